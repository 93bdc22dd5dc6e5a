"""Quality rules by cross-document line frequency (operator 8), in built-in functions only.

Lines are normalised and hashed; for each host the distinct documents that hold a line are counted.
Lines in more documents of a host than LINE_DOCUMENTS, or than LINE_PERCENT of them all, are removed,
and a document of which too little stays is rejected. Texts are read once: counts, text hashes and
line hashes are written together, and all else works on those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Distinct documents of a host above which a line is boilerplate; the percent of them all above which it is so too, from LEAST_DOCUMENTS on.
LINE_DOCUMENTS, LINE_PERCENT, LEAST_DOCUMENTS = 50, 10, 4
#: The percent of its word characters that a document must keep once such lines are gone.
LEFT_PERCENT = 20
#: Rows of the table of removed lines up to which it is broadcast (16 bytes each); beyond, the join is shuffled.
BROADCAST_LINES = 500_000
#: Words fewer than which fail, percent of repeated words above which fail, and the window of words that repeats.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8

_BLANKS = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _windows(words: Column) -> Column:
    """A hash of each window of WINDOW words; empty for shorter texts."""
    last = F.size(words) - WINDOW + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words that lie in a window found more than once: equal hashes meet by sorting, then overlaps of sorted places are taken off."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twins(s: Column) -> Column:
        same = lambda x, i, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, i, i - 1) | same(x, i, i + 1)), lambda x: x["i"]))

    def spread(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)

    # arrays of one element bind what is used more than once inside a lambda
    return F.transform(F.transform(F.array(placed), twins), spread)[0]


def text_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0)
    step = docs.withColumns({
        "_words": words_of(text),
        "word_chars": F.length(F.translate(text, _BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "_split": lines,
    })
    step = step.withColumns({"n_words": F.size("_words").cast("long"), "n_dup_lines": (F.size("_split") - F.size(F.array_distinct("_split"))).cast("long"), "_windows": _windows(F.col("_words"))}).drop("_words", "_split")
    repeated = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), _covered(F.col("_windows"))).otherwise(0)
    step = step.withColumn("n_repeat_words", repeated.cast("long")).drop("_windows")
    return step.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def normalised_lines(text: Column) -> Column:
    """Each line with words: its hash once lower-cased, digits to 0, blanks to single spaces; and its word characters."""
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[0-9]+", "0"), "[\\x20\\x09-\\x0D]+", " "))
    every = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(F.xxhash64(plain(x)).alias("line"), F.length(F.translate(x, _BLANKS, "")).alias("chars")))
    return F.filter(every, lambda x: x["chars"] > 0)


def removed_chars(rows: DataFrame) -> DataFrame:
    """_row, removed_chars: the word characters on boilerplate lines of rows (_row, _host, _text, _lines), where there are any.

    Copies of a text on a host are one document there: only the first row of each (host, text)
    counts. Documents by lines are summed before they are shuffled, so that one line or one host in
    a third of all rows is a partial sum from each task.
    """
    firsts = rows.groupBy("_host", "_text").agg(F.min("_row").alias("_row"))
    total = firsts.groupBy("_host").agg(F.count("*").alias("_total"))
    distinct = rows.select("_row", "_host", "_lines").join(firsts.select("_row"), "_row", "left_semi")
    distinct = distinct.select("_host", F.explode(F.array_distinct(F.transform("_lines", lambda x: x["line"]))).alias("line"))
    often = distinct.groupBy("_host", "line").agg(F.count("*").alias("_docs")).where(F.col("_docs") >= LEAST_DOCUMENTS).join(total, "_host")
    boilerplate = (F.col("_docs") > LINE_DOCUMENTS) | (100 * F.col("_docs") > LINE_PERCENT * F.col("_total"))
    often = common.sized(common.staged(often.where(boilerplate).select("_host", "line")), BROADCAST_LINES)
    each = rows.select("_row", "_host", F.explode("_lines").alias("_l")).select("_row", "_host", F.col("_l.line").alias("line"), F.col("_l.chars").alias("chars"))
    return each.join(often, ["_host", "line"], "left_semi").groupBy("_row").agg(F.sum("chars").alias("removed_chars"))


def line_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """Judges every whole text.

    One row per row of docs: doc_id, the counts of text_counts, removed_chars, and kept: false if
    base_failed or if less than LEFT_PERCENT of the word characters stay once boilerplate lines are
    gone. A null or empty text fails by its few words; a null host is a host of its own; repeated
    rows each get a row; an empty table gives no rows; other columns are left out, whatever their names.
    """
    rows = docs.select("doc_id", "text", F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("_host"))
    rows = text_counts(rows.withColumns({"_text": F.xxhash64("text"), "_lines": normalised_lines(F.col("text"))})).drop("text")
    rows = common.staged(rows.withColumn("_row", F.monotonically_increasing_id()))  # written once, so a row's number is the same wherever it is read
    joined = rows.drop("_lines", "_text", "_host").join(removed_chars(rows), "_row", "left").withColumn("removed_chars", F.coalesce("removed_chars", F.lit(0)))
    kept = ~F.col("base_failed") & (100 * (F.col("word_chars") - F.col("removed_chars")) >= LEFT_PERCENT * F.col("word_chars"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_chars", kept.alias("kept"))


# The same result in DuckDB's SQL, over texts and lines themselves where the operator has hashes.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, text, source FROM documents),
c AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
n AS (SELECT *, len(words) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols FROM c),
l AS (SELECT r, source, text, unnest(string_split(t, chr(10))) AS line FROM d),
held AS (SELECT r, source, text, line, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars,
         trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS plain
         FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
twice AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM held GROUP BY r),
win AS (SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS w FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM c)),
again AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM again) GROUP BY r),
total AS (SELECT source, count(DISTINCT coalesce('=' || text, '')) AS total FROM d GROUP BY source),
often AS (SELECT h.source, plain FROM (SELECT source, plain, count(DISTINCT coalesce('=' || text, '')) AS docs FROM held GROUP BY source, plain) h
          JOIN total ON h.source IS NOT DISTINCT FROM total.source
          WHERE docs >= {LEAST_DOCUMENTS} AND (docs > {LINE_DOCUMENTS} OR 100 * docs > {LINE_PERCENT} * total)),
gone AS (SELECT r, sum(chars)::BIGINT AS removed_chars FROM held JOIN often ON held.source IS NOT DISTINCT FROM often.source AND held.plain = often.plain GROUP BY r),
s AS (SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
      coalesce(removed_chars, 0) AS removed_chars FROM n LEFT JOIN twice USING (r) LEFT JOIN covered USING (r) LEFT JOIN gone USING (r)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND 100 * (word_chars - removed_chars) >= {LEFT_PERCENT} * word_chars AS kept FROM f
"""


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(common.table(spark, sf_dir, "documents"))
