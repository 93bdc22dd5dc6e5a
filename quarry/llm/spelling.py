"""Spelling variants by a rare-first q-gram prefix filter (operator 11).

Two words one edit apart share all but two of their bigrams, so of the three bigrams of each that are
the rarest of all (one order for the whole vocabulary) at least one is the same bigram of both, moved
by a place at most. The edit is then either after it, and both words are equal up to it, or before it,
and they're equal from it on. What is left over of the shorter word falls into two halves, of which the
edit spares one. Bigram, place, the shorter word's length, the equal end and the spared half together
are the key by which words are joined: no group of words that merely share a bigram is ever paired.
Every candidate is verified by its edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Code points of a word and its occurrences, at least; and how many times as frequent a form is.
LEAST_CHARS, LEAST_COUNT, RATIO = 7, 2, 10
#: One occurrence in so many, by its hash, loses a letter.
NOISE = 31
#: The rarest bigrams of a word that it is joined by: one more than an edit can touch.
PREFIX = 3
#: Distinct words that a task counts before it hands its counts on.
HELD_WORDS = 200_000

_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_CHARS},}}")
#: Letters by their Latin-1 byte: a-z, then U+00C0 to U+00FF.
_LETTERS = 26 + 64
_LETTER = np.zeros(256, np.int64)
_LETTER[97:123] = np.arange(26)
_LETTER[0xC0:] = 26 + np.arange(64)

_rng = np.random.RandomState(1_311)
_VALUE = _rng.randint(0, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def occurrences(doc_id: int | None, text: str) -> Counter:
    """The words of one text with their counts, after the letters that the hash takes."""
    start, out = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode())), Counter()
    for word, n in Counter(_RUN.findall(text.encode().lower().decode())).items():  # bytes.lower takes A-Z only
        h = zlib.crc32(word.encode(), start)
        if h % NOISE == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
            if len(word) < LEAST_CHARS:
                continue
        out[word] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: words of docs (doc_id, text) that occur often enough; each task counts before anything is shuffled."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for block in common.blocks(batches):
            for i, text in zip(block.column(0).to_pylist(), block.column(1).fill_null(b"").to_pylist(), strict=True):
                seen.update(occurrences(i, text.decode()))
            if len(seen) > HELD_WORDS:
                yield out()
                seen = Counter()
        yield out()

    counted = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Latin-1 bytes of all words, and where each starts (one more at the end)."""
    text = words.to_pylist()
    return np.frombuffer("".join(text).encode("latin-1"), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in text], dtype=np.int64)])


def _bigrams(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bigrams within words: number, word, and place in the word."""
    letter = _LETTER[codes]
    word = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = np.flatnonzero(word[1:] == word[:-1])
    return letter[inside] * _LETTERS + letter[inside + 1], word[inside], inside - at[word[inside]]


def bigram_ranks(words: DataFrame) -> np.ndarray:
    """The rank of every bigram by how often words (word) hold it, rarest first; 90 x 90 at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_LETTERS**2, np.int64)
        for b in batches:
            total += np.bincount(_bigrams(*_codes(b.column(0)))[0], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bigram", "n"])

    n = np.zeros(_LETTERS**2, np.int64)
    for r in words.select("word").mapInArrow(run, "bigram long, n long").groupBy("bigram").agg(F.sum("n").alias("n")).collect():
        n[r["bigram"]] = r["n"]
    rank = np.empty(len(n), np.int64)
    rank[np.lexsort((np.arange(len(n)), n))] = np.arange(len(n))
    return rank


def prefixes(codes: np.ndarray, at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and place of each word's PREFIX rarest bigrams."""
    bigram, word, place = _bigrams(codes, at)
    order = np.lexsort((place, rank[bigram], word))
    word = word[order]
    nth = np.arange(len(word)) - np.searchsorted(word, word)
    chosen = order[nth < PREFIX]
    return word[nth < PREFIX], place[chosen]


def keys(codes: np.ndarray, at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word, key, short: every key of every word once; short where the word may be the shorter of a pair."""
    size = np.diff(at)
    word, p = prefixes(codes, at, rank)
    place = np.arange(len(codes)) - np.repeat(at[:-1], size)
    longest = int(size.max(initial=0)) + 1
    with np.errstate(over="ignore"):
        one, none = np.ones(1, np.uint64), np.zeros(1, np.uint64)
        power = np.concatenate([one, np.cumprod(np.full(longest, _BASE, np.uint64))])
        back = np.concatenate([one, np.cumprod(np.full(longest, _BACK, np.uint64))])
        total = np.concatenate([none, np.cumsum(_VALUE[codes] * power[place])])

        def part(w: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
            """Hash of the code points start to end of words w, wherever they stand."""
            return common.mix((total[at[w] + end] - total[at[w] + start]) * back[start] + (end - start).astype(np.uint64))

        found = []
        for longer in (0, 1):  # the shorter word of the pair has as many code points, or one fewer
            for after in (True, False):  # the edit comes after the bigram, or before it
                w, q, n = word, p, size[word]
                rest = n - longer - (q + 2 if after else n - q)  # of the shorter word
                ok = rest >= 0
                w, q, n, rest = w[ok], q[ok], n[ok], rest[ok]
                half, zero = rest // 2, np.zeros(len(w), np.int64)
                least = n - longer
                fixed = q if after else n - q
                for first in (True, False):  # the half that is spared
                    use = slice(None) if first else rest > 0
                    if after:
                        spans = [(zero, q + 2 + half)] if first else [(zero, q + 2), (n - (rest - half), n)]
                    else:
                        spans = [(zero, half), (q, n)] if first else [(q - (rest - half), n)]
                    tag = np.uint64(1 + 2 * after + first)
                    h = common.mix((least.astype(np.uint64) << np.uint64(32)) + (fixed.astype(np.uint64) << np.uint64(3)) + tag)
                    for s, e in spans:
                        h = common.mix(h * np.uint64(31) + part(w, s, e))
                    found.append((w[use], h[use].view(np.int64), np.full(len(w), not longer)[use]))
    w, h, short = (np.concatenate([f[k] for f in found]) for k in range(3))
    once = np.lexsort((h, w))
    w, h, short = w[once], h[once], short[once]
    new = np.concatenate([[True], (w[1:] != w[:-1]) | (h[1:] != h[:-1])]) if len(w) else np.zeros(0, bool)
    return w[new], h[new], short[new]


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: ids and counts of words (id, word, n) that are one edit apart, each pair once."""
    rank = bigram_ranks(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                w, h, short = keys(*_codes(part.column(1)), rank)
                rows = part.take(pa.array(w))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(short), *rows.columns], names=["key", "short", "id", "word", "n"])

    common.small_batches(words.sparkSession, 16_384)
    keyed = words.select("id", "word", "n").mapInArrow(run, "key long, short boolean, id long, word string, n long")
    left, right = keyed.alias("l"), keyed.alias("r")
    apart = F.col("l.short") & (~F.col("r.short") | (F.col("l.id") < F.col("r.id"))) & (F.levenshtein("l.word", "r.word", 1) == 1)
    found = left.join(right, (F.col("l.key") == F.col("r.key")) & apart)
    return found.select(F.col("l.id").alias("a"), F.col("l.n").alias("n_a"), F.col("r.id").alias("b"), F.col("r.n").alias("n_b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """id, root: where the forms (id, form) of each id end; steps double, and counts grow tenfold with each step, so rounds are few."""
    step = common.staged(forms.select("id", F.col("form").alias("root")))
    while True:
        ahead = step.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        step = common.staged(step.join(ahead, "root", "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if step.where("_moved").isEmpty():
            return step.drop("_moved")
        step = step.drop("_moved")


def variants(docs: DataFrame) -> DataFrame:
    """Groups the words of whole texts (docs: doc_id, text) by spelling: word, form, root, n, n_near, form_n.

    One row a word that occurs often enough. form is the near word of the largest n (ties: the smallest
    in code-point order) if that is at least RATIO times the word's own, else null; root is where forms
    lead, the word itself where there is none. A null text has no words, a null doc_id counts as empty
    text in the hash, repeated rows count each, an empty table gives no rows, other columns are left out.
    """
    counted = vocabulary(docs).orderBy("word")
    words = common.staged(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"))  # ids in the words' order
    pairs = common.staged(near_pairs(words))
    both = pairs.select("a", "n_a", "b", "n_b").unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = F.max(F.struct(F.col("n_b").alias("n"), (-F.col("b")).alias("b")))
    near = both.groupBy(F.col("a").alias("id")).agg(F.first("n_a").alias("n"), F.count("*").alias("n_near"), best.alias("best"))
    fits = F.col("best.n") >= RATIO * F.col("n")
    near = common.staged(near.select("id", "n_near", F.when(fits, -F.col("best.b")).alias("form"), F.when(fits, F.col("best.n")).alias("form_n")))
    forms = near.where("form IS NOT NULL").select("id", "form")
    names = words.select(F.col("id").alias("to"), F.col("word").alias("name"))
    ends = roots(forms).select("id", F.col("root").alias("to")).join(names, "to").select("id", F.col("name").alias("root"))
    named = forms.select("id", F.col("form").alias("to")).join(names, "to").select("id", F.col("name").alias("form")).join(ends, "id")
    out = words.join(near.select("id", "n_near", "form_n"), "id", "left").join(named, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(common.table(spark, sf_dir, "documents"))


#: The same by deletion: words one edit apart are equal once one code point is taken from the longer, or one at the same place from both.
SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS step),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
bytes AS (
  SELECT run, k, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS b
  FROM runs WHERE length(run) >= 7),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(step[(xor(c, x) & 255) + 1], c >> 8))) AS h FROM bytes, crc),
words AS (
  SELECT word, sum(k)::BIGINT AS n
  FROM (SELECT k, CASE WHEN h % 31 = 0 THEN concat(left(run, (h % length(run))::INT), substr(run, (h % length(run))::INT + 2)) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (
  SELECT word, n, i, concat(left(word, (i - 1)::INT), substr(word, (i + 1)::INT)) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT DISTINCT x.word, y.word AS other, y.n FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN words y ON x.rest = y.word
  UNION SELECT y.word, x.word, x.n FROM cut x JOIN words y ON x.rest = y.word),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS form_n FROM near GROUP BY word),
form AS (
  SELECT w.word, w.n, b.n_near, CASE WHEN b.form_n >= 10 * w.n THEN b.form_n END AS form_n,
    CASE WHEN b.form_n >= 10 * w.n THEN (SELECT min(other) FROM near m WHERE m.word = w.word AND m.n = b.form_n) END AS form
  FROM words w LEFT JOIN best b ON b.word = w.word),
walk AS (
  SELECT word, word AS last, 0 AS depth FROM form
  UNION ALL SELECT walk.word, form.form, depth + 1 FROM walk JOIN form ON form.word = walk.last WHERE form.form IS NOT NULL),
ends AS (SELECT word, arg_max(last, depth) AS root FROM walk GROUP BY word)
SELECT f.word, f.form, e.root, f.n, coalesce(f.n_near, 0) AS n_near, f.form_n FROM form f JOIN ends e ON e.word = f.word
"""
