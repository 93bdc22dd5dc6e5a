"""URL filters by a character language-model ratio (operator 10), in built-in functions only.

URLs that the rules accept and reject teach two variable-order Markov models over characters,
smoothed by interpolation down to a uniform distribution. A URL that no rule fits is judged by the
difference of its log-likelihoods under the two, divided by its length, against a threshold that
all but a set share of accepted URLs of sites unseen in training passes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rules (verdict, host, path), fixed values.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Longest context in characters, characters of the uniform distribution, and the discount of a context with few counts.
ORDER, ALPHABET, DISCOUNT = 5, 128, 4.0
#: Share of accepted URLs of unseen sites below whose score a URL is blocked.
MISS = 0.01
#: Of so many sites one is held out to set the threshold.
HELD = 2
#: Grams up to which the model is broadcast (about 40 bytes each); beyond, the join is shuffled.
BROADCAST_GRAMS = 300_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape_of(url: Column) -> Column:
    """What the models read: lower case, each run of digits one 0, opened by a mark and closed by another.

    The registered domain and the path's first segment are left out. Rules go by them, so the models
    would only learn the rules once more and carry them to every host alike. A url without :// is
    read whole.
    """
    host, rest = host_of(url), F.regexp_extract(url, "(?s)^.*?://[^/?#]*(.*)$", 1)
    inner = F.concat(F.regexp_replace(host, "\\.?[^.]*\\.[^.]*$", ""), F.regexp_replace(rest, "^/[^/?#]*/", "/"))
    text = F.when(F.instr(url, "://") > 0, inner).otherwise(F.coalesce(url, F.lit("")))
    return F.concat(F.lit("\x02"), F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[0-9]+", "0"), F.lit("\x03"))


def site_of(shape: Column) -> Column:
    """0 for one site in HELD, by the label before the registered domain, whose accepted urls set the threshold and are not seen by the models that score them."""
    site = F.regexp_extract(shape, "^\x02(?:[^/?#]*\\.)?([^./?#\x03]*)", 1)
    return F.conv(F.left(F.md5(site), F.lit(4)), 16, 10).cast("int") % HELD


def _grams(shape: Column) -> Column:
    """For each place but the first: its grams, from one character up to ORDER before it and itself."""
    places = F.sequence(F.lit(2), F.length(shape))
    return F.transform(places, lambda i: F.transform(F.sequence(F.lit(0), F.least(F.lit(ORDER), i - 1)), lambda k: F.substring(shape, i - k, k + 1)))


def ratio_model(shapes: DataFrame) -> DataFrame:
    """gram, ratio: log10 P(last character | those before) under the accepted less the rejected model, for every gram of either.

    shapes: shape, good and bad (how often accepted and rejected; each shape teaches once, however many its urls). Probabilities of a gram come from
    its counts and from the gram without its first character, by one join for each length.
    """
    once = [F.least(k, F.lit(1)).alias(k) for k in ("good", "bad")]
    each = shapes.select(*once, F.explode(F.flatten(_grams(F.col("shape")))).alias("gram"))
    counts = each.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).withColumn("context", F.expr("left(gram, length(gram) - 1)"))
    own = Window.partitionBy("context")
    counts = common.staged(counts.withColumns({"good_context": F.sum("good").over(own), "bad_context": F.sum("bad").over(own)}))
    lower, out = None, None
    for size in range(1, ORDER + 2):
        now = counts.where(F.length("gram") == size)
        if lower is None:
            now = now.withColumns({"good_low": F.lit(1 / ALPHABET), "bad_low": F.lit(1 / ALPHABET)})
        else:
            now = now.withColumn("shorter", F.expr("substring(gram, 2)")).join(lower, "shorter")
        p = {f"{k}_p": (F.col(k) + DISCOUNT * F.col(f"{k}_low")) / (F.col(f"{k}_context") + DISCOUNT) for k in ("good", "bad")}
        now = common.staged(now.withColumns(p).select("gram", "good_p", "bad_p"))
        rows = now.select("gram", (F.log10("good_p") - F.log10("bad_p")).alias("ratio"))
        out = rows if out is None else out.unionByName(rows)
        lower = now.select(F.col("gram").alias("shorter"), F.col("good_p").alias("good_low"), F.col("bad_p").alias("bad_low"))
    return out


def scored(shapes: DataFrame, model: DataFrame) -> DataFrame:
    """shape, score: the mean over characters of the ratio of the longest gram that the model has."""
    small = model.count() <= BROADCAST_GRAMS
    places = shapes.select("shape", F.posexplode(_grams(F.col("shape"))).alias("at", "grams")).select("shape", "at", F.explode("grams").alias("gram"))
    found = places.join(F.broadcast(model) if small else model, "gram")
    best = found.groupBy("shape", "at").agg(F.max_by("ratio", F.length("gram")).alias("ratio"))
    return best.groupBy("shape").agg((F.sum("ratio") / (F.length("shape") - 1)).alias("score"))


def url_filter(pages: DataFrame) -> DataFrame:
    """Judges every url.

    One row per row of pages: page_id, host, path, rule, verdict, score (null where a rule decides).
    A null url or one without :// has an empty host and path, fits no rule and is judged by the
    models as text. Without accepted and rejected urls to learn from, or on characters never seen,
    the ratio is 0. The threshold is never above 0, so such urls are allowed. Repeated rows are each
    judged; other columns are left out. Urls are counted by shape before anything is shuffled, so a
    host with a third of all rows is a few counts.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), shape_of(F.col("url")).alias("shape"))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path")))
    shapes = common.staged(rows.groupBy("shape").agg(*[F.count_if(F.col("fit.verdict") == v).alias(n) for v, n in (("allow", "good"), ("block", "bad"))], F.count_if(F.col("fit").isNull()).alias("open")))
    taught, held = shapes.where("good + bad > 0"), site_of(F.col("shape")) == 0
    unseen = scored(taught.where(held & (F.col("good") > 0)).select("shape"), ratio_model(taught.where(~held))).join(taught.select("shape", "good"), "shape")
    limit = threshold(unseen.groupBy(F.round("score", 4).alias("score")).agg(F.sum("good").alias("good")))
    score = scored(shapes.where("open > 0").select("shape"), ratio_model(taught))
    return rows.join(score, "shape", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.coalesce("score", F.lit(0.0)) < limit, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("fit").isNull(), F.round(F.coalesce("score", F.lit(0.0)), 6)).alias("score"),
    )


def threshold(by_score: DataFrame) -> float:
    """The score that all but MISS of the accepted urls reach, at most 0. by_score: score to 4 places, so its rows are few."""
    low = by_score.agg(F.percentile("score", F.lit(MISS), F.col("good"))).first()[0]
    return 0.0 if low is None else min(0.0, math.floor(low * 1e4) / 1e4)


def _model_sql(name: str, shapes: str) -> str:
    """ratio_model in SQL: a table name (gram, ratio) from a table shapes (shape, good, bad)."""
    out = [
        f"{name}_each AS (SELECT least(good, 1) AS good, least(bad, 1) AS bad, gram FROM {shapes} JOIN grams USING (shape))",
        f"{name}_sums AS (SELECT gram, sum(good) AS good, sum(bad) AS bad FROM {name}_each GROUP BY gram)",
        f"{name}_counts AS (SELECT *, sum(good) OVER w AS good_context, sum(bad) OVER w AS bad_context FROM {name}_sums WINDOW w AS (PARTITION BY left(gram, length(gram) - 1)))",
    ]
    for size in range(1, ORDER + 2):
        low = [f"{1 / ALPHABET}"] * 2 if size == 1 else ["b.good_p", "b.bad_p"]
        p = [f"(c.{k} + {DISCOUNT} * {x}) / (c.{k}_context + {DISCOUNT})" for k, x in zip(("good", "bad"), low, strict=True)]
        join = "" if size == 1 else f" JOIN {name}_{size - 1} b ON b.gram = substring(c.gram, 2)"
        out.append(f"{name}_{size} AS (SELECT c.gram, {p[0]} AS good_p, {p[1]} AS bad_p FROM {name}_counts c{join} WHERE length(c.gram) = {size})")
    every = " UNION ALL ".join(f"SELECT * FROM {name}_{size}" for size in range(1, ORDER + 2))
    return ", ".join([*out, f"{name} AS (SELECT gram, log10(good_p) - log10(bad_p) AS ratio FROM ({every}))"])


def _scored_sql(name: str, shapes: str, model: str) -> str:
    """scored in SQL: a table name (shape, score)."""
    return f"""{name}_best AS (SELECT shape, pos, max_by(ratio, length(gram)) AS ratio FROM {shapes} JOIN grams USING (shape) JOIN {model} USING (gram) GROUP BY shape, pos),
{name} AS (SELECT shape, sum(ratio) / (length(shape) - 1) AS score FROM {name}_best GROUP BY shape)"""


_FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))

# The same result in DuckDB's SQL.
SQL = f"""
WITH u AS (SELECT page_id, url, coalesce(url, '') AS t FROM pages),
h AS (SELECT *, translate(regexp_extract(t, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(t, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
      regexp_extract(t, '(?s)^.*?://[^/?#]*(.*)$', 1) AS rest FROM u),
s AS (SELECT *, chr(2) || regexp_replace(translate(CASE WHEN instr(url, '://') > 0 THEN regexp_replace(host, '\\.?[^.]*\\.[^.]*$', '') || regexp_replace(rest, '^/[^/?#]*/', '/') ELSE t END,
      '{_UPPER}', '{_LOWER}'), '[0-9]+', '0', 'g') || chr(3) AS shape, CASE {_FITS} END AS fit FROM h),
shapes AS (SELECT shape, count_if(starts_with(fit, 'allow')) AS good, count_if(starts_with(fit, 'block')) AS bad, count_if(fit IS NULL) AS open,
           ('0x' || left(md5(regexp_extract(shape, '^\\x02(?:[^/?#]*\\.)?([^./?#\\x03]*)', 1)), 4))::INT % {HELD} = 0 AS held FROM s GROUP BY shape),
places AS (SELECT shape, unnest(range(2, length(shape) + 1)) AS pos FROM shapes),
grams AS (SELECT shape, pos, substring(shape, pos - k, k + 1) AS gram FROM (SELECT shape, pos, unnest(range(0, least({ORDER}, pos - 1) + 1)) AS k FROM places)),
taught AS (SELECT shape, good, bad FROM shapes WHERE good + bad > 0),
half AS (SELECT shape, good, bad FROM shapes WHERE good + bad > 0 AND NOT held),
tried AS (SELECT shape FROM shapes WHERE good > 0 AND held),
opened AS (SELECT shape FROM shapes WHERE open > 0),
{_model_sql("part", "half")}, {_scored_sql("unseen", "tried", "part")},
low AS (SELECT quantile_cont(round(score, 4), {MISS}) AS low FROM (SELECT score, unnest(range(good::BIGINT)) FROM unseen JOIN taught USING (shape))),
{_model_sql("whole", "taught")}, {_scored_sql("judged", "opened", "whole")}
SELECT page_id, host, path, substring(fit, 7) AS rule,
       coalesce(left(fit, 5), CASE WHEN coalesce(score, 0) < coalesce((SELECT least(0, floor(low * 1e4) / 1e4) FROM low), 0) THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN fit IS NULL THEN round(coalesce(score, 0), 6) END AS score
FROM s LEFT JOIN judged USING (shape)
"""


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(common.table(spark, sf_dir, "pages"))
