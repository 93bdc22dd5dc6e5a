"""Ranked search over names and texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..plans import grammar
from ..sources.store import kept
from .relational import first_by

#: Tokens of a vocabulary that nearest_token broadcasts at most.
VOCABULARY = 10_000


def postings(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """The index: key, term, tf, doc_len; only tokens are shuffled, summed before."""
    rows = docs.select(key, terms.alias("_terms"))
    return rows.select(key, F.size("_terms").alias("doc_len"), F.explode("_terms").alias("term")).groupBy(key, "doc_len", "term").agg(F.count("*").alias("tf"))


def prefix_hits(index: DataFrame, key: str, query: list[str]) -> DataFrame:
    """q, key, doc_len, tf: one read of the index for all prefixes; the words that one prefix begins sum up."""
    any_of = F.lit(False)
    for q in query:
        any_of = any_of | F.col("term").startswith(q)
    own = F.filter(F.array(*[F.lit(q) for q in query]), lambda q: F.startswith("term", q))
    return index.where(any_of).select(key, "doc_len", "tf", F.explode(own).alias("q")).groupBy("q", key, "doc_len").agg(F.sum("tf").alias("tf"))


def weighed(hits: DataFrame, key: str, sums: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score of hits (q, key, doc_len, tf) in a corpus of sums (documents, mean_length; one row); least idf 1e-6."""
    df = hits.groupBy("q").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("documents") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("mean_length")))
    return hits.join(F.broadcast(df.join(F.broadcast(sums))), "q").groupBy(key).agg(F.sum(idf * weight).alias("score"))  # one row a query term


def bm25(index: DataFrame, key: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """TXT-4: scores by prefix terms, each prefix one phrase whose frequency sums over its words. Counts of the whole index are one broadcast row."""
    sums = index.select(key, "doc_len").distinct().agg(F.count("*").alias("documents"), F.avg("doc_len").alias("mean_length"))
    return weighed(prefix_hits(index, key, query), key, sums, k1, b)


def promoted(hits: DataFrame, name: str, query: str, limit: int) -> DataFrame:
    """TXT-4, SRT-1: hits (score) with rank, the best first: exact names and prefixes before all others, then by score, length and name."""
    ranked = hits.withColumn("rank", name_rank(F.col(name), query))
    return ranked.orderBy("rank", F.desc("score"), F.length(name), name).limit(limit)


def search(symbols: DataFrame, query: str, limit: int, kinds: str | None = None, modifiers: str | None = None, origin: str = "source") -> DataFrame:
    """TXT-4 to TXT-7: symbols (symbol_id, fq_name, kind, modifiers, origin) by relevance: place, symbol_id, fq_name.

    Filters hold before limits. Each term finds names by words, topped up by names that hold it as it
    stands; several terms each have their share of the limit first, in their order, and what is left
    goes to the best hits of the whole query.
    """
    index = kept(postings(symbols, "symbol_id", scalars.index_terms(F.col("fq_name"))))  # written once, read for each list
    allowed = symbols.where(grammar.kind_filter(F.col("kind"), kinds) & grammar.tag_filter(F.col("modifiers"), modifiers) & grammar.origin_filter(F.col("origin"), origin)).select("symbol_id", "fq_name")

    def ranked(text: str, take: int) -> DataFrame:
        words = list(dict.fromkeys(x.lower() for x in re.findall(r"[^\W_]+", text) if len(x) >= 2))
        order = ["_from", "rank", "_score", F.length("fq_name"), "fq_name"]
        like = search_like(allowed, "fq_name", text, take).select("symbol_id", "fq_name", "rank", F.lit(0.0).alias("_score"), F.lit(1).alias("_from"))
        if words:
            found = promoted(allowed.join(bm25(index, "symbol_id", words), "symbol_id"), "fq_name", text, take)
            like = found.select("symbol_id", "fq_name", "rank", (-F.col("score")).alias("_score"), F.lit(0).alias("_from")).unionByName(like)
            like = first_by(like, ["symbol_id"], F.col("_from"), F.col("rank"))
        head = like.orderBy(*order).limit(take)
        return head.select("symbol_id", "fq_name", F.row_number().over(Window.orderBy(*order)).alias("nth"))  # take rows at most

    terms = query.split()
    if not terms:
        return allowed.limit(0).select(F.lit(0).alias("place"), "symbol_id", "fq_name")
    lists = [(text, ranked(text, max(1, limit // len(terms)))) for text in terms] if len(terms) > 1 else []
    both = None
    for k, (_, d) in enumerate([*lists, (query, ranked(query, limit))]):
        d = d.withColumn("term", F.lit(k))
        both = d if both is None else both.unionByName(d)
    once = first_by(both, ["symbol_id"], F.col("term"), F.col("nth")).orderBy("term", "nth").limit(limit)
    return once.select((F.row_number().over(Window.orderBy("term", "nth")) - 1).alias("place"), "symbol_id", "fq_name")


def name_rank(name: Column, query: str) -> Column:
    """TXT-4, TXT-5: 0 the name itself, 1 a prefix whatever its case, 2 elsewhere."""
    return F.when(name == query, 0).when(F.lower(name).startswith(query.lower()), 1).otherwise(2)


def search_like(names: DataFrame, column: str, query: str, limit: int) -> DataFrame:
    """TXT-5, SRT-2: names that hold the query, whatever its case; by rank, length and name."""
    c = F.col(column)
    hits = names.where(F.contains(F.lower(c), F.lit(query.lower()))).withColumn("rank", name_rank(c, query))
    return hits.orderBy("rank", F.length(column), column).limit(limit)


def topped_up(first: DataFrame, second: DataFrame, key: str, limit: int) -> DataFrame:
    """TXT-6: first (rank), then second, each key once."""
    both = first.select(key, "rank", F.lit(0).alias("_from")).unionByName(second.select(key, "rank", F.lit(1).alias("_from")))
    return first_by(both, [key], F.col("_from"), F.col("rank")).orderBy("_from", "rank", F.length(key), key).limit(limit).select(key, "rank")


def near_names(names: DataFrame, column: str, query: str, limit: int) -> DataFrame:
    """TXT-8, TXT-9, SRT-3: names whose last part, without parameters, is within an edit distance of a quarter of the query's length, 1 to 3.

    The nearest first, then by length and name as a whole; queries shorter than 3 find none. With a
    column origin, only names of source count.
    """
    tolerance = min(max(len(query) // 4, 1), 3)
    c = scalars.unqualified(F.col(column))
    if "origin" in names.columns:
        names = names.where(grammar.origin_filter(F.col("origin"), "source"))
    near = names.where(F.abs(F.length(c) - len(query)) <= tolerance).withColumn("distance", F.levenshtein(F.lower(c), F.lit(query.lower()), tolerance))
    return near.where((F.col("distance") >= 0) & F.lit(len(query) >= 3)).orderBy("distance", F.length(column), column).limit(limit)


def nearest_token(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """TXT-10: for each word the one nearest token of a vocabulary within its tolerance; a tie or a token itself gives none.

    Plural and underscores cost nothing. The vocabulary is that of an argument: tens of tokens.
    """
    w, t = F.lower("word"), F.lower("token")
    bare = lambda x: F.regexp_replace(x, "_", "")
    stem = lambda x: F.regexp_replace(x, "s+$", "")
    alike = (bare(w) == bare(t)) | ((F.length(w) > 1) & (F.length(t) > 1) & (stem(w) == stem(t)))
    edits = F.levenshtein(w, t, 3)
    distance = F.when(alike, 0).when(edits < 0, 4).otherwise(edits)
    if vocabulary.limit(VOCABULARY + 1).count() > VOCABULARY:
        raise ValueError(f"the vocabulary of an argument has {VOCABULARY} tokens at most")
    tokens = vocabulary.agg(F.collect_set("token").alias("tokens"))
    each = words.join(F.broadcast(tokens)).select("word", F.explode("tokens").alias("token")).withColumns({"distance": distance, "same": w == t})
    best = each.groupBy("word").agg(F.min("distance").alias("distance"), F.bool_or("same").alias("same"))
    close = each.drop("same").join(best.where("NOT same").drop("same"), ["word", "distance"])
    one = close.groupBy("word", "distance").agg(F.count("*").alias("n"), F.min("token").alias("token")).where("n = 1")
    return one.where(F.col("distance") <= F.least(F.greatest(F.floor(F.length("token") / 4), F.lit(1)), F.lit(3))).select("word", "token")


def did_you_mean(names: DataFrame, column: str, query: str, limit: int) -> DataFrame:
    """TXT-11: names that hold the query; without any, near names."""
    held = names.where(F.lower(column).contains(query.lower())).select(column)
    near = near_names(names, column, query, limit).select(column)
    any_held = held.limit(1).agg(F.count("*").alias("_n"))
    return held.unionByName(near.join(any_held.where("_n = 0")).drop("_n")).distinct().orderBy(F.length(column), column).limit(limit)


def uncovered_terms(terms: DataFrame, index: DataFrame) -> DataFrame:
    """TXT-12: query terms that begin no indexed term. The terms of one query are broadcast, never the vocabulary: each task finds which of them begin its own words."""
    if terms.limit(VOCABULARY + 1).count() > VOCABULARY:
        raise ValueError(f"a query has {VOCABULARY} terms at most")
    asked = F.broadcast(terms.agg(F.collect_set("term").alias("_asked")))
    begun = index.select(F.col("term").alias("_t")).join(asked).select(F.explode(F.filter("_asked", lambda q: F.startswith("_t", q))).alias("term")).distinct()
    return terms.join(begun, "term", "left_anti")


def log_score(entries: DataFrame, tokens: list[str]) -> DataFrame:
    """TXT-13: entries (terms map, title, classes, tags) with score: term counts, 3 for the title, 5 for a class, 4 for a tag; for each query token."""
    score = F.lit(0)
    for t in tokens:
        has = lambda c, t=t: F.exists(c, lambda x: F.lower(x) == t)
        score = score + F.coalesce(F.element_at("terms", F.lit(t)), F.lit(0)) + F.when(F.col("title").ilike(f"%{t}%"), 3).otherwise(0) + F.when(has("classes"), 5).otherwise(0) + F.when(has("tags"), 4).otherwise(0)
    return entries.withColumn("score", score.cast("double"))


def syntax_rank(name: Column, full: Column, query: str, is_member: Column) -> Column:
    """TXT-15: 0 the name, 1 the full name's end, 2 a prefix, 3 elsewhere; members 10 later; null without a match."""
    q = query.lower()
    rank = F.when(F.lower(name) == q, 0).when(F.lower(full).endswith(f".{q}"), 1).when(F.lower(name).startswith(q), 2).when(F.lower(name).contains(q), 3)
    return rank + F.when(is_member, 10).otherwise(0)


def shorter(rows: DataFrame, one: Column, two: Column) -> DataFrame:
    """TXT-16: the shorter of two renderings as JSON; the first where they are alike."""
    a, b = F.to_json(one), F.to_json(two)
    return rows.withColumn("rendered", F.when(F.length(b) < F.length(a), b).otherwise(a))

