"""Counts over edges and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reference_counts(edges: DataFrame, symbols: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """JOIN-1, JOIN-2, AGG-2 to AGG-5: for each symbol that edges reach: distinct callers, implementations, overrides and tests, and distinct callees.

    edges: from_symbol, to_symbol, edge_kind; symbols: symbol_id, is_test. Edges from unknown symbols
    count. With covered (symbol_id), its symbols have 0 where nothing was found and no other has a row.
    """
    callers = edges.join(symbols.select(F.col("symbol_id").alias("from_symbol"), "is_test"), "from_symbol", "left")
    kind = lambda k: F.col("edge_kind") == k
    each = {"callers": kind("call"), "implementations": kind("implements"), "overrides": kind("overrides"), "tests": kind("call") & F.col("is_test")}
    incoming = callers.groupBy(F.col("to_symbol").alias("symbol_id")).agg(*[F.count_distinct(F.when(c, F.col("from_symbol"))).alias(n) for n, c in each.items()])
    outgoing = edges.where(kind("call")).groupBy(F.col("from_symbol").alias("symbol_id")).agg(F.count_distinct("to_symbol").alias("callees"))
    both = incoming.join(outgoing, "symbol_id", "full")
    names = [*each, "callees"]
    if covered is None:
        return both
    return covered.select("symbol_id").distinct().join(both, "symbol_id", "left").select("symbol_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def totals(events: DataFrame, tokens: str) -> DataFrame:
    """AGG-6: calls and tokens; 0 without events."""
    return events.agg(F.count("*").alias("calls"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"))


def patch_totals(patches: DataFrame, retrievals: DataFrame, tokens: str, key: str, succeeded: Column, applied: Column) -> DataFrame:
    """AGG-7, JOIN-7: attempts, successes and applications of all patches; calls and tokens only of those that the other log hasn't counted."""
    seen = retrievals.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_seen", F.lit(True))
    own = F.col("_seen").isNull()
    return patches.join(seen, key, "left").agg(
        F.count("*").alias("attempts"), F.count_if(succeeded).alias("succeeded"), F.count_if(applied).alias("applied"),
        F.count_if(own).alias("calls"), F.coalesce(F.sum(F.when(own, F.col(tokens))), F.lit(0)).alias("tokens"),
    )


def labelled_union(parts: dict[str, DataFrame], label: str) -> DataFrame:
    """SET-1: parts one after another, each under its label; parts with a label of their own keep it."""
    out = None
    for name, part in parts.items():
        part = part if label in part.columns else part.withColumn(label, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def by_group(events: DataFrame, group: Column, tokens: str, time: str | None = None) -> DataFrame:
    """AGG-8 to AGG-11, AGG-14: calls and tokens by group, with the first and last time if asked for."""
    seen = [F.min(time).alias("first_seen"), F.max(time).alias("last_seen")] if time else []
    return events.groupBy(group).agg(F.count("*").alias("calls"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), *seen)


def directions(events: DataFrame, request: str, response: str, estimator: str) -> DataFrame:
    """AGG-12, AGG-13: totals of both directions and the estimators used; no row without events."""
    got = events.agg(F.count("*").alias("calls"), F.sum(request).alias("request"), F.sum(response).alias("response"), F.array_join(F.array_sort(F.collect_set(estimator)), ",").alias("estimators"))
    return got.where("calls > 0")


def index_drift(symbols: DataFrame, mirror: DataFrame, key: str) -> DataFrame:
    """AGG-15, INC-5: whether a mirror holds each symbol once: counts, distinct count, and the verdict."""
    one, two = symbols.agg(F.count("*").alias("symbols")), mirror.agg(F.count("*").alias("mirrored"), F.count_distinct(key).alias("distinct"))
    return one.join(two).withColumn("intact", (F.col("symbols") == F.col("mirrored")) & (F.col("mirrored") == F.col("distinct")))


def merged_sites(sites: DataFrame, keys: list[str], site: str, flag: str) -> DataFrame:
    """AGG-16: one row a key: its sites, sorted and distinct, and whether any is flagged."""
    return sites.groupBy(*keys).agg(F.array_sort(F.collect_set(site)).alias("sites"), F.bool_or(flag).alias("any_flag"))


def distilled(rows: DataFrame, keys: list[str], site: str, most: int = 3) -> DataFrame:
    """AGG-17: one row a key: how many rows, up to most distinct sites in order, and how many distinct ones are left out."""
    distinct = rows.groupBy(*keys, site).agg(F.count("*").alias("_n"))
    ranked = distinct.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(site)))
    shown = F.array_sort(F.collect_list(F.when(F.col("_rn") <= most, F.col(site))))
    return ranked.groupBy(*keys).agg(F.sum("_n").alias("n"), shown.alias("sites"), F.count_if(F.col("_rn") > most).alias("suppressed"))


def grouped_in_order(rows: DataFrame, outer: str, inner: str, position: str) -> DataFrame:
    """AGG-18: groups in the order in which they are first seen, each with its distinct inner names in that order; uniform where there is one."""
    seen = rows.groupBy(outer, inner).agg(F.min(position).alias("_at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_at", inner))), lambda x: x[inner])
    return seen.groupBy(outer).agg(F.min("_at").alias("first_at"), listed.alias("names"), (F.count("*") == 1).alias("uniform"))


def constant_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """AGG-19: which columns have one value in all rows; nulls count as a value."""
    one = lambda c: (F.count_distinct(c) + F.max(F.col(c).isNull().cast("int")) == 1).alias(c)
    return rows.agg(*[one(c) for c in columns])


def term_counts(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """AGG-20: how often each document holds each term."""
    return docs.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def text_only_matches(tokens: DataFrame, text: str, name: str) -> DataFrame:
    """AGG-22: rows of comments and strings whose text holds the name."""
    return tokens.agg(F.sum((F.instr(text, name) > 0).cast("int")).alias("matches"))
