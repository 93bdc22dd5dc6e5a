"""Derived tables kept up to date by fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables
from .relational import snapshot_diff


def sweep(before: DataFrame, now: DataFrame) -> DataFrame:
    """INC-1: path and change of two scans (path, modificationTime, length): added, removed or changed."""
    stamp = F.concat_ws("|", F.col("modificationTime").cast("string"), F.col("length").cast("string")).alias("stamp")
    return snapshot_diff(before.select("path", stamp), now.select("path", stamp), "path", "stamp").where("change <> 'unchanged'")


def sweep_after_baseline(before: DataFrame | None, now: DataFrame) -> DataFrame:
    """INC-2: the first scan is the baseline and reports nothing."""
    return sweep(now if before is None else before, now)


def refresh(old: DataFrame, new: DataFrame, old_edges: DataFrame, new_edges: DataFrame, key: str = "symbol_id", digest: str = "digest") -> tuple[DataFrame, DataFrame, DataFrame]:
    """INC-3: symbols, edges and changes after a new scan.

    Changed and added symbols are replaced, removed ones go with their edges, and edges are pruned
    only where their owner changed; nulls in edge keys equal each other, so a scan without changes
    adds nothing.
    """
    change = snapshot_diff(old, new, key, digest)
    touched = change.where("change <> 'unchanged'").select(key)
    gone = change.where("change = 'removed'").select(key)
    symbols = tables.upsert(old.join(gone, key, "left_anti"), new.join(touched, key, "left_semi"), [key])
    rest = old_edges.join(touched.select(F.col(key).alias("from_symbol")), "from_symbol", "left_anti").join(gone.select(F.col(key).alias("to_symbol")), "to_symbol", "left_anti")
    return symbols, tables.insert_absent(rest.select(*new_edges.columns), new_edges, new_edges.columns), change


def valid_facts(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """INC-4: facts whose symbol still has the body they were taken from."""
    return facts.join(symbols.select("symbol_id", "body_hash"), ["symbol_id", "body_hash"])


def repaired(symbols: DataFrame, mirror: DataFrame, key: str, build) -> DataFrame:
    """INC-5: the mirror, or a rebuilt one where it doesn't hold each symbol once."""
    from .metrics import index_drift

    return mirror if index_drift(symbols, mirror, key).first()["intact"] else build(symbols)


def ingest_once(log: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """INC-6: new events by their call's id, once; those already in the log change nothing."""
    return tables.insert_absent(log, new.where(F.col(key).isNotNull()), [key])


def deferred(queue: DataFrame, now: DataFrame) -> DataFrame:
    """INC-7: what to do once loading has ended, for changes (path, at) that came in meanwhile: each path once, refresh where now (path) has it, else remove."""
    last = queue.groupBy("path").agg(F.max("at").alias("at"))
    there = now.select("path", F.lit(True).alias("_there")).distinct()
    return last.join(there, "path", "left").select("path", "at", F.when(F.col("_there"), "refresh").otherwise("remove").alias("action"))


def current_history(history: DataFrame, symbols: DataFrame) -> DataFrame:
    """INC-8: current: whether an entry's version is the symbol's body now."""
    now = symbols.select("symbol_id", F.col("body_hash").alias("_now"))
    return history.join(now, "symbol_id", "left").withColumn("current", F.coalesce(F.col("new_version") == F.col("_now"), F.lit(False))).drop("_now")
