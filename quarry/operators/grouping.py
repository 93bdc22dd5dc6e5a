"""Groups in first-seen order, with what is alike in a group lifted out of its rows.

Lists of unknown length stay rows with a position; only tree() nests them, for a page of results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Merged:
    """AGG-16: groups (one row a key) and sites (one row a key and distinct site, with first_at)."""

    groups: DataFrame
    sites: DataFrame


def merged(rows: DataFrame, keys: list[str], position: str, sites: list[str], flags: list[str]) -> Merged:
    """AGG-16: each key's first row by position, with flags that hold if any row's does (null as false) and n_sites; and its distinct sites.

    Ties of position go to the least remaining columns. Sites with all columns null are none. Nothing of
    a group is gathered in one row.
    """
    others = [c for c in rows.columns if c not in {*keys, *sites, *flags, position}]
    seen = rows.where(_any([F.col(c).isNotNull() for c in sites]))
    distinct = seen.groupBy(*keys, *sites).agg(F.min(position).alias("first_at"))
    first = F.min(F.struct(position, *others)).alias("_first")
    groups = rows.groupBy(*keys).agg(first, *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags])
    many = distinct.groupBy(*keys).agg(F.count("*").alias("n_sites"))
    groups = groups.select(*keys, f"_first.{position}", *[f"_first.{c}" for c in others], *flags).alias("g")
    same = _all([F.col(f"g.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys])
    return Merged(groups.join(many.alias("m"), same, "left").select("g.*", F.coalesce("m.n_sites", F.lit(0)).alias("n_sites")), distinct)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


@dataclass(frozen=True)
class Distilled:
    """AGG-17: causes (one row a diagnostic), sites (id, file, line, place from 1), inspections (id, symbol, first_at) and totals (one row)."""

    causes: DataFrame
    sites: DataFrame
    inspections: DataFrame
    totals: DataFrame


def distilled(rows: DataFrame, changed: DataFrame, most: int = 3) -> Distilled:
    """AGG-17: root causes of diagnostics (id, position, message, file, line, symbol), with changed (symbol, position) to fall back on.

    A cause counts its rows and has the first one's message, its first most distinct places in reported
    order, and the distinct symbols around them, to be inspected; where there is none, all of changed stand
    in (inspected tells which, affected is the first), and without those the cause goes. suppressed is what
    its rows exceed its inspections by; in totals, what all rows exceed the causes by. Rows without a file
    have no place. The first places come from a limit within each task before the shuffle.
    """
    each = rows.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("position", "message")).alias("_first"))
    places = rows.where("file IS NOT NULL AND file <> ''").groupBy("id", "file", "line").agg(F.min("position").alias("first_at"))
    ranked = places.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("first_at", "file", "line"))).where(F.col("place") <= most)
    inspections = rows.where("symbol IS NOT NULL").groupBy("id", "symbol").agg(F.min("position").alias("first_at"))
    of_id = inspections.groupBy("id").agg(F.count("*").alias("_own"), F.min(F.struct("first_at", "symbol")).alias("_origin"))
    instead = changed.agg(F.count_distinct("symbol").alias("_instead"), F.min(F.struct("position", "symbol")).alias("_changed"))
    both = each.join(of_id, "id", "left").join(F.broadcast(instead))  # one row
    own = F.col("_own").isNotNull()
    both = both.withColumn("inspections", F.coalesce("_own", "_instead")).where("inspections > 0")
    causes = both.select(
        "id", "n", F.col("_first.message").alias("message"), F.when(own, F.col("_origin.symbol")).otherwise(F.col("_changed.symbol")).alias("affected"),
        F.when(own, "diagnostic origin").otherwise("changed by this patch").alias("inspected"), "inspections", F.greatest(F.col("n") - F.col("inspections"), F.lit(0)).alias("suppressed"),
    )
    kept = causes.select("id")
    totals = rows.agg(F.count("*").alias("raw")).join(causes.agg(F.count("*").alias("causes"))).select("raw", "causes", (F.col("raw") - F.col("causes")).alias("suppressed"))
    return Distilled(causes, ranked.join(kept, "id", "left_semi").select("id", "file", "line", "place"), inspections, totals)


@dataclass(frozen=True)
class Hoisted:
    """AGG-19: shared (keys, n, columns, hoisted: the names lifted out) and rest, the rows without what was lifted out."""

    keys: list[str]
    columns: list[str]
    shared: DataFrame
    rest: DataFrame


def _fields(rows: DataFrame, column: str) -> list[str]:
    kind = rows.schema[column].dataType
    return kind.names if isinstance(kind, StructType) else []


def hoisted(rows: DataFrame, keys: list[str], columns: list[str], least: int = 1) -> Hoisted:
    """AGG-18, AGG-19: columns with one value in all rows of a group (of all rows, without keys) go to its row of shared.

    Null is a value. Of a struct that isn't alike as a whole, the fields that are go by themselves, as
    `column.field`. Groups of fewer than least rows keep all. Keys may be null; columns need an order.
    """
    one = lambda c: (F.count(c) == 0) | ((F.count(c) == F.count("*")) & F.min(c).eqNullSafe(F.max(c)))
    paths = {c: [f"{c}.{f}" for f in _fields(rows, c)] for c in columns}
    every = [p for c in columns for p in (c, *paths[c])]
    mark = {p: f"_is{k}" for k, p in enumerate(every)}
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[one(F.col(p)).alias(mark[p]) for p in every], *[F.min(F.col(p)).alias(f"_v{k}") for k, p in enumerate(every)])
    value = {p: F.col(f"_v{k}") for k, p in enumerate(every)}
    enough = F.col("n") >= least
    lifted = {c: enough & F.col(mark[c]) for c in columns}
    lifted |= {p: enough & ~F.col(mark[c]) & F.col(mark[p]) for c in columns for p in paths[c]}

    def share(c: str) -> Column:
        whole = F.when(lifted[c], value[c])
        if paths[c]:
            part = F.struct(*[F.when(lifted[p], value[p]).alias(p.split(".", 1)[1]) for p in paths[c]])
            whole = whole.when(_any([lifted[p] for p in paths[c]]), part)
        return whole.alias(c)

    names = F.array_compact(F.array(*[F.when(lifted[p], F.lit(p)) for p in every])).cast("array<string>")
    shared = stats.select(*keys, "n", *[share(c) for c in columns], names.alias("hoisted"))
    own = [F.col(f"r.{c}") for c in rows.columns if c not in columns]

    def keep(c: str) -> Column:
        held = lambda p: F.array_contains("s.hoisted", p)
        got = F.col(f"r.{c}")
        if paths[c]:
            got = F.when(got.isNotNull(), F.struct(*[F.when(~held(p), F.col(f"r.{p}")).alias(p.split(".", 1)[1]) for p in paths[c]]))
        return F.when(~held(c), got).alias(c)

    rest = _joined(rows, shared, keys, "inner").select(*own, *[keep(c) for c in columns])
    return Hoisted(keys, columns, shared, rest.select(*rows.columns))


def _joined(rows: DataFrame, shared: DataFrame, keys: list[str], how: str) -> DataFrame:
    """rows as r with shared as s; without keys, shared is one row."""
    if not keys:
        return rows.alias("r").join(F.broadcast(shared).alias("s"))
    return rows.alias("r").join(shared.alias("s"), _all([F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]), how)


def restored(got: Hoisted) -> DataFrame:
    """The rows that hoisted() was given."""
    held = lambda p: F.array_contains("s.hoisted", p)

    def back(c: str) -> Column:
        mine = F.col(f"r.{c}")
        if fields := _fields(got.rest, c):
            mine = F.when(mine.isNotNull(), F.struct(*[F.when(held(f"{c}.{f}"), F.col(f"s.{c}.{f}")).otherwise(F.col(f"r.{c}.{f}")).alias(f) for f in fields]))
        return F.when(held(c), F.col(f"s.{c}")).otherwise(mine).alias(c)

    return _joined(got.rest, got.shared, got.keys, "inner").select(*[back(c) if c in got.columns else F.col(f"r.{c}") for c in got.rest.columns])


@dataclass(frozen=True)
class Grouped:
    """AGG-18: header (one row), leaves (outer, inner, outer_at, at, n, columns, hoisted) and the rows below them."""

    outer: str
    inner: str
    position: str
    header: DataFrame
    leaves: DataFrame
    rows: DataFrame


def grouped(rows: DataFrame, outer: str, inner: str, position: str, columns: list[str]) -> Grouped:
    """AGG-18: groups of outer, and of inner within them, by where they are first seen, with the columns alike in a leaf lifted out of it.

    The header is flat, with the values of outer and inner, where all rows have the same two; else it
    counts groups. Without rows it counts 0 groups.
    """
    got = hoisted(rows, [outer, inner], columns)
    at = rows.groupBy(outer, inner).agg(F.min(position).alias("at"))
    first = at.groupBy(outer).agg(F.min("at").alias("outer_at")).alias("f")
    at = at.alias("a").join(first, F.col(f"a.{outer}").eqNullSafe(F.col(f"f.{outer}"))).select("a.*", "outer_at")
    leaves = _joined(got.shared, at, [outer, inner], "inner").select("r.*", "s.outer_at", "s.at")
    flat = F.count("*") == 1
    header = leaves.agg(F.count_if(F.col("outer_at") == F.col("at")).alias("groups"), F.count("*").alias("leaves"), flat.alias("flat"), *[F.when(flat, F.first(c)).alias(c) for c in (outer, inner)])
    return Grouped(outer, inner, position, header, leaves, got.rest)


def tree(got: Grouped) -> DataFrame:
    """AGG-18: one row an outer group: outer, outer_at, and leaves, an array by at, each with its rows by position. Meant for a page of results."""
    own = [c for c in got.rows.columns if c not in (got.outer, got.inner, got.position)]
    lists = got.rows.groupBy(got.outer, got.inner).agg(F.array_sort(F.collect_list(F.struct(got.position, *own))).alias("rows"))
    leaf = _joined(got.leaves, lists, [got.outer, got.inner], "inner").select("r.*", "s.rows")
    inside = [c for c in leaf.columns if c not in (got.outer, "outer_at", "at")]
    return leaf.groupBy(got.outer, "outer_at").agg(F.array_sort(F.collect_list(F.struct("at", *inside))).alias("leaves"))
