"""Joins, set operations, windows, sorting and paging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import kept


def in_covered(symbols: DataFrame, edges: DataFrame, project: str = "project") -> DataFrame:
    """JOIN-5, JOIN-6: symbols of projects that any edge starts in."""
    return symbols.join(edges.select(project).distinct(), project, "left_semi")


def not_counted(events: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """JOIN-7: events whose call isn't among others; a null call is among none."""
    return events.join(others.select(key).distinct(), key, "left_anti")


def lookup(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """JOIN-9: rows with small's columns where it has their key. Catalyst broadcasts small if it is."""
    return rows.join(small, key, "left")


def disambiguate(rows: DataFrame, candidates: DataFrame, steps: list[str]) -> DataFrame:
    """JOIN-10: for each row (id, name, steps) the one candidate by name, then by each further step; rows that stay ambiguous go.

    A row is settled at the first step that leaves one candidate. Candidates are counted by name and steps
    before they meet the rows, so a name costs its rows and its candidates, not their product.
    """
    own = [c for c in candidates.columns if c not in ("name", *steps)]
    left, out = rows.select("name", *[c for c in rows.columns if c != "name"]), None
    for k in range(len(steps) + 1):
        alike = candidates.groupBy(F.col("name").alias("_name"), *[F.col(s).alias(f"_{s}") for s in steps[:k]])
        alike = alike.agg(F.count("*").alias("_n"), F.any_value(F.struct("name", *own)).alias("_one"))  # any is the one, where there is one
        same = [F.col("name") == F.col("_name"), *[F.col(s).eqNullSafe(F.col(f"_{s}")) for s in steps[:k]]]
        counted = left.join(alike, same).withColumn("_all", F.sum("_n").over(Window.partitionBy("id")))
        found = counted.where("_all = 1").select(*left.columns, *[F.col("_one").getField(c).alias(c) for c in own])
        out = found if out is None else out.unionByName(found)
        left = counted.where("_all > 1").select(*left.columns)
    return out


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """JOIN-11: key and change (added, removed, changed, unchanged) of two keyed sets; null digests equal each other."""
    o, n = old.select(key, F.col(digest).alias("_old"), F.lit(True).alias("_o")), new.select(key, F.col(digest).alias("_new"), F.lit(True).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return o.join(n, key, "full").select(key, change.alias("change"))


def match_cascade(removed: DataFrame, added: DataFrame) -> DataFrame:
    """JOIN-12: pairs of removed and added rows (id, key, name, position, signature): by key, then by name and place among its like, then by a signature that one row has on either side.

    Rows that a round pairs take no part in the next.
    """
    sides = ["old", "new"]
    left = {"old": removed, "new": added}

    def take(pairs: DataFrame) -> DataFrame:
        for s in sides:
            left[s] = kept(left[s].join(pairs.select(F.col(f"{s}_id").alias("id")), "id", "left_anti"))
        return pairs

    def pairs(on: list[str], how: str, prepare: Callable[[DataFrame], DataFrame]) -> DataFrame:
        o, n = (prepare(left[s]).select(F.col("id").alias(f"{s}_id"), *on) for s in sides)
        return take(kept(o.join(n, on).select("old_id", "new_id", F.lit(how).alias("how"))))

    nth = lambda d: d.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("position", "id")))
    only = lambda d: d.where("signature IS NOT NULL").withColumn("same", F.count("*").over(Window.partitionBy("signature"))).where("same = 1")
    exact = pairs(["key"], "key", lambda d: d)
    named = pairs(["name", "nth"], "name", nth)
    return exact.unionByName(named).unionByName(pairs(["signature"], "signature", only))


def transposed(edges: DataFrame, source: str, target: str) -> DataFrame:
    """JOIN-13, GRF-10: each target with the sorted sources that refer to it."""
    return edges.groupBy(target).agg(F.array_sort(F.collect_set(source)).alias("referenced_by"))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """WIN-1, SET-5: the first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def fair_order(df: DataFrame, tier: str, origin: str, *order: Column) -> DataFrame:
    """WIN-2: turn: rows take turns over the origins of their tier; tiers come one after another."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(tier, origin).orderBy(*order)))


def fair_page(df: DataFrame, tier: str, origin: str, origin_rank: Column, order: list[Column], offset: int, limit: int) -> DataFrame:
    """WIN-2: one page of the fair order (tier, turn, rank of the origin), its rows back in the order of tier, rank and order."""
    fair = fair_order(df, tier, origin, *order).orderBy(tier, "turn", origin_rank, *order).offset(offset).limit(limit)
    return fair.drop("turn").orderBy(tier, origin_rank, *order)


def floor_share(df: DataFrame, term: str, key: str, limit: int, terms: list, *order: Column) -> DataFrame:
    """WIN-3, TXT-7: place (from 0) and row: each term's best share of the limit (one row at least), terms as they are listed, then the best of all others; each key once."""
    share = max(1, limit // max(1, len(terms)))
    at = F.array_position(F.array(*[F.lit(x) for x in terms]), F.col(term))
    ranked = df.withColumn("_nth", F.row_number().over(Window.partitionBy(term).orderBy(*order)))
    ranked = ranked.withColumn("_at", F.when(F.col("_nth") <= share, at).otherwise(len(terms) + 1))
    once = first_by(ranked, [key], F.col("_at"), F.col("_nth"), *order)
    turn = F.when(F.col("_at") <= len(terms), F.col("_nth"))
    best = once.orderBy("_at", turn, *order).limit(limit)
    return best.withColumn("place", F.row_number().over(Window.orderBy("_at", turn, *order)) - 1).drop("_nth", "_at")  # limit rows at most


def paired(old: DataFrame, new: DataFrame, keys: list[str], old_order: Column, new_order: Column) -> DataFrame:
    """WIN-4: the i-th row of old with the i-th of new within each key; other columns of either side keep their names."""
    nth = lambda d, o: d.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(o)))
    return nth(old, old_order).join(nth(new, new_order), [*keys, "_nth"]).drop("_nth")


def unique_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-5: rows that are alone in their group."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")


def among(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """JOIN-3, JOIN-8: rows whose key others have; each row once."""
    return rows.join(others.select(key).distinct(), key, "left_semi")


def entries_of(log: DataFrame, symbols: DataFrame, log_key: str, by: str, symbol: str) -> DataFrame:
    """JOIN-4: entries and distinct symbols for each by of a log, by its symbol rows."""
    return log.join(symbols, log_key).groupBy(by).agg(F.count("*").alias("entries"), F.count_distinct(symbol).alias("symbols"))


def difference(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """SET-4: keys of rows that others lack."""
    return rows.select(key).join(others.select(key).distinct(), key, "left_anti")


def key_union(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """SET-6: distinct keys of both."""
    return one.select(key).union(two.select(key)).distinct()


def recent(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """SRT-4, SRT-8: the head under an order; strings compare by their bytes."""
    return df.orderBy(*order).limit(limit)


# Ceilings of a page of references, of a scoped search before its scope is applied, of shown members, and of a summary's characters.
REFERENCE_CAP, SCOPED_OVERFETCH_CAP, MEMBERS_CAP, SUMMARY_CAP = 200, 500, 40, 160


def scoped_top(df: DataFrame, scope: Column, limit: int, *order: Column) -> DataFrame:
    """SRT-7: at most limit (REFERENCE_CAP at most) rows in scope among the first SCOPED_OVERFETCH_CAP."""
    return df.orderBy(*order).limit(SCOPED_OVERFETCH_CAP).where(scope).orderBy(*order).limit(min(max(limit, 1), REFERENCE_CAP))


def projected(df: DataFrame, shown: list[str], restated: dict[str, Column]) -> DataFrame:
    """PRJ-4: the shown columns; those that only restate another (restated: column and when) are null there."""
    return df.select(*[F.when(~F.coalesce(restated[c], F.lit(False)), F.col(c)).alias(c) if c in restated else F.col(c) for c in shown])


def flattened(df: DataFrame, node: str, name: str = "name", children: str = "children") -> DataFrame:
    """PRJ-5: parent, name, depth for a nested struct and all structs below it; as many steps as the type is deep."""
    level, out = df.select(F.lit(None).cast("string").alias("parent"), F.col(node).alias("_n"), F.lit(0).alias("depth")), None
    while True:
        rows = level.select("parent", F.col(f"_n.{name}").alias("name"), "depth")
        out = rows if out is None else out.unionByName(rows)
        if children not in level.schema["_n"].dataType.names:
            return out
        level = level.select(F.col(f"_n.{name}").alias("parent"), F.explode(f"_n.{children}").alias("_n"), (F.col("depth") + 1).alias("depth"))


def islands(df: DataFrame, keys: list[str], line: str) -> DataFrame:
    """WIN-6: runs of consecutive lines: start and end."""
    at = df.select(*keys, line).distinct().withColumn("_g", F.col(line) - F.row_number().over(Window.partitionBy(*keys).orderBy(line)))
    return at.groupBy(*keys, "_g").agg(F.min(line).alias("start"), F.max(line).alias("end")).drop("_g")


def shifted(df: DataFrame, keys: list[str], position: str, delta: str) -> DataFrame:
    """WIN-7: shift: the sum of all changes before this one."""
    before = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("shift", F.coalesce(F.sum(delta).over(before), F.lit(0)))


def _with_total(head: DataFrame, df: DataFrame) -> DataFrame:
    """head with total, the rows of df: one broadcast row."""
    return head.join(F.broadcast(df.agg(F.count("*").alias("total"))))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """SRT-5: one page of 1 to 200 rows, with the total and where the next page begins (null on the last)."""
    limit = min(max(limit, 1), 200)
    rows = _with_total(df.orderBy(*order).offset(offset).limit(limit), df)
    return rows.withColumn("next_offset", F.when(F.col("total") > offset + limit, offset + limit))


def capped(lists: dict[str, DataFrame], order: list[Column], caps: dict[str, int]) -> dict[str, DataFrame]:
    """SRT-6: the head of each list under its own cap, with its true total."""
    return {k: _with_total(d.orderBy(*order).limit(caps[k]), d) for k, d in lists.items()}


def interval_pairs(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """FLT-17: the rows of left and right (no column name in common) whose ranges, both ends included, overlap; each pair once.

    A range of up to 2^k integers has level k and touches two bins of that width at most. Two ranges meet
    in the bins of the coarser of their levels, so a range goes to the bins of its own level and of each
    coarser one that the other side has; the bin in which the later start lies is the one that counts.
    Ranges that lack an end, or end before they start, overlap nothing. The levels, 63 at most, reach the driver.
    """
    sides = []
    for df, (low, high) in ((left, left_range), (right, right_range)):
        size = F.col(high) - F.col(low) + 1
        bits = F.length(F.bin(size.cast("long") - 1))
        sides.append(df.where(F.col(low) <= F.col(high)).withColumn("_level", F.when(size == 1, 0).otherwise(bits).cast("int")))
    present = [sorted(r["_level"] for r in s.select("_level").distinct().collect()) for s in sides]

    def binned(df: DataFrame, own: int, names: tuple[str, str]) -> DataFrame:
        levels = F.array_union(F.array("_level"), F.filter(F.array(*[F.lit(x) for x in present[1 - own]]).cast("array<int>"), lambda x: x > F.col("_level")))
        out = df.withColumn("_at", F.explode(levels))
        first, last = (F.expr(f"CAST({c} AS BIGINT) - pmod(CAST({c} AS BIGINT), shiftleft(1L, _at))") for c in names)
        return out.withColumn("_bin", F.explode(F.array_distinct(F.array(first, last))))

    one, two = binned(sides[0], 0, left_range), binned(sides[1], 1, right_range)
    two = two.withColumnsRenamed({"_level": "_level2", "_at": "_at2", "_bin": "_bin2"})
    meets = (F.col("_at") == F.col("_at2")) & (F.col("_bin") == F.col("_bin2")) & (F.col("_at") == F.greatest("_level", "_level2"))
    later = F.greatest(F.col(left_range[0]).cast("long"), F.col(right_range[0]).cast("long"))
    meets = meets & (F.col(left_range[0]) <= F.col(right_range[1])) & (F.col(right_range[0]) <= F.col(left_range[1]))
    meets = meets & (later - F.pmod(later, F.expr("shiftleft(1L, _at)")) == F.col("_bin"))
    return one.join(two, meets).drop("_level", "_at", "_bin", "_level2", "_at2", "_bin2")


def overlapping(left: DataFrame, right: DataFrame, key: str, left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """FLT-17: the rows of left (key is unique) that overlap any range of right."""
    low, high = right_range
    others = right.select(F.col(low).alias("_low"), F.col(high).alias("_high")).distinct()
    hit = interval_pairs(left.select(key, *left_range), others, left_range, ("_low", "_high"))
    return left.join(hit.select(key).distinct(), key, "left_semi")
