"""Approximate nearest neighbours by multi-index hashing (operator 7).

Learned rotations turn vectors into binary codes, split into substrings that are each indexed. By
the pigeonhole principle a code within Hamming radius r of a query agrees with it to within
r // substrings bits in one substring at least, so probing all substring values that near finds
every code in the radius; those are reranked by exact cosines. Queries with too few codes in the
radius are asked again with a growing one, in the end of all bits.

Vectors are indexed once per distinct value, with their smallest ids, so copies cost nothing.
Queries meet the index in blocks: a shard of vectors with a block of queries in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bits of a code and of a substring; vectors that rotations and radius are learnt from; rounds of learning.
BITS, SUBSTRING, SAMPLE, ROUNDS = 256, 16, 4096, 25
#: Share of true neighbours in the sample that the radius takes in. More vectors have nearer neighbours, so recall grows from there.
WITHIN = 0.96
#: Bits by which the radius first grows for queries that it gave too few; it grows by twice as many each time.
WIDER = 16
#: Distinct vectors of a shard and queries of a block.
SHARD, BLOCK = 8192, 4096

_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of vectors of the usual length, without nulls, not zero, all finite."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", v.alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0))


class Codes:
    """Rotations learnt by iterative quantisation, and the radius."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 7) -> None:
        rng, unit = np.random.RandomState(seed), sample / np.linalg.norm(sample, axis=1, keepdims=True)
        dim = unit.shape[1]
        self.rotations = []
        for _ in range(-(-BITS // dim)):
            turn = np.linalg.qr(rng.randn(dim, dim))[0]
            for _ in range(ROUNDS):
                left, _, right = np.linalg.svd(np.where(unit @ turn > 0, 1.0, -1.0).T @ unit)
                turn = (left @ right).T
            self.rotations.append(turn)
        self.radius = BITS
        if len(unit) > 2 * k:
            codes, ask = self.encode(sample), np.arange(0, len(unit), max(1, len(unit) // 500))
            near = unit[ask] @ unit.T
            near[np.arange(len(ask)), ask] = -2
            best = np.argpartition(near, -k, axis=1)[:, -k:]
            self.radius = int(np.quantile(_ONES[codes[ask][:, None, :] ^ codes[best]].sum(2), WITHIN))

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as substrings: unsigned 16-bit integers."""
        bits = np.concatenate([vectors @ r > 0 for r in self.rotations], axis=1)[:, :BITS]
        return np.packbits(bits, axis=1).view(np.uint16)


class Index:
    """For each substring the codes by its value."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, self.tables = codes, []
        for column in codes.T:
            order = np.argsort(column, kind="stable")
            values, starts = np.unique(column[order], return_index=True)
            self.tables.append((values, np.append(starts, len(order)), order))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is within radius, by probing substring values within the pigeonhole's share."""
        share, hit = radius // len(self.tables), np.zeros(len(self.codes), bool)
        for j, (values, starts, order) in enumerate(self.tables):
            near = np.flatnonzero(_ONES[values ^ code[j]] <= share)
            if len(near) == len(values):
                hit[:] = True
                break
            sizes = starts[near + 1] - starts[near]
            hit[order[np.repeat(starts[near] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]] = True
        rows = np.flatnonzero(hit)
        return rows[_ONES[self.codes[rows] ^ code].sum(1, dtype=np.int64) <= radius]


def nearest(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """The k nearest others, found by multi-index hashing, of each vector for which is_query (a Column over vec_id) holds.

    One row per query and rank: query_id, rank (from 1), vec_id, score (cosine in double precision);
    nearest first, ties to the smaller vec_id; fewer ranks only where there are fewer candidates in
    all. Vectors that are null, zero, of another length than most, or with null or
    non-finite components take no part; rows with the same vec_id and vector count once, and no row
    with the query's vec_id is its neighbour. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = common.staged(usable(vectors).dropDuplicates(["vec_id", "v"]))
    sample = common.about(rows, "vec_id", SAMPLE).orderBy("vec_id").select("v").toArrow().column("v")
    schema = "query_id long, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes = Codes(np.unique(np.array(sample.to_pylist()), axis=0), k)
    sent = spark.sparkContext.broadcast(codes)
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    distinct = common.staged(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))  # k + 1 ids at most
    asked = common.staged(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v"))
    shards = max(1, -(-distinct.count() // SHARD))

    def search(radius: int):
        def run(key, own: pa.Table, asked: pa.Table) -> pa.Table:
            out: list[tuple[int, int, float]] = []
            if own.num_rows and asked.num_rows:
                flat = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
                data, queries, ids = flat(own), flat(asked), own.column("ids").to_pylist()
                first, alone = np.array([x[0] for x in ids]), np.array([len(x) == 1 for x in ids])
                size = np.sqrt((data * data).sum(1))
                table = Index(sent.value.encode(data))
                for query, q, code in zip(asked.column("query_id").to_pylist(), queries, sent.value.encode(queries), strict=True):
                    near = table.within(code, radius)
                    near = near[~(alone[near] & (first[near] == query))]
                    if not len(near):
                        continue
                    score = data[near] @ q / (size[near] * np.sqrt(q @ q))
                    least = np.partition(score, -k - 1)[-k - 1] if len(score) > k + 1 else -2
                    got = [(-s, i) for s, at in zip(score[score >= least].tolist(), near[score >= least].tolist(), strict=True) for i in ids[at] if i != query]
                    out += [(query, i, -s) for s, i in sorted(got)[:k]]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

        return run

    def ranked(asked: DataFrame, m: int, radius: int) -> DataFrame:
        parts = max(1, -(-m // BLOCK))
        block = lambda own, count, other, of: (F.pmod(F.xxhash64(own), F.lit(count)).cast("int").alias(other), F.explode(F.sequence(F.lit(0), F.lit(of - 1))).alias({"shard": "part", "part": "shard"}[other]))
        index = distinct.select("v", "ids", *block("ids", shards, "shard", parts))
        ask = asked.select("query_id", "v", *block("query_id", parts, "part", shards))
        found = index.groupBy("shard", "part").cogroup(ask.groupBy("shard", "part")).applyInArrow(search(radius), schema)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    radius, step, m, done = codes.radius, WIDER, asked.count(), None
    while radius < BITS and m:
        got = common.staged(ranked(asked, m, radius))
        full = got.where(F.col("rank") == k).select("query_id")
        asked = common.staged(asked.join(full, "query_id", "left_anti"))
        m = asked.count()
        whole = got.join(full, "query_id", "left_semi") if m else got
        done = whole if done is None else done.unionByName(whole)
        radius, step = min(BITS, radius + step), 2 * step
    if done is None or m:
        rest = ranked(asked, m, radius)
        done = rest if done is None else done.unionByName(rest)
    return done


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
