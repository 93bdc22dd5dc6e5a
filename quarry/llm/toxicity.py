"""Toxicity by non-negative positive-unlabelled learning (operator 4).

Confirmed toxic rows are the positives, all learnable text is unlabelled. Linear numpy classifiers
minimise the non-negative risk prior * R_p+ + max(0, R_u- - prior * R_p-); labelled-clean rows are
used only for the class prior. The words that count are chosen by their shares of all rows. Steps on
samples find a start; rounds over all unlabelled rows, whose risk and gradient each task sums up,
end it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Buckets of word hashes.
BUCKETS = 1 << 20
#: Labelled toxic rows that are learnt from, about, at most; unlabelled texts that the start is found on, about, at most.
POSITIVES, START = 4_000, 12_000
#: Rows of the samples that a bucket is found in at least, and standard deviations by which its shares differ at least.
SEEN, DEVIATIONS = 3, 5.0
#: Steps, rows of each kind a step, step size, shrinkage, share of a row's words that a step sees, and classifiers that are averaged.
STEPS, BATCH, RATE, SHRINK, KEEP, MEMBERS = 800, 256, 0.05, 1e-5, 0.4, 3
#: Rounds over all unlabelled rows, and their step size.
ROUNDS, ROUND_RATE = 8, 0.02


def word_ids(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each row's distinct words of letters and digits, by row."""
    words, rows, _ = common.hashed_words(data, at, common.alnum_bytes())
    keys = np.unique(rows.astype(np.int64) * BUCKETS + (words % np.uint64(BUCKETS)).astype(np.int64))
    return keys // BUCKETS, keys % BUCKETS


def row_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Of rows (known, text): in how many known rows, and in how many of all, each bucket is found; and how many rows of either there are."""

    def run(batches):
        common.release()
        total = np.zeros((2, BUCKETS + 1), np.int64)
        for block in common.blocks(batches):
            row, ids = word_ids(*common.raw(block.column(1)))
            known = block.column(0).to_numpy(zero_copy_only=False).astype(bool)
            total[0] += np.bincount(ids[known[row]], minlength=BUCKETS + 1)
            total[1] += np.bincount(ids, minlength=BUCKETS + 1)
            total[:, BUCKETS] += (known.sum(), len(known))
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "known", "n"])

    common.small_batches(rows.sparkSession)
    summed = rows.mapInArrow(run, "bucket int, known long, n long").groupBy("bucket").agg(F.sum("known").alias("known"), F.sum("n").alias("n"))
    got = summed.where((F.col("n") >= SEEN) | (F.col("bucket") == BUCKETS)).toArrow()  # BUCKETS rows at most
    out = np.zeros((2, BUCKETS + 1), np.int64)
    for k, name in enumerate(("known", "n")):
        out[k, got.column("bucket").to_numpy()] = got.column(name).to_numpy()
    return out[0, :-1], out[1, :-1], int(out[0, -1]), int(out[1, -1])


def word_sets(rows: DataFrame, used: np.ndarray) -> DataFrame:
    """doc_id, known, and which of the used buckets each text of rows (doc_id, known, text) has, as places in used, int32 bytes."""
    sent = rows.sparkSession.sparkContext.broadcast(used)

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        row, ids = word_ids(*common.raw(block.column(2)))
        at = np.minimum(np.searchsorted(sent.value, ids), len(sent.value) - 1)
        hit = sent.value[at] == ids
        row, flat = row[hit], at[hit].astype("<i4").tobytes()
        ends = np.searchsorted(row, np.arange(block.num_rows), side="right") * 4
        sets = [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([*block.columns[:-1], pa.array(sets, pa.binary())], names=["doc_id", "known", "words"])

    return common.map_blocks(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, known boolean, words binary")


class Rows:
    """Sparse rows of ones."""

    def __init__(self, sets: list[bytes]) -> None:
        self.ids = [np.frombuffer(x, "<i4") for x in sets]

    def batch(self, rng: np.random.RandomState, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, id) of size random rows, of which a share KEEP of the ids is left, so that no word leans on others."""
        got = [self.ids[i] for i in rng.randint(0, len(self.ids), size)]
        rows, ids = np.repeat(np.arange(size), [len(x) for x in got]), np.concatenate(got)
        left = rng.random_sample(len(ids)) < KEEP
        return rows[left], ids[left]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def telling(known: np.ndarray, every: np.ndarray, positives: int, rows: int) -> np.ndarray:
    """The buckets, sorted, that enough rows have and whose share of the known rows differs from that of all beyond chance."""
    pooled = (known + every) / (positives + rows)
    spread = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / positives + 1 / rows))
    return np.flatnonzero((known + every >= SEEN) & (np.abs(known / positives - every / rows) > DEVIATIONS * spread))


def _gradients(p: np.ndarray, prior: float, negative: float) -> tuple[np.ndarray, float]:
    """By the positives' outputs, and the sign of the unlabelled part, for the non-negative risk of logistic losses."""
    if negative >= 0:
        return prior * (p - 1) - prior * p, 1.0
    return prior * (p - 1) + prior * p, -1.0  # the risk has gone below nought: step back from what was overfitted


class Adam:
    def __init__(self, size: int, rate: float) -> None:
        self.m, self.v, self.rate, self.step = np.zeros(size), np.zeros(size), rate, 0

    def __call__(self, g: np.ndarray) -> np.ndarray:
        self.step += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.99 * self.v + 0.01 * g * g
        return self.rate * (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.v / (1 - 0.99**self.step)) + 1e-6)


def start(positive: list[bytes], unlabelled: list[bytes], size: int, prior: float, seed: int) -> np.ndarray:
    """Weights of size buckets, and last the bias, by Adam on random batches of samples."""
    rng, pos, unl, adam = np.random.RandomState(seed), Rows(positive), Rows(unlabelled), Adam(size + 1, RATE)
    w = np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    for _ in range(STEPS):
        pr, pi = pos.batch(rng, BATCH)
        ur, ui = unl.batch(rng, BATCH * 2)
        p = _sigmoid(np.bincount(pr, w[pi], BATCH) + w[-1])
        u = _sigmoid(np.bincount(ur, w[ui], BATCH * 2) + w[-1])
        gp, sign = _gradients(p, prior, -np.log(1 - u + 1e-9).mean() + prior * np.log(1 - p + 1e-9).mean())
        gp, gu = gp / BATCH, sign * u / len(u)
        g = np.bincount(pi, gp[pr], len(w)) + np.bincount(ui, gu[ur], len(w)) + SHRINK * w
        g[-1] = gp.sum() + gu.sum()
        w -= adam(g)
    return w


def _outputs(w: np.ndarray, sets: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id) of the sets, and each row's output; a share KEEP of each weight counts, as in a step on average."""
    ids = np.frombuffer(b"".join(sets), "<i4")
    rows = np.repeat(np.arange(len(sets)), [len(x) // 4 for x in sets])
    return rows, ids, _sigmoid(KEEP * np.bincount(rows, w[ids], len(sets)) + w[-1])


def unlabelled_risk(sets: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean over all rows of sets (words) of -log(1 - output), and its gradient; each task returns its sums."""
    sent = sets.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        w = sent.value
        total = np.zeros(len(w) + 2)
        for b in batches:
            rows, ids, u = _outputs(w, b.column(0).to_pylist())
            total[: len(w)] += np.bincount(ids, KEEP * u[rows], len(w))
            total[len(w) - 1 :] += (u.sum(), -np.log(1 - u + 1e-9).sum(), len(u))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["id", "value"])

    got = sets.select("words").mapInArrow(run, "id int, value double").groupBy("id").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(len(w) + 2)
    out[got.column("id").to_numpy()] = got.column("value").to_numpy()
    rows = max(out[-1], 1.0)
    return out[-2] / rows, out[: len(w)] / rows


def end(w: np.ndarray, positive: list[bytes], sets: DataFrame, prior: float) -> np.ndarray:
    """w after ROUNDS steps on the risk of the positives and of all rows of sets."""
    adam = Adam(len(w), ROUND_RATE)
    for _ in range(ROUNDS):
        loss, g = unlabelled_risk(sets, w)
        rows, ids, p = _outputs(w, positive)
        gp, sign = _gradients(p, prior, loss + prior * np.log(1 - p + 1e-9).mean())
        gp /= len(p)
        g = sign * g + np.bincount(ids, KEEP * gp[rows], len(w)) + SHRINK * w
        g[-1] += gp.sum()
        w = w - adam(g)
    return w


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, positives: int = POSITIVES) -> np.ndarray | None:
    """Weights of the buckets, and last the bias; None without a toxic row to learn from or without a telling word.

    A row labelled both ways counts as toxic; rows without a label value are no labels; rows without a
    doc_id teach nothing. All learnable rows, toxic ones included, are the unlabelled text. Of rows that
    share a doc_id, one is a positive or a text of the start's sample, that of the least set of words.
    """
    by_id = common.staged(labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learnable).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = by_id.agg(F.avg("toxic")).first()[0]
    if not share:
        return None
    prior = min(max(float(share), 0.01), 0.5)
    picked = common.about(by_id.where("toxic = 1").select("doc_id"), "doc_id", positives).withColumn("known", F.lit(True))
    rows = docs.where(learnable & F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = rows.join(F.broadcast(picked), "doc_id", "left")  # about so many positives
    rows = rows.select("doc_id", F.coalesce("known", F.lit(False)).alias("known"), "text")
    known, every, some, many = row_counts(rows.select("known", "text"))
    if not some:
        return None
    used = telling(known, every, some, many)
    if not len(used):
        return None
    sets = common.staged(word_sets(rows, used))
    positive = common.one_an_id(sets.where("known"), "doc_id", "words").toArrow().sort_by("doc_id").column("words").to_pylist()
    sample = common.one_an_id(sets, "doc_id", "words", START).toArrow().sort_by("doc_id").column("words").to_pylist()
    w = np.mean([start(positive, sample, len(used), prior, seed) for seed in range(MEMBERS)], axis=0)
    w = end(w, positive, sets, prior)
    out = np.zeros(BUCKETS + 1, np.float32)
    out[used], out[-1] = w[:-1], w[-1]
    return out


def score(docs: DataFrame, weights: np.ndarray | None, keep: list[str]) -> DataFrame:
    """keep, and score: the probability of toxic for each whole text; 0 where nothing was learnt."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    if weights is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        got = probability(sent.value, *common.raw(block.column(block.num_columns - 1)))
        return pa.RecordBatch.from_arrays([*block.columns[:-1], pa.array(got, pa.float64())], names=[*keep, "score"])

    return common.map_blocks(docs.select(*keep, F.col("text").cast("binary").alias("_text")), run, f"{kinds}, score double")


def probability(weights: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The score of each text."""
    rows, ids = word_ids(data, at)
    return _sigmoid(np.bincount(rows, weights[ids], len(at) - 1) + weights[-1])


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns of any name, that score below 0.5; all of them without toxic labels.

    A null text is judged as an empty one; repeated rows are judged each; an empty table stays empty.
    """
    weights = fit(docs, labels, learnable_row())
    if weights is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    return common.scored_rows(docs, lambda data, at: probability(sent.value, data, at), lambda s: s < 0.5)


def learnable_row() -> Column:
    return common.id_crc() % 5 != 0


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, learnable: Column | None = None) -> DataFrame:
    """Scores every whole text; labels only teach.

    One row per row of docs: keep (doc_id), score in 0 to 1, predicted (1 from 0.5). A null text is
    an empty one, which has the bias alone; repeated rows are scored each; an empty table gives no
    rows; without toxic labels all scores are 0.
    """
    scored = score(docs, fit(docs, labels, learnable_row() if learnable is None else learnable), keep or ["doc_id"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return got.select("doc_id", (~learnable_row()).alias("held_out"), "score", "predicted")
