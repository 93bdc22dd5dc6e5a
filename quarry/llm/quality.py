"""Quality by nearest-neighbour voting in a latent-semantic space (operator 3).

Terms are what a text's make-up shows in any language: n-grams of character classes, and words and
lines by how they recur. A tf-idf matrix of a bounded sample of labelled rows gives the latent space
by its singular vectors; the sample's vectors and labels are broadcast, each document is projected
and takes the similarity-weighted vote of its nearest labelled rows by exact blocked cosine products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Buckets of class n-grams, and terms after them for recurrence.
GRAMS, RECUR = 4096, 48
TERMS = GRAMS + RECUR
#: Labelled rows of each label that are learnt from at most, latent dimensions, neighbours, sharpness of the vote.
SAMPLE, DIMENSIONS, NEIGHBOURS, SHARP = 2_000, 48, 15, 8.0
#: Rounds of subspace iteration that find the latent dimensions.
ITERATIONS = 12


def _classes() -> np.ndarray:
    """Letters to a, capitals to A, digits to 0, bytes beyond ASCII to a, white space to a space; other bytes stay."""
    out = np.arange(256, dtype=np.uint8)
    out[97:123] = out[128:] = ord("a")
    out[65:91] = ord("A")
    out[48:58] = ord("0")
    out[list(common.SPACES)] = ord(" ")
    out[10] = 10
    return out


_CLASS = _classes()


def terms(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of term weights for each text: 1 + log of counts for n-grams, steps of shares for recurrence."""
    n = len(at) - 1
    out = np.zeros((n, TERMS), np.float32)
    if len(data):
        kind = _CLASS[data]
        row = np.repeat(np.arange(n), np.diff(at))
        fresh = np.ones(len(kind), bool)  # runs of letters count as one
        fresh[1:] = (kind[1:] != kind[:-1]) | (row[1:] != row[:-1]) | ((kind[1:] != ord("a")) & (kind[1:] != ord("A")))
        kind, row = kind[fresh].astype(np.uint64), row[fresh]
        for size in (1, 2, 3, 5):
            if len(kind) < size:
                break
            gram = np.full(len(kind) - size + 1, size, np.uint64)
            for k in range(size):
                gram = gram * np.uint64(257) + kind[k : len(kind) - size + 1 + k]
            same = row[size - 1 :] == row[: len(row) - size + 1]
            bucket = (common.mix(gram) % np.uint64(GRAMS)).astype(np.int64)
            out[:, :GRAMS] += np.bincount((row[: len(gram)] * GRAMS + bucket)[same], minlength=n * GRAMS).reshape(n, GRAMS)
        np.log1p(out, out=out)
    words, row, _ = common.hashed_words(data, at, common.word_bytes())
    lines, line_row, _ = common.hashed_words(data, at, common.word_bytes(b"\n"))
    many = np.bincount(row, minlength=n)
    twice = np.zeros(n)
    if len(words) > 1:
        twice = np.bincount(row[1:][(words[1:] == words[:-1]) & (row[1:] == row[:-1])], minlength=n)
    shares = [twice / np.maximum(many, 1)]
    for items, of in ((words, row), (lines, line_row)):
        each = np.bincount(of, minlength=n)
        order = np.lexsort((items, of))
        new = np.ones(len(order), bool)
        new[1:] = (items[order][1:] != items[order][:-1]) | (of[order][1:] != of[order][:-1])
        shares.append(1 - np.bincount(of[order][new], minlength=n) / np.maximum(each, 1))
    for k, share in enumerate(shares):  # a step reached counts as a term that occurs often
        for step in range(16):
            out[:, GRAMS + 16 * k + step] = 6.0 * (share > (step + 1) / 18)
    return out


def term_rows(docs: DataFrame, keep: list[str]) -> DataFrame:
    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        got = terms(*common.raw(block.column(block.num_columns - 1)))
        return pa.RecordBatch.from_arrays([*block.columns[:-1], pa.array([x.astype("<f2").tobytes() for x in got], pa.binary())], names=[*keep, "terms"])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep) + ", terms binary"
    return common.map_blocks(docs.select(*keep, F.col("text").cast("binary").alias("text")), run, schema)


class Space:
    """Labelled latent vectors: idf, projection, unit vectors and labels of the sample, and the share of label 1; matrix is changed in place."""

    def __init__(self, matrix: np.ndarray, labels: np.ndarray, share: float) -> None:
        self.share, self.labels = share, labels.astype(np.float32)
        seen = np.count_nonzero(matrix, axis=0)
        self.idf = np.where(seen > 0, np.log((1 + len(matrix)) / (1 + seen)) + 1, 0).astype(np.float32)
        matrix *= self.idf  # in place: the driver holds the matrix once
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
        self.mean = matrix.mean(0)
        matrix -= self.mean
        self.axes = self._leading(matrix)
        self.vectors = self._unit(matrix @ self.axes)
        # as many rows of each label are kept as there were to keep; votes are weighted back to the labels' share
        ones = max(self.labels.mean(), 1e-6)
        self.weights = np.where(labels == 1, share / ones, (1 - share) / max(1 - ones, 1e-6)).astype(np.float32)

    @staticmethod
    def _leading(matrix: np.ndarray) -> np.ndarray:
        """The leading right singular vectors, by subspace iteration with a third more of them on the way."""
        wide = min(DIMENSIONS + DIMENSIONS // 3, *matrix.shape)
        basis = np.random.RandomState(5).standard_normal((matrix.shape[1], wide)).astype(np.float32)
        for _ in range(ITERATIONS):
            basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
        turn = np.linalg.svd(matrix @ basis, full_matrices=False)[2].T
        return (basis @ turn)[:, :DIMENSIONS].astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among each row's nearest labelled rows; of equal cosines at the last place the smaller doc_ids count."""
        at = self._unit((self._unit(rows * self.idf) - self.mean) @ self.axes)
        near = at @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        pick = np.argpartition(near, -k, axis=1)[:, -k:]
        last = np.take_along_axis(near, pick, 1).min(1, keepdims=True)
        tied = np.flatnonzero((near >= last).sum(1) > k)
        pick[tied] = np.argsort(-near[tied], axis=1, kind="stable")[:, :k]
        vote = np.exp(SHARP * (np.take_along_axis(near, pick, 1) - 1)) * self.weights[pick]
        return np.clip((vote * self.labels[pick]).sum(1) / vote.sum(1), 0, 1).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, sample: int = SAMPLE) -> Space | None:
    """The space of about sample rows of each label at most, those of small hashes of their ids; None without labels.

    A row labelled both ways counts as 1; rows without a label value are no labels. Of rows that share a
    doc_id, the one whose text has the least hash teaches.
    """
    by_id = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & learnable).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    by_id = common.staged(by_id)
    share = by_id.agg(F.avg("quality")).first()[0]
    if share is None:
        return None
    picked = [common.about(by_id.where(F.col("quality") == k), "doc_id", sample) for k in (0, 1)]
    texts = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    texts = texts.withColumn("_row", F.struct(F.xxhash64("text").alias("h"), "text", "quality"))
    texts = common.one_an_id(texts, "doc_id", "_row").select("doc_id", "_row.text", "_row.quality")  # about 2 * sample rows at most
    got = term_rows(texts, ["doc_id", "quality"]).toArrow()
    if not got.num_rows:
        return None
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    place, at = np.empty_like(order), 0
    place[order] = np.arange(len(order))
    matrix = np.empty((len(order), TERMS), np.float32)
    for chunk in got.column("terms").chunks:
        matrix[place[at : at + len(chunk)]] = common.raw(chunk)[0].view("<f2").reshape(-1, TERMS)
        at += len(chunk)
    known = got.column("quality").to_numpy()[order]
    del got
    return Space(matrix, known, float(share))


def score(docs: DataFrame, space: Space | None, keep: list[str]) -> DataFrame:
    """keep, and score: how likely each whole text has label 1; 0.5 where nothing was learnt."""
    if space is None:
        return docs.select(*keep, F.lit(0.5).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(space)

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        got = sent.value.score(terms(*common.raw(block.column(block.num_columns - 1))))
        return pa.RecordBatch.from_arrays([*block.columns[:-1], pa.array(got, pa.float64())], names=[*keep, "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return common.map_blocks(docs.select(*keep, F.col("text").cast("binary").alias("_text")), run, f"{kinds}, score double", 1 << 19)


def only_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns of any name, that score 0.5 or more; all of them without labels.

    A null text is judged as an empty one; repeated rows are judged each; an empty table stays empty.
    """
    space = fit(docs, labels, learnable_row())
    if space is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(space)
    return common.scored_rows(docs, lambda data, at: sent.value.score(terms(data, at)), lambda s: s >= 0.5, 1 << 19)


def learnable_row() -> Column:
    return common.id_crc() % 3 != 1


def quality(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, learnable: Column | None = None) -> DataFrame:
    """Scores every whole text; labels only teach.

    One row per row of docs: keep (doc_id), score in 0 to 1, predicted (1 from 0.5). A null text is
    an empty one and is scored like any other; repeated rows are scored each; an empty table gives
    no rows; without labels all scores are 0.5.
    """
    scored = score(docs, fit(docs, labels, learnable_row() if learnable is None else learnable), keep or ["doc_id"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return got.select("doc_id", (~learnable_row()).alias("held_out"), "score", "predicted")
