"""Shared pieces of the training-data operators: staging tables, block-wise text maps, vectorised words."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

#: Bytes that end a word: space, and tab to carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of text that one numpy pass takes.
BLOCK_BYTES = 1 << 20
#: Bytes of an Arrow batch (one row at least).
BATCH_BYTES = "8mb"

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of our own in a local session and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder's path in the shared folder, with its scheme; what tasks write there goes at exit."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    _staged.append((spark, path))
    return path


def staged(df: DataFrame, **options: str) -> DataFrame:
    """df written once to the shared folder, with the writer's options, and read again: short lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path, **options)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def clear_staged() -> None:
    """Removes what staged() wrote in this process, where the session still lives."""
    while _staged:
        spark, path = _staged.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session has ended
            return


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df (staged, so that a count is cheap) to be broadcast if it has so many rows at most; else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def about(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About so many of df's rows, those of small hashes of key; all where there are no more. No row is sorted or sent anywhere."""
    total = df.count()
    return df if total <= rows else df.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int((1 << 40) * rows / total))


def one_an_id(df: DataFrame, key: str, column: str, rows: int | None = None) -> DataFrame:
    """key and the least column of each key; of about so many keys, those of small hashes, if rows is given. A key's number of rows plays no part."""
    if rows is not None:
        total = df.select(key).distinct().count()
        df = df if total <= rows else df.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int((1 << 40) * rows / total))
    return df.groupBy(key).agg(F.min(column).alias(column))


def fresh(name: str, columns: list[str]) -> str:
    """name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches hold few rows and bytes, since one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


_held: dict = {}


def held(key: str, make: Callable):
    """What a worker keeps under key over its tasks; only the last key's. Functions sent to workers reach it by this name, not by a copy."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Frees what the tasks of another operator left in this worker, and gives it back to the system."""
    if _held:
        _held.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # a C library without malloc_trim
            ctypes.CDLL(None).malloc_trim(0)


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose last column, binary, holds about limit bytes at most (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = batch.column(batch.num_columns - 1).fill_null(b"")
        ends = np.cumsum(np.diff(_offsets(sizes)))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _offsets(arr: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(arr.type) else np.int32
    return np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array, nulls empty, and where each row starts (one more at the end)."""
    arr = arr.fill_null(b"")
    at = _offsets(arr)
    data = arr.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def map_blocks(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, limit: int = BLOCK_BYTES, keeps: bool = False) -> DataFrame:
    """fn over blocks of df's rows; df's last column is the text as binary. keeps: fn itself uses held()."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release()
        for block in blocks(batches, limit):
            out = fn(block)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def scored_rows(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], keep: Callable[[Column], Column], limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs whose score(bytes, row starts) of the text keep accepts; all columns, of any name, pass through in one map."""
    name = fresh("score", docs.columns)
    others = [c for c in docs.columns if c != "text"]
    schema = StructType([*[docs.schema[c] for c in others], StructField("text", BinaryType()), StructField(name, DoubleType())])

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        got = pa.array(score(*raw(block.column(block.num_columns - 1))), pa.float64())
        return pa.RecordBatch.from_arrays([*block.columns, got], names=schema.names)

    out = map_blocks(docs.select(*others, F.col("text").cast("binary").alias("text")), run, schema, limit)
    return out.where(keep(F.col(name))).withColumn("text", F.col("text").cast("string")).select(*docs.columns)


def word_bytes(spaces: bytes = SPACES) -> np.ndarray:
    """Which bytes belong to words, all but spaces."""
    out = np.ones(256, bool)
    out[list(spaces)] = False
    return out


def alnum_bytes() -> np.ndarray:
    """Which bytes belong to words of letters and digits; every byte of a character beyond ASCII does."""
    out = np.zeros(256, bool)
    out[48:58] = out[65:91] = out[97:123] = out[128:] = True
    return out


_rng = np.random.RandomState(20_011)
_BYTE = _rng.randint(0, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_POWER = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hashed_words(data: np.ndarray, at: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased) of all rows, each word's row, and each word's first byte."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none.astype(np.uint64), none, none
    inside = member[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return none.astype(np.uint64), none, none
    sizes = np.flatnonzero(last) + 1 - starts
    heads = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(heads, sizes)
    value = _BYTE[data[inside]] * _POWER[place & 0xFFFF]
    if sizes.max() > 0xFFFF:
        value *= (2 * (place >> 16) + 1).astype(np.uint64)
    hashes = mix(np.add.reduceat(value, heads) + sizes.astype(np.uint64))
    return hashes, np.searchsorted(at, starts, side="right") - 1, starts


def hash_word(word: str, member: np.ndarray | None = None) -> int:
    """The hash that hashed_words gives one word."""
    b = np.frombuffer(word.encode(), np.uint8)
    return int(hashed_words(b, np.array([0, len(b)]), np.ones(256, bool) if member is None else member)[0][0])
