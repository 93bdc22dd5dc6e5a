"""Alignment of two tokenizers over whole corpora by byte offsets (operator 13).

Texts are encoded once, by tokenizer A (byte-level BPE) and tokenizer B (pieces with byte fallback),
and staged as ids. A link is a pair of an A and a B token whose byte ranges overlap; between two
neighbouring token ends, of either side, lies exactly one link. Links are packed into int64 keys,
B's id above A's. Each task counts its own keys by np.unique; partial counts are range-partitioned by
key and sorted, equal neighbours are summed, and each range becomes a pair of sorted arrays in the
shared folder. The last pass maps those files into memory and looks counts up by searchsorted.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common
from .packing import TokenizerPieces

#: Distinct pairs that a task holds before it hands its partial counts on.
HELD_PAIRS = 1_000_000
#: Partial counts that one range of the global sort holds, about.
SHARD_ROWS = 4_000_000

_NONE = np.zeros(0, np.int64)


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordPieces:
    """Ids of space+text by a piece model, remembered by word.

    A piece holds a space at its start or is made of spaces only, so a text whose words stand one space
    apart falls into its words; any other text is encoded whole.
    """

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]
        spaced = any(b" " in x[1:] and x.strip(b" ") for x in self.bytes)
        self.memo = None if spaced else bpe.Memo(self._many)

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def _many(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, "<u4").tobytes() for x in self.model.encode(texts, num_threads=1)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.memo is None:
            return self._many(texts)
        whole = [i for i, x in enumerate(texts) if not x or "  " in x or x[0] == " " or x[-1] == " "]
        odd = dict(zip(whole, self._many([texts[i] for i in whole]), strict=True))
        split = [[] if i in odd else x.split(" ") for i, x in enumerate(texts)]
        get = self.memo.learn(set().union(*split))
        return [odd[i] if i in odd else b"".join(map(get, x)) for i, x in enumerate(split)]


class Encoders:
    """Both tokenizers of a worker, with the bytes of every id."""

    def __init__(self, a: str, b: bytes) -> None:
        self.a, self.b = bpe.Splitter(public_tokenizers.PATTERN, TokenizerPieces(a)), WordPieces(b)
        self.a_bytes, self.b_bytes = a_vocabulary(a), self.b.bytes

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Each text's ids of A and B as little-endian 32-bit integers; none where joined bytes aren't space+text."""
        spaced = [f" {x}" for x in texts]
        out = []
        for got, table in ((self.a.encode(spaced), self.a_bytes), (self.b.encode(texts), self.b_bytes)):
            out.append([(x, b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist()))) for x in got])
        want = [x.encode() for x in spaced]
        good = [bool(t) and w == x[1] == y[1] for t, w, x, y in zip(texts, want, *out, strict=True)]
        return tuple([x[0] if ok else b"" for x, ok in zip(side, good, strict=True)] for side in out)


def a_vocabulary(text: str) -> list[bytes]:
    """The bytes of every id of a byte-level tokenizer file; added tokens stand for their own strings."""
    whole, letters = json.loads(text), byte_alphabet()
    out = [b""] * (1 + max([*whole["model"]["vocab"].values(), *[t["id"] for t in whole.get("added_tokens", [])]]))
    for token, i in whole["model"]["vocab"].items():
        out[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    for t in whole.get("added_tokens", []):
        out[t["id"]] = t["content"].encode()
    return out


def token_ids(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id") -> DataFrame:
    """id, a, b: ids of each whole text as little-endian integers (16 bits where both vocabularies allow it); empty where the bytes differ."""
    with open(a_path, encoding="utf-8") as file:
        a = file.read()
    with open(b_path, "rb") as file:
        b = file.read()
    sent = docs.sparkSession.sparkContext.broadcast((a, b))  # of a size that the vocabularies fix
    key, kind = f"align-{hashlib.sha256(a.encode() + b).hexdigest()}", _kind(len(a_vocabulary(a)), len(WordPieces(b).bytes))

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        coder = common.held(key, lambda: Encoders(*sent.value))
        got = coder.encode(block.column(1).fill_null(b"").cast(pa.string()).to_pylist())
        narrow = [pa.array([np.frombuffer(x, "<u4").astype(kind).tobytes() for x in side], pa.binary()) for side in got]
        return pa.RecordBatch.from_arrays([block.column(0), *narrow], names=["id", "a", "b"])

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, a binary, b binary"
    return common.map_blocks(docs.select(id_col, F.col("text").cast("binary").alias("text")), run, schema, keeps=True)


def _kind(*sizes: int) -> str:
    return "<u2" if max(sizes) <= 1 << 16 else "<u4"


class Links:
    """The links of a block of rows (id, a, b), by byte offsets over the whole block."""

    def __init__(self, block: pa.RecordBatch, kind: str, a_sizes: np.ndarray, b_sizes: np.ndarray) -> None:
        (self.a, self.a_at), (self.b, self.b_at) = (self._ids(block.column(k), kind) for k in (1, 2))
        a_ends, b_ends = np.cumsum(a_sizes[self.a]), np.cumsum(b_sizes[self.b])
        mark = np.zeros(int(a_ends[-1]) + 1 if len(a_ends) else 1, np.uint8)
        mark[a_ends] = 1
        mark[b_ends] |= 2
        ends = np.flatnonzero(mark)
        mark = mark[ends]
        in_a, in_b = (mark & 1).astype(np.int64), (mark >> 1).astype(np.int64)
        self.of_a, self.of_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b  # the tokens whose ranges reach each end
        self.joint = mark == 3  # both end here
        self.keys = (self.b[self.of_b].astype(np.int64) << 32) | self.a[self.of_a].astype(np.int64)
        #: Where each row's links start, by the ends of its last A token.
        self.at = np.searchsorted(self.of_a, self.a_at)

    @staticmethod
    def _ids(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
        data, at = common.raw(column)
        width = int(kind[2:])
        return np.frombuffer(data.tobytes(), kind).astype(np.int64), at // width


def per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between row starts."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts; keys come sorted."""
    if not len(keys):
        return _NONE, _NONE
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def partial_counts(ids: DataFrame, kind: str, a_sizes: np.ndarray, b_sizes: np.ndarray) -> DataFrame:
    """pair, n: each task's counts of its own links; a task of many distinct pairs hands on several times."""
    common.small_batches(ids.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        parts, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, counts = (np.concatenate([p[k] for p in parts]) if parts else _NONE for k in (0, 1))
            order = np.argsort(keys, kind="stable")
            return summed(keys[order], counts[order])

        for block in common.blocks(batches):
            parts.append(np.unique(Links(block, kind, a_sizes, b_sizes).keys, return_counts=True))
            size += len(parts[-1][0])
            if size > HELD_PAIRS:
                parts = [merged()]
                size = len(parts[0][0])
                if size > HELD_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], names=["pair", "n"])
                    parts, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["pair", "n"])

    return ids.mapInArrow(run, "pair long, n long")


def _open(folder: str) -> tuple[fs.FileSystem | None, str]:
    """The file system of a qualified folder (none for files that this machine mounts) and the path in it."""
    if folder.startswith("file:"):
        return None, "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def save_shard(folder: str, name: str, values: np.ndarray) -> None:
    """values as a .npy file that counts only once it's whole; a repeated task writes the same again."""
    system, path = _open(folder)
    if system is None:
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}-{uuid.uuid4().hex}.npy"
        np.save(part, values)
        os.replace(part, f"{path}/{name}.npy")
        return
    part = f"{path}/.{name}-{uuid.uuid4().hex}.npy"
    system.create_dir(path, recursive=True)
    with system.open_output_stream(part) as out:
        np.save(out, values)
    system.move(part, f"{path}/{name}.npy")


def load_shard(folder: str, name: str) -> np.ndarray:
    """A shard's values: mapped into memory, or read where the folder isn't mounted."""
    system, path = _open(folder)
    if system is None:
        return np.load(f"{path}/{name}.npy", mmap_mode="r")
    with system.open_input_file(f"{path}/{name}.npy") as file:
        return np.load(file)


def count_shards(partial: DataFrame, folder: str) -> DataFrame:
    """shard, first (its least pair), b, best: the highest count of each B id in each shard; partial (pair, n) is summed and written to folder.

    A shard is one range of pairs: {shard}-keys.npy and {shard}-counts.npy, sorted and without repeats.
    """
    parts = max(1, -(-partial.count() // SHARD_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [_NONE], [_NONE]
        for b in batches:
            k, n = summed(b.column(0).to_numpy(), b.column(1).to_numpy())
            if len(keys[-1]) and len(k) and keys[-1][-1] == k[0]:  # a run goes on
                counts[-1][-1] += n[0]
                k, n = k[1:], n[1:]
            if len(k):
                keys.append(k)
                counts.append(n.copy())
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        if not len(keys):
            return
        shard = TaskContext.get().partitionId()
        save_shard(folder, f"{shard}-keys", keys)
        save_shard(folder, f"{shard}-counts", counts)
        b, at = np.unique(keys >> 32, return_index=True)
        cols = [pa.array(np.full(len(b), shard, np.int32)), pa.array(np.full(len(b), keys[0])), pa.array(b), pa.array(np.maximum.reduceat(counts, at))]
        yield pa.RecordBatch.from_arrays(cols, names=["shard", "first", "b", "best"])

    return partial.repartitionByRange(parts, "pair").sortWithinPartitions("pair").mapInArrow(run, "shard int, first long, b long, best long")


class Counts:
    """Corpus-wide counts of pairs, from the shards of a folder."""

    def __init__(self, folder: str, shards: list[tuple[int, int]]) -> None:
        self.folder, self.shards, self.first = folder, [s for s, _ in shards], np.array([f for _, f in shards], np.int64)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted distinct keys, each of which some shard holds."""
        out = np.zeros(len(keys), np.int64)
        ends = np.append(np.searchsorted(keys, self.first), len(keys))
        for k, shard in enumerate(self.shards):
            own = keys[ends[k] : ends[k + 1]]
            if not len(own):
                continue
            if shard not in self.open:
                self.open[shard] = load_shard(self.folder, f"{shard}-keys"), load_shard(self.folder, f"{shard}-counts")
            known, counts = self.open[shard]
            out[ends[k] : ends[k + 1]] = counts[np.searchsorted(known, own)]
        return out


class GroupText:
    """Groups as text: `a1,a2|b1;a3|b2`."""

    def __init__(self, a_size: int, b_size: int) -> None:
        self.a_size, self.b_size = a_size, b_size
        self.parts = [f"{i}{end}".encode() for size, ends in ((a_size, ",|"), (b_size, ",;")) for end in ends for i in range(size)]

    def rows(self, x: Links) -> list[bytes]:
        """The text of every row; empty without tokens."""
        joint = np.flatnonzero(x.joint)
        a_last, b_last = x.of_a[joint], x.of_b[joint]  # the last tokens of every group
        a_end, b_end = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
        a_end[a_last], b_end[b_last] = 1, 1
        a_group, b_group = np.cumsum(a_end) - a_end, np.cumsum(b_end) - b_end
        b_before = np.concatenate([[0], b_last + 1])[a_group]  # B tokens of earlier groups
        a_before = (a_last + 1)[b_group] if len(b_group) else b_group  # A tokens up to this group
        out = np.zeros(len(x.a) + len(x.b), np.int64)
        out[np.arange(len(x.a)) + b_before] = x.a + a_end * self.a_size
        out[np.arange(len(x.b)) + a_before] = x.b + b_end * self.b_size + 2 * self.a_size
        get, at = self.parts.__getitem__, (x.a_at + x.b_at).tolist()
        return [b"".join(map(get, out[i:j].tolist()))[:-1] for i, j in zip(at, at[1:])]  # noqa: B905


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, groups: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Aligns the tokens of two tokenizers in every whole text of docs; counts of linked pairs are those of all of docs.

    One row per row of docs: id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest
    of their B id, ties included), count_sum, groups_sha256, and with groups the text that it digests.
    A null or empty text, and one whose tokens don't join to space+text, has zeros and an empty digest.
    Repeated rows count each and give a row each; a null id stays null; an empty table gives no rows;
    other columns are left out. Only one row a B id and one a shard reach the driver.
    """
    spark = docs.sparkSession
    a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    with open(a_path, encoding="utf-8") as file:
        a_bytes = a_vocabulary(file.read())
    with open(b_path, "rb") as file:
        b_bytes = WordPieces(file.read()).bytes
    kind = _kind(len(a_bytes), len(b_bytes))
    a_sizes, b_sizes = (np.array([len(x) for x in table], np.int64) for table in (a_bytes, b_bytes))
    ids = common.staged(token_ids(docs, a_path, b_path, id_col))
    folder = common.shared_path(spark, "pairs")
    shards = common.staged(count_shards(common.staged(partial_counts(ids, kind, a_sizes, b_sizes)), folder))
    first = [(r["shard"], r["first"]) for r in shards.select("shard", "first").distinct().orderBy("first").collect()]  # one row a shard
    best = np.zeros(len(b_bytes), np.int64)
    for r in shards.groupBy("b").agg(F.max("best").alias("best")).collect():  # one row a B id
        best[r["b"]] = r["best"]
    sent = spark.sparkContext.broadcast((first, best, a_sizes, b_sizes))

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        first, best, a_sizes, b_sizes = sent.value
        counts, text = common.held(folder, lambda: (Counts(folder, first), GroupText(len(a_sizes), len(b_sizes))))
        x = Links(block, kind, a_sizes, b_sizes)
        keys, places = np.unique(x.keys, return_inverse=True)
        n = counts.of(keys)
        at_best = (n == best[keys >> 32])[places]
        written = text.rows(x)
        cols = [np.diff(x.a_at), np.diff(x.b_at), per_row(x.joint, x.at), np.diff(x.at), per_row(at_best, x.at), per_row(n[places], x.at)]
        digests = [hashlib.sha256(t).hexdigest() if t else "" for t in written]
        arrays = [block.column(0), *[pa.array(c, pa.int64()) for c in cols], pa.array(digests, pa.string())]
        if groups:
            arrays.append(pa.array([t.decode() for t in written], pa.string()))
        return pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * groups
    return common.map_blocks(ids, run, schema, keeps=True)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(common.table(spark, sf_dir, "documents"))
