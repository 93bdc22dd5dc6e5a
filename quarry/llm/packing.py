"""Best-fit packing by minimum bin slack (operator 1).

Only the number of pieces of each length decides a packing, so the plan is made on the driver from
a histogram of at most `capacity` counts, whatever the corpus. One bitset dynamic program per bin
finds the fullest combination around the longest piece left; the combination is then used as often
as the counts allow. Pieces find their seats by their rank within their length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common


def fullest(lengths: list[int], left: Counter, room: int) -> Counter:
    """The combination of available lengths (descending) with the largest sum within room."""
    reach, layers, mask = 1, [], (1 << room + 1) - 1
    for size in lengths:
        if size > room:
            continue
        many, step = min(left[size], room // size), 1
        while many > 0:
            step = min(step, many)
            wider = (reach | reach << size * step) & mask
            if wider != reach:
                layers.append((size, step, reach))
                reach = wider
            many -= step
            step *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, Counter()
    for size, step, before in reversed(layers):
        if not before >> at & 1:
            taken[size] += step
            at -= size * step
    return taken


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Seats by length and rank, rows (length, first rank, first bin, pieces a bin, first offset), and the number of bins.

    The longest piece left opens each bin. A combination is repeated while all its counts last, so
    there are at most about capacity * ln(capacity) combinations for any number of pieces.
    """
    left = Counter({k: int(v) for k, v in histogram.items() if v})
    used: Counter = Counter()
    lengths = sorted(left, reverse=True)
    rows, bins = [], 0
    while lengths:
        top = lengths[0]
        left[top] -= 1
        bin_ = fullest(lengths, left, capacity - top)
        left[top] += 1
        bin_[top] += 1
        times, offset = min(left[k] // m for k, m in bin_.items()), 0
        for size in sorted(bin_, reverse=True):
            rows.append((size, used[size], bins, bin_[size], offset))
            offset += size * bin_[size]
            used[size] += times * bin_[size]
            left[size] -= times * bin_[size]
        bins += times
        if not all(left[k] for k in bin_):
            lengths = [x for x in lengths if left[x]]
    return np.array(sorted(rows), np.int64).reshape(-1, 5), bins


def seats(rows: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of the rank-th piece of each length."""
    row = rows[np.searchsorted((rows[:, 0] << 44) + rows[:, 1], (length << 44) + rank, side="right") - 1]
    past = rank - row[:, 1]
    return row[:, 2] + past // row[:, 3], row[:, 4] + past % row[:, 3] * length


class TokenizerPieces:
    """encode_many of pre-tokens by the tokenizers library; those that open with one space go in as running text."""

    RUN, ONCE = 256, 8192
    _joins = re.compile(r"\x20\S+")

    def __init__(self, text: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each keep memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.encode_special_tokens = True  # texts come cut at added tokens; pre-tokens side by side must not make one

    def __call__(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(pieces), self.ONCE):
            out += self._some(pieces[i : i + self.ONCE])
        return out

    def _some(self, pieces: list[str]) -> list[bytes]:
        out = dict.fromkeys(pieces, b"")
        joined, alone, joins = [], [], self._joins.fullmatch
        for x in pieces:
            (joined if joins(x) else alone).append(x)
        runs = [joined[i : i + self.RUN] for i in range(0, len(joined), self.RUN)]
        for run, got in zip(runs, self.tokenizer.encode_batch(["".join(x) for x in runs], add_special_tokens=False), strict=True):
            ids, words = np.array(got.ids, "<u4"), np.array(got.word_ids, np.int64)
            if len(words) == 0 or words[-1] != len(run) - 1:
                alone += run  # split otherwise than by the pattern
                continue
            ends = np.searchsorted(words, np.arange(len(run)), side="right") * 4
            data, at = ids.tobytes(), 0
            for x, to in zip(run, ends.tolist(), strict=True):
                out[x] = data[at:to]
                at = to
        for x, got in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            out[x] = np.array(got.ids, "<u4").tobytes()
        return [out[x] for x in pieces]


class AddedTokens:
    """Added tokens of a tokenizer, which stand for one id wherever their string is in a text."""

    def __init__(self, text: str) -> None:
        added = json.loads(text).get("added_tokens", [])
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in what is around them are not supported")
        self.ids = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added if t["content"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.ids, key=lambda x: (-len(x), x)))) + ")") if self.ids else None

    def encode(self, texts: list[str], plain: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Each text's ids: plain's, of what is between added tokens, and theirs."""
        held = [i for i, t in enumerate(texts) if any(map(t.__contains__, self.ids))]
        if not held:
            return plain(texts)
        parts = {i: self.cut.split(texts[i]) for i in held}
        rest = iter(plain([x for i, t in enumerate(texts) for x in (parts[i][::2] if i in parts else [t])]))
        return [b"".join(next(rest) if k % 2 == 0 else self.ids[x] for k, x in enumerate(parts.get(i, [""]))) for i in range(len(texts))]


def splitter(key: int, text: str, memo: int | None = None) -> bpe.Splitter:
    """This worker's splitter, kept over tasks; memo bounds each generation of its memories (bpe.MEMO)."""
    return common.held(f"pieces-{key}-{memo}", lambda: bpe.Splitter(public_tokenizers.PATTERN, TokenizerPieces(text), memo))


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, memo: int | None = None) -> DataFrame:
    """Each document's ids and end_id, cut where they exceed capacity: the first piece takes what whole pieces leave.

    seat is a piece's number among those of its length in its task, part; both are written with the row.
    """
    with open(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        text = file.read()
    sent, added = docs.sparkSession.sparkContext.broadcast(text), AddedTokens(text)
    key, end = zlib.crc32(text.encode()), np.array([end_id], "<u4").tobytes()

    def run(block: pa.RecordBatch, seen: Counter) -> pa.RecordBatch:
        rows, own = [], TaskContext.get().partitionId()
        for i, ids in enumerate(added.encode(block.column(1).fill_null(b"").cast(pa.string()).to_pylist(), splitter(key, sent.value, memo).encode)):
            ids += end
            n, start, piece = len(ids) // 4, 0, 0
            while start < n:
                to = start + ((n - start) % capacity or capacity)
                part = ids[start * 4 : to * 4]
                rows.append((i, piece, start, to - start, zlib.crc32(part), own, seen[to - start], part))
                seen[to - start] += 1
                start, piece = to, piece + 1
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        arrays = [block.column(0).take(pa.array(cols[0]))] + [pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays[: 7 + with_ids], names=[str(i) for i in range(7 + with_ids)])

    def task(batches):
        seen: Counter = Counter()
        for block in common.blocks(batches):
            yield run(block, seen)

    common.small_batches(docs.sparkSession)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, seat long" + ", ids binary" * with_ids
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(task, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, memo: int | None = None) -> DataFrame:
    """Packs all documents into as few sequences of at most capacity tokens as minimum bin slack finds.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with_ids the
    ids as little-endian bytes. A null or empty text is end_id alone; repeated rows are packed each;
    a null doc_id stays null; an empty table gives no rows. Other columns are left out. The strings
    of the tokenizer's added tokens in a text are their ids, as the library has it. memo bounds the
    memory of words that each worker keeps (bpe.MEMO without it); less costs time, and no result.
    """
    cut = common.staged(pieces(docs, tokenizer, capacity, end_id, with_ids, memo))
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("here"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("here").alias("n")).collect()}  # capacity rows at most
    rows, _ = plan(histogram, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("base") + F.col("seat")).alias("rank"))
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def seat(batches):
        for b in batches:
            sequence, offset = seats(sent.value, b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1]) + ", sequence_id long, offset long"
    return ranked.mapInArrow(seat, schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
