"""Secret scans by inferred formats (operator 12).

Rules find labelled credentials: values assigned to telling names, access keys and long hexadecimal
strings. Of each kind a probabilistic automaton is inferred, by merging the compatible states of the
prefix tree of a bounded sample. All other runs of credential characters, counted over the whole
corpus, make a chain of symbol pairs that stands for ordinary text. Every such run is then scored: it is
a secret where some kind's likelihood, times the share of that kind, is above that of ordinary text.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .automata import Automaton

#: The rules' kinds in the order of results, then that of the method.
KINDS, INFERRED = ("assign", "access", "hex"), "inferred"
#: Least length of what each rule finds: the assigned value, the access key, the hexadecimal string.
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Least length of a run that is scored.
CANDIDATE = 12
#: Distinct credentials of a kind that its automaton is inferred from, at most, and the longest of them.
SAMPLE, LONGEST = 2_000, 256
#: Distinct credentials that a task holds before it hands them on.
HELD = 100_000

_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_SYMBOLS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
#: Number of each byte among the symbols; the start and the end of a run share the last number.
_CODE = np.full(256, len(_SYMBOLS), np.uint8)
_CODE[list(_SYMBOLS)] = np.arange(len(_SYMBOLS))
_EDGE = len(_SYMBOLS)


def _runs(member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of members of so many bytes."""
    edge = np.flatnonzero(np.diff(member.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_HEX = _table(b"0123456789abcdef")
#: Characters of scored runs: those of values but the dot, which ends sentences.
_RUN = _table(_SYMBOLS.replace(b".", b""))


class Texts:
    """A block of texts as one line of bytes, parted by line breaks, which no rule matches."""

    def __init__(self, column: pa.Array) -> None:
        texts = column.fill_null(b"").to_pylist()
        self.whole = b"\n".join(texts)
        self.data = np.frombuffer(self.whole, np.uint8)
        self.at = np.cumsum([0, *[len(t) + 1 for t in texts]])  # where rows start

    def base(self) -> list[tuple[int, int, int, bytes]]:
        """start, kind, end and credential of every span of the rules, sorted."""
        out = [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(self.whole) if m.end(1) - m.start(1) >= LEAST["assign"]]
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(self.whole) if m.end() - m.start() >= LEAST["access"]]
        out += [(s, 2, e, self.whole[s:e]) for s, e in zip(*(x.tolist() for x in _runs(_HEX[self.data], LEAST["hex"])), strict=True)]
        return sorted(out)

    def candidates(self, base: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs that no span of the rules touches."""
        starts, ends = _runs(_RUN[self.data], CANDIDATE)
        if base:
            taken = np.zeros(len(self.data) + 1, np.int64)
            for s, _, e, _ in base:
                taken[s + 1 : e + 1] = 1
            taken = np.cumsum(taken)
            free = taken[ends] == taken[starts]
            starts, ends = starts[free], ends[free]
        return starts, ends

    def rows(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, places, side="right") - 1

    def points(self) -> np.ndarray:
        """Code points before each byte of the block."""
        return np.concatenate([np.zeros(1, np.int64), np.cumsum((self.data & 0xC0) != 0x80)])


def _pairs(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol pairs of runs, edges included, and the run of each."""
    sizes = ends - starts + 1
    run = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = starts[run] + place
    before = np.where(place > 0, codes[np.maximum(at - 1, 0)], _EDGE).astype(np.int64)
    after = np.where(place < (sizes - 1)[run], codes[np.minimum(at, len(codes) - 1)], _EDGE)
    return before * (_EDGE + 1) + after, run


def gathered(docs: DataFrame) -> DataFrame:
    """kind, value, n over docs (text): the labelled credentials, and under an empty kind the pairs of ordinary runs."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        found, pairs = Counter(), np.zeros((_EDGE + 1) ** 2, np.int64)

        def out() -> pa.RecordBatch:
            kinds, values = [KINDS[k] for k, _ in found], [v.decode() for _, v in found]
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(list(found.values()), pa.int64())], names=["kind", "value", "n"])

        for block in common.blocks(batches):
            texts = Texts(block.column(0))
            base = texts.base()
            found.update((k, v) for _, k, _, v in base)
            starts, ends = texts.candidates(base)
            if len(starts):
                pairs += np.bincount(_pairs(_CODE[texts.data], starts, ends)[0], minlength=len(pairs))
            if len(found) > HELD:
                yield out()
                found.clear()
        yield out()
        seen = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array([""] * len(seen), pa.string()), pa.array([str(x) for x in seen], pa.string()), pa.array(pairs[seen])], names=["kind", "value", "n"])

    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "kind string, value string, n long")
    return counted.groupBy("kind", "value").agg(F.sum("n").alias("n"))


class Model:
    """Automata of the kinds and the chain of ordinary runs, with each one's log share."""

    def __init__(self, samples: dict[str, list[str]], totals: dict[str, int], pairs: dict[int, int]) -> None:
        chain = np.full((_EDGE + 1) ** 2, 0.5)
        for k, n in pairs.items():
            chain[k] += n
        chain = chain.reshape(_EDGE + 1, -1)
        runs = chain[_EDGE].sum()  # one start a run
        self.chain = np.log(chain / chain.sum(axis=1, keepdims=True)).ravel()
        self.kinds = []
        for kind, strings in samples.items():
            if strings:
                codes = [_CODE[np.frombuffer(x.encode(), np.uint8)].tolist() for x in strings]
                self.kinds.append((np.log(totals[kind] / runs), Automaton(codes, _EDGE)))

    def gain(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How far the best kind's log likelihood and share are above those of ordinary runs."""
        if not len(starts) or not self.kinds:
            return np.full(len(starts), -np.inf)
        codes = _CODE[data]
        pairs, run = _pairs(codes, starts, ends)
        plain = np.bincount(run, self.chain[pairs], len(starts))
        return np.max([share + a.score(codes, starts, ends) for share, a in self.kinds], axis=0) - plain


def learn(docs: DataFrame) -> Model:
    """The model of docs. Totals and pairs cover all rows; of each kind SAMPLE distinct credentials at most, those of the least hashes, reach the driver."""
    found = common.staged(gathered(docs))
    totals = {r["kind"]: r["n"] for r in found.where("kind <> ''").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    pairs = {int(r["value"]): r["n"] for r in found.where("kind = ''").collect()}  # as many as pairs of symbols at most
    samples = {}
    for kind in KINDS:
        own = found.where((F.col("kind") == kind) & (F.length("value") <= LONGEST))
        samples[kind] = sorted(r["value"] for r in own.orderBy(F.xxhash64("value"), "value").limit(SAMPLE).select("value").collect())
    return Model(samples, totals, pairs)


def secret_scan(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Finds secrets in every whole text of docs: id, n_assign, n_access, n_hex, base_sha256, spans, n_inferred.

    A span is a whole match, as kind:start:end in code points, the end exclusive; spans stand by start,
    then kind (assign, access, hex, inferred), joined by commas. base_sha256 digests those of the rules
    (of nothing, where there are none). A null or empty text has no spans; repeated rows give a row each
    and count each among the shares, but once among the samples; a null id stays null; an empty table
    gives no rows; without labelled credentials the rules' spans are all. Other columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs))  # bounded by SAMPLE and LONGEST

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        texts, n = Texts(block.column(1)), block.num_rows
        base = texts.base()
        starts, ends = texts.candidates(base)
        hit = sent.value.gain(texts.data, starts, ends) > 0
        spans = [(s, k, e) for s, k, e, _ in base] + list(zip(starts[hit].tolist(), [3] * int(hit.sum()), ends[hit].tolist(), strict=True))
        counts, own, all_of = np.zeros((4, n), np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
        if spans:
            points = texts.points()
            spans.sort()
            for (s, k, e), row in zip(spans, texts.rows(np.array([x[0] for x in spans])).tolist(), strict=True):
                first = int(points[s] - points[texts.at[row]])
                written = f"{(*KINDS, INFERRED)[k]}:{first}:{first + e - s}"
                counts[k, row] += 1
                all_of[row].append(written)
                if k < 3:
                    own[row].append(written)
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in own]
        cols = [block.column(0), *[pa.array(c) for c in counts[:3]], pa.array(digests, pa.string()), pa.array([",".join(x) for x in all_of], pa.string()), pa.array(counts[3])]
        return pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_inferred long"
    return common.map_blocks(docs.select(id_col, F.col("text").cast("binary").alias("text")), run, schema)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(common.table(spark, sf_dir, "documents"))
