"""Byte-level BPE over whole corpora: splitting, memoised words, a minimal perfect hash and heap merges.

Operator 9 (encode, decode) and the token stream of operator 1 stand on this module.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A space that another space precedes and that white space or the end follows: there a text can't be cut before its spaces.
_UNSAFE = re.compile(r"\x20(?<=\s\x20)(?:\s|\Z)")
#: Entries of one generation of a worker's memory of words, and the longest string that it remembers.
MEMO, MEMO_CHARS = 500_000, 64


class Memo:
    """A memory of encoded strings, bounded in bytes: two generations of most (MEMO) entries of MEMO_CHARS at most; what is used again moves to the younger."""

    def __init__(self, encode_many, most: int | None = None) -> None:
        self.encode_many, self.young, self.old, self.most = encode_many, {}, {}, most or MEMO

    def learn(self, words: set[str]) -> Callable[[str], bytes]:
        """Makes every word known; how to find them until the next call. Long words are known until then only."""
        new = words.difference(self.young)
        if not new:
            return self.young.__getitem__
        if max(map(len, new)) > MEMO_CHARS:
            long = [w for w in new if len(w) > MEMO_CHARS]
            passing = dict(zip(long, self.encode_many(long), strict=True))
            get = self.learn(words.difference(passing))
            return lambda w: passing[w] if w in passing else get(w)
        if len(self.young) + len(new) > self.most:
            self.old, self.young = self.young, {}
            new = words
        if self.old:
            known = [w for w in new if w in self.old]
            self.young.update(zip(known, map(self.old.__getitem__, known)))  # noqa: B905
            new = new.difference(known)
        fresh = list(new)
        self.young.update(zip(fresh, self.encode_many(fresh)))  # noqa: B905
        return self.young.__getitem__


class Splitter:
    """Encodes texts by pre-tokens, through encode_many(list of pre-tokens) -> list of ids as little-endian bytes.

    A text is cut before each space, which never cuts a pre-token unless spaces follow one another
    (such texts are split whole); cuts and pre-tokens are remembered in bounded memories.
    """

    def __init__(self, pattern: str, encode_many, most: int | None = None) -> None:
        self.pattern = regex.compile(pattern)
        self.tokens = Memo(encode_many, most)
        self.cuts = Memo(lambda words: self._joined(list(map(self._cut, words))), most)

    def _cut(self, word: str) -> list[str]:
        """Pre-tokens of a space and the word; letters alone, or with one mark after them, need no pattern."""
        if word.isascii():
            if len(word) > 1 and word.isalpha():
                return [f" {word}"]
            if word[-1:] in ",." and word[:-1].isalpha():
                return [f" {word[:-1]}", word[-1]]
        return self.pattern.findall(f" {word}")

    def _pieces(self, texts: list[str]) -> list[bytes]:
        return self._joined(list(map(self.pattern.findall, texts)))

    def _joined(self, split: list[list[str]]) -> list[bytes]:
        get = self.tokens.learn(set().union(*split))
        return [get(x[0]) if len(x) == 1 else b"".join(map(get, x)) for x in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        whole = [i for i, x in enumerate(texts) if _UNSAFE.search(x)]
        odd = dict(zip(whole, self._pieces([texts[i] for i in whole]), strict=True))
        split = [[] if i in odd else x.split(" ") for i, x in enumerate(texts)]
        firsts = self._pieces([x.pop(0) if x else "" for x in split])
        get = self.cuts.learn(set().union(*split))
        return [odd[i] if i in odd else firsts[i] + b"".join(map(get, x)) for i, x in enumerate(split)]


class PerfectHash:
    """Minimal perfect hash over byte strings: n keys to n slots, by hash and displace.

    Keys go to buckets by one hash; the fullest first, each bucket takes the first displacement
    under which all its keys fall on free slots. find() compares the stored key, so others give -1.
    """

    def __init__(self, keys: list[bytes]) -> None:
        n = self.n = max(1, len(keys))
        self.groups = n // 3 + 1
        h = [xxhash.xxh64_intdigest(k) for k in keys]
        buckets: dict[int, list[int]] = {}
        for i, x in enumerate(h):
            buckets.setdefault(x % self.groups, []).append(i)
        self.shift, self.slots, self.keys = [0] * self.groups, [-1] * n, keys
        free = 0
        for g, own in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(own) == 1:  # single keys fill what is left
                while self.slots[free] >= 0:
                    free += 1
                self.shift[g], self.slots[free] = -1 - free, own[0]
                continue
            d = 0
            while True:
                at = {self._at(h[i], d) for i in own}
                if len(at) == len(own) and all(self.slots[s] < 0 for s in at):
                    break
                d += 1
            self.shift[g] = d
            for i in own:
                self.slots[self._at(h[i], d)] = i

    def _at(self, h: int, d: int) -> int:
        return ((h >> 24) + d * ((h >> 7) | 1) + d * d) % self.n

    def find(self, key: bytes) -> int:
        """The key's number, or -1."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.groups]
        i = self.slots[-1 - d if d < 0 else ((h >> 24) + d * ((h >> 7) | 1) + d * d) % self.n]
        return i if i >= 0 and self.keys[i] == key else -1


class BytePair:
    """Two tiers: the perfect hash for whole pre-tokens, else merges by a heap over linked bytes."""

    def __init__(self, vocabulary: list[bytes], index: PerfectHash | None = None) -> None:
        self.words, self.index = vocabulary, index or PerfectHash(vocabulary)
        self.single = [self.index.find(bytes([b])) for b in range(256)]
        self.pairs: dict[int, int] = {}

    def _pair(self, key: int) -> int:
        """The rank of two ids' joint bytes, -1 if none; remembered by both ids."""
        got = self.pairs[key] = self.index.find(self.words[key >> 32] + self.words[key & 0xFFFFFFFF])
        return got

    def token(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: the lowest rank merges first, the leftmost among equals.

        Heap entries are rank << 32 | place; one is stale once the pair at its place has another rank.
        """
        whole = self.index.find(piece)
        if whole >= 0:
            return [whole]
        pairs, rank_of, pop, push = self.pairs, self._pair, heapq.heappop, heapq.heappush
        if len(pairs) > MEMO:
            pairs.clear()
        ids = list(map(self.single.__getitem__, piece))
        n = len(ids)
        now = [pairs[k] if (k := a << 32 | b) in pairs else rank_of(k) for a, b in zip(ids, ids[1:])]  # noqa: B905  each place's rank with the next
        now.append(-1)
        heap = [r << 32 | i for i, r in enumerate(now) if r >= 0]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            x = pop(heap)
            i, rank = x & 0xFFFFFFFF, x >> 32
            if now[i] != rank:
                continue
            j = after[i]
            ids[i] = rank
            ids[j] = now[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                key = rank << 32 | ids[k]
                now[i] = r = pairs[key] if key in pairs else rank_of(key)
                if r >= 0:
                    push(heap, r << 32 | i)
            else:
                now[i] = -1
            p = before[i]
            if p >= 0:
                key = ids[p] << 32 | rank
                now[p] = r = pairs[key] if key in pairs else rank_of(key)
                if r >= 0:
                    push(heap, r << 32 | p)
        return [x for x in ids if x >= 0]

    def encode_many(self, pieces: list[str]) -> list[bytes]:
        return [array("I", self.token(x.encode())).tobytes() for x in pieces]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.words.__getitem__, ids.tolist()))


def load_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def coder(key: str, vocabulary: list[bytes], index: PerfectHash, pattern: str) -> tuple[BytePair, Splitter]:
    """This worker's coder, kept over tasks."""

    def make() -> tuple[BytePair, Splitter]:
        pair = BytePair(vocabulary, index)
        return pair, Splitter(pattern, pair.encode_many)

    return common.held(key, make)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Encodes each whole text of docs and decodes it again.

    One row per row of docs: id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves as
    little-endian bytes if asked for. A null or empty text has no tokens, and the digests of nothing.
    Repeated rows each give a row; other columns of docs are left out. The rank file is read on the
    driver and sent with its perfect hash, of a size that the vocabulary fixes.
    """
    vocabulary = load_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, PerfectHash(vocabulary)))
    key = hashlib.sha256(b"\n".join(vocabulary) + pattern.encode()).hexdigest()

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        pair, splitter = coder(key, *sent.value, pattern)
        got = splitter.encode(block.column(1).fill_null(b"").cast(pa.string()).to_pylist())
        back = [hashlib.sha256(pair.decode(np.frombuffer(x, "<u4"))).hexdigest() for x in got]
        cols = [block.column(0), pa.array([len(x) // 4 for x in got], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in got]), pa.array(back)]
        return pa.RecordBatch.from_arrays(cols + [pa.array(got, pa.binary())] * ids, names=[f"c{i}" for i in range(4 + ids)])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    return common.map_blocks(docs.select(id_col, F.col("text").cast("binary").alias("text")), run, schema, keeps=True)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(common.table(spark, sf_dir, "documents"))
