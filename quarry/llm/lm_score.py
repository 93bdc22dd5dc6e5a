"""Language-model scores of whole texts (operator 6): a causal self-attention model, mixed word by word with corpus counts.

Texts are split and encoded once, and every later pass reads ids. Every token of every training text is a target. Classes, and
a subword's share of its class after the subword before it, come from counts over all training texts. In
rounds, every task goes on with the model over all windows of its texts of that round, the first round
from random weights, and the weights are averaged by the windows behind them.
"""

from __future__ import annotations

import copy
import math
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention, bpe, common
from .attention import ROUND_RATE, WINDOW, WINDOWS, Adam, Attention

#: Rounds over all training documents, each of which has its turn in one; windows of a step after a task's first STEPS steps.
ROUNDS, LATER = 2, 256
#: Tokens whose contexts a task counts at once.
CELLS = 1 << 22
#: Of start_sample() and spans(), which lm_score() doesn't use: rows, words of a span, share of spans.
SAMPLE, SPAN, SHARE = 1000, WINDOW + 8, 1 / 8
#: Most frequent words that are broadcast with their counts; rarer ones meet their counts in a shuffled join.
FREQUENT = 200_000
#: Bytes of the longest word that is broadcast; longer ones are joined.
LONGEST = 64
#: Weights of the attention model against word counts, beside the chance of a new word.
WEIGHTS = (0.1, 0.3, 0.6, 0.9)
#: Rows and bytes of texts whose words are told apart at once.
TEXTS, TEXT_BYTES = 2048, 4 << 20
#: Distinct words that a counting task holds before it passes them on.
HELD = 300_000


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; split at space and tab to carriage return."""
    return text.lower().split()


def block_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words_of() all texts (binary), each word as a place among those, and how many each text has."""
    texts = texts.fill_null(b"")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    plain = pa.Array.from_buffers(pa.string(), len(texts), [None, *texts.buffers()[1:]])  # as bytes; nothing here looks at characters
    lists = pc.ascii_split_whitespace(pc.ascii_lower(plain))
    words, at = lists.values, lists.offsets.to_numpy()
    full = pc.binary_length(words).to_numpy() > 0
    if not full.all():  # white space at either end of a text leaves an empty string
        words, at = words.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[at]
    found = pc.dictionary_encode(words)
    data, ends = common.raw(found.dictionary.cast(pa.binary()))
    whole, ends = data.tobytes(), ends.tolist()
    return [whole[i:j] for i, j in zip(ends, ends[1:])], found.indices.to_numpy(), np.diff(at)  # noqa: B905


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary), c: over all rows of texts (one binary column); the end of each text counts as the empty word."""

    def run(batches):
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
            held.clear()
            return got

        for block in common.blocks(batches, TEXT_BYTES):
            kinds, which, _ = block_words(block.column(0))
            for w, c in zip(kinds, np.bincount(which, minlength=len(kinds)).tolist(), strict=True):
                held[w] += c
            held[b""] += block.num_rows
            if len(held) > HELD:
                yield out()
        yield out()

    common.small_batches(texts.sparkSession, TEXTS)
    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def openings(ranks: list[bytes]) -> np.ndarray:
    """Which ids open a word: those that begin with a space, which no word holds; the end, last, is one too."""
    return np.array([*(t[:1] == b" " for t in ranks), True])


_subwords: dict[int, bpe.Memo] = {}


def subwords(ranks: list[bytes]) -> bpe.Memo:
    """This worker's memory of words as uint16 ids; a word is encoded as it stands after a space."""
    if id(ranks) not in _subwords:
        import tiktoken

        opens = openings(ranks)
        coding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})

        def encode(words: list[bytes]) -> list[bytes]:
            # a space opens a match and ends the one before it, so words are matched in a row as they are alone; beyond ASCII there is other white space
            plain = [w for w in words if w.isascii()]
            ids = np.array(coding.encode_ordinary(f" {b' '.join(plain).decode()}") if plain else [], "<u2")
            at, data = (np.append(np.flatnonzero(opens[ids]), len(ids)) * 2).tolist(), ids.tobytes()
            got = dict(zip(plain, map(data.__getitem__, map(slice, at, at[1:])), strict=True))  # noqa: B905
            return [got[w] if w in got else array("H", coding.encode_ordinary(f" {w.decode(errors='replace')}")).tobytes() for w in words]

        _subwords.clear()
        _subwords[id(ranks)] = bpe.Memo(encode)
    return _subwords[id(ranks)]


def block_ids(memo: bpe.Memo, kinds: list[bytes], which: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' subword ids, each text's with its end, one after another; and how many each text has. Texts as block_words() gives them."""
    parts = [*map(memo.learn(set(kinds)), kinds), np.array([end], "<u2").tobytes()]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 2
    flat, starts = np.frombuffer(b"".join(parts), "<u2"), np.cumsum(sizes) - sizes
    which = np.insert(which.astype(np.int64), np.cumsum(counts), len(kinds))
    each = sizes[which]
    ends = np.cumsum(each)
    place = np.arange(int(ends[-1])) + np.repeat(starts[which] - ends + each, each)
    return flat[place], np.diff(np.append(0, ends[np.cumsum(counts + 1) - 1]))


def cut(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary array whose rows are so many items of data each."""
    ends = np.append(0, np.cumsum(counts) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def encoded(docs: DataFrame, ranks, frequent) -> DataFrame:
    """Rows of docs (doc_id, learn, text) with ids in place of text: its subword ids, the end last; also places (int32, of each word in the broadcast list frequent, -1 for others) and rare (those others in their order, joined by spaces)."""
    end = len(ranks.value)
    tables: dict[str, dict[bytes, int]] = {}

    def run(batches):
        if "known" not in tables:
            words = frequent.value.to_pylist()
            tables["known"] = dict(zip(words, range(len(words)), strict=True))
        known = tables["known"]
        for block in common.blocks(batches, TEXT_BYTES):
            kinds, which, counts = block_words(block.column(2))
            ids, many = block_ids(subwords(ranks.value), kinds, which, counts, end)
            places = np.array([known.get(w, -1) for w in kinds], np.int32)[which]
            unknown = np.flatnonzero(places < 0)
            ends = np.searchsorted(unknown, np.cumsum(counts)).tolist()
            words = list(map(kinds.__getitem__, which[unknown].tolist()))
            rare = pa.array([b" ".join(words[i:j]) for i, j in zip([0, *ends], ends)], pa.binary())  # noqa: B905
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), rare, cut(places, counts), cut(ids, many)], names=["doc_id", "learn", "rare", "places", "ids"])

    common.small_batches(docs.sparkSession, TEXTS)
    return docs.select("doc_id", "learn", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, learn boolean, rare binary, places binary, ids binary")


def id_counts(ids: DataFrame, size: int) -> np.ndarray:
    """How often each of so many ids occurs in all rows of ids."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for texts in _arrays(batches):
            total += np.bincount(np.concatenate(texts), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "c"])

    got = ids.mapInArrow(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("id").to_numpy()] = got.column("c").to_numpy()
    return out


def spans(texts: list[list[bytes]]) -> list[tuple[list[bytes], bool, bool]]:
    """Runs of SPAN words, a share SHARE of each text's by a hash of the text: words, whether they open it, and whether they end it."""
    out = []
    for words in texts:
        places = np.arange(0, len(words) + 1, SPAN)
        seed = np.uint64(zlib.crc32(b" ".join(words)))
        with np.errstate(over="ignore"):
            chosen = common.mix(seed * np.uint64(0x9E3779B97F4A7C15) + places.astype(np.uint64)) < np.uint64(int(SHARE * 2**64))
        for at in places[chosen].tolist():
            # a window needs the words before those that it scores
            out.append((words[at : at + SPAN], at == 0, at + SPAN > len(words)))
    return out


def start_sample(texts: DataFrame, rows: int) -> DataFrame:
    """About so many distinct texts (text; null as empty), those of small hashes: however often a text is repeated, it is drawn once."""
    each = texts.select(F.expr("coalesce(text, X'')").alias("text")).withColumn("_hash", F.xxhash64("text"))
    total = each.agg(F.approx_count_distinct("_hash")).first()[0]
    if total > rows:
        each = each.where(F.pmod("_hash", F.lit(1 << 40)) < int((1 << 40) * rows / total))
    return each.groupBy("_hash").agg(F.first("text").alias("text")).select("text")


def token_ids(texts: DataFrame, ranks) -> DataFrame:
    """ids (binary, uint16): of each row of texts (text), the end last."""
    end = len(ranks.value)

    def run(batches):
        for block in common.blocks(batches):
            yield pa.RecordBatch.from_arrays([cut(*block_ids(subwords(ranks.value), *block_words(block.column(0)), end))], names=["ids"])

    return texts.select("text").mapInArrow(run, "ids binary")


def _arrays(batches):
    """Lists of id arrays, of about as many bytes as a block."""
    for block in common.blocks(batches):
        yield [np.frombuffer(x, "<u2") for x in block.column(0).to_pylist()]


def context_counts(model: Attention, ids: DataFrame) -> np.ndarray:
    """How often each context of Attention.contexts() occurs in all rows of ids: a table of fixed size."""
    sent, size = ids.sparkSession.sparkContext.broadcast(model), (attention.ROWS + 1) * attention.BEFORE

    def run(batches):
        total, waiting, n = np.zeros(size, np.int64), [], 0
        for texts in _arrays(batches):
            waiting.append(sent.value.contexts(texts))
            n += len(waiting[-1])
            if n >= CELLS:
                total += np.bincount(np.concatenate(waiting), minlength=size)
                waiting, n = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=size)
        for at in np.array_split(np.flatnonzero(total), 16):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["cell", "c"])

    got = ids.mapInArrow(run, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("cell").to_numpy()] = got.column("c").to_numpy()
    return out


def fit(ids: DataFrame, size: int) -> Attention | None:
    """The model of all rows of ids (staged), which are of so many subwords, the end last; None without any."""
    each = id_counts(ids, size)
    if not each[-1]:
        return None
    model = Attention(each)
    table = context_counts(model, ids)
    model.cluster(table)
    model.follow(table)
    model.open(np.random.RandomState(5))
    # tasks with too few windows for a start of their own are put together
    tasks = max(1, int(each.sum()) // (attention.SCORED * ROUNDS * attention.STEPS * WINDOWS))
    for k in range(ROUNDS):
        further(model, ids.where(F.pmod(F.xxhash64("ids"), F.lit(ROUNDS)) == k).coalesce(tasks), first=k == 0)
    model.finish()
    return model


def further(model: Attention, ids: DataFrame, first: bool) -> None:
    """Gives model the mean of the weights that the tasks of ids reach from it over all their windows, each weighted by its windows.

    In the first round a task goes on over its windows again until it has made STEPS steps.
    """
    sent, steps = ids.sparkSession.sparkContext.broadcast(model), attention.STEPS

    def run(batches):
        own = copy.copy(sent.value)  # tables that scoring alone needs stay shared
        own.p = {k: x.copy() for k, x in own.p.items()}
        adam, rng, n, again = Adam(own.p), np.random.RandomState(7), 0, []

        def learn(parts: list[list[np.ndarray]], rest: bool) -> list[list[np.ndarray]]:
            """Steps over the windows of parts in a random order; the last few are given back, or learnt from as well."""
            if not parts:
                return []
            x = [np.concatenate(c) for c in zip(*parts, strict=True)]
            order, at = rng.permutation(len(x[0])), 0
            while at < len(order):
                start = first and adam.step < steps
                size = WINDOWS if start else LATER
                if at + size > len(order) and not rest:
                    break
                pick = order[at : at + size]
                adam.learn(own, *[c[pick] for c in x], rate=max(attention.rate(adam.step), ROUND_RATE) if start else ROUND_RATE)
                at += size
            return [[c[order[at:]] for c in x]] if at < len(order) else []

        waiting = []
        for texts in _arrays(batches):
            part = own.windows_of(texts)
            n += len(part[0])
            if first and n <= steps * WINDOWS:
                again.append(part)
            waiting = learn([*waiting, part], False)
        learn(waiting, True)
        while n and first and adam.step < steps:  # all windows are in again: there are fewer than those steps take
            learn(again, True)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([own.weights.tobytes()], pa.binary())], names=["n", "weights"])

    def mean(batches):
        n, total = 0, 0.0
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, total = n + k, total + k * np.frombuffer(x, np.float32).astype(np.float64)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["n", "weights"])

    reached = common.staged(ids.mapInArrow(run, "n long, weights binary"))  # one row a task
    parts = math.isqrt(reached.count()) + 1
    got = pa.Table.to_batches(reached.repartition(parts).mapInArrow(mean, "n long, weights binary").toArrow())
    for b in mean(got):
        model.weights = np.frombuffer(b.column(1)[0].as_py(), np.float32)


def weights(singles: int, total: int) -> list[float]:
    """Weights of the attention model to mix over: the share of training tokens that are words seen once (the chance of a new word), and WEIGHTS; 1 without training."""
    return [(singles + 1) / (total + 2), *WEIGHTS] if total else [1.0]


def mixed(counts: Column, spelt: Column, total: int, weight: float) -> Column:
    """log10 of the mixture of a word's share of total and its log10 probability spelt, which has the weight; null without spelt."""
    seen = F.when(counts > 0, F.log10(counts * ((1 - weight) / max(total, 1))))
    x = spelt + F.lit(float(np.log10(weight)))
    return F.when(seen.isNull(), x).when(spelt.isNotNull(), F.greatest(seen, x) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(seen - x))))


def averaged(scores: list[Column]) -> Column:
    """log10 of the mean of probabilities, given by their log10."""
    most = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return most + F.log10(sum((F.pow(F.lit(10.0), x - most) for x in scores), F.lit(0.0)) / len(scores))


def lm_score(docs: DataFrame, learnable: Column, ranks_path: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """Scores every whole text, learning from learnable rows.

    One row per row of docs: doc_id, n_tokens (words and the end), n_known (those that occur in
    training), train_tokens, base_score (add-one unigram log10 probability) and score. The score sums
    log10 of each word's probability: the attention model's, over the word's subwords, with one of a
    few weights(), and the word's share of all training tokens with the rest; a text's probability is
    the mean of those that the weights give, so each text is told by the weight that suits it. Words
    that training never saw are spelt by the attention model alone. A null or empty text is its end alone; repeated
    rows are scored each; with nothing to learn from, n_known is 0, train_tokens 0, base_score 0 and
    score the uniform log10 probability of the subwords. Frequent words are looked up in a broadcast
    of FREQUENT entries at most; all others are joined with the table of counts. sample is taken no
    notice of: every training row teaches.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(bpe.load_ranks(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")))
    text = F.col("text").cast("binary").alias("text")
    training = docs.where(learnable).select(text)
    counts = common.staged(word_counts(training))
    total, distinct, singles, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("c"))), F.lit(0))).first()
    shares = weights(singles, total)
    names = [f"score{k}" for k in range(len(shares))]
    # the least count of frequent words, from a histogram by eighths of powers of two
    step = F.when(F.length("word") <= LONGEST, F.floor(F.log2("c") * 8)).otherwise(-1).cast("int")
    least, room = None, FREQUENT
    for r in sorted(counts.where((F.col("c") > 0) & (step >= 0)).groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["s"]
    frequent = counts.where((F.lit(False) if least is None else step >= least) & (F.col("c") > 0) & (F.length("word") > 0)).toArrow()
    frequent = frequent.take(np.argsort(-frequent.column("c").to_numpy(), kind="stable"))  # small places are common: they pack well
    docs = docs.select("doc_id", F.coalesce(learnable, F.lit(False)).alias("learn"), text)
    docs = common.staged(encoded(docs, ranks, spark.sparkContext.broadcast(frequent.column("word").combine_chunks())), compression="zstd")
    model = fit(docs.where("learn").select("ids"), len(ranks.value) + 1)
    sent = spark.sparkContext.broadcast((np.append(frequent.column("c").to_numpy(), ends).astype(np.float64), model))
    spread, end = np.log10(total + distinct + 1), len(ranks.value)

    def run(batches):
        many, model = sent.value
        more, opens = np.log10(many + 1), openings(ranks.value)
        for block in common.blocks(batches):
            n = block.num_rows
            ids = [np.frombuffer(x, "<u2") for x in block.column(4).to_pylist()]
            flat = np.concatenate(ids)
            spelt = model.each(ids) if model else np.full(len(flat), -np.log10(end + 1))
            spelt = np.add.reduceat(spelt, np.flatnonzero(opens[flat]))  # of each word, and of each text's end
            data, at = common.raw(block.column(3))
            sizes = np.diff(at) // 4 + 1
            text_of, closing = np.repeat(np.arange(n), sizes), np.cumsum(sizes) - 1
            places = np.insert(data.view(np.int32), at[1:] // 4, len(many) - 1 if ends else -1)
            seen = places >= 0
            mine, places = text_of[seen], places[seen]
            base, hits = np.bincount(mine, more[places], n), np.bincount(mine, minlength=n)
            by_count, by_model = many[places] / max(total, 1), np.power(10.0, spelt[seen])
            scores = [np.bincount(mine, np.log10(w * by_model + (1 - w) * by_count), n) for w in shares]
            if not ends:  # nothing to learn from
                scores = [x + spelt[closing] for x in scores]
                seen[closing] = True
            kinds, which, _ = block_words(block.column(2))
            mine = text_of[~seen] * len(kinds) + which  # a row for each text and word
            order = np.argsort(mine, kind="stable")
            mine = mine[order]
            starts = np.flatnonzero(np.diff(mine, prepend=-1))
            own, words = np.divmod(mine[starts], max(len(kinds), 1))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(n, np.int64), starts, [len(mine)]]), pa.int32()), pa.array(spelt[~seen][order], pa.float64()))
            row = block.column(0).take(pa.array(np.concatenate([np.arange(n), own])))
            keys = block.column(0).to_pylist()
            gap = pa.nulls(len(own))
            both = lambda a, kind: pa.concat_arrays([pa.array(a, kind), gap.cast(kind)])
            yield pa.RecordBatch.from_arrays([
                row, pa.array([b" %d" % k for k in keys] + [kinds[k] for k in words.tolist()], pa.binary()), lists,
                pa.concat_arrays([block.column(1), gap.cast(block.column(1).type)]), both(sizes, pa.int64()), both(hits, pa.int64()), both(base - sizes * spread, pa.float64()), *[both(x, pa.float64()) for x in scores],
            ], names=["_row", "word", "spelt", "doc_id", "n_tokens", "hits", "base", *names])

    common.small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "rare", "places", "ids")
    # each text's own row goes through the join under a key that is no word (it holds a space), so that keys stay spread
    rows = source.mapInArrow(run, f"_row long, word binary, spelt array<double>, doc_id {kind}, n_tokens long, hits long, base double, {', '.join(f'{c} double' for c in names)}")
    scarce = counts.where(F.lit(True) if least is None else step < least).where(F.length("word") > 0)
    joined = rows.join(scarce.hint("shuffle_hash"), "word", "left").withColumn("spelt", F.explode_outer("spelt"))
    first = lambda c: F.max(c).alias(c)
    known = F.col("spelt").isNotNull() & (F.col("c") > 0)
    each = [(F.max(c) + F.coalesce(F.sum(mixed(F.col("c"), F.col("spelt"), total, w)), F.lit(0.0))).alias(c) for c, w in zip(names, shares, strict=True)]
    added = joined.groupBy("_row").agg(first("doc_id"), first("n_tokens"), *each, (F.max("hits") + F.count_if(known)).alias("n_known"), (F.max("base") + F.coalesce(F.sum(F.when(known, F.log10(F.col("c") + 1))), F.lit(0.0))).alias("base_score"))
    added = added.withColumn("score", averaged([F.col(c) for c in names]))
    return added.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    learnable = common.id_crc() % 7 != 2
    got = lm_score(common.table(spark, sf_dir, "documents"), learnable)
    return got.select("doc_id", (~learnable).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
