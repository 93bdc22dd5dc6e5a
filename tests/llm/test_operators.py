"""Every operator on awkward rows and against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import alignment, attention, bpe, common, components, licenses, line_rules, lm_score, near_dup, neighbours, packing, quality, queries, secrets, toxicity, url_filter

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 700}x{i % 11}" for i in range(20_000))
AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "a b c d e f g h i j"), (6, "a b c d e f g h i j"), (6, "a b c d e f g h i j"), (7, LONG), (8, LONG + " end"),
    (9, "MIT License here. Released under the MIT License."), (10, "Licensed under CC BY-NC 4.0. é日本 ＷＯＲＤ　x  y   z\n\n "), (None, "no id at all"), (12, "<|endoftext|> it's 100%  \x1c odd"), (13, "hello <|endoftext|> world <|endoftext|><|endoftext|>"), (14, "<|endof text|> <|endoftext|"),
]


def rows(spark, texts=AWKWARD):
    """Documents with extra columns, one of a clashing name."""
    data = [(i, t, "en", None if k % 3 == 0 else "s", len(t or ""), float(k), k) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score double, key long").repartition(3)


def labels(spark, n=60):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(n)] + [(1, None, None), (None, 1, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


OPERATORS = {
    "pack": lambda s, d: packing.pack_documents(d), "near": lambda s, d: near_dup.near_duplicates(d), "quality": lambda s, d: quality.quality(d, labels(s)),
    "toxicity": lambda s, d: toxicity.toxicity(d, labels(s)), "license": lambda s, d: licenses.license_scan(d), "lm": lambda s, d: lm_score.lm_score(d, common.id_crc() % 7 != 2, sample=20),
    "lines": lambda s, d: line_rules.line_rules(d), "bpe": lambda s, d: bpe.encode_documents(d, ids=True),
    "secrets": lambda s, d: secrets.secret_scan(d), "alignment": lambda s, d: alignment.align(d, groups=True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_and_empty_tables(spark, name):
    got = OPERATORS[name](spark, rows(spark)).select("doc_id").collect()
    assert Counter(r.doc_id for r in got if name != "pack" or r) >= Counter(i for i, _ in AWKWARD)
    if name != "pack":
        assert len(got) == len(AWKWARD)
    assert OPERATORS[name](spark, rows(spark).limit(0)).count() == 0


def test_without_labels(spark):
    none = labels(spark).limit(0)
    assert {r.score for r in quality.quality(rows(spark), none).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity(rows(spark), none).collect()} == {0.0}
    assert toxicity.without_toxic(rows(spark), none).count() == quality.only_good(rows(spark), none).count() == len(AWKWARD)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t a'sX9\x1c　\x85")), max_size=40), max_size=5))
def test_bpe_is_the_library_s(texts):
    import tiktoken

    vocabulary, index = _vocabulary()
    _, splitter = bpe.coder("test", vocabulary, index, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(vocabulary)}, special_tokens={})
    for text, got in zip(texts, splitter.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode_ordinary(text)


_cache: list = []


def _vocabulary():
    if not _cache:
        found = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
        _cache.append((found, bpe.PerfectHash(found)))
    return _cache[0]


def test_perfect_hash_is_minimal_and_exact():
    vocabulary, index = _vocabulary()
    assert sorted(index.slots) == list(range(len(vocabulary)))
    assert all(index.find(w) == i for i, w in enumerate(vocabulary))
    assert index.find(b"no such token") == -1


def test_bpe_round_trip(spark):
    got = bpe.encode_documents(common.table(spark, DATA, "documents"), ids=True).toPandas().set_index("doc_id")
    for r in common.table(spark, DATA, "documents").collect():
        one = got.loc[r.doc_id]
        assert one.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert one.ids_sha256 == hashlib.sha256(one.ids).hexdigest() and one.n_tokens * 4 == len(one.ids)


def test_long_strings_are_not_remembered():
    memo = bpe.Memo(lambda words: [w.encode() for w in words])
    long = "x" * 10_000
    get = memo.learn({"a", long, "b"})
    assert (get("a"), get(long)) == (b"a", long.encode()) and set(memo.young) == {"a", "b"}
    assert memo.learn({"a", long})(long) == long.encode()


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 10)
    memo = bpe.Memo(lambda words: [w.encode() for w in words])
    for k in range(50):
        memo.learn({f"w{k}", f"w{k + 1}", "always"})
        assert memo.young["always"] == b"always" and len(memo.young) <= 10 and len(memo.old) <= 10


def test_packing_of_the_pipeline_remembers_fewer_words(spark, monkeypatch):
    made = []
    monkeypatch.setattr(packing, "pack_documents", lambda docs, **k: made.append(k))
    corpus_pipeline.pack(spark, rows(spark), DATA)
    splitter = bpe.Splitter(public_tokenizers.PATTERN, packing.TokenizerPieces(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()), made[0]["memo"])
    assert splitter.tokens.most == splitter.cuts.most == corpus_pipeline.MEMO < bpe.MEMO
    monkeypatch.undo()
    few, many = (packing.pack_documents(rows(spark), memo=memo).drop("sequence_id", "offset").orderBy("doc_id", "ids_crc32", "piece", "start").collect() for memo in (3, None))
    assert few == many


def test_counting_of_toxic_words_frees_what_packing_left(spark):
    class Caught:
        sparkSession = spark

        def mapInArrow(self, run, schema):  # noqa: N802
            common.held("words of packing", dict)
            next(iter(run(iter([]))))
            raise InterruptedError

    with pytest.raises(InterruptedError):
        toxicity.row_counts(Caught())
    assert not common._held


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_packing_plan(histogram):
    found, bins = packing.plan(histogram, 64)
    fill: Counter = Counter()
    spans = []
    for size, n in histogram.items():
        at, offset = packing.seats(found, np.full(n, size), np.arange(n))
        for b, o in zip(at.tolist(), offset.tolist(), strict=True):
            fill[b] += size
            spans.append((b, o, o + size))
    assert len(fill) == bins and all(v <= 64 for v in fill.values())
    for b in fill:  # no gaps and no overlaps
        own = sorted(s[1:] for s in spans if s[0] == b)
        assert own[0][0] == 0 and all(x[1] == y[0] for x, y in zip(own, own[1:]))  # noqa: B905
    total = sum(k * v for k, v in histogram.items())
    assert bins >= -(-total // 64)


@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(1, 60))
def test_fullest_is_the_best_subset(items, room):
    counts = Counter(items)
    got = packing.fullest(sorted(counts, reverse=True), counts, room)
    sums = {0}
    for x in items:
        sums |= {s + x for s in sums if s + x <= room}
    assert sum(k * v for k, v in got.items()) == max(sums) and all(v <= counts[k] for k, v in got.items())


def test_packing_whole_documents(spark):
    from tokenizers import Tokenizer

    docs = rows(spark)
    got = packing.pack_documents(docs, capacity=256, with_ids=True).toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in AWKWARD if i is not None}
    for r in got[got.doc_id.notna()].itertuples():
        ids = whole[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32 and len(ids) == r.length <= 256
        assert r.length == 256 or r.piece == 0
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= 256
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) + 1


def brute_groups(texts):
    """The least id reachable for each row, by all pairs."""
    sets, number = [], {}
    for _, t in texts:
        w = words((t or "").translate(LOWER))
        sets.append([number.setdefault(x, len(number)) for x in (set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else ())])  # noqa: B905
    holds = np.zeros((len(texts), len(number)), np.float32)
    for i, x in enumerate(sets):
        holds[i, x] = 1
    size = holds.sum(1)
    shared = holds @ holds.T
    linked = (size[:, None] > 0) & (size > 0) & (100 * shared >= 80 * (size[:, None] + size - shared))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in np.argwhere(np.tril(linked, -1)).tolist():
        root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(texts):
        least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(texts))


def test_near_duplicates_are_all_pairs(spark):
    rng = np.random.RandomState(1)
    base = [f"t{rng.randint(500)}" for _ in range(60)]
    texts = [(i, t) for i, t in AWKWARD if i is not None]
    for i in range(300):  # chains of copies, each a few words from the last
        if i % 5 == 0:
            base = [f"t{rng.randint(500)}" for _ in range(60)]
        base = [w if rng.random_sample() > 0.03 else f"u{rng.randint(500)}" for w in base]
        texts.append((1000 - i, " ".join(base)))
    got = near_dup.near_duplicates(rows(spark, texts)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, 600 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{i: 500 for i in [500, *range(600, 650)]}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("query", "label"), [("op3_quality_classifier", "quality"), ("op4_toxicity", "toxic")])
def test_classifiers_on_held_out_rows(spark, query, label):
    data = "/root/testdata/sf0.01"
    got = queries.QUERIES[query](spark, data).join(common.table(spark, data, "labels"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got[label]).mean() > 0.9
    assert got.score.between(0, 1).all()


def test_license_base_matches_a_plain_scan(spark):
    texts = [*AWKWARD[:10], (20, "apache LICENSE apache license GNU General Public License"), (21, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction")]
    got = {r.doc_id: r for r in licenses.license_scan(rows(spark, texts)).collect()}
    for i, t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        places = [(k, label) for phrase, label in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        assert (got[i].n_words, got[i].n_base) == (len(w), len(places))
        assert got[i].base_labels == ",".join(sorted({label for _, label in places}))
        assert (got[i].first_word, got[i].last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
    assert got[21].labels == "mit" and got[21].base_labels == "" and got[21].score > 0.9


def test_licenses_that_many_files_carry_are_found(spark):
    mit = licenses.TEMPLATES[6][1]
    got = {r.doc_id: r for r in licenses.license_scan(rows(spark, [(1, mit), (2, "x " + mit), (3, "nothing of that kind")])).collect()}
    assert [(got[i].labels, got[i].score) for i in (1, 2, 3)] == [("mit", 1.0), ("mit", 1.0), ("", 0.0)]
    many = [(i, f"n{i} " + (licenses.TEMPLATES[7][1] if i % 3 == 0 else "plain text of no licence")) for i in range(60)]
    assert all(r.labels == ("bsd" if r.doc_id % 3 == 0 else "") for r in licenses.license_scan(rows(spark, many)).collect())


def test_every_notice_of_a_file_is_found(spark):
    notices = [licenses.TEMPLATES[k] for k in (1, 4, 6, 7, 8, 9, 13, 14)]
    # weights by rarity: the last templates' words are seen least, so they alone are among a file's rarest
    texts = [(i, " filler words between ".join(t for _, t, _ in notices[: 1 + i % len(notices)])) for i in range(40)]
    got = {r.doc_id: r.labels for r in licenses.license_scan(rows(spark, texts)).collect()}
    assert all(got[i] == ",".join(sorted({label for label, _, _ in notices[: 1 + i % len(notices)]})) for i, _ in texts)


def test_license_places_equal_a_trial_of_all():
    rng, index = np.random.RandomState(4), licenses.Index()
    index.weigh({k: int(rng.randint(0, 50)) for k in range(len(index.vocabulary))}, 50)
    for trial in range(60):
        parts = []
        for k in rng.choice(len(index.templates), 3):
            own = index.templates[k][1].copy()
            own[rng.rand(len(own)) < rng.choice([0.1, 0.3, 0.5])] = index.vocabulary[rng.randint(len(index.vocabulary))]
            parts += [index.vocabulary[rng.randint(0, len(index.vocabulary), rng.randint(0, 9))], np.delete(own, rng.randint(len(own))) if trial % 2 else own]
        words = np.concatenate(parts)
        want, best = set(), 0.0
        for label, own, keys in index.templates:
            for shift in range(-len(own), len(words) + 1):
                hit = [any(0 <= shift + i + s < len(words) and words[shift + i + s] == w for s in range(-2, 3)) for i, w in enumerate(own)]
                if np.mean(hit) >= licenses.ALIGNED and all(len(licenses.starts(words[max(0, shift - 2) : max(0, shift + len(own) + 2)], k)) for k in keys):
                    want.add(label)
                    best = max(best, float(np.mean(hit)))
        held = np.flatnonzero(index.holders(words, np.zeros(len(words), int), 1)[:, 0])
        assert index.match(words, index.find(words), held) == (want, best)


def test_word_counts_of_language_scores(spark):
    got = lm_score.lm_score(rows(spark), common.id_crc() % 7 != 2, sample=20).toPandas()
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    tokens = [(i, [*words((t or "").translate(LOWER)), None]) for i, t in AWKWARD]
    counts = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((len(t), sum(counts[w] > 0 for w in t), round(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in t), 4)) for _, t in tokens)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got.itertuples()) == want
    assert (got.train_tokens == n).all() and (got.score < 0).all()


def test_repeated_and_null_texts_do_not_flood_the_start(spark):
    texts = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN CAST('hot' AS BINARY) ELSE CAST(concat('text ', id) AS BINARY) END AS text")
    got = [bytes(r.text) for r in lm_score.start_sample(texts, 1000).collect()]
    assert 700 < len(got) < 1400 and len(set(got)) == len(got)
    assert {bytes(r.text) for r in lm_score.start_sample(texts.where("text IS NULL OR text = CAST('hot' AS BINARY)"), 1000).collect()} == {b"", b"hot"}


def test_rare_words_are_counted_by_the_join(spark, monkeypatch):
    before = lm_score.lm_score(rows(spark), F.lit(True), sample=5).toPandas()
    monkeypatch.setattr(lm_score, "FREQUENT", 3)
    after = lm_score.lm_score(rows(spark), F.lit(True), sample=5).toPandas()
    cols = ["n_tokens", "n_known", "base_score"]
    assert np.allclose(before.sort_values(cols)[cols], after.sort_values(cols)[cols])
    # the mixture in a task is that of the join
    assert np.allclose(before.sort_values(cols).score, after.sort_values(cols).score, rtol=1e-3)


def test_mixture_of_counts_and_spelling(spark):
    cases = [(c, x) for c in (None, 0, 1, 7) for x in (None, -0.5, -9.0, -400.0)]
    got = spark.createDataFrame([(k, c, x) for k, (c, x) in enumerate(cases)], "k int, c long, spelt double")
    got = got.select("k", lm_score.mixed(F.col("c"), F.col("spelt"), 50, 0.125).alias("x")).sort("k").collect()
    for r, (c, x) in zip(got, cases, strict=True):
        if x is None:
            assert r.x is None
        else:
            assert np.isclose(r.x, np.log10(0.125) + x if not c else np.log10(0.875 * c / 50 + 0.125 * 10.0**x), rtol=1e-12)
    assert lm_score.weights(0, 0) == [1.0] and all(0 < w < 1 for w in lm_score.weights(9, 9))
    mean = spark.range(1).select(lm_score.averaged([F.lit(-700.0), F.lit(-701.0)]).alias("x")).first().x
    assert np.isclose(mean, -700 + np.log10(1.1 / 2))


def test_language_scores_of_long_words(spark):
    long = "x" * 300 + " " + "=" * 70  # words that the memory of subwords doesn't keep
    got = lm_score.lm_score(rows(spark, [(i, f"{long} word {i} {long}") for i in range(20)]), F.col("doc_id") % 7 != 2, sample=20).toPandas()
    assert len(got) == 20 and np.isfinite(got.score).all() and (got.n_known >= 6).all()


def test_language_scores_of_known_words_beat_the_counts(spark):
    got = lm_score.op6_lm_score(spark, "/root/testdata/sf0.01").toPandas()
    got = got[got.held_out & (got.n_known == got.n_tokens) & (got.n_tokens > 20)]
    assert len(got) and got.score.sum() / got.n_tokens.sum() > got.base_score.sum() / got.n_tokens.sum()


def _small_attention(texts=None):
    rng = np.random.RandomState(8)
    texts = texts or [np.append(rng.randint(0, 300, rng.randint(1, 90)), 300).astype("<u2") for _ in range(40)]
    model = attention.Attention(np.bincount(np.concatenate(texts), minlength=301))
    model.begin(texts)
    model.finish()
    return model, texts


def test_attention_score_is_a_naive_one(monkeypatch):
    monkeypatch.setattr(attention, "STEPS", 30)
    model, texts = _small_attention()
    p = {k: x.astype(float) for k, x in model.p.items()}
    for text, got in zip(texts, model.score(texts), strict=True):
        total = 0.0
        for i, target in enumerate(text.tolist()):
            first = i // attention.SCORED * attention.SCORED
            seen = [model.end if k == 0 else int(text[k - 1]) for k in range(max(0, first - attention.CONTEXT), i + 1)]  # what comes before each place up to this one
            e = p["e"][model.row[seen]]
            back = np.arange(len(seen))[::-1]
            a = np.exp(e[-1] @ p["q"] @ (e @ p["k"]).T / np.sqrt(attention.HEAD) + p["near"][back])
            z = np.concatenate([e[-1], a @ (e @ p["v"]) / a.sum()]) @ p["o"] + p["b"]
            own = model.class_of[target]
            inside = model.counts[model.class_of == own] + 0.1
            total += z[own] - np.log(np.exp(z).sum()) + np.log((model.counts[target] + 0.1) / inside.sum())
        assert abs(total / np.log(10) - got) < 1e-3 * max(1, abs(got))


def test_attention_gradients_are_the_loss_s(monkeypatch):
    monkeypatch.setattr(attention, "STEPS", 5)
    model, texts = _small_attention()
    model.p = {k: x.astype(np.float64) for k, x in model.p.items()}
    batch = model.spans([(t[:-1], k % 2 == 0) for k, t in enumerate(texts) if len(t) > 12])
    loss, g = model.gradients(*batch)
    rng = np.random.RandomState(1)
    for name, x in model.p.items():
        for _ in range(6):
            at = tuple(rng.randint(0, s) for s in x.shape) if name != "e" else (int(rng.choice(batch[0].ravel())), rng.randint(attention.WIDTH))
            keep, step = x[at], 1e-4
            x[at] = keep + step
            more = model.gradients(*batch)[0]
            x[at] = keep - step
            less = model.gradients(*batch)[0]
            x[at] = keep
            assert abs((more - less) / (2 * step) - g[name][at]) < 2e-4, name
    before = model.weights
    model.weights = before
    assert np.allclose(model.weights, before)


def test_attention_scores_stay_finite_and_parts_sum_up(monkeypatch):
    monkeypatch.setattr(attention, "STEPS", 5)
    model, texts = _small_attention()
    batch = model.windows_of(texts)
    whole = model.gradients(*batch)
    monkeypatch.setattr(attention, "BATCH", 7)
    parts = model.gradients(*batch)
    assert abs(whole[0] - parts[0]) < 1e-4 and all(np.allclose(whole[1][k], parts[1][k], atol=1e-5) for k in model.p)
    model.p["o"] *= 1e4  # exponents far above what exp() holds
    model.finish()
    assert np.isfinite(model.score(texts)).all()


def test_rounds_learn_from_every_task(spark):
    text = " ".join(["alpha beta gamma delta epsilon zeta eta theta"] * 40)
    docs = rows(spark, [(i, text + f" own{i}") for i in range(200)])
    got = lm_score.lm_score(docs, F.col("doc_id") % 7 != 2, sample=20).toPandas()
    assert len(got) == 200 and (got.score / got.n_tokens > got.base_score / got.n_tokens).all()  # context tells what comes next


def test_every_training_token_teaches(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "start_sample", None)  # no sample is drawn
    rng = np.random.RandomState(4)
    docs = rows(spark, [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "x" * 80, "delta"], rng.randint(0, 200)))) for i in range(70)] + [(70, None)])
    got = lm_score.lm_score(docs, F.col("doc_id") % 7 != 2, sample=1).toPandas()
    assert len(got) == 71 and np.isfinite(got.score).all()
    ranks = spark.sparkContext.broadcast(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    ids = lm_score.token_ids(docs.select(F.col("text").cast("binary").alias("text")), ranks).repartition(5)
    texts = [np.frombuffer(r.ids, "<u2") for r in ids.collect()]
    model = attention.Attention(np.bincount(np.concatenate(texts), minlength=len(ranks.value) + 1))
    monkeypatch.setattr(lm_score, "CELLS", 500)
    counts = lm_score.context_counts(model, ids)
    want = Counter()
    for t in texts:
        want.update((int(model.row[b]), min(int(model.row[a]), attention.BEFORE - 1)) for a, b in zip([model.end, *t[:-1]], t, strict=True))
    assert {divmod(int(c), attention.BEFORE): int(counts[c]) for c in np.flatnonzero(counts)} == want
    model.cluster(counts)
    assert model.windows_of(texts)[2].sum() == sum(map(len, texts))


def test_shares_after_a_subword_sum_up_and_tell_more(monkeypatch):
    monkeypatch.setattr(attention, "STEPS", 30)
    rng = np.random.RandomState(2)
    after = rng.permutation(300)
    texts = []
    for _ in range(80):
        t = [int(rng.randint(300))]
        for _ in range(40):
            t.append(int(after[t[-1]]) if rng.rand() < 0.8 else int(rng.randint(300)))
        texts.append(np.array([*t, 300], "<u2"))
    learnt, held = texts[:60], texts[60:]
    model, _ = _small_attention(learnt)
    before = model.score(held).sum()
    model.follow(np.bincount(model.contexts(learnt), minlength=(attention.ROWS + 1) * attention.BEFORE))
    assert model.score(held).sum() > before + 100
    for prev in (0, 5, attention.BEFORE + 3):
        shares = np.exp(model.inside(np.arange(301), np.full(301, prev)).astype(float))
        sums = np.bincount(model.class_of, shares)
        assert np.allclose(sums[np.unique(model.class_of)], 1, atol=1e-4)


def test_sparse_steps_are_dense_ones(monkeypatch):
    monkeypatch.setattr(attention, "STEPS", 5)
    model, texts = _small_attention()
    batch = model.windows_of(texts)
    _, g, rows, each = model.sparse_gradients(*batch)
    dense = model.gradients(*batch)[1]
    assert len(rows) == len(np.unique(batch[0])) and np.allclose(dense["e"][rows], each) and np.count_nonzero(np.delete(dense["e"], rows, 0)) == 0
    p = {k: x.copy() for k, x in model.p.items()}
    attention.Adam(p)(dense, 0.01)
    attention.Adam(model.p).learn(model, *batch, rate=0.01)
    assert all(np.allclose(p[k], model.p[k], atol=1e-6) for k in p)
    for scale in (1e3, -1e3):  # exponents of positions far beyond what exp() holds
        model.p["near"][:] = scale
        loss, g = model.gradients(*batch)
        assert np.isfinite(loss) and all(np.isfinite(x).all() for x in g.values())


def test_words_of_a_block_are_those_of_its_texts():
    import tiktoken

    texts = [b"", b" \t a  b\n", b"\x1c\x1dA \x85 ' 's 'S x's'll !?.. 123abc\x0b\x0c\r", None, "\u00e9\u00a0b \u3000 \uff58 \u0130 Ab c".encode(), b"x" * 300 + b" " + b"=" * 70, b"\xff\xfe bad \xc3", b"again b b"]
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
    for part in (pa.array(texts, pa.binary()), pa.array([b"no", *texts], pa.binary())[1:], pa.array([None, b" "], pa.binary())):
        kinds, which, counts = lm_score.block_words(part)
        want = [lm_score.words_of(t or b"") for t in part.to_pylist()]
        assert [kinds[k] for k in which] == [w for t in want for w in t] and counts.tolist() == list(map(len, want))
        ids, many = lm_score.block_ids(lm_score.subwords(ranks), kinds, which, counts, len(ranks))
        each = [[x for w in t for x in coding.encode_ordinary(f" {w.decode(errors='replace')}")] + [len(ranks)] for t in want]
        assert ids.tolist() == [x for t in each for x in t] and many.tolist() == list(map(len, each))
        assert lm_score.openings(ranks)[ids].sum() == sum(counts) + len(counts)  # words are told apart by what opens them


def test_spans_cover_texts_evenly(monkeypatch):
    texts = [[b"w%d" % i for i in range(n)] for n in (0, 1, 39, 40, 41, 500)]
    monkeypatch.setattr(lm_score, "SHARE", 1 - 2.0**-40)
    for t in texts:
        got = lm_score.spans([t])
        assert [w for part, _, _ in got for w in part] == t and [o for _, o, _ in got] == [True] + [False] * (len(got) - 1) and [e for *_, e in got][-1]


def test_near_duplicates_within_a_full_region(spark):
    rng, fresh = np.random.RandomState(6), iter(range(10**6))

    def changed(text, times):
        out = list(text)
        for k in rng.choice(len(out) // 2, times, replace=False) * 2:
            out[k] = f"new{next(fresh)}"
        return out

    base = [f"w{k}" for k in range(400)]
    family = [changed(base, 14) for _ in range(4000)]  # about 0.75 alike
    pairs = {k: 5000 + k for k in range(0, 4000, 10)}
    texts = [(k, " ".join(x)) for k, x in enumerate(family)] + [(twin, " ".join(changed(family[k], 21))) for k, twin in pairs.items()]
    sets = {i: {(a, b) for a, b in zip(t.split(), t.split()[1:], strict=False)} for i, t in texts}
    linked = [(a, b) for a, b in pairs.items() if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(rows(spark, texts)).collect()}
    assert len(linked) > 250 and sum(got[a] == got[b] for a, b in linked) == len(linked)


@pytest.mark.parametrize("partitions", [1, 8, 211])
def test_near_duplicates_of_a_dense_family(spark, partitions):
    rng = np.random.RandomState(11)
    base, texts = [f"w{k}" for k in range(100)], []
    for i in range(1500):  # about as alike as the limit: 1, 4 or 5 words replaced by words of a small pool
        text = list(base)
        for k in rng.choice(100, rng.choice([1, 4, 5, 6]), replace=False):
            text[k] = f"x{rng.randint(400)}"
        texts.append((3 * i, " ".join(text)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(rows(spark, texts)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_groups(texts)


@given(st.integers(0, 10_000), st.booleans())
@settings(max_examples=40, deadline=None)
def test_sets_joined_in_a_task(seed, within):
    rng = np.random.RandomState(seed)
    base = rng.choice(1000, 20, replace=False)
    sets = [np.unique(np.where(rng.rand(20) < rng.choice([0.0, 0.05, 0.3]), rng.randint(0, 1000, 20), base)[: rng.randint(1, 21)]).astype("<u8") for _ in range(30)]
    roots, side = rng.randint(0, 20, 30), rng.randint(0, 2, 30)

    def parts(pairs):
        root = {r: r for r in roots.tolist()}
        for a, b in pairs:
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
        return root

    alike = lambda x, y: 100 * len(set(x.tolist()) & set(y.tolist())) >= 80 * len(set(x.tolist()) | set(y.tolist()))
    want = [(int(roots[i]), int(roots[j])) for i in range(30) for j in range(i) if alike(sets[i], sets[j]) and (within or side[i] != side[j])]
    got = near_dup.joined(roots, side, sets, within)
    assert parts(got) == parts(want) and len(got) < 30


def test_one_of_each_goes_by_rows(spark):
    a, b = "a b c d e f g h", "k l m n o p q r s t"
    texts = [(3, b), (5, a), (5, b), (5, a), (7, None), (7, None), (8, ""), (None, a), (None, "x y z"), (None, "x y z")]
    docs = rows(spark, texts).withColumn("twin", F.lit("own")).withColumn("_twin", F.lit("own too"))
    got = near_dup.one_of_each(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(3, b), (5, a), (7, None), (7, None), (8, ""), (None, "x y z")])
    assert near_dup.one_of_each(docs.limit(0)).count() == 0


def test_neighbours_awkward_and_recall(spark):
    rng = np.random.RandomState(0)
    data = [(i, rng.randn(16).astype("float32").tolist()) for i in range(600)]
    data += [(700 + i, data[0][1]) for i in range(20)] + [(800, None), (801, [0.0] * 16), (802, [float("nan")] * 16), (803, [1.0] * 3), (804, [None] * 16), (None, [1.0] * 16)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = neighbours.nearest(frame, F.col("vec_id") % 50 == 0).toPandas()
    good = {i: np.array(v, "f8") for i, v in data if i is not None and i < 800}
    ids, unit = np.array(list(good)), np.array([v / np.linalg.norm(v) for v in good.values()])
    hit = n = 0
    for q, own in got.groupby("query_id"):
        score = np.round(unit @ unit[list(ids).index(q)], 12)
        score[list(ids).index(q)] = -9
        best = ids[np.lexsort((ids, -score))][:5]
        hit, n = hit + len(set(best) & set(own.vec_id)), n + 5
        assert own["rank"].tolist() == list(range(1, len(own) + 1)) and q not in set(own.vec_id)
    assert hit / n >= 0.9
    zero = got[got.query_id == 0].sort_values("rank")
    assert zero.vec_id.tolist() == [700, 701, 702, 703, 704]
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert neighbours.nearest(frame.limit(2), F.col("vec_id") >= 0).count() == 2


def test_neighbours_of_outliers_are_full(spark):
    rng = np.random.RandomState(5)
    heart = rng.randn(20, 32)
    near = heart[rng.randint(0, 20, 760)] + 0.05 * rng.randn(760, 32)
    data = [(i, v.tolist()) for i, v in enumerate(np.concatenate([near, rng.randn(40, 32)]))]
    got = neighbours.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") >= 740).toPandas()
    assert sorted(got.groupby("query_id")["rank"].max().items()) == [(i, 5) for i in range(740, 800)] and len(got) == 300
    assert got[["query_id", "vec_id"]].drop_duplicates().shape[0] == 300 and (got.query_id != got.vec_id).all()


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.RandomState(2)
    codes = rng.randint(0, 1 << 16, (300, 4)).astype(np.uint16)
    codes[100:] = codes[:200] ^ (1 << rng.randint(0, 16, (200, 4))).astype(np.uint16)
    index = neighbours.Index(codes)
    for q in codes[::17]:
        near = np.array([bin(int.from_bytes((c ^ q).tobytes(), "little")).count("1") for c in codes])
        for radius in (0, 3, 11, 25):
            assert index.within(q, radius).tolist() == np.flatnonzero(near <= radius).tolist()


def test_line_rules_counts(spark):
    texts = [*AWKWARD, (30, "x\ny\nx\n \n\nx"), (31, " ".join("abcdefghij" * 3)), (32, "a # b $ | <c>")]
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in line_rules.line_rules(rows(spark, texts)).collect())
    want = Counter()
    for i, t in texts:
        w, lines, seen, inside = words(t), [x for x in (t or "").split("\n") if words(x)], {}, set()
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        for at in seen.values():
            inside |= {k + j for k in at for j in range(8)} if len(at) > 1 else set()
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside)] += 1
    assert got == want


def test_boilerplate_lines_reject_depleted_documents(spark):
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))  # noqa: E731  digits count as one digit in lines
    filler = lambda i: " ".join(f"own{i if isinstance(i, str) else word(i)}w{word(j)}" for j in range(25))
    notice = " ".join(f"notice{word(j)}" for j in range(30))
    texts = [(i, f"{notice} {i % 10}" + "\n" + ("few own words " + word(i) if i < 60 else filler(i))) for i in range(120)]
    texts += [(500 + i, filler("copy")) for i in range(200)]  # exact copies are one document
    frame = rows(spark, texts).withColumn("source", F.lit("host"))
    kept = {r.doc_id: (r.kept, r.base_failed) for r in line_rules.line_rules(frame).collect()}
    assert all(kept[i] == (False, False) for i in range(60))
    assert all(kept[i] == (True, False) for i in [*range(60, 120), *range(500, 700)])


def test_url_rules_and_models(spark):
    rng = np.random.RandomState(3)
    name = lambda: "".join(rng.choice(list("abcdefgh"), 8))
    urls = [f"http://{name()}.example.net/en/{k}" for k in range(150)] + [f"http://spam-{'xyzw' * 2}{k % 7}.example.com/de/{k}" for k in range(150)]
    odd = [None, "", "no scheme", "http://", "HTTP://A.NET", "http://a.net/x?y#z", "https://Sub.Example.NET/en/1", "http://notexample.net/en/", "http://x.org/fr/?q", "http://org/fr/", "http://x.org/en/", "http://spam-xyzwxyzw9.example.com/en/5", "http://user@example.com/de/#f"]
    frame = spark.createDataFrame([(i, u, None) for i, u in enumerate([*odd, *urls])], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.url_filter(frame).collect()}
    assert len(got) == len(odd) + len(urls)
    for i, u in enumerate([*odd, *urls]):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda x: len(x[0]))[0] if fits else None
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        if fits:
            assert got[i].verdict == dict(fits)[rule]
    assert got[11].verdict == "block" and got[2].verdict in ("allow", "block")
    assert url_filter.url_filter(frame.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.url_filter(frame.where("page_id < 4")).collect()} == {"allow"}


def test_pipeline_stages(spark):
    docs = common.table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == docs.columns and [t for _, t in after.dtypes] == [t for _, t in docs.dtypes], name
        after = common.staged(after)
        assert after.count() <= docs.count() and after.join(docs, "doc_id", "left_anti").count() == 0
        if name == "near_dedup":
            kept = {r[0] for r in brute_groups([(r.doc_id, r.text) for r in docs.collect()]) if r[0] == r[2]}
            assert {r.doc_id for r in after.collect()} == kept
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == docs.count()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = rows(spark)
    for k in ("_score", "_text", "_twin", "twin", "node", "root", "label", "words", "known", "first", "n", "items", "quality", "toxic"):
        docs = docs.withColumn(k, F.lit(k))
    got = stage(spark, docs, DATA)
    assert stage(spark, docs.limit(0), DATA).count() == 0
    if name == "packing":
        assert Counter(r.doc_id for r in got.where("piece = 0").collect()) == Counter(i for i, _ in AWKWARD)
        return
    assert got.columns == docs.columns
    for r in got.collect():
        assert (r.doc_id, r.text) in AWKWARD and r.twin == "twin" and r._score == "_score"
    if name == "near_dedup":
        assert Counter(r.doc_id for r in got.collect()) == Counter(i for i, _ in AWKWARD if i not in (6, 8))


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
@pytest.mark.parametrize("data", [DATA, "/root/testdata/sf0.01"])
def test_queries_equal_their_sql(spark, name, data):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    frame = queries.QUERIES[name](spark, data)
    assert sorted(frame.columns) == sorted(names)
    assert Counter(map(tuple, frame.select(*names).collect())) == Counter(want.fetchall())


def test_votes_are_the_nearest_labelled_rows():
    rng = np.random.RandomState(3)
    matrix, labels_ = np.abs(rng.randn(60, quality.TERMS)).astype(np.float32) * (rng.rand(60, quality.TERMS) < 0.05), rng.randint(0, 2, 60)
    space = quality.Space(matrix.copy(), labels_, 0.3)
    unit = lambda x: x / max(np.linalg.norm(x), 1e-9)
    place = lambda x: unit((unit(x * space.idf) - space.mean) @ space.axes)
    learnt = [place(x) for x in matrix]
    for x, got in zip(matrix[:20] + matrix[20:40], space.score(matrix[:20] + matrix[20:40]), strict=True):
        cosines = [float(place(x) @ y) for y in learnt]
        near = sorted(range(60), key=lambda k: -cosines[k])[: quality.NEIGHBOURS]
        votes = {k: np.exp(quality.SHARP * (cosines[k] - 1)) * (0.3 / labels_.mean() if labels_[k] else 0.7 / (1 - labels_.mean())) for k in near}
        assert abs(sum(v for k, v in votes.items() if labels_[k]) / sum(votes.values()) - got) < 1e-3


def test_unlabelled_risk_is_that_of_all_rows(spark):
    rng = np.random.RandomState(2)
    texts = [(i, " ".join(f"w{rng.randint(40)}" for _ in range(rng.randint(0, 30)))) for i in range(150)]
    docs = spark.createDataFrame([(i, i % 5 == 0, bytearray(t.encode())) for i, t in texts], "doc_id long, known boolean, text binary").repartition(5)
    bucket = lambda w: common.hash_word(w) % toxicity.BUCKETS
    known, every, some, many = toxicity.row_counts(docs.select("known", "text"))
    assert (some, many) == (30, 150)
    for w in (f"w{k}" for k in range(40)):
        assert every[bucket(w)] == sum(w in t.split() for _, t in texts) and known[bucket(w)] == sum(w in t.split() for i, t in texts if i % 5 == 0)
    used = np.unique([bucket(f"w{k}") for k in range(0, 40, 2)])
    w = rng.randn(len(used) + 1)
    loss, g = toxicity.unlabelled_risk(toxicity.word_sets(docs, used), w)

    def risk(w):
        place = {b: k for k, b in enumerate(used.tolist())}
        outs = [toxicity.KEEP * sum(w[place[bucket(x)]] for x in set(t.split()) if bucket(x) in place) + w[-1] for _, t in texts]
        return float(np.mean(np.log1p(np.exp(outs))))

    assert abs(loss - risk(w)) < 1e-6
    for k in range(len(w)):
        step = np.eye(len(w))[k] * 1e-5
        assert abs((risk(w + step) - risk(w - step)) / 2e-5 - g[k]) < 1e-6


def test_every_operator_has_a_query():
    assert [int(k[2:].split("_")[0]) for k in queries.QUERIES] == list(range(1, 11))


def test_one_row_an_id_however_often_it_comes(spark):
    hot = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).cast("binary").alias("words"))
    every = common.one_an_id(hot, "doc_id", "words").collect()
    assert len(every) == 4000 + (7 % 3 == 0) and {bytes(r.words) for r in every if r.doc_id == 7} == {b"w0"}
    for parts in (1, 16):
        some = {r.doc_id for r in common.one_an_id(hot.repartition(parts), "doc_id", "words", 400).collect()}
        assert 300 < len(some) < 500 and len(some) == common.one_an_id(hot, "doc_id", "words", 400).count()
    assert common.one_an_id(hot.where("doc_id = 7"), "doc_id", "words", 5).count() == 1


def test_a_toxic_id_in_a_third_of_all_rows(spark):
    bad = spark.range(300).select(F.when(F.col("id") < 100, F.lit(1)).otherwise(F.col("id") + 1).alias("doc_id"), F.when(F.col("id") < 130, F.concat(F.lit("vile scum rant "), F.col("id").cast("string"))).otherwise(F.concat(F.lit("calm note on gardens "), F.col("id").cast("string"))).alias("text"))
    known = bad.select("doc_id", F.startswith("text", F.lit("vile")).cast("int").alias("toxic"), F.lit(1).alias("quality")).distinct()
    got = toxicity.toxicity(bad, known, ["doc_id", "text"], F.lit(True)).collect()
    assert len(got) == 300
    scores = {kind: [r.score for r in got if r.text.startswith(kind)] for kind in ("vile", "calm")}
    assert min(scores["vile"]) > max(scores["calm"])


def test_equal_cosines_at_the_last_place_count_by_id():
    rng = np.random.RandomState(3)
    few = np.abs(rng.randn(4, quality.TERMS)).astype(np.float32) * (rng.rand(4, quality.TERMS) < 0.05)
    matrix, known = np.repeat(few, 3 * quality.NEIGHBOURS, 0), rng.randint(0, 2, 12 * quality.NEIGHBOURS)
    space = quality.Space(matrix.copy(), known, 0.5)
    space.vectors = np.repeat(space.vectors[:: 3 * quality.NEIGHBOURS], 3 * quality.NEIGHBOURS, 0)
    for i, score in enumerate(space.score(few.copy())):
        first = np.arange(3 * quality.NEIGHBOURS * i, 3 * quality.NEIGHBOURS * i + quality.NEIGHBOURS)
        assert score == pytest.approx((space.weights * known)[first].sum() / space.weights[first].sum(), abs=1e-5)


def test_a_labelled_id_in_a_third_of_all_rows_teaches_once(spark):
    hot = spark.range(300).select(F.when(F.col("id") < 100, F.lit(1)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    known = hot.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    for parts in (1, 7):
        assert len(quality.fit(hot.repartition(parts), known, F.lit(True)).labels) == 201
