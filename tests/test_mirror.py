"""A stream of changes: batches count once, crashes and restarts lose nothing, the index equals a rebuilt one."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.sources.store import Store
from quarry.streaming.mirror import COLUMNS, Mirror


def made(spark, folder):
    return Mirror(Store(spark, str(folder), {}))


def batches(seed, many=3):
    rng, seq, out = random.Random(seed), 0, []
    for _ in range(many):
        rows = []
        for _ in range(12):
            seq += 1
            d = rng.randrange(3)
            rows.append((f"k{rng.randrange(8)}", seq - rng.choice([0, 0, 9]), f"d{d}", [f"w{d}", f"w{d // 2}"], rng.random() < 0.2))
        out.append([*rows, rows[0], (None, 1, "d", ["x"], False), ("late", None, "d", ["x"], False), ("empty", seq, "d", None, None)])
    return out


def expected(rows):
    """What the changes leave, one after another."""
    now = {}
    for part in rows:
        last = {}
        for key, seq, digest, terms, removed in part:
            if key is not None and seq is not None:
                last[key] = max(last.get(key, (-99,)), (seq, digest, terms or [], bool(removed)))
        for key, c in last.items():
            if key not in now or c[0] > now[key][0]:
                now[key] = c
    return {k: (s, d, t) for k, (s, d, t, gone) in now.items() if not gone}


def check(mirror, want):
    assert {r.key: (r.seq, r.digest, r.terms) for r in mirror.current().collect()} == want
    df = {}
    for _, _, terms in want.values():
        for t in set(terms):
            df[t] = df.get(t, 0) + 1
    assert {r.term: r.df for r in mirror.store.read(mirror.index.terms).collect()} == df
    hits = {(r.key, r.doc_len, r.tf) for r in mirror.index.hits(["w0"]).collect()}
    assert hits == {(k, len(t), t.count("w0")) for k, (_, _, t) in want.items() if "w0" in t}


@pytest.mark.parametrize("seed", [0, 1])
def test_batches_leave_the_last_changes(spark, tmp_path, seed):
    mirror, parts = made(spark, tmp_path), batches(seed)
    for n, rows in enumerate(parts):
        df = spark.createDataFrame(rows, COLUMNS).repartition(2)
        assert mirror.apply(df, n) and not mirror.apply(df, n)
    check(mirror, expected(parts))
    mirror.compact()
    check(mirror, expected(parts))
    assert not mirror.apply(spark.createDataFrame(parts[0], COLUMNS), 0)


def test_an_empty_batch(spark, tmp_path):
    mirror = made(spark, tmp_path)
    assert mirror.apply(spark.createDataFrame([], COLUMNS), 0) and mirror.current().count() == 0
    mirror.apply(spark.createDataFrame([("a", 1, "d", ["w0"], False)], COLUMNS), 1)
    check(mirror, {"a": (1, "d", ["w0"])})


def test_a_stream_goes_on_after_a_crash(spark, tmp_path, monkeypatch):
    source, parts = tmp_path / "in", batches(5)
    source.mkdir()

    def run(mirror):
        changes = spark.readStream.text(str(source)).select(F.from_json("value", COLUMNS).alias("c")).select("c.*")
        mirror.start(changes, str(tmp_path / "checkpoint")).awaitTermination()

    def arrive(n):
        names = ("key", "seq", "digest", "terms", "removed")
        (source / f"part{n}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in parts[n]))

    arrive(0)
    run(made(spark, tmp_path / "store"))
    arrive(1)
    published = Store._publish
    for before in (True, False):  # the commit is lost; the commit is made and the stream doesn't hear of it

        def crash(self, number, state, before=before):
            if not before:
                published(self, number, state)
            raise OSError("lost")

        monkeypatch.setattr(Store, "_publish", crash)
        with pytest.raises(Exception, match="lost"):
            run(made(spark, tmp_path / "store"))
        check(made(spark, tmp_path / "store"), expected(parts[: 1 if before else 2]))
    monkeypatch.setattr(Store, "_publish", published)
    run(made(spark, tmp_path / "store"))
    arrive(2)
    run(made(spark, tmp_path / "store"))
    mirror = made(spark, tmp_path / "store")
    check(mirror, expected(parts))
    assert mirror.store.version(mirror.log) == 3
