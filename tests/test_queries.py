"""Every query of the library against its SQL on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from quarry.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(rows, order):
    near = lambda v: round(v, 6) if isinstance(v, float) else v
    return Counter(tuple(near(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows_as_sql(spark, sql, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sql.execute(registry.ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    assert plain(df.collect(), cols) == plain(got.fetchall(), [names.index(c) for c in cols])


def test_blast_radius_beyond_cap_and_fan(spark, tmp_path):
    """More nodes than a call tree's cap, and more callers of one node than the SQL opens."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i::BIGINT AS s_suppkey, (i % 3)::INTEGER AS s_nationkey, (i % 7 - 3)::DOUBLE AS s_acctbal FROM range(9000) r(i)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet')")
    got = registry.QUERIES["agg_23_blast_radius"](spark, str(tmp_path)).select("depth", "nodes").collect()
    assert Counter(map(tuple, got)) == Counter(con.execute(registry.ORACLE["agg_23_blast_radius"]).fetchall())


def test_blast_radius_follows_every_caller(spark, tmp_path):
    """3,000 callers of one node: query and SQL have what calls each of them, by a walk along all paths."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i::BIGINT AS s_suppkey, (i % 3)::INTEGER AS s_nationkey, (i % 7 - 3)::DOUBLE AS s_acctbal FROM range(9000) r(i)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet')")
    callers = {}
    for i in range(9000):
        callers.setdefault(f"n{i % 3}", []).append(f"s{i}")
        callers.setdefault(f"s{(2 * i + 1) % 9000 if i % 7 >= 3 else i // 2}", []).append(f"s{i}")
    paths, want = [("n1",)], {0: 1}
    for depth in range(1, 5):
        paths = [(*p, x) for p in paths for x in callers.get(p[-1], []) if x not in p]
        want[depth] = len({p[-1] for p in paths})
    got = registry.QUERIES["agg_23_blast_radius"](spark, str(tmp_path)).select("depth", "nodes").collect()
    assert dict(map(tuple, got)) == want == dict(con.execute(registry.ORACLE["agg_23_blast_radius"]).fetchall())
