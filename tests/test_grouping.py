"""Merged sites, root causes, hoisted columns, nested groups and representative cycles on small rows."""

import random
from collections import Counter

import pytest

from quarry.operators import graph, grouping

HITS = "pos long, ns string, file string, kind string, line int, content struct<a: string, b: int>"
ROWS = [
    (5, "n1", "f1", "method", 3, ("x", 1)), (1, "n2", "f1", "class", None, ("x", 2)), (2, "n2", "f1", "class", None, ("x", 3)), (3, "n1", "f2", "method", 4, None),
    (4, "n1", "f2", "method", 4, ("y", 4)), (6, None, "f3", None, None, (None, 5)), (7, None, "f3", None, 9, (None, 6)), (8, "n3", "f1", None, 1, None), (9, "n3", "f1", "enum", 1, None),
]


def hits(spark, rows=ROWS):
    return spark.createDataFrame(rows, HITS).repartition(3)


@pytest.mark.parametrize("keys", [["ns", "file"], ["ns"], []])
@pytest.mark.parametrize("rows", [ROWS, ROWS + ROWS, ROWS[1:3], ROWS[:1], []])
@pytest.mark.parametrize("least", [1, 2])
def test_hoisted_and_rest_are_the_rows(spark, keys, rows, least):
    got = grouping.hoisted(hits(spark, rows), keys, ["kind", "line", "content"], least)
    assert Counter(grouping.restored(got).collect()) == Counter(hits(spark, rows).collect())


def test_what_is_hoisted(spark):
    got = grouping.hoisted(hits(spark), ["ns", "file"], ["kind", "line", "content"])
    shared = {(r.ns, r.file): r for r in got.shared.collect()}
    assert shared["n2", "f1"].hoisted == ["kind", "line", "content.a"] and shared["n2", "f1"].content == ("x", None) and shared["n2", "f1"].kind == "class"
    assert shared[None, "f3"].hoisted == ["kind", "content.a"] and shared["n3", "f1"].hoisted == ["line", "content"] and shared["n1", "f1"].hoisted == ["kind", "line", "content"]
    rest = {r.pos: r for r in got.rest.collect()}
    assert rest[1].kind is None and rest[1].content == (None, 2) and rest[9].kind == "enum" and rest[9].line is None and rest[4].content == ("y", 4)


def test_groups_are_in_first_seen_order(spark):
    got = grouping.grouped(hits(spark), "ns", "file", "pos", ["kind", "line"])
    rows = sorted(grouping.tree(got).collect(), key=lambda r: r.outer_at)
    assert [(r.ns, [(x.file, x["at"], x.kind, [y.pos for y in x.rows]) for x in r.leaves]) for r in rows] == [
        ("n2", [("f1", 1, "class", [1, 2])]), ("n1", [("f2", 3, "method", [3, 4]), ("f1", 5, "method", [5])]), (None, [("f3", 6, None, [6, 7])]), ("n3", [("f1", 8, None, [8, 9])]),
    ]
    assert got.header.first().asDict() == {"groups": 4, "leaves": 5, "flat": False, "ns": None, "file": None}
    one = grouping.grouped(hits(spark, ROWS[1:3]), "ns", "file", "pos", ["kind"]).header.first()
    assert one.flat and (one.ns, one.file) == ("n2", "f1")
    assert tuple(grouping.grouped(hits(spark, []), "ns", "file", "pos", ["kind"]).header.first()) == (0, 0, False, None, None)


def test_merged_sites_keep_the_first_row(spark):
    rows = [("a", 2, "later", "f", 1, True), ("a", 1, "first", "f", 1, None), ("a", 3, "last", "g", None, False), ("b", 4, "none", None, None, None), (None, 5, "null", "h", 2, False)]
    got = grouping.merged(spark.createDataFrame(rows, "id string, pos int, text string, file string, line int, direct boolean"), ["id"], "pos", ["file", "line"], ["direct"])
    assert {tuple(r) for r in got.groups.collect()} == {("a", 1, "first", True, 2), ("b", 4, "none", False, 0), (None, 5, "null", False, 1)}
    assert {tuple(r) for r in got.sites.collect()} == {("a", "f", 1, 1), ("a", "g", None, 3), (None, "h", 2, 5)}


def test_root_causes(spark):
    kind = "id string, position int, message string, file string, line int, symbol string"
    rows = [("E1", 4, "four", "f", 9, "s2"), ("E1", 1, "one", "f", 9, "s1"), ("E1", 2, "two", "g", 1, "s1"), ("E1", 3, "three", "f", 2, None), ("E1", 6, "six", "a", 1, "s1"), ("E2", 5, "five", None, None, None), ("E2", 7, "seven", "", 1, None)]
    changed = [("c2", 2), ("c1", 1)]
    got = grouping.distilled(spark.createDataFrame(rows, kind), spark.createDataFrame(changed, "symbol string, position int"))
    assert {tuple(r) for r in got.causes.collect()} == {("E1", 5, "one", "s1", "diagnostic origin", 2, 3), ("E2", 2, "five", "c1", "changed by this patch", 2, 0)}
    assert {tuple(r) for r in got.sites.collect()} == {("E1", "f", 9, 1), ("E1", "g", 1, 2), ("E1", "f", 2, 3)}
    assert {tuple(r) for r in got.inspections.collect()} == {("E1", "s1", 1), ("E1", "s2", 4)} and tuple(got.totals.first()) == (7, 2, 5)
    none = grouping.distilled(spark.createDataFrame(rows, kind), spark.createDataFrame([], "symbol string, position int"))
    assert [r.id for r in none.causes.collect()] == ["E1"] and tuple(none.totals.first()) == (7, 1, 6)


def shown(spark, pairs):
    found = graph.representative_cycles(spark.createDataFrame(pairs, "source string, target string")).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.component, r.position)):
        assert r.position == len(out.setdefault(r.component, []))
        out[r.component].append(r.node)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_representative_cycles_are_arcs(spark, seed):
    rng = random.Random(seed)
    pairs = list({(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(rng.choice([9, 16, 26]))})
    got = shown(spark, pairs)
    members = {r.component: r.members for r in graph.cycles(spark.createDataFrame(pairs, "source string, target string")).collect()}
    assert set(got) == set(members)
    for component, nodes in got.items():
        assert len(set(nodes)) == len(nodes) and nodes[0] == min(nodes) and set(nodes) <= set(members[component])
        assert all(p in pairs for p in zip(nodes, [*nodes[1:], nodes[0]], strict=True))


def test_representative_of_a_long_ring_takes_few_rounds(spark, monkeypatch):
    rounds = []
    closed = graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: rounds.append(1) or closed(df))
    n = 300
    assert shown(spark, [(f"{i:05}", f"{(i + 1) % n:05}") for i in range(n)]) == {"00000": [f"{i:05}" for i in range(n)]} and len(rounds) <= 60
