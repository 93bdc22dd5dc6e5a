"""Row fixtures for operators that queries don't reach, or only in part."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.functions import scalars
from quarry.operators import graph, incremental, metrics, name_index, ranking, relational, term_index
from quarry.plans import grammar
from quarry.sources import store, tables
from quarry.streaming import ingest


def arcs(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string") if pairs else graph.empty(spark)


def test_diamond_is_expanded_once(spark):
    callers = [("root", "left"), ("root", "right"), ("left", "shared"), ("right", "shared"), ("shared", "a"), ("shared", "b")]
    got = graph.call_tree(arcs(spark, callers), "root", 6)
    assert {r.depth: r.nodes for r in graph.depth_counts(got.reached).collect()} == {0: 1, 1: 2, 2: 1, 3: 2}
    assert sorted(r.repeated for r in got.tree.where("node = 'shared'").collect()) == [False, True] and not got.depth_capped


def test_omitted_callers_are_reached(spark):
    fan = arcs(spark, [("root", x) for x in "abcde"] + [("a", "z")])
    got = graph.call_tree(fan, "root", 2, fan=2)
    assert [(r.node, r.omitted) for r in got.tree.where("omitted > 0").collect()] == [("root", 3)]
    assert {r.depth: r.nodes for r in graph.depth_counts(got.reached).collect()} == {0: 1, 1: 5, 2: 1}
    assert got.omitted == 3 and got.depth_capped
    assert not graph.call_tree(fan, "root", 3).depth_capped and graph.call_tree(fan, "root", 1).depth_capped
    assert graph.call_tree(fan, "root", 5, cap=1).depth_capped
    assert {r.node for r in graph.call_tree(fan, "type", 2, seeds=["a", "b"]).reached.collect()} == {"type", "a", "b", "z"}


def test_a_cycle_ends_its_branch(spark):
    got = graph.call_tree(arcs(spark, [("a", "b"), ("b", "a"), ("b", "c")]), "a", 5)
    assert sorted((r.node, r.depth, r.cycle) for r in got.tree.collect()) == [("a", 0, False), ("a", 2, True), ("b", 1, False), ("c", 2, False)]
    assert not got.depth_capped


def _walked(pairs, root, most, fan):
    """The tree, what is reached, neighbours left out and whether the walk was cut, by all paths."""
    near, shown, reached, lost = {}, set(), set(), []
    for a, b in sorted(set(pairs)):
        near.setdefault(a, []).append(b)

    def walk(parent, node, path, place):
        depth, below = len(place), []
        reached.add((node, depth))
        if depth < most:
            reached.update((x, depth + 1) for x in near.get(node, [])[fan:])
            lost.extend(depth + 1 < most for _ in near.get(node, [])[fan:])
            for k, x in enumerate(near.get(node, [])[:fan], 1):
                below += [(node, x, depth + 1, (*place, k), True, False, 0)] if x in path else walk(node, x, path | {x}, (*place, k))
        elif node in near:
            lost.append(None)
        again = bool(below) and node in shown
        shown.update([node] if below else [])
        return [(parent, node, depth, place, False, again, max(len(near.get(node, [])) - fan, 0) if depth < most else 0), *([] if again else below)]

    rows = walk(None, root, {root}, ())
    return Counter(rows), reached, sum(x is not None for x in lost), any(x is not False for x in lost)


@pytest.mark.parametrize("most", [0, 1, 4])
def test_blast_radius_by_all_paths(spark, most):
    rng = random.Random(most)
    pairs = [(f"n{rng.randrange(7)}", f"n{rng.randrange(7)}") for _ in range(20)]
    got = graph.blast_radius(arcs(spark, pairs), "n0", most).collect()
    assert Counter((r.node, r.depth) for r in got) == Counter(_walked(pairs, "n0", most, len(pairs))[1])


def test_call_tree_stops_at_no_number_of_nodes(spark):
    many = [p for i in range(3000) for p in (("root", f"x{i}"), (f"x{i}", "y"))]
    got = graph.call_tree(arcs(spark, [*many, ("y", "z")]), "root", 4)
    assert {r.depth: r.nodes for r in graph.depth_counts(got.reached).collect()} == {0: 1, 1: 3000, 2: 1, 3: 1}
    assert not got.omitted and not got.depth_capped


@pytest.mark.parametrize("seed", range(2))
def test_call_tree_and_components_by_all_paths(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(rng.choice([8, 14, 22]))]
    fan, most = rng.choice([1, 2, 50]), rng.choice([2, 4, 5])
    got = graph.call_tree(arcs(spark, pairs), "n0", most, fan)
    tree = Counter((r.parent, r.node, r.depth, tuple(r.place), r.cycle, r.repeated, r.omitted) for r in got.tree.collect())
    assert (tree, {(r.node, r.depth) for r in got.reached.collect()}, got.omitted, got.depth_capped) == _walked(pairs, "n0", most, fan)
    reach = {a: {b for x, b in pairs if x == a} for a, _ in pairs}
    for _ in range(9):
        reach = {a: b.union(*(reach.get(x, set()) for x in b)) for a, b in reach.items()}
    want = {tuple(sorted(y for y in reach if y in reach[x] and x in reach[y])) for x in reach if x in reach[x]}
    assert {tuple(r.members) for r in graph.cycles(arcs(spark, pairs)).collect()} == want


def test_diamonds_cost_their_nodes(spark):
    layers = [p for i in range(8) for c in "abcdefgh" for p in ((f"x{i}", f"{c}{i}"), (f"{c}{i}", f"x{i + 1}"))]  # 8^8 paths
    got = graph.call_tree(arcs(spark, [*layers, ("x8", "end")]), "x0", 20)
    rows = got.tree.collect()
    repeated = {tuple(r.place) for r in rows if r.repeated}
    assert len(rows) == 1 + 16 * 8 + 1 and len(repeated) == 7 * 8 and not got.depth_capped
    assert not any(tuple(r.place[:-1]) in repeated for r in rows)


def test_a_loop_within_a_larger_component(spark):
    """s0 has a loop, and becomes part of a run once loops have gone; what leads to s1 lasts until then."""
    pairs = [("s0", "s0"), ("s0", "s1"), ("s1", "s0"), ("a1", "b"), ("a2", "b"), ("b", "c"), ("b2", "c"), ("c", "s1")]
    assert [tuple(r) for r in graph.cycles(arcs(spark, pairs)).collect()] == [("s0", ["s0", "s1"])]


@pytest.mark.parametrize("ring", [False, True])
def test_long_chains_and_rings_take_few_rounds(spark, monkeypatch, ring):
    rounds = []
    closed = graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: rounds.append(1) or closed(df))
    n = 600
    pairs = [(f"{i:05}", f"{(i + 1) % n if ring else i + 1:05}") for i in range(n)]
    found = graph.cycles(arcs(spark, pairs)).collect()
    assert [len(r.members) for r in found] == ([n] if ring else []) and len(rounds) <= 20


def test_rename_chain_doubles(spark, monkeypatch):
    rounds = []
    closed = graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: rounds.append(1) or closed(df))
    got = graph.rename_chain(spark.createDataFrame([(f"{i + 1}", f"{i}") for i in range(600)], "id string, old_id string")).agg(F.count("*"), F.max("depth")).first()
    assert tuple(got) == (600 + 600 * 601 // 2, 600) and len(rounds) <= 11


@pytest.mark.parametrize(("pairs", "found"), [([], []), ([("a", "b"), ("b", "c")], []), ([("a", "a")], [["a"]]), ([("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c")], [["a", "b"], ["c", "d", "e"]])])
def test_cycles(spark, pairs, found):
    assert sorted(r.members for r in graph.cycles(arcs(spark, pairs)).collect()) == found


def test_paths(spark):
    a = arcs(spark, [("start", "middle"), ("middle", "deep"), ("deep", "spin")])
    assert graph.shortest_path(a, "start", "spin").nodes == ["start", "middle", "deep", "spin"]
    miss = graph.shortest_path(a, "spin", "start")
    assert miss.nodes is None and miss.explored == 2
    assert graph.shortest_path(a, "start", "start").nodes == ["start"]
    short = graph.shortest_path(a, "start", "spin", 2)
    assert short.nodes is None and (short.forward, short.backward) == (["deep"], ["spin"])


def test_rename_chain_with_a_cycle(spark):
    renames = spark.createDataFrame([("B", "A"), ("C", "B"), ("A", "C")], "id string, old_id string")
    assert {r.former for r in graph.rename_chain(renames).where("id = 'C'").collect()} == {"A", "B", "C"}


def test_match_cascade_in_three_rounds(spark):
    schema = "id string, key string, name string, position int, signature string"
    old = spark.createDataFrame([("o1", "k1", "n", 1, "s1"), ("o2", "k2", "m", 2, "s2"), ("o3", "k3", "x", 3, "s3"), ("o4", "k4", "y", 4, "s4")], schema)
    new = spark.createDataFrame([("n1", "k1", "n", 1, "s9"), ("n2", "k9", "m", 2, "s8"), ("n3", "k8", "z", 3, "s3"), ("n4", "k7", "w", 4, None)], schema)
    assert {tuple(r) for r in relational.match_cascade(old, new).collect()} == {("o1", "n1", "key"), ("o2", "n2", "name"), ("o3", "n3", "signature")}


def test_nulls_in_keys_equal_each_other(spark):
    schema = "a string, file string, line int"
    old = spark.createDataFrame([("x", None, None)], schema)
    assert tables.insert_absent(old, old, ["a", "file", "line"]).count() == 1


def test_a_scan_without_changes_changes_nothing(spark):
    symbols = spark.createDataFrame([("a", "1"), ("b", "2")], "symbol_id string, digest string")
    edges = spark.createDataFrame([("a", "b", None)], "from_symbol string, to_symbol string, file string")
    got, kept, change = incremental.refresh(symbols, symbols, edges, edges)
    assert got.count() == 2 and kept.count() == 1 and change.where("change <> 'unchanged'").count() == 0


def test_meter_directions_and_shared_calls(spark):
    rows = spark.createDataFrame([("Grep", 40, 900, "chars4"), ("Read", 30, 4000, "chars4")], "tool string, rq long, rs long, est string")
    assert metrics.directions(rows, "rq", "rs", "est").first().asDict() == {"calls": 2, "request": 70, "response": 4900, "estimators": "chars4"}
    assert metrics.directions(rows.limit(0), "rq", "rs", "est").count() == 0
    calls = spark.createDataFrame([("c1", 400)], "tool_call_id string, tokens long")
    got = metrics.patch_totals(calls, calls, "tokens", "tool_call_id", F.lit(True), F.lit(False)).first()
    assert (got.attempts, got.calls, got.tokens) == (1, 0, 0)


def test_files_manifest_log_and_solution(spark, tmp_path):
    (tmp_path / "src" / "bin").mkdir(parents=True)
    for p in ("src/a.cs", "src/bin/b.cs", "src/a.g.cs"):
        (tmp_path / p).write_text("class A {}")
    files = tables.scan_files(spark, str(tmp_path), exclude=["**/*.g.cs"])
    assert [r.path.rsplit("/", 1)[1] for r in files.select("path").collect()] == ["a.cs"]
    tables.save_manifest(files, str(tmp_path / "manifest"))
    assert tables.load_manifest(spark, str(tmp_path / "manifest")).count() == 1
    text = '# Week\n## 2024-01-02 — Title here\n<!-- devlog {"id": "x1", "tags": ["t"], "status": "open"} -->\nBody text\n\n## 2024-01-03 - Bare\n<!-- devlog {broken} -->\nMore\n## No date'
    log = spark.createDataFrame([("logs/w.md", text)], "path string, text string").withColumn("modified", F.lit("2020-02-02").cast("timestamp"))
    first, second, third = tables.parse_log(log).orderBy("position").collect()
    assert (str(first.ts.date()), first.title, first.id, first.tags, first.status) == ("2024-01-02", "Title here", "x1", ["t"], "open")
    assert first.markdown.endswith("Body text")
    assert (str(second.ts.date()), second.title, second.id, second.status) == ("2024-01-03", "Bare", "w#2", "done")
    assert (str(third.ts.date()), third.title, third.id) == ("2020-02-02", "No date", "w#3")
    (tmp_path / "config.json").write_text('{"solution": "a.sln", "excludeGlobs": ["x/**"]}')
    assert tables.load_config(spark, str(tmp_path / "config.json")) == tables.Config("a.sln", exclude_globs=("x/**",))
    (tmp_path / "config.json").write_text("{broken")
    assert tables.load_config(spark, str(tmp_path / "config.json")) == tables.load_config(spark, str(tmp_path / "none.json")) == tables.Config()
    (tmp_path / "s.slnx").write_text('<Solution><Project Path="a/a.csproj" /><Project Path="b/b.csproj" /></Solution>')
    assert [r.path for r in tables.read_solution(spark, str(tmp_path / "s.slnx")).collect()] == ["a/a.csproj", "b/b.csproj"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    own = store.Store(spark, str(tmp_path / "s"), {"t": "k string, v int", "log": "k string, v int"}, append_only={"log"}, session={"log"})
    assert own.read("t").count() == own.version("t") == 0
    own.replace("t", df)
    before = own.read("t")
    own.replace("t", df.where("k = 'a'"))
    assert (before.count(), own.read("t").count(), own.version("t")) == (2, 1, 2)  # readers of the old version keep it
    own.append("log", df)
    own.append("log", df)
    assert own.read("log").count() == 4
    with pytest.raises(PermissionError):
        own.replace("log", df)
    assert own.migrate([(1, "one", lambda s: s.append("t", df))]) == [1] and own.migrate([(1, "one", None)]) == []
    assert own.read("log").count() == 0 and own.read("t").count() == 3
    assert tables.pipe_table(df.orderBy("k"), "rows", 5, 2) == ["rows(2/5) k|v", "a|1", "b|", "…+3 more (raise limit)"]
    assert sorted(r.json for r in tables.as_json(df).collect()) == ['{"k":"a","v":1}', '{"k":"b"}']


def test_stream_counts_each_call_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = '{"tool_name": "Grep", "tool_use_id": "u1", "request": "abcd", "response": "abcdefgh"}\n'
    (tmp_path / "in" / "one.json").write_text(line * 2 + '{"tool_name": "Read"}\n')
    events = ingest.once(ingest.metered(ingest.read_payloads(spark, str(tmp_path / "in"))))
    ingest.append_log(events, str(tmp_path / "log"), str(tmp_path / "checkpoint")).awaitTermination(120)
    got = ingest.by_tool(spark.read.parquet(str(tmp_path / "log"))).collect()
    assert [tuple(r) for r in got] == [("Grep", 1, 2)]


class Crash(Exception):
    pass


@pytest.mark.parametrize("at", ["_write", "_publish"])
def test_a_crash_leaves_the_old_state_and_a_retry_succeeds(spark, tmp_path, monkeypatch, at):
    own = store.Store(spark, str(tmp_path / "s"), {"symbols": "k string", "edges": "k string", "facts": "k string"})
    rows = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    state = lambda: [sorted(r.k for r in own.read(n).collect()) for n in ("symbols", "edges", "facts")]

    def refresh(*k):
        step = own.begin()
        step.replace("symbols", rows(*k))
        step.append("edges", rows(*k))
        step.replace("facts", step.read("facts").unionByName(rows("f")))
        step.commit()

    refresh("a")
    for nth in (1, 2, 3) if at == "_write" else (1,):
        real, calls = getattr(own, at), []

        def broken(*args, real=real, calls=calls, nth=nth):
            calls.append(1)
            if len(calls) == nth:
                raise Crash
            return real(*args)

        monkeypatch.setattr(own, at, broken)
        with pytest.raises(Crash):
            refresh("b", "c")
        monkeypatch.undo()
        assert state() == [["a"], ["a"], ["f"]]
    refresh("b", "c")
    assert state() == [["b", "c"], ["a", "b", "c"], ["f", "f"]]
    assert own.vacuum() >= 2 and state() == [["b", "c"], ["a", "b", "c"], ["f", "f"]] and own.vacuum() == 0


def test_of_two_writers_one_is_refused(spark, tmp_path):
    schemas = {"t": "k string", "log": "k string"}
    own, other = (store.Store(spark, str(tmp_path / "s"), schemas, append_only=x) for x in ({"log"}, set()))
    rows = spark.createDataFrame([("a",)], "k string")
    one, two, three = own.begin(), other.begin(), other.begin()
    one.replace("t", rows)
    two.replace("t", rows.union(rows))
    three.append("log", rows)
    assert one.commit() and three.commit()  # appends to another table don't touch
    with pytest.raises(store.Conflict):
        two.commit()
    assert (own.read("t").count(), other.read("log").count()) == (1, 1)
    with pytest.raises(PermissionError):  # the log holds the guard
        other.replace("log", rows)


def test_a_batch_counts_once(spark, tmp_path):
    own = store.Store(spark, str(tmp_path / "s"), {"t": "k string"})
    rows = spark.createDataFrame([("a",)], "k string")
    for number, fresh in ((0, True), (0, False), (1, True), (0, False)):
        step = own.begin()
        step.append("t", rows)
        assert step.commit(("stream", number)) is fresh
    assert own.read("t").count() == 2


def test_source_selection():
    assert grammar.parse_source("") is grammar.parse_source("code-remarks") is grammar.parse_source("full-exact-compact") is grammar.parse_source("half") is grammar.parse_source("full@5-2") is grammar.parse_source("full@-") is grammar.parse_source("full@") is None
    got = grammar.parse_source("FULL-remarks-typeParams-attributes-lineNumbers@46-76;79;-5")
    assert (got.mode, got.doc_parts, got.attributes, got.comments, got.rendering) == ("full", {"remarks", "typeparam"}, True, False, "compact")
    assert got.ranges == ((46, 76), (79, 79), (None, 5))
    assert grammar.parse_source("@7-").ranges == ((7, None),) and grammar.parse_source("code").mode == "code"


def test_hook_payloads(spark):
    rows = ["", "[1]", "not json", '{"tool_name": 5}', '{"tool_name": "Read", "tool_input": "x", "session_id": 3}', '{"tool_name": "Bash", "tool_input": {"command": "ls"}, "tool_response": [1], "agent_id": "a"}']
    got = tables.parse_hook(spark.createDataFrame([(x,) for x in rows], "value string")).orderBy("tool_name").collect()
    assert [(r.tool_name, r.command, r.tool_input, r.tool_response, r.agent_id, r.session_id) for r in got] == [("Bash", "ls", '{"command":"ls"}', "[1]", "a", None), ("Read", None, None, None, None, None)]


def test_names_with_nested_brackets(spark):
    want = {"A.B.C(D.E f)": "B.C(D.E f)", "N.X<Y.Z<W>, List<A.B>>.Get(int n)": "X<Y.Z<W>, List<A.B>>.Get(int n)", "Q.N.X<Y.Z[]>.Get": "X<Y.Z[]>.Get", "Bare": "Bare", "N.Get": "N.Get"}
    got = spark.createDataFrame([(k,) for k in want], "n string").select("n", scalars.containing(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in got} == want


def test_near_names_of_members(spark):
    names = spark.createDataFrame([("Demo.Normalizer", "source"), ("Demo.Normalizer.Run(System.String)", "source"), ("Lib.Normalizer", "external")], "fq_name string, origin string")
    assert [r.fq_name for r in ranking.near_names(names, "fq_name", "Nrmalizer", 5).collect()] == ["Demo.Normalizer"]
    assert [r.fq_name for r in ranking.near_names(names, "fq_name", "run", 5).collect()] == ["Demo.Normalizer.Run(System.String)"]


def test_excludes_match_how_a_path_begins(spark):
    paths = spark.createDataFrame([("src/gen/a.cs",), ("SRC/gen/b.cs",), ("src/genx.cs",), ("lib/a.cs",)], "path string")
    assert [r.path for r in paths.where(tables.not_excluded(F.col("path"), ["src/gen/"])).orderBy("path").collect()] == ["lib/a.cs", "src/genx.cs"]


def test_grammars():
    assert grammar.parse_filter("a,-b") == (["a"], ["b"])
    assert grammar.subtract([(1, 10)], [(3, 4), (10, 12)]) == [(1, 2), (5, 9)]
    assert grammar.required_layers(["source"]) == ["decl", "body"]
    with pytest.raises(ValueError, match="unknown"):
        grammar.columns("nope", ["a"], ["a"])


def test_search_terms(spark):
    got = spark.range(1).select(scalars.index_terms(F.lit("Demo.HTTPServer2_run")).alias("x"), scalars.query_terms(F.lit("a Get-Name")).alias("y")).first()
    assert got.x == ["demo", "httpserver2", "http", "server2", "run"]
    assert got.y == ["get", "name"]


def test_parameter_types_with_brackets_and_defaults(spark):
    want = {
        "N.P(A.B x, C y)": "B,C", "N.P()": "", "N.P": "", "N2.Part.x(Map<K, V> m, List<T> l, int n)": "Map<K,V>,List<T>,int",
        'N.P(Dictionary<N.K, System.Func<A, B>> d, string s = "x", int n = 3) -> List<A, B>': "Dictionary<K,Func<A,B>>,string,int",
        "P(this A.B x, out C y, (int a, int b) pair, int[,] grid)": "B,outC,(inta,intb),int[,]",
    }
    rows = spark.createDataFrame([(k,) for k in want], "sig string").select("sig", scalars.parameter_types(F.col("sig")).alias("types")).collect()
    assert {r.sig: r.types for r in rows} == want


def test_a_refreshed_index_equals_a_rebuilt_one(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: rng.choice("redwood red reed blue bluebell green greenery".split())
    docs = lambda ids: {i: [word() for _ in range(rng.randrange(5))] for i in ids}
    frame = lambda d: spark.createDataFrame(list(d.items()), "key long, terms array<string>")
    held = docs(range(30))
    own = store.Store(spark, str(tmp_path / "s"), {"symbols": "key long, terms array<string>"})
    index = term_index.TermIndex(own, "i", "long")
    step = own.begin()
    step.replace("symbols", frame(held))
    index.build(step, frame(held))
    step.commit()
    for turn in range(3):
        gone, changed, fresh = rng.sample(sorted(held), 4), docs(rng.sample(sorted(held), 6)), docs(range(100 + 10 * turn, 105 + 10 * turn))
        changed = {k: v for k, v in changed.items() if k not in gone}
        before = {k: held[k] for k in {*gone, *changed}}
        held = {k: v for k, v in held.items() if k not in gone} | changed | fresh
        step = own.begin()
        step.replace("symbols", frame(held))
        index.refresh(step, frame(before), frame(changed | fresh))
        step.commit()
    other = term_index.TermIndex(store.Store(spark, str(tmp_path / "t"), {}), "i", "long")
    assert other.repaired(frame(held)) and not other.repaired(frame(held)) and not index.repaired(own.read("symbols"))

    def state(x):
        near = lambda v: round(v, 9) if isinstance(v, float) else v
        parts = x.store.read(x.terms), x.store.read(x.sums), x.search(["red", "green"]), x.hits(["b", "blueb"])
        return [Counter(tuple(map(near, r)) for r in p.collect()) for p in parts]

    assert state(index) == state(other)
    step = own.begin()
    index.compact(step)
    step.commit()
    assert state(index) == state(other) and own.read(index.dead).count() == 0
    plan = index.search(["red", "green"])._jdf.queryExecution().toString()
    assert "StringStartsWith(term,red)" in plan and "StringStartsWith(term,green)" in plan
    asked = spark.createDataFrame([("blueb",), ("zz",)], "term string")
    assert [r.term for r in index.uncovered(asked).collect()] == ["zz"]


def test_intervals_meet_as_in_a_nested_loop(spark):
    rng = random.Random(7)
    span = lambda: (s := rng.randrange(-500, 500), s + rng.choice([-3, 0, 0, 1, 2, 7, 8, 60, 900]))
    one, two = [(i, *span()) for i in range(60)] + [(90, None, 3)], [(i, *span()) for i in range(50)] + [(91, 3, None)]
    left, right = spark.createDataFrame(one, "a int, s int, e int"), spark.createDataFrame(two, "b int, low long, high long")
    want = Counter((a, b) for a, s, e in one for b, lo, hi in two if None not in (s, e, lo, hi) and s <= e and lo <= hi and s <= hi and lo <= e)
    got = relational.interval_pairs(left, right, ("s", "e"), ("low", "high")).select("a", "b")
    assert Counter(map(tuple, got.collect())) == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert {r.a for r in relational.overlapping(left, right, "a", ("s", "e"), ("low", "high")).collect()} == {a for a, _ in want}
    assert relational.interval_pairs(left.limit(0), right, ("s", "e"), ("low", "high")).count() == 0


def test_names_by_trigrams_equal_a_full_scan(spark, tmp_path):
    rng = random.Random(11)
    names = sorted({"".join(rng.choice("abÀé") for _ in range(rng.randrange(1, 14))) for _ in range(150)} | {f"Module{i}Reader" for i in range(60)} | {"aaaaaaaa", "aaaaaaa"})
    own = store.Store(spark, str(tmp_path / "s"), {})
    index, step = name_index.NameIndex(own, "n"), own.begin()
    index.build(step, spark.createDataFrame([(n, n) for n in names] + [("none", None)], "key string, name string"))
    step.commit()
    edits = lambda a, b: min(3 + 1, _edits(a, b))
    asked = sorted({n[1:5].upper() for n in names} | {n[:2] + n[3:] + "b" for n in names} | {"", "a", "zzzz", "module7reader", "Modle11Raeder"})
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    held = {(q, n) for q in asked for n in names if q.lower() in n.lower()}
    near = {(q, n) for q in asked for n in names if len(q) >= 3 and edits(q.lower(), n.lower()) <= min(max(len(q) // 4, 1), 3)}
    assert {(r.query, r.name) for r in index.holding(queries, 10**6).collect()} == held
    assert {(r.query, r.name) for r in index.near(queries, 10**6).collect()} == near
    either = held | {(q, n) for q, n in near if q not in {x for x, _ in held}}
    assert {(r.query, r.name) for r in index.did_you_mean(queries, 10**6).collect()} == either
    first = index.holding(queries, 1).where("query = 'a'").first()
    assert first.name == min((n for n in names if "a" in n.lower()), key=lambda n: (n != "a", not n.startswith("a"), len(n), n))


def test_near_names_meet_by_few_rare_grams(spark, tmp_path):
    rng = random.Random(5)
    names = sorted({"_".join([rng.choice(["red", "blue", "green"]), rng.choice(["bolt", "gear"]), rng.choice(["STANDARD", "PROMO"])]) + str(i) for i in range(150)})
    own = store.Store(spark, str(tmp_path / "s"), {})
    index, step = name_index.NameIndex(own, "n"), own.begin()
    index.build(step, spark.createDataFrame([(n, n) for n in names], "key string, name string"))
    step.commit()
    asked = sorted({n[:3] + n[4:8] + "q" + n[8:] for n in names})
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    picked = index.near_grams(queries).collect()
    places = {q: sorted(r.at for r in picked if r["query"] == q) for q in asked}
    assert all(len(p) <= 4 and all(b - a >= 3 for a, b in zip(p, p[1:])) for p in places.values())
    assert sum(r.n for r in picked) < len(asked) * len(names) / 4  # before, every query met every name, several times
    assert {(r.query, r.name) for r in index.near(queries, 10**6).collect()} == {(q, n) for q in asked for n in names if _edits(q.lower(), n.lower()) <= min(len(q) // 4, 3)}


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_tokens_know_literals_and_comments(spark):
    want = {
        'x = "http://a b"; // c': ["x", "=", '"http://a b"', ";"], "a/* b\n // */c": ["a", "c"],
        "c = '\"' + '\\'';": ["c", "=", "'\"'", "+", "'\\''", ";"], 'f($"{x} // y", """raw "q" // z""")': ["f", "(", '$"{x} // y"', ",", '"""raw "q" // z"""', ")"], "": [], "a=>b >= c": ["a", "=>", "b", ">=", "c"],
    }
    want |= {'s = @"c:\\"; t // x': ["s", "=", '@"c:\\"', ";", "t"], '@"a""b // c" d': ['@"a""b // c"', "d"]}
    got = spark.createDataFrame([(k,) for k in want], "t string").select("t", scalars.tokens(F.col("t")).alias("x"), scalars.layer_hashes(F.col("t")).alias("h")).collect()
    assert {r.t: r.x for r in got} == want
    assert {r.t for r in got if r.h.body is None} == {"a/* b\n // */c", "", '@"a""b // c" d', 'f($"{x} // y", """raw "q" // z""")'}


def test_sections_of_a_comment(spark):
    xml = "<summary>Uses <c>Foo</c>s of <see cref=\"M:A.B.Of``1(System.Func{A.C})\"/>.</summary><returns> </returns><typeparam name=\"T\">kind</typeparam><exception cref=\"A.Bad\">why</exception><param name=\"p\"><paramref name=\"q\"/> too</param>"
    got = spark.createDataFrame([(1, xml), (2, "no tags"), (3, None), (4, "<inheritdoc cref=\"T:A\" />")], "k int, x string").select("k", scalars.doc_sections(F.col("x")).alias("s")).orderBy("k").collect()
    s = got[0].s
    assert (s.summary, s.returns, s.inheritdoc) == ("Uses Foos of Of.", None, None)
    assert [[tuple(x) for x in y] for y in (s.params, s.type_params, s.exceptions)] == [[("p", "q too")], [("T", "kind")], [("Bad", "why")]]
    assert got[1].s is got[2].s is None and got[3].s.inheritdoc and got[3].s.params is None


def test_disambiguation_counts_candidates_before_they_meet_rows(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "c", "d", None]), rng.choice([0, 1, None]), rng.choice([0, 1, 2])) for i in range(40)] + [(0, "c", 1, 1)]
    found = [(rng.choice(["a", "a", "b", None]), rng.choice([0, 1, None]), rng.choice([0, 1, 2]), k) for k in range(14)] + [("c", 1, 1, 90), ("d", 0, 0, None)]
    want, left = Counter(), [(r, f) for r in rows for f in found if r[1] is not None and r[1] == f[0]]
    for step in (lambda r, f: True, lambda r, f: r[2] == f[1], lambda r, f: r[3] == f[2]):
        left = [(r, f) for r, f in left if step(r, f)]
        n = Counter(r[0] for r, _ in left)
        want += Counter((r[0], f[3]) for r, f in left if n[r[0]] == 1)
        left = [(r, f) for r, f in left if n[r[0]] > 1]
    one, two = spark.createDataFrame(rows, "id int, name string, arity int, size int"), spark.createDataFrame(found, "name string, arity int, size int, hit int")
    got = relational.disambiguate(one, two, ["arity", "size"])
    assert got.columns == ["name", "id", "arity", "size", "hit"]
    assert Counter((r.id, r.hit) for r in got.collect()) == want
    # 4 million pairs of one name never meet: each join takes one row a name or step
    many = relational.disambiguate(spark.range(2000).selectExpr("id", "'x' AS name", "id % 3 AS arity"), spark.range(2000).selectExpr("'x' AS name", "id % 3 AS arity", "id AS hit"), ["arity"])
    open_, joins = [many._jdf.queryExecution().optimizedPlan()], []
    while open_:
        node = open_.pop()
        below = [node.children().apply(k) for k in range(node.children().size())]
        open_ += below
        joins += [below[1].toString().lstrip().startswith("Aggregate")] if node.nodeName() == "Join" else []
    assert joins and all(joins) and many.count() == 0
