"""The data sources: scans of folders against os.walk, and calls over a loopback socket through the log into a stream."""

import json
import os
import random
import re
import socket
import threading

import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from quarry.sources import folders, lines
from quarry.sources.tables import PROJECT_FILES, SKIPPED, scan_files
from quarry.streaming import ingest

SUFFIXES = [".cs"]


def grown(root, seed, depth=4):
    rng = random.Random(seed)
    names = ["a", "b", "Obj", "bin", "node_modules", "object", "Gen", "ü x", "d=1"]

    def grow(folder, left):
        for i in range(rng.randrange(4)):
            (folder / f"f{i}{rng.choice(['.cs', '.CS', '.g.cs', '.txt', ''])}").write_text(str(rng.random()))
        for name in rng.sample(names, rng.randrange(1, 6)) if left else []:
            (folder / name).mkdir()
            grow(folder / name, left - 1)

    grow(root, depth)


def walked(root, exclude=()):
    out = {}
    for folder, below, files in os.walk(root):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        rel = "" if rel == "." else rel + "/"
        below[:] = [b for b in below if b.lower() not in SKIPPED and not any(re.match(e, f"{rel}{b}/") for e in exclude)]
        for f in files:
            if f.lower().endswith(".cs") and not any(re.match(e, rel + f) for e in exclude):
                out[rel + f] = open(f"{folder}/{f}", "rb").read()
    return out


@pytest.mark.parametrize(("seed", "options"), [(0, {}), (1, {"parts": 1}), (2, {"parts": 3}), (3, {"parts": 2, "wide": 1}), (4, {"parts": 500, "wide": 3})])
def test_a_scan_takes_what_a_walk_finds(spark, tmp_path, seed, options):
    grown(tmp_path, seed)
    got = folders.scan_tree(spark, str(tmp_path), SUFFIXES, ["**/gen/", "a/*.g.cs"], content=True, **options).collect()
    want = walked(tmp_path, [r"(?i)(.*/)?gen/", r"(?i)a/[^/]*\.g\.cs"])
    assert len(got) == len(want) and {r.path: bytes(r.content) for r in got} == want
    assert all(r.length == len(r.content) for r in got)


def test_a_scan_agrees_with_the_plain_reader(spark, tmp_path):
    grown(tmp_path, 7)
    plain = scan_files(spark, str(tmp_path), "*.cs").select(F.regexp_replace("path", "^.*?" + re.escape(tmp_path.name) + "/", "").alias("path"), "modificationTime", "length")
    tree = folders.scan_tree(spark, f"file:{tmp_path}", SUFFIXES).where("endswith(path, '.cs')")
    plain = {(r.path, r.modificationTime.replace(microsecond=0), r.length) for r in plain.collect()}
    assert plain and plain == {(r.path, r.modificationTime.replace(microsecond=0), r.length) for r in tree.collect()}


def test_project_files_and_empty_scans(spark, tmp_path):
    for name in ("A.csproj", "Directory.Build.PROPS", "x.sln", "x.slnx", "y.targets", "obj/n.g.props", "z.cs"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("")
    suffixes = ["." + s for s in re.search(r"\{(.*)\}", PROJECT_FILES)[1].split(",")]
    got = folders.scan_tree(spark, str(tmp_path), suffixes, content=True).collect()
    assert {r.path for r in got} == {"A.csproj", "Directory.Build.PROPS", "x.sln", "x.slnx", "y.targets"} and all(bytes(r.content) == b"" for r in got)
    assert folders.scan_tree(spark, str(tmp_path), []).count() == 0
    assert folders.scan_tree(spark, str(tmp_path / "none"), SUFFIXES).count() == 0


def test_links_that_lead_back_aren_t_followed(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "other").mkdir()
    (tmp_path / "a/b/x.cs").write_text("x")
    (tmp_path / "other/y.cs").write_text("y")
    (tmp_path / "a/b/back").symlink_to(tmp_path / "a")
    (tmp_path / "a/side").symlink_to(tmp_path / "other")
    (tmp_path / "a/gone.cs").symlink_to(tmp_path / "nothing")
    (tmp_path / "a/self").symlink_to("self")
    for parts in (1, 16):
        got = sorted(r.path for r in folders.scan_tree(spark, str(tmp_path), SUFFIXES, parts=parts).collect())
        assert got == ["a/b/x.cs", "a/side/y.cs", "other/y.cs"]


def test_what_can_t_be_read_is_skipped_and_what_is_pruned_is_never_listed(tmp_path, monkeypatch):
    for f in ("a/1.cs", "bad/2.cs", "bin/3.cs", "gen/4.cs", "a/bad/5.cs", "6.cs"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text(f)
    listed = []
    plain = pafs.LocalFileSystem()

    class Guarded(pafs.LocalFileSystem):
        def get_file_info(self, selector):
            listed.append(os.path.relpath(selector.base_dir, tmp_path))
            if selector.base_dir.endswith("bad"):
                raise PermissionError(selector.base_dir)
            return plain.get_file_info(selector)

        def open_input_stream(self, path, **kw):
            if path.endswith("6.cs"):
                raise PermissionError(path)
            return plain.open_input_stream(path, **kw)

    monkeypatch.setattr(folders, "opened", lambda uri: (Guarded(), uri))
    for parts in (1, 2, 64):
        reader = folders.TreeReader({"path": str(tmp_path), "suffixes": '[".cs"]', "exclude": '["gen/"]', "content": "true", "parts": str(parts)})
        rows = {r[0]: r[3] for p in reader.partitions() for r in reader.read(p)}
        assert rows == {"a/1.cs": b"a/1.cs", "6.cs": None}
    assert set(listed) == {".", "a", "bad", "a/bad"}


def say(address, line):
    with socket.create_connection(address, timeout=20) as s:
        s.sendall(line if isinstance(line, bytes) else (line + "\n").encode())
        return s.makefile().readline().rstrip("\n")


def call(i, **more):
    return "meter " + json.dumps({"toolName": f"t{i % 3}", "toolUseId": str(i), **more})


def test_answers_and_rows_of_the_socket(spark, tmp_path):
    log = str(tmp_path / "log")
    with lines.Listener(log) as server:
        ask = lambda line: say(server.server_address, line)
        assert ask(call(1, requestTokens=5, responseTokens=7, estimator="chars", agentId="a \n")) == lines.METERED
        assert ask("  " + call(2, requestTokens=None, other=[1]) + " \r") == lines.METERED
        for bad in ('{"toolName": "x"}', '{"toolUseId": "1", "toolName": null}', "null", "{}"):
            assert ask("meter " + bad) == lines.MISSING
        for bad in ("{", "[]", "5", '{"toolName": 5, "toolUseId": "1"}', call(3, requestTokens="9")[6:], call(3, requestTokens=2**31)[6:], call(3, responseTokens=True)[6:], "[" * 100_000):
            assert ask("meter " + bad) == lines.FAILED
        for bad in ("", "meter", "rescan", "METER {}", b"\xff\xfe\n", b"meter " + b" " * lines.LONGEST + b"{}\n"):
            assert ask(bad) == lines.UNKNOWN
    rows = {r.tool_use_id: r[:8] for r in lines.read_calls(spark, log).collect()}
    assert rows == {"1": ("t1", "1", "chars", None, "a \n", None, 5, 7), "2": ("t2", "2", "unknown", None, None, None, 0, 0)}


def drained(spark, log, tmp_path):
    """Runs the stream until it has all; the calls in its table."""
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    ingest.append_log(lines.stream_calls(spark, log), out, marks).awaitTermination()
    return sorted(int(r.tool_use_id) for r in spark.read.schema(lines.SCHEMA).parquet(out).collect())


def files_of(log):
    return sum(f.endswith(".jsonl") for _, _, names in os.walk(log) for f in names)


def test_a_stream_reads_each_call_once_over_restarts_and_two_listeners(spark, tmp_path):
    log = str(tmp_path / "log")
    with lines.Listener(log) as one, lines.Listener(log) as two:

        def send(first, last):
            jobs = [threading.Thread(target=say, args=((one if i % 2 else two).server_address, call(i))) for i in range(first, last)]
            [j.start() for j in jobs]
            [j.join() for j in jobs]

        send(0, 30)
        assert drained(spark, log, tmp_path) == list(range(30))
        assert drained(spark, log, tmp_path) == list(range(30))
        send(30, 50)
        assert drained(spark, log, tmp_path) == list(range(50))
    before = files_of(log)
    with lines.Listener(log) as three:  # a listener that is started again, after the others are gone
        say(three.server_address, call(50))
        say(three.server_address, call(51))
    assert drained(spark, log, tmp_path) == list(range(52))
    assert files_of(log) < before + 2  # what was committed goes


def test_a_batch_that_failed_is_read_again_with_the_same_lines(spark, tmp_path):
    log, marks, seen = str(tmp_path / "log"), str(tmp_path / "marks"), {}
    lines.append_calls(spark.createDataFrame([(call(i)[6:],) for i in range(20)], "value string").repartition(3), log)

    def run(fail):
        def batch(df, number):
            seen.setdefault(number, []).append(sorted(r.line_id for r in df.collect()))
            if fail:
                raise OSError("lost")

        lines.stream_calls(spark, log).writeStream.foreachBatch(batch).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run(True)
    lines.append_calls(spark.createDataFrame([(call(99)[6:],), ("{",), (None,)], "value string"), log)
    run(False)
    assert list(seen) == [0]
    run(False)
    assert len(seen[0]) == 2 and seen[0][0] == seen[0][1] and len(seen[0][0]) == 20
    assert sum(len(ids[-1]) for ids in seen.values()) == 21


def test_a_call_whose_file_is_lost_is_refused_and_nothing_else(tmp_path, monkeypatch):
    log = lines.LineLog(str(tmp_path))
    log.append("1")
    with monkeypatch.context() as m:
        m.setattr(log, "files", None)
        with pytest.raises(AttributeError):
            log.append("2")
    log.append("3")
    texts = [open(f"{log.folder}/{n:012d}.jsonl").read() for n in (0, 1)]
    assert texts == ["1\n", "2\n3\n"] and files_of(tmp_path) == 2


def test_an_empty_log(spark, tmp_path):
    assert lines.read_calls(spark, str(tmp_path / "none")).count() == 0
    assert drained(spark, str(tmp_path / "none"), tmp_path) == []
