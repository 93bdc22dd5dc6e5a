"""Calls that come in as lines over sockets: a listener, the log that keeps them, and the log as a data source."""

from __future__ import annotations

import json
import socketserver
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .folders import opened

# The command, its answers, the fields of its payload and what holds where one is missing.
METER = "meter "
METERED, MISSING, FAILED, UNKNOWN = "ok:metered", "err:meter payload missing toolName or toolUseId", "err:meter failed", "err:unknown command"
TEXTS = {"toolName": None, "toolUseId": None, "estimator": "unknown", "claudeSessionId": None, "agentId": None, "agentType": None}
NUMBERS = {"requestTokens": 0, "responseTokens": 0}

SCHEMA = "tool_name string, tool_use_id string, estimator string, session_id string, agent_id string, agent_type string, request_tokens int, response_tokens int, line_id string"
#: Bytes of a line; a longer one isn't a command.
LONGEST = 1 << 20
#: Lines that a task writes into a file.
BLOCK = 10_000
#: Files that one task reads at most.
FILES = 256


def measured(payload: str) -> list | None:
    """A payload's fields in the order of SCHEMA; None without a tool name or a call id, ValueError where it is no such object."""
    raw = json.loads(payload)
    if raw is None:
        return None
    if not isinstance(raw, dict):
        raise ValueError("no object")
    out = []
    for fields, kind in ((TEXTS, str), (NUMBERS, int)):
        for name, default in fields.items():
            value = raw.get(name)
            if value is not None and (not isinstance(value, kind) or isinstance(value, bool) or kind is int and not -(2**31) <= value < 2**31):
                raise ValueError(name)
            out.append(default if value is None else value)
    return None if out[0] is None or out[1] is None else out


class LineLog:
    """Numbered files of lines in a folder of this writer's own, so that any number of writers share a log.

    append() returns once the file with the line is there under its name; lines that wait meanwhile go
    into the next file together. If it raises, the line may come in later all the same.
    """

    def __init__(self, folder: str) -> None:
        self.files, root = opened(folder)
        self.folder = f"{root}/{uuid.uuid4().hex}"
        self.files.create_dir(self.folder, recursive=True)
        self._lock, self._writing = threading.Lock(), threading.Lock()
        self._waiting: list[str] = []
        self._count = self._written = self._number = 0

    def _publish(self, lines: list[str]) -> None:
        name = f"{self.folder}/{self._number:012d}"
        with self.files.open_output_stream(f"{name}.part", compression=None) as f:
            f.write("".join(line + "\n" for line in lines).encode())
        self.files.move(f"{name}.part", f"{name}.jsonl")
        self._number += 1

    def extend(self, lines: list[str]) -> None:
        with self._lock:
            self._waiting += lines
            self._count += len(lines)
            mine = self._count
        with self._writing:
            if self._written >= mine:
                return
            with self._lock:
                taken, self._waiting = self._waiting, []
            try:
                self._publish(taken)
            except BaseException:
                with self._lock:
                    self._waiting[:0] = taken
                raise
            self._written += len(taken)

    def append(self, line: str) -> None:
        self.extend([line])


class _Call(socketserver.StreamRequestHandler):
    timeout = 30

    def handle(self) -> None:
        try:
            line = self.rfile.readline(LONGEST + 1)
            self.wfile.write((self.server.answer(line) + "\n").encode())
        except OSError:
            return


class Listener(socketserver.ThreadingTCPServer):
    """SRC-12: takes one line a connection and answers it with one; a call is answered once the log has it.

    Run one or more, on any machines that see the log's folder; streams needn't run meanwhile.
    """

    daemon_threads, allow_reuse_address = True, True

    def __init__(self, folder: str, host: str = "127.0.0.1", port: int = 0) -> None:
        self.log = LineLog(folder)
        super().__init__((host, port), _Call)

    def answer(self, line: bytes) -> str:
        command = line.decode("utf-8", "replace").strip()
        if len(line) > LONGEST or not command.startswith(METER):
            return UNKNOWN
        try:
            fields = measured(command[len(METER) :])
            if fields is None:
                return MISSING
            self.log.append(json.dumps(fields))
            return METERED
        except (ValueError, OSError, RecursionError):
            return FAILED

    def __enter__(self) -> Listener:
        threading.Thread(target=self.serve_forever, kwargs={"poll_interval": 0.05}, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self.shutdown()
        self.server_close()


@dataclass
class Files(InputPartition):
    """Files of one writer: from the first number to below the second."""

    writer: str
    first: int
    last: int


class _Log:
    """A log's offsets: for each writer the number of its next file."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.keep = options["path"], options.get("keep") == "true"

    def numbers(self) -> dict[str, list[int]]:
        files, root = opened(self.path)
        out: dict[str, list[int]] = {}
        for e in files.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
            if e.base_name.endswith(".jsonl"):
                out.setdefault(e.path.rsplit("/", 2)[-2], []).append(int(e.base_name[:-6]))
        return out

    def between(self, start: dict, end: dict) -> list[Files]:
        return [Files(w, a, min(a + FILES, end[w])) for w in sorted(end) for a in range(start.get(w, 0), end[w], FILES)]

    def rows(self, p: Files) -> Iterator[tuple]:
        files, root = opened(self.path)
        for n in range(p.first, p.last):
            with files.open_input_stream(f"{root}/{p.writer}/{n:012d}.jsonl", compression=None) as f:
                for i, line in enumerate(f.read().decode().splitlines()):
                    yield (*json.loads(line), f"{p.writer}:{n}:{i}")


class LogReader(_Log, DataSourceReader):
    def partitions(self) -> list[Files]:
        got = self.numbers()
        return self.between({w: min(n) for w, n in got.items()}, {w: max(n) + 1 for w, n in got.items()}) or [Files("", 0, 0)]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition)


class LogStream(_Log, DataSourceStreamReader):
    """Offsets name whole files, which never change, so a batch that is run again reads the same lines.

    What a stream has committed is removed, but for each writer's last file, by which its offset is known;
    with the option keep nothing is, and several streams may read one log.
    """

    def initialOffset(self) -> dict:
        return {w: min(n) for w, n in self.numbers().items()}

    def latestOffset(self) -> dict:
        return {w: max(n) + 1 for w, n in self.numbers().items()}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.between(start, end)

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        if self.keep:
            return
        files, root = opened(self.path)
        for writer, numbers in self.numbers().items():
            for n in numbers:
                if n < end.get(writer, 0) - 1:
                    files.delete_file(f"{root}/{writer}/{n:012d}.jsonl")


class CallLines(DataSource):
    """A log of calls, as a table or as a stream."""

    @classmethod
    def name(cls) -> str:
        return "call_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(dict(self.options))

    def streamReader(self, schema) -> LogStream:
        return LogStream(dict(self.options))


def append_calls(payloads: DataFrame, folder: str, column: str = "value") -> None:
    """Payloads of a table into a log, each task as a writer of its own; what a listener would refuse is left out.

    A task that is run again writes its lines again, under other line ids.
    """

    def write(rows: Iterator) -> None:
        log, block = LineLog(folder), []
        for (payload,) in rows:
            try:
                fields = measured(payload or "null")
            except (ValueError, RecursionError):
                continue
            if fields is not None:
                block.append(json.dumps(fields))
            if len(block) == BLOCK:
                log.extend(block)
                block = []
        if block:
            log.extend(block)

    payloads.select(column).foreachPartition(write)


def read_calls(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-12: the calls that a log holds."""
    spark.dataSource.register(CallLines)
    return spark.read.format("call_lines").load(folder)


def stream_calls(spark: SparkSession, folder: str, keep: bool = False) -> DataFrame:
    """SRC-12: calls as they come into a log. A client that had no answer may send a call twice: ingest.once keeps one.

    With availableNow Spark reads a Python source in a single batch: after a failure that is the failed batch
    alone, and a further run takes what came in later.
    """
    spark.dataSource.register(CallLines)
    return spark.readStream.format("call_lines").option("keep", str(keep).lower()).load(folder)
