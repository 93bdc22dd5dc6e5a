"""Files below a folder as a data source: folders are pruned before anything goes down into them."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tables import SKIPPED, glob_regex

#: Entries of a folder above which several tasks share it.
WIDE = 10_000


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI, or of a path that is mounted."""
    if re.match(r"^\w+:/", uri):
        return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if re.match(r"^file:/[^/]", uri) else uri)
    return pafs.LocalFileSystem(), os.path.abspath(uri)


@dataclass(frozen=True)
class Rules:
    """What a scan takes: files by suffix, in any case, and neither skipped folders nor what a glob excludes."""

    suffixes: tuple[str, ...]
    exclude: tuple[str, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "_out", [re.compile(glob_regex(g)) for g in self.exclude])

    def _excluded(self, path: str) -> bool:
        return any(p.match(path) for p in self._out)

    def takes(self, path: str) -> bool:
        return path.lower().endswith(self.suffixes) and not self._excluded(path)

    def enters(self, path: str) -> bool:
        return path.rsplit("/", 1)[-1].lower() not in SKIPPED and not self._excluded(path + "/")


@dataclass
class Part(InputPartition):
    """Folders of one task: with all below them or only their own files, and which share of their entries."""

    folders: list[str]
    deep: bool
    share: int = 0
    shares: int = 1


class TreeReader(DataSourceReader):
    """The driver lists folders level by level until there are enough for the tasks, and keeps names of folders only.

    Files are listed by the tasks. A folder of more than `wide` entries isn't opened up: several tasks list
    it, and each takes the entries whose names' hashes fall to it.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.content = options["path"], options.get("content") == "true"
        self.rules = Rules(tuple(s.lower() for s in json.loads(options.get("suffixes", '[""]'))), tuple(json.loads(options.get("exclude", "[]"))))
        self.parts, self.wide = int(options.get("parts", 64)), int(options.get("wide", WIDE))

    def entries(self, files: pafs.FileSystem, root: str, folder: str) -> list[tuple[str, pafs.FileInfo]]:
        """Path from root on and entry of what a folder holds; nothing where it can't be read."""
        try:
            got = files.get_file_info(pafs.FileSelector(f"{root}/{folder}".rstrip("/") or "/"))
        except OSError:
            return []
        return sorted(((f"{folder}/{e.base_name}".lstrip("/"), e) for e in got), key=lambda pair: pair[0])

    @staticmethod
    def _loop(files: pafs.FileSystem, path: str) -> bool:
        """Whether a link leads back to a folder that it lies in."""
        if not isinstance(files, pafs.LocalFileSystem) or not os.path.islink(path):
            return False
        return (os.path.realpath(os.path.dirname(path)) + "/").startswith(os.path.realpath(path).rstrip("/") + "/")

    def below(self, files: pafs.FileSystem, root: str, got: list[tuple[str, pafs.FileInfo]]) -> list[str]:
        return [p for p, e in got if e.type == pafs.FileType.Directory and self.rules.enters(p) and not self._loop(files, f"{root}/{p}")]

    def partitions(self) -> list[Part]:
        files, root = opened(self.root)
        level, own, wide = [""], [], []
        while level and len(level) < self.parts:
            following: list[str] = []
            for folder in level:
                got = self.entries(files, root, folder)
                if len(got) > self.wide:
                    wide.append(folder)
                else:
                    own.append(folder)
                    following += self.below(files, root, got)
            level = following
        dealt = [Part(level[i :: self.parts], True) for i in range(min(self.parts, len(level)))]
        dealt += [Part(own[i :: self.parts], False) for i in range(min(self.parts, len(own)))]
        return dealt + [Part([f], True, i, self.parts) for f in wide for i in range(self.parts)]

    def read(self, partition: Part) -> Iterator[tuple]:
        files, root = opened(self.root)
        first, waiting = set(partition.folders), list(reversed(partition.folders))
        while waiting:
            folder = waiting.pop()
            got = self.entries(files, root, folder)
            if folder in first:
                got = [(p, e) for p, e in got if crc32(p.encode("utf-8", "surrogatepass")) % partition.shares == partition.share]
            for path, e in got:
                if e.type == pafs.FileType.File and self.rules.takes(path):
                    yield (path, e.mtime, e.size, self._bytes(files, e.path)) if self.content else (path, e.mtime, e.size)
            if partition.deep:
                waiting += reversed(self.below(files, root, got))

    @staticmethod
    def _bytes(files: pafs.FileSystem, path: str) -> bytes | None:
        try:
            with files.open_input_stream(path, compression=None) as f:
                return f.read()
        except OSError:
            return None


class FileTree(DataSource):
    """Files below `path`; options suffixes and exclude (JSON lists), content, parts (tasks) and wide."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "path string, modificationTime timestamp, length long" + (", content binary" if self.options.get("content") == "true" else "")

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def scan_tree(spark: SparkSession, root: str, suffixes: list[str], exclude: list[str] | None = None, content: bool = False, **options: int) -> DataFrame:
    """SRC-1, SRC-4: path (from root on), modificationTime, length and, if asked for, content of the files below root.

    Build folders and excluded ones are never listed. A folder that can't be read, or is gone, counts as
    empty, a file that can't be read has null content; links are followed unless they lead back to a folder
    that they lie in. root is a URI or a path that all executors see. No suffixes: no files.
    """
    spark.dataSource.register(FileTree)
    reader = spark.read.format("file_tree").option("suffixes", json.dumps(suffixes)).option("exclude", json.dumps(exclude or []))
    return reader.option("content", str(content).lower()).options(**options).load(root)
