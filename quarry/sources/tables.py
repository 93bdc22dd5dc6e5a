"""Reading and writing: Parquet tables, file scans, manifests, Markdown logs, events, and the sinks."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

# Folders that scans leave out, and suffixes of project files.
SKIPPED = ["bin", "obj", "node_modules", ".git", ".vs", "dist"]
PROJECT_FILES = "*.{csproj,props,targets,sln,slnx}"

SCHEMA_VERSION = 1

HOOK = "tool_name string, tool_use_id string, session_id string, agent_id string, agent_type string, request string, response string"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """SRC-6: one Parquet table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def glob_regex(glob: str) -> str:
    """SRC-2: a pattern for how a path begins, whatever its case: **/ any folders, ** anything, * within a folder, ? one character."""
    rules = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "."}
    return "(?i)^" + re.sub(r"\*\*/|\*\*|[*?]|[^*?]+", lambda m: rules.get(m[0]) or re.escape(m[0]), glob.replace("\\", "/"))


def not_excluded(path: Column, globs: list[str]) -> Column:
    return ~F.lit(False) if not globs else ~F.greatest(F.lit(False), *[path.rlike(glob_regex(g)) for g in globs])


def in_skipped_folder(path: Column) -> Column:
    """SRC-3: whether a folder of the path is one that scans leave out."""
    return F.exists(F.split(path, "/"), lambda x: F.lower(x).isin(SKIPPED))


def scan_files(spark: SparkSession, root: str, glob: str = "*.cs", exclude: list[str] | None = None) -> DataFrame:
    """SRC-1, SRC-4: path, modificationTime, length, content below root; build folders and excluded paths (from root on) are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/"
    relative = F.substring(F.col("path"), F.instr("path", base) + len(base), F.length("path"))
    return files.where(~in_skipped_folder(relative) & not_excluded(relative, exclude or []))


def save_manifest(files: DataFrame, path: str) -> None:
    """SRC-5: what a scan saw, stamped with the schema's version."""
    files.select("path", "modificationTime", "length", F.lit(SCHEMA_VERSION).alias("version")).write.mode("overwrite").parquet(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: a saved scan; rows of another version don't count."""
    return spark.read.parquet(path).where(F.col("version") == SCHEMA_VERSION).drop("version")


def parse_log(texts: DataFrame) -> DataFrame:
    """SRC-9: entries of Markdown logs (path, modified, text): a level-two heading each, and what its devlog comment says in JSON.

    Without a comment, or with a malformed one, the id is the file's name and the entry's number, the
    time that of the heading or else the file's, the status done; markdown is the whole entry.
    """
    blocks = texts.select("path", "modified", F.posexplode(F.split("text", r"(?m)^##\s")).alias("position", "block")).where("position > 0")
    blocks = blocks.withColumn("block", F.regexp_replace(F.concat(F.lit("## "), "block"), r"\s+$", ""))
    heading = F.regexp_replace(F.regexp_extract("block", r"^[# ]*([^\r\n]*)", 1), r"\s+$", "")
    meta = F.from_json(F.regexp_extract("block", r"<!--\s*devlog\s*(\{.*?\})\s*-->", 1), "id string, ts timestamp, status string, classes array<string>, domain string, tags array<string>")
    dash = F.when(F.instr("heading", " — ") > 1, " — ").when(F.instr("heading", " - ") > 1, " - ")
    parsed = blocks.select("path", "modified", "position", "block", heading.alias("heading"), meta.alias("meta")).withColumn("dash", dash)
    at = F.instr("heading", F.col("dash"))
    parsed = parsed.withColumn("day", F.when(F.col("dash").isNotNull(), F.trim(F.left("heading", at - 1)))).withColumn("title", F.trim(F.when(F.col("dash").isNotNull(), F.substring(F.col("heading"), at + 3, F.length("heading"))).otherwise(F.col("heading"))))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    none = F.array().cast("array<string>")
    return parsed.select(
        "path", "position", F.coalesce("meta.id", F.concat(stem, F.lit("#"), F.col("position").cast("string"))).alias("id"),
        F.coalesce("meta.ts", F.try_to_timestamp("day"), "modified").alias("ts"), "title", F.coalesce("meta.status", F.lit("done")).alias("status"),
        F.coalesce("meta.classes", none).alias("classes"), "meta.domain", F.coalesce("meta.tags", none).alias("tags"), F.col("block").alias("markdown"),
    )


def read_solution(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: project paths of a solution in XML."""
    return spark.read.format("xml").option("rowTag", "Project").schema("_Path string").load(path).select(F.col("_Path").alias("path"))


def parse_payload(raw: DataFrame, column: str = "value") -> DataFrame:
    """SRC-12, SRC-13: JSON payloads; rows without a tool name and a call id are left out."""
    return raw.select(F.from_json(column, HOOK).alias("p")).select("p.*").where("tool_name IS NOT NULL AND tool_use_id IS NOT NULL")


def parse_hook(raw: DataFrame, column: str = "value") -> DataFrame:
    """SRC-13: hook payloads in JSON with their parts; fields that aren't strings are null. What is no object, or names no tool, is left out."""
    v = F.try_parse_json(column)
    text = lambda path: F.when(F.schema_of_variant(F.variant_get(v, path, "variant")) == "STRING", F.variant_get(v, path, "string"))
    is_object = F.schema_of_variant(F.variant_get(v, "$.tool_input", "variant")).startswith("OBJECT")
    inside = lambda c: F.when(is_object, c)
    names = ["tool_name", "tool_use_id", "session_id", "agent_id", "agent_type"]
    columns = [text(f"$.{n}").alias(n) for n in names]
    columns += [inside(text(f"$.tool_input.{n}")).alias(n) for n in ("file_path", "command")]
    columns += [inside(F.to_json(F.variant_get(v, "$.tool_input", "variant"))).alias("tool_input"), F.to_json(F.variant_get(v, "$.tool_response", "variant")).alias("tool_response")]
    whole = raw.where(F.schema_of_variant(v).startswith("OBJECT"))
    return whole.select(*columns).where("tool_name IS NOT NULL")


@dataclass(frozen=True)
class Config:
    """SRC-14: settings of a repository, and what holds where none are given."""

    solution: str | None = None
    devlog_dir: str = "devlog"
    exclude_globs: tuple[str, ...] = ()
    default_format: str = "toon"


def load_config(spark: SparkSession, path: str) -> Config:
    """SRC-14: the settings in a JSON file; the defaults where there is no file or none that can be read."""
    try:
        raw = json.loads(spark.read.text(path, wholetext=True).first()[0])
        globs = raw.get("excludeGlobs") or []
        return Config(raw.get("solution"), raw.get("devlogDir") or "devlog", tuple(map(str, globs)), raw.get("defaultFormat") or "toon")
    except (AnalysisException, ValueError, AttributeError, TypeError):
        return Config()


def parse_name_status(lines: DataFrame, suffix: str = ".cs") -> DataFrame:
    """SRC-10: lines (value) of a name-status listing: status (its letter), path, former (of renames and copies), of files with the suffix."""
    parts = F.split("value", "\t")
    got = lines.select(F.left(parts[0], F.lit(1)).alias("status"), F.element_at(parts, -1).alias("path"), F.when(F.size(parts) > 2, parts[1]).alias("former"), F.size(parts).alias("_n"))
    return got.where((F.col("_n") > 1) & F.endswith(F.lower("path"), F.lit(suffix))).drop("_n")


def point_lookup(table: DataFrame, key: str, value) -> DataFrame:
    """SRC-7: the row of one key; the filter reaches the scan."""
    return table.where(F.col(key) == value).limit(1)


def batch_lookup(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """SRC-8: rows of many keys, by one join."""
    return ids.select(key).distinct().join(table, key)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-1: old with the rows of new in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-2: old and those rows of new whose keys it lacks; nulls in keys equal each other."""
    fresh = new.dropDuplicates(keys).alias("n")
    same = None
    for k in keys:
        one = F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
        same = one if same is None else same & one
    return old.unionByName(fresh.join(old.select(*keys).alias("o"), same, "left_anti"))


def delete_cascade(symbols: DataFrame, edges: DataFrame, facts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SNK-5: symbols, edges (by either end) and facts without those of gone (symbol_id)."""
    by = lambda df, c: df.join(gone.select(F.col("symbol_id").alias(c)).distinct(), c, "left_anti")
    return by(symbols, "symbol_id"), by(by(edges, "from_symbol"), "to_symbol"), by(facts, "symbol_id")


def as_json(df: DataFrame, pretty: bool = False) -> DataFrame:
    """SNK-8: rows as JSON without nulls."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": str(pretty).lower()}).alias("json"))


def toon_cell(df: DataFrame, column: str) -> Column:
    """SNK-8: one value as TOON writes it: strings that could be read as anything else, or that hold a delimiter, stand in quotes."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if not isinstance(kind, StringType):
        return F.coalesce(F.to_json(c) if isinstance(kind, (ArrayType, MapType, StructType)) else c.cast("string"), F.lit("null"))
    plain = ~c.rlike(r"""^$|^\s|\s$|[,:"\\\[\]{}\x00-\x1f]|^-""") & ~c.rlike(r"^(true|false|null)$") & ~c.rlike(r"^[+]?\d+(\.\d+)?([eE][+-]?\d+)?$")
    quoted = c
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(raw), F.lit(escaped))
    return F.when(c.isNull(), "null").when(plain, c).otherwise(F.concat(F.lit('"'), quoted, F.lit('"')))


def as_toon(df: DataFrame) -> DataFrame:
    """SNK-8: rows as lines of a TOON table; toon_header opens it."""
    return df.select(F.concat(F.lit("  "), F.concat_ws(",", *[toon_cell(df, c) for c in df.columns])).alias("toon"))


def toon_header(df: DataFrame, label: str, rows: int) -> str:
    return f"{label}[{rows}]{{{','.join(df.columns)}}}:"


def smaller_encoding(df: DataFrame, label: str, rows: int) -> DataFrame:
    """SNK-8: encoding and its characters for TOON and JSON, the smaller first."""
    toon = as_toon(df).agg(F.coalesce(F.sum(F.length("toon") + 1), F.lit(0)).alias("n")).select(F.lit("toon").alias("encoding"), (F.col("n") + len(toon_header(df, label, rows))).alias("n"))
    plain = as_json(df).agg(F.coalesce(F.sum(F.length("json") + 1), F.lit(1)).alias("n")).select(F.lit("json").alias("encoding"), (F.col("n") + 1).alias("n"))
    return toon.unionByName(plain).orderBy("n", F.desc("encoding"))


# The header, the line for what is left out and the limit's name, below.
def pipe_table(df: DataFrame, label: str, total: int, limit: int) -> list[str]:
    """SNK-9: a header with counts, rows joined by pipes, and a line for what was left out; limit bounds what is fetched."""
    rows = [r[0] for r in df.limit(limit).select(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])).collect()]
    more = [f"…+{total - len(rows)} more (raise limit)"] if total > len(rows) else []
    return [f"{label}({len(rows)}/{total}) {'|'.join(df.columns)}", *rows, *more]


def padded_union(one: DataFrame, two: DataFrame) -> DataFrame:
    """SNK-10: rows of both with all their columns, null where a side lacks one."""
    return one.unionByName(two, allowMissingColumns=True)
