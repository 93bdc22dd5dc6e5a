"""Small grammars of arguments, parsed to Columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of kinds and what they stand for.
ALIASES = {"class": "Type", "type": "Type", "interface": "Interface", "struct": "Struct", "enum": "Enum", "delegate": "Delegate", "record": "Record", "method": "Method", "property": "Property", "field": "Field", "event": "Event"}


def parse_filter(text: str | None) -> tuple[list[str], list[str]]:
    """FLT-2: a,b,-c: what to include and what to exclude."""
    parts = [p.strip() for p in re.split(r"[,\s]+", text or "") if p.strip(" -")]
    return [p for p in parts if p[0] != "-"], [p[1:] for p in parts if p[0] == "-"]


def kind_filter(kind: Column, text: str | None) -> Column:
    """FLT-1, FLT-3: whatever its case, kind is one of the included; without any, none of the excluded."""
    include, exclude = parse_filter(text)
    if include:
        return F.lower(kind).isin([x.lower() for x in include])
    return ~F.lower(kind).isin([x.lower() for x in exclude]) if exclude else F.lit(True)


def canonical_kind(kind: Column) -> Column:
    """FLT-4: an alias to its kind; others as they are."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in ALIASES.items() for x in p]), F.lower(kind)), kind)


def tag_filter(tags: Column, text: str | None) -> Column:
    """FLT-5, FLT-6: all included tags and none of the excluded, whatever their case; null tags have none."""
    include, exclude = parse_filter(text)
    have = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.lower(x))
    out = F.lit(True)
    for t in include:
        out = out & F.array_contains(have, t.lower())
    for t in exclude:
        out = out & ~F.array_contains(have, t.lower())
    return out


def origin_filter(origin: Column, wanted: str) -> Column:
    """FLT-7: source or external; anything else filters nothing."""
    return origin == wanted if wanted in ("source", "external") else F.lit(True)


def within_path(path: Column, scope: str) -> Column:
    """FLT-8: the path is scope or below it; null is out."""
    return F.coalesce((path == scope) | path.startswith(scope.rstrip("/") + "/"), F.lit(False))


def between_days(ts: Column, since: str | None, until: str | None) -> Column:
    """FLT-9: days, both included, as a half-open range that reaches the scan."""
    out = F.lit(True)
    if since:
        out = out & (ts >= F.lit(since).cast("timestamp"))
    if until:
        out = out & (ts < (F.date_add(F.lit(until).cast("date"), 1)).cast("timestamp"))
    return out


def all_terms(text: Column, query: str) -> Column:
    """FLT-12: every term is in the text, whatever its case."""
    out = F.lit(True)
    for term in query.split():
        out = out & text.ilike(f"%{term}%")
    return out


def log_filter(
    affected_class: str | None = None, domain: str | None = None, tag: str | None = None, status: str | None = None, since: str | None = None, until: str | None = None
) -> Column:
    """FLT-13: log entries (classes, domain, tags, status, ts) by part of a class, by domain, tag and status, whatever their case, and by days, both included."""
    out = between_days(F.col("ts"), since, until)
    if affected_class is not None:
        out = out & F.coalesce(F.exists("classes", lambda c: F.contains(F.lower(c), F.lit(affected_class.lower()))), F.lit(False))
    for column, wanted in (("domain", domain), ("status", status)):
        if wanted is not None:
            out = out & F.coalesce(F.lower(column) == wanted.lower(), F.lit(False))
    if tag is not None:
        out = out & F.coalesce(F.exists("tags", lambda t: F.lower(t) == tag.lower()), F.lit(False))
    return out


def line_ranges(line: Column, text: str, last: int | None = None) -> Column:
    """FLT-16: @46-76;79-83;100-;-5, or single lines."""
    out = F.lit(False)
    for part in text.lstrip("@").split(";"):
        m = re.fullmatch(r"(\d*)(-?)(\d*)", part.strip())
        if not m or not (m[1] or m[3]):
            raise ValueError(f"no range: {part!r}")
        low = int(m[1] or 1)
        out = out | ((line >= low) & (line <= int(m[3])) if m[3] else line >= low if m[2] else line == low)
    return out


def columns(text: str | None, default: list[str], known: list[str], strict: bool = True) -> list[str]:
    """PRJ-1, PRJ-2: a list replaces the default; standard and all stand for lists; unknown names are refused, or left out."""
    if not text:
        return default
    names: list[str] = []
    for x in re.split(r"[,\s]+", text.strip()):
        names += default if x == "standard" else known if x == "all" else [x]
    unknown = [x for x in names if x not in known]
    if unknown and strict:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return list(dict.fromkeys(x for x in names if x in known))


# Layers that a column's content depends on.
LAYERS = {"signature": ["decl"], "members": ["decl", "api"], "source": ["decl", "body"], "facts": ["body"], "references": ["refs"]}


def required_layers(names: list[str]) -> list[str]:
    """PRJ-3: the layers a token is narrowed to for the columns that are shown."""
    return [x for x in ("decl", "body", "refs", "api") if any(x in LAYERS.get(n, []) for n in names)]


# Names of documentation parts that a source selection can leave out, and their elements.
DOC_PARTS = {"summary": "summary", "remarks": "remarks", "returns": "returns", "value": "value", "inheritdoc": "inheritdoc", "params": "param", "typeparams": "typeparam", "exceptions": "exception"}


@dataclass(frozen=True)
class SourceSelection:
    """FN-20: which lines of a declaration are shown: all or code only, less documentation parts, attributes and comments, within ranges (None: the declaration's own end)."""

    mode: str
    doc_parts: frozenset[str] = frozenset()
    attributes: bool = False
    comments: bool = False
    ranges: tuple[tuple[int | None, int | None], ...] = ()
    rendering: str = "automatic"

    def keeps(self, line: Column, kind: Column, doc_part: Column) -> Column:
        """Whether a line is shown: kind is code, attribute, comment or doc; doc_part is the element that a doc line belongs to."""
        out = F.lit(True)
        if self.mode == "code":
            out = out & (kind != "doc")
        elif self.doc_parts:
            out = out & ~F.coalesce((kind == "doc") & doc_part.isin(*self.doc_parts), F.lit(False))
        for name, left_out in (("attribute", self.attributes), ("comment", self.comments)):
            if left_out:
                out = out & (kind != name)
        inside = F.lit(not self.ranges)
        for low, high in self.ranges:
            inside = inside | ((line >= (low or 1)) & (F.lit(True) if high is None else line <= high))
        return out & inside


def parse_ranges(text: str) -> tuple[tuple[int | None, int | None], ...] | None:
    """46-76;79;83-;-5 as ranges; None for anything malformed, empty or upside down."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(";"))):
        m = re.fullmatch(r"(\d*)(-?)(\d*)", part)
        if not m or not (m[1] or m[3]):
            return None
        low, high = int(m[1]) if m[1] else None, int(m[3]) if m[3] else None
        if not m[2]:
            high = low
        if low == 0 or high == 0 or (low and high and high < low):
            return None
        out.append((low, high))
    return tuple(out) or None


def parse_source(text: str) -> SourceSelection | None:
    """FN-20: full or code, less -parts, @ranges; None for what isn't understood. @ranges alone stands for full.

    Documentation parts can only be taken from full; exact and compact (or lineNumbers) exclude each other.
    """
    head, at, tail = text.partition("@")
    ranges = parse_ranges(tail) if at else ()
    mode, rest = (head[:4].lower(), head[4:]) if head else ("full", "")
    if ranges is None or not (head or at) or mode not in ("full", "code") or (rest and rest[0] != "-"):
        return None
    names = [x.lower() for x in rest.split("-") if x]
    renderings = {"exact": "exact", "compact": "compact", "linenumbers": "compact"}
    parts = {x for x in names if x not in renderings and x not in ("attributes", "comments")}
    chosen = {renderings[x] for x in names if x in renderings}
    if not parts <= DOC_PARTS.keys() or (parts and mode == "code") or len(chosen) > 1:
        return None
    return SourceSelection(mode, frozenset(DOC_PARTS[x] for x in parts), "attributes" in names, "comments" in names, ranges, chosen.pop() if chosen else "automatic")


def subtract(ranges: list[tuple[int, int]], without: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Line ranges less other ranges."""
    for a, b in without:
        ranges = [p for low, high in ranges for p in ((low, min(high, a - 1)), (max(low, b + 1), high)) if p[0] <= p[1]]
    return ranges


def task_filter(task: Column, ids: list[str] | None) -> Column:
    """FLT-10."""
    return task.isin(ids) if ids else F.lit(True)


def in_session(events, session: str):
    """FLT-11: readers never look beyond their session."""
    return events.where(F.col("session_id") == session)
