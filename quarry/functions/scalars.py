"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of modifiers, in their order.
MODIFIERS = [("public", "p"), ("internal", "i"), ("protected", "t"), ("private", "x"), ("static", "s"), ("abstract", "a"), ("virtual", "v"), ("override", "o"), ("async", "y"), ("sealed", "l"), ("partial", "g"), ("const", "c"), ("readonly", "d"), ("extension", "e")]
# Levels, least first, and the level that a kind of change asks for (any other: dependent_compile).
LEVELS = ["parse", "semantic_bind", "project_compile", "dependent_compile", "targeted_tests", "solution_validate"]
KIND_LEVEL = {"trivia": 0, "body": 2, "added": 2}
# Words that full-text scores leave out.
STOPWORDS = "the a an and or of to in for on with is are was were it this that we not by as at be from but into than then so no what why how when all its our have has".split()
#: Lines from which a declaration counts as large.
LARGE = 60


def chars4(text: Column) -> Column:
    """FN-1: tokens by characters: a quarter, rounded up; nothing for null."""
    return F.floor((F.coalesce(F.length(text), F.lit(0)) + 3) / 4).cast("long")


def unqualified(name: Column) -> Column:
    """FN-2: what stands after the last dot before any parameters."""
    return F.substring_index(F.substring_index(name, "(", 1), ".", -1)


def containing(name: Column) -> Column:
    """FN-3: the last two parts of a name, and its parameters; dots within brackets, however nested, part nothing."""
    head = F.substring_index(name, "(", 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))

    def step(a: Column, ch: Column) -> Column:
        depth = a["depth"] + F.when(ch.isin("<", "[", "{"), 1).when(ch.isin(">", "]", "}"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.concat(a["text"], F.when((ch == ".") & (depth != 0), "\x01").otherwise(ch)).alias("text"))

    masked = F.aggregate(F.filter(F.split(head, ""), lambda ch: ch != ""), start, step)["text"]
    return F.concat(F.translate(F.substring_index(masked, ".", -2), "\x01", "."), F.substring(name, F.length(head) + 1, F.length(name)))


def _depths(text: Column) -> Column:
    """Characters with the depth of brackets around each."""
    step = lambda a, ch: F.struct((a["depth"] + F.when(ch.isin("(", "<", "[", "{"), 1).when(ch.isin(")", ">", "]", "}"), -1).otherwise(0)).alias("depth"), (a["commas"] + F.when((ch == ",") & (a["depth"] == 1), 1).otherwise(0)).alias("commas"))
    return F.aggregate(F.split(text, ""), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("commas")), step)


def arity(signature: Column) -> Column:
    """FN-4: parameters of a signature; commas inside brackets of a parameter don't count; null without brackets."""
    inside = F.regexp_extract(signature, r"(?s)(\(.*\))", 1)
    empty = F.trim(F.regexp_replace(inside, r"^\(|\)$", "")) == ""
    return F.when(inside == "", None).when(empty, 0).otherwise(_depths(inside)["commas"] + 1)


def _split_top(signature: Column) -> Column:
    """The parameters of the first bracket of a signature, split at commas that no other bracket holds; what follows the bracket is left out."""
    tail = F.when(F.instr(signature, "(") > 0, F.substring(signature, F.instr(signature, "("), F.length(signature))).otherwise("")
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("ended"), F.lit("").alias("text"))

    def step(a: Column, ch: Column) -> Column:
        depth = a["depth"] + F.when(ch.isin("(", "<", "[", "{"), 1).when(ch.isin(")", ">", "]", "}"), -1).otherwise(0)
        ended = a["ended"] | (depth == 0)
        kept = F.when(ended | ((a["depth"] == 0) & (ch == "(")), "").when((ch == ",") & (a["depth"] == 1), "\x01").otherwise(ch)
        return F.struct(depth.alias("depth"), ended.alias("ended"), F.concat(a["text"], kept).alias("text"))

    return F.split(F.aggregate(F.filter(F.split(tail, ""), lambda ch: ch != ""), start, step)["text"], "\x01")


def parameter_types(signature: Column) -> Column:
    """FN-5: types of parameters, joined by commas; names, default values, namespaces, blanks and a leading this off, other modifiers stay with the type."""

    def bare(p: Column) -> Column:
        tokens = F.filter(F.split(F.substring_index(p, "=", 1), r"\s+"), lambda x: x != "")
        tokens = F.when(F.get(tokens, F.lit(0)) == "this", F.slice(tokens, 2, F.size(tokens))).otherwise(tokens)
        tokens = F.when(F.size(tokens) > 1, F.slice(tokens, 1, F.size(tokens) - 1)).otherwise(tokens)
        return F.regexp_replace(F.array_join(tokens, ""), r"[A-Za-z_][A-Za-z0-9_]*\.", "")

    return F.concat_ws(",", F.filter(F.transform(_split_top(signature), bare), lambda x: x != ""))


def compact_name(name: Column) -> Column:
    """FN-6: namespaces of parameter types taken off."""
    at = F.instr(name, "(")
    return F.when(at > 0, F.concat(F.substring_index(name, "(", 1), F.regexp_replace(F.substring(name, at, F.length(name)), r"[\w]+\.", ""))).otherwise(name)


def truncate(text: Column, size: int) -> Column:
    """FN-7: at most size characters, the last an ellipsis where something is cut."""
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.left(text, F.lit(size - 1)), F.lit("…")))


def first_sentence(text: Column, size: int = 120) -> Column:
    """FN-7: up to the first full stop that a space follows; null for blank text."""
    plain = F.trim(text)
    at = F.instr(plain, ". ")
    return F.when(plain == "", None).otherwise(truncate(F.when(at > 1, F.left(plain, at)).otherwise(plain), size))


def code(parts: list[tuple[str, Column]]) -> Column:
    """FN-8: letters with counts above 0, joined by hyphens; null without any."""
    return F.nullif(F.concat_ws("-", *[F.when(n > 0, F.concat(F.lit(k), n.cast("string"))) for k, n in parts]), F.lit(""))


def reference_code(is_type: Column, callers: Column, callees: Column, implementations: Column, overrides: Column, tests: Column) -> Column:
    """FN-9: types always show I; members always show R, others only above 0."""
    rest = code([("E", callees), ("I", implementations), ("V", overrides), ("T", tests)])
    return F.when(is_type, F.concat(F.lit("I"), implementations.cast("string"))).otherwise(F.concat_ws("-", F.concat(F.lit("R"), callers.cast("string")), rest))


def modifier_code(tags: Column) -> Column:
    """FN-10: letters of an array of modifiers, in fixed order; null without any."""
    return F.nullif(F.concat_ws("", *[F.when(F.array_contains(tags, t), F.lit(c)) for t, c in MODIFIERS]), F.lit(""))


def read_advice(intent: str | None, kind: Column, members: Column, lines: Column, landmarks: Column, docs: Column) -> Column:
    """FN-11: how to read a symbol: mem, out, code, or null."""
    lines = F.coalesce(lines, F.lit(0))
    mapped = (F.coalesce(landmarks, F.lit(0)) > 0) & (F.lit(True) if intent is None else lines >= LARGE)
    route = F.when(members > 0, "mem").when(mapped, "out").otherwise("code")
    if intent == "edit":
        return F.when(kind == "Field", None).when(members.isNull(), "out").otherwise("mem")
    if intent == "surface":
        return F.when(members > 0, "mem")
    if intent == "logic":
        return F.when((route == "code") & (docs == 0) & (lines < LARGE), None).otherwise(route)
    return F.when(lines >= LARGE, route)


def _member(cref: Column) -> Column:
    """The bare name that a cref means: what stands after the last dot, without arity and parameters."""
    return F.regexp_extract(cref, r"^(?:[A-Z]:)?(?:[^`(.]*\.)*([^`(.]*)", 1)


def _plain(xml: Column) -> Column:
    """A section's text: names for references, nothing for other tags, blanks as one; null where nothing is left."""
    named = F.regexp_replace(F.replace(xml, F.lit("///"), F.lit(" ")), r'<(?:see\w*|(?:type)?paramref)\s+\w+="(?:[A-Z]:)?(?:[^"`(.]*\.)*([^"`(.]*)[^"]*"\s*/?>', "$1")
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(named, "<[^>]+>", ""), r"\s+", " ")), F.lit(""))


def doc_section(xml: Column, tag: str) -> Column:
    """FN-12: the plain text of one section of an XML comment; null without it."""
    return _plain(F.regexp_extract(xml, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1))


def doc_sections(xml: Column) -> Column:
    """FN-12: all sections of an XML comment as one struct: summary, returns, remarks, value, inheritdoc, params, type_params, exceptions.

    The last three are arrays of structs (name, text) in their order, without empty texts, and null
    where none is left; the struct is null where the comment has no section.
    """

    def listed(tag: str, attribute: str, name) -> Column:
        pattern = F.lit(rf'(?s)<{tag}\s+{attribute}="([^"]+)"\s*>(.*?)</{tag}>')
        both = F.arrays_zip(F.regexp_extract_all(xml, pattern, F.lit(1)).alias("a"), F.regexp_extract_all(xml, pattern, F.lit(2)).alias("b"))
        rows = F.filter(F.transform(both, lambda x: F.struct(name(x["a"]).alias("name"), _plain(x["b"]).alias("text"))), lambda x: x["text"].isNotNull())
        return F.when(F.size(rows) > 0, rows)

    parts = {tag: doc_section(xml, tag) for tag in ("summary", "returns", "remarks", "value")}
    parts["inheritdoc"] = F.when(xml.rlike(r'<inheritdoc(?:\s+cref="[^"]+")?\s*/>'), True)
    parts["params"], parts["type_params"] = listed("param", "name", lambda x: x), listed("typeparam", "name", lambda x: x)
    parts["exceptions"] = listed("exception", "cref", _member)
    some = F.array_contains(F.array(*[c.isNotNull() for c in parts.values()]), True)
    return F.when(some, F.struct(*[c.alias(k) for k, c in parts.items()]))


def line_count(start: Column, end: Column) -> Column:
    """FN-13: lines from start to end, both included; null where they make no sense."""
    return F.when(end >= start, end - start + 1)


def snake(name: Column) -> Column:
    """FN-14: TargetedTests to targeted_tests."""
    return F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", "_"))


def impact(layers: Column, public: Column) -> Column:
    """FN-15: how a change of layers touches others."""
    return F.when(~F.array_contains(layers, "decl"), "non-breaking").when(public, "breaking-public").otherwise("breaking-internal")


def set_hash(items: Column) -> Column:
    """FN-16: an aggregate: 12 hex digits for a set of strings, whatever their order."""
    return F.left(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_set(items))), 256), F.lit(12))


#: What source text is made of, in the order of trial: strings (raw, verbatim, plain), characters, comments, words, signs of two characters, others.
_LEXEMES = "|".join([r'"""(?s:.*?)"""', r'[$]?@[$]?"[^"]*+(?:""[^"]*+)*+"', r'[$]?"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"', r"'(?:\\.|[^'\\\n])[^'\n]*+'", r"//[^\n]*+", r"/\*(?s:.*?)\*/", r"\w+", r"=>|[=!<>]=|&&|\|\||\?\?", r"[^ \t\n\x0B\f\r\w]"])


def tokens(text: Column) -> Column:
    """FN-17: the tokens of source text in order, without blanks and comments; what looks like a comment within a literal is the literal's."""
    every = F.regexp_extract_all(text, F.lit(_LEXEMES), F.lit(0))
    return F.filter(every, lambda x: ~(F.startswith(x, F.lit("//")) | F.startswith(x, F.lit("/*"))))


def _digest(parts: Column) -> Column:
    return F.left(F.sha2(F.array_join(parts, " "), 256), F.lit(12))


def text_hash(text: Column) -> Column:
    """FN-17: 12 hex digits of the tokens of source text; blanks and comments don't change them, anything in a literal does."""
    return _digest(tokens(text))


def layer_hashes(text: Column) -> Column:
    """FN-17: struct decl, body: hashes of a member's tokens before its body and of the body, which is a block, an arrow or an initializer; body is null without one.

    A sign of assignment within parentheses is a default value and opens no body.
    """
    parts = tokens(text)
    at = lambda sign: F.nullif(F.array_position(parts, sign), F.lit(0).cast("long"))
    value = F.when(at("(").isNull() | (at("=") < at("(")), at("="))
    start = F.least(at("{"), at("=>"), value)
    decl = F.when(start.isNull(), parts).otherwise(F.slice(parts, F.lit(1), (start - 1).cast("int")))
    return F.struct(_digest(decl).alias("decl"), F.when(start.isNotNull(), _digest(F.slice(parts, F.coalesce(start, F.lit(1)).cast("int"), F.size(parts)))).alias("body"))


def line_ending(text: Column) -> Column:
    """FN-19: the ending most lines have: crlf or lf."""
    crlf = F.regexp_count(text, F.lit("\r\n"))
    return F.when(2 * crlf > F.regexp_count(text, F.lit("\n")), "crlf").otherwise("lf")


def retarget(text: Column, ending: str) -> Column:
    """FN-19: text with all its lines ended alike."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n", "\r\n" if ending == "crlf" else "\n")


def symbol_id(assembly: Column, doc: Column, prefix: str = "sym_") -> Column:
    """An id from an assembly and a documentation id."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("|", assembly, doc), 256), F.lit(16)))


def required_level(kinds: Column, tested: Column) -> Column:
    """AGG-21: the level (a number of LEVELS) that an array of kinds of change asks for; tests raise compile levels."""
    each = F.transform(kinds, lambda k: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in KIND_LEVEL.items() for x in p]), k), F.lit(3)))
    top = F.coalesce(F.array_max(each), F.lit(0))
    return F.when(tested & (top >= 2), F.greatest(top, F.lit(4))).otherwise(top)


def layers(token: Column) -> Column:
    """A version token such as decl:a|body:b as a map."""
    return F.str_to_map(token, F.lit(r"\|"), F.lit(":"))


def agrees(one: Column, two: Column) -> Column:
    """FLT-14: tokens with a layer in common and no common layer that differs."""
    shared = F.array_intersect(F.map_keys(one), F.map_keys(two))
    return (F.size(shared) > 0) & F.forall(shared, lambda k: F.element_at(one, k) == F.element_at(two, k))


def satisfies(have: Column, want: Column) -> Column:
    """FLT-15: every layer of want is in have with the same hash; an empty want is never satisfied, as nothing was held."""
    return (F.size(want) > 0) & F.forall(F.map_keys(want), lambda k: F.coalesce(F.element_at(have, k) == F.element_at(want, k), F.lit(False)))


def covers(have: Column, names: list[str]) -> Column:
    """FLT-15: have holds all named layers."""
    return F.forall(F.array(*[F.lit(n) for n in names]), lambda k: F.map_contains_key(have, k))


def segments_of_command(command: Column) -> Column:
    """FN-18: a shell command's parts between | ; and &, blanks around them off, empty ones left out.

    Separators in quotes or after a backslash part nothing; in single quotes a backslash is a character like any other.
    """
    start = F.struct(F.lit("").alias("quote"), F.lit(False).alias("escaped"), F.lit("").alias("text"))

    def step(a: Column, ch: Column) -> Column:
        free = ~a["escaped"]
        opens = free & (a["quote"] == "") & ch.isin("'", '"')
        closes = free & (a["quote"] == ch)
        parts = free & (a["quote"] == "") & ch.isin("|", ";", "&")
        quote = F.when(opens, ch).when(closes, "").otherwise(a["quote"])
        escaped = free & (ch == "\\") & (a["quote"] != "'")
        return F.struct(quote.alias("quote"), escaped.alias("escaped"), F.concat(a["text"], F.when(parts, "\x01").otherwise(ch)).alias("text"))

    cut = F.split(F.aggregate(F.filter(F.split(command, ""), lambda ch: ch != ""), start, step)["text"], "\x01")
    return F.filter(F.transform(cut, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def command_name(segment: Column) -> Column:
    """FN-18: the bare name of the command that a segment calls, without quotes, folders and .exe; null without one."""
    first = F.regexp_extract(segment, r"^\s*(\S+)", 1)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(first, "[\"']", ""), r"^.*[/\\]", ""), r"(?i)\.exe$", "")
    return F.nullif(bare, F.lit(""))


def narrow(token: Column, names: list[str]) -> Column:
    """FLT-15: the token with the named layers only."""
    return F.map_filter(token, lambda k, _: k.isin(names))


def segments(name: Column) -> Column:
    """TXT-3: runs of letters and digits."""
    return F.filter(F.split(name, r"[^\p{L}\p{Nd}]+"), lambda x: x != "")


def index_terms(name: Column) -> Column:
    """TXT-1: segments and their camel-case parts, each once whatever its case, in order."""
    camel = r"(?<=[^\p{Lu}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
    both = F.flatten(F.transform(segments(name), lambda s: F.concat(F.array(s), F.split(s, camel))))
    return F.array_distinct(F.transform(both, lambda x: F.lower(x)))


def query_terms(text: Column) -> Column:
    """TXT-2: lower-cased segments of two characters or more; each stands for a prefix."""
    return F.array_distinct(F.filter(F.transform(segments(text), lambda x: F.lower(x)), lambda x: F.length(x) >= 2))


def log_tokens(text: Column) -> Column:
    """TXT-14: words of two characters or more but stopwords."""
    words = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+)"), F.lit(1)), lambda x: F.lower(x))
    return F.filter(words, lambda x: (F.length(x) >= 2) & ~x.isin(STOPWORDS))
