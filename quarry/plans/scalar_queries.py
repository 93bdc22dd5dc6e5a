"""Scalar functions over part, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from . import grammar
from .registry import query

_SIG = "'N' || (p_size % 3) || '.' || CASE p_size % 3 WHEN 2 THEN 'Box<X.Y<Z.W>, E.F[]>' ELSE 'Part' END || '.' || replace(p_name, ' ', '') || '(' || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'A.B x, C y' ELSE 'Map<K, V> m, List<T> l, int n' END || ')'"


def _signed(t):
    args = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "A.B x, C y").otherwise("Map<K, V> m, List<T> l, int n")
    return t.part.withColumn("sig", F.concat(F.lit("N"), F.col("p_size") % 3, F.lit("."), F.when(F.col("p_size") % 3 == 2, "Box<X.Y<Z.W>, E.F[]>").otherwise("Part"), F.lit("."), F.regexp_replace("p_name", " ", ""), F.lit("("), args, F.lit(")")))


@query("fn_02_unqualified", "SELECT p_partkey, replace(p_name, ' ', '') AS name FROM part")
def _(t):
    return _signed(t).select("p_partkey", scalars.unqualified(F.col("sig")).alias("name"))


@query("fn_03_containing", f"SELECT p_partkey, substr({_SIG}, 4) AS name FROM part")
def _(t):
    return _signed(t).select("p_partkey", scalars.containing(F.col("sig")).alias("name"))


@query("fn_04_arity", "SELECT p_partkey, CAST(CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END AS INTEGER) AS arity FROM part")
def _(t):
    return _signed(t).select("p_partkey", scalars.arity(F.col("sig")).alias("arity"))


@query("fn_05_parameter_types", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'B,C' ELSE 'Map<K,V>,List<T>,int' END AS types FROM part")
def _(t):
    return _signed(t).select("p_partkey", scalars.parameter_types(F.col("sig")).alias("types"))


@query("fn_06_compact_name", f"SELECT p_partkey, replace({_SIG}, 'A.B', 'B') AS name FROM part")
def _(t):
    return _signed(t).select("p_partkey", scalars.compact_name(F.col("sig")).alias("name"))


@query("fn_07_first_sentence", """
WITH s AS (SELECT doc_id, trim(text) AS t FROM documents), c AS (SELECT doc_id, CASE WHEN instr(t, '. ') > 1 THEN left(t, instr(t, '. ')) ELSE t END AS t FROM s)
SELECT doc_id, CASE WHEN t = '' THEN NULL WHEN length(t) <= 120 THEN t ELSE left(t, 119) || '…' END AS summary FROM c""")
def _(t):
    return t.documents.select("doc_id", scalars.first_sentence(F.col("text")).alias("summary"))


@query("fn_08_shape_code", "SELECT p_partkey, nullif(concat_ws('-', CASE WHEN p_size % 4 > 0 THEN 'P' || (p_size % 4) END, CASE WHEN p_size % 3 > 0 THEN 'L' || (p_size % 3) END, CASE WHEN p_partkey % 2 > 0 THEN 'D' || (p_partkey % 2) END), '') AS shape FROM part")
def _(t):
    return t.part.select("p_partkey", scalars.code([("P", F.col("p_size") % 4), ("L", F.col("p_size") % 3), ("D", F.col("p_partkey") % 2)]).alias("shape"))


@query("fn_09_reference_code", "SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'I' || (p_size % 2) ELSE concat_ws('-', 'R' || (p_size % 5), CASE WHEN p_size % 3 > 0 THEN 'E' || (p_size % 3) END, CASE WHEN p_size % 2 > 0 THEN 'I' || (p_size % 2) END) END AS code FROM part")
def _(t):
    size, none = F.col("p_size"), F.lit(0)
    return t.part.select("p_partkey", scalars.reference_code(F.col("p_type") == "SMALL", size % 5, size % 3, size % 2, none, none).alias("code"))


@query("fn_10_modifier_code", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'ps' WHEN p_size % 3 = 0 THEN 'xy' END AS code FROM part")
def _(t):
    tags = F.when(F.col("p_size") % 2 == 0, F.split(F.lit("static public unknown"), " ")).when(F.col("p_size") % 3 == 0, F.split(F.lit("async private"), " ")).otherwise(F.array(F.lit("other")))
    return t.part.select("p_partkey", scalars.modifier_code(tags).alias("code"))


@query("fn_11_read_advice", """
WITH f AS (SELECT p_partkey, p_type = 'SMALL' AS field, CASE WHEN p_size % 5 > 0 THEN p_size % 3 END AS m, p_size * 2 AS n, p_size % 2 AS land, p_partkey % 2 AS docs FROM part),
r AS (SELECT *, CASE WHEN m > 0 THEN 'mem' WHEN land > 0 AND n >= 60 THEN 'out' ELSE 'code' END AS route FROM f)
SELECT p_partkey, CASE WHEN n < 60 THEN NULL ELSE route END AS plain, CASE WHEN field THEN NULL WHEN m IS NULL THEN 'out' ELSE 'mem' END AS edit,
  CASE WHEN m > 0 THEN 'mem' END AS surface, CASE WHEN route = 'code' AND docs = 0 AND n < 60 THEN NULL ELSE route END AS logic FROM r""")
def _(t):
    size = F.col("p_size")
    kind = F.when(F.col("p_type") == "SMALL", "Field").otherwise(F.col("p_type"))
    facts = (kind, F.when(size % 5 > 0, size % 3), size * 2, size % 2, F.col("p_partkey") % 2)
    return t.part.select("p_partkey", *[scalars.read_advice(i, *facts).alias(i or "plain") for i in (None, "edit", "surface", "logic")])


@query("fn_12_doc_section", "SELECT p_partkey, p_name AS summary, CASE WHEN p_size > 25 THEN p_brand END AS returns FROM part")
def _(t):
    xml = F.concat(F.lit("<summary>\n  "), "p_name", F.lit(" </summary>"), F.when(F.col("p_size") > 25, F.concat(F.lit("<returns><c>"), "p_brand", F.lit("</c></returns>"))).otherwise(""))
    return t.part.select("p_partkey", scalars.doc_section(xml, "summary").alias("summary"), scalars.doc_section(xml, "returns").alias("returns"))


@query("fn_12_doc_sections", """
SELECT p_partkey, 'The ' || p_type || 's of it.' AS summary, CASE WHEN p_size > 25 THEN true END AS inheritdoc, 'a=' || p_name || ';b=two' AS params, CASE WHEN p_size % 2 = 0 THEN 'Failure=if ' || p_brand END AS exceptions FROM part""")
def _(t):
    text = [F.lit("<summary>\n /// The <see cref=\"T:Ns."), F.col("p_type"), F.lit("`1\"/>s <c>of</c> it. </summary><param name=\"a\">"), F.col("p_name"), F.lit("</param><param name=\"none\"> </param><param name=\"b\">two</param>")]
    text += [F.when(F.col("p_size") > 25, "<inheritdoc/>").otherwise(""), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<exception cref=\"T:Ns.Failure(System.Int32)\">if "), "p_brand", F.lit("</exception>"))).otherwise("")]
    got = t.part.select("p_partkey", scalars.doc_sections(F.concat(*text)).alias("s"))
    joined = lambda c: F.when(c.isNotNull(), F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["name"], x["text"])), ";"))
    return got.select("p_partkey", "s.summary", "s.inheritdoc", joined(F.col("s.params")).alias("params"), joined(F.col("s.exceptions")).alias("exceptions"))


@query("fn_13_line_count", "SELECT p_partkey, CASE WHEN p_partkey % 60 >= p_size THEN p_partkey % 60 - p_size + 1 END AS n FROM part")
def _(t):
    return t.part.select("p_partkey", scalars.line_count(F.col("p_size"), F.col("p_partkey") % 60).alias("n"))


@query("fn_14_snake", "SELECT p_partkey, replace(p_name, ' ', '_') AS name FROM part")
def _(t):
    return t.part.select("p_partkey", scalars.snake(F.regexp_replace(F.initcap("p_name"), " ", "")).alias("name"))


@query("fn_15_impact", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'non-breaking' WHEN p_size % 3 = 0 THEN 'breaking-public' ELSE 'breaking-internal' END AS impact FROM part")
def _(t):
    layers = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("body"))).otherwise(F.array(F.lit("decl"), F.lit("body")))
    return t.part.select("p_partkey", scalars.impact(layers, F.col("p_size") % 3 == 0).alias("impact"))


@query("fn_16_set_hash", "SELECT p_brand, left(sha256(string_agg(DISTINCT p_name, chr(10) ORDER BY p_name)), 12) AS hash FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_brand").agg(scalars.set_hash(F.col("p_name")).alias("hash"))


@query("fn_17_text_hash", "SELECT p_partkey, left(sha256(p_name || ' ' || p_type), 12) AS hash FROM part")
def _(t):
    return t.part.select("p_partkey", scalars.text_hash(F.concat(F.lit("  "), "p_name", F.lit(" // note\n\t"), "p_type", F.lit("\n"))).alias("hash"))


@query("fn_17_layers", """
SELECT p_partkey, left(sha256('int M' || p_size || ' ( string s = "a // ' || p_name || '" )'), 12) AS decl, CASE WHEN p_size % 2 = 0 THEN left(sha256('{ return "http://' || p_type || '" ; }'), 12) END AS body FROM part""")
def _(t):
    head = F.concat(F.lit("int  M"), F.col("p_size"), F.lit("(string s=\"a // "), "p_name", F.lit("\") // note\n"))
    body = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("{ /* "), "p_brand", F.lit(" \n */ return \"http://"), "p_type", F.lit("\"; }"))).otherwise("")
    return t.part.select("p_partkey", scalars.layer_hashes(F.concat(head, body)).alias("h")).select("p_partkey", "h.decl", "h.body")


@query("fn_19_line_endings", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'crlf' ELSE 'lf' END AS ending, p_name || chr(10) || p_type || chr(10) AS text FROM part")
def _(t):
    nl = F.when(F.col("p_size") % 2 == 0, "\r\n").otherwise("\n")
    text = F.concat("p_name", nl, "p_type", nl)
    return t.part.select("p_partkey", scalars.line_ending(text).alias("ending"), scalars.retarget(text, "lf").alias("text"))


@query("id_symbol", "SELECT p_partkey, 'sym_' || left(sha256(p_brand || '|' || p_name), 16) AS id FROM part")
def _(t):
    return t.part.select("p_partkey", scalars.symbol_id(F.col("p_brand"), F.col("p_name")).alias("id"))


@query("fn_18_segments", """
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'cat a.txt#grep ''x|y'' b' WHEN 1 THEN 'echo \\; "p & q"#ls' ELSE '/usr/bin/CAT.exe z' END AS segments,
  CASE p_size % 3 WHEN 0 THEN 'cat,grep' WHEN 1 THEN 'echo,ls' ELSE 'CAT' END AS commands FROM part""")
def _(t):
    line = F.when(F.col("p_size") % 3 == 0, "cat a.txt | grep 'x|y' b").when(F.col("p_size") % 3 == 1, 'echo \\; "p & q" && ls;').otherwise("/usr/bin/CAT.exe z")
    parts = scalars.segments_of_command(line)
    return t.part.select("p_partkey", F.array_join(parts, "#").alias("segments"), F.array_join(F.transform(parts, scalars.command_name), ",").alias("commands"))


@query("fn_20_source_lines", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_linestatus = 'F') AND l_returnflag <> 'R' AND (l_linenumber BETWEEN 2 AND 3 OR l_linenumber >= 6)""")
def _(t):
    chosen = grammar.parse_source("full-remarks-attributes@2-3;6-")
    kind = F.when(F.col("l_returnflag") == "A", "doc").when(F.col("l_returnflag") == "R", "attribute").otherwise("code")
    part = F.when(F.col("l_linestatus") == "F", "remarks").otherwise("summary")
    return t.lineitem.where(chosen.keeps(F.col("l_linenumber"), kind, part)).select("l_orderkey", "l_linenumber")
