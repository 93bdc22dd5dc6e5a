"""Filters, joins, windows, paging, sinks and diffs over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import incremental, metrics, ranking, relational
from ..sources import folders, store, tables
from ..streaming import mirror
from . import grammar
from .registry import query


def _path(t):
    return t.part.withColumn("path", F.concat_ws("/", F.lower("p_type"), F.regexp_replace("p_name", " ", "/"), F.col("p_partkey").cast("string")))


_PATH = "lower(p_type) || '/' || replace(p_name, ' ', '/') || '/' || p_partkey"


@query("src_02_glob_exclude", f"SELECT p_partkey FROM part WHERE NOT regexp_matches({_PATH}, '^((.*/)?RED/r.ng/|small/b[^/]*)', 'i')")
def _(t):
    return _path(t).where(tables.not_excluded(F.col("path"), ["**/RED/r?ng/", "small\\b*"])).select("p_partkey")


def _tree(t, suffix):
    """Names of parts in files below folders by brand; a part of a small size is in a build folder, one of a large size in an excluded one."""
    root = store.shared_folder(t.spark, "tree")
    for size, folder in (("p_size BETWEEN 10 AND 40", "src"), ("p_size < 10", "src/OBJ"), ("p_size > 40", "Generated/src")):
        t.part.where(size).select("p_brand", F.concat_ws(" ", "p_partkey", "p_name").alias("value")).repartition("p_brand").write.partitionBy("p_brand").text(f"{root}/{folder}")
    files = folders.scan_tree(t.spark, root, [suffix], exclude=["generated/"], content=True, parts=8)
    return files.select("path", F.explode(F.split(F.rtrim(F.decode("content", "utf-8"), F.lit("\n")), "\n")).alias("line"))


@query("src_01_tree", "SELECT 'src/p_brand=' || p_brand AS folder, CAST(p_partkey AS VARCHAR) || ' ' || p_name AS line FROM part WHERE p_size BETWEEN 10 AND 40")
def _(t):
    return _tree(t, ".TXT").select(F.url_decode(F.regexp_replace("path", "/[^/]*$", "")).alias("folder"), "line")


@query("src_05_manifest", "SELECT CAST(p_partkey AS VARCHAR) AS path, p_size AS length FROM part")
def _(t):
    files = t.part.select(F.col("p_partkey").cast("string").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modificationTime"), F.col("p_size").alias("length"))
    folder = store.shared_folder(t.spark, "manifest")
    tables.save_manifest(files, folder)
    return tables.load_manifest(t.spark, folder).select("path", "length")


@query("src_03_skip_folders", f"SELECT p_partkey FROM (SELECT p_partkey, CASE WHEN p_size < 10 THEN 'src/OBJ/' WHEN p_size < 20 THEN 'src/objects/' ELSE 'src/' END || {_PATH} AS path FROM part) WHERE regexp_matches(lower('/' || path || '/'), '/(bin|obj|node_modules|[.]git|[.]vs|dist)/')")
def _(t):
    head = F.when(F.col("p_size") < 10, "src/OBJ/").when(F.col("p_size") < 20, "src/objects/").otherwise("src/")
    return _path(t).where(tables.in_skipped_folder(F.concat(head, F.col("path")))).select("p_partkey")


_ROWS = {"region": "r_regionkey int, r_name string", "calls": "event_id long, event_type string", "history": "event_id long"}


def _store(t):
    """A new store with one table of each kind."""
    return store.Store(t.spark, store.shared_folder(t.spark, "store"), _ROWS, append_only={"calls"}, session={"calls"})


@query("src_06_table_store", "SELECT r_regionkey, upper(r_name) AS r_name FROM region UNION ALL SELECT 2, 'migrations'")
def _(t):
    own = _store(t)
    steps = [(2, "upper", lambda s: s.replace("region", s.read("region").withColumn("r_name", F.upper("r_name")))), (1, "load", lambda s: s.replace("region", t.region))]
    ran = len(own.migrate(steps)) + len(own.migrate(steps))
    return own.read("region").unionByName(t.spark.createDataFrame([(ran, "migrations")], "r_regionkey int, r_name string"))


@query("src_07_point_lookup", "SELECT p_name, p_brand FROM part WHERE p_partkey = 42")
def _(t):
    return tables.point_lookup(t.part, "p_partkey", 42).select("p_name", "p_brand")


@query("src_09_log", """
SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'id' || n_nationkey ELSE 'week#' || (n_nationkey + 1) END AS id, CASE WHEN n_nationkey % 3 = 2 THEN 'Plain ' || n_name ELSE n_name END AS title,
  CASE WHEN n_nationkey % 3 = 0 THEN 'open' ELSE 'done' END AS status, CASE WHEN n_nationkey % 3 = 0 THEN 'a,b' ELSE '' END AS tags, CASE WHEN n_nationkey % 3 = 2 THEN DATE '2020-02-02' ELSE DATE '2024-01-01' + n_nationkey::INTEGER END AS day FROM nation""")
def _(t):
    k = F.col("n_nationkey")
    day = F.date_add(F.lit("2024-01-01").cast("date"), k.cast("int")).cast("string")
    head = F.when(k % 3 == 0, F.concat(day, F.lit(" — "), "n_name")).when(k % 3 == 1, F.concat(day, F.lit(" - "), "n_name")).otherwise(F.concat(F.lit("Plain "), "n_name"))
    meta = F.when(k % 3 == 0, F.concat(F.lit('\n<!-- devlog {"id": "id'), k.cast("string"), F.lit('", "status": "open", "tags": ["a", "b"]} -->'))).when(k % 3 == 1, "\n<!-- devlog {broken} -->").otherwise("\n<!-- other {} -->")
    entry = F.concat(F.lit("## "), head, meta, F.lit("\nBody\n\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), entry.alias("e")))), lambda x: x["e"]), "")
    logs = t.nation.agg(F.concat(F.lit("# Week\n"), text).alias("text")).select(F.lit("logs/week.md").alias("path"), F.lit("2020-02-02").cast("timestamp").alias("modified"), "text")
    return tables.parse_log(logs).select("id", "title", "status", F.array_join("tags", ",").alias("tags"), F.to_date("ts").alias("day"))


@query("src_10_name_status", "SELECT CASE WHEN p_size % 2 = 0 THEN 'M' ELSE 'R' END AS status, p_name || '.cs' AS path, CASE WHEN p_size % 2 = 1 THEN p_type || '.cs' END AS former FROM part WHERE p_size % 3 > 0")
def _(t):
    name = F.concat("p_name", F.when(F.col("p_size") % 3 > 0, ".cs").otherwise(".md"))
    line = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("M\t"), name)).otherwise(F.concat(F.lit("R087\t"), "p_type", F.lit(".cs\t"), name))
    return tables.parse_name_status(t.part.select(line.alias("value")))


@query("src_08_batch_lookup", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _(t):
    return tables.batch_lookup(t.part, t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey").select("p_partkey", "p_name")


def _halves(t):
    rows = t.part.select("p_partkey", "p_name", "p_size")
    return rows.where("p_partkey % 3 <> 0"), rows.where("p_partkey % 2 = 0").withColumn("p_size", F.col("p_size") + 100)


@query("snk_01_upsert", "SELECT p_partkey, p_name, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_size + 100 ELSE p_size END AS INTEGER) AS p_size FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0")
def _(t):
    return tables.upsert(*_halves(t), ["p_partkey"])


@query("snk_02_insert_absent", "SELECT p_partkey, p_name, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size + 100 ELSE p_size END AS INTEGER) AS p_size FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0")
def _(t):
    return tables.insert_absent(*_halves(t), ["p_partkey"])


@query("snk_03_append", "SELECT event_id, event_type FROM events UNION ALL SELECT event_id, 'again' FROM events WHERE event_id % 3 = 0")
def _(t):
    own, rows = _store(t), t.events.select("event_id", "event_type")
    own.append("calls", rows)
    own.append("calls", rows.where("event_id % 3 = 0").withColumn("event_type", F.lit("again")))
    return own.read("calls")


@query("snk_04_replace", "SELECT r_regionkey, r_name || '!' AS r_name FROM region WHERE r_regionkey > 1")
def _(t):
    own = _store(t)
    own.replace("region", t.region)
    own.replace("region", own.read("region").where("r_regionkey > 1").withColumn("r_name", F.concat("r_name", F.lit("!"))))
    return own.read("region")


@query("snk_06_purge", "SELECT 'history' AS name, count(*) AS n FROM events UNION ALL SELECT 'calls', 0")
def _(t):
    own = _store(t)
    own.append("calls", t.events.select("event_id", "event_type"))
    own.append("history", t.events.select("event_id"))
    own.purge()
    count = lambda name: own.read(name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return count("history").unionByName(count("calls"))


@query("snk_07_guard", "SELECT event_id, event_type, true AS refused FROM events")
def _(t):
    own, rows = _store(t), t.events.select("event_id", "event_type")
    own.append("calls", rows)
    try:
        own.replace("calls", rows.limit(0))
        refused = False
    except PermissionError:
        refused = True
    return own.read("calls").withColumn("refused", F.lit(refused))


@query("snk_05_cascade", """
SELECT 'edges' AS part, o_orderkey AS a, o_custkey AS b FROM orders WHERE o_orderkey % 7 <> 0 AND o_custkey % 7 <> 0
UNION ALL SELECT 'symbols', o_orderkey, NULL FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT 'facts', o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 <> 0""")
def _(t):
    edges = t.orders.select(F.col("o_orderkey").alias("from_symbol"), F.col("o_custkey").alias("to_symbol"))
    symbols = t.orders.select(F.col("o_orderkey").alias("symbol_id"))
    gone = symbols.unionByName(t.customer.select(F.col("c_custkey").alias("symbol_id"))).where("symbol_id % 7 = 0")
    one, two, three = tables.delete_cascade(symbols, edges, symbols.withColumn("fact", F.lit(0)).drop("fact").join(edges, F.col("symbol_id") == F.col("from_symbol")).select("symbol_id", F.col("to_symbol").alias("fact")), gone)
    row = lambda part, d, a, b: d.select(F.lit(part).alias("part"), F.col(a).alias("a"), b.alias("b"))
    none = F.lit(None).cast("long")
    return row("edges", two, "from_symbol", F.col("to_symbol")).unionByName(row("symbols", one, "symbol_id", none)).unionByName(row("facts", three, "symbol_id", F.col("fact")))


@query("snk_08_json", "SELECT CASE WHEN r_regionkey = 0 THEN json_object('r_regionkey', r_regionkey) ELSE json_object('r_regionkey', r_regionkey, 'r_name', r_name) END::VARCHAR AS json FROM region")
def _(t):
    return tables.as_json(t.region.withColumn("r_name", F.when(F.col("r_regionkey") != 0, F.col("r_name"))))


@query("snk_08_toon", """SELECT '  ' || n_nationkey || ',' || CASE n_nationkey % 5 WHEN 0 THEN 'null' WHEN 1 THEN '"a, \\"b\\""' WHEN 2 THEN '"17"' WHEN 3 THEN '""' ELSE n_name END AS toon FROM nation""")
def _(t):
    k = F.col("n_nationkey")
    name = F.when(k % 5 == 1, 'a, "b"').when(k % 5 == 2, "17").when(k % 5 == 3, "").when(k % 5 == 4, F.col("n_name"))
    return tables.as_toon(t.nation.select("n_nationkey", name.alias("name")))


@query("snk_08_smaller", "SELECT 'toon' AS encoding UNION ALL SELECT 'json'")
def _(t):
    return tables.smaller_encoding(t.nation.select("n_nationkey", "n_name"), "nations", 25).select("encoding")


@query("snk_09_pipe_table", """
SELECT 'nations(5/' || count(*) || ') n_nationkey|n_name' AS line FROM nation UNION ALL SELECT n_nationkey || '|' || n_name FROM nation WHERE n_nationkey < 5
UNION ALL SELECT '…+' || (count(*) - 5) || ' more (raise limit)' FROM nation""")
def _(t):
    rows = t.nation.select("n_nationkey", "n_name").orderBy("n_nationkey")
    return t.spark.createDataFrame([(x,) for x in tables.pipe_table(rows, "nations", rows.count(), 5)], "line string")


@query("snk_10_padding", "SELECT r_regionkey, r_name, NULL::INTEGER AS n_nationkey FROM region UNION ALL SELECT NULL, NULL, n_nationkey FROM nation")
def _(t):
    return tables.padded_union(t.region, t.nation.select("n_nationkey"))


@query("flt_01_kinds", "SELECT p_partkey FROM part WHERE lower(p_type) IN ('economy', 'small')")
def _(t):
    return t.part.where(grammar.kind_filter(F.col("p_type"), "Economy,SMALL")).select("p_partkey")


@query("flt_02_exclude_grammar", "SELECT p_partkey FROM part WHERE lower(p_type) NOT IN ('economy')")
def _(t):
    return t.part.where(grammar.kind_filter(F.col("p_type"), "-economy")).select("p_partkey")


@query("flt_03_mixed_grammar", "SELECT p_partkey FROM part WHERE lower(p_type) IN ('economy')")
def _(t):
    return t.part.where(grammar.kind_filter(F.col("p_type"), "economy,-small")).select("p_partkey")


@query("flt_04_aliases", "SELECT event_id, CASE event_type WHEN 'click' THEN 'Type' WHEN 'view' THEN 'Method' ELSE event_type END AS kind FROM events")
def _(t):
    raw = F.when(F.col("event_type") == "click", "Class").when(F.col("event_type") == "view", "METHOD").otherwise(F.col("event_type"))
    return t.events.select("event_id", grammar.canonical_kind(raw).alias("kind"))


@query("flt_05_tags", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'red') AND NOT list_contains(string_split(p_name, ' '), 'bolt')")
def _(t):
    return t.part.where(grammar.tag_filter(F.split(F.initcap("p_name"), " "), "rED,-BOLT")).select("p_partkey")


@query("flt_06_sections", "SELECT p_partkey FROM part WHERE p_size % 2 = 1 OR NOT list_contains(string_split(p_name, ' '), 'bolt')")
def _(t):
    return t.part.where(grammar.tag_filter(F.when(F.col("p_size") % 2 == 0, F.split("p_name", " ")), "-bolt")).select("p_partkey")


@query("flt_07_origin", "SELECT p_partkey, 'source' AS wanted FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'any' FROM part")
def _(t):
    rows = t.part.withColumn("origin", F.when(F.col("p_size") % 2 == 0, "source").otherwise("external"))
    one = lambda wanted: rows.where(grammar.origin_filter(F.col("origin"), wanted)).select("p_partkey", F.lit(wanted).alias("wanted"))
    return one("source").unionByName(one("any"))


@query("flt_08_path_scope", f"SELECT p_partkey FROM part WHERE {_PATH} = 'economy/red' OR starts_with({_PATH}, 'economy/red/')")
def _(t):
    return _path(t).where(grammar.within_path(F.col("path"), "economy/red")).select("p_partkey")


@query("flt_12_all_terms", "SELECT doc_id FROM documents WHERE text ILIKE '%license%' AND text ILIKE '%under%' ORDER BY doc_id DESC LIMIT 50")
def _(t):
    return t.documents.where(grammar.all_terms(F.col("text"), "license UNDER")).select("doc_id").orderBy(F.desc("doc_id")).limit(50)


@query("flt_13_log_attributes", "SELECT p_partkey FROM part WHERE p_name ILIKE '%widg%' AND p_type = 'ECONOMY' AND starts_with(p_name, 'red ') AND p_size % 2 = 0 AND p_size BETWEEN 5 AND 20")
def _(t):
    ts = F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).cast("timestamp") + F.expr("INTERVAL 23 HOURS")
    rows = t.part.select("p_partkey", F.split("p_name", " ").alias("classes"), F.col("p_type").alias("domain"), F.array(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("tags"), F.when(F.col("p_size") % 2 == 0, "Done").alias("status"), ts.alias("ts"))
    return rows.where(grammar.log_filter("WIDG", "economy", "RED", "done", "2024-01-06", "2024-01-21")).select("p_partkey")


def _tokens(t):
    a = F.concat(F.lit("decl:"), F.col("p_size") % 3, F.lit("|body:"), F.col("p_size") % 4)
    b = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("decl:"), F.col("p_partkey") % 3)).otherwise(F.concat(F.lit("api:"), F.col("p_partkey") % 3))
    return t.part.select("p_partkey", scalars.layers(a).alias("a"), scalars.layers(b).alias("b"))


@query("flt_14_version_agrees", "SELECT p_partkey FROM part WHERE p_partkey % 2 = 0 AND p_size % 3 = p_partkey % 3")
def _(t):
    return _tokens(t).where(scalars.agrees(F.col("a"), F.col("b"))).select("p_partkey")


@query("flt_15_version_satisfies", """
SELECT p_partkey, p_size % 5 > 0 AND p_partkey % 2 = 0 AND p_size % 3 = p_partkey % 3 AS satisfied, p_size % 5 > 0 AND p_partkey % 2 = 1 AS covered, 'decl:' || (p_size % 3) AS narrowed FROM part""")
def _(t):
    pairs = F.transform(F.map_entries(scalars.narrow(F.col("a"), ["decl"])), lambda e: F.concat_ws(":", e["key"], e["value"]))
    rows = _tokens(t).join(t.part.select("p_partkey", "p_size"), "p_partkey").withColumn("b", F.when(F.col("p_size") % 5 > 0, F.col("b")).otherwise(F.map_filter("b", lambda k, v: F.lit(False))))
    return rows.select("p_partkey", scalars.satisfies(F.col("a"), F.col("b")).alias("satisfied"), scalars.covers(F.col("b"), ["api"]).alias("covered"), F.array_join(pairs, "|").alias("narrowed"))


@query("flt_16_line_ranges", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber BETWEEN 2 AND 3 OR l_linenumber = 5 OR l_linenumber >= 7")
def _(t):
    return t.lineitem.where(grammar.line_ranges(F.col("l_linenumber"), "@2-3;5;7-")).select("l_orderkey", "l_linenumber", "l_partkey")


@query("flt_17_overlap", "SELECT DISTINCT a.event_id FROM events a JOIN nation n ON a.event_id % 1000 <= n.n_nationkey * 40 + 3 AND n.n_nationkey * 40 <= a.event_id % 1000 + 2")
def _(t):
    spans = t.events.select("event_id", (F.col("event_id") % 1000).alias("s"), (F.col("event_id") % 1000 + 2).alias("e"))
    changed = t.nation.select((F.col("n_nationkey") * 40).alias("low"), (F.col("n_nationkey") * 40 + 3).alias("high"))
    return relational.overlapping(spans, changed, "event_id", ("s", "e"), ("low", "high")).select("event_id")


_SPANS = "(SELECT o_orderkey, o_orderkey * 3 + o_custkey % 7 AS s, o_orderkey * 3 + CAST(o_custkey % 11 * (o_custkey % 11) * (o_custkey % 11) AS BIGINT) AS e FROM orders)"


@query("flt_17_interval_join", f"SELECT o_orderkey, event_id FROM {_SPANS} o JOIN events a ON o.s <= o.e AND o.s <= a.event_id * 5 + a.user_id % 9 AND a.event_id * 5 <= o.e")
def _(t):
    cube = F.col("o_custkey") % 11
    spans = t.orders.select("o_orderkey", (F.col("o_orderkey") * 3 + F.col("o_custkey") % 7).alias("s"), (F.col("o_orderkey") * 3 + cube * cube * cube).alias("e"))
    events = t.events.select("event_id", (F.col("event_id") * 5).alias("low"), (F.col("event_id") * 5 + F.col("user_id") % 9).alias("high"))
    return relational.interval_pairs(spans, events, ("s", "e"), ("low", "high")).select("o_orderkey", "event_id")


@query("prj_01_columns", "SELECT p_partkey, p_name, p_size FROM part")
def _(t):
    return t.part.select(*grammar.columns("standard,p_size", ["p_partkey", "p_name"], t.part.columns))


@query("prj_02_lenient_columns", "SELECT p_partkey, p_brand FROM part")
def _(t):
    return t.part.select(*grammar.columns("p_partkey,nonsense,p_brand", ["p_partkey"], t.part.columns, strict=False))


@query("prj_03_layers", "SELECT p_partkey, 'decl:' || (p_size % 3) || '|body:' || (p_size % 4) AS token FROM part")
def _(t):
    pairs = F.transform(F.map_entries(scalars.narrow(F.col("a"), grammar.required_layers(["source", "signature"]))), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return _tokens(t).select("p_partkey", F.array_join(pairs, "|").alias("token"))


@query("prj_04_wide", "SELECT p_partkey, CASE WHEN p_name <> p_type THEN p_name END AS p_name, CASE WHEN p_size > 25 THEN p_size END AS p_size FROM part")
def _(t):
    return relational.projected(t.part, ["p_partkey", "p_name", "p_size"], {"p_name": F.col("p_name") == F.col("p_type"), "p_size": F.col("p_size") <= 25})


@query("prj_05_flatten", "SELECT NULL AS parent, r_name AS name, 0 AS depth FROM region UNION ALL SELECT r_name, n_name, 1 FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 's' || s_suppkey, 2 FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def _(t):
    low = t.supplier.groupBy("s_nationkey").agg(F.collect_list(F.struct(F.concat(F.lit("s"), "s_suppkey").alias("name"))).alias("children"))
    mid = t.nation.join(low, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("name"), "children")).alias("children"))
    top = t.region.join(mid, F.col("n_regionkey") == F.col("r_regionkey")).select(F.struct(F.col("r_name").alias("name"), "children").alias("node"))
    return relational.flattened(top, "node")


@query("join_04_log_symbols", "SELECT o_custkey, count(*) AS entries, count(DISTINCT l_partkey) AS symbols FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    return relational.entries_of(t.orders.withColumnRenamed("o_orderkey", "l_orderkey"), t.lineitem, "l_orderkey", "o_custkey", "l_partkey")


@query("join_05_semi_coverage", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def _(t):
    return relational.in_covered(t.customer.withColumnRenamed("c_nationkey", "project"), t.supplier.withColumnRenamed("s_nationkey", "project")).select("c_custkey")


@query("join_06_scalar_coverage", "SELECT s_suppkey, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > 9000) AS covered FROM supplier")
def _(t):
    rich = t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("s_nationkey")).distinct().withColumn("_c", F.lit(True))
    return t.supplier.join(rich, "s_nationkey", "left").select("s_suppkey", F.col("_c").isNotNull().alias("covered"))


@query("join_07_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _(t):
    return relational.not_counted(t.orders, t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey").select("o_orderkey")


@query("join_08_semi_hits", "SELECT p_partkey FROM part WHERE p_name ILIKE '%ring%' AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def _(t):
    made = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return relational.among(t.part.where(F.col("p_name").ilike("%ring%")), made, "p_partkey").select("p_partkey")


@query("join_09_lookup", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 20")
def _(t):
    return relational.lookup(t.supplier.withColumnRenamed("s_nationkey", "n_nationkey"), t.nation.where("n_nationkey < 20"), "n_nationkey").select("s_suppkey", "n_name")


@query("join_10_disambiguate", """
WITH j AS (SELECT c.c_custkey AS id, s.s_suppkey AS hit, c.c_nationkey % 5 = s.s_suppkey % 5 AS same FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey),
a AS (SELECT id, any_value(hit) AS hit FROM j GROUP BY id HAVING count(*) = 1),
b AS (SELECT id, any_value(hit) AS hit FROM j WHERE same AND id NOT IN (SELECT id FROM a) GROUP BY id HAVING count(*) = 1)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def _(t):
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("name"), (F.col("c_nationkey") % 5).cast("long").alias("arity"))
    found = t.supplier.select(F.col("s_nationkey").alias("name"), (F.col("s_suppkey") % 5).alias("arity"), F.col("s_suppkey").alias("hit"))
    return relational.disambiguate(rows, found, ["arity"]).select("id", "hit")


def _snapshots(t):
    digest = F.sha2("text", 256).alias("digest")
    return t.documents.where("doc_id % 5 <> 0").select("doc_id", digest), t.documents.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("x")).otherwise(digest).alias("digest"))


_CHANGE = "CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'removed' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END"


@query("join_11_snapshot_diff", f"SELECT doc_id, {_CHANGE} AS change FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 7 <> 0")
def _(t):
    return relational.snapshot_diff(*_snapshots(t), "doc_id", "digest")


@query("join_12_match_cascade", """
SELECT a.p_partkey AS old_id, a.p_partkey + 1 AS new_id, CASE a.p_partkey // 2 % 4 WHEN 0 THEN 'key' WHEN 1 THEN 'name' ELSE 'signature' END AS how
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 2 = 0 AND a.p_partkey // 2 % 4 < 3""")
def _(t):
    # pairs of neighbours have a key, a name with others in the same order, or a signature in common; a fourth of them nothing
    def rows(odd: int):
        j, own = F.floor(F.col("p_partkey") / 2).cast("long"), F.concat(F.lit(f"own{odd}-"), F.col("p_partkey"))
        part = t.part.where(F.col("p_partkey") % 2 == odd).withColumn("both", F.col("p_partkey") + 1 - 2 * odd)
        part = part.join(t.part.select(F.col("p_partkey").alias("both")), "both")
        either = lambda k, c: F.when(j % 4 == k, F.concat(F.lit("both"), c)).otherwise(own)
        return part.select(F.col("p_partkey").alias("id"), either(0, j).alias("key"), either(1, F.floor(j / 12).cast("long")).alias("name"), F.col("p_partkey").alias("position"), F.when(j % 4 != 3, either(2, j)).alias("signature"))

    return relational.match_cascade(rows(0), rows(1))


@query("join_13_transpose", "SELECT n_regionkey AS target, array_to_string(list(n_name ORDER BY n_name), ',') AS referenced_by FROM nation GROUP BY 1")
def _(t):
    return relational.transposed(t.nation, "n_name", "n_regionkey").select(F.col("n_regionkey").alias("target"), F.array_join("referenced_by", ",").alias("referenced_by"))


@query("win_01_first_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def _(t):
    return relational.first_by(t.orders, ["o_custkey"], F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("win_02_fair_order", """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY p_size < 25, p_brand ORDER BY p_partkey) AS turn FROM part)
SELECT p_partkey, p_brand FROM f ORDER BY p_size < 25, turn, p_brand, p_partkey LIMIT 40 OFFSET 20""")
def _(t):
    rows = t.part.withColumn("tier", F.col("p_size") < 25)
    return relational.fair_page(rows, "tier", "p_brand", F.col("p_brand"), [F.col("p_partkey")], 20, 40).select("p_partkey", "p_brand")


@query("win_03_floor_share", """
WITH t AS (SELECT DISTINCT p_type FROM part), k AS (SELECT p_type, row_number() OVER (ORDER BY p_type DESC) AS seq, count(*) OVER () AS terms FROM t),
r AS (SELECT p_partkey, p_size, seq, terms, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS rn FROM part JOIN k USING (p_type)),
f AS (SELECT *, CASE WHEN rn <= 30 // terms THEN seq ELSE terms + 1 END AS turn FROM r)
SELECT p_partkey, CAST(row_number() OVER (ORDER BY turn, CASE WHEN turn <= terms THEN rn END, p_size, p_partkey) - 1 AS INTEGER) AS place FROM f ORDER BY place LIMIT 30""")
def _(t):
    kinds = sorted((r.p_type for r in t.part.select("p_type").distinct().collect()), reverse=True)  # the terms of a query: a few
    return relational.floor_share(t.part, "p_type", "p_partkey", 30, kinds, F.col("p_size"), F.col("p_partkey")).select("p_partkey", "place")


@query("win_04_positional_pairs", """
WITH a AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders WHERE o_orderstatus = 'O')
SELECT a.o_orderkey AS old_id, b.o_orderkey AS new_id FROM a JOIN b ON a.o_custkey = b.o_custkey AND a.nth = b.nth""")
def _(t):
    side = lambda s, n: t.orders.where(F.col("o_orderstatus") == s).select("o_custkey", F.col("o_orderkey").alias(n))
    return relational.paired(side("F", "old_id"), side("O", "new_id"), ["o_custkey"], F.col("old_id"), F.col("new_id")).select("old_id", "new_id")


@query("win_05_unique_groups", "SELECT o_orderkey FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM orders) WHERE n = 1")
def _(t):
    return relational.unique_rows(t.orders, ["o_custkey", "o_orderpriority"]).select("o_orderkey")


@query("srt_04_recent", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def _(t):
    return relational.recent(t.orders, 25, F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey")


@query("srt_07_scoped_top", "SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500) WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def _(t):
    return relational.scoped_top(t.orders, F.col("o_orderstatus") == "F", 1000, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey")


@query("srt_05_page", "SELECT p_partkey, (SELECT count(*) FROM part) AS total, 90 AS next_offset FROM (SELECT p_partkey FROM part ORDER BY p_name, p_partkey LIMIT 50 OFFSET 40)")
def _(t):
    return relational.page(t.part.select("p_name", "p_partkey"), [F.col("p_name"), F.col("p_partkey")], 40, 50).drop("p_name")


@query("srt_06_capped_lists", """
SELECT 'F' AS list, o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 10)
UNION ALL SELECT 'P', o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 5)""")
def _(t):
    lists = {s: t.orders.where(F.col("o_orderstatus") == s).select("o_orderkey") for s in ("F", "P")}
    return metrics.labelled_union(relational.capped(lists, [F.col("o_orderkey")], {"F": 10, "P": 5}), "list")


@query("srt_08_byte_order", "SELECT p_partkey FROM part ORDER BY p_name DESC, p_partkey LIMIT 20")
def _(t):
    return relational.recent(t.part, 20, F.desc("p_name"), F.col("p_partkey")).select("p_partkey")


@query("set_04_difference", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(t):
    return relational.difference(t.customer, t.orders.where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("set_06_key_union", "SELECT l_partkey AS k FROM lineitem UNION SELECT p_partkey FROM part")
def _(t):
    return relational.key_union(t.lineitem.withColumnRenamed("l_partkey", "k"), t.part.withColumnRenamed("p_partkey", "k"), "k")


@query("inc_01_sweep", f"SELECT CAST(doc_id AS VARCHAR) AS path, {_CHANGE} AS change FROM documents WHERE (doc_id % 5 <> 0 OR doc_id % 7 <> 0) AND {_CHANGE} <> 'unchanged'")
def _(t):
    stamp = lambda d, s: d.select(F.col("doc_id").cast("string").alias("path"), s.alias("modificationTime"), F.col("n_chars").alias("length"))
    before = stamp(t.documents.where("doc_id % 5 <> 0"), F.lit("1"))
    return incremental.sweep(before, stamp(t.documents.where("doc_id % 7 <> 0"), F.when(F.col("doc_id") % 3 == 0, "2").otherwise("1")))


@query("inc_02_baseline", f"SELECT CAST(doc_id AS VARCHAR) AS path, {_CHANGE} AS change, 'second' AS scan FROM documents WHERE (doc_id % 5 <> 0 OR doc_id % 7 <> 0) AND {_CHANGE} <> 'unchanged'")
def _(t):
    stamp = lambda d, s: d.select(F.col("doc_id").cast("string").alias("path"), s.alias("modificationTime"), F.col("n_chars").alias("length"))
    before, now = stamp(t.documents.where("doc_id % 5 <> 0"), F.lit("1")), stamp(t.documents.where("doc_id % 7 <> 0"), F.when(F.col("doc_id") % 3 == 0, "2").otherwise("1"))
    first = incremental.sweep_after_baseline(None, before).withColumn("scan", F.lit("first"))
    return first.unionByName(incremental.sweep_after_baseline(before, now).withColumn("scan", F.lit("second")))


@query("inc_03_mirror", """
WITH l AS (SELECT 'c' || o_custkey AS key, max({'seq': o_orderkey, 'digest': o_orderpriority, 'gone': o_orderstatus = 'P'}) AS last FROM orders GROUP BY 1),
s AS (SELECT key, last.digest AS digest FROM l WHERE NOT last.gone)
SELECT 'symbol' AS part, key AS a, digest AS b FROM s
UNION ALL SELECT 'term', term, CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT key, unnest(string_split(lower(digest), '-')) AS term FROM s) GROUP BY 2""")
def _(t):
    own = mirror.Mirror(store.Store(t.spark, store.shared_folder(t.spark, "mirror"), {}))
    digest, seq = F.col("o_orderpriority"), F.col("o_orderkey").cast("long")
    changes = t.orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("key"), seq.alias("seq"), digest.alias("digest"), F.split(F.lower(digest), "-").alias("terms"), (F.col("o_orderstatus") == "P").alias("removed"))
    # all orders in two batches, so that earlier changes of a key come late; the second comes twice
    first, second = changes.where("seq % 2 = 0"), changes.where("seq % 2 = 1")
    for number, batch in ((0, first), (1, second), (1, second)):
        own.apply(batch, number)
    terms = own.store.read(own.index.terms).select(F.lit("term").alias("part"), F.col("term").alias("a"), F.col("df").cast("string").alias("b"))
    return own.current().select(F.lit("symbol").alias("part"), F.col("key").alias("a"), F.col("digest").alias("b")).unionByName(terms)


@query("inc_03_refresh", f"""
SELECT 'symbol' AS part, doc_id AS a, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE lang END AS b FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT 'change', doc_id, {_CHANGE} FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 7 <> 0
UNION ALL SELECT 'edge', doc_id, CAST(doc_id + 1 AS VARCHAR) FROM documents WHERE doc_id % 7 <> 0""")
def _(t):
    rows = lambda d, digest: d.select(F.col("doc_id").alias("symbol_id"), digest.alias("digest"))
    old = rows(t.documents.where("doc_id % 5 <> 0"), F.col("lang"))
    new = rows(t.documents.where("doc_id % 7 <> 0"), F.when(F.col("doc_id") % 3 == 0, "new").otherwise(F.col("lang")))
    edges = lambda d: d.select(F.col("symbol_id").alias("from_symbol"), (F.col("symbol_id") + 1).alias("to_symbol"))
    symbols, links, change = incremental.refresh(old, new, edges(old), edges(new))
    row = lambda part, d, a, b: d.select(F.lit(part).alias("part"), F.col(a).alias("a"), F.col(b).cast("string").alias("b"))
    return row("symbol", symbols, "symbol_id", "digest").unionByName(row("change", change, "symbol_id", "change")).unionByName(row("edge", links, "from_symbol", "to_symbol"))


@query("inc_04_valid_facts", "SELECT p_partkey AS symbol_id FROM part WHERE p_size % 2 = 0")
def _(t):
    facts = t.part.select(F.col("p_partkey").alias("symbol_id"), F.col("p_size").cast("string").alias("body_hash"))
    now = t.part.select(F.col("p_partkey").alias("symbol_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("changed").alias("body_hash"))
    return incremental.valid_facts(facts, now).select("symbol_id")


@query("inc_05_self_repair", "SELECT p_partkey AS symbol_id FROM part")
def _(t):
    symbols = t.part.select(F.col("p_partkey").alias("symbol_id"))
    return incremental.repaired(symbols, symbols.where("symbol_id > 5"), "symbol_id", lambda s: s)


@query("inc_07_deferred", "SELECT CAST(user_id AS VARCHAR) AS path, max(event_id) AS at, CASE WHEN user_id % 3 = 0 THEN 'remove' ELSE 'refresh' END AS action FROM events GROUP BY user_id")
def _(t):
    queue = t.events.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("at"))
    now = t.events.where("user_id % 3 <> 0").select(F.col("user_id").cast("string").alias("path"))
    return incremental.deferred(queue, now)


@query("inc_08_current", "SELECT p_partkey AS symbol_id, p_size % 2 = 0 AS current FROM part")
def _(t):
    history = t.part.select(F.col("p_partkey").alias("symbol_id"), F.col("p_size").alias("new_version"))
    now = t.part.select(F.col("p_partkey").alias("symbol_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).otherwise(-1).alias("body_hash"))
    return incremental.current_history(history, now).select("symbol_id", "current")


@query("srt_02_like_rank", "SELECT p_partkey FROM part WHERE p_name ILIKE '%ring%' ORDER BY CASE WHEN p_name = 'ring' THEN 0 WHEN p_name ILIKE 'ring%' THEN 1 ELSE 2 END, length(p_name), p_name, p_partkey LIMIT 40")
def _(t):
    hits = t.part.where(F.col("p_name").ilike("%ring%"))
    return hits.orderBy(ranking.name_rank(F.col("p_name"), "ring"), F.length("p_name"), "p_name", "p_partkey").limit(40).select("p_partkey")
