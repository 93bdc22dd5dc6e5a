"""Telemetry: counts and sums over events, orders and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import grouping, incremental, metrics, relational
from ..sources import lines, store, tables
from ..streaming import ingest
from . import grammar
from .registry import query

_CENTS = "round(value * 100)"


def _events(t):
    return t.events.withColumn("tokens", F.expr(_CENTS).cast("long"))


@query("agg_01_count", "SELECT count(*) AS n FROM events")
def _(t):
    return t.events.agg(F.count("*").alias("n"))


@query("agg_02_two_distinct", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events WHERE value > 20")
def _(t):
    return t.events.where("value > 20").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"))


@query("agg_06_totals", f"SELECT count(*) AS calls, CAST(coalesce(sum({_CENTS}), 0) AS BIGINT) AS tokens FROM events")
def _(t):
    return metrics.totals(_events(t), "tokens")


@query("agg_07_patch_totals", """
SELECT count(*) AS attempts, count(*) FILTER (WHERE o_orderstatus = 'F') AS succeeded, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS applied,
  count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS calls,
  CAST(coalesce(sum(CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN o_custkey END), 0) AS BIGINT) AS tokens
FROM orders""")
def _(t):
    return metrics.patch_totals(t.orders, t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT")


@query("agg_08_by_tool", f"""
SELECT tool, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM (
  SELECT event_type AS tool, CAST({_CENTS} AS BIGINT) AS tokens FROM events
  UNION ALL SELECT 'patch' AS tool, o_custkey AS tokens FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) GROUP BY tool""")
def _(t):
    patches = relational.not_counted(t.orders, t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    both = metrics.labelled_union({"read": _events(t).select(F.col("event_type").alias("tool"), "tokens"), "patch": patches.select(F.col("o_custkey").alias("tokens"))}, "tool")
    return metrics.by_group(both, F.col("tool"), "tokens")


@query("agg_09_by_session", f"SELECT user_id AS session, count(*) AS calls, CAST(sum({_CENTS}) AS BIGINT) AS tokens, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY user_id")
def _(t):
    return metrics.by_group(_events(t), F.col("user_id").alias("session"), "tokens", "ts")


@query("agg_10_by_symbol", f"SELECT coalesce(CASE WHEN event_type <> 'error' THEN event_type END, '(unresolved)') AS symbol, count(*) AS calls, CAST(sum({_CENTS}) AS BIGINT) AS tokens FROM events GROUP BY 1")
def _(t):
    symbol = F.coalesce(F.when(F.col("event_type") != "error", F.col("event_type")), F.lit("(unresolved)"))
    return metrics.by_group(_events(t), symbol.alias("symbol"), "tokens")


@query("agg_11_by_level", "SELECT o_orderpriority AS level, count(*) AS calls FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("level")).agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "level")


_CHARS = "((coalesce(length(text), 0) + 3) // 4)"


@query("agg_12_directions", f"""
SELECT count(*) AS calls, CAST(sum(CASE WHEN role = 'user' THEN {_CHARS} ELSE 0 END) AS BIGINT) AS request, CAST(sum(CASE WHEN role <> 'user' THEN {_CHARS} ELSE 0 END) AS BIGINT) AS response,
  string_agg(DISTINCT role, ',' ORDER BY role) AS estimators FROM conversations HAVING count(*) > 0""")
def _(t):
    n, user = scalars.chars4(F.col("text")), F.col("role") == "user"
    rows = t.conversations.select("role", F.when(user, n).otherwise(0).alias("rq"), F.when(~user, n).otherwise(0).alias("rs"))
    return metrics.directions(rows, "rq", "rs", "role")


@query("agg_13_distinct_concat", "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_orderstatus").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query("agg_14_harness_groups", f"SELECT event_type AS tool, coalesce(CASE WHEN user_id % 3 <> 0 THEN 'agent' || (user_id % 3) END, '(main thread)') AS agent, count(*) AS calls, CAST(sum({_CENTS}) AS BIGINT) AS tokens FROM events GROUP BY 1, 2")
def _(t):
    agent = F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("agent"), F.col("user_id") % 3))
    rows = _events(t).withColumns({"tool": F.col("event_type"), "agent": F.coalesce(agent, F.lit("(main thread)"))})
    return rows.groupBy("tool", "agent").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


@query("agg_15_index_drift", "SELECT (SELECT count(*) FROM part) AS symbols, (SELECT count(*) FROM lineitem) AS mirrored, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS \"distinct\", (SELECT count(*) FROM part) = (SELECT count(*) FROM lineitem) AND (SELECT count(*) FROM lineitem) = (SELECT count(DISTINCT l_partkey) FROM lineitem) AS intact")
def _(t):
    return metrics.index_drift(t.part, t.lineitem, "l_partkey")


@query("agg_16_merged_sites", "SELECT l_suppkey, array_to_string(list_sort(list_distinct(list(l_shipmode_))), ',') AS sites, bool_or(l_returnflag = 'R') AS any_flag FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem) GROUP BY 1")
def _(t):
    rows = t.lineitem.select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("site"), (F.col("l_returnflag") == "R").alias("flag"))
    return metrics.merged_sites(rows, ["l_suppkey"], "site", "flag").withColumn("sites", F.array_join("sites", ","))


@query("agg_17_distilled", """
WITH d AS (SELECT user_id, hour(ts) AS site, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY site) AS rn FROM d)
SELECT user_id, CAST(sum(n) AS BIGINT) AS n, array_to_string(list(site ORDER BY site) FILTER (WHERE rn <= 3), ',') AS sites, count(*) FILTER (WHERE rn > 3) AS suppressed FROM r GROUP BY 1""")
def _(t):
    rows = t.events.where("event_type = 'error'").select("user_id", F.hour("ts").alias("site"))
    return metrics.distilled(rows, ["user_id"], "site").withColumn("sites", F.array_join(F.col("sites").cast("array<string>"), ","))


@query("agg_18_grouped_in_order", """
WITH s AS (SELECT user_id, event_type, min(event_id) AS pos FROM events GROUP BY 1, 2)
SELECT user_id, min(pos) AS first_at, array_to_string(list(event_type ORDER BY pos), ',') AS names, count(*) = 1 AS uniform FROM s GROUP BY 1""")
def _(t):
    return metrics.grouped_in_order(t.events, "user_id", "event_type", "event_id").withColumn("names", F.array_join("names", ","))


@query("agg_19_constant_columns", "SELECT count(DISTINCT o_orderstatus) = 1 AS o_orderstatus, count(DISTINCT o_orderpriority) = 1 AS o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return metrics.constant_columns(t.orders.where("o_orderstatus = 'F'"), ["o_orderstatus", "o_orderpriority"])


_HITS = "(SELECT l_orderkey * 8 + l_linenumber AS pos, l_suppkey, l_shipdate, l_quantity, l_returnflag, l_linestatus, l_returnflag || l_linestatus AS site, l_returnflag = 'R' AS flag FROM lineitem)"


def _hits(t):
    return t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus", F.concat("l_returnflag", "l_linestatus").alias("site"), (F.col("l_returnflag") == "R").alias("flag"))


@query("agg_16_first_rows", f"""
SELECT l_suppkey, min(pos) AS pos, min({{'pos': pos, 'q': l_quantity}}).q AS l_quantity, bool_or(flag) AS flag, count(DISTINCT site) AS n_sites FROM {_HITS} GROUP BY 1""")
def _(t):
    return grouping.merged(_hits(t).select("l_suppkey", "pos", "l_quantity", "site", "flag"), ["l_suppkey"], "pos", ["site"], ["flag"]).groups


@query("agg_16_sites_in_order", f"SELECT l_suppkey, site, min(pos) AS first_at FROM {_HITS} GROUP BY 1, 2")
def _(t):
    return grouping.merged(_hits(t).select("l_suppkey", "pos", "l_quantity", "site", "flag"), ["l_suppkey"], "pos", ["site"], ["flag"]).sites


def _diagnostics(t):
    """Events as diagnostics: an error's user is around it, other events have no symbol."""
    at = F.col("event_type") == "error"
    return t.events.select(F.col("event_type").alias("id"), F.col("event_id").alias("position"), F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("message"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.hour("ts").alias("line"), F.when(at, F.col("user_id").cast("string")).alias("symbol"))


def _causes(t):
    return grouping.distilled(_diagnostics(t), t.nation.select(F.col("n_name").alias("symbol"), F.col("n_nationkey").alias("position")))


@query("agg_17_causes", """
WITH c AS (SELECT event_type AS id, count(*) AS n, arg_min(event_type || ' ' || event_id, event_id) AS message, count(DISTINCT user_id) AS users, arg_min(CAST(user_id AS VARCHAR), event_id) AS first_user FROM events GROUP BY 1),
s AS (SELECT c.*, (SELECT count(*) FROM nation) AS fallback, (SELECT arg_min(n_name, n_nationkey) FROM nation) AS first_changed FROM c)
SELECT id, n, message, CASE WHEN id = 'error' THEN first_user ELSE first_changed END AS affected, CASE WHEN id = 'error' THEN 'diagnostic origin' ELSE 'changed by this patch' END AS inspected,
  CASE WHEN id = 'error' THEN users ELSE fallback END AS inspections, greatest(n - CASE WHEN id = 'error' THEN users ELSE fallback END, 0) AS suppressed FROM s""")
def _(t):
    return _causes(t).causes


@query("agg_17_first_sites", """
WITH d AS (SELECT event_type AS id, 'u' || user_id AS file, CAST(hour(ts) AS INTEGER) AS line, min(event_id) AS first_at FROM events GROUP BY 1, 2, 3)
SELECT id, file, line, CAST(row_number() OVER (PARTITION BY id ORDER BY first_at, file, line) AS INTEGER) AS place FROM d QUALIFY place <= 3""")
def _(t):
    return _causes(t).sites


@query("agg_18_leaves", f"""
WITH g AS (SELECT l_suppkey, l_shipdate, min(pos) AS "at", count(*) AS n, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS l_returnflag, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS l_linestatus FROM {_HITS} GROUP BY 1, 2)
SELECT *, min("at") OVER (PARTITION BY l_suppkey) AS outer_at, concat_ws(',', CASE WHEN l_returnflag IS NOT NULL THEN 'l_returnflag' END, CASE WHEN l_linestatus IS NOT NULL THEN 'l_linestatus' END) AS hoisted FROM g""")
def _(t):
    got = grouping.grouped(_hits(t).select("l_suppkey", "l_shipdate", "pos", "l_returnflag", "l_linestatus"), "l_suppkey", "l_shipdate", "pos", ["l_returnflag", "l_linestatus"])
    return got.leaves.withColumn("hoisted", F.array_join("hoisted", ","))


@query("agg_18_header", "SELECT o_orderstatus, 'orders' AS source, TRUE AS flat, CAST(1 AS BIGINT) AS groups, CAST(1 AS BIGINT) AS leaves FROM (SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    rows = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus", F.lit("orders").alias("source"))
    return grouping.grouped(rows, "o_orderstatus", "source", "o_orderkey", []).header


@query("agg_19_rest", """
WITH u AS (SELECT o_custkey, count(DISTINCT o_orderstatus) = 1 AND count(*) > 1 AS s, count(DISTINCT o_orderpriority) = 1 AND count(*) > 1 AS p FROM orders GROUP BY 1)
SELECT o_orderkey, o_custkey, CASE WHEN NOT s THEN o_orderstatus END AS o_orderstatus, CASE WHEN NOT p THEN o_orderpriority END AS o_orderpriority FROM orders JOIN u USING (o_custkey)""")
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return grouping.hoisted(rows, ["o_custkey"], ["o_orderstatus", "o_orderpriority"], least=2).rest


@query("agg_21_required_level", """
SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' AND lvl >= 2 THEN greatest(lvl, 4) ELSE lvl END AS INTEGER) AS level FROM (
  SELECT o_orderkey, o_orderstatus, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 2 WHEN '3' THEN 2 ELSE 3 END AS lvl FROM orders)""")
def _(t):
    digit = F.left("o_orderpriority", F.lit(1))
    kind = F.when(digit == "1", "trivia").when(digit == "2", "body").when(digit == "3", "added").otherwise("signature")
    return t.orders.select("o_orderkey", scalars.required_level(F.array(F.lit("trivia"), kind), F.col("o_orderstatus") == "F").alias("level"))


@query("agg_22_text_only", "SELECT CAST(sum(CASE WHEN contains(text, 'License') THEN 1 ELSE 0 END) AS BIGINT) AS matches FROM documents")
def _(t):
    return metrics.text_only_matches(t.documents, "text", "License")


@query("flt_09_date_range", "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-06'")
def _(t):
    return t.events.where(grammar.between_days(F.col("ts"), "2024-01-03", "2024-01-05")).select("event_id", "event_type")


@query("flt_10_task_list", "SELECT event_id FROM events WHERE CAST(user_id AS VARCHAR) IN ('3', '7')")
def _(t):
    return t.events.where(grammar.task_filter(F.col("user_id").cast("string"), ["3", "7"])).select("event_id")


@query("flt_11_session_scope", "SELECT event_id, event_type FROM events WHERE user_id = 8")
def _(t):
    return grammar.in_session(t.events.withColumnRenamed("user_id", "session_id"), "8").select("event_id", "event_type")


@query("set_01_union_all", "SELECT user_id AS id, 'event' AS log FROM events UNION ALL SELECT o_custkey, 'order' FROM orders")
def _(t):
    return metrics.labelled_union({"event": t.events.select(F.col("user_id").alias("id")), "order": t.orders.select(F.col("o_custkey").alias("id"))}, "log")


@query("set_05_distinct_key", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def _(t):
    return relational.first_by(t.events, ["user_id", "event_type"], F.col("event_id")).select("user_id", "event_type", "event_id")


@query("inc_06_ingest_once", "SELECT event_id, event_type FROM events")
def _(t):
    log = t.events.where("event_id % 2 = 0").select("event_id", "event_type")
    again = t.events.select("event_id", "event_type")
    return incremental.ingest_once(log, again.unionByName(again.where("event_id % 5 = 0")), "event_id")


@query("src_13_payload", """
SELECT event_type AS tool_name, CAST(event_id AS VARCHAR) AS tool_use_id, CASE WHEN event_id % 3 <> 0 THEN 'f' || user_id END AS file_path, CASE WHEN event_id % 3 = 1 THEN NULL ELSE '{"n":' || user_id || '}' END AS tool_response
FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0""")
def _(t):
    # a seventh of the payloads is cut short, a fifth names its tool by a number
    i = F.col("event_id")
    name = F.when(i % 5 == 0, F.lit("17")).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    given = F.when(i % 3 == 0, F.lit('"none"')).otherwise(F.concat(F.lit('{"file_path": "f'), "user_id", F.lit('", "command": 5}')))
    answer = F.when(i % 3 == 1, F.lit("")).otherwise(F.concat(F.lit(', "tool_response": {"n": '), "user_id", F.lit("}")))
    text = F.concat(F.lit('{"tool_name": '), name, F.lit(', "tool_use_id": "'), i.cast("string"), F.lit('", "tool_input": '), given, answer, F.when(i % 7 == 0, "").otherwise("}"))
    return tables.parse_hook(t.events.select(text.alias("value"))).select("tool_name", "tool_use_id", "file_path", "tool_response")


@query("src_12_event_lines", "SELECT event_type AS tool_name, CAST(event_id AS VARCHAR) AS tool_use_id FROM events WHERE event_id % 4 <> 0")
def _(t):
    raw = t.events.select(F.to_json(F.struct(F.col("event_type").alias("tool_name"), F.when(F.col("event_id") % 4 != 0, F.col("event_id").cast("string")).alias("tool_use_id"))).alias("value"))
    return tables.parse_payload(raw).select("tool_name", "tool_use_id")


@query("src_12_line_log", "SELECT event_type AS tool_name, CAST(event_id AS VARCHAR) AS tool_use_id, CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE 'words' END AS estimator, CAST(user_id AS INTEGER) AS request_tokens FROM events WHERE event_id % 4 <> 0")
def _(t):
    # the log is written by tasks, as listeners on many machines would, and read as a stream
    i, folder, out, marks = F.col("event_id"), *(store.shared_folder(t.spark, kind) for kind in ("lines", "calls", "marks"))
    fields = F.struct(F.col("event_type").alias("toolName"), F.when(i % 4 != 0, i.cast("string")).alias("toolUseId"), F.when(i % 3 != 0, "words").alias("estimator"), F.col("user_id").alias("requestTokens"))
    lines.append_calls(t.events.select(F.to_json(fields).alias("value")), folder)
    ingest.append_log(lines.stream_calls(t.spark, folder), out, marks).awaitTermination()
    calls = t.spark.read.schema(lines.SCHEMA).parquet(out)
    return calls.dropDuplicates(["tool_use_id"]).select("tool_name", "tool_use_id", "estimator", "request_tokens")


@query("win_06_islands", """
WITH d AS (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS line FROM events WHERE event_type = 'signup'),
g AS (SELECT *, line - row_number() OVER (PARTITION BY user_id ORDER BY line) AS g FROM d)
SELECT user_id, CAST(min(line) AS INTEGER) AS "start", CAST(max(line) AS INTEGER) AS "end" FROM g GROUP BY user_id, g""")
def _(t):
    rows = t.events.where("event_type = 'signup'").select("user_id", F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("line"))
    return relational.islands(rows, ["user_id"], "line")


@query("win_07_running_shift", "SELECT event_id, CAST(coalesce(sum(CAST(round(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM events")
def _(t):
    rows = t.events.select("event_id", "user_id", F.expr("cast(round(value) AS bigint)").alias("delta"))
    return relational.shifted(rows, ["user_id"], "event_id", "delta").select("event_id", "shift")


@query("fn_01_chars4", f"SELECT conv_id, turn, CAST({_CHARS} AS BIGINT) AS tokens FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", scalars.chars4(F.col("text")).alias("tokens"))
