"""Ranked search and text scores over part names and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import metrics, name_index, ranking, relational, term_index
from ..sources import store
from .registry import query

_NAMES = "(SELECT DISTINCT p_name || '_' || p_type AS name FROM part)"
_STOP = ", ".join(f"'{w}'" for w in scalars.STOPWORDS)
_TOKENS = f"list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)), lambda x: length(x) >= 2 AND x NOT IN ({_STOP}))"
_INDEX = "(SELECT p_partkey AS id, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS term FROM part)"


_SYMBOLS = """(SELECT p_partkey AS symbol_id, 'Ns.' || p_type || '.' || replace(p_name, ' ', '_') || '(' || p_size || ')' AS fq_name, p_brand AS kind, CASE WHEN p_size % 2 = 0 THEN 'source' ELSE 'external' END AS origin FROM part)"""


def _symbols(t):
    name = F.concat(F.lit("Ns."), "p_type", F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("("), "p_size", F.lit(")"))
    origin = F.when(F.col("p_size") % 2 == 0, "source").otherwise("external")
    return t.part.select(F.col("p_partkey").alias("symbol_id"), name.alias("fq_name"), F.col("p_brand").alias("kind"), F.array(F.lower("p_type")).alias("modifiers"), origin.alias("origin"))


_BM25 = """
p AS (SELECT id, term, count(*) AS tf FROM {index} GROUP BY 1, 2), l AS (SELECT id, count(*) AS len FROM {index} GROUP BY 1),
h AS (SELECT q, id, sum(tf) AS tf FROM p, (VALUES {terms}) v(q) WHERE starts_with(term, q) GROUP BY 1, 2),
d AS (SELECT q, count(*) AS df FROM h GROUP BY 1), n AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
scores AS (SELECT id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM h JOIN d USING (q) JOIN l USING (id), n GROUP BY id)"""


def _search_sql(k: int, text: str, terms: str, take: int) -> str:
    """Tables of one ranked search over x (id, term) and ok (symbol_id, fq_name); the last is t and its number."""
    return f"""
p{k} AS (SELECT id, term, count(*) AS tf FROM x GROUP BY 1, 2), l{k} AS (SELECT id, count(*) AS len FROM x GROUP BY 1), h{k} AS (SELECT q, id, sum(tf) AS tf FROM p{k}, (VALUES {terms}) v(q) WHERE starts_with(term, q) GROUP BY 1, 2),
d{k} AS (SELECT q, count(*) AS df FROM h{k} GROUP BY 1), n{k} AS (SELECT count(*) AS n, avg(len) AS mean FROM l{k}),
b{k} AS (SELECT id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM h{k} JOIN d{k} USING (q) JOIN l{k} USING (id), n{k} GROUP BY id),
m{k} AS (SELECT symbol_id, fq_name, 0 AS f, CASE WHEN fq_name = '{text}' THEN 0 WHEN starts_with(lower(fq_name), '{text}') THEN 1 ELSE 2 END AS rank, -score AS s FROM b{k} JOIN ok ON ok.symbol_id = id
  UNION ALL SELECT symbol_id, fq_name, 1, CASE WHEN fq_name = '{text}' THEN 0 WHEN starts_with(lower(fq_name), '{text}') THEN 1 ELSE 2 END, 0 FROM ok WHERE contains(lower(fq_name), '{text}')),
u{k} AS (SELECT * FROM m{k} QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY f, rank) = 1),
t{k} AS (SELECT {k} AS t, symbol_id, fq_name, row_number() OVER (ORDER BY f, rank, round(s, 9), length(fq_name), fq_name, symbol_id) AS nth FROM u{k} QUALIFY nth <= {take})"""


def _names(t):
    return t.part.select(F.concat_ws("_", "p_name", "p_type").alias("name")).distinct()


def _index(t):
    return ranking.postings(t.part, "p_partkey", F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "))


@query("txt_01_index_terms", "SELECT p_partkey, array_to_string(list_distinct_ordered, '|') AS terms FROM (SELECT p_partkey, [lower(s1) || 'widget' || p_size] || [lower(s1), 'widget' || p_size] AS list_distinct_ordered FROM (SELECT p_partkey, p_size, string_split(p_name, ' ')[1] AS s1 FROM part))")
def _(t):
    camel = F.concat(F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit("Widget"), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", F.array_join(scalars.index_terms(camel), "|").alias("terms"))


@query("txt_02_prefix_terms", "SELECT p_partkey, array_to_string(list_filter([string_split(p_name, ' ')[1], string_split(p_name, ' ')[2], CASE WHEN list_contains(string_split(p_name, ' '), lower(p_type)) THEN NULL ELSE lower(p_type) END], lambda x: x IS NOT NULL), '|') AS terms FROM part")
def _(t):
    text = F.concat(F.upper("p_name"), F.lit("! a::"), "p_type", F.lit(" x-"), "p_type")
    return t.part.select("p_partkey", F.array_join(scalars.query_terms(text), "|").alias("terms"))


@query("txt_03_query_segments", "SELECT p_partkey, array_to_string(string_split(p_name, ' '), '|') AS segments FROM part")
def _(t):
    return t.part.select("p_partkey", F.array_join(scalars.segments(F.regexp_replace("p_name", " ", "::")), "|").alias("segments"))


@query("txt_04_bm25", f"""WITH {_BM25.format(index=_INDEX, terms="('red'), ('wid')")} SELECT id AS p_partkey, round(score, 6) AS score FROM scores""")
def _(t):
    return ranking.bm25(_index(t), "p_partkey", ["red", "wid"]).select("p_partkey", F.round("score", 6).alias("score"))


@query("srt_01_promoted", f"""WITH {_BM25.format(index=_INDEX, terms="('red'), ('widget')")}
SELECT p_partkey, round(score, 6) AS score FROM scores JOIN part ON p_partkey = id
ORDER BY CASE WHEN p_name || ' ' || p_partkey = 'red widget 1' THEN 0 WHEN starts_with(p_name || ' ' || p_partkey, 'red widget 1') THEN 1 ELSE 2 END, round(score, 6) DESC, length(p_name || ' ' || p_partkey), p_name || ' ' || p_partkey LIMIT 30""")
def _(t):
    names = t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_partkey").alias("name"))
    hits = names.join(ranking.bm25(_index(t), "p_partkey", ["red", "widget"]), "p_partkey").withColumn("score", F.round("score", 6))
    return ranking.promoted(hits, "name", "red widget 1", 30).select("p_partkey", "score")


@query("txt_05_substring_rank", f"SELECT name, CAST(CASE WHEN name = 'red' THEN 0 WHEN name ILIKE 'red%' THEN 1 ELSE 2 END AS INTEGER) AS rank FROM {_NAMES} WHERE name ILIKE '%red%' ORDER BY 2, length(name), name LIMIT 20")
def _(t):
    return ranking.search_like(_names(t), "name", "red", 20)


@query("txt_06_top_up", f"""
WITH a AS (SELECT name, 1 AS rank, 0 AS f FROM {_NAMES} WHERE starts_with(name, 'red')), b AS (SELECT name, CASE WHEN name ILIKE 'red%' THEN 1 ELSE 2 END AS rank, 1 AS f FROM {_NAMES} WHERE name ILIKE '%red%'),
c AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY f, rank) AS rn FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT name, CAST(rank AS INTEGER) AS rank FROM c WHERE rn = 1 ORDER BY f, rank, length(name), name LIMIT 60""")
def _(t):
    first = _names(t).where(F.col("name").startswith("red")).withColumn("rank", F.lit(1))
    return ranking.topped_up(first, ranking.search_like(_names(t), "name", "red", 60), "name", 60)


@query("txt_07_term_floors", f"""
WITH h AS (SELECT DISTINCT id, q, seq, length(term) AS rank FROM {_INDEX}, (VALUES ('red', 1), ('blu', 2), ('bolt', 3)) v(q, seq) WHERE starts_with(term, q)),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank, id) AS rn FROM h),
o AS (SELECT *, CASE WHEN rn <= 4 THEN seq ELSE 4 END AS turn FROM r), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn, rn, rank, id) AS one FROM o)
SELECT id AS p_partkey, CAST(row_number() OVER (ORDER BY turn, CASE WHEN turn < 4 THEN rn END NULLS FIRST, rank, id) - 1 AS INTEGER) AS place FROM f WHERE one = 1 ORDER BY place LIMIT 12""")
def _(t):
    index, hits = _index(t), None
    for q in ("red", "blu", "bolt"):
        one = index.where(F.col("term").startswith(q)).select("p_partkey", F.lit(q).alias("q"), F.length("term").alias("rank")).distinct()
        hits = one if hits is None else hits.unionByName(one)
    return relational.floor_share(hits, "q", "p_partkey", 12, ["red", "blu", "bolt"], F.col("rank"), F.col("p_partkey")).select("p_partkey", "place")


@query("txt_17_search", f"""
WITH s AS {_SYMBOLS}, x AS (SELECT symbol_id AS id, unnest(list_distinct(['ns', lower(split_part(fq_name, '.', 2)), string_split(split_part(split_part(fq_name, '.', 3), '(', 1), '_')[1], string_split(split_part(split_part(fq_name, '.', 3), '(', 1), '_')[2], rtrim(split_part(fq_name, '(', 2), ')')])) AS term FROM s),
ok AS (SELECT symbol_id, fq_name FROM s WHERE origin = 'source' AND lower(kind) NOT IN ('brand#2')),
{", ".join(_search_sql(*x) for x in ((0, "ring", "('ring')", 10), (1, "olt", "('olt')", 10), (2, "ring olt", "('ring'), ('olt')", 20)))},
every AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2), once AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY t, nth) = 1)
SELECT CAST(row_number() OVER (ORDER BY t, nth) - 1 AS INTEGER) AS place, fq_name FROM once ORDER BY place LIMIT 20""")
def _(t):
    return ranking.search(_symbols(t), "ring olt", 20, kinds="-brand#2").select("place", "fq_name")


@query("txt_08_near_names", f"SELECT fq_name, CAST(levenshtein(lower(split_part(split_part(fq_name, '.', 3), '(', 1)), 'red_wigdt') AS INTEGER) AS distance FROM {_SYMBOLS} WHERE origin = 'source' AND levenshtein(lower(split_part(split_part(fq_name, '.', 3), '(', 1)), 'red_wigdt') <= 2 ORDER BY 2, length(fq_name), fq_name LIMIT 10")
def _(t):
    return ranking.near_names(_symbols(t), "fq_name", "Red_wigdt", 10).select("fq_name", "distance")


@query("txt_09_edit_distance", "SELECT p_partkey, CAST(levenshtein(lower(p_name), lower(p_type)) AS INTEGER) AS distance FROM part")
def _(t):
    return t.part.select("p_partkey", F.levenshtein(F.lower("p_name"), F.lower("p_type")).alias("distance"))


@query("txt_10_nearest_token", """
WITH w(word) AS (VALUES ('clicks'), ('purchse'), ('sign_up'), ('erorr'), ('view'), ('nothinglike')), v AS (SELECT DISTINCT event_type AS token FROM events),
c AS (SELECT word, token, word = token AS same, CASE WHEN replace(word, '_', '') = replace(token, '_', '') OR regexp_replace(word, 's+$', '') = regexp_replace(token, 's+$', '') THEN 0 ELSE levenshtein(word, token) END AS distance FROM w, v),
b AS (SELECT word, min(distance) AS distance, bool_or(same) AS same FROM c GROUP BY 1)
SELECT word, min(token) AS token FROM c JOIN b USING (word, distance) WHERE NOT b.same GROUP BY word, distance HAVING count(*) = 1 AND distance <= least(greatest(length(min(token)) // 4, 1), 3)""")
def _(t):
    words = t.spark.createDataFrame([("clicks",), ("purchse",), ("sign_up",), ("erorr",), ("view",), ("nothinglike",)], "word string")
    return ranking.nearest_token(words, t.events.select(F.col("event_type").alias("token")).distinct())


@query("txt_11_did_you_mean", f"SELECT name FROM {_NAMES} WHERE contains(lower(name), 'widget_e') ORDER BY length(name), name LIMIT 15")
def _(t):
    return ranking.did_you_mean(_names(t), "name", "Widget_E", 15)


@query("txt_12_uncovered", f"SELECT term FROM (VALUES ('red'), ('zzz'), ('wid'), ('qqq')) v(term) WHERE NOT EXISTS (SELECT 1 FROM {_INDEX} i WHERE starts_with(i.term, v.term))")
def _(t):
    return ranking.uncovered_terms(t.spark.createDataFrame([("red",), ("zzz",), ("wid",), ("qqq",)], "term string"), _index(t))


@query("txt_13_log_score", f"""
SELECT doc_id, CAST(len(list_filter(tk, lambda x: x = 'license')) + CASE WHEN lang ILIKE '%en%' THEN 0 ELSE 0 END + CASE WHEN source ILIKE '%license%' THEN 3 ELSE 0 END + CASE WHEN lang = 'license' THEN 5 ELSE 0 END
  + len(list_filter(tk, lambda x: x = 'en')) + CASE WHEN source ILIKE '%en%' THEN 3 ELSE 0 END + CASE WHEN lang = 'en' THEN 5 ELSE 0 END AS DOUBLE) AS score
FROM (SELECT doc_id, lang, source, {_TOKENS} AS tk FROM documents)""")
def _(t):
    tokens = scalars.log_tokens(F.col("text"))
    count = lambda w: F.size(F.filter(tokens, lambda x: x == w))
    terms = F.create_map(F.lit("license"), count("license"), F.lit("en"), count("en"))
    entries = t.documents.select("doc_id", terms.alias("terms"), F.col("source").alias("title"), F.array("lang").alias("classes"), F.array().cast("array<string>").alias("tags"))
    return ranking.log_score(entries, ["license", "en"]).select("doc_id", "score")


@query("txt_14_log_tokens", f"SELECT doc_id, len({_TOKENS}) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(scalars.log_tokens(F.col("text"))).cast("long").alias("n"))


@query("agg_20_term_counts", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY 1, 2")
def _(t):
    return metrics.term_counts(t.documents, "doc_id", scalars.log_tokens(F.col("text")))


@query("txt_15_syntax_rank", """
SELECT p_partkey, CAST(CASE WHEN p_name = 'red ring' THEN 0 WHEN ends_with(p_type || '.' || p_name, '.red ring') THEN 1 WHEN starts_with(p_name, 'red ring') THEN 2 ELSE 3 END + CASE WHEN p_size > 25 THEN 10 ELSE 0 END AS INTEGER) AS rank
FROM part WHERE contains(p_name, 'red ring')""")
def _(t):
    rank = ranking.syntax_rank(F.col("p_name"), F.concat_ws(".", "p_type", "p_name"), "Red Ring", F.col("p_size") > 25)
    return t.part.select("p_partkey", rank.alias("rank")).where("rank IS NOT NULL")


@query("txt_16_shorter_rendering", """
WITH r AS (SELECT p_partkey, json_object('p_name', p_name, 'p_type', p_type)::VARCHAR AS a, json_object('x', p_name || '|' || p_type || CASE WHEN p_size % 2 = 0 THEN repeat('-', 20) ELSE '' END)::VARCHAR AS b FROM part)
SELECT p_partkey, CASE WHEN length(b) < length(a) THEN b ELSE a END AS rendered FROM r""")
def _(t):
    tail = F.when(F.col("p_size") % 2 == 0, "-" * 20).otherwise("")
    return ranking.shorter(t.part, F.struct("p_name", "p_type"), F.struct(F.concat("p_name", F.lit("|"), "p_type", tail).alias("x"))).select("p_partkey", "rendered")


@query("join_03_hits_to_symbols", f"SELECT DISTINCT p.p_partkey, p.p_brand FROM {_INDEX} i JOIN part p ON p.p_partkey = i.id WHERE starts_with(term, 'rin')")
def _(t):
    return relational.among(t.part, _index(t).where(F.col("term").startswith("rin")), "p_partkey").select("p_partkey", "p_brand")


@query("srt_03_nearest_top", f"SELECT DISTINCT split_part(fq_name, '(', 1) AS name FROM {_SYMBOLS} WHERE levenshtein(lower(split_part(split_part(fq_name, '.', 3), '(', 1)), 'blue_blt') <= 2 ORDER BY levenshtein(lower(split_part(name, '.', 3)), 'blue_blt'), length(name), name LIMIT 5")
def _(t):
    names = _symbols(t).select(F.substring_index("fq_name", "(", 1).alias("name")).distinct()
    return ranking.near_names(names, "name", "blue_blt", 5).select("name")


_NOW = "(SELECT p_partkey AS id, unnest(string_split(CASE WHEN p_size BETWEEN 20 AND 25 THEN 'gadget ' || lower(p_type) ELSE lower(p_name || ' ' || p_type) END, ' ')) AS term FROM part WHERE p_size <= 40)"


def _kept_index(t):
    """An index of the parts' words, built, then refreshed: small parts are new, large ones gone, some have other names."""
    own = store.Store(t.spark, store.shared_folder(t.spark, "index"), {})
    index, size = term_index.TermIndex(own, "part", t.part.schema["p_partkey"].dataType.simpleString()), F.col("p_size")
    first = t.part.select(F.col("p_partkey").alias("key"), "p_size", F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("terms"))
    other = t.part.select(F.col("p_partkey").alias("key"), "p_size", F.split(F.lower(F.concat_ws(" ", F.lit("gadget"), "p_type")), " ").alias("terms"))
    step = own.begin()
    index.build(step, first.where(size >= 10).drop("p_size"))
    step.commit()
    step = own.begin()
    index.refresh(step, first.where((size > 40) | size.between(20, 25)).drop("p_size"), first.where(size < 10).unionByName(other.where(size.between(20, 25))).drop("p_size"))
    step.commit()
    return index


@query("txt_18_kept_index", f"""WITH {_BM25.format(index=_NOW, terms="('red'), ('wid'), ('gad')")} SELECT id AS p_partkey, round(score, 6) AS score FROM scores""")
def _(t):
    return _kept_index(t).search(["red", "wid", "gad"]).select(F.col("key").alias("p_partkey"), F.round("score", 6).alias("score"))


@query("txt_18_kept_terms", f"SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM {_NOW} GROUP BY 1")
def _(t):
    index = _kept_index(t)
    return index.store.read(index.terms)


_LONG_NAMES = "(SELECT DISTINCT replace(p_name, ' ', '_') || '_' || p_type || p_size AS name FROM part)"
_HELD = "(SELECT DISTINCT substr(p_name, 3, 5) || 'X' AS query FROM part UNION SELECT DISTINCT upper(substr(replace(p_name, ' ', '_'), 2, 6)) FROM part UNION SELECT DISTINCT substr(p_type, 1, 2) FROM part UNION SELECT DISTINCT p_type || p_size FROM part)"
_MISSPELT = "(SELECT DISTINCT substr(name, 1, 3) || substr(name, 5, 4) || 'q' || substr(name, 9) AS query FROM (SELECT replace(p_name, ' ', '_') || '_' || p_type || p_size AS name FROM part))"


def _name_index(t):
    own = store.Store(t.spark, store.shared_folder(t.spark, "names"), {})
    index, step = name_index.NameIndex(own, "part"), own.begin()
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_type", "p_size")
    index.build(step, t.part.select(name.alias("key"), name.alias("name")).distinct())
    step.commit()
    return index


def _held(t):
    one = F.concat(F.substring("p_name", 3, 5), F.lit("X"))
    texts = F.array(one, F.upper(F.substring(F.replace("p_name", F.lit(" "), F.lit("_")), 2, 6)), F.substring("p_type", 1, 2), F.concat("p_type", "p_size"))
    return t.part.select(F.explode(texts).alias("query")).distinct()


@query("txt_19_names_holding", f"""
SELECT query, name, CAST(CASE WHEN name = query THEN 0 WHEN starts_with(lower(name), lower(query)) THEN 1 ELSE 2 END AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY query ORDER BY CASE WHEN name = query THEN 0 WHEN starts_with(lower(name), lower(query)) THEN 1 ELSE 2 END, length(name), name) AS INTEGER) AS nth
FROM {_HELD} JOIN {_LONG_NAMES} ON contains(lower(name), lower(query)) QUALIFY nth <= 7""")
def _(t):
    return _name_index(t).holding(_held(t), 7).select("query", "name", "rank", "nth")


@query("txt_19_names_near", f"""
SELECT query, name, CAST(levenshtein(lower(name), lower(query)) AS INTEGER) AS distance, CAST(row_number() OVER (PARTITION BY query ORDER BY levenshtein(lower(name), lower(query)), length(name), name) AS INTEGER) AS nth
FROM {_MISSPELT} JOIN {_LONG_NAMES} ON levenshtein(lower(name), lower(query)) <= least(greatest(length(query) // 4, 1), 3) QUALIFY nth <= 7""")
def _(t):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_type", "p_size")
    misspelt = t.part.select(name.alias("n")).select(F.concat(F.substring("n", 1, 3), F.substring("n", 5, 4), F.lit("q"), F.expr("substring(n, 9)")).alias("query")).distinct()
    return _name_index(t).near(misspelt, 7).select("query", "name", "distance", "nth")
