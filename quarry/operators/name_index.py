"""A trigram index of names kept in a store, for many substring and near-name queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.store import Store, Transaction, kept

#: Characters of a gram.
GRAM = 3
#: What stands before and after a name in the index, so that its ends have grams of their own.
EDGE = "\x01\x01"
#: Pairs of a name and a query, about, that a slice of a gram compares.
PAIRS = 1_000_000


def grams(text: Column) -> Column:
    """The positional trigrams of a text as structs (at, gram), from 0; none below three characters."""
    last = F.length(text) - GRAM
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.struct(k.alias("at"), F.substring(text, k + 1, F.lit(GRAM)).alias("gram")))).otherwise(F.array().cast("array<struct<at:int,gram:string>>"))


def tolerance(text: Column) -> Column:
    """The edit distance up to which a name is near: a quarter of its length, 1 to 3."""
    return F.least(F.greatest(F.floor(F.length(text) / 4), F.lit(1)), F.lit(3)).cast("int")


class NameIndex:
    """TXT-5, TXT-8, TXT-11: names (key of type kind, name) by their positional trigrams, whatever their case.

    Grams lie in files ranged and sorted by gram. Queries (query; distinct) come as a table and meet the
    grams in joins: a substring by its rarest trigram alone, a near name by one more disjoint trigrams than
    there may be edits, the rarest; candidates are verified by the text itself, so answers equal a full scan.
    """

    def __init__(self, store: Store, name: str, kind: str = "string") -> None:
        self.store, self.names, self.grams, self.counts = store, f"{name}_names", f"{name}_grams", f"{name}_counts"
        schemas = {self.names: f"key {kind}, name string", self.grams: f"gram string, at int, size int, key {kind}", self.counts: "gram string, n long"}
        store.schemas.update({k: StructType.fromDDL(v) for k, v in schemas.items()})

    def build(self, step: Transaction, names: DataFrame) -> None:
        """The index of names (key, name; one row a key); rows without a name are left out."""
        known = names.where("key IS NOT NULL AND name IS NOT NULL").select("key", "name")
        padded = F.concat(F.lit(EDGE), F.lower("name"), F.lit(EDGE))
        rows = known.select("key", F.length(F.lower("name")).alias("size"), F.explode(grams(padded)).alias("g")).select("g.gram", "g.at", "size", "key")
        step.replace(self.names, known)
        step.replace(self.grams, rows.repartitionByRange("gram").sortWithinPartitions("gram", "key"))
        step.replace(self.counts, rows.groupBy("gram").agg(F.count("*").alias("n")).orderBy("gram"))

    def holding_candidates(self, queries: DataFrame) -> DataFrame:
        """query, key: names that have the rarest trigram of each query; a query with a trigram of no name has none."""
        own = queries.where(F.length("query") >= GRAM).select("query", F.explode(grams(F.lower("query"))).alias("g")).select("query", "g.gram").distinct()
        rare = own.join(self.store.read(self.counts), "gram", "left").groupBy("query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
        rare = rare.where("best.n > 0").select("query", F.col("best.gram").alias("gram"))
        return self.store.read(self.grams).join(rare, "gram").select("query", "key").distinct()

    def holding(self, queries: DataFrame, limit: int) -> DataFrame:
        """TXT-5: query, key, name, rank, nth: for each query the first limit names that hold it: itself, then prefixes, then the shortest, by name.

        Queries below three characters have no trigram; every name is read for those.
        """
        names = self.store.read(self.names)
        found = self.holding_candidates(queries).join(names, "key").where(F.contains(F.lower("name"), F.lower("query")))
        short = F.broadcast(queries.where(F.length("query") < GRAM).agg(F.collect_set("query").alias("_short")))  # as many as there are strings of two characters at most
        every = names.join(short).select("key", "name", F.explode(F.filter("_short", lambda q: F.contains(F.lower("name"), F.lower(q)))).alias("query"))
        both = found.select("query", "key", "name").unionByName(every.select("query", "key", "name"))
        rank = F.when(F.col("name") == F.col("query"), 0).when(F.startswith(F.lower("name"), F.lower("query")), 1).otherwise(2)
        best = Window.partitionBy("query").orderBy("rank", F.length("name"), "name", "key")
        return both.withColumn("rank", rank).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= limit)

    def near_grams(self, queries: DataFrame) -> DataFrame:
        """query, length, k, at, gram, n: one more disjoint trigrams of each query than its tolerance k, those that fewest names hold, and how many do.

        An edit breaks one of disjoint trigrams at most, so a near name holds one of them. The grams of a
        query that are three places apart are disjoint; of those from 0, 1 or 2 on the rarest are taken.
        """
        lower = F.lower("query")
        own = queries.where(F.length("query") >= GRAM).select("query", F.length(lower).alias("length"), tolerance(F.col("query")).alias("k"), F.explode(grams(F.concat(F.lit(EDGE), lower, F.lit(EDGE)))).alias("g"))
        known = own.select("query", "length", "k", "g.at", "g.gram").join(self.store.read(self.counts), "gram", "left")
        apart = known.groupBy("query", "length", "k", F.col("at") % GRAM).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "gram"))).alias("all"))
        some = apart.where(F.size("all") > F.col("k")).withColumn("some", F.slice("all", F.lit(1), F.col("k") + 1))
        cost = F.aggregate("some", F.lit(0).cast("long"), lambda x, g: x + g.n)
        least = some.groupBy("query", "length", "k").agg(F.min(F.struct(cost.alias("cost"), "some")).alias("best"))
        return least.select("query", "length", "k", F.explode("best.some").alias("g")).select("query", "length", "k", "g.at", "g.gram", "g.n").where("n > 0")

    def near(self, queries: DataFrame, limit: int) -> DataFrame:
        """TXT-8: query, key, name, distance, nth: for each query the first limit names within its tolerance, the nearest first, then the shortest, by name.

        A gram's names and queries are dealt into slices of about PAIRS pairs, so a frequent gram is many groups; pairs
        are verified where they meet, and only near ones are shuffled.
        """
        asked = kept(self.near_grams(queries))
        slices = asked.groupBy("gram").agg(F.ceil(F.count("*") * F.max("n") / PAIRS).cast("int").alias("slices"))
        posted = self.store.read(self.grams).join(slices, "gram").join(self.store.read(self.names), "key")
        posted = posted.select("gram", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("at").alias("_at"), "size", "key", "name")
        asked = asked.join(slices, "gram").withColumn("slice", F.pmod(F.xxhash64("query"), "slices").cast("int"))
        # edits before the gram shift it by as many places at least, those behind it what follows
        moved = F.abs(F.col("at") - F.col("_at")) + F.abs(F.col("length") - F.col("at") - F.col("size") + F.col("_at"))
        found = posted.join(asked, ["gram", "slice"]).where(moved <= F.col("k")).withColumn("distance", F.levenshtein(F.lower("name"), F.lower("query"), 3))
        found = found.where((F.col("distance") >= 0) & (F.col("distance") <= F.col("k"))).select("query", "key", "name", "distance").distinct()
        best = Window.partitionBy("query").orderBy("distance", F.length("name"), "name", "key")
        return found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= limit)

    def did_you_mean(self, queries: DataFrame, limit: int) -> DataFrame:
        """TXT-11: query, key, name, nth: names that hold each query; near names of the queries that none holds."""
        held = self.holding(queries, limit).select("query", "key", "name", "nth")
        others = queries.join(held.select("query").distinct(), "query", "left_anti")
        return held.unionByName(self.near(others, limit).select("query", "key", "name", "nth"))
