"""An inverted index kept in a store: postings in files ranged by term, refreshed by delta within a commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.store import Store, Transaction
from . import ranking


class TermIndex:
    """TXT-4, INC-3, INC-5: the index name over documents (key of type kind, terms).

    Postings lie in files ranged and sorted by term, so a search reads the row groups of its prefixes
    only. A refresh appends the postings of new and changed documents under the number of its commit, and
    says up to which number those of changed and removed ones are dead; frequencies of terms and lengths
    are updated by what changed. All is written through a transaction, so it counts together with the
    tables it mirrors. compact() drops what is dead.
    """

    def __init__(self, store: Store, name: str, kind: str = "string") -> None:
        self.store, self.postings, self.dead, self.terms, self.sums = store, f"{name}_postings", f"{name}_dead", f"{name}_terms", f"{name}_sums"
        schemas = {self.postings: f"term string, key {kind}, tf long, doc_len long, gen long", self.dead: f"key {kind}, upto long", self.terms: "term string, df long, tf long", self.sums: "documents long, length long"}
        store.schemas.update({k: StructType.fromDDL(v) for k, v in schemas.items()})

    @staticmethod
    def _rows(docs: DataFrame) -> DataFrame:
        """term, key, tf, doc_len of docs (key, terms); documents without terms have none."""
        return ranking.postings(docs, "key", F.col("terms")).select("term", "key", "tf", F.col("doc_len").cast("long").alias("doc_len"))

    @staticmethod
    def _ranged(rows: DataFrame) -> DataFrame:
        return rows.repartitionByRange("term").sortWithinPartitions("term", "key")

    def build(self, step: Transaction, docs: DataFrame) -> None:
        """The index of docs (key, terms; one row a key) in place of any before."""
        gen = F.lit(step.base + 1).cast("long")
        rows = self._rows(docs)
        step.replace(self.postings, self._ranged(rows.withColumn("gen", gen)))
        step.replace(self.dead, self.store.spark.createDataFrame([], self.store.schemas[self.dead]))
        step.replace(self.terms, rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).orderBy("term"))
        step.replace(self.sums, docs.where(F.size("terms") > 0).agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).cast("long").alias("length")))

    def refresh(self, step: Transaction, before: DataFrame, after: DataFrame) -> None:
        """before (key, terms): changed and removed documents as the index has them; after: changed and new ones as they are now."""
        gen = step.base + 1
        old, new = self._rows(before), self._rows(after)
        step.append(self.postings, self._ranged(new.withColumn("gen", F.lit(gen).cast("long"))))
        step.append(self.dead, before.select("key", F.lit(gen - 1).cast("long").alias("upto")))
        counted = lambda d, sign: d.select("term", F.lit(sign).cast("long").alias("df"), (sign * F.col("tf")).alias("tf"))
        moved = step.read(self.terms).unionByName(counted(old, -1)).unionByName(counted(new, 1))
        step.replace(self.terms, moved.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).where("df > 0").orderBy("term"))
        size = lambda d, sign: d.where(F.size("terms") > 0).select(F.lit(sign).cast("long").alias("documents"), (sign * F.size("terms")).cast("long").alias("length"))
        both = step.read(self.sums).unionByName(size(before, -1)).unionByName(size(after, 1))
        step.replace(self.sums, both.agg(F.sum("documents").alias("documents"), F.sum("length").alias("length")))

    def _live(self, postings: DataFrame, dead: DataFrame) -> DataFrame:
        upto = dead.groupBy("key").agg(F.max("upto").alias("upto"))
        return postings.join(upto, (postings["key"] == upto["key"]) & (F.col("gen") <= F.col("upto")), "left_anti")

    def compact(self, step: Transaction) -> None:
        """The same index without what is dead."""
        step.replace(self.postings, self._ranged(self._live(step.read(self.postings), step.read(self.dead))))
        step.replace(self.dead, self.store.spark.createDataFrame([], self.store.schemas[self.dead]))

    def hits(self, prefixes: list[str]) -> DataFrame:
        """q, key, doc_len, tf of the documents that hold words with these prefixes; one read for all of them."""
        any_of = F.lit(False)
        for q in prefixes:
            any_of = any_of | F.col("term").startswith(q)
        return ranking.prefix_hits(self._live(self.store.read(self.postings).where(any_of), self.store.read(self.dead)), "key", prefixes)

    def search(self, prefixes: list[str]) -> DataFrame:
        """key, score by BM25, of the documents that hold any word with one of these prefixes."""
        sums = self.store.read(self.sums).select("documents", (F.col("length") / F.col("documents")).alias("mean_length"))
        return ranking.weighed(self.hits(prefixes), "key", sums)

    def uncovered(self, terms: DataFrame) -> DataFrame:
        """TXT-12: the query terms that begin no term of the index, by its list of terms alone."""
        return ranking.uncovered_terms(terms, self.store.read(self.terms))

    def repaired(self, docs: DataFrame, step: Callable[[], Transaction] | None = None) -> bool:
        """INC-5: builds the index anew where its number of documents isn't that of docs; whether it did."""
        known = self.store.read(self.sums).agg(F.sum("documents")).first()[0]
        if known == docs.where(F.size("terms") > 0).count():
            return False
        own = (step or self.store.begin)()
        self.build(own, docs)
        return own.commit()
