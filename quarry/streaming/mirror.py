"""A stream of changed symbols kept in a store together with their index, each batch as one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.term_index import TermIndex
from ..sources.store import Store, kept

COLUMNS = "key string, seq long, digest string, terms array<string>, removed boolean"


class Mirror:
    """INC-3, INC-7: the symbols that changes (COLUMNS) leave, and the index of their terms.

    Changes are appended, and of a key the one with the largest seq holds (ties: the greatest digest); one
    that comes late under a smaller or equal seq changes nothing. A batch reads the keys it names and writes
    what it changes; log, index and the batch's number are one commit, so a batch that is run again, as a
    whole or after a crash at any step, counts once. What comes in while the tables are being loaded waits
    in the source until the stream goes on from its checkpoint. Changes without key or seq are left out;
    null terms are none; removed may be null for no. compact() keeps the last change of each key.
    """

    def __init__(self, store: Store, name: str = "mirror") -> None:
        self.store, self.name, self.log, self.index = store, name, f"{name}_log", TermIndex(store, name)
        store.schemas[self.log] = StructType.fromDDL(COLUMNS)

    @staticmethod
    def _last(changes: DataFrame) -> DataFrame:
        return changes.groupBy("key").agg(F.max(F.struct("seq", "digest", "terms", "removed")).alias("_c")).select("key", "_c.*")

    def apply(self, changes: DataFrame, number: int) -> bool:
        """One batch; False where it or a later one has been committed."""
        step = self.store.begin()
        if step.state["batches"].get(self.name, -1) >= number:
            return False
        terms, gone = F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), F.coalesce("removed", F.lit(False)).alias("removed")
        new = kept(self._last(changes.where("key IS NOT NULL AND seq IS NOT NULL").select("key", "seq", "digest", terms, gone)))
        old = self._last(step.read(self.log).join(new.select("key"), "key", "left_semi"))
        both = new.join(old.select("key", *[F.col(c).alias(f"_{c}") for c in old.columns if c != "key"]), "key", "left")
        both = kept(both.where("_seq IS NULL OR seq > _seq"))
        there, is_ = F.coalesce(~F.col("_removed"), F.lit(False)), ~F.col("removed")
        same = there & is_ & F.col("digest").eqNullSafe(F.col("_digest"))
        step.append(self.log, both.select("key", "seq", "digest", F.when(same, F.col("_terms")).otherwise(F.col("terms")).alias("terms"), "removed"))
        self.index.refresh(step, both.where(there & ~same).select("key", F.col("_terms").alias("terms")), both.where(is_ & ~same).select("key", "terms"))
        return step.commit((self.name, number))

    def start(self, changes: DataFrame, checkpoint: str):
        """Applies all that has come in since the checkpoint, and ends."""
        return changes.writeStream.foreachBatch(lambda df, number: self.apply(df, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def current(self) -> DataFrame:
        """key, seq, digest, terms of the symbols that are there."""
        return self._last(self.store.read(self.log)).where("NOT removed").drop("removed")

    def compact(self) -> None:
        """The last change of each key, removals too, and an index without what is dead, in one commit."""
        step = self.store.begin()
        step.replace(self.log, self._last(step.read(self.log)))
        self.index.compact(step)
        step.commit()
