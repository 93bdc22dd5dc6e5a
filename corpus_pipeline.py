"""A corpus pipeline: toxic documents go, then those of low quality, then near copies; the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents, whatever other columns
there are. A null text counts as an empty one; rows without labels or without a doc_id are judged like
all others; repeated rows are one document to the third stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import common, near_dup, packing, quality, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents with a score of 0.5 or more go."""
    return toxicity.without_toxic(docs, common.table(spark, sf_dir, "labels"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents with a score below 0.5 go."""
    return quality.only_good(docs, common.table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of near copies the document with the smallest doc_id stays."""
    return near_dup.one_of_each(docs)


#: Words of a generation that packing remembers here: earlier stages have left the executor a full heap beside its workers.
MEMO = 150_000


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one row per piece with its place in a sequence of 2048 tokens."""
    return packing.pack_documents(docs, memo=MEMO)


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_dedup", drop_copies), ("packing", pack)]

#: Models and tokens can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
