"""Structured Streaming: idempotent ingest of call events and the roll-up by tool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources import tables


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-12: JSON lines that land in a folder, parsed; payloads without a tool or a call id go."""
    return tables.parse_payload(spark.readStream.text(folder))


def metered(payloads: DataFrame, time: str = "received") -> DataFrame:
    """Tokens of both directions."""
    return payloads.withColumns({"request_tokens": scalars.chars4(F.col("request")), "response_tokens": scalars.chars4(F.col("response")), time: F.current_timestamp()})


def once(events: DataFrame, key: str = "tool_use_id", time: str = "received", delay: str = "1 hour") -> DataFrame:
    """INC-6: each call once within the delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def by_tool(events: DataFrame) -> DataFrame:
    """AGG-8 over a stream."""
    return events.groupBy("tool_name").agg(F.count("*").alias("calls"), F.sum("response_tokens").alias("tokens"))


def append_log(events: DataFrame, path: str, checkpoint: str):
    """Appends what has arrived to the event table and ends."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
