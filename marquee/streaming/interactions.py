"""Interaction stream: landing, staging, deduplication, merging and dead letters.

The transformations are the batch ones, applied to a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marquee.functions.instants import parse_instant
from marquee.operators.marts import merge_by_index
from marquee.operators.quality import check_freshness
from marquee.operators.staging import MESSAGE_FIELDS, message_fields, stage_interactions, valid_messages

REQUIRED_FIELDS = ["event_id", "user_id", "direction", "swiped_at"]


def decode_envelopes(stream: DataFrame, subscription: str) -> DataFrame:
    """Broker rows (message_id, publish_time, data as bytes, attributes as a map) -> the raw table's columns.

    Bytes that are not UTF-8 are replaced, so no message is lost.
    """
    return stream.select(
        F.lit(subscription).alias("subscription_name"), "message_id", F.col("publish_time").cast("timestamp"),
        F.make_valid_utf8(F.col("data").cast("string")).alias("data"),
        F.to_json("attributes").alias("attributes"))


def _finite(writer, available_now: bool):
    return writer.trigger(availableNow=True) if available_now else writer


def land_envelopes(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Raw table in day partitions. The file sink with its checkpoint writes every message once."""
    dated = stream.withColumn("publish_date", F.to_date("publish_time"))
    writer = (dated.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
              .partitionBy("publish_date").outputMode("append"))
    return _finite(writer, available_now).start()


stream_land = land_envelopes


def stream_stage(stream: DataFrame) -> DataFrame:
    """Typed valid interactions of a stream of envelopes."""
    return valid_messages(stage_interactions(stream))


def stream_dedupe(stream: DataFrame, delay: str = "3 days") -> DataFrame:
    """Drops redeliveries of a message inside the delay.

    The first delivery stays, while the fact keeps the latest; both are the same message.
    """
    timed = stream.withColumn("ingestion_timestamp", F.col("ingestion_timestamp").cast("timestamp"))
    return timed.withWatermark("ingestion_timestamp", delay).dropDuplicatesWithinWatermark(["interaction_id"])


def stream_merge_fact(stream: DataFrame, target: str, catalog: DataFrame | Callable[[], DataFrame], checkpoint: str, staging: str,
                      available_now: bool = True) -> StreamingQuery:
    """Merges every micro-batch of staged interactions into the stored fact.

    A batch that is retried finishes what it left and changes nothing it already did. A function as `catalog` is asked for
    every batch, so that a running stream sees new events. Arrivals may be of any age: the table's version index tells which
    days hold older versions, so a stray old row makes a batch read its own day, not all days since.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_by_index(batch.sparkSession, target, batch, catalog() if callable(catalog) else catalog, staging, f"batch-{batch_id}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return _finite(writer, available_now).start()


def rejected_messages(raw: DataFrame) -> DataFrame:
    """Envelopes that staging leaves out, with the reason in `error`."""
    missing = F.coalesce(*[F.when(F.col(name).isNull(), f"no {name}") for name in REQUIRED_FIELDS])
    unreadable = F.when(parse_instant(F.col("swiped_at")).isNull(), "swiped_at is not an instant")
    reason = F.when(F.col("data").isNull(), "no body").otherwise(F.coalesce(
        F.when(missing.isNotNull() & F.try_parse_json("data").isNull(), "body is not JSON"), missing, unreadable))
    taken = message_fields(raw.select(*[name for name in raw.columns if name not in MESSAGE_FIELDS]))
    return taken.withColumn("error", reason).filter(F.col("error").isNotNull()).drop(*MESSAGE_FIELDS)


def stream_dead_letter(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Rejected messages of a stream of envelopes as JSON lines."""
    writer = (rejected_messages(stream).writeStream.format("json").option("path", path)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    return _finite(writer, available_now).start()


def stream_freshness(landed: DataFrame, now: Column, warn_hours: float = 1.0, error_hours: float = 6.0) -> DataFrame:
    """Age of the newest landed message."""
    return check_freshness(landed, "publish_time", now, warn_hours, error_hours)
