"""Streams over the events file, run to their end and read back. Each must equal its batch counterpart."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import Tables, query, scratch, ts_text
from marquee.schemas import ENVELOPE
from marquee.streaming import interactions


def event_stream(t: Tables) -> DataFrame:
    """The events file as a file-source stream."""
    batch = t.read("events")
    return t.spark.readStream.schema(batch.schema).parquet(posixpath.join(t.sf_dir, "events*.parquet"))


def envelope_stream(t: Tables) -> DataFrame:
    """Envelopes as a stream: broker rows with binary bodies and attribute maps, decoded."""
    rows = t.raw(event_stream(t)).select(
        "message_id", "publish_time", F.col("data").cast("binary").alias("data"),
        F.from_json("attributes", "map<string,string>").alias("attributes"))
    return interactions.decode_envelopes(rows, "interactions")


def finished(query_) -> None:
    query_.awaitTermination()


def written(t: Tables, stream: DataFrame) -> DataFrame:
    path = scratch(t.spark)
    finished(stream.writeStream.format("parquet").option("path", f"{path}/out")
             .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    return t.spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("stream_land", """
    SELECT message_id, strftime(publish_time, '%Y-%m-%d %H:%M:%S.%f') AS publish_time, 'interactions' AS subscription_name,
           '{"event_type":"swipe","user_id":"' || user_id || '"}' AS attributes FROM raw""")
def _(t: Tables):
    path = scratch(t.spark)
    finished(interactions.stream_land(envelope_stream(t), f"{path}/raw", f"{path}/checkpoint"))
    landed = t.spark.read.schema(ENVELOPE).parquet(f"{path}/raw")
    return landed.select("message_id", ts_text("publish_time").alias("publish_time"), "subscription_name", "attributes")


@query("stream_stage", """
    SELECT interaction_id, event_id, user_id, liked, strftime(ingestion_timestamp, '%Y-%m-%d %H:%M:%S.%f') AS ingestion_timestamp
    FROM staged""")
def _(t: Tables):
    rows = written(t, interactions.stream_stage(envelope_stream(t)))
    return rows.select("interaction_id", "event_id", "user_id", "liked", ts_text("ingestion_timestamp").alias("ingestion_timestamp"))


@query("stream_dedupe", "SELECT interaction_id, event_id, user_id FROM latest")
def _(t: Tables):
    rows = written(t, interactions.stream_dedupe(interactions.stream_stage(envelope_stream(t))))
    return rows.select("interaction_id", "event_id", "user_id")


@query("stream_merge_fact", """
    SELECT interaction_id, strftime(ingestion_timestamp, '%Y-%m-%d %H:%M:%S.%f') AS ingestion_timestamp, segment, city
    FROM fact""")
def _(t: Tables):
    path = scratch(t.spark)
    finished(interactions.stream_merge_fact(
        interactions.stream_stage(envelope_stream(t)), f"{path}/fact", t.catalog(), f"{path}/checkpoint", f"{path}/staging"))
    stored = t.spark.read.parquet(f"{path}/fact")
    return stored.select("interaction_id", ts_text("ingestion_timestamp").alias("ingestion_timestamp"), "segment", "city")


@query("stream_dead_letter", "SELECT message_id, 'no direction' AS error FROM raw WHERE direction IS NULL")
def _(t: Tables):
    path = scratch(t.spark)
    finished(interactions.stream_dead_letter(envelope_stream(t), f"{path}/dead", f"{path}/checkpoint"))
    return t.spark.read.schema("message_id string, error string").json(f"{path}/dead")


@query("rejected_messages", """
    SELECT message_id, CASE CAST(message_id AS BIGINT) % 5 WHEN 0 THEN 'no body' WHEN 1 THEN 'body is not JSON'
        WHEN 2 THEN 'swiped_at is not an instant' ELSE 'no direction' END AS error
    FROM raw WHERE CAST(message_id AS BIGINT) % 5 < 2 OR direction IS NULL OR CAST(message_id AS BIGINT) % 5 = 2
    EXCEPT ALL SELECT message_id, 'swiped_at is not an instant' FROM raw WHERE CAST(message_id AS BIGINT) % 5 = 2 AND direction IS NULL
    UNION ALL SELECT message_id, 'no direction' FROM raw WHERE CAST(message_id AS BIGINT) % 5 = 2 AND direction IS NULL""")
def _(t: Tables):
    kind = F.col("message_id").cast("bigint") % 5
    body = (F.when(kind == 1, "{oops").when(kind == 2, F.regexp_replace("data", r'"swiped_at":"[^"]*"', '"swiped_at":"soon"'))
            .when(kind > 2, F.col("data")))
    return interactions.rejected_messages(t.raw().withColumn("data", body)).select("message_id", "error")
