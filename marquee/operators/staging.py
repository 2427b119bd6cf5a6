"""Interaction messages: building, parsing and validating them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.instants import iso_micros, iso_text, parse_instant
from marquee.functions.values import json_value
from marquee.scale import top_per_key

PAYLOAD_FIELDS = ["event_id", "direction", "swiped_at", "dwell_ms", "session_id", "recommendation_context"]


def build_envelope(df: DataFrame, user: Column, now: Column) -> DataFrame:
    """Interaction payload rows -> message body and attributes.

    Adds the signed-in user, and `now` where the client sent no time. A time that was sent has six digits of a second, also
    when they are zero. `data` is JSON text, `attributes` a string map.
    """
    body = {name: F.col(name) for name in PAYLOAD_FIELDS if name in df.columns}
    body["swiped_at"] = F.coalesce(iso_micros(F.col("swiped_at")), iso_text(now))
    body["user_id"] = user.cast("string")
    data = F.to_json(F.struct(*[value.alias(name) for name, value in body.items()]), {"ignoreNullFields": "false"})
    pairs = F.array(
        F.struct(F.lit("event_type").alias("key"), F.lit("swipe").alias("value")),
        F.struct(F.lit("user_id").alias("key"), user.cast("string").alias("value")),
        F.struct(F.lit("direction").alias("key"), F.col("direction").alias("value")),
    )
    present = F.filter(pairs, lambda pair: pair["value"].isNotNull())
    return df.select("*", data.alias("data"), F.map_from_entries(present).alias("attributes"))


MESSAGE_FIELDS = ["swiped_at", "user_id", "session_id", "event_id", "interaction_type", "direction",
                  "recommendation_context"]


def message_fields(raw: DataFrame) -> DataFrame:
    """Adds the body's fields as text columns; objects, arrays, JSON null and bad JSON give NULL.

    One generator reads all fields in a single pass over the body, and filters on them cannot be moved
    below it, where they would parse the body again. The generator also gives objects and arrays as
    text, so a value that looks like one is checked, which hardly ever happens.
    """
    found = raw.select("*", F.json_tuple("data", *MESSAGE_FIELDS).alias(*[f"_{name}" for name in MESSAGE_FIELDS]))

    def scalar(name: str) -> Column:
        text = F.col(f"_{name}")
        return F.when(text.rlike(r"^[\[{]"), json_value(F.col("data"), f"$.{name}")).otherwise(text).alias(name)

    return found.select(*raw.columns, *[scalar(name) for name in MESSAGE_FIELDS])


def stage_interactions(raw: DataFrame) -> DataFrame:
    """Envelopes -> ten typed columns. Bad JSON gives NULL columns."""
    direction = F.col("direction")
    return message_fields(raw.select("message_id", "publish_time", "data")).select(
        F.col("message_id").alias("interaction_id"),
        parse_instant(F.col("swiped_at")).alias("event_timestamp"),
        "user_id",
        "session_id",
        "event_id",
        F.coalesce("interaction_type", F.lit("swipe")).alias("interaction_type"),
        direction.alias("swipe_direction"),
        F.when(direction == "right", True).when(direction == "left", False).alias("liked"),
        "recommendation_context",
        F.col("publish_time").alias("ingestion_timestamp"),
    )


def valid_messages(staged: DataFrame) -> DataFrame:
    """Rows with event, user, direction and time. Which direction it is does not matter here."""
    needed = ["event_id", "user_id", "swipe_direction", "event_timestamp"]
    return staged.filter(F.expr(" AND ".join(f"{name} IS NOT NULL" for name in needed)))


def payload_rules() -> dict[str, Column]:
    """Conditions a client payload must meet; each is NULL-safe."""
    context = F.col("recommendation_context")
    return {
        "direction": F.coalesce(F.col("direction").isin("left", "right"), F.lit(False)),
        "dwell_ms": F.coalesce(F.col("dwell_ms") >= 0, F.lit(True)),
        "recommendation_context": F.coalesce(context.isin("swipe", "chat"), F.lit(True)),
    }


def validate_payload(df: DataFrame) -> DataFrame:
    """Adds `is_valid` and `invalid_fields`, the comma-separated names of failing fields."""
    rules = payload_rules()
    failing = F.concat_ws(",", *[F.when(~rule, F.lit(name)) for name, rule in rules.items()])
    return df.withColumn("invalid_fields", failing).withColumn("is_valid", F.col("invalid_fields") == "")


def recent_messages(raw: DataFrame, n: int = 20) -> DataFrame:
    """The `n` newest envelopes."""
    return raw.orderBy(F.col("publish_time").desc_nulls_last(), F.col("message_id")).limit(n)


def latest_per_key(df: DataFrame, keys: list[str], order_by: str, tiebreak: list[Column]) -> DataFrame:
    """The newest version of every key; `tiebreak` decides between versions of the same instant."""
    return top_per_key(df, keys, [F.col(order_by).desc_nulls_last(), *tiebreak])
