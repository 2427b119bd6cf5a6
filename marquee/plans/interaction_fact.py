"""Raw messages -> interaction fact, with the checks that belong to each table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marquee.operators import quality
from marquee.operators.marts import enrich_fact, fact_projection, latest_interactions
from marquee.operators.staging import stage_interactions, valid_messages


def build_fact(raw: DataFrame, catalog: DataFrame) -> DataFrame:
    """The whole fact from scratch; `merge_incremental` keeps it up to date."""
    staged = valid_messages(stage_interactions(raw))
    return fact_projection(enrich_fact(latest_interactions(staged), catalog))


def staging_checks(staged: DataFrame) -> DataFrame:
    columns = ["interaction_id", "event_id", "user_id", "swipe_direction", "event_timestamp", "ingestion_timestamp"]
    return (quality.check_not_null(staged, columns)
            .union(quality.check_unique(staged, "interaction_id"))
            .union(quality.check_accepted(staged, "swipe_direction", ["left", "right"])))


def fact_checks(fact: DataFrame) -> DataFrame:
    columns = ["interaction_id", "event_timestamp", "user_id", "event_id", "interaction_type", "swipe_direction",
               "liked", "ingestion_timestamp"]
    return (quality.check_not_null(fact, columns)
            .union(quality.check_unique(fact, "interaction_id"))
            .union(quality.check_accepted(fact, "interaction_type", ["swipe"]))
            .union(quality.check_accepted(fact, "swipe_direction", ["left", "right"])))
