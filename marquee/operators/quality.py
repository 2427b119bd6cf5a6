"""Data-quality checks. Each reads its table once and gives (rule, failures)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import lookups


def _counted(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule with the number of rows for which the rule's failure condition is true."""
    counts = df.agg(*[F.count_if(failing).alias(f"c{i}") for i, failing in enumerate(rules.values())])
    pairs = [F.struct(F.lit(name).alias("rule"), F.col(f"c{i}").alias("failures")) for i, name in enumerate(rules)]
    return counts.select(F.inline(F.array(*pairs)))


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _counted(df, {f"not_null:{name}": F.col(name).isNull() for name in columns})


def check_unique(df: DataFrame, key: str) -> DataFrame:
    """Number of non-NULL keys that occur more than once."""
    repeated = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    return repeated.agg(F.count("*").alias("failures")).select(F.lit(f"unique:{key}").alias("rule"), "failures")


def check_accepted(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows with a non-NULL value outside the list."""
    return _counted(df, {f"accepted:{column}": ~F.col(column).isin(*values)})


def check_range(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    """Rows with a non-NULL value outside the inclusive range."""
    return _counted(df, {f"range:{column}": ~F.col(column).between(lo, hi)})


def check_freshness(df: DataFrame, ts: str, now: Column, warn_hours: float = 1.0,
                    error_hours: float = 6.0) -> DataFrame:
    """One row: newest instant, its age in hours, and pass / warn / error. No rows at all is an error."""
    newest = df.agg(F.max(ts).alias("newest"))
    age = F.timestamp_diff("SECOND", F.col("newest"), now) / F.lit(3600.0)
    status = (F.when(age.isNull() | (age > error_hours), "error").when(age > warn_hours, "warn").otherwise("pass"))
    return newest.select("newest", age.alias("age_hours"), status.alias("status"))


def attribute_rules() -> dict[str, Column]:
    """Failure conditions of the semantic attributes; a missing required attribute fails too."""
    def outside(name: str, words: Sequence[str]) -> Column:
        return ~F.coalesce(F.col(name).isin(*words), F.lit(False))

    def beyond(value: Column, lo: int, hi: int) -> Column:
        return ~F.coalesce(value.between(lo, hi), F.lit(False))

    def missing(value: Column) -> Column:
        return value.isNull()

    tags = F.col("occasion_tags")
    known = F.array(*[F.lit(word) for word in lookups.OCCASIONS])
    rules = {
        "mood": outside("mood", lookups.MOODS),
        "price_band": outside("price_band", lookups.PRICE_BANDS),
        "setting": outside("setting", lookups.SETTINGS),
        "time_slot": outside("time_slot", lookups.TIME_SLOTS),
        "minutes_ahead": beyond(F.col("arrival_advice.minutes_ahead"), 15, 120),
        "reason": missing(F.col("arrival_advice.reason")),
        "occasion_tags": beyond(F.size(tags), 1, 3) | ~F.coalesce(F.size(F.array_except(tags, known)) == 0,
                                                                  F.lit(False)),
        "plan_pairings": beyond(F.size(F.col("plan_pairings")), 1, 3),
        "duration_minutes": missing(F.col("duration_minutes")),
        "subcategory": ~F.coalesce(
            lookups.subcategory_allowed(F.col("category"), F.col("subcategory")), F.lit(False)),
    }
    for name in ("romantic_score", "family_score", "group_score", "tourist_score"):
        rules[name] = beyond(F.col(name), 0, 100)
    return rules


def check_attributes(df: DataFrame) -> DataFrame:
    return _counted(df, {f"attribute:{name}": failing for name, failing in attribute_rules().items()})


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
