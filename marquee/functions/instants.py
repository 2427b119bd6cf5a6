"""Dates, instants and the calendar table. `now` is always passed in, never read from the clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_instant(value: Column) -> Column:
    """ISO text with `Z`, an offset or a space separator; bad text gives NULL."""
    return F.try_to_timestamp(value)


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole days from `start` to `end`, rounded down."""
    return F.floor(F.timestamp_diff("MICROSECOND", start, end) / F.lit(86_400_000_000.0)).cast("bigint")


def expiry(now: Column, days: int) -> Column:
    return now + F.make_dt_interval(F.lit(days))


def iso_date_or_null(value: Column) -> Column:
    """Date of a strict `YYYY-MM-DD` text."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd"))


def iso_text(instant: Column) -> Column:
    """`2024-02-01T20:30:00+00:00`; a fraction is written only when there is one."""
    whole = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ssxxx")
    return F.when(F.date_trunc("second", instant) == instant, whole).otherwise(iso_micros(instant))


def iso_micros(instant: Column) -> Column:
    """`2024-02-01T20:30:00.000000+00:00`, always with six digits."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def sort_instant_text(starts_at: Column, date: Column, time: Column) -> Column:
    """Text that sorts occurrences: the instant, or `date time` where there is none."""
    local = F.concat_ws(" ", F.coalesce(date.cast("string"), F.lit("")), F.coalesce(time, F.lit("")))
    return F.coalesce(starts_at.cast("string"), local)


def month_grid(months: DataFrame, month: str = "month_start") -> DataFrame:
    """Monday-first calendar cells, padded to whole weeks, for every month start in `months`.

    Gives (month_start, cell, day): `cell` counts from 0 and `day` is NULL in padding.
    """
    starts = months.select(F.trunc(F.col(month), "month").alias("month_start")).distinct()
    first, last = F.col("month_start"), F.last_day("month_start")
    monday = F.date_sub(first, F.weekday(first))
    sunday = F.date_add(last, F.lit(6) - F.weekday(last))
    cells = starts.select("month_start", F.posexplode(F.sequence(monday, sunday)).alias("cell", "date"))
    inside = F.trunc("date", "month") == F.col("month_start")
    return cells.select("month_start", "cell", F.when(inside, F.col("date")).alias("day"))


def single_month(spark: SparkSession, year: int, month: int) -> DataFrame:
    """The grid of one month."""
    row = spark.createDataFrame([(dt.date(year, month, 1),)], "month_start date")
    return month_grid(row)
