"""The interaction fact: deduplication, catalogue lookup, and the incremental merge."""

from __future__ import annotations

import datetime as dt
import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators.staging import latest_per_key
from marquee.scale import spread_join, top_per_key
from marquee.schemas import FACT
from marquee.sources import commits

CATALOG_COLUMNS = {
    "segment": "string", "genre": "string", "subgenre": "string", "city": "string",
    "price_min": "double", "price_max": "double", "event_date": "date", "venue_id": "string",
}
EPOCH = "1970-01-01 00:00:00"
#: Folder of the version index in a stored fact, and its buckets.
INDEX, INDEX_BUCKETS = "_index", 64


def unique_catalog(catalog: DataFrame) -> DataFrame:
    """One row per event with the columns the fact takes; columns the catalogue lacks are NULL."""
    columns = [
        (F.col(name) if name in catalog.columns else F.lit(None)).cast(kind).alias(name)
        for name, kind in CATALOG_COLUMNS.items()
    ]
    order = [F.col(name).asc_nulls_last() for name in CATALOG_COLUMNS]
    rows = catalog.filter(F.col("id").isNotNull()).select(F.col("id").alias("event_id"), *columns)
    return top_per_key(rows, ["event_id"], order)


def enrich_fact(interactions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Interactions with their event's columns; those of unknown events are kept.

    The catalogue side is unique, so rows never multiply, and the interactions of a popular event are
    spread over several tasks.
    """
    bare = interactions.drop(*CATALOG_COLUMNS)  # a source may carry older values of them
    return spread_join(bare, unique_catalog(catalog), ["event_id"])


def fact_projection(df: DataFrame) -> DataFrame:
    """The 18 columns of the fact; prices the catalogue does not have are NULL."""
    return df.select(*[
        (F.col(field.name) if field.name in df.columns else F.lit(None).cast(field.dataType)).alias(field.name)
        for field in FACT.fields
    ])


def version_tiebreak(df: DataFrame) -> list[Column]:
    """Order among versions of one interaction that arrived at the same instant."""
    return [F.col("event_timestamp").desc_nulls_last(), F.col("event_id").asc_nulls_last()]


def latest_interactions(staged: DataFrame) -> DataFrame:
    return latest_per_key(staged, ["interaction_id"], "ingestion_timestamp", version_tiebreak(staged))


def new_events_only(batch: DataFrame, existing: DataFrame, key: str = "id", dedupe: bool = False) -> DataFrame:
    """Rows of the batch whose key is not stored yet. A NULL key counts as new.

    `dedupe=True` also keeps only one row per key of the batch; all rows without a key stay.
    """
    fresh = batch.join(existing.select(key), key, "left_anti")
    if not dedupe:
        return fresh
    order = [F.col(name).asc_nulls_last() for name, kind in fresh.dtypes if name != key and not kind.startswith("map")]
    keyed = top_per_key(fresh.filter(F.col(key).isNotNull()), [key], order or [F.col(key)])
    return keyed.unionByName(fresh.filter(F.col(key).isNull()))


def append_batches(*batches: DataFrame) -> DataFrame:
    """All rows of all batches; columns that a batch lacks are NULL."""
    combined = batches[0]
    for batch in batches[1:]:
        combined = combined.unionByName(batch, allowMissingColumns=True)
    return combined


def additive_schema(target: DataFrame, source: DataFrame) -> DataFrame:
    """Target and source rows; columns new in the source are appended after the target's."""
    return append_batches(target, source)


def _lookback(now: Column, days: int) -> Column:
    return now - F.make_dt_interval(F.lit(days))


def target_high_water(target: DataFrame, now: Column, days: int = 3) -> DataFrame:
    """One row: the newest arrival in the target inside the lookback, or the epoch."""
    recent = target.filter(F.col("ingestion_timestamp") > _lookback(now, days))
    epoch = F.lit(EPOCH).cast(dict(target.dtypes)["ingestion_timestamp"])
    return recent.agg(F.coalesce(F.max("ingestion_timestamp"), epoch).alias("high_water"))


def merge_updates(target: DataFrame, source: DataFrame, catalog: DataFrame, now: Column, days: int = 3,
                  strict: bool = True) -> DataFrame:
    """Fact rows that a run adds or rewrites, one per interaction: the chosen arrivals with their event's columns."""
    return fact_projection(enrich_fact(chosen_arrivals(target, source, now, days, strict), catalog))


def chosen_arrivals(target: DataFrame, source: DataFrame, now: Column, days: int = 3, strict: bool = True) -> DataFrame:
    """Arrivals that a run adds or rewrites, one per interaction.

    `strict=True` takes only arrivals later than the target's newest one, so late rows and rows of
    that very instant are never read. `strict=False` takes every arrival inside the lookback that the
    target does not hold yet in that version or a newer one.
    """
    arrivals = source.filter(F.col("ingestion_timestamp") > _lookback(now, days))
    if strict:
        mark = target_high_water(target, now, days).scalar()
        return latest_interactions(arrivals.filter(F.col("ingestion_timestamp") > mark))
    held = target.filter(F.col("ingestion_timestamp") > _lookback(now, days)).select(
        "interaction_id", F.col("ingestion_timestamp").alias("_held"))
    newest = latest_interactions(arrivals)
    return newest.join(
        held, (newest["interaction_id"] == held["interaction_id"])
        & (held["_held"] >= newest["ingestion_timestamp"]), "left_anti")


def merge_incremental(target: DataFrame, source: DataFrame, catalog: DataFrame, now: Column, days: int = 3,
                      strict: bool = True) -> DataFrame:
    """The target after the run: matching rows inside the lookback are replaced, the rest is inserted.

    A match older than the lookback is left alone and the new version is inserted next to it.
    """
    updates = merge_updates(target, source, catalog, now, days, strict)
    replaced = F.col("ingestion_timestamp") > _lookback(now, days)
    old = target.filter(~F.coalesce(replaced, F.lit(False)))
    recent = target.filter(replaced).join(updates.select("interaction_id"), "interaction_id", "left_anti")
    return old.unionByName(recent).unionByName(updates, allowMissingColumns=True)


def _write_days(df: DataFrame, path: str, mode: str) -> None:
    dated = df.withColumn("ingestion_date", F.to_date("ingestion_timestamp"))
    (dated.repartitionByRange("ingestion_date", "user_id", "interaction_id")
     .sortWithinPartitions("ingestion_date", "user_id", "interaction_id")
     .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("ingestion_date").parquet(path))


def write_fact(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Day partitions, clustered by user. The range split cuts through hot days and hot users.

    A version index that the table has is dropped; the next merge that needs one makes it anew.
    """
    commits.Files(df.sparkSession, path).delete(INDEX)
    _write_days(df, path, mode)


def read_fact(spark: SparkSession, path: str) -> DataFrame:
    """The stored fact; a table that has no files yet is empty."""
    stored = T.StructType([*FACT.fields, T.StructField("ingestion_date", T.DateType())])
    if not commits.Files(spark, path).data_files():
        return spark.createDataFrame([], stored)
    return spark.read.parquet(path)


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_fact(chosen: DataFrame, catalog: DataFrame) -> DataFrame:
    """Fact rows of stored arrivals. Only the events that they name are taken from the catalogue."""
    named = catalog.join(chosen.select(F.col("event_id").alias("id")).distinct(), "id", "left_semi")
    return fact_projection(enrich_fact(chosen, named))


def merge_into_path(spark: SparkSession, path: str, source: DataFrame, catalog: DataFrame, now: dt.datetime,
                    staging: str, run_id: str, days: int = 3, strict: bool = True) -> list[dt.date]:
    """Merge a run into a stored fact and return the days that were rewritten.

    Only the day partitions inside the lookback are read, and of them whole rows only where rows change. The new content
    of these days is written under `staging/run_id` and published through a commit log (`sources.commits`): what a run left
    that stopped anywhere is finished by the next one, which then starts from there. Running it twice changes nothing.
    """
    commits.finish(spark, path)
    clock = F.lit(now)
    first_day = (now - dt.timedelta(days=days)).date()
    work = posixpath.join(staging, run_id)
    target = read_fact(spark, path).filter(F.col("ingestion_date") >= F.lit(first_day))
    chosen = _stored(chosen_arrivals(target.drop("ingestion_date"), source, clock, days, strict), f"{work}/chosen")
    inside = F.col("ingestion_timestamp") > _lookback(clock, days)

    # At most one entry per day of the lookback, so the list is short whatever the data.
    old_days = target.filter(inside).join(chosen.select("interaction_id"), "interaction_id", "left_semi").select("ingestion_date")
    touched = _days(old_days.union(chosen.select(F.to_date("ingestion_timestamp"))))
    if touched:
        _publish_days(spark, path, target, touched, _stored(stored_fact(chosen, catalog), f"{work}/updates"), inside, work, run_id)
    return touched


def _days(days: DataFrame) -> list[dt.date]:
    return sorted(row[0] for row in days.distinct().collect())


def _publish_days(spark: SparkSession, path: str, target: DataFrame, touched: list[dt.date], updates: DataFrame, replaceable: Column,
                  work: str, run_id: str) -> None:
    """Publishes the touched days without the replaceable rows that the updates renew, with the updates, and their index."""
    files, staged = commits.Files(spark, path), f"{work}/days"
    commits.Files(spark, staged).delete("")  # of a run that stopped before it had a manifest
    renewed = updates.select("interaction_id", F.lit(True).alias("_renewed"))
    current = target.filter(F.col("ingestion_date").isin(touched)).drop("ingestion_date")
    kept = current.join(renewed, "interaction_id", "left").filter(
        ~F.coalesce(F.col("_renewed") & replaceable, F.lit(False))).select(*current.columns)
    _write_days(kept.unionByName(updates, allowMissingColumns=True), staged, "overwrite")
    old = [name for day in touched for name in files.data_files(f"ingestion_date={day}")]
    if files.exists(INDEX):
        buckets, held = _held_versions(spark, path, updates)
        versions = held.join(updates, "interaction_id", "left_anti").unionByName(_versions(updates))
        _write_index(versions, staged)
        old += [name for n in buckets for name in files.data_files(f"{INDEX}/bucket={n}")]
    commits.publish(spark, path, staged, old, run_id)


# The version index of a stored fact: the day and arrival of the newest version held of every interaction.

def _versions(fact: DataFrame) -> DataFrame:
    return fact.filter("interaction_id IS NOT NULL").select(
        "interaction_id", F.to_date("ingestion_timestamp").alias("held_day"), F.col("ingestion_timestamp").alias("held_at"))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("interaction_id"), F.lit(INDEX_BUCKETS)).cast("int")


def _write_index(versions: DataFrame, path: str) -> None:
    (versions.withColumn("bucket", _bucket()).repartitionByRange("bucket", "interaction_id")
     .write.partitionBy("bucket").parquet(f"{path}/{INDEX}"))


def _held_versions(spark: SparkSession, path: str, rows: DataFrame) -> tuple[list[int], DataFrame]:
    """The index buckets of the rows' interactions, of which there are at most INDEX_BUCKETS, and what these buckets hold."""
    buckets = sorted(row[0] for row in rows.select(_bucket().alias("bucket")).distinct().collect())
    schema = "interaction_id string, held_day date, held_at timestamp, bucket int"
    if not commits.Files(spark, path).data_files(INDEX):
        return buckets, spark.createDataFrame([], schema).drop("bucket")
    return buckets, spark.read.schema(schema).parquet(f"{path}/{INDEX}").filter(F.col("bucket").isin(buckets)).drop("bucket")


def build_index(spark: SparkSession, path: str, staging: str, run_id: str) -> None:
    """Indexes a stored fact; three columns of it are read once."""
    order = [F.col("held_at").desc()]
    staged = posixpath.join(staging, run_id, "index")
    commits.Files(spark, staged).delete("")
    _write_index(top_per_key(_versions(read_fact(spark, path)), ["interaction_id"], order), staged)
    commits.publish(spark, path, staged, [], f"{run_id}-index")


def merge_by_index(spark: SparkSession, path: str, source: DataFrame, catalog: DataFrame, staging: str, run_id: str) -> list[dt.date]:
    """Merge arrivals of any age into a stored fact; return the days that were read and rewritten.

    The newest version of every interaction stays, wherever an older one is held. The version index tells which days hold
    interactions of the run, so these and the arrivals' own days are all that is read, whatever lies between them.
    Arrivals without an id or a time are left out. As safe to stop and to repeat as `merge_into_path`.
    """
    commits.finish(spark, path)
    work = posixpath.join(staging, run_id)
    if not commits.Files(spark, path).exists(INDEX):
        build_index(spark, path, staging, run_id)
    newest = _stored(latest_interactions(source.dropna(subset=["interaction_id", "ingestion_timestamp"])), f"{work}/newest")
    _, index = _held_versions(spark, path, newest)
    held = index.join(newest.select("interaction_id", "ingestion_timestamp"), "interaction_id")
    stale = _stored(held.select("interaction_id", "held_day", (F.col("held_at") >= F.col("ingestion_timestamp")).alias("done")), f"{work}/held")
    chosen = newest.join(stale.filter("done"), "interaction_id", "left_anti")
    touched = _days(stale.filter("NOT done").select("held_day").union(chosen.select(F.to_date("ingestion_timestamp"))))
    if touched:
        updates = _stored(stored_fact(chosen, catalog), f"{work}/updates")
        _publish_days(spark, path, read_fact(spark, path), touched, updates, F.lit(True), work, run_id)
    return touched
