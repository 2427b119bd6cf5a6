"""Writers and keyed writes. Files are written in parallel; nothing is forced into one file."""

from __future__ import annotations

import datetime as dt
import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators.catalog import project_warehouse
from marquee.operators.marts import new_events_only
from marquee.scale import top_per_key
from marquee.sources import commits


def _run_folder(path: str, run_ts: dt.datetime) -> str:
    return posixpath.join(path, f"run_ts={run_ts:%Y%m%d_%H%M%S}")


def land_raw(df: DataFrame, path: str, run_ts: dt.datetime) -> None:
    """Events of one run as JSON lines with the fields that are read, test events included.

    `land_documents` keeps fields that nothing reads yet, too.
    """
    df.write.mode("overwrite").json(_run_folder(path, run_ts))


def land_documents(documents: DataFrame, path: str, run_ts: dt.datetime) -> None:
    """Documents of one run as they came, one JSON text (`value`) per line."""
    documents.select("value").write.mode("overwrite").text(_run_folder(path, run_ts))


def land_tagged(tagged: DataFrame, path: str, run_ts: dt.datetime) -> DataFrame:
    """Tagged lines of one run as text, a folder for each tag, and read back from there: nothing is parsed twice."""
    folder = _run_folder(path, run_ts)
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("tag").text(folder)
    return tagged.sparkSession.read.schema("value string, tag string").text(folder)


def write_dead_letters(bad: DataFrame, path: str, run_ts: dt.datetime) -> None:
    """Rejected rows as JSON lines {id, error, timestamp, raw}."""
    raw = F.struct(*[F.col(name) for name in bad.columns if name != "error"])
    lines = bad.select(F.to_json(F.struct(
        F.col("id"), F.col("error"), F.lit(run_ts.isoformat()).alias("timestamp"), raw.alias("raw"))).alias("value"))
    lines.write.mode("overwrite").text(_run_folder(path, run_ts))


def _keyed(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows with a whole key. As in any keyed store, NULL is no key: such rows would all be one."""
    return rows.dropna(how="any", subset=key)


def upsert_by_key(target: DataFrame, updates: DataFrame, key: list[str], order_by: Column) -> DataFrame:
    """Keyed write: columns the updates carry overwrite, columns they lack stay, the last write of a key wins.

    Updates without a whole key are refused.
    """
    newest = top_per_key(_keyed(updates, key), key, [order_by])
    changed = [name for name in updates.columns if name not in key]
    columns = list(target.columns) + [name for name in changed if name not in target.columns]
    marked = newest.select(*key, F.struct(*changed).alias("_new"))
    joined = target.join(marked, key, "full_outer")

    def column(name: str) -> Column:
        if name in key:
            return F.col(name)
        kept = F.col(name) if name in target.columns else F.lit(None)
        if name not in changed:
            return kept
        return F.when(F.col("_new").isNotNull(), F.col("_new")[name]).otherwise(kept).alias(name)

    return joined.select(*[column(name) for name in columns])


def upsert_documents(target: DataFrame, updates: DataFrame, order_by: Column, key: str = "id") -> DataFrame:
    """`upsert_by_key` for documents keyed by one id."""
    return upsert_by_key(target, updates, [key], order_by)


def append_new(df: DataFrame, path: str, schema: T.StructType, partition: str, key: str = "id") -> None:
    """Append the rows whose key is not stored yet, projected to the schema; makes the table if missing."""
    spark = df.sparkSession
    rows = project_warehouse(df, schema)
    stored = commits.Files(spark, path).data_files()
    existing = spark.read.parquet(path).select(key) if stored else spark.createDataFrame([], T.StructType([schema[key]]))
    fresh = new_events_only(rows, existing, key, dedupe=True)
    fresh.repartitionByRange(partition, key).write.mode("append").partitionBy(partition).parquet(path)


def insert_ignore(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Target plus the rows whose key it lacks; of equal keys among the rows one is taken, rows without a whole key are refused."""
    order = [F.col(name).asc_nulls_last() for name in rows.columns if name not in key]
    fresh = top_per_key(_keyed(rows, key), key, order or [F.col(key[0])]).join(target.select(*key), key, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def day_partitioned_table(df: DataFrame, path: str, ts: str, cluster: list[str], mode: str = "append") -> None:
    """Table partitioned by the day of `ts` and sorted by the clustering columns.

    Rows are split by ranges of (day, clustering columns, ts), so neither a hot day nor a hot user
    ends up in one task.
    """
    day = f"{ts}_day"
    dated = df.withColumn(day, F.to_date(ts))
    (dated.repartitionByRange(day, *cluster, ts).sortWithinPartitions(day, *cluster, ts)
     .write.mode(mode).partitionBy(day).parquet(path))


def write_artifacts(tables: dict[str, DataFrame], path: str, report: str | None = None,
                    format: str = "parquet") -> None:
    """Every table under its name, plus the report text."""
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        if format == "csv":
            writer = writer.option("header", True).option("escape", '"')
        writer.format(format).save(posixpath.join(path, name))
    if report is not None:
        spark: SparkSession = next(iter(tables.values())).sparkSession
        spark.createDataFrame([(report,)], "value string").write.mode("overwrite").text(
            posixpath.join(path, "report"))
