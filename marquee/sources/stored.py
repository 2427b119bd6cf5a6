"""Stored tables that are changed by key: hash buckets of which only those with changed keys are read and written.

A table lies in folders `bucket=<n>`, n being a hash of the key modulo `buckets`. A change reads the buckets of its keys,
writes their new content to staging and publishes it through `commits`, so a run that stops anywhere is finished by the
next one and may be repeated. Rows without a whole key are refused, as a keyed store would do: they are never stored, and
reports name them. Of several changes to a key in one run the first of `order_by` counts. What is broadcast is at most the
list of bucket numbers.

`erase_stored` takes rows of given keys out of tables of any layout. An index from key hashes to files tells which files can
hold a key; the key columns of those are read, and only files that do hold one are written anew.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.scale import top_per_key
from marquee.sources import commits
from marquee.sources.sinks import upsert_by_key

BUCKETS = 64
#: Folder of the key index in a stored table, and its buckets.
KEYS, KEY_BUCKETS = "_keys", 64


def bucket_of(key: Sequence[str], buckets: int) -> Column:
    """The bucket of a key; integers of any width and the same text hash alike."""
    return F.pmod(F.xxhash64(*[F.col(name).cast("string") for name in key]), F.lit(buckets)).cast("int")


class KeyedTable:
    """A table of unique keys at `path`. `schema` is what an empty table has; later columns are added by upserts."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], schema: T.StructType, staging: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), list(key), schema
        self.staging, self.buckets = staging.rstrip("/"), buckets

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The stored rows; with `buckets`, only those folders are read."""
        if not commits.Files(self.spark, self.path).data_files():
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.option("mergeSchema", True).parquet(self.path)
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets))
        return rows.drop("bucket")

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.filter(F.expr(" AND ".join(f"`{name}` IS NOT NULL" for name in self.key)))

    def _change(self, changes: DataFrame, run_id: str, change: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """Publishes change(held rows, changes) for the buckets that `changes` name, and gives what was held there.

        The changes are stored first, so they are evaluated once and a report can be told from them afterwards.
        """
        commits.finish(self.spark, self.path)
        work = posixpath.join(self.staging, run_id)
        changes.withColumn("bucket", bucket_of(self.key, self.buckets)).write.mode("overwrite").parquet(f"{work}/changes")
        stored = self.spark.read.parquet(f"{work}/changes")
        touched = sorted(row[0] for row in self._keyed(stored).select("bucket").distinct().collect())  # at most `buckets`
        if not touched:
            return self.read([])
        held = self.read(touched)
        held.write.mode("overwrite").parquet(f"{work}/held")
        held = self.spark.read.schema(held.schema).parquet(f"{work}/held")
        commits.Files(self.spark, f"{work}/after").delete("")  # of a run that stopped before it had a manifest
        after = change(held, self._keyed(stored).drop("bucket"))
        (after.withColumn("bucket", bucket_of(self.key, self.buckets)).repartitionByRange("bucket", *self.key).write.mode("overwrite")
         .partitionBy("bucket").parquet(f"{work}/after"))
        files = commits.Files(self.spark, self.path)
        old = [name for n in touched for name in files.data_files(f"bucket={n}")]
        commits.publish(self.spark, self.path, f"{work}/after", old, run_id)
        return held

    def _changes(self, run_id: str) -> DataFrame:
        return self.spark.read.parquet(posixpath.join(self.staging, run_id, "changes")).drop("bucket")

    def upsert(self, updates: DataFrame, order_by: Column, run_id: str) -> None:
        """Columns that the updates carry overwrite, others stay; new keys are inserted."""
        self._change(updates, run_id, lambda held, changes: upsert_by_key(held, changes, self.key, order_by))

    def insert_ignore(self, rows: DataFrame, order_by: Column, run_id: str) -> DataFrame:
        """Inserts the keys that are not there. Report: key, outcome (inserted, conflict, no key), a row for each given one."""
        def change(held: DataFrame, changes: DataFrame) -> DataFrame:
            fresh = top_per_key(changes, self.key, [order_by]).join(held.select(*self.key), self.key, "left_anti")
            return held.unionByName(fresh, allowMissingColumns=True)

        held = self._change(rows, run_id, change).select(*self.key, F.lit(True).alias("_held"))
        given = self._changes(run_id)
        first = self._numbered(given, order_by)
        return self._report(first.join(held, self.key, "left"),
                            F.when(F.col("_held").isNotNull() | (F.col("_nth") > 1), "conflict").otherwise("inserted"))

    def delete_by_key(self, keys: DataFrame, run_id: str, owner: str | None = None) -> DataFrame:
        """Deletes the rows of `keys`. With `owner`, a column of both, only rows of that owner.

        Report: key, outcome (deleted, missing, not the owner, no key), a row for each given one.
        """
        def change(held: DataFrame, changes: DataFrame) -> DataFrame:
            match = [*self.key, *([owner] if owner else [])]
            return held.join(changes.select(*match).distinct(), match, "left_anti")

        return self._owned(self._change(keys, run_id, change), run_id, owner, "deleted")

    def patch_by_key(self, patches: DataFrame, order_by: Column, run_id: str, owner: str | None = None) -> DataFrame:
        """Overwrites the columns that a patch carries with a value; what it has null stays. Never inserts.

        With `owner`, a column of both, only rows of that owner change. Report: key, outcome (patched, missing, not the
        owner, no key), a row for each given one.
        """
        fields = [name for name in patches.columns if name not in self.key and name != owner]

        def change(held: DataFrame, changes: DataFrame) -> DataFrame:
            match = [*self.key, *([owner] if owner else [])]
            newest = top_per_key(changes, match, [order_by])
            patch = newest.select(*match, F.struct(*fields).alias("_patch"))
            columns = [F.coalesce(F.col("_patch")[name], F.col(name)).alias(name) if name in fields else F.col(name) for name in held.columns]
            return held.join(patch, match, "left").select(*columns)

        return self._owned(self._change(patches, run_id, change), run_id, owner, "patched")

    def _numbered(self, given: DataFrame, order_by: Column) -> DataFrame:
        return given.withColumn("_nth", F.row_number().over(Window.partitionBy(*self.key).orderBy(order_by)))

    def _owned(self, held: DataFrame, run_id: str, owner: str | None, done: str) -> DataFrame:
        there = held.select(*self.key, (F.col(owner) if owner else F.lit(None)).alias("_owner"), F.lit(True).alias("_held"))
        given = self._changes(run_id).join(there, self.key, "left")
        theirs = F.coalesce(F.col("_owner") == F.col(owner), F.lit(False)) if owner else F.lit(True)
        return self._report(given, F.when(F.col("_held").isNull(), "missing").when(theirs, done).otherwise("not the owner"))

    def _report(self, given: DataFrame, outcome: Column) -> DataFrame:
        whole = F.expr(" AND ".join(f"`{name}` IS NOT NULL" for name in self.key))
        return given.select(*self.key, F.when(~whole, "no key").otherwise(outcome).alias("outcome"))


# Erasure

def _hashed(rows: DataFrame, key: str) -> DataFrame:
    hashed = rows.withColumn("hash", F.xxhash64(F.col(key).cast("string")))
    return hashed.withColumn("bucket", F.pmod("hash", F.lit(KEY_BUCKETS)).cast("int"))


def _file() -> Column:
    return F.col("_metadata.file_path")


def index_files(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(file, hash, bucket): which hashes of the key each data file holds, in folders by bucket; stored with the table.

    Only files that are not indexed yet are read, and of them only the key.
    """
    place = posixpath.join(path, KEYS, key)
    schema = "file string, hash long, bucket int"
    files = commits.Files(spark, path)
    rows = spark.read.parquet(path).select(_file().alias("file"), F.col(key))
    new = None
    if files.data_files(posixpath.join(KEYS, key)):
        # Whole files drop out of the scan: the filter on the file's name is applied to the list of files.
        held = spark.read.schema(schema).parquet(place).select("file").distinct()
        new = sorted({row[0] for row in spark.read.parquet(path).select(_file()).distinct().collect()} - {row[0] for row in held.collect()})
        rows = rows.filter(_file().isin(new))
    if new is None or new:
        (_hashed(rows, key).select("file", "hash", "bucket").distinct().repartitionByRange("bucket", "hash")
         .write.mode("append").partitionBy("bucket").parquet(place))
    return spark.read.schema(schema).parquet(place)


def files_with(spark: SparkSession, path: str, key: str, ids: DataFrame) -> list[str]:
    """Names of the files that hold one of the ids. The index narrows them down, then their keys are read.

    Each id meets only the files of its hash, so the work grows with the index's rows in the ids' buckets and not with all
    pairs of a file and an id.
    """
    index = index_files(spark, path, key)
    wanted = ids.select(F.col(ids.columns[0]).alias("id")).filter("id IS NOT NULL").distinct()
    asked = _hashed(wanted, "id")
    buckets = sorted(row[0] for row in asked.select("bucket").distinct().collect())  # at most KEY_BUCKETS
    likely = index.filter(F.col("bucket").isin(buckets)).join(asked, ["bucket", "hash"], "left_semi")
    candidates = sorted(row[0] for row in likely.select("file").distinct().collect())
    if not candidates:
        return []
    held = spark.read.parquet(path).filter(_file().isin(candidates)).select(_file().alias("file"), F.col(key).alias("id"))
    return sorted(row[0] for row in held.join(wanted, "id", "left_semi").select("file").distinct().collect())


def erase_stored(spark: SparkSession, tables: dict[str, str], ids: DataFrame, staging: str, run_id: str,
                 partitions: dict[str, list[str]] | None = None) -> dict[str, int]:
    """Takes the rows of the given ids out of stored tables: `tables` maps a folder to its key column.

    `partitions` names the partition columns of a folder that has them. Returns how many files of each folder were written
    anew; all other files are left as they are. A run that stopped is finished by the next one, and may be repeated.
    """
    wanted, written = ids.select(F.col(ids.columns[0]).alias("_id")).distinct(), {}
    for n, (path, key) in enumerate(sorted(tables.items())):
        path = path.rstrip("/")
        commits.finish(spark, path)
        held = files_with(spark, path, key, ids)
        written[path] = len(held)
        if not held:
            continue
        rows = spark.read.parquet(path)
        kept = rows.filter(_file().isin(held)).join(wanted, F.col(key) == F.col("_id"), "left_anti")
        staged, by = posixpath.join(staging, run_id, str(n)), (partitions or {}).get(path, [])
        commits.Files(spark, staged).delete("")
        kept.write.partitionBy(*by).parquet(staged)
        files = commits.Files(spark, path)
        commits.publish(spark, path, staged, [files.relative(name) for name in held], f"{run_id}-{n}")
    return written
