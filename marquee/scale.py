"""Helpers that keep plans safe when one key holds a large share of the rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1,
                rank: str | None = None) -> DataFrame:
    """The first `k` rows of every key.

    Spark turns a filter on `row_number` into a group limit that also runs before the shuffle, so
    each map task sends at most `k` rows per key, however many rows the key has.
    """
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


SPREAD = 16


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", parts: int = SPREAD
                ) -> DataFrame:
    """Join to a side with few rows per key, each key of the left side being spread over `parts` tasks.

    The right side is repeated for every part. A left row's part is a hash of its whole content, so the
    same row always goes to the same part, also when a lost task is run again. Adaptive execution
    cannot split a hot key when the right side is fresh out of an aggregation or window on that key,
    which is where this is used.

    Both sides are shuffled: Spark's estimate of an exploded table leaves the copies out, so it would plan to broadcast
    one of any size through the driver, which it does not take back when the size is known.
    """
    hashable = [name for name, kind in left.dtypes if "map<" not in kind and "variant" not in kind]
    salted = left.withColumn("_part", F.pmod(F.xxhash64(*hashable), F.lit(parts)).cast("int"))
    repeated = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).hint("merge")
    return salted.join(repeated, [*keys, "_part"], how).drop("_part")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one named by `spark.checkpoint.dir`, which all executors must share.

    Only a session that runs in one process, as in tests, may leave it unset and gets a scratch folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="checkpoint-"))
    return f"{context.getCheckpointDir().rstrip('/')}/{uuid.uuid4().hex}"


_passing: ContextVar[list[str] | None] = ContextVar("_passing", default=None)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that `durable` stores inside are deleted at the end, so nothing that outlives it may read them.

    A table that is to stay is stored by `durable` after all others, as the last one inside.
    """
    stored: list[str] = []
    token = _passing.set(stored)
    try:
        yield
    finally:
        _passing.reset(token)
        for name in stored[:-1]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the checkpoint folder and go on from there.

    What follows survives lost executors without recomputing what came before, and, unlike with a
    checkpoint of rows, reads only the columns it needs.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    if (stored := _passing.get()) is not None:
        stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def distinct_values(df: DataFrame, column: str, limit: int = 1000) -> list:
    """Sorted non-NULL values of a column that is to become columns; too many of them is an error."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} distinct values, too many to turn into columns")
    return sorted(row[0] for row in rows)


def running_count(df: DataFrame, keys: Sequence[str], position: str, count: str, name: str,
                  width: int = 65_536) -> DataFrame:
    """Sum of `count` over rows of the same key with a position up to this row's, as column `name`.

    `position` is a non-negative integer, unique within a key. Rows are summed inside fixed ranges of
    `width` positions and the ranges' totals are added, so no window holds a whole key.
    """
    part = F.floor(F.col(position) / F.lit(width)).cast("bigint")
    parted = df.withColumn("_part", part)
    totals = parted.groupBy(*keys, "_part").agg(F.sum(count).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_part").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    inside = parted.withColumn("_inside", F.sum(count).over(within))
    joined = inside.join(offsets, [*keys, "_part"])
    return joined.withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside")


def numbered_by_hash(df: DataFrame, keys: Sequence[str], identity: Sequence[Column], name: str) -> DataFrame:
    """Number the rows of every key 1, 2, 3, ... in the order of a hash of their unique identity.

    The leading digits of the hash split a key into 4,096 parts. Rows are numbered inside their part
    and the parts' sizes are added, so a key with most of the rows is still spread over many tasks.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat_ws("\u0001", *[c.cast("string") for c in identity])))
    parted = hashed.withColumn("_part", F.left("_hash", F.lit(3)))
    sizes = parted.groupBy(*keys, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_part").orderBy("_hash")
    inside = parted.withColumn("_inside", F.row_number().over(within))
    joined = inside.join(offsets, [*keys, "_part"])
    return joined.withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint")).drop(
        "_part", "_hash", "_before", "_inside")
