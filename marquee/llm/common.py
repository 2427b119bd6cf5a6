"""What the operators of this subpackage share: tables, names that cannot clash, durable steps, patterns."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.scale import durable, passing

__all__ = ["SPACE", "WORD", "durable", "fresh", "ids_as_text", "passing", "plain_text", "release", "table", "through_python", "words_in"]

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have, whatever the case of its letters."""
    taken = {name.lower() for name in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def plain_text(column: Column | str) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    value = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(F.coalesce(value, F.lit("")), SPACE, " ")


def ids_as_text(df: DataFrame, column: str = "id") -> DataFrame:
    """Whole-number ids as text for Python: beside nulls, pandas would turn them into floats and change those above 2^53."""
    whole = dict(df.dtypes)[column] in ("tinyint", "smallint", "int", "bigint")
    return df.withColumn(column, F.col(column).cast("string")) if whole else df


def through_python(df: DataFrame, run: Callable, columns: str, column: str = "id", name: str | None = None) -> DataFrame:
    """`mapInPandas` of rows with an id, which comes out as it went in; `columns` are the others, `name` its new name."""
    kind, told = dict(df.dtypes)[column], ids_as_text(df, column)
    made = told.mapInPandas(run, f"{column} {dict(told.dtypes)[column]}, {columns}").withColumn(column, F.col(column).cast(kind))
    return made.withColumnRenamed(column, name or column)


def words_in(column: Column | str) -> Column:
    """Number of words of a text; null has none."""
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.regexp_count(value, F.lit(WORD)), F.lit(0)).cast("bigint")


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of steps whose results are stored and whose frames are gone.

    The first collection frees the frames, the second what they held; the cleaner works beside them.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)
