"""Mixing sources to target weights.

Sizes are summed per source, targets and repetition rates derived from the sums, and every document is emitted
floor(rate) times, plus once more with the rate's fraction as probability, drawn from a seeded hash of the document.

Defined results: sources are ordered by code point, null last, and weigh 1, 2, 3, 1, 2, 3, ... The mix is as large as
the input. A target stops at `most` times its source's size and the excess is shared anew by weight among the others.
A null text has size 0. A source without any word has target 0 and rate 1: its documents cost nothing and stay once.
Rows with the same id draw alike; rows without an id draw by their text. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import durable, fresh, words_in

MOST = 3
SEED = "mix-1"
WEIGHTS = 3
EXACT = "decimal(38,0)"


def source_rates(sizes: DataFrame, most: int = MOST, weights: int = WEIGHTS) -> DataFrame:
    """sizes(source, size), a row per document -> source, source_size, weight, target, rate.

    Sources are numbered by range-sorted parts and the parts' counts, so no task needs all sources. Sharing the excess
    is a fixed point of sums: each round caps the sources above their limit, until no more are.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = F.col("source").asc_nulls_last()
    parts = durable(totals.repartitionByRange(ordered).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(ordered)) + F.col("before")
    sources = durable(parts.join(before, "part").select(
        "source", "source_size", ((place - 1) % weights + 1).cast("bigint").alias("weight")))

    whole = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    rest, weight, n_capped = int(whole["size"] or 0), int(whole["weight"] or 0), 0
    limit = F.col("source_size").cast(EXACT) * most

    def capped() -> Column:
        return limit * F.lit(weight).cast("decimal(18,0)") <= F.lit(rest).cast(EXACT) * F.col("weight").cast("decimal(18,0)")

    while rest:
        at = capped()
        row = sources.agg(
            F.count_if(at).alias("n"), F.sum(F.when(at, F.col("source_size") * most)).alias("size"),
            F.sum(F.when(at, F.col("weight"))).alias("weight")).first()
        if row["n"] == n_capped:
            break
        n_capped, rest = row["n"], int(whole["size"]) - int(row["size"] or 0)
        weight = int(whole["weight"]) - int(row["weight"] or 0)
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(max(weight, 1)))
    target = F.when(capped(), F.col("source_size").cast("double") * most).otherwise(share) if rest else F.lit(0.0)
    return sources.withColumn("target", target).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0))


def _draw(identity: Column, text: Column, seed: str) -> Column:
    """Uniform in [0, 1): 52 bits of a hash of the seed and the id, or the text of a row without an id."""
    key = F.concat(F.lit(seed), F.lit(":"), F.coalesce(identity.cast("string"), F.concat(F.lit("text:"), text), F.lit("")))
    return F.conv(F.left(F.md5(key), F.lit(13)), 16, 10).cast("bigint") / F.lit(float(2**52))


def _copies(rate: Column, draw: Column) -> Column:
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("bigint")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST,
        seed: str = SEED) -> DataFrame:
    """One row per row of `docs`: id, source, size, source_size, target, rate, copies and taken words."""
    rows = durable(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_in(text_col).alias("size"),
        _draw(F.col(id_col), F.col(text_col), seed).alias("draw")))
    rates = durable(source_rates(rows.select("source", "size"), most))
    return (rows.withColumnRenamed("source", "of").join(rates, F.col("of").eqNullSafe(F.col("source")))
            .withColumn("copies", _copies(F.col("rate"), F.col("draw")))
            .select(F.col("id").alias(id_col), F.col("of").alias(source_col), "size", "source_size", "target", "rate",
                    "copies", (F.col("copies") * F.col("size")).alias("taken")))


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST,
         seed: str = SEED) -> DataFrame:
    """The mixed rows themselves: each row of `docs`, with all its columns, as often as the mix takes it."""
    sizes = docs.select(F.col(source_col).alias("source"), words_in(text_col).alias("size"))
    of, rate = fresh(docs, "of"), fresh(docs, "rate")
    rates = durable(source_rates(sizes, most).select(F.col("source").alias(of), F.col("rate").alias(rate)))
    copies = _copies(F.col(rate), _draw(F.col(id_col), F.col(text_col), seed))
    copy = fresh(docs, "copy")
    return (docs.join(rates, F.col(source_col).eqNullSafe(F.col(of)))
            .withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(*docs.columns))
