"""Exact duplicates by a heavy-hitter split.

Misra-Gries counters find the few digests that may be very frequent. Their exact counts are verified, and the
winners of the verified ones, at most 1 / `support` rows, are broadcast: the rows of those groups are settled on the
map side. All other groups hold less than a `support` share of the rows and are settled by an ordinary shuffle.

Defined results: a null text counts as empty, so null and empty texts are one group. Of a group the row with the
smallest id stays; null ids come last; of rows with equal id and text one stays. An empty table gives no rows. Extra
columns are carried along unseen by `keep_first` and ignored by `exact_groups`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import durable, fresh, plain_text

#: Share of the rows from which a digest counts as frequent; its inverse bounds counters and broadcast.
SUPPORT = 0.001


def _settled(rows: DataFrame, support: float) -> DataFrame:
    """rows(id, row, digest) -> the same with keep_id, keep_row and group_size. `rows` must be a stored table."""
    order = F.struct(F.col("id").isNull(), "id", "row")
    candidates = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    least = F.greatest(F.lit(2), F.floor(F.lit(support) * rows.count()))
    frequent = durable(
        rows.join(F.broadcast(candidates), "digest")
        .groupBy("digest").agg(F.count("*").alias("group_size"), F.min(order).alias("first"))
        .filter(F.col("group_size") >= least)
        .select("digest", "group_size", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row")))
    heavy = rows.join(F.broadcast(frequent), "digest")
    group = Window.partitionBy("digest")
    first = F.min(order).over(group)
    light = rows.join(F.broadcast(frequent.select("digest")), "digest", "left_anti").select(
        "digest", "id", "row", F.count("*").over(group).alias("group_size"),
        first["id"].alias("keep_id"), first["row"].alias("keep_row"))
    return heavy.select(*light.columns).unionByName(light)


def _digest(text: str):
    return F.sha2(plain_text(text), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256."""
    rows = durable(docs.select(F.col(id_col).alias("id"), _digest(text_col).alias("digest"))
                   .withColumn("row", F.monotonically_increasing_id()))
    return _settled(rows, support).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of `docs` that stay, with all their columns. The rows are stored once, with a number each."""
    row, digest = fresh(docs, "row"), fresh(docs, "digest")
    stored = durable(docs.withColumn(digest, _digest(text_col)).withColumn(row, F.monotonically_increasing_id()))
    rows = stored.select(F.col(id_col).alias("id"), F.col(row).alias("row"), F.col(digest).alias("digest"))
    lost = _settled(rows, support).filter(F.col("row") != F.col("keep_row")).select(F.col("row").alias(row))
    return stored.join(lost, row, "left_anti").select(*docs.columns)
