"""Connected components of links: forests of bounded blocks of links, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import durable

#: Links that one task joins in memory at a time.
BLOCK = 1 << 18


def _edges(df: DataFrame) -> DataFrame:
    return df.filter("u <> v").distinct()


def _forest(links: DataFrame) -> DataFrame:
    """u, v: every node of a block of links with the smallest node that the block joins it to. Not more rows than nodes."""
    def stars(block: pd.DataFrame) -> pd.DataFrame:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := above.setdefault(x, x)) != x:
                above[x] = above[y]
                x = y
            return x

        for u, v in zip(block["u"].tolist(), block["v"].tolist()):
            x, y = top(u), top(v)
            above[max(x, y)] = min(x, y)
        nodes = [x for x in above if top(x) != x]
        return pd.DataFrame({"u": nodes, "v": [top(x) for x in nodes]}, dtype="int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= BLOCK:
                yield stars(pd.concat(held))
                held = []
        if held:
            yield stars(pd.concat(held))

    return links.mapInPandas(run, "u bigint, v bigint")


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node move to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least")))
    return _edges(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and the node, move to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = durable(down.groupBy("u").agg(F.min("v").alias("least")))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return _edges(moved.unionByName(least.withColumnRenamed("least", "v")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one smaller end, which is no larger end of another edge."""
    ends = edges.select(F.col("u").alias("node"), "v").unionByName(
        edges.select(F.col("v").alias("node"), F.lit(None).cast("bigint").alias("v")))
    several = ends.groupBy("node").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_if(F.col("v").isNull()).alias("below"))
    return several.filter("lo <> hi or (lo is not null and below > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links(u, v) -> node, label: the smallest node of its component, for every node with a link to another one.

    Blocks of `BLOCK` links give their forests first, so few links are left to the steps between blocks. The number of
    these grows with the logarithm of the longest path; a step never makes more edges than it had.
    """
    stored = durable(links.select("u", "v").filter("u <> v"))
    tasks = stored.count() // BLOCK + 1
    edges = durable(_edges(_forest(stored.coalesce(tasks))))
    while not _are_stars(edges):
        edges = durable(_small_star(durable(_large_star(edges))))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
