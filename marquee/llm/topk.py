"""Exact top-k by inner product: branch and bound over vectors stored dimension by dimension.

Vectors are turned to whole numbers and packed in blocks of about `BLOCK`: one matrix for each `WIDTH` dimensions, those
with most mass first, each beside the mass that is left of every vector behind it. A group of queries adds up its products
one such matrix after the other. A candidate goes as soon as what it has, plus the most that the masses left on both sides
allow (Cauchy-Schwarz), is below the k-th best score of every query of the group; survivors are compacted.

Blocks are searched in rounds that grow eightfold, and the k-th best score of one round is the bound that the next begins
with. So a round sends little more than what replaces earlier candidates, not k rows for each query and block. Queries
are packed too, in chunks of about `CHUNK`; a pair of block and chunk is one bounded group of Spark.

Defined results: scores are exact. Products are added in doubles where the norms prove that no sum leaves their whole
numbers, else in whole numbers of any size; a score beyond 64 bits is an error. Vectors that are null, hold null or
non-finite components, or lack an id take no part. Vectors meet only those of their own length. Rows are told apart by
position, so repeated rows are candidates of each other and each asks for itself. Ties go to smaller ids. A query has
fewer than k rows only where it has fewer candidates. Empty tables give no rows, extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import durable
from marquee.scale import top_per_key

#: Vectors of a block, queries of a chunk, and how much larger a round is than all before it.
BLOCK, CHUNK, GROWTH = 16_384, 4096, 8
#: Dimensions of a matrix; vectors and queries that are searched together.
WIDTH, SLICE, GROUP = 8, 2048, 32
#: Doubles hold whole numbers up to here.
EXACT = 2.0 ** 53


def scaled(vector: Column, scale: int = 1024) -> Column:
    """scale * x of every component, as doubles that `Block` rounds down; null where a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(vector, lambda x: x.cast("double") * scale))


def _norms(matrix: np.ndarray) -> np.ndarray:
    """Upper bounds of the columns' norms."""
    return np.sqrt((matrix * matrix).sum(axis=0)) * (1 + 1e-9)


class Block:
    """Vectors as columns, cut into bands of dimensions."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.lexsort((rows, ids))
        self.rows, self.ids = rows[by_id], ids[by_id]
        columns = np.floor(vectors[by_id].T)
        with np.errstate(over="ignore", invalid="ignore"):
            mass = (columns * columns).sum(axis=1)
            self.norms = _norms(columns)
        self.order = np.argsort(-mass, kind="stable")
        columns = columns[self.order]
        small = np.abs(columns).max(initial=0) < 2 ** 31
        self.bands = [columns[i: i + WIDTH].astype(np.int32 if small else np.float64) for i in range(0, len(columns), WIDTH)]
        with np.errstate(over="ignore", invalid="ignore"):
            self.left = [_norms(columns[i + WIDTH:]) for i in range(0, len(columns), WIDTH)]

    def best(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query, candidate, score), by their places, of each query's k best that reach its floor; ties to smaller ids."""
        queries = np.floor(queries)
        with np.errstate(over="ignore", invalid="ignore"):
            sure = bool(np.all(_norms(queries.T).max(initial=0) * self.norms.max(initial=0) < EXACT))
        if not sure:
            return self._best_of_any_size(queries, own, floor, k)
        out = []
        for a in range(0, len(queries), GROUP):
            out += [(a + i, j, s) for i, j, s in self._best_of_group(
                queries[a: a + GROUP][:, self.order], own[a: a + GROUP], floor[a: a + GROUP].copy(), k)]
        return out

    def _best_of_group(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        after = [_norms(queries[:, i + WIDTH:].T) for i in range(0, queries.shape[1], WIDTH)]
        held = [(np.zeros(0, np.int64), np.zeros(0)) for _ in queries]
        for a in range(0, len(self.rows), SLICE):
            kept = np.arange(a, min(a + SLICE, len(self.rows)))
            sums = np.zeros((len(queries), len(kept)))
            for n, band in enumerate(self.bands):
                sums += queries[:, n * WIDTH: (n + 1) * WIDTH] @ band[:, kept].astype(np.float64)
                most = sums + after[n][:, None] * self.left[n][kept][None, :]
                alive = (most >= floor[:, None]).any(axis=0)
                if alive.mean() < 0.9:
                    kept, sums = kept[alive], sums[:, alive]
                if not len(kept):
                    break
            if not len(kept):
                continue
            for i in np.flatnonzero((sums >= floor[:, None]).any(axis=1)):
                here = np.flatnonzero((sums[i] >= floor[i]) & (self.rows[kept] != own[i]))
                places, scores = np.concatenate((held[i][0], kept[here])), np.concatenate((held[i][1], sums[i][here]))
                first = np.lexsort((places, -scores))[:k]  # places are in the order of ids
                held[i] = places[first], scores[first]
                if len(first) == k:
                    floor[i] = max(floor[i], scores[first[-1]])
        return [(i, int(j), int(s)) for i, (places, scores) in enumerate(held) for j, s in zip(places, scores)]

    def _best_of_any_size(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """The same in whole numbers of any size, without bounds."""
        columns = np.concatenate(self.bands) if self.bands else np.zeros((0, len(self.rows)))
        theirs = [[int(x) for x in column] for column in columns.T]
        out = []
        for i, query in enumerate(queries):
            ours = [int(x) for x in query[self.order]]
            scores = [(-sum(map(int.__mul__, ours, column)), j) for j, column in enumerate(theirs) if self.rows[j] != own[i]]
            out += [(i, j, -s) for s, j in sorted(scores)[:k] if -s >= floor[i]]
        return out


def _numbers(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))


def _rounds(n: int) -> list[tuple[float, float, int]]:
    """(from, to, blocks): shares of all vectors, the last ones `GROWTH` times as large as all before them."""
    steps = max(3, 1 + math.ceil(math.log(max(1, n / BLOCK), GROWTH)))
    edges = [0.0, *[float(GROWTH) ** (i - steps + 1) for i in range(steps)]]
    return [(a, b, max(1, math.ceil((b - a) * n / BLOCK))) for a, b in zip(edges, edges[1:])]


def top_products(rows: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
                 scale: int = 1024) -> DataFrame:
    """query_id, rank, id, score: the k largest inner products of every row for which `queries` is true."""
    spark = rows.sparkSession
    vectors = durable(rows.select(F.col(id_col).cast("bigint").alias("id"), scaled(F.col(vector_col), scale).alias("vector"),
                                  F.coalesce(queries, F.lit(False)).alias("asks"))
                      .filter("id is not null and vector is not null").withColumn("row", F.monotonically_increasing_id())
                      .withColumn("length", F.size("vector")))
    n, asking = vectors.agg(F.count("*"), F.count_if("asks")).first()
    share, spread = F.pmod(F.xxhash64("row", F.lit("round")), F.lit(1 << 20)) / (1 << 20), F.xxhash64("row", F.lit("block"))
    plan = _rounds(n)
    number = block = None
    for i, (low, high, parts) in enumerate(plan):
        inside = (share >= low) & (share < high)
        number = F.when(inside, i) if number is None else number.when(inside, i)
        block = F.when(inside, F.pmod(spread, F.lit(parts))) if block is None else block.when(inside, F.pmod(spread, F.lit(parts)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        packed = Block(group["row"].to_numpy(), group["id"].to_numpy(), _matrix(group["vector"]))
        return group.iloc[:1][["length", "round", "block"]].assign(packed=pickle.dumps(packed))

    blocks = durable(vectors.withColumn("round", number).withColumn("block", block).groupBy("length", "round", "block")
                     .applyInPandas(pack, "length int, round int, block bigint, packed binary"))
    chunks = max(1, math.ceil(asking / CHUNK))
    asked = vectors.filter("asks").withColumn("chunk", F.pmod(F.xxhash64("row", F.lit("chunk")), F.lit(chunks)))

    def pack_queries(group: pd.DataFrame) -> pd.DataFrame:
        packed = pickle.dumps((group["row"].to_numpy(), _matrix(group["vector"]), np.nextafter(group["floor"].to_numpy(np.float64), -np.inf)))
        return group.iloc[:1][["length", "chunk"]].assign(packed=packed)

    def search(asks: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asks) and len(block):
            ours, matrix, floor = pickle.loads(asks["packed"].iat[0])
            there = pickle.loads(block["packed"].iat[0])
            found = [(ours[i], there.ids[j], there.rows[j], s) for i, j, s in there.best(matrix, ours, floor, k)]
        return pd.DataFrame(found, columns=["query", "id", "row", "score"])

    best = spark.createDataFrame([], "query bigint, id bigint, row bigint, score bigint")
    for i, (_, _, parts) in enumerate(plan):
        floors = best.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        with_floor = asked.join(floors, asked["row"] == floors["query"], "left").select(
            "length", "chunk", "row", "vector", F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf"))).alias("floor"))
        packed = with_floor.groupBy("length", "chunk").applyInPandas(pack_queries, "length int, chunk bigint, packed binary")
        left = packed.withColumn("block", _numbers(parts))
        right = blocks.filter(F.col("round") == i).withColumn("chunk", _numbers(chunks))
        keys = ["length", "chunk", "block"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, best.schema)
        best = durable(top_per_key(best.unionByName(found), ["query"], [F.desc("score"), F.col("id"), F.col("row")], k))
    kind = rows.schema[id_col].dataType.simpleString()
    ranked = top_per_key(best, ["query"], [F.desc("score"), F.col("id"), F.col("row")], k, rank="rank")
    return ranked.join(asked.select(F.col("row").alias("query"), F.col("id").alias("asker")), "query").select(
        F.col("asker").cast(kind).alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").cast(kind).alias(id_col), "score")


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64).reshape(len(vectors), -1)
