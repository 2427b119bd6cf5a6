"""Approximate nearest neighbours by balanced posting lists.

Centroids of even cells are fitted on a bounded sample and joined by an in-memory graph, which finds the centroids near
a vector without looking at all of them. Every vector is indexed: in the list of its nearest centroid and, if it lies
at a boundary, in the lists of those about as near. A query opens the lists whose centroids are not much farther than
its nearest one, by the ratio of their distances. Lists are searched as matrices, in Spark groups of bounded size.

The ratio is measured: the true neighbours of a sample of queries are found by comparing them with all vectors, and the
ratio is taken at which their lists hold `TARGET` of them. No number of lists bounds a query: where the graph's beam
ends before the ratio does, all centroids are looked at.

Equal vectors are indexed once, with the k + 1 smallest of their ids: as ties go to smaller ids, others can never be
among the k nearest of any query. Equal queries are searched once. So a vector with a large share of all rows is one
vector of one list. Lists and queries of a list are split into parts of at most about `PART`.

Defined results: nearness is the cosine in double precision on the original vectors, ties go to smaller ids. Vectors
that are null, zero, hold null or non-finite components, or lack an id take no part; nor do those of another length
than most (of equally frequent lengths the smaller one counts). Parallel vectors are as near as their cosine in doubles
tells: where it is equal, smaller ids come first. A query gets fewer than k rows only where there are
fewer candidates. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import durable
from marquee.scale import top_per_key

#: Components of the fitted sample, and vectors of a list.
SAMPLE, LIST = 4_000_000, 160
MOST_CENTROIDS = 4096
#: Links of a centroid in the graph, width of the search in it, and places where it begins.
LINKS, BEAM, ENTRIES = 16, 96, 16
#: A vector joins lists of centroids up to (1 + NEAR) times as far as its nearest, at most COPIES of them.
NEAR, COPIES = 0.08, 4
#: A query opens lists of centroids up to (1 + OPEN) times as far as its nearest one, or farther if TARGET of the true
#: neighbours of PROBES queries need it.
OPEN = 0.25
TARGET, PROBES = 0.98, 256
PART = 2048
#: A query's lists are searched nearest first, in rounds that end behind so many of them; the last has all others.
ROUNDS = (8, 64)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix.astype(np.float64)
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def even_cells(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of cells of even size: halves along the direction of most variance, cut at the median, again and again."""
    rng, pending, found = np.random.default_rng(7), [(np.arange(len(sample)), cells)], []
    while pending:
        rows, n = pending.pop()
        if n <= 1 or len(rows) <= 1:
            found.append(unit(sample[rows].mean(axis=0, keepdims=True) + 1e-12)[0])
            continue
        x = sample[rows] - sample[rows].mean(axis=0)
        axis = rng.normal(size=x.shape[1])
        for _ in range(8):
            axis = x.T @ (x @ axis)
            axis /= np.linalg.norm(axis) + 1e-30
        order = np.argsort(x @ axis, kind="stable")
        cut = len(rows) * (n // 2) // n
        pending += [(rows[order[cut:]], n - n // 2), (rows[order[:cut]], n // 2)]
    centroids = np.array(found)
    for _ in range(3):  # let the cells settle
        own = np.concatenate([(sample[i: i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.stack([np.bincount(own, weights=sample[:, j], minlength=len(centroids)) for j in range(sample.shape[1])], axis=1)
        filled = np.abs(sums).sum(axis=1) > 0
        centroids[filled] = unit(sums[filled])
    return centroids


class Graph:
    """Centroids, each linked to its nearest ones and to its successor, and searched by a beam for many vectors at once."""

    def __init__(self, centroids: np.ndarray):
        n = len(centroids)
        self.centroids = centroids
        near = [np.argsort(-(centroids[i: i + 512] @ centroids.T), axis=1, kind="stable")[:, 1: LINKS + 1] for i in range(0, n, 512)]
        after = ((np.arange(n) + 1) % n)[:, None]
        self.links = np.concatenate((np.concatenate(near), after), axis=1) if n > 1 else np.zeros((1, 1), np.int64)
        self.entries = np.unique(np.linspace(0, n - 1, ENTRIES).astype(np.int64))

    def search(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of each unit vector's nearest found, nearest first; -1 fills up."""
        n, k = len(vectors), len(self.centroids)
        width = max(BEAM, len(self.entries))
        ids = np.full((n, width), -1)
        sims = np.full((n, width), -np.inf)
        ids[:, : len(self.entries)] = self.entries
        sims[:, : len(self.entries)] = vectors @ self.centroids[self.entries].T
        seen = np.zeros((n, k), bool)
        seen[:, self.entries] = True
        spent = sims == -np.inf
        while True:
            open_ = np.where(spent, -np.inf, sims)
            best = open_.argmax(axis=1)
            rows = np.flatnonzero(open_[np.arange(n), best] > -np.inf)
            if not len(rows):
                break
            spent[rows, best[rows]] = True
            linked = self.links[ids[rows, best[rows]]]
            new = ~seen[rows[:, None], linked]
            seen[rows[:, None], linked] = True
            new[:, -1] &= (linked[:, :-1] != linked[:, -1:]).all(axis=1)
            found = np.where(new, np.einsum("rmd,rd->rm", self.centroids[linked], vectors[rows]), -np.inf)
            all_sims = np.concatenate((sims[rows], found), axis=1)
            kept = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[rows] = np.take_along_axis(np.concatenate((ids[rows], linked), axis=1), kept, 1)
            spent[rows] = np.take_along_axis(np.concatenate((spent[rows], ~new), axis=1), kept, 1)
            sims[rows] = np.take_along_axis(all_sims, kept, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        sims = np.take_along_axis(sims, order, 1)
        ids = np.where(sims > -np.inf, np.take_along_axis(ids, order, 1), -1)
        return ids, np.sqrt(np.maximum(0, 2 - 2 * np.maximum(sims, -1.0)))

    def scan(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All centroids and their distances for each unit vector, nearest first."""
        sims = vectors @ self.centroids.T
        ids = np.argsort(-sims, axis=1, kind="stable")
        return ids, np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, ids, 1)))


def _fit(vectors: DataFrame, n: int, length: int) -> Graph:
    """A graph of centroids from a sample of at most `SAMPLE` components, taken in the order of a hash."""
    size = max(1, SAMPLE // length)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"packed": [np.asarray(v, np.float64).tobytes() for v in batch["vector"]]})

    rows = vectors.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(size).mapInPandas(pack, "packed binary").collect()
    sample = unit(np.array([np.frombuffer(row["packed"]) for row in rows]))
    return Graph(even_cells(sample, max(1, min(-(-n // LIST), MOST_CENTROIDS, len(sample) // 4))))


def _lists_of(vectors: DataFrame, graph: Graph, chosen, all_chosen: bool = False) -> DataFrame:
    """`vectors` with one row for each list that chosen(graph, ids, distances) tells, and the round of its search.

    With `all_chosen`, vectors for which all that the beam holds is chosen are compared with all centroids.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(graph)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.iloc[a: a + 512]
                points = unit(np.stack(part["vector"].to_numpy()))
                ids, distance = shared.value.search(points)
                taken = chosen(shared.value, ids, distance) & (ids >= 0)
                more = taken.all(axis=1) & all_chosen & (ids.shape[1] < len(shared.value.centroids))
                at, rank = np.nonzero(taken & ~more[:, None])
                yield part.iloc[at].assign(list=ids[at, rank], turn=np.searchsorted(ROUNDS, rank, side="right"))
                if more.any():
                    ids, distance = shared.value.scan(points[more])
                    at, rank = np.nonzero(chosen(shared.value, ids, distance))
                    for b in range(0, len(at), 16 * PART):  # a vector may have thousands of lists
                        i, j = at[b: b + 16 * PART], rank[b: b + 16 * PART]
                        yield part.iloc[np.flatnonzero(more)[i]].assign(list=ids[i, j], turn=np.searchsorted(ROUNDS, j, side="right"))

    schema = vectors.select("*", F.lit(0).alias("list"), F.lit(0).alias("turn")).schema
    return vectors.mapInPandas(run, schema)


def _at_boundary(graph: Graph, ids: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """The nearest list, and others about as near, unless their centroid is nearer to the nearest list's than to the vector."""
    take = distance <= (1 + NEAR) * distance[:, :1]
    apart = np.linalg.norm(graph.centroids[ids] - graph.centroids[ids[:, :1]], axis=2)
    take &= apart >= distance
    take[:, 0] = True
    return take & (np.cumsum(take, axis=1) <= COPIES)


def _needed_ratio(vectors: DataFrame, asking: DataFrame, posted: DataFrame, graph: Graph, k: int) -> float:
    """The ratio of distances within which lists hold `TARGET` of the true neighbours of at most `PROBES` queries."""
    probes = vectors.join(asking.select("node").distinct(), "node", "left_semi").select("node", "vector").orderBy(
        F.xxhash64("node"), "node").limit(PROBES).collect()
    if not probes:
        return 1 + OPEN
    nodes, points = np.array([r["node"] for r in probes]), unit(np.array([r["vector"] for r in probes]))
    shared = vectors.sparkSession.sparkContext.broadcast((nodes, points))

    def closest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, points = shared.value
        for batch in batches:
            for a in range(0, len(batch), 4096):
                theirs = batch["node"].to_numpy()[a: a + 4096]
                close = points @ unit(np.stack(batch["vector"].to_numpy()[a: a + 4096])).T
                close[nodes[:, None] == theirs[None, :]] = -np.inf
                most = min(len(theirs), k)
                at = np.argpartition(-close, most - 1, axis=1)[:, :most]
                yield pd.DataFrame({"probe": np.repeat(np.arange(len(nodes)), most), "node": theirs[at.ravel()],
                                    "close": np.take_along_axis(close, at, 1).ravel()})

    near = vectors.select("node", "vector").mapInPandas(closest, "probe int, node bigint, close double").filter("close > double('-infinity')")
    true = durable(top_per_key(near, ["probe"], [F.desc("close"), F.col("node")], k))
    lists = posted.select("node", "list").join(true.select("probe", "node"), "node").collect()  # PROBES * k * COPIES at most
    if not lists:
        return 1 + OPEN
    distance = np.sqrt(np.maximum(0, 2 - 2 * points @ graph.centroids.T))
    found = pd.DataFrame({"probe": [r["probe"] for r in lists], "node": [r["node"] for r in lists], "list": [r["list"] for r in lists]})
    found["ratio"] = distance[found["probe"], found["list"]] / np.maximum(distance.min(axis=1), 1e-12)[found["probe"]]
    ratios = np.sort(found.groupby(["probe", "node"])["ratio"].min().to_numpy())
    return max(1 + OPEN, ratios[int(np.ceil(TARGET * len(ratios))) - 1] * (1 + 1e-9))


def _searched(asked: DataFrame, posted: DataFrame, best: DataFrame, k: int, kind: str) -> DataFrame:
    """`best` (asks, score, other), the k + 1 best so far of each query, after a search of the lists that `asked` names.

    What a query has so far is its bound: of a list, only vectors at least as near as its k + 1st best are sent on.
    """
    floors = best.groupBy("asks").agg(F.when(F.count("*") > k, F.min("score")).alias("floor"))
    bounded = asked.join(floors, asked["node"] == floors["asks"], "left").select("list", "node", "vector", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
    loads = durable(asked.groupBy("list").agg((F.floor(F.count("*") / PART) + 1).alias("chunks")).join(
        posted.groupBy("list").agg((F.floor(F.count("*") / PART) + 1).alias("parts")), "list"))
    part, chunk = F.pmod(F.xxhash64("node"), F.col("parts")), F.pmod(F.xxhash64("node"), F.col("chunks"))
    left = bounded.join(loads, "list").withColumn("chunk", chunk).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    right = posted.join(loads, "list").withColumn("part", part).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))

    def search(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(v):
            ours, theirs = (np.stack(x["vector"].to_numpy()).astype(np.float64) for x in (q, v))
            norms, firsts = np.sqrt((theirs * theirs).sum(axis=1)), np.array([ids[0] for ids in v["ids"]])
            close = unit(ours) @ unit(theirs).T
            most = min(len(v), k + 1)
            # All about as near as the last one that counts, however many: exact scores and ids decide among them.
            cut = np.maximum(-np.partition(-close, most - 1, axis=1)[:, most - 1], q["floor"].to_numpy()) - 1e-9
            for i, (node, x, floor) in enumerate(zip(q["node"], ours, q["floor"])):
                at = np.flatnonzero(close[i] >= cut[i])
                score = (theirs[at] * x).sum(axis=1) / (norms[at] * np.sqrt((x * x).sum()))
                for j in np.lexsort((firsts[at], -score))[: k + 1]:
                    if score[j] >= floor:
                        out.append((node, v["node"].iat[at[j]], score[j], v["ids"].iat[at[j]]))
        return pd.DataFrame(out, columns=["asks", "node", "score", "ids"])

    keys = ["list", "part", "chunk"]
    found = left.select(*keys, "node", "vector", "floor").groupBy(*keys).cogroup(right.select(*keys, "node", "vector", "ids").groupBy(*keys)).applyInPandas(
        search, f"asks bigint, node bigint, score double, ids array<{kind}>")
    # A vector of several lists is found several times; equal vectors have several ids.
    rows = found.select("asks", "score", F.explode("ids").alias("other")).unionByName(best).distinct()
    return top_per_key(rows, ["asks"], [F.desc("score"), F.col("other")], k + 1)


def nearest(rows: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: the k nearest found of every row for which `queries` is true."""
    plain = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")
                        ).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    common = plain.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    spark = rows.sparkSession
    kind = plain.schema["id"].dataType.simpleString()
    result = f"query_id {kind}, rank int, {id_col} {kind}, score double"
    if common is None:
        return spark.createDataFrame([], result)
    length = common["length"]
    plain = plain.filter(F.size("vector") == length)
    copies = top_per_key(plain.select("vector", "id").distinct(), ["vector"], [F.col("id")], k + 1)
    vectors = durable(copies.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
                      .withColumn("node", F.monotonically_increasing_id()))
    n = vectors.count()
    graph = _fit(vectors, n, length)
    posted = durable(_lists_of(vectors, graph, _at_boundary))
    sizes = {r["list"]: r["count"] for r in posted.groupBy("list").count().collect()}  # one row per centroid
    held = np.array([sizes.get(i, 0) for i in range(len(graph.centroids))])
    asking = durable(plain.filter("asks").select("id", "vector").join(vectors.select("vector", "node"), "vector").select("id", "node"))
    ratio = _needed_ratio(vectors, asking, posted, graph, k)

    def opened(graph: Graph, ids: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Lists within the ratio, and at any rate enough to hold several times k vectors."""
        there = np.where(ids >= 0, held[ids], 0)
        return (distance <= ratio * distance[:, :1]) | (np.cumsum(there, axis=1) - there < 8 * (k + 1))

    asked = durable(_lists_of(vectors.join(asking.select("node").distinct(), "node", "left_semi").select("node", "vector"), graph, opened, True))
    best = spark.createDataFrame([], f"asks bigint, score double, other {kind}")
    for turn in range(len(ROUNDS) + 1):
        best = durable(_searched(asked.filter(F.col("turn") == turn), posted, best, k, kind))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "other")
    return (asking.distinct().select(F.col("id").alias("query_id"), F.col("node").alias("asks")).join(best, "asks")
            .filter("query_id <> other").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("other").alias(id_col), "score"))
