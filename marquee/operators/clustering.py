"""User clustering: scaling, the K-Means sweep, quality measures and cluster descriptions.

Measures take a frame with one row per user, its feature columns and a `label` column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.scale import durable

BLOCK_ROWS = 20_000  # rows on each side of one silhouette task, at most
GROUPS = 24  # groups of rows that silhouette makes before its blocks are as large as that
ROWS_PER_PARTITION = 20_000
#: Rows of a packed block of the matrix, and rows from which starts are drawn.
BLOCK, START_ROWS = 256, 10_000


def scale_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Z-scores with the population deviation; a constant column becomes 0."""
    stats = df.agg(F.struct(*[
        part for name in columns
        for part in (F.avg(name).alias(f"m_{name}"), F.stddev_pop(name).alias(f"s_{name}"))])).scalar()
    given = df.withColumn("_stats", stats)

    def scaled(name: str) -> Column:
        mean, deviation = F.col("_stats")[f"m_{name}"], F.col("_stats")[f"s_{name}"]
        return F.when(deviation > 0, (F.col(name) - mean) / deviation).otherwise(F.lit(0.0)).alias(name)

    others = [name for name in df.columns if name not in columns]
    return given.select(*others, *[scaled(name) for name in columns])


# Measures for given labels
#
# A frame may carry several clusterings, one label column each. They are measured together, so that
# distances between rows are worked out once for all of them.

def _long(df: DataFrame, columns: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """One row per row and clustering: the features, `clustering` (the label column's name) and `label`."""
    typed = df.select(*[F.col(name).cast("double").alias(name) for name in columns],
                      *[F.col(name).cast("string").alias(name) for name in labels])
    return typed.unpivot(list(columns), list(labels), "clustering", "label")


def _label_stats(df: DataFrame, columns: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """One row per cluster: size, centroid and the sum of squared distances to it, in one pass."""
    spread = sum((F.var_pop(name) for name in columns[1:]), F.var_pop(columns[0]))
    return _long(df, columns, labels).groupBy("clustering", "label").agg(
        F.count("*").alias("n"),
        F.array(*[F.avg(name) for name in columns]).alias("centroid"),
        (spread * F.count("*")).alias("within"),
    )


def _squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, d: acc + d)


def _cluster_key(clustering: str = "clustering", label: str = "label") -> Column:
    return F.concat_ws("\u0001", F.col(clustering), F.col(label))


def _by_cluster(stats: DataFrame, value: str) -> Column:
    """Scalar map cluster -> value. It has one entry per cluster and is all that travels to the rows."""
    return stats.agg(F.map_from_entries(F.collect_list(F.struct(_cluster_key(), F.col(value))))).scalar()


def _inertia(df: DataFrame, columns: Sequence[str], labels: Sequence[str]) -> DataFrame:
    return _label_stats(df, columns, labels).groupBy("clustering").agg(F.sum("within").alias("inertia"))


def _calinski_harabasz(df: DataFrame, columns: Sequence[str], labels: Sequence[str]) -> DataFrame:
    stats = _label_stats(df, columns, labels)
    centre = F.array(*[F.sum(F.col("n") * F.col("centroid")[i]) / F.sum("n") for i in range(len(columns))])
    # The clusters of a clustering are few: one row holds them all.
    whole = stats.groupBy("clustering").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("within").alias("within"), centre.alias("centre"),
        F.collect_list(F.struct("n", "centroid")).alias("clusters"))
    between = F.aggregate(
        "clusters", F.lit(0.0),
        lambda acc, cluster: acc + cluster["n"] * _squared_distance(cluster["centroid"], F.col("centre")))
    ratio = (between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return whole.select("clustering", F.when(F.col("within") > 0, ratio).otherwise(F.lit(1.0)).alias("calinski_harabasz"))


def _davies_bouldin(df: DataFrame, columns: Sequence[str], labels: Sequence[str]) -> DataFrame:
    centroids = _by_cluster(_label_stats(df, columns, labels), "centroid")
    placed = _long(df, columns, labels).withColumn("_centroids", centroids).select(
        "clustering", "label", F.array(*columns).alias("x"), F.try_element_at("_centroids", _cluster_key()).alias("centroid"))
    spreads = placed.groupBy("clustering", "label").agg(
        F.avg(F.sqrt(_squared_distance(F.col("x"), F.col("centroid")))).alias("spread"),
        F.first("centroid").alias("centroid"))
    clusters = spreads.groupBy("clustering").agg(
        F.collect_list(F.struct("label", "spread", "centroid")).alias("clusters"))

    def worst(one: Column) -> Column:
        others = F.filter("clusters", lambda other: other["label"] != one["label"])
        ratios = F.transform(others, lambda other: (one["spread"] + other["spread"]) / F.nullif(
            F.sqrt(_squared_distance(one["centroid"], other["centroid"])), F.lit(0.0)))
        return F.coalesce(F.array_max(ratios), F.lit(0.0))

    total = F.aggregate("clusters", F.lit(0.0), lambda acc, one: acc + worst(one))
    return clusters.select("clustering", (total / F.size("clusters")).alias("davies_bouldin"))


def _mean_score(parts: DataFrame) -> DataFrame:
    """Mean silhouette of rows given own cluster size `n`, own mean distance `a` and nearest other `b`."""
    score = F.when(F.col("n") > 1, F.coalesce(
        (F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0))
    return parts.groupBy("clustering").agg(F.avg(score).alias("silhouette"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x from all rows of y.

    By inner products; where these cancel, or are not finite, by differences.
    """
    centre = y.mean(axis=0)
    if np.isfinite(centre).all():
        x, y = x - centre, y - centre
    with np.errstate(invalid="ignore", over="ignore"):
        norms = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)
        squares = norms - 2.0 * (x @ y.T)
        rows, others = np.nonzero(~(squares >= 1e-3 * norms))
        for at in range(0, len(rows), 65_536):
            r, o = rows[at:at + 65_536], others[at:at + 65_536]
            gaps = x[r] - y[o]
            squares[r, o] = (gaps * gaps).sum(axis=1)
        return np.sqrt(squares)


def _silhouette(df: DataFrame, columns: Sequence[str], labels: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    sizes = _long(df, [], labels).groupBy("clustering", "label").agg(F.count("*").alias("n"))
    clusters = sizes.agg(F.array_sort(F.collect_list(F.struct(_cluster_key().alias("key"), "clustering", "n")))).scalar()
    keys = F.transform("_clusters", lambda cluster: cluster["key"])

    def number(label: str) -> Column:
        """Position of the row's cluster in the list of all clusters."""
        return F.array_position(keys, F.concat_ws("\u0001", F.lit(label), F.col(label).cast("string"))).cast("int")

    rows = df.withColumn("_clusters", clusters).select(
        F.monotonically_increasing_id().alias("i"), F.array(*[number(label) for label in labels]).alias("own"),
        F.array(*[F.col(name).cast("double") for name in columns]).alias("x"))
    rows = durable(rows)  # the row numbers must not change between the two sides
    n_rows = rows.count()
    g = max(1, math.ceil(n_rows / max(block_rows, min(BLOCK_ROWS, math.ceil(n_rows / GROUPS)))))
    # Both sides must have the same type for a and b, or their groups do not meet.
    part = F.pmod(F.xxhash64("i"), F.lit(g)).cast("int")
    left = rows.withColumn("a", part).withColumn("b", F.explode(F.sequence("a", F.lit(g - 1))))
    right = rows.withColumn("b", part).withColumn("a", F.explode(F.sequence(F.lit(0), "b")))

    def members(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Features, own clusters, and for each clustering its clusters and who is in which."""
        own, found = np.stack(block["own"].to_numpy()), []
        for numbers in own.T:
            others, codes = np.unique(numbers, return_inverse=True)
            found.append((others, np.eye(len(others))[codes]))
        return np.stack(block["x"].to_numpy()), own, found

    def sums(key: tuple, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        """Sums of the rows of both sides over the other one's clusters; distances inside a group are in both orders already."""
        found: list[tuple] = []

        def add(ids: np.ndarray, own: np.ndarray, others: np.ndarray, total: np.ndarray) -> None:
            found.append((np.repeat(ids, len(others)), np.repeat(own, len(others)), np.tile(others, len(ids)), total.ravel()))

        if len(one) and len(two):
            (x, own_x, in_x), (y, own_y, in_y) = members(one), members(two)
            back = [np.zeros((len(y), len(others))) for others, _ in in_x]
            step = max(1, 4_000_000 // len(two))
            for start in range(0, len(one), step):
                piece = slice(start, start + step)
                distances = _distances(x[piece], y)
                for c, (others, member) in enumerate(in_y):
                    add(one["i"].to_numpy()[piece], own_x[piece, c], others, distances @ member)
                    if key[0] != key[1]:
                        back[c] += distances.T @ in_x[c][1][piece]
            if key[0] != key[1]:
                for c, (others, _) in enumerate(in_x):
                    add(two["i"].to_numpy(), own_y[:, c], others, back[c])
        names = ["i", "own", "other", "total"]
        return pd.DataFrame({name: np.concatenate([part[at] for part in found]) if found else np.array([])
                             for at, name in enumerate(names)})

    totals = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(
        sums, "i long, own int, other int, total double")
    per_row = totals.groupBy("i", "own", "other").agg(F.sum("total").alias("total")).withColumn("_clusters", clusters)
    cluster = F.element_at("_clusters", F.col("other"))
    n, same = cluster["n"], F.col("own") == F.col("other")
    return _mean_score(per_row.groupBy(cluster["clustering"].alias("clustering"), "i").agg(
        F.max(F.when(same, n)).alias("n"),
        F.max(F.when(same & (n > 1), F.col("total") / (n - 1))).alias("a"),
        F.min(F.when(~same, F.col("total") / n)).alias("b")))


def _squared_silhouette(df: DataFrame, columns: Sequence[str], labels: Sequence[str]) -> DataFrame:
    norm = sum((F.col(name) * F.col(name) for name in columns[1:]), F.col(columns[0]) * F.col(columns[0]))
    long = _long(df, columns, labels)
    stats = long.groupBy("clustering", "label").agg(
        F.count("*").alias("n"), F.array(*[F.sum(name) for name in columns]).alias("sum"), F.sum(norm).alias("norm"))
    clusters = stats.agg(F.collect_list(F.struct("clustering", "label", "n", "sum", "norm"))).scalar()
    given = long.select("clustering", "label", F.array(*columns).alias("x"), norm.alias("norm"), clusters.alias("clusters"))

    def total(cluster: Column) -> Column:
        dot = F.aggregate(F.zip_with("x", cluster["sum"], lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
        return cluster["n"] * F.col("norm") + cluster["norm"] - F.lit(2.0) * dot

    mine = F.filter("clusters", lambda c: (c["clustering"] == F.col("clustering")) & (c["label"] == F.col("label")))[0]
    others = F.filter("clusters", lambda c: (c["clustering"] == F.col("clustering")) & (c["label"] != F.col("label")))
    return _mean_score(given.select(
        "clustering", mine["n"].alias("n"), (total(mine) / F.nullif(mine["n"] - 1, F.lit(0))).alias("a"),
        F.array_min(F.transform(others, lambda c: total(c) / c["n"])).alias("b")))


def inertia(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """Sum of squared distances to the own centroid. Needs no join: it is a sum of variances."""
    return _inertia(df, columns, [label]).drop("clustering")


def calinski_harabasz(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """(between / (k - 1)) / (within / (n - k))."""
    return _calinski_harabasz(df, columns, [label]).drop("clustering")


def davies_bouldin(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / distance with another cluster."""
    return _davies_bouldin(df, columns, [label]).drop("clustering")


def silhouette(df: DataFrame, columns: Sequence[str], label: str = "label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean Euclidean silhouette over all rows, exact.

    Every row meets every other one, so the work grows with the square of the rows. Rows are dealt
    into g groups and each unordered pair of groups is worked out once, in a task of bounded size that gives
    only sums per row and cluster. Groups have `block_rows` rows, and more, up to BLOCK_ROWS, where there would be
    over GROUPS of them, as every row is sent to each. For more rows than that allows use `squared_silhouette`.
    """
    return _silhouette(df, columns, [label], block_rows).drop("clustering")


def squared_silhouette(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """Mean silhouette with squared distances: one pass and no pairs, for any number of rows."""
    return _squared_silhouette(df, columns, [label]).drop("clustering")


def measures(df: DataFrame, columns: Sequence[str], labels: Sequence[str], metric: str = "squared") -> DataFrame:
    """All four measures of several clusterings, one row per label column."""
    score = _squared_silhouette if metric == "squared" else _silhouette
    result = _inertia(df, columns, labels)
    for part in (score(df, columns, labels), _calinski_harabasz(df, columns, labels), _davies_bouldin(df, columns, labels)):
        result = result.join(part, "clustering")
    return result


# Fitting
#
# Centres are a table: k (which model), label and the features.

def _labelled(centres: DataFrame, df: DataFrame, columns: Sequence[str], names: dict[str, int]) -> DataFrame:
    """Adds a label column for each of several models (name -> k). All centres together are a few rows."""
    known = centres.agg(F.collect_list(F.struct("k", "label", F.array(*columns).alias("at")))).scalar()
    point = F.array(*[F.col(name).cast("double") for name in columns])

    def apart(centre: Column) -> Column:
        gaps = F.zip_with("_point", centre["at"], lambda p, q: (p - q) * (p - q))
        return F.struct(F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v).alias("apart"), centre["label"].alias("label"))

    def nearest(k: int) -> Column:
        return F.array_min(F.transform(F.filter("_centres", lambda centre: centre["k"] == k), apart))["label"]

    given = df.withColumns({"_centres": known, "_point": point})
    return given.withColumns({name: nearest(k) for name, k in names.items()}).drop("_centres", "_point")


def assignments(centres: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds each row's `label`, that of the nearest of the given centres, the smallest one on ties."""
    return _labelled(centres.withColumn("k", F.lit(0)), df, columns, {"label": 0})


def centroids_scaled(centres: DataFrame, k: int, columns: Sequence[str]) -> DataFrame:
    """The centres of one model in the scaled space, one row per label."""
    return centres.filter(F.col("k") == k).select("label", *columns)


def _first_centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each further centre is the best of a few rows drawn by their squared distance to those taken so far."""
    taken = [int(rng.integers(len(sample)))]
    near = ((sample - sample[taken[0]]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        weights = near / near.sum() if near.sum() > 0 else None
        drawn = rng.choice(len(sample), size=2 + int(math.log(k)), p=weights)
        options = [np.minimum(near, ((sample - sample[i]) ** 2).sum(axis=1)) for i in drawn]
        least = min(range(len(drawn)), key=lambda i: options[i].sum())
        taken.append(int(drawn[least]))
        near = options[least]
    return sample[taken]


def _scan(blocks: RDD, models: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """One pass for all models: for each its cost, and its centres moved to the mean of the rows nearest to them.

    A task gives one array, with a line for each centre: number, cost and sum of its rows. Arrays are added up in a tree.
    """
    width, edges, centres = models[0].shape[1], np.cumsum([0, *[len(m) for m in models]]), np.concatenate(models)

    def run(packed: Iterator[bytes]) -> Iterator[np.ndarray]:
        total, squares = np.zeros((len(centres), width + 2)), (centres * centres).sum(axis=1)
        for block in packed:
            x = np.frombuffer(block).reshape(-1, width)
            apart = np.maximum(squares - 2 * (x @ centres.T) + (x * x).sum(axis=1)[:, None], 0)
            own = np.stack([apart[:, a:b].argmin(axis=1) + a for a, b in zip(edges, edges[1:])], axis=1)
            member = np.zeros(apart.shape)
            member[np.arange(len(x))[:, None], own] = 1.0
            total += np.column_stack((member.sum(axis=0), (apart * member).sum(axis=0), member.T @ x))
        yield total

    found = blocks.mapPartitions(run).treeReduce(np.add)
    return [(found[a:b, 1].sum(), np.where(found[a:b, :1] > 0, found[a:b, 2:] / np.maximum(found[a:b, :1], 1), model))
            for model, a, b in zip(models, edges, edges[1:])]


def _fit_all(matrix: DataFrame, n: int, columns: Sequence[str], tasks: list[tuple[int, int]], seed: int, max_iter: int, tol: float,
             rows_per_partition: int) -> dict[int, np.ndarray]:
    """The best centres for each k: every start of every k moves in the same scans, until its centres stand still."""
    content = F.xxhash64(*[name for name, kind in matrix.dtypes if "map<" not in kind and "variant" not in kind])
    dealt = matrix.select(content.alias("_content"), *[F.col(name).cast("double").alias(name) for name in columns])
    parted = dealt.repartition(math.ceil(n / rows_per_partition), "_content").sortWithinPartitions("_content", *columns).select(*columns)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = np.ascontiguousarray(batch.to_numpy(np.float64))
            yield pd.DataFrame({"packed": [rows[i: i + BLOCK].tobytes() for i in range(0, len(rows), BLOCK)]})

    first = dealt.orderBy("_content", *columns).limit(START_ROWS).select(*columns)
    sample = np.concatenate([np.frombuffer(row["packed"]).reshape(-1, len(columns))
                             for row in first.mapInPandas(pack, "packed binary").collect()])
    models = [_first_centres(sample, k, np.random.default_rng([seed, k, start])) for k, start in tasks]
    costs, moving = [math.inf] * len(tasks), list(range(len(tasks)))
    # Each pass runs the same small program over whole partitions and adds arrays, which no DataFrame operator does.
    blocks = parted.mapInPandas(pack, "packed binary").rdd.map(lambda row: bytes(row["packed"])).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(max_iter):
            if not moving:
                break
            moved = _scan(blocks, [models[m] for m in moving])
            still = []
            for place, m in enumerate(moving):
                costs[m], after = moved[place]
                if ((after - models[m]) ** 2).sum() > tol:
                    still.append(m)
                models[m] = after
            moving = still
    finally:
        blocks.unpersist()
    best: dict[int, int] = {}
    for m, (k, _) in enumerate(tasks):
        if k not in best or costs[m] < costs[best[k]]:
            best[k] = m
    return {k: models[m] for k, m in best.items()}


def sweep_k(df: DataFrame, columns: Sequence[str], ks: Sequence[int] = range(2, 9), seed: int = 42, n_init: int = 20,
            metric: str = "squared", max_iter: int = 300, tol: float = 1e-4, rows_per_partition: int = ROWS_PER_PARTITION
            ) -> tuple[DataFrame, DataFrame]:
    """Fit K-Means for every k, keeping the best of `n_init` starts, and measure each winner.

    Returns the measures, one row per k, and the winners' centres (k, label and the features). A k below 2 or not below the
    number of rows is skipped. `metric="euclidean"` takes the silhouette of all pairs of rows, which is quadratic.

    All starts of all k share the scans of the stored matrix: a task adds up, for every centre, the rows nearest to it, and
    the driver holds nothing but the centres. A model leaves the scans when the sum of its centres' squared moves
    is at most `tol` times the features' mean variance.
    Starts are drawn by k-means++ from at most `START_ROWS` rows, the first by a hash of their content; all rows take part in
    every scan. Neither depends on the cluster or on how `df` was partitioned.
    """
    spark = df.sparkSession
    matrix = durable(df)
    n, spread = matrix.agg(F.count("*"), sum((F.var_pop(name) for name in columns[1:]), F.var_pop(columns[0])) / len(columns)).first()
    valid = [k for k in ks if 2 <= k < n]
    if not valid:
        raise ValueError("No valid k to fit.")
    best = _fit_all(matrix, n, columns, [(k, start) for k in valid for start in range(n_init)], seed, max_iter, tol * spread, rows_per_partition)
    rows = [(k, label, *map(float, centre)) for k in valid for label, centre in enumerate(best[k])]
    centres = spark.createDataFrame(rows, ", ".join(["k int", "label int", *[f"`{name}` double" for name in columns]]))

    names = {f"k{k}": k for k in valid}
    labelled = durable(_labelled(centres, matrix.select(*columns), columns, names))
    counts = _long(labelled, [], list(names)).groupBy("clustering").agg(F.count_distinct("label").alias("n_clusters"))
    metrics = measures(labelled, columns, list(names), metric).join(counts, "clustering")
    return durable(metrics.select(
        F.substring("clustering", 2, 10).cast("int").alias("k"), "n_clusters", "inertia", "silhouette",
        "calinski_harabasz", "davies_bouldin")), centres


def select_k(metrics: DataFrame) -> int:
    """The k with the highest silhouette, the smallest one on ties."""
    return metrics.orderBy(F.col("silhouette").desc_nulls_last(), F.col("k")).first()["k"]


def canonical_labels(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """Renumber labels by size, largest first, then by the first centroid coordinate."""
    sizes = df.groupBy(F.col(label).alias("l")).agg(F.count("*").alias("n"), F.avg(columns[0]).alias("c"))
    ordered = sizes.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "c", "l"))).alias("o"))
    lookup = ordered.select(F.map_from_entries(
        F.transform("o", lambda item, i: F.struct(item["l"], i)))).scalar()
    return df.withColumn("_lookup", lookup).withColumn(label, F.try_element_at("_lookup", F.col(label))).drop("_lookup")


# Descriptions

def cluster_profiles(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """Means of the unscaled features per cluster."""
    return df.groupBy(label).agg(*[F.avg(name).alias(name) for name in columns])


def share_of_total(df: DataFrame, value: str) -> DataFrame:
    """Adds `share`, the row's part of the total."""
    return df.withColumn("share", F.col(value) / df.agg(F.sum(value)).scalar())


def cluster_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    return share_of_total(df.groupBy(label).agg(F.count("*").alias("users")), "users")


def top_traits(df: DataFrame, columns: Sequence[str], n: int = 5, label: str = "label") -> DataFrame:
    """The features whose cluster mean lies furthest above and below the global mean, ranked."""
    sums = df.groupBy(label).agg(F.count("*").alias("_n"), *[F.avg(name).alias(name) for name in columns])
    everywhere = Window.partitionBy()  # one row per cluster

    def delta(name: str) -> Column:
        mean = F.sum(F.col(name) * F.col("_n")).over(everywhere) / F.sum("_n").over(everywhere)
        return (F.col(name) - mean).alias(name)

    long = sums.select(label, *[delta(name) for name in columns]).unpivot(
        label, list(columns), "feature", "delta_vs_global_mean")
    value = F.round("delta_vs_global_mean", 12)  # means that differ only by rounding noise rank by name
    up = Window.partitionBy(label).orderBy(value.desc(), F.col("feature"))
    down = Window.partitionBy(label).orderBy(value.asc(), F.col("feature"))
    ranked = long.withColumns({"positive": F.row_number().over(up), "negative": F.row_number().over(down)})
    both = ranked.unpivot([label, "feature", "delta_vs_global_mean"], ["positive", "negative"], "direction", "rank")
    return both.filter(F.col("rank") <= n).select(label, "direction", "rank", "feature", "delta_vs_global_mean")


def interpretation(traits: DataFrame, sizes: DataFrame, label: str = "label") -> DataFrame:
    """One text per cluster from its size and traits (a handful of rows each)."""
    entry = F.concat("feature", F.lit(" ("), F.format_string("%+.2f", "delta_vs_global_mean"), F.lit(")"))

    def listed(direction: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("direction") == direction, F.struct("rank", entry.alias("t")))))
        return F.concat_ws(", ", F.transform(rows, lambda row: row["t"]))

    texts = traits.groupBy(label).agg(listed("positive").alias("up"), listed("negative").alias("down"))
    return texts.join(sizes, label).select(label, F.concat_ws(
        "\n", F.format_string("Cluster %s", F.col(label).cast("string")),
        F.format_string("- users: %d", "users"),
        F.concat(F.lit("- strongest positive traits: "), F.col("up")),
        F.concat(F.lit("- strongest negative traits: "), F.col("down"))).alias("text"))


def report(metrics: DataFrame, sizes: DataFrame, traits: DataFrame, cleaning: DataFrame, label: str = "label"
           ) -> DataFrame:
    """One row with the summary text: cleaning counters, the chosen k, cluster sizes and descriptions."""
    counters = F.to_json(F.struct(*cleaning.columns), {"pretty": "true"})
    cleaned = cleaning.select(F.concat(F.lit("Cleaning summary\n"), counters)).scalar()
    best = metrics.orderBy(F.col("silhouette").desc_nulls_last(), F.col("k")).limit(1)
    chosen = best.select(F.concat_ws(
        "\n", F.lit("Selected K-Means model"), F.format_string("- Best k: %d", "k"),
        F.format_string("- Silhouette: %.4f", "silhouette"),
        F.format_string("- Calinski-Harabasz: %.2f", "calinski_harabasz"),
        F.format_string("- Davies-Bouldin: %.4f", "davies_bouldin"),
        F.format_string("- Inertia: %.4f", "inertia"))).scalar()

    def lines(frame: DataFrame, text: Column, separator: str) -> Column:
        rows = F.array_sort(F.collect_list(F.struct(F.col(label), text.alias("t"))))
        return frame.agg(F.concat_ws(separator, F.transform(rows, lambda row: row["t"]))).scalar()

    size_line = F.format_string("- Cluster %s: %d users (%.2f%%)", F.col(label).cast("string"), F.col("users"),
                                F.col("share") * 100.0)
    texts = interpretation(traits, sizes, label)
    return metrics.limit(1).select(F.concat_ws(
        "\n\n", cleaned, chosen,
        F.concat(F.lit("Cluster sizes\n"), lines(sizes, size_line, "\n")),
        F.lit("Cluster interpretation"), lines(texts, F.col("text"), "\n\n")).alias("text"))

