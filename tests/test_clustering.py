import inspect
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from checks import clusters
from marquee.operators import clustering, features
from marquee.plans.user_segments import segment_users
from marquee.sources import sinks
from tests.test_interactions import DAY, T0, fact, fact_row


@pytest.fixture(scope="module")
def blobs(spark):
    rng = random.Random(5)
    rows = [(f"u{c}-{i}", c * 10 + rng.gauss(0, 1), c % 2 * 10 + rng.gauss(0, 1)) for c in range(3) for i in range(12)]
    return spark.createDataFrame(rows, "user_id string, a double, b double")


def test_scaling_of_a_constant_column(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "id int, a double, b double")
    rows = clustering.scale_features(df, ["a", "b"]).orderBy("id").collect()
    assert [(r.a, r.b) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]


def test_sweep_finds_the_blobs(spark, blobs):
    metrics, centres = clustering.sweep_k(blobs, ["a", "b"], ks=[1, 2, 3, 4, 36, 99], n_init=4)
    rows = metrics.orderBy("k").collect()
    assert [r.k for r in rows] == [2, 3, 4] and [r.n_clusters for r in rows] == [2, 3, 4]
    assert clustering.select_k(metrics) == 3 and rows[1].silhouette > 0.7
    assert rows[0].inertia > rows[1].inertia > rows[2].inertia
    labels = clustering.assignments(clustering.centroids_scaled(centres, 3, ["a", "b"]), blobs, ["a", "b"])
    assert labels.columns == ["user_id", "a", "b", "label"]
    assert clustering.inertia(labels, ["a", "b"]).first()[0] == pytest.approx(rows[1].inertia)
    groups = labels.groupBy(F.split_part("user_id", F.lit("-"), F.lit(1))).agg(F.count_distinct("label")).collect()
    assert all(r[1] == 1 for r in groups)
    squared, _ = clustering.sweep_k(blobs, ["a", "b"], ks=[2, 3], n_init=2, metric="squared")
    assert clustering.select_k(squared) == 3
    assert sorted(round(c.a / 10) for c in clustering.centroids_scaled(centres, 3, ["a", "b"]).collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        clustering.sweep_k(blobs, ["a", "b"], ks=[1])


def test_starts_do_not_depend_on_partitions(spark, blobs):
    found = []
    for df in (blobs.coalesce(1), blobs.orderBy(F.desc("b")).repartition(5), blobs.repartition(11, "a")):
        _, centres = clustering.sweep_k(df, ["a", "b"], ks=[5, 7], n_init=1, rows_per_partition=9)
        found.append(sorted((c.k, round(c.a, 9), round(c.b, 9)) for c in centres.collect()))
    assert found[0] == found[1] == found[2]


def test_shared_scans_are_as_good_as_separate_fits(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(9)
    rows = [(i, *[rng.gauss(i % 6 * 4 * (j == i % 3), 1.5) for j in range(4)]) for i in range(600)]
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "user_id int, a double, b double, c double, d double")
    metrics, _ = clustering.sweep_k(df, names, ks=[2, 4, 6], n_init=20)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(df).cache()
    for row in metrics.collect():
        separate = min(KMeans(k=row.k, seed=s, maxIter=300).fit(vectors).summary.trainingCost for s in range(8))
        assert row.inertia <= separate * 1.01


def test_equal_and_empty_rows_can_be_fitted(spark):
    same = spark.createDataFrame([(i, 1.0, 2.0) for i in range(5)], "user_id int, a double, b double")
    metrics, centres = clustering.sweep_k(same, ["a", "b"], ks=[2], n_init=2)
    assert metrics.first().inertia == 0 and centres.count() == 2
    with pytest.raises(ValueError):
        clustering.sweep_k(same.limit(0), ["a", "b"])


def test_registered_sweep_runs_the_defaults(monkeypatch):
    real, seen = inspect.signature(clustering.sweep_k), []
    monkeypatch.setattr(clusters, "durable", lambda df: df)
    monkeypatch.setattr(clusters, "prepared_features", lambda df: df)
    monkeypatch.setattr(features, "feature_columns", lambda df: [])
    monkeypatch.setattr(clustering, "scale_features", lambda df, columns: df)
    monkeypatch.setattr(clustering, "sweep_k", lambda *a, **b: seen.append(real.bind(*a, **b)) or (None, {}))
    clusters.swept(SimpleNamespace(clean=lambda: None))
    seen[0].apply_defaults()
    assert list(seen[0].arguments["ks"]) == [2, 3, 4, 5, 6, 7, 8] and seen[0].arguments["n_init"] == 20


def test_ties_choose_the_smaller_k(spark):
    rows = spark.createDataFrame([(5, 0.4), (3, 0.4), (4, 0.1), (2, None)], "k int, silhouette double")
    assert clustering.select_k(rows) == 3


def test_descriptions(spark, blobs):
    df = blobs.withColumn("label", F.when(F.col("a") > 15, 1).otherwise(0))
    sizes = clustering.cluster_sizes(df)
    assert {r.label: (r.users, round(r.share, 3)) for r in sizes.collect()} == {0: (24, 0.667), 1: (12, 0.333)}
    traits = clustering.top_traits(df, ["a", "b"], n=1)
    assert {(r.label, r.direction): r.feature for r in traits.collect()} == {
        (0, "positive"): "b", (0, "negative"): "a", (1, "positive"): "a", (1, "negative"): "b"}
    texts = {r.label: r.text for r in clustering.interpretation(traits, sizes).collect()}
    assert texts[1].startswith("Cluster 1\n- users: 12\n- strongest positive traits: a (+")
    assert {r.user_id: r.label for r in clustering.canonical_labels(df, ["a"]).collect()} == {
        r.user_id: r.label for r in df.collect()}


def test_whole_analysis(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for user in range(20):
        taste = "Rock" if user % 2 else "Opera"
        for i in range(12):
            genre = taste if rng.random() < 0.9 else "Jazz"
            rows.append(fact_row(f"{user}-{i}", T0 + rng.randrange(20) * DAY, user=f"u{user}", genre=genre, liked=genre == taste,
                                 segment="Music" if user % 2 else "Arts & Theatre", price_min=10.0 + user % 2 * 50, price_max=80.0,
                                 recommendation_context=rng.choice(["map", "planner"])))
    result = segment_users(fact(spark, *rows), ks=[2, 3], n_init=2)
    assert result.best_k == 2 and "- Best k: 2" in result.report and '"clean_rows" : 240' in result.report
    assert len(result.tables) == 11
    sinks.write_artifacts(result.tables, str(tmp_path / "out"), result.report, format="csv")
    names = [r.feature for r in spark.read.option("header", True).csv(str(tmp_path / "out" / "feature_list")).collect()]
    assert len(names) == 17 + 4 + 2 and set(features.FIXED_FEATURES) < set(names)
    assert spark.read.text(str(tmp_path / "out" / "report")).first()[0].startswith("Cleaning summary")
    with pytest.raises(ValueError, match="No interaction is complete"):
        segment_users(fact(spark, fact_row("1", T0, price_min=None)))
