"""Plans and results under one hot key."""

import random

from pyspark.sql import functions as F

from marquee.functions.geo import haversine_m
from marquee.operators import clustering, enrich, lifecycle, marts
from marquee.scale import numbered_by_hash, running_count, spread_join, top_per_key


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def hot(spark, n=20_000):
    """A third of the rows have one key."""
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"))


def test_top_per_key_limits_before_the_shuffle(spark):
    text = plan(top_per_key(hot(spark), ["key"], [F.col("id")], 2))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text.split("Exchange")[-1]


def test_user_features_prune_columns_and_never_cross_join(spark):
    import __spark_entry__ as contract
    for name in ("user_activity", "fact_projection", "group_occurrences", "cache_aside", "merge_incremental", "nearby_places"):
        text = plan(contract.queries()[name](spark, "/root/testdata/sf0.001"))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_spread_join_splits_a_hot_key_and_changes_nothing(spark):
    left = hot(spark, 3000)
    right = left.select("key").distinct().filter("key % 2 = 0").withColumn("v", F.col("key") + 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for how in ("left", "inner", "left_semi", "left_anti"):
            plain, spread = left.join(right, "key", how), spread_join(left, right, ["key"], how)
            assert sorted(map(str, plain.collect())) == sorted(map(str, spread.select(*plain.columns).collect())), how
        parts = left.filter("key = 0").select(F.pmod(F.xxhash64("id", "key"), F.lit(16)).alias("p")).groupBy("p").count()
        assert parts.count() == 16 and max(r["count"] for r in parts.collect()) < 150
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_numbering_and_running_counts_of_a_hot_key(spark):
    rows = numbered_by_hash(hot(spark), ["key"], [F.col("id")], "n").filter("key = 0")
    numbers = sorted(r.n for r in rows.collect())
    assert numbers == list(range(1, len(numbers) + 1)) and len(numbers) > 6000
    one = spark.range(1000).select(F.lit(1).alias("key"), (F.col("id") * 3).alias("at"), F.lit(2).alias("c"))
    counted = running_count(one, ["key"], "at", "c", "upto", width=64).collect()
    assert all(r.upto == (r.at // 3 + 1) * 2 for r in counted)


def test_unique_handles_of_one_name(spark):
    new = spark.range(5000).select("id", F.lit("Ana").alias("name"), F.lit("a@x").alias("email"))
    taken = ["ana", "ana_3", "ana_4", "ana_4999", "ana_x", "ana_07"]
    existing = spark.createDataFrame([(t,) for t in taken], "username string")
    extra = spark.createDataFrame([(9000, "ana 9", "b@x"), (9001, None, "m.b@x"), (9002, "¿?", None)], "id long, name string, email string")
    rows = {r.id: r.username for r in lifecycle.unique_handles(new.union(extra), existing).collect()}
    handles = list(rows.values())
    assert len(set(handles)) == 5003 and not set(handles) & set(taken)
    assert rows[9000] == "ana_9" and rows[9001] == "m_b" and rows[9002] == "user"
    numbers = sorted(int(h.split("_")[1]) for h in handles if h.startswith("ana_"))
    assert numbers == [n for n in range(2, 5006) if n not in (3, 4, 4999)]


def brute(spark, venues, places, radius, k):
    pairs = venues.crossJoin(places.select("place_id", F.col("latitude").alias("a"), F.col("longitude").alias("b")))
    far = pairs.withColumn("distance_m", haversine_m(F.col("latitude"), F.col("longitude"), F.col("a"), F.col("b")))
    return sorted(map(tuple, enrich.top_k_places(far.filter(F.col("distance_m") <= radius), k).select(
        "venue_id", "place_id", "distance_m").collect()))


def test_nearby_places_against_brute_force(spark):
    rng = random.Random(3)
    centres = [(40.0, -3.7), (0.0, 0.001), (49.9999, 179.9995), (79.2, 10.0), (85.4, 30.0), (-33.0, -179.999)]
    venues, places = [], []
    for c, (lat, lng) in enumerate(centres):
        for i in range(6):
            venues.append((f"v{c}-{i}", lat + rng.gauss(0, 0.003), lng + rng.gauss(0, 0.003)))
        for i in range(120):
            spread = 0.0005 if i < 60 else 0.02  # half of them in a dense knot
            x = lng + rng.gauss(0, spread)
            places.append((f"p{c}-{i}", lat + rng.gauss(0, spread), x - 360 if x > 180 else x + 360 if x < -180 else x, ["bar"]))
    places += [(f"same{i}", 40.0, -3.7, ["bar"]) for i in range(200)]  # copies at one spot
    places += [("other", 40.0, -3.7, ["zoo"]), ("lost", None, 1.0, ["bar"])]
    venues.append(("nowhere", None, None))
    v = spark.createDataFrame(venues, "venue_id string, latitude double, longitude double")
    p = spark.createDataFrame(places, "place_id string, latitude double, longitude double, types array<string>")
    bars = p.filter(F.array_contains("types", "bar"))
    for radius, k in ((1000, 20), (5000, 3), (200, 20), (5, 2)):
        found = sorted(map(tuple, enrich.nearby_places(v, p, float(radius), ["bar"], k).collect()))
        assert found == brute(spark, v, bars, radius, k), (radius, k)


def test_enrich_fact_never_multiplies_rows(spark):
    interactions = hot(spark, 3000).select(F.col("id").cast("string").alias("interaction_id"), F.col("key").cast("string").alias("event_id"))
    catalog = spark.createDataFrame([("0", "A"), ("0", "B"), ("0", None), (None, "C")], "id string, segment string")
    rows = marts.enrich_fact(interactions, catalog)
    assert rows.count() == 3000 and {r.segment for r in rows.filter("event_id = '0'").collect()} == {"A"}


def test_silhouette_blocks_do_not_change_the_result(spark):
    rng = random.Random(1)
    rows = [(i, i % 3 + rng.gauss(0, 0.4), rng.gauss(0, 1), i % 3) for i in range(300)] + [(999, 9.0, 9.0, 7)]
    df = spark.createDataFrame(rows, "id int, a double, b double, label int").repartition(5)
    results = [clustering.silhouette(df, ["a", "b"], block_rows=b).first()[0] for b in (1000, 100, 37)]
    assert max(results) - min(results) < 1e-12


def test_copies_of_a_spread_join_count_towards_a_broadcast(spark):
    """1,000 rows fit under the limit, their 16 copies do not."""
    left = spark.range(100_000).select((F.col("id") % 1000).alias("key"), "id")
    right = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 65_536)
        joined = spread_join(left, right, ["key"])
        assert joined.filter("value = 2 * key").count() == 100_000
        assert "BroadcastHashJoin" not in plan(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_silhouette_visits_each_pair_once_and_sends_a_row_to_few_groups(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.gauss(i % 3, 0.5) + 1e4, rng.gauss(0, 1), i % 3) for i in range(300)] + [(1e4, 0.0, 1), (1e4, 0.0, 2)]
    df = spark.createDataFrame(rows, "a double, b double, label int").repartition(5)
    sent = []
    monkeypatch.setattr(clustering, "GROUPS", 6)
    real = clustering.F.sequence
    monkeypatch.setattr(clustering.F, "sequence", lambda *ends: sent.append(ends) or real(*ends))
    score = clustering.silhouette(df, ["a", "b"], block_rows=2)
    assert "5" in str(sent[0][1]) and sent[0][0] == "a" and sent[1][1] == "b"  # 6 groups, each with those from itself on
    whole = [(r.a, r.b, r.label) for r in df.collect()]
    distance = lambda p, q: ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5
    total = 0.0
    for at, p in enumerate(whole):
        means = {}
        for label in range(3):
            others = [distance(p, q) for n, q in enumerate(whole) if n != at and q[2] == label]
            means[label] = sum(others) / len(others)
        own, other = means.pop(p[2]), min(means.values())
        total += (other - own) / max(own, other)
    assert abs(score.first()[0] - total / len(whole)) < 1e-10


def test_an_image_is_picked_in_one_pass_over_the_list(spark):
    df = spark.createDataFrame([([("4_3", 9, "a"), ("16_9", 1, "b"), (None, 5, "c"), ("16_9", None, "d"), ("16_9", 1, "e")],), ([],), (None,)],
                               "images array<struct<ratio string, width long, url string>>")
    from marquee.operators.catalog import pick_image
    for least, urls in ((0, ["b", None, None]), (2, ["a", None, None])):
        picked = df.select(pick_image(F.col("images"), "16_9", least).alias("url"))
        assert [r.url for r in picked.collect()] == urls and plan(picked).count("transform(") == 1
