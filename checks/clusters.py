"""Scaling and cluster measures on a labelled feature matrix, and the K-Means sweep on user features."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.aggregates import rounded
from checks.base import EMBEDDING, Tables, query, scratch
from marquee.operators import clustering, features
from marquee.plans.user_segments import prepared_features
from marquee.scale import durable
from marquee.sources import sinks

SCALED = ", ".join(f"round((CAST({e} AS DOUBLE) - avg({e}) OVER ()) / stddev_pop({e}) OVER (), 6) + 0.0 AS {e}" for e in EMBEDDING)


@query("scale_features", f"SELECT vec_id, {SCALED} FROM matrix")
def _(t: Tables):
    return rounded(clustering.scale_features(t.embeddings().drop("label"), EMBEDDING), ("vec_id",))


MEANS = ", ".join(f"avg({e}) AS {e}" for e in EMBEDDING)
CENTRE = "[" + ", ".join(f"avg({e})" for e in EMBEDDING) + "]"
CENTROIDS = f"SELECT label, count(*) AS n, {CENTRE} AS c FROM matrix GROUP BY label"


@query("inertia", f"""
    WITH c AS ({CENTROIDS}) SELECT round(sum(pow(list_distance(x, c), 2)), 6) AS inertia FROM matrix JOIN c USING (label)""")
def _(t: Tables):
    return rounded(clustering.inertia(t.embeddings(), EMBEDDING))


@query("silhouette", """
    WITH sizes AS (SELECT label, count(*) AS n FROM matrix GROUP BY label),
    d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.x, b.x)) AS total
          FROM matrix a, matrix b GROUP BY 1, 2, 3),
    s AS (SELECT vec_id, max(CASE WHEN d.label = other THEN n END) AS n,
                 max(CASE WHEN d.label = other THEN total / nullif(n - 1, 0) END) AS a,
                 min(CASE WHEN d.label <> other THEN total / n END) AS b
          FROM d JOIN sizes ON sizes.label = d.other GROUP BY vec_id)
    SELECT round(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM s""")
def _(t: Tables):
    # Small blocks, so that the work is split over several pairs of groups even on a small table.
    return rounded(clustering.silhouette(t.embeddings(), EMBEDDING, block_rows=200))


@query("squared_silhouette", """
    WITH sizes AS (SELECT label, count(*) AS n FROM matrix GROUP BY label),
    d AS (SELECT a.vec_id, a.label, b.label AS other, sum(pow(list_distance(a.x, b.x), 2)) AS total
          FROM matrix a, matrix b GROUP BY 1, 2, 3),
    s AS (SELECT vec_id, max(CASE WHEN d.label = other THEN n END) AS n,
                 max(CASE WHEN d.label = other THEN total / nullif(n - 1, 0) END) AS a,
                 min(CASE WHEN d.label <> other THEN total / n END) AS b
          FROM d JOIN sizes ON sizes.label = d.other GROUP BY vec_id)
    SELECT round(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM s""")
def _(t: Tables):
    return rounded(clustering.squared_silhouette(t.embeddings(), EMBEDDING))


@query("calinski_harabasz", f"""
    WITH c AS ({CENTROIDS}), g AS (SELECT {CENTRE} AS c, count(*) AS n FROM matrix),
    b AS (SELECT sum(c.n * pow(list_distance(c.c, g.c), 2)) AS between_, count(*) AS k FROM c, g),
    w AS (SELECT sum(pow(list_distance(x, c), 2)) AS within_ FROM matrix JOIN c USING (label))
    SELECT round((between_ / (k - 1)) / (within_ / (n - k)), 6) AS calinski_harabasz FROM b, w, g""")
def _(t: Tables):
    return rounded(clustering.calinski_harabasz(t.embeddings(), EMBEDDING))


@query("davies_bouldin", f"""
    WITH c AS ({CENTROIDS}), s AS (SELECT label, avg(list_distance(x, c)) AS s, any_value(c) AS c FROM matrix JOIN c USING (label) GROUP BY label)
    SELECT round(avg(worst), 6) AS davies_bouldin FROM (
        SELECT i.label, max((i.s + j.s) / list_distance(i.c, j.c)) AS worst FROM s i JOIN s j ON i.label <> j.label GROUP BY i.label)""")
def _(t: Tables):
    return rounded(clustering.davies_bouldin(t.embeddings(), EMBEDDING))


@query("cluster_profiles", f"SELECT label, {', '.join(f'round({e}, 6) + 0.0 AS {e}' for e in EMBEDDING)} FROM (SELECT label, {MEANS} FROM matrix GROUP BY label)")
def _(t: Tables):
    return rounded(clustering.cluster_profiles(t.embeddings(), EMBEDDING), ("label",))


@query("cluster_sizes", """
    SELECT label, users, round(users / sum(users) OVER (), 6) AS share FROM (SELECT label, count(*) AS users FROM matrix GROUP BY 1)""")
def _(t: Tables):
    return rounded(clustering.cluster_sizes(t.embeddings()), ("label",))


LONG = f"UNPIVOT (SELECT label, {MEANS} FROM matrix GROUP BY label) ON {', '.join(EMBEDDING)} INTO NAME feature VALUE mean"
GLOBAL = f"UNPIVOT (SELECT {MEANS} FROM matrix) ON {', '.join(EMBEDDING)} INTO NAME feature VALUE overall"


@query("top_traits", f"""
    WITH l AS (FROM ({LONG})), g AS (FROM ({GLOBAL})),
    d AS (SELECT label, feature, mean - overall AS delta FROM l JOIN g USING (feature))
    SELECT label, direction, CAST(rank AS INTEGER) AS rank, feature, round(delta, 6) + 0.0 AS delta_vs_global_mean FROM (
        SELECT *, 'positive' AS direction, row_number() OVER (PARTITION BY label ORDER BY delta DESC, feature) AS rank FROM d
        UNION ALL
        SELECT *, 'negative', row_number() OVER (PARTITION BY label ORDER BY delta, feature) FROM d)
    WHERE rank <= 5""")
def _(t: Tables):
    return rounded(clustering.top_traits(t.embeddings(), EMBEDDING), ("label",))


@query("canonical_labels", """
    WITH o AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, avg(e0)) - 1 AS rank FROM matrix GROUP BY label)
    SELECT vec_id, CAST(rank AS INTEGER) AS label FROM matrix JOIN o USING (label)""")
def _(t: Tables):
    return clustering.canonical_labels(t.embeddings(), EMBEDDING).select("vec_id", "label")


def swept(t: Tables):
    """Prepared and scaled user features with the result of the whole sweep, at the operator's defaults."""
    users = durable(prepared_features(t.clean()))
    columns = features.feature_columns(users)
    scaled = durable(clustering.scale_features(users, columns))
    return clustering.sweep_k(scaled, columns)


@query("sweep_k")
def _(t: Tables):
    return rounded(swept(t)[0], ("k",))


#: Measures as a sweep would give them: a row for each line number, taken as k.
GIVEN_METRICS = """
    SELECT CAST(l_linenumber + 1 AS INTEGER) AS k, CAST(count(*) AS DOUBLE) AS inertia, CAST(count(*) % 1000 AS DOUBLE) / 1000 AS silhouette,
           CAST(sum(l_orderkey) % 100000 AS DOUBLE) / 100 AS calinski_harabasz, CAST(sum(l_partkey) % 10000 AS DOUBLE) / 10000 AS davies_bouldin
    FROM lineitem GROUP BY l_linenumber"""


def given_metrics(t: Tables):
    whole = lambda value, part: (value % part).cast("double")
    return t.read("lineitem").groupBy((F.col("l_linenumber") + 1).cast("int").alias("k")).agg(
        F.count("*").cast("double").alias("inertia"), (whole(F.count("*"), 1000) / 1000).alias("silhouette"),
        (whole(F.sum("l_orderkey"), 100_000) / 100).alias("calinski_harabasz"), (whole(F.sum("l_partkey"), 10_000) / 10_000).alias("davies_bouldin"))


def given_centres(t: Tables):
    """Means by label as the centres of model 2, those by label % 3 as the centres of model 3."""
    rows = t.embeddings()
    means = [F.avg(name).alias(name) for name in EMBEDDING]
    return rows.groupBy(F.lit(2).alias("k"), F.col("label").cast("int").alias("label")).agg(*means).unionByName(
        rows.groupBy(F.lit(3).alias("k"), (F.col("label") % 3).cast("int").alias("label")).agg(*means))


@query("select_k", f"SELECT k AS best_k FROM ({GIVEN_METRICS}) ORDER BY silhouette DESC, k LIMIT 1")
def _(t: Tables):
    return t.spark.createDataFrame([(clustering.select_k(given_metrics(t)),)], "best_k int")


@query("assignments", f"""
    WITH c AS ({CENTROIDS})
    SELECT vec_id, CAST(arg_min(c.label, struct_pack(d := list_distance(m.x, c.c), l := c.label)) AS INTEGER) AS label
    FROM matrix m, c GROUP BY vec_id""")
def _(t: Tables):
    chosen = clustering.centroids_scaled(given_centres(t), 2, EMBEDDING)
    return clustering.assignments(chosen, t.embeddings().drop("label"), EMBEDDING).select("vec_id", "label")


@query("centroids_scaled", f"""
    SELECT CAST(label AS INTEGER) AS label, {', '.join(f'round({e}, 6) + 0.0 AS {e}' for e in EMBEDDING)}
    FROM (SELECT label % 3 AS label, {MEANS} FROM matrix GROUP BY 1)""")
def _(t: Tables):
    return rounded(clustering.centroids_scaled(given_centres(t), 3, EMBEDDING), ("label",))


#: Size and traits of every label, and the text for each.
TOLD = f"""
    l AS (FROM ({LONG})), g AS (FROM ({GLOBAL})),
    d AS (SELECT label, feature, mean - overall AS delta FROM l JOIN g USING (feature)),
    n AS (SELECT label, count(*) AS users, count(*) * 100.0 / sum(count(*)) OVER () AS share FROM matrix GROUP BY label),
    r AS (SELECT label, feature, printf('%s (%+.2f)', feature, delta) AS said,
                 row_number() OVER (PARTITION BY label ORDER BY round(delta, 12) DESC, feature) AS up,
                 row_number() OVER (PARTITION BY label ORDER BY round(delta, 12), feature) AS down FROM d),
    texts AS (
        SELECT label, printf('Cluster %s', label::VARCHAR) || chr(10) || printf('- users: %d', any_value(users)) || chr(10)
               || '- strongest positive traits: ' || string_agg(said, ', ' ORDER BY up) FILTER (up <= 5) || chr(10)
               || '- strongest negative traits: ' || string_agg(said, ', ' ORDER BY down) FILTER (down <= 5) AS text
        FROM r JOIN n USING (label) GROUP BY label)"""


@query("interpretation", f"WITH {TOLD} SELECT label, text FROM texts")
def _(t: Tables):
    rows = t.embeddings()
    return clustering.interpretation(clustering.top_traits(rows, EMBEDDING), clustering.cluster_sizes(rows))


@query("report", f"""
    WITH {TOLD},
    c AS (SELECT count(*) AS all_rows, count(*) FILTER (lower(interaction_type) = 'swipe') AS swipes,
                 count(*) FILTER (lower(interaction_type) = 'swipe' AND price_max < price_min) AS swaps FROM fact),
    k AS (SELECT count(*) AS clean_rows, count(DISTINCT user_id) AS users FROM clean)
    SELECT concat_ws(chr(10) || chr(10),
        'Cleaning summary' || chr(10) || (SELECT '{{' || chr(10) || concat_ws(',' || chr(10), '  "input_rows" : ' || all_rows,
            '  "rows_after_dedup" : ' || all_rows, '  "direction_liked_mismatches" : 0', '  "rows_after_interaction_filter" : ' || swipes,
            '  "price_swaps" : ' || swaps, '  "rows_dropped_invalid" : ' || (swipes - clean_rows), '  "clean_rows" : ' || clean_rows,
            '  "unique_users" : ' || users) || chr(10) || '}}' FROM c, k),
        (SELECT concat_ws(chr(10), 'Selected K-Means model', printf('- Best k: %d', k), printf('- Silhouette: %.4f', silhouette),
            printf('- Calinski-Harabasz: %.2f', calinski_harabasz), printf('- Davies-Bouldin: %.4f', davies_bouldin), printf('- Inertia: %.4f', inertia))
         FROM ({GIVEN_METRICS}) ORDER BY silhouette DESC, k LIMIT 1),
        'Cluster sizes' || chr(10) || (SELECT string_agg(printf('- Cluster %s: %d users (%.2f%%)', label::VARCHAR, users, share::DOUBLE), chr(10) ORDER BY label) FROM n),
        'Cluster interpretation', (SELECT string_agg(text, chr(10) || chr(10) ORDER BY label) FROM texts)) AS text""")
def _(t: Tables):
    rows = t.embeddings()
    return clustering.report(given_metrics(t), clustering.cluster_sizes(rows), clustering.top_traits(rows, EMBEDDING),
                             features.cleaning_report(t.fact()))


@query("ordered_outputs", f"""
    SELECT CAST(row_number() OVER (ORDER BY label, direction, rank) AS INTEGER) AS place, label, direction, CAST(rank AS INTEGER) AS rank, feature FROM (
        SELECT label, 'positive' AS direction, up AS rank, feature FROM r WHERE up <= 5
        UNION ALL SELECT label, 'negative', down, feature FROM r WHERE down <= 5)""".replace("SELECT CAST(row", f"WITH {TOLD} SELECT CAST(row", 1))
def _(t: Tables):
    """The traits as the analysis stores them, with the place that each line has in the file that was read back."""
    path = scratch(t.spark)
    ordered = clustering.top_traits(t.embeddings(), EMBEDDING).orderBy("label", "direction", "rank").coalesce(1)
    sinks.write_artifacts({"traits": ordered}, path)
    stored = t.spark.read.parquet(f"{path}/traits")
    return stored.select((F.col("_metadata.row_index") + 1).cast("int").alias("place"), "label", "direction", "rank", "feature")
