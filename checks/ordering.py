"""Window functions, sorting, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Tables, query, ts_text
from checks.joins import nation_cache, nation_keys
from checks.projections import CATALOG_TEXT, catalog_text
from marquee.functions.text import slugify_handle
from marquee.operators import catalog, enrich, lifecycle, marts, staging


@query("latest_per_key", """
    SELECT interaction_id, strftime(ingestion_timestamp, '%Y-%m-%d %H:%M:%S.%f') AS ingestion_timestamp FROM latest""")
def _(t: Tables):
    return t.latest().select("interaction_id", ts_text("ingestion_timestamp").alias("ingestion_timestamp"))


@query("first_per_identity", f"""
    SELECT {CATALOG_TEXT} FROM keyed
    QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY starts_at NULLS FIRST, id) = 1""")
def _(t: Tables):
    return catalog_text(catalog.first_per_identity(t.catalog()))


@query("pick_image", """
    SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL
        WHEN p_partkey % 5 = 3 THEN 'c' WHEN p_size >= 25 THEN 'b' WHEN p_size >= 20 THEN 'a' ELSE 'c' END AS url
    FROM part""")
def _(t: Tables):
    # c is widest but has another ratio; a and b have the ratio and tie from size 25 up unless b is wider.
    image = lambda ratio, width, url: F.struct(
        F.lit(ratio).alias("ratio"), width.cast("bigint").alias("width"), F.lit(url).alias("url"))
    size = F.col("p_size")
    a, b = image("16_9", size * 50, "a"), image("16_9", F.when(size >= 25, size * 50 + 1).otherwise(10), "b")
    c, d = image("4_3", F.lit(9000), "c"), image(None, F.lit(9000), "d")
    kind = F.col("p_partkey") % 5
    images = (F.when(kind == 4, F.array().cast("array<struct<ratio:string,width:bigint,url:string>>"))
              .when(kind == 3, F.array(c, d)).otherwise(F.array(a, b, c, d)))
    return t.read("part").select("p_partkey", catalog.pick_image(images, "16_9", 1000).alias("url"))


@query("top_k_places", """
    SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (
        SELECT DISTINCT l_partkey, l_suppkey, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS distance_m FROM lineitem)
    QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY distance_m, l_orderkey, l_linenumber, l_partkey) <= 5""")
def _(t: Tables):
    # Order lines stand for (venue, place) pairs: the supplier is the venue and the quantity the distance.
    pairs = t.read("lineitem").select(
        "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("distance_m"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("place_id")).distinct()
    return enrich.top_k_places(pairs, 5, ["l_suppkey"]).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@query("unique_handles", r"""
    WITH new AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'ana' WHEN c_custkey % 3 = 1 THEN 'ana_2'
                        ELSE 'user' || (c_custkey % 40) END AS slug FROM customer),
    existing AS (SELECT 'ana' AS username UNION ALL SELECT 'ana_' || (2 + s_suppkey * 3) FROM supplier
                 UNION ALL SELECT 'user' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0),
    bounds AS (SELECT slug, count(*) AS n FROM new GROUP BY slug),
    candidates AS (SELECT slug, i, CASE WHEN i = 1 THEN slug ELSE slug || '_' || i END AS handle
                   FROM (SELECT slug, unnest(range(1, 2 * n + 2500)) AS i FROM bounds)),
    free AS (SELECT slug, handle, row_number() OVER (PARTITION BY slug ORDER BY i) AS r FROM candidates
             WHERE handle NOT IN (SELECT username FROM existing)
               AND (i = 1 OR handle NOT IN (SELECT slug FROM bounds)))
    SELECT f.slug, handle FROM free f JOIN bounds b ON b.slug = f.slug AND f.r <= b.n""")
def _(t: Tables):
    key = F.col("c_custkey")
    name = (F.when(key % 3 == 0, "Ana!").when(key % 3 == 1, "ána 2")
            .otherwise(F.concat(F.lit("User"), (key % 40).cast("string"))))
    new = t.read("customer").select(key.alias("id"), name.alias("name"), F.lit("x@mail.example").alias("email"))
    supplier = t.read("supplier")
    existing = (supplier.select(F.concat(F.lit("ana_"), (F.col("s_suppkey") * 3 + 2).cast("string")).alias("username"))
                .union(supplier.filter("s_suppkey = 0").select(F.lit("ana")))
                .union(supplier.filter("s_suppkey % 2 = 0").select(F.concat(F.lit("user"), F.col("s_suppkey").cast("string")))))
    handles = lifecycle.unique_handles(new, existing)
    return handles.join(new, "id").select(
        slugify_handle(F.col("name"), F.col("email")).alias("slug"), F.col("username").alias("handle"))


@query("share_of_total", """
    SELECT c_mktsegment, n, round(n / sum(n) OVER (), 6) AS share FROM (
        SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)""")
def _(t: Tables):
    from marquee.operators.clustering import share_of_total
    counts = t.read("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return share_of_total(counts, "n").select("c_mktsegment", "n", F.round("share", 6).alias("share"))


@query("catalog_page", f"SELECT {CATALOG_TEXT} FROM catalog ORDER BY starts_at ASC NULLS FIRST, id LIMIT 100")
def _(t: Tables):
    return catalog_text(catalog.catalog_page(t.catalog(), 100))


@query("recent_messages", """
    SELECT message_id, strftime(publish_time, '%Y-%m-%d %H:%M:%S.%f') AS publish_time FROM raw
    ORDER BY raw.publish_time DESC, message_id LIMIT 20""")
def _(t: Tables):
    return staging.recent_messages(t.raw()).select("message_id", ts_text("publish_time").alias("publish_time"))


@query("plans_by_recency", "SELECT user_id, plan_id, updated_at FROM plan_headers ORDER BY user_id, updated_at DESC, plan_id")
def _(t: Tables):
    return lifecycle.plans_by_recency(t.plan_headers()).select("user_id", "plan_id", "updated_at")


@query("latest_plan", """
    SELECT user_id, plan_id FROM plan_headers
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, plan_id) = 1""")
def _(t: Tables):
    return lifecycle.latest_plan(t.plan_headers()).select("user_id", "plan_id")


@query("saved_by_recency", """
    SELECT user_id, event_id, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM saved""")
def _(t: Tables):
    return lifecycle.saved_by_recency(t.saved()).select("user_id", "event_id", ts_text("created_at").alias("created_at"))


@query("sort_places", """
    SELECT o_orderkey, string_agg(CAST(i AS VARCHAR), ',' ORDER BY CASE WHEN d IS NULL OR d = 0 THEN 9999 ELSE d END, i) AS places
    FROM (SELECT o_orderkey, i, CASE WHEN (o_orderkey + i) % 4 <> 3 THEN (o_orderkey * 7919 + i * 31) % 20 * 600 END AS d
          FROM orders, range(0, 6) r(i))
    GROUP BY o_orderkey""")
def _(t: Tables):
    # Six places per order; some lie 0 m away, some at an unknown distance, some beyond 9999 m.
    key = F.col("o_orderkey")
    place = lambda i: F.struct(
        F.lit(i).alias("id"), F.when((key + i) % 4 != 3, (key * 7919 + i * 31) % 20 * 600).alias("distance_m"))
    ids = F.transform(catalog.sort_places(F.array(*[place(i) for i in range(6)])), lambda p: p["id"].cast("string"))
    return t.read("orders").select("o_orderkey", F.array_join(ids, ",").alias("places"))


@query("deck", """
    SELECT id FROM (
        SELECT * FROM (SELECT * FROM keyed ORDER BY starts_at ASC NULLS FIRST, id LIMIT 50)
        QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY starts_at NULLS FIRST, id) = 1)
    WHERE id NOT IN (SELECT event_id FROM saved WHERE user_id = '7')""")
def _(t: Tables):
    return catalog.deck(t.catalog(), t.saved(), "7").select("id")


@query("merge_hits_misses", """
    SELECT c_custkey, CASE WHEN n_nationkey % 2 = 0 THEN 'cached ' || n_name END AS capital
    FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 9 <> 0""")
def _(t: Tables):
    rows, cache = nation_keys(t), nation_cache(t)
    hits = rows.join(cache, "n_name").select("c_custkey", "capital")
    misses = rows.filter("n_name IS NOT NULL").join(cache, "n_name", "left_anti").select("c_custkey")
    return enrich.merge_hits_misses(hits, misses)


@query("fields_complete", """
    SELECT id, genre IS NOT NULL AND city IS NOT NULL AND price_min IS NOT NULL AS complete FROM catalog""")
def _(t: Tables):
    return t.catalog().select("id", enrich.fields_complete(["genre", "city", "price_min"]).alias("complete"))


@query("surviving_categories", """
    SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN p_type || ',gone' ELSE 'gone' END AS kept FROM part""")
def _(t: Tables):
    selected = F.array(F.col("p_type"), F.lit("never"), F.lit("gone"))
    available = F.array(F.lit("gone"), F.lit("PROMO"), F.lit("ECONOMY"))
    return t.read("part").select("p_partkey", F.array_join(enrich.surviving_categories(selected, available), ",").alias("kept"))


@query("additive_schema", """
    SELECT interaction_id, user_id, CAST(NULL AS VARCHAR) AS device FROM fact WHERE liked
    UNION ALL SELECT interaction_id, user_id, 'phone' FROM fact WHERE NOT liked""")
def _(t: Tables):
    rows = t.fact().select("interaction_id", "user_id", "liked")
    source = rows.filter(~F.col("liked")).drop("liked").withColumn("device", F.lit("phone"))
    return marts.additive_schema(rows.filter("liked").drop("liked"), source)

