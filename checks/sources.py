"""Reading and writing: every query writes whole derived tables to a scratch folder and reads them back."""

from __future__ import annotations

import contextlib
import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.base import NOW, Tables, now, query, r6, scratch, ts_text
from checks.projections import GOOD_RAW, fact_text, raw_events
from marquee.operators import catalog, marts, staging
from marquee.plans.catalogue_batch import CatalogueStore, run_catalogue_batch
from marquee.scale import durable
from marquee.schemas import FACT, WAREHOUSE
from marquee.sources import commits, readers, sinks
from marquee.sources.stored import KeyedTable

RUN = dt.datetime(2024, 1, 31)


@query("read_event_pages", "SELECT id, CASE WHEN CAST(id AS BIGINT) % 12 <> 0 THEN segment END AS segment, city FROM catalog")
def _(t: Tables):
    path = scratch(t.spark)
    pages = raw_events(t).withColumn("e", F.struct("*")).groupBy(
        F.floor(F.col("id").cast("bigint") / 50).alias("number")).agg(F.collect_list("e").alias("events")).select(
        F.struct("events").alias("_embedded"), F.struct("number").alias("page"))
    empty = pages.limit(1).select(F.struct("page.number").alias("page"))  # a page without events
    pages.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    empty.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)
    events = catalog.flatten_event(readers.read_event_pages(t.spark, path))
    return events.select("id", "segment", "city")


@query("tag_pages", """
    SELECT 'event' AS tag, id AS said FROM catalog
    UNION ALL SELECT CASE CAST(id AS BIGINT) % 5 WHEN 0 THEN 'no_json' WHEN 1 THEN 'no_object' WHEN 2 THEN 'no_list' WHEN 3 THEN 'empty_page'
        ELSE 'no_event' END, id FROM catalog""")
def _(t: Tables):
    """A page for each event, and a line for each that has another shape; landed by tag in one parse and read back."""
    path = scratch(t.spark)
    key = F.col("id").cast("bigint") % 5
    pages = raw_events(t).select(F.to_json(F.struct(F.struct(F.array(F.struct("*")).alias("events")).alias("_embedded"))).alias("value"))
    odd = t.catalog().select(F.when(key == 0, F.concat(F.lit('{"oops": '), "id")).when(key == 1, F.concat(F.lit('["'), "id", F.lit('"]')))
                             .when(key == 2, F.concat(F.lit('{"_embedded": {"events": {"id": "'), "id", F.lit('"}}}')))
                             .when(key == 3, F.concat(F.lit('{"page": "'), "id", F.lit('"}')))
                             .otherwise(F.concat(F.lit('{"_embedded": {"events": ["'), "id", F.lit('"]}}'))).alias("value"))
    pages.unionByName(odd).write.text(f"{path}/pages")
    landed = sinks.land_tagged(readers.tag_pages(t.spark, f"{path}/pages"), f"{path}/raw", RUN)
    said = F.when(F.col("tag") == readers.EVENT, F.get_json_object("value", "$.id")).otherwise(F.regexp_extract("value", "([0-9]+)", 1))
    return landed.select("tag", said.alias("said"))


@query("event_window", """
    SELECT id, city FROM catalog WHERE starts_at BETWEEN TIMESTAMP '2024-02-10' AND TIMESTAMP '2024-02-22' AND city = 'NATION_4'""")
def _(t: Tables):
    rows = t.catalog().withColumn("country", F.col("city"))
    return readers.event_window(rows, dt.datetime(2024, 2, 10), 12, "NATION_4").select("id", "city")


@query("land_raw", "SELECT id, name, CAST(coalesce(is_test, FALSE) AS BOOLEAN) AS is_test FROM catalog")
def _(t: Tables):
    path = scratch(t.spark)
    sinks.land_raw(raw_events(t), path, RUN)
    stored = readers.read_raw_events(t.spark, f"{path}/run_ts=20240131_000000")
    return stored.select("id", "name", F.coalesce("test", F.lit(False)).alias("is_test"))


@query("write_dead_letters", """
    SELECT id, CASE WHEN CAST(id AS BIGINT) % 47 = 3 THEN 'latitude is not a number' ELSE 'start is not an instant' END AS error,
           '2024-01-31T00:00:00' AS timestamp, name AS raw_name
    FROM catalog WHERE NOT (""" + GOOD_RAW + ")")
def _(t: Tables):
    path = scratch(t.spark)
    _good, bad = catalog.split_valid(raw_events(t), catalog.raw_event_rules())
    sinks.write_dead_letters(bad, path, RUN)
    lines = t.spark.read.schema("id string, error string, timestamp string, raw struct<name: string>").json(path)
    return lines.select("id", "error", "timestamp", F.col("raw.name").alias("raw_name"))


@query("upsert_documents", """
    WITH s AS (SELECT *, CAST(id AS BIGINT) AS k FROM catalog)
    SELECT id, CASE WHEN k % 3 <> 0 THEN name END AS name,
           CASE WHEN k % 2 = 0 THEN 'second' WHEN k % 3 <> 0 THEN status END AS status,
           CASE WHEN k % 2 = 0 THEN city END AS moved FROM s WHERE k % 3 <> 0 OR k % 2 = 0""")
def _(t: Tables):
    key = F.col("id").cast("bigint")
    target = t.catalog().filter(key % 3 != 0).select("id", "name", "status")
    rows = t.catalog().filter(key % 2 == 0).select("id", F.col("city").alias("moved"))
    updates = (rows.withColumns({"status": F.lit("first"), "seq": F.lit(1)})
               .unionByName(rows.withColumns({"status": F.lit("second"), "seq": F.lit(2)})))
    merged = sinks.upsert_documents(target, updates, F.col("seq").desc())
    return merged.select("id", "name", "status", "moved")


@query("append_new", "SELECT id, event_date, segment FROM catalog")
def _(t: Tables):
    path = scratch(t.spark)
    rows, odd = t.catalog(), F.col("id").cast("bigint") % 2 == 1
    sinks.append_new(rows.filter(odd), path, WAREHOUSE, "event_date")
    sinks.append_new(rows.unionByName(rows), path, WAREHOUSE, "event_date")
    stored = t.spark.read.parquet(path)
    return stored.select("id", F.col("event_date").cast("string").alias("event_date"), "segment")


@query("read_ids", "SELECT o_orderkey FROM orders")
def _(t: Tables):
    return readers.read_ids(t.spark, f"{t.sf_dir}/orders.parquet", "o_orderkey")


@query("read_interactions_csv", """
    SELECT interaction_id, strftime(event_timestamp, '%Y-%m-%d %H:%M:%S.%f') AS event_timestamp, liked, segment,
           round(price_min, 6) AS price_min, CAST(event_date AS VARCHAR) AS event_date FROM fact""")
def _(t: Tables):
    path = scratch(t.spark)
    named = t.fact().withColumnsRenamed({"segment": "segmento", "price_min": "precio_min", "event_date": "fecha_evento"})
    named.write.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    rows = readers.type_interactions(readers.read_interactions_csv(t.spark, path))
    return fact_text(rows.select("interaction_id", "event_timestamp", "liked", "segment",
                                 r6("price_min").alias("price_min"), "event_date"))


@query("write_artifacts", "SELECT CAST(id AS VARCHAR) AS id, segment FROM catalog")
def _(t: Tables):
    path = scratch(t.spark)
    sinks.write_artifacts({"events": t.catalog().select("id", "segment")}, path, "done", format="csv")
    return t.spark.read.option("header", True).csv(f"{path}/events")


@query("build_envelope", """
    SELECT message_id, direction, user_id,
           to_json({'event_id': event_id, 'direction': direction, 'swiped_at': CASE WHEN CAST(message_id AS BIGINT) % 4 = 0
               THEN '2024-01-31T00:00:00' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00', 'dwell_ms': dwell_ms,
               'session_id': session_id, 'recommendation_context': recommendation_context, 'user_id': user_id})::VARCHAR AS data,
           'swipe' AS kind FROM payloads""")
def _(t: Tables):
    key = F.col("message_id").cast("bigint")
    rows = t.payloads().withColumn("swiped_at", F.when(key % 4 != 0, F.col("swiped_at")))
    built = staging.build_envelope(rows, F.col("user_id"), now())
    return built.select("message_id", F.col("attributes")["direction"].alias("direction"),
                        F.col("attributes")["user_id"].alias("user_id"), "data", F.col("attributes")["event_type"].alias("kind"))


@query("insert_ignore", """
    SELECT id, name FROM catalog WHERE CAST(id AS BIGINT) % 3 = 0
    UNION ALL SELECT id, 'new' FROM catalog WHERE CAST(id AS BIGINT) % 3 <> 0""")
def _(t: Tables):
    target = t.catalog().filter(F.col("id").cast("bigint") % 3 == 0).select("id", "name")
    rows = t.catalog().select("id", F.lit("new").alias("name"))
    return sinks.insert_ignore(target, rows.union(rows), ["id"])


@query("day_partitioned_table", """
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def _(t: Tables):
    path = scratch(t.spark)
    sinks.day_partitioned_table(t.read("events"), path, "ts", ["user_id"])
    return t.spark.read.parquet(path).groupBy(F.col("ts_day").cast("string").alias("day")).agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("write_fact", """
    SELECT CAST(CAST(ingestion_timestamp AS DATE) AS VARCHAR) AS ingestion_date, count(*) AS n,
           count(*) FILTER (WHERE liked) AS likes FROM fact GROUP BY 1""")
def _(t: Tables):
    path = scratch(t.spark)
    marts.write_fact(t.fact(), path)
    return t.spark.read.parquet(path).groupBy(F.col("ingestion_date").cast("string").alias("ingestion_date")).agg(
        F.count("*").alias("n"), F.count_if("liked").alias("likes"))


class Stopped(Exception):
    pass


@contextlib.contextmanager
def stopped_while_moving():
    """Lets a run publish its manifest and one file, then ends it as a lost driver would."""
    real, moves = commits.Files.move, []

    def move(self, source, target):
        if len(moves) == 2:
            raise Stopped
        moves.append(target)
        real(self, source, target)

    commits.Files.move = move
    try:
        yield
    except Stopped:
        pass
    finally:
        commits.Files.move = real


@query("merge_into_path", """
    SELECT interaction_id, strftime(ingestion_timestamp, '%Y-%m-%d %H:%M:%S.%f') AS ingestion_timestamp, segment FROM fact""")
def _(t: Tables):
    """A stored fact lacks the last day and a half. One run stops with its files staged and half of them moved; the next
    finishes it, and a third adds nothing."""
    path, work = scratch(t.spark), scratch(t.spark)
    staged = durable(t.staged())
    cut = F.lit("2024-01-29 12:00:00").cast("timestamp")
    before = marts.latest_interactions(staged.filter(F.col("ingestion_timestamp") <= cut))
    marts.write_fact(marts.fact_projection(marts.enrich_fact(before, t.catalog())), path)
    with stopped_while_moving():
        marts.merge_into_path(t.spark, path, staged, t.catalog(), dt.datetime.fromisoformat(NOW), work, "one", strict=False)
    for run in ("one", "two"):
        marts.merge_into_path(t.spark, path, staged, t.catalog(), dt.datetime.fromisoformat(NOW), work, run, strict=False)
    stored = t.spark.read.schema(FACT).parquet(path)
    return stored.select("interaction_id", ts_text("ingestion_timestamp").alias("ingestion_timestamp"), "segment")


@query("read_operational", "SELECT id, email, full_name, is_verified, preferred_location_lat FROM users")
def _(t: Tables):
    path = scratch(t.spark)
    t.users().write.parquet(f"{path}/users")
    return readers.read_operational(t.spark, path, "users").select(
        "id", "email", "full_name", "is_verified", "preferred_location_lat")


@query("catalogue_batch", f"""
    SELECT id, venue_id, CASE WHEN latitude IS NOT NULL THEN 'near ' || venue_id END AS nearby, 'mood ' || name AS mood,
           latitude IS NOT NULL AS has_weather
    FROM catalog WHERE {GOOD_RAW} AND coalesce(is_test, FALSE) = FALSE""")
def _(t: Tables):
    """The whole catalogue run, from landed pages to enriched documents."""
    from checks.joins import attributes
    from marquee.schemas import RESTAURANT

    path = scratch(t.spark)
    pages = raw_events(t).withColumn("events", F.array(F.struct("*"))).select(
        F.to_json(F.struct(F.struct("events").alias("_embedded"))).alias("value"))
    pages.write.text(f"{path}/pages")

    def near(missing):
        place = F.struct(F.concat(F.lit("near "), "venue_id").alias("name"), F.lit(4.0).alias("rating"), F.lit("€").alias("price"),
                         F.lit("here").alias("address"), F.lit(5).cast("bigint").alias("distance_m")).cast(RESTAURANT)
        return missing.select("venue_id", F.array(place).alias("nearby_restaurants"), F.lit(None).alias("nearby_lodgings"))

    nothing_near = near(t.venues()).withColumn("expires_at", now()).filter("false")
    no_attributes = attributes(t.catalog().select(F.col("name").alias("cache_id")), "none").filter("false")
    days = F.sequence(F.lit("2024-02-01").cast("date"), F.lit("2024-04-30").cast("date"))
    forecast = t.venues().select("*", F.explode(days).alias("day")).select(
        F.bround("latitude", 3).alias("latitude"), F.bround("longitude", 3).alias("longitude"),
        F.col("day").cast("string").alias("event_date"), F.lit(20.0).alias("temp_max"), F.lit(5.0).alias("temp_min"),
        F.lit(0.0).alias("rain_mm"), F.lit(0).cast("bigint").alias("weather_code"), F.lit(9.0).alias("wind_max_kmh"))
    no_documents, no_venues = T.StructType([WAREHOUSE["id"]]), T.StructType([WAREHOUSE["venue_id"]])
    store = CatalogueStore(*[KeyedTable(t.spark, f"{path}/{name}", [schema[0].name], schema, f"{path}/{name}-staging", 4) for name, schema in (
        ("documents", no_documents), ("venues", no_venues), ("semantics", no_attributes.schema))])
    run_catalogue_batch(
        t.spark, f"{path}/pages", f"{path}/raw", f"{path}/dead", f"{path}/warehouse", nothing_near, near, no_attributes,
        lambda missing: attributes(missing, "mood"), forecast, RUN, store)
    stored = t.spark.read.parquet(f"{path}/warehouse").select("id")
    return store.documents.read().join(stored, "id", "left_semi").select(
        "id", "venue_id", F.get("nearby_restaurants", 0)["name"].alias("nearby"), "mood",
        F.col("weather").isNotNull().alias("has_weather"))

