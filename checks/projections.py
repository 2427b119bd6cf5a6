"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import Tables, query, r6, ts_text
from marquee.operators import catalog, features, lifecycle, marts, staging
from marquee.schemas import RAW_EVENT, WAREHOUSE

ALL_FACT_TEXT = """interaction_id, strftime(event_timestamp, '%Y-%m-%d %H:%M:%S.%f') AS event_timestamp, user_id,
    session_id, event_id, interaction_type, swipe_direction, liked, recommendation_context"""


def fact_text(df: DataFrame) -> DataFrame:
    """Dates and instants as text, so that both engines give the same values."""
    kinds = dict(df.dtypes)
    return df.select(*[
        ts_text(name).alias(name) if kinds[name].startswith("timestamp")
        else F.col(name).cast("string").alias(name) if kinds[name] == "date" else F.col(name)
        for name in df.columns])


def raw_events(t: Tables) -> DataFrame:
    """Catalogue rows put back into the API's nested documents, with some bad coordinates and instants."""
    rows = t.catalog()
    key = F.col("id").cast("bigint")
    named = lambda column: F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("name")))
    image = lambda ratio, width, n: F.struct(
        F.lit(ratio).alias("ratio"), width.cast("bigint").alias("width"), F.concat(F.lit(f"img{n}-"), "id").alias("url"))
    images = F.array(
        image("16_9", 900 + key % 3 * 100, 1), image("16_9", 1000 + key % 2 * 200, 2), image("4_3", F.lit(3000), 3),
        image("16_9", F.lit(1200), 4))
    venue = F.struct(
        F.col("venue_id").alias("id"), F.col("venue_name").alias("name"), named("city").alias("city"),
        F.struct(F.col("address").alias("line1")).alias("address"), F.lit("28001").alias("postalCode"),
        F.struct(
            F.when(key % 47 == 3, "abc").otherwise(F.coalesce(F.col("latitude").cast("string"), F.lit(""))).alias("latitude"),
            F.col("longitude").cast("string").alias("longitude")).alias("location"))
    start = F.struct(
        F.col("event_date").alias("localDate"), F.col("event_time").alias("localTime"),
        F.when(key % 53 == 5, "soon").otherwise(F.date_format("starts_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("dateTime"))
    kind = F.struct(named("segment").alias("segment"), named("genre").alias("genre"), named("subgenre").alias("subGenre"))
    nested = rows.select(
        "id", "name", "url", F.col("is_test").alias("test"),
        F.struct(start.alias("start"), F.struct(F.col("status").alias("code")).alias("status")).alias("dates"),
        F.struct(F.struct(F.lit("2024-01-01T09:00:00Z").alias("startDateTime"),
                          F.lit(None).cast("string").alias("endDateTime")).alias("public")).alias("sales"),
        F.when(key % 12 == 0, F.array().cast(RAW_EVENT["classifications"].dataType))
        .otherwise(F.array(kind)).alias("classifications"),
        F.struct(
            F.array(venue, venue).alias("venues"),
            F.when(F.col("artist_name").isNotNull(), F.array(F.struct(
                F.concat(F.lit("a"), "id").alias("id"), F.col("artist_name").alias("name"),
                F.array(image("3_2", F.lit(305), 5)).alias("images")))).alias("attractions")).alias("_embedded"),
        images.alias("images"), F.struct(F.lit("Promoter").alias("name")).alias("promoter"),
        F.lit(None).cast("string").alias("description"))
    return nested.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_EVENT.fields])


GOOD_RAW = "CAST(id AS BIGINT) % 47 <> 3 AND CAST(id AS BIGINT) % 53 <> 5"


@query("flatten_event", f"""
    SELECT id, name, url, coalesce(is_test, FALSE) AS is_test, event_date, event_time,
           strftime(starts_at, '%Y-%m-%d %H:%M:%S.%f') AS starts_at, status, '2024-01-01T09:00:00Z' AS sale_start,
           CAST(NULL AS VARCHAR) AS sale_end,
           CASE WHEN CAST(id AS BIGINT) % 12 <> 0 THEN segment END AS segment,
           CASE WHEN CAST(id AS BIGINT) % 12 <> 0 THEN genre END AS genre,
           CASE WHEN CAST(id AS BIGINT) % 12 <> 0 THEN subgenre END AS subgenre,
           venue_id, venue_name, city, address, '28001' AS postal_code, latitude, longitude,
           CASE WHEN artist_name IS NOT NULL THEN 'a' || id END AS artist_id, artist_name,
           CASE WHEN artist_name IS NOT NULL THEN 'img5-' || id END AS artist_image,
           CASE WHEN CAST(id AS BIGINT) % 2 = 1 THEN 'img2-' ELSE 'img4-' END || id AS event_image,
           'Promoter' AS promoter, CAST(NULL AS VARCHAR) AS description
    FROM catalog WHERE {GOOD_RAW}""")
def _(t):
    good, _bad = catalog.split_valid(raw_events(t), catalog.raw_event_rules())
    return fact_text(catalog.flatten_event(good))


@query("split_valid", """
    SELECT id, CASE WHEN CAST(id AS BIGINT) % 47 = 3 THEN 'latitude is not a number'
                    WHEN CAST(id AS BIGINT) % 53 = 5 THEN 'start is not an instant' ELSE 'ok' END AS outcome
    FROM catalog""")
def _(t):
    good, bad = catalog.split_valid(raw_events(t), catalog.raw_event_rules())
    return good.select("id", F.lit("ok").alias("outcome")).union(bad.select("id", F.col("error").alias("outcome")))


@query("drop_test_events", "SELECT id, is_test FROM catalog WHERE is_test IS NULL OR NOT is_test")
def _(t):
    return catalog.drop_test_events(t.catalog()).select("id", "is_test")


@query("project_warehouse", """
    SELECT id, event_date, strftime(starts_at, '%Y-%m-%d %H:%M:%S.%f') AS starts_at, segment, latitude,
           CAST(NULL AS VARCHAR) AS promoter, CAST(NULL AS VARCHAR) AS mood, CAST(0 AS INTEGER) AS n_tags,
           CAST(38 AS INTEGER) AS n_columns
    FROM catalog""")
def _(t):
    rows = catalog.project_warehouse(t.catalog(), WAREHOUSE)
    return rows.select("id", F.col("event_date").cast("string").alias("event_date"), ts_text("starts_at").alias("starts_at"),
                       "segment", "latitude", "promoter", "mood", F.size("occasion_tags").alias("n_tags"),
                       F.lit(len(rows.columns)).alias("n_columns"))


@query("stage_interactions", """
    SELECT message_id AS interaction_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS event_timestamp, user_id, session_id,
           event_id, coalesce(interaction_type, 'swipe') AS interaction_type, direction AS swipe_direction,
           CASE direction WHEN 'right' THEN TRUE WHEN 'left' THEN FALSE END AS liked, recommendation_context,
           strftime(publish_time, '%Y-%m-%d %H:%M:%S.%f') AS ingestion_timestamp
    FROM raw""")
def _(t):
    return fact_text(staging.stage_interactions(t.raw()))


@query("valid_messages", f"""
    SELECT {ALL_FACT_TEXT}, strftime(ingestion_timestamp, '%Y-%m-%d %H:%M:%S.%f') AS ingestion_timestamp
    FROM staged""")
def _(t):
    return fact_text(t.staged())


CATALOG_TEXT = "id, strftime(starts_at, '%Y-%m-%d %H:%M:%S.%f') AS starts_at, segment, city"


def catalog_text(df: DataFrame) -> DataFrame:
    return df.select("id", ts_text("starts_at").alias("starts_at"), "segment", "city")


@query("query_catalog", f"""
    SELECT {CATALOG_TEXT} FROM catalog
    WHERE segment IN ('ECONOMY', 'PROMO', 'SMALL') AND latitude BETWEEN 36.5 AND 40 AND longitude BETWEEN -9 AND -3
    ORDER BY starts_at ASC NULLS FIRST, id LIMIT 200""")
def _(t):
    return catalog_text(catalog.query_catalog(
        t.catalog(), segments=["ECONOMY", "PROMO", "SMALL"], bbox=(36.5, 40.0, -9.0, -3.0), limit=200))


@query("query_catalog_box_last", f"""
    SELECT {CATALOG_TEXT} FROM (
        SELECT * FROM catalog WHERE segment IN ('ECONOMY', 'PROMO', 'SMALL')
        ORDER BY starts_at ASC NULLS FIRST, id LIMIT 200)
    WHERE latitude BETWEEN 36.5 AND 40 AND longitude BETWEEN -9 AND -3""")
def _(t):
    return catalog_text(catalog.query_catalog(
        t.catalog(), segments=["ECONOMY", "PROMO", "SMALL"], bbox=(36.5, 40.0, -9.0, -3.0), limit=200, box_first=False))


@query("query_catalog_city_date", f"""
    SELECT {CATALOG_TEXT} FROM catalog WHERE city = 'NATION_3' AND event_date = '2024-02-20'
    ORDER BY starts_at ASC NULLS FIRST, id LIMIT 1000""")
def _(t):
    return catalog_text(catalog.query_catalog(t.catalog(), city="NATION_3", date="2024-02-20"))


@query("bbox_filter", f"""
    SELECT {CATALOG_TEXT} FROM catalog WHERE latitude BETWEEN 37 AND 39 AND longitude BETWEEN -8 AND -4""")
def _(t):
    return catalog_text(catalog.bbox_filter(t.catalog(), 37.0, 39.0, -8.0, -4.0))


@query("get_event", f"SELECT {CATALOG_TEXT} FROM catalog WHERE id = '77'")
def _(t):
    return catalog_text(catalog.get_event(t.catalog(), "77"))


@query("mappable_events", f"SELECT {CATALOG_TEXT} FROM catalog WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def _(t):
    return catalog_text(catalog.mappable_events(t.catalog()))


GROUPS = """
    SELECT group_key, arg_min(id, sort_instant || ' ' || id) AS primary_id,
           arg_min(latitude, sort_instant || ' ' || id) AS latitude,
           arg_min(longitude, sort_instant || ' ' || id) AS longitude, count(*) AS n_occurrences
    FROM keyed WHERE latitude IS NOT NULL GROUP BY group_key"""


@query("visible_groups", f"""
    SELECT group_key, primary_id, n_occurrences FROM ({GROUPS})
    WHERE latitude BETWEEN 37 AND 39 AND longitude BETWEEN -8 AND -4""")
def _(t):
    groups = catalog.group_occurrences(catalog.mappable_events(t.catalog()))
    return catalog.visible_groups(groups, (37.0, 39.0, -8.0, -4.0)).select(
        "group_key", F.col("primary.id").alias("primary_id"), "n_occurrences")


@query("only_swipes", "SELECT interaction_id FROM fact WHERE lower(interaction_type) = 'swipe'")
def _(t):
    return features.only_swipes(t.fact()).select("interaction_id")


def dirty(t: Tables) -> DataFrame:
    """Fact with a `liked` that is sometimes wrong or missing, and sometimes no direction."""
    key = F.col("interaction_id").cast("bigint")
    return t.fact().withColumns({
        "liked": F.when(key % 9 == 0, F.lit(None)).when(key % 10 == 0, ~F.col("liked")).otherwise(F.col("liked")),
        "swipe_direction": F.when(key % 15 == 0, F.lit(None)).otherwise(F.col("swipe_direction"))})


DIRTY = """SELECT * REPLACE (
        CASE WHEN CAST(interaction_id AS BIGINT) % 9 = 0 THEN NULL
             WHEN CAST(interaction_id AS BIGINT) % 10 = 0 THEN NOT liked ELSE liked END AS liked,
        CASE WHEN CAST(interaction_id AS BIGINT) % 15 <> 0 THEN swipe_direction END AS swipe_direction) FROM fact"""


@query("repair_liked", f"""
    SELECT interaction_id,
           CASE swipe_direction WHEN 'right' THEN TRUE WHEN 'left' THEN FALSE ELSE liked END AS liked,
           coalesce((swipe_direction = 'right' AND liked IS DISTINCT FROM TRUE)
                    OR (swipe_direction = 'left' AND liked IS DISTINCT FROM FALSE), FALSE) AS liked_repaired
    FROM ({DIRTY})""")
def _(t):
    return features.repair_liked(dirty(t)).select("interaction_id", "liked", "liked_repaired")


@query("repair_price_order", """
    SELECT interaction_id, CASE WHEN price_max < price_min THEN price_max ELSE price_min END AS price_min,
           CASE WHEN price_max < price_min THEN price_min ELSE price_max END AS price_max,
           coalesce(price_max < price_min, FALSE) AS price_repaired
    FROM fact""")
def _(t):
    return features.repair_price_order(t.fact()).select("interaction_id", "price_min", "price_max", "price_repaired")


@query("drop_incomplete", f"""
    SELECT interaction_id FROM ({DIRTY})
    WHERE liked IS NOT NULL AND price_min IS NOT NULL AND price_max IS NOT NULL AND event_date IS NOT NULL""")
def _(t):
    return features.drop_incomplete(dirty(t)).select("interaction_id")


@query("derive_interaction", """
    SELECT interaction_id, CAST(days_until_event AS INTEGER) AS days_until_event, round(avg_price, 6) AS avg_price,
           is_right_swipe FROM clean""")
def _(t):
    return t.clean().select("interaction_id", "days_until_event", r6("avg_price").alias("avg_price"), "is_right_swipe")


@query("clean_interactions", """
    SELECT interaction_id, user_id, liked, round(price_min, 6) AS price_min, round(price_max, 6) AS price_max FROM clean""")
def _(t):
    doubled = t.fact().unionByName(t.fact())
    return features.clean_interactions(doubled).select(
        "interaction_id", "user_id", "liked", r6("price_min").alias("price_min"), r6("price_max").alias("price_max"))


@query("fact_projection", f"""
    SELECT {ALL_FACT_TEXT}, segment, genre, subgenre, city, price_min, price_max,
           CAST(event_date AS VARCHAR) AS event_date, venue_id,
           strftime(ingestion_timestamp, '%Y-%m-%d %H:%M:%S.%f') AS ingestion_timestamp
    FROM fact""")
def _(t):
    return fact_text(marts.fact_projection(marts.enrich_fact(t.latest(), t.catalog())))


@query("validate_payload", """
    SELECT message_id, concat_ws(',', CASE WHEN direction IS NULL THEN 'direction' END,
               CASE WHEN dwell_ms - 50 < 0 THEN 'dwell_ms' END,
               CASE WHEN recommendation_context <> 'map' THEN 'recommendation_context' END) AS invalid_fields,
           direction IS NOT NULL AND dwell_ms - 50 >= 0 AND recommendation_context = 'map' AS is_valid
    FROM payloads""")
def _(t):
    context = F.when(F.col("recommendation_context") == "map", "chat").otherwise(F.col("recommendation_context"))
    rows = t.payloads().withColumns({"dwell_ms": F.col("dwell_ms") - 50, "recommendation_context": context})
    return staging.validate_payload(rows).select("message_id", "invalid_fields", "is_valid")


@query("serialise_event", """
    SELECT id, to_json({'id': id, 'name': name, 'url': url, 'event_date': event_date, 'event_time': event_time,
        'starts_at': strftime(starts_at, '%Y-%m-%dT%H:%M:%S') || '+00:00', 'status': status, 'sale_start': NULL,
        'sale_end': NULL, 'segment': segment, 'genre': genre, 'subgenre': subgenre, 'venue_id': venue_id,
        'venue_name': venue_name, 'city': city, 'address': address, 'latitude': CAST(latitude AS VARCHAR),
        'longitude': CAST(longitude AS VARCHAR), 'artist_id': NULL, 'artist_name': artist_name, 'artist_image': NULL,
        'event_image': NULL, 'promoter': NULL, 'nearby_restaurants': [], 'nearby_lodgings': [],
        'arrival_advice': NULL})::VARCHAR AS json
    FROM catalog""")
def _(t):
    # Engines write doubles differently inside JSON, so the coordinates are compared as text.
    rows = t.catalog().withColumns({
        "latitude": F.col("latitude").cast("string"), "longitude": F.col("longitude").cast("string")})
    return catalog.serialise_event(rows)


@query("field_mask_places", """
    SELECT place_id, place_name AS name,
           CASE WHEN list_contains(types, 'hotel') THEN 'hotel' WHEN list_contains(types, 'motel') THEN 'motel'
                WHEN list_contains(types, 'hostel') THEN 'hostel' ELSE 'alojamiento' END AS kind,
           CASE CAST(place_id AS BIGINT) % 3 WHEN 0 THEN '€€' WHEN 1 THEN 'Gratis' END AS price,
           'Road ' || place_id AS address
    FROM places""")
def _(t):
    level = F.element_at(F.array(F.lit("PRICE_LEVEL_MODERATE"), F.lit("PRICE_LEVEL_FREE"), F.lit("OTHER")),
                         (F.col("place_id").cast("bigint") % 3 + 1).cast("int"))
    place = F.struct(
        F.struct(F.col("place_name").alias("text")).alias("displayName"), F.lit(4.5).alias("rating"),
        level.alias("priceLevel"), F.concat(F.lit("Road "), "place_id").alias("formattedAddress"), "types",
        F.lit(10).cast("bigint").alias("distance_m"))
    masked = t.places().select("place_id", catalog.field_mask_places(F.array(place), lodging=True)[0].alias("p"))
    return masked.select("place_id", "p.name", "p.kind", "p.price", "p.address")


@query("profile_completion", """
    SELECT id, CAST(round(25.0 * (CASE WHEN avatar_url IS NOT NULL THEN 1 ELSE 0 END
        + CASE WHEN full_name IS NOT NULL THEN 1 ELSE 0 END
        + CASE WHEN preferred_location IS NOT NULL THEN 1 ELSE 0 END
        + CASE WHEN n_categories > 0 THEN 1 ELSE 0 END)) AS INTEGER) AS completion_pct FROM users""")
def _(t):
    return lifecycle.profile_completion(t.users()).select("id", "completion_pct")


@query("plan_view", """
    SELECT CAST(plan_id AS BIGINT) AS plan_id, user_id, coalesce(title, '') AS title, updated_at,
           CAST(0 AS INTEGER) AS n_messages, CAST(50 AS INTEGER) AS vibe_chaos
    FROM plan_headers WHERE user_id = '7'""")
def _(t):
    plans = t.plan_headers().withColumns({
        "messages": F.lit(None).cast("array<struct<role:string,content:string,timestamp:string>>"),
        "itinerary": F.lit(None).cast("struct<stops:array<string>,budget:int,vibe_chaos:int,vibe_hidden:int>")})
    return lifecycle.plan_view(plans, "7").select(
        "plan_id", "user_id", "title", "updated_at", F.size("messages").alias("n_messages"),
        F.col("itinerary.vibe_chaos").alias("vibe_chaos"))
