"""Joins, caches and keyed writes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.base import Tables, now, query, ts_text
from checks.projections import ALL_FACT_TEXT, fact_text
from marquee.functions import lookups
from marquee.operators import catalog, enrich, lifecycle, marts
from marquee.scale import durable
from marquee.schemas import ARRIVAL_ADVICE, SEMANTIC_FIELDS


@query("enrich_fact", """
    SELECT interaction_id, event_id, segment, city, price_min, CAST(event_date AS VARCHAR) AS event_date, venue_id FROM (
        SELECT l.*, c.segment, c.city, c.price_min, c.event_date, c.venue_id FROM latest l
        LEFT JOIN (SELECT * FROM catalog WHERE CAST(id AS BIGINT) % 3 <> 0) c ON c.id = l.event_id)""")
def _(t: Tables):
    # The catalogue is given twice: duplicates must not multiply rows.
    part = t.catalog().filter(F.col("id").cast("bigint") % 3 != 0)
    rows = marts.enrich_fact(t.latest(), part.unionByName(part))
    return rows.select("interaction_id", "event_id", "segment", "city", "price_min",
                       F.col("event_date").cast("string").alias("event_date"), "venue_id")


@query("new_events_only", """
    SELECT id, segment FROM catalog WHERE CAST(id AS BIGINT) % 4 <> 0
    UNION ALL SELECT id, segment FROM catalog WHERE CAST(id AS BIGINT) % 4 <> 0
    UNION ALL SELECT NULL, segment FROM catalog""")
def _(t: Tables):
    rows = t.catalog().select("id", "segment")
    nameless = rows.withColumn("id", F.lit(None).cast("string"))
    existing = rows.filter(F.col("id").cast("bigint") % 4 == 0)
    return marts.new_events_only(rows.union(rows).union(nameless), existing)


@query("new_events_only_deduped", "SELECT id, segment FROM catalog WHERE CAST(id AS BIGINT) % 4 <> 0")
def _(t: Tables):
    rows = t.catalog().select("id", "segment")
    return marts.new_events_only(rows.union(rows), rows.filter(F.col("id").cast("bigint") % 4 == 0), dedupe=True)


ANSWER = T.StructType([T.StructField("capital", T.StringType())])


def nation_keys(t: Tables):
    """Customers with the name of their nation as key, every ninth without."""
    nation = t.read("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = t.read("customer").join(nation, "c_nationkey")
    return rows.select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("n_name")).alias("n_name"))


def nation_cache(t: Tables):
    return t.read("nation").filter("n_nationkey % 2 = 0").select(
        "n_name", F.concat(F.lit("cached "), "n_name").alias("capital"), (F.col("n_nationkey") % 4 == 0).alias("good"))


def nation_answers(t: Tables):
    table = t.read("nation").filter("n_nationkey % 5 <> 3").select(
        "n_name", F.concat(F.lit("asked "), "n_name").alias("capital"))
    return lambda missing: missing.join(table, "n_name")


NATION_ANSWERS = """
    SELECT n_name, n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'cached ' || n_name
        WHEN n_nationkey % 5 <> 3 THEN 'asked ' || n_name END AS capital FROM nation"""


@query("cache_aside", f"""
    SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN n_name END AS n_name,
           CASE WHEN c_custkey % 9 <> 0 THEN capital END AS capital
    FROM customer JOIN ({NATION_ANSWERS}) ON n_nationkey = c_nationkey""")
def _(t: Tables):
    enriched, _fresh = enrich.cache_aside(
        nation_keys(t), nation_cache(t), ["n_name"], F.col("good"), nation_answers(t), ANSWER)
    return enriched.select("c_custkey", "n_name", "capital")


@query("cache_aside_updates", f"""
    SELECT DISTINCT n_name, capital FROM ({NATION_ANSWERS})
    JOIN customer ON n_nationkey = c_nationkey AND c_custkey % 9 <> 0
    WHERE n_nationkey % 4 <> 0 AND capital IS NOT NULL""")
def _(t: Tables):
    _enriched, fresh = enrich.cache_aside(
        nation_keys(t), nation_cache(t), ["n_name"], F.col("good"), nation_answers(t), ANSWER)
    return fresh.select("n_name", "capital")


@query("cache_aside_batches", """
    SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN
        CASE WHEN n_nationkey % 4 = 0 THEN 'cached ' || n_name ELSE upper(n_name) || '!' END END AS capital
    FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def _(t: Tables):
    def setup():
        mark = "!"

        def call(batch):
            return batch.assign(capital=batch["n_name"].str.upper() + mark)[["n_name", "capital"]]

        return call

    answer = enrich.per_batch(setup, "n_name string, capital string")
    enriched, _fresh = enrich.cache_aside(nation_keys(t), nation_cache(t), ["n_name"], F.col("good"), answer, ANSWER)
    return enriched.select("c_custkey", "capital")


VENUE_OUT = T.StructType([T.StructField("nearby", T.StringType())])


@query("enrich_venue", """
    SELECT id, CASE WHEN latitude IS NULL THEN NULL
        WHEN CAST(venue_id AS BIGINT) % 3 = 0 THEN 'cached ' || venue_id ELSE 'asked ' || venue_name END AS nearby
    FROM catalog""")
def _(t: Tables):
    key = F.col("venue_id").cast("bigint")
    cache = t.venues().filter(key % 3 != 1).select(
        "venue_id", F.concat(F.lit("cached "), "venue_id").alias("nearby"),
        F.when(key % 3 == 0, now() + F.expr("INTERVAL 1 DAY")).otherwise(now()).alias("expires_at"))
    ask = lambda missing: missing.select("venue_id", F.concat(F.lit("asked "), "venue_name").alias("nearby"))
    enriched, _updates = enrich.enrich_venue(t.catalog(), cache, ask, now(), VENUE_OUT)
    return enriched.select("id", "nearby")


@query("enrich_venue_updates", """
    SELECT venue_id, 'asked ' || any_value(venue_name) AS nearby, '2024-02-14 00:00:00.000000' AS expires_at,
           any_value(venue_name) AS venue_name, min(city) AS city, any_value(latitude) AS latitude, any_value(longitude) AS longitude
    FROM catalog WHERE latitude IS NOT NULL AND CAST(venue_id AS BIGINT) % 3 <> 0 GROUP BY venue_id""")
def _(t: Tables):
    key = F.col("venue_id").cast("bigint")
    cache = t.venues().filter(key % 3 == 0).select(
        "venue_id", F.lit("cached").alias("nearby"), (now() + F.expr("INTERVAL 1 DAY")).alias("expires_at"))
    ask = lambda missing: missing.select("venue_id", F.concat(F.lit("asked "), "venue_name").alias("nearby"))
    _enriched, updates = enrich.enrich_venue(t.catalog(), cache, ask, now(), VENUE_OUT)
    return updates.select("venue_id", "nearby", ts_text("expires_at").alias("expires_at"), "venue_name", "city", "latitude", "longitude")


def attributes(rows, source: str):
    """Semantic attributes made up from a name, as a function or a cache would give them."""
    kinds = {f.name: f.dataType for f in SEMANTIC_FIELDS.fields}
    made = {"mood": F.concat(F.lit(f"{source} "), "cache_id"), "category": F.lit("Música")}
    columns = []
    for name, kind in kinds.items():
        default = F.lit(50) if isinstance(kind, T.LongType) else F.array(F.lit("solo")) if isinstance(kind, T.ArrayType) \
            else F.lit("x")
        columns.append(made.get(name, default).cast(kind).alias(name))
    advice = F.struct(F.lit(30).cast("bigint").alias("minutes_ahead"), F.lit("cola").alias("reason"))
    return rows.select("cache_id", advice.alias("arrival_advice"), *columns)


@query("enrich_semantic", """
    SELECT id, CASE WHEN first IN ('b', 'c') THEN 'cached ' || name WHEN first NOT IN ('s', 'r') THEN 'asked ' || name END AS mood,
           CASE WHEN first NOT IN ('s', 'r') THEN CAST(30 AS BIGINT) END AS minutes_ahead
    FROM (SELECT id, replace(name, '/', '_') AS name, left(name, 1) AS first FROM catalog)""")
def _(t: Tables):
    names = t.catalog().select(F.col("name").alias("cache_id")).distinct()
    first = F.left("cache_id", F.lit(1))
    full = attributes(names.filter(first.isin("b", "c", "h")), "cached")
    # An incomplete cache row does not count; for s and r there is no answer.
    cache = full.withColumn("time_slot", F.when(first != "h", F.col("time_slot")))
    ask = lambda missing: attributes(missing.filter(~first.isin("s", "r")), "asked")
    enriched, _fresh = enrich.enrich_semantic(t.catalog(), cache, ask, ARRIVAL_ADVICE)
    return enriched.select("id", "mood", F.col("arrival_advice.minutes_ahead").alias("minutes_ahead"))


@query("enrich_weather", """
    SELECT id, CASE WHEN known THEN venue % 10 + 15.5 END::DOUBLE AS temp_max,
           CASE WHEN known AND venue % 2 = 0 THEN 'Despejado' END AS description, known AS has_weather
    FROM (SELECT id, CAST(venue_id AS BIGINT) AS venue,
                 latitude IS NOT NULL AND CAST(event_date AS DATE) < DATE '2024-03-01' AS known FROM catalog)""")
def _(t: Tables):
    key = F.col("venue_id").cast("bigint")
    days = F.sequence(F.lit("2024-02-01").cast("date"), F.lit("2024-02-29").cast("date"))
    forecast = t.venues().select("*", F.explode(days).alias("day")).select(
        F.bround("latitude", 3).alias("latitude"), F.bround("longitude", 3).alias("longitude"),
        F.col("day").cast("string").alias("event_date"), (key % 10 + F.lit(15.5)).alias("temp_max"),
        F.lit(5.0).alias("temp_min"), F.lit(0.0).alias("rain_mm"),
        F.when(key % 2 == 0, 0).otherwise(7).cast("bigint").alias("weather_code"), F.lit(9.0).alias("wind_max_kmh"))
    rows = enrich.enrich_weather(t.catalog(), forecast)
    return rows.select("id", F.col("weather.temp_max").alias("temp_max"), F.col("weather.description").alias("description"),
                       F.col("weather").isNotNull().alias("has_weather"))


def nearest_sql(radius: int, words: str, k: int = 20) -> str:
    return f"""
    SELECT venue_id, place_id, distance_m FROM (
        SELECT v.venue_id, p.place_id, CAST(round_even(6371000.0 * 2 * asin(sqrt(
               pow(sin(radians(p.latitude - v.latitude) / 2), 2) + cos(radians(v.latitude)) * cos(radians(p.latitude))
               * pow(sin(radians(p.longitude - v.longitude) / 2), 2))), 0) AS BIGINT) AS distance_m
        FROM venues v JOIN places p ON list_has_any(p.types, {words})
         AND p.latitude BETWEEN v.latitude - 0.1 AND v.latitude + 0.1)
    WHERE distance_m <= {radius}
    QUALIFY row_number() OVER (PARTITION BY venue_id ORDER BY distance_m, place_id) <= {k}"""


@query("nearby_places", nearest_sql(5000, "['hotel', 'motel', 'hostel', 'lodging']"))
def _(t: Tables):
    return enrich.nearby_places(t.venues(), t.places(), 5000.0, enrich.LODGING_TYPES)


@query("nearby_places_few", nearest_sql(5000, "['restaurant', 'spa', 'lodging']", 2))
def _(t: Tables):
    return enrich.nearby_places(t.venues(), t.places(), 5000.0, ["restaurant", "spa", "lodging"], 2)


@query("venue_surroundings", f"""
    SELECT *, 'restaurant' AS kind FROM ({nearest_sql(1000, "['restaurant']")})
    UNION ALL SELECT *, 'lodging' AS kind FROM ({nearest_sql(5000, "['hotel', 'motel', 'hostel', 'lodging']")})""")
def _(t: Tables):
    return enrich.venue_surroundings(t.venues(), t.places())


@query("exclude_saved", """
    SELECT id, user_id, event_id FROM save_requests r
    WHERE NOT EXISTS (SELECT 1 FROM saved s WHERE s.user_id = r.user_id AND s.event_id = r.event_id)""")
def _(t: Tables):
    return catalog.exclude_saved(t.save_requests(), t.saved()).select("id", "user_id", "event_id")


WEATHER_ROWS = ", ".join(f"({code}, '{words}')" for code, words in lookups.WEATHER_CODES.items())


@query("lookup_weather_code", f"""
    SELECT p_partkey, description FROM part LEFT JOIN (VALUES {WEATHER_ROWS}) w(code, description) ON code = p_partkey % 100""")
def _(t: Tables):
    return t.read("part").select("p_partkey", lookups.lookup_weather_code(F.col("p_partkey") % 100).alias("description"))


PRICE_ROWS = ", ".join(f"('{level}', '{symbol}')" for level, symbol in lookups.PRICE_LEVELS.items())
LEVELS = [*lookups.PRICE_LEVELS, "OTHER"]


@query("lookup_price_level", f"""
    SELECT p_partkey, symbol FROM (
        SELECT p_partkey, list_extract([{', '.join(repr(w) for w in LEVELS)}], CAST(p_partkey % 7 + 1 AS INTEGER)) AS level FROM part)
    LEFT JOIN (VALUES {PRICE_ROWS}) w(code, symbol) ON code = level""")
def _(t: Tables):
    level = F.get(F.array(*[F.lit(w) for w in LEVELS]), (F.col("p_partkey") % 7).cast("int"))
    return t.read("part").select("p_partkey", lookups.lookup_price_level(level).alias("symbol"))


@query("lookup_pin_category", """
    SELECT id, CASE segment WHEN 'ECONOMY' THEN 'music' WHEN 'LARGE' THEN 'art' WHEN 'SMALL' THEN 'art' ELSE 'food' END AS pin
    FROM catalog""")
def _(t: Tables):
    segment = (F.when(F.col("segment") == "ECONOMY", " Music ").when(F.col("segment") == "LARGE", "Arts & Theatre")
               .when(F.col("segment") == "SMALL", "Film").otherwise(F.col("segment")))
    return t.catalog().select("id", lookups.lookup_pin_category(segment).alias("pin"))


@query("resolve_home_location", """
    SELECT id, coalesce(preferred_location_lat, CASE trim(lower(preferred_location)) WHEN 'málaga' THEN 36.7213
               WHEN 'barcelona' THEN 41.3851 WHEN 'bilbao' THEN 43.263 END, 40.4168)::DOUBLE AS home_lat,
           coalesce(preferred_location_lng, CASE trim(lower(preferred_location)) WHEN 'málaga' THEN -4.4214
               WHEN 'barcelona' THEN 2.1734 WHEN 'bilbao' THEN -2.935 END, -3.7038)::DOUBLE AS home_lng
    FROM users""")
def _(t: Tables):
    return enrich.resolve_home_location(t.users()).select("id", "home_lat", "home_lng")


FIRST_REQUESTS = """
    SELECT id, user_id, event_id FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY created_at, id) AS n FROM save_requests) r
    WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM saved s WHERE s.user_id = r.user_id AND s.event_id = r.event_id)"""


@query("save_if_absent", FIRST_REQUESTS)
def _(t: Tables):
    fresh, _conflicts = lifecycle.save_if_absent(t.saved(), t.save_requests())
    return fresh.select("id", "user_id", "event_id")


@query("save_if_absent_conflicts", f"""
    SELECT id, user_id, event_id FROM save_requests WHERE id NOT IN (SELECT id FROM ({FIRST_REQUESTS}))""")
def _(t: Tables):
    _fresh, conflicts = lifecycle.save_if_absent(t.saved(), t.save_requests())
    return conflicts.select("id", "user_id", "event_id")


@query("sibling_occurrences", """
    SELECT group_key, id FROM keyed WHERE group_key IN (
        SELECT group_key FROM keyed WHERE CAST(id AS BIGINT) % 5 = 0)""")
def _(t: Tables):
    wanted = t.catalog().filter(F.col("id").cast("bigint") % 5 == 0).select("id")
    return catalog.sibling_occurrences(t.catalog(), wanted).select("group_key", "id")


@query("export_user_data", """
    SELECT id AS user_id, 'profile' AS section, id AS record_key,
           to_json({'id': id, 'email': email, 'full_name': full_name})::VARCHAR AS record FROM users WHERE CAST(id AS BIGINT) % 6 = 0
    UNION ALL
    SELECT user_id, 'saved_event', event_id,
           to_json({'user_id': user_id, 'event_id': event_id, 'created': strftime(created_at, '%Y-%m-%d')})::VARCHAR
    FROM saved WHERE CAST(user_id AS BIGINT) % 6 = 0
    UNION ALL
    SELECT user_id, 'plan', CAST(plan_id AS VARCHAR), to_json({'plan_id': plan_id, 'user_id': user_id, 'title': title})::VARCHAR
    FROM plan_headers WHERE CAST(user_id AS BIGINT) % 6 = 0 AND user_id IN (SELECT id FROM users)""")
def _(t: Tables):
    ids = t.users().filter(F.col("id").cast("bigint") % 6 == 0).select("id")
    saved = t.saved().select("user_id", "event_id", F.to_date("created_at").cast("string").alias("created"))
    return lifecycle.export_user_data(
        t.users().select("id", "email", "full_name"), saved, t.plan_headers().select("plan_id", "user_id", "title"), ids)


@query("erase_users", """
    SELECT 'users' AS name, id AS user_id, email AS item FROM users WHERE CAST(id AS BIGINT) % 6 <> 0
    UNION ALL SELECT 'saved', user_id, event_id FROM saved WHERE CAST(user_id AS BIGINT) % 6 <> 0
    UNION ALL SELECT 'plans', user_id, CAST(plan_id AS VARCHAR) FROM plan_headers WHERE CAST(user_id AS BIGINT) % 6 <> 0""")
def _(t: Tables):
    ids = t.users().filter(F.col("id").cast("bigint") % 6 == 0).select("id")
    left = lifecycle.erase_users({"users": t.users(), "saved": t.saved(), "plans": t.plan_headers()}, ids)
    shown = {"users": ("id", "email"), "saved": ("user_id", "event_id"), "plans": ("user_id", "plan_id")}
    rows = [frame.select(F.lit(name).alias("name"), F.col(shown[name][0]).alias("user_id"), F.col(shown[name][1]).cast("string").alias("item"))
            for name, frame in left.items()]
    return rows[0].union(rows[1]).union(rows[2])


def sign_ins(t: Tables):
    """Orders as sign-ins: by a known uid, by a known e-mail under a new uid, by both, and by strangers."""
    key, user = F.col("o_orderkey"), F.col("o_custkey")
    kind = user % 4  # users whose number divides by four have no uid yet
    stranger = key % 10 == 9
    uid = F.when(stranger, F.concat(F.lit("new-"), (key % 700).cast("string"))).otherwise(
        F.concat(F.when(key % 10 == 8, "alt-").otherwise("uid-"), user.cast("string")))
    email = F.when(stranger, F.concat(F.lit("guest"), (key % 700).cast("string"), F.lit("@mail.example"))).otherwise(
        F.concat(F.lit("user"), user.cast("string"), F.lit("@mail.example")))
    return t.read("orders").select(
        uid.alias("uid"), email.alias("email"), (key % 3 == 0).alias("email_verified"),
        F.when(kind != 2, F.concat(F.lit("Name "), (user % 50).cast("string"))).alias("name"),
        F.when(kind != 1, F.lit("picture")).alias("picture"),
        F.when(key % 2 == 0, "password").otherwise("google.com").alias("provider"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.col("o_orderkey") % 86400)).alias("signed_at"))


SIGN_INS = """
    SELECT * FROM (
        SELECT CASE WHEN o_orderkey % 10 = 9 THEN 'new-' || (o_orderkey % 700) WHEN o_orderkey % 10 = 8 THEN 'alt-' || o_custkey ELSE 'uid-' || o_custkey END AS uid,
               CASE WHEN o_orderkey % 10 = 9 THEN 'guest' || (o_orderkey % 700) ELSE 'user' || o_custkey END || '@mail.example' AS email,
               o_orderkey % 3 = 0 AS email_verified,
               CASE WHEN o_custkey % 4 <> 2 THEN 'Name ' || (o_custkey % 50) END AS name,
               CASE WHEN o_custkey % 4 <> 1 THEN 'picture' END AS picture, o_orderkey % 2 = 0 AS by_password,
               o_orderdate + to_seconds(o_orderkey % 86400) AS signed_at FROM orders)
    WHERE NOT (by_password AND NOT email_verified)"""


@query("reconcile_identities", f"""
    WITH s AS ({SIGN_INS}),
    known AS (SELECT uid, arg_max(email_verified, signed_at) AS verified, max(signed_at) AS at FROM s
              WHERE uid IN (SELECT auth_uid FROM users WHERE auth_uid IS NOT NULL) GROUP BY uid),
    rest AS (SELECT email, arg_max(uid, signed_at) AS uid, arg_max(email_verified, signed_at) AS verified, max(signed_at) AS at,
                    arg_min(name, signed_at) FILTER (WHERE name IS NOT NULL) AS name,
                    arg_min(picture, signed_at) FILTER (WHERE picture IS NOT NULL) AS picture
             FROM s WHERE uid NOT IN (SELECT auth_uid FROM users WHERE auth_uid IS NOT NULL) GROUP BY email)
    SELECT u.email, coalesce(r.uid, u.auth_uid) AS auth_uid, coalesce(u.full_name, r.name) AS full_name,
           coalesce(u.avatar_url, r.picture) AS avatar_url, coalesce(CASE WHEN r.at >= coalesce(k.at, r.at) THEN r.verified ELSE k.verified END, u.is_verified) AS is_verified
    FROM users u LEFT JOIN known k ON k.uid = u.auth_uid LEFT JOIN rest r ON r.email = u.email
    UNION ALL
    SELECT email, uid, name, picture, verified FROM rest WHERE email NOT IN (SELECT email FROM users)""")
def _(t: Tables):
    return lifecycle.reconcile_identities(t.users(), sign_ins(t)).select(
        "email", "auth_uid", "full_name", "avatar_url", "is_verified")


@query("merge_incremental", f"""
    WITH target AS (SELECT * REPLACE ('old' AS segment) FROM fact WHERE ingestion_timestamp <= TIMESTAMP '2024-01-29 12:00:00'),
    mark AS (SELECT max(ingestion_timestamp) AS high FROM target WHERE ingestion_timestamp > TIMESTAMP '2024-01-28'),
    fresh AS (SELECT * FROM staged WHERE ingestion_timestamp > (SELECT high FROM mark)
              QUALIFY row_number() OVER (PARTITION BY interaction_id ORDER BY ingestion_timestamp DESC) = 1),
    updates AS (SELECT l.*, c.segment FROM fresh l LEFT JOIN catalog c ON c.id = l.event_id)
    SELECT {ALL_FACT_TEXT}, segment, strftime(ingestion_timestamp, '%Y-%m-%d %H:%M:%S.%f') AS ingestion_timestamp FROM target
    WHERE NOT (ingestion_timestamp > TIMESTAMP '2024-01-28' AND interaction_id IN (SELECT interaction_id FROM updates))
    UNION ALL
    SELECT {ALL_FACT_TEXT}, segment, strftime(ingestion_timestamp, '%Y-%m-%d %H:%M:%S.%f') FROM updates""")
def _(t: Tables):
    cut = F.lit("2024-01-29 12:00:00").cast("timestamp")
    staged = durable(t.staged())
    target = durable(t.fact()).filter(F.col("ingestion_timestamp") <= cut).withColumn("segment", F.lit("old"))
    merged = marts.merge_incremental(target, staged, t.catalog(), now())
    return fact_text(merged.select(
        "interaction_id", "event_timestamp", "user_id", "session_id", "event_id", "interaction_type", "swipe_direction",
        "liked", "recommendation_context", "segment", "ingestion_timestamp"))


@query("merge_incremental_late", """
    WITH target AS (SELECT * FROM fact WHERE CAST(interaction_id AS BIGINT) % 3 <> 0)
    SELECT interaction_id, 'kept' AS origin FROM target
    UNION ALL
    SELECT interaction_id, 'added' FROM latest
    WHERE CAST(interaction_id AS BIGINT) % 3 = 0 AND ingestion_timestamp > TIMESTAMP '2024-01-28'""")
def _(t: Tables):
    third = F.col("interaction_id").cast("bigint") % 3
    target = durable(t.fact()).filter(third != 0)
    merged = marts.merge_incremental(target, durable(t.staged()), t.catalog(), now(), strict=False)
    return merged.select("interaction_id", F.when(third == 0, "added").otherwise("kept").alias("origin"))


@query("target_high_water", """
    SELECT strftime(coalesce(max(ingestion_timestamp), TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S.%f') AS high_water
    FROM fact WHERE ingestion_timestamp > TIMESTAMP '2024-01-28'""")
def _(t: Tables):
    return marts.target_high_water(t.fact(), now()).select(ts_text("high_water").alias("high_water"))


@query("target_high_water_empty", """
    SELECT strftime(coalesce(max(ingestion_timestamp), TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S.%f') AS high_water
    FROM fact WHERE ingestion_timestamp > TIMESTAMP '2024-01-31' + INTERVAL 397 DAY""")
def _(t: Tables):
    later = now() + F.expr("INTERVAL 400 DAYS")
    return marts.target_high_water(t.fact(), later).select(ts_text("high_water").alias("high_water"))

