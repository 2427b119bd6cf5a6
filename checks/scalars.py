"""Scalar functions, each over a whole column."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Tables, query, r6, ts_text
from marquee.functions import geo, instants, lookups, text, values


@query("haversine_m", """
    SELECT place_id, CAST(round_even(6371000.0 * 2 * atan2(sqrt(a), sqrt(1 - a)), 0) AS BIGINT) AS distance_m
    FROM (SELECT p.place_id,
                 pow(sin(radians(p.latitude - v.latitude) / 2), 2) + cos(radians(v.latitude)) * cos(radians(p.latitude))
                 * pow(sin(radians(p.longitude - v.longitude) / 2), 2) AS a
          FROM places p JOIN venues v ON v.venue_id = CAST(CAST(p.place_id AS BIGINT) % 10 AS VARCHAR))""")
def _(t: Tables):
    places = t.places().withColumn("venue_id", (F.col("place_id").cast("bigint") % 10).cast("string"))
    venues = t.venues().select("venue_id", F.col("latitude").alias("v_lat"), F.col("longitude").alias("v_lng"))
    distance = geo.haversine_m(F.col("v_lat"), F.col("v_lng"), F.col("latitude"), F.col("longitude"))
    return places.join(venues, "venue_id").select("place_id", distance.alias("distance_m"))


@query("json_value", """
    SELECT event_id, json_extract_string(doc, '$.k') AS number,
           CASE WHEN json_type(doc, '$.o') IN ('OBJECT', 'ARRAY') THEN NULL ELSE json_extract_string(doc, '$.o') END AS nested,
           CASE WHEN json_type(doc, '$.a') IN ('OBJECT', 'ARRAY') THEN NULL ELSE json_extract_string(doc, '$.a') END AS list,
           CAST(NULL AS VARCHAR) AS nothing, json_extract_string(doc, '$.o.inner') AS inside
    FROM (SELECT event_id, json(replace(props, '}', ', "o": {"inner": "' || event_type || '"}, "a": [1, 2], "z": null}')) AS doc
          FROM events WHERE event_id % 10 <> 0
          UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 10 = 0)""")
def _(t: Tables):
    tail = F.concat(F.lit(', "o": {"inner": "'), "event_type", F.lit('"}, "a": [1, 2], "z": null}'))
    doc = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.replace("props", F.lit("}"), tail))
    rows = t.read("events").select("event_id", doc.alias("doc"))
    get = lambda path: values.json_value(F.col("doc"), path)
    return rows.select("event_id", get("$.k").alias("number"), get("$.o").alias("nested"), get("$.a").alias("list"),
                       get("$.z").alias("nothing"), get("$.o.inner").alias("inside"))


@query("parse_instant", """
    SELECT event_id, strftime(CASE event_id % 4 WHEN 3 THEN NULL WHEN 2 THEN ts - INTERVAL 2 HOUR ELSE ts END,
                              '%Y-%m-%d %H:%M:%S.%f') AS instant FROM events""")
def _(t: Tables):
    form = lambda pattern: F.date_format("ts", pattern)
    kind = F.col("event_id") % 4
    written = (F.when(kind == 0, form("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(kind == 1, form("yyyy-MM-dd HH:mm:ss.SSSSSS"))
               .when(kind == 2, form("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'")).otherwise(F.lit("yesterday")))
    return t.read("events").select("event_id", ts_text(instants.parse_instant(written)).alias("instant"))


WORDS = ["True", " yes ", "1", "FALSE", "no", "0", "maybe", ""]


@query("parse_bool", """
    SELECT event_id, CASE WHEN event_id % 8 < 3 THEN TRUE WHEN event_id % 8 < 6 THEN FALSE END AS value FROM events""")
def _(t: Tables):
    word = F.get(F.array(*[F.lit(w) for w in WORDS]), (F.col("event_id") % 8).cast("int"))
    return t.read("events").select("event_id", values.parse_bool(word).alias("value"))


@query("to_number", """
    SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS number FROM part""")
def _(t: Tables):
    written = F.when(F.col("p_partkey") % 5 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string"))
    return t.read("part").select("p_partkey", values.to_number(written).alias("number"))


@query("slugify", r"""
    SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(regexp_replace(lower(trim(label)), '[ /\-]', '_', 'g'),
           '&', 'and'), '[^\p{L}\p{N}_]', '', 'g'), '_+', '_', 'g'), '_') AS slug
    FROM (SELECT p_partkey, ' ' || p_brand || ' & Ópera/' || p_type || '--(' || p_name || ')! ' AS label FROM part)""")
def _(t: Tables):
    label = F.concat(F.lit(" "), "p_brand", F.lit(" & Ópera/"), "p_type", F.lit("--("), "p_name", F.lit(")! "))
    return t.read("part").select("p_partkey", text.slugify(label).alias("slug"))


@query("slugify_handle", r"""
    SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN regexp_replace(left(split_part(mail, '@', 1), 90),
                                '[^\p{L}\p{N}_\-]', '_', 'g')
           ELSE left(regexp_replace(lower(trim(regexp_replace(strip_accents(label), '[^A-Za-z0-9_\-]+', '_', 'g'), '_')),
                                    '_+', '_', 'g'), 90) END AS handle
    FROM (SELECT c_custkey, '¡José Núñez! ' || c_name || ' Çelik' AS label, 'a.b+' || c_custkey || '@mail.example' AS mail
          FROM customer)""")
def _(t: Tables):
    key = F.col("c_custkey")
    name = F.when(key % 6 != 0, F.concat(F.lit("¡José Núñez! "), "c_name", F.lit(" Çelik"))).when(key % 12 == 0, "¿?")
    mail = F.concat(F.lit("a.b+"), key.cast("string"), F.lit("@mail.example"))
    return t.read("customer").select("c_custkey", text.slugify_handle(name, mail).alias("handle"))


@query("clean_label", """
    SELECT id, CASE WHEN trim(coalesce(genre, '')) <> '' AND lower(trim(genre)) <> 'undefined' THEN trim(genre) END AS label
    FROM catalog""")
def _(t: Tables):
    padded = F.concat(F.lit("  "), "genre", F.lit(" "))
    return t.catalog().select("id", text.clean_label(padded).alias("label"))


@query("identity_key", "SELECT id, group_key FROM keyed")
def _(t: Tables):
    shouted = F.concat(F.lit(" "), F.upper("name"))
    return t.catalog().select("id", text.identity_key(shouted, F.col("venue_name"), F.col("city")).alias("group_key"))


@query("strip_accents_lower", """
    SELECT id, strip_accents(lower(trim(preferred_location))) AS city FROM users""")
def _(t: Tables):
    return t.users().select("id", text.strip_accents_lower(F.col("preferred_location")).alias("city"))


@query("sort_instant_text", "SELECT id, sort_instant FROM keyed")
def _(t: Tables):
    return t.catalog().select("id", instants.sort_instant_text(
        F.col("starts_at"), F.col("event_date"), F.col("event_time")).alias("sort_instant"))


@query("days_between", """
    SELECT interaction_id, CAST(date_diff('day', CAST(event_timestamp AS DATE), event_date) AS INTEGER) AS days,
           CAST(floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(event_timestamp)) / 86400e6) AS BIGINT) AS elapsed
    FROM fact""")
def _(t: Tables):
    from checks.base import now
    return t.fact().select(
        "interaction_id", instants.days_between(F.to_date("event_timestamp"), F.col("event_date")).alias("days"),
        instants.elapsed_days(F.col("event_timestamp"), now()).alias("elapsed"))


@query("logarithms", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(log2(l_quantity), 6) AS log2_quantity,
           round(ln(1 + l_quantity), 6) AS log1p_quantity FROM lineitem""")
def _(t: Tables):
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(F.log2("l_quantity")).alias("log2_quantity"),
        r6(F.log1p("l_quantity")).alias("log1p_quantity"))


@query("expiry", """
    SELECT o_orderkey, strftime(o_orderdate + INTERVAL 14 DAY, '%Y-%m-%d %H:%M:%S.%f') AS cache_until,
           strftime(o_orderdate + INTERVAL 365 DAY, '%Y-%m-%d %H:%M:%S.%f') AS plan_until FROM orders""")
def _(t: Tables):
    stamp = F.col("o_orderdate").cast("timestamp")
    return t.read("orders").select("o_orderkey", ts_text(instants.expiry(stamp, 14)).alias("cache_until"),
                                   ts_text(instants.expiry(stamp, 365)).alias("plan_until"))


@query("round_key", """
    SELECT place_id, round_even(latitude / 3, 3) AS lat_key, round_even(longitude / 3, 4) AS lng_key FROM places""")
def _(t: Tables):
    return t.places().select("place_id", geo.round_key(F.col("latitude") / 3, 3).alias("lat_key"),
                             geo.round_key(F.col("longitude") / 3, 4).alias("lng_key"))


@query("place_type", """
    SELECT place_id, CASE WHEN list_contains(types, 'hotel') THEN 'hotel' WHEN list_contains(types, 'motel') THEN 'motel'
        WHEN list_contains(types, 'hostel') THEN 'hostel' ELSE 'alojamiento' END AS kind FROM places""")
def _(t: Tables):
    return t.places().select("place_id", lookups.place_type(F.col("types")).alias("kind"))


@query("describe_event", """
    SELECT id, CASE WHEN sentence = '' THEN 'Discover ' || name || ' and plan your night out.' ELSE sentence END AS description
    FROM (SELECT id, name, concat_ws(' ',
            CASE WHEN artist_name IS NOT NULL THEN 'Join ' || artist_name || ' for an unforgettable live experience.' END,
            CASE WHEN big <> '' THEN 'Genre: ' || big || '.' END,
            CASE WHEN segment IS NOT NULL THEN 'Category: ' || segment || '.' END,
            CASE WHEN place <> '' THEN 'Taking place at ' || place || '.' END) AS sentence
          FROM (SELECT *, concat_ws(' / ', CASE WHEN genre <> 'Undefined' THEN genre END,
                                    CASE WHEN shown THEN subgenre END) AS big,
                       concat_ws(', ', CASE WHEN shown THEN venue_name END, CASE WHEN shown THEN address END,
                                 CASE WHEN shown THEN city END) AS place
                FROM (SELECT * REPLACE (CASE WHEN CAST(id AS BIGINT) % 4 <> 0 THEN artist_name END AS artist_name,
                                        CASE WHEN CAST(id AS BIGINT) % 4 <> 0 THEN genre END AS genre,
                                        CASE WHEN CAST(id AS BIGINT) % 4 <> 0 THEN segment END AS segment),
                             CAST(id AS BIGINT) % 4 <> 0 AS shown FROM catalog)))""")
def _(t: Tables):
    shown = F.col("id").cast("bigint") % 4 != 0
    part = lambda name: F.when(shown, F.col(name))
    return t.catalog().select("id", text.describe_event(
        F.col("name"), part("artist_name"), part("segment"), part("genre"), part("subgenre"), part("venue_name"),
        part("address"), part("city")).alias("description"))


@query("title_from_text", "SELECT conv_id, turn, left(text, 60) AS title FROM conversations")
def _(t: Tables):
    return t.read("conversations").select("conv_id", "turn", text.title_from_text(F.col("text")).alias("title"))


@query("cache_id", "SELECT id, replace(url, '/', '_') AS cache_id FROM catalog")
def _(t: Tables):
    return t.catalog().select("id", text.cache_id(F.col("url")).alias("cache_id"))


@query("iso_date_or_null", """
    SELECT id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN event_date END AS date FROM catalog""")
def _(t: Tables):
    key = F.col("id").cast("bigint")
    written = (F.when(key % 3 == 0, F.col("event_date")).when(key % 3 == 1, F.replace("event_date", F.lit("-"), F.lit("/")))
               .otherwise("2024-02-31"))
    return t.catalog().select("id", instants.iso_date_or_null(written).cast("string").alias("date"))


@query("month_grid", """
    SELECT CAST(month_start AS VARCHAR) AS month_start, CAST(cell AS INTEGER) AS cell,
           CASE WHEN date_trunc('month', monday + cell) = month_start THEN CAST(CAST(monday + cell AS DATE) AS VARCHAR) END AS day
    FROM (SELECT month_start, monday, CAST(unnest(range(0, CAST(7 * ceil((last_day(month_start) - monday + 1) / 7.0) AS INTEGER))) AS INTEGER) AS cell
          FROM (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS month_start,
                       CAST(date_trunc('week', date_trunc('month', l_shipdate)) AS DATE) AS monday FROM lineitem))""")
def _(t: Tables):
    grid = instants.month_grid(t.read("lineitem"), "l_shipdate")
    return grid.select(F.col("month_start").cast("string").alias("month_start"), "cell", F.col("day").cast("string").alias("day"))


#: The fixed part of the request: allowed answers and the map, from the tables of fixed values.
PROMPT_TAIL = "\n".join([
    "Answer with one JSON object:", "* minutes_ahead: whole number, 15 to 120", "* reason: one short sentence in Spanish",
    "* mood: one of " + ", ".join(lookups.MOODS), "* occasion_tags: 1 to 3 of " + ", ".join(lookups.OCCASIONS),
    "* price_band: one of " + ", ".join(lookups.PRICE_BANDS), "* setting: one of " + ", ".join(lookups.SETTINGS),
    "* time_slot: one of " + ", ".join(lookups.TIME_SLOTS),
    "* romantic_score, family_score, group_score, tourist_score: whole numbers, 0 to 100", "* duration_minutes: typical length in minutes",
    "* plan_pairings: 1 to 3 snake_case labels", "* category: one of " + ", ".join(lookups.SUBCATEGORIES),
    "* subcategory: one listed under the chosen category", "Subcategories by category:",
    *[f"* {category}: {', '.join(words)}" for category, words in lookups.SUBCATEGORIES.items()]]).replace("'", "''")


@query("enrichment_prompt", f"""
    SELECT id, concat_ws(chr(10), 'Classify this event using only these fields:', '* name: ' || coalesce(name, 'unknown'), '* description: unknown',
        '* segment: ' || coalesce(segment, 'unknown'), '* genre: ' || coalesce(genre, 'unknown'), '* subgenre: ' || coalesce(subgenre, 'unknown'),
        '* venue: ' || coalesce(venue_name, 'unknown'), '* time: ' || coalesce(event_time, 'unknown'), '{PROMPT_TAIL}') AS prompt FROM catalog""")
def _(t: Tables):
    return t.catalog().select("id", lookups.enrichment_prompt(
        F.col("name"), F.lit(None).cast("string"), F.col("segment"), F.col("genre"), F.col("subgenre"),
        F.col("venue_name"), F.col("event_time")).alias("prompt"))


CATEGORY_ROWS = ", ".join(
    f"('{category}', '{word}')" for category, words in lookups.SUBCATEGORIES.items() for word in words)
CATEGORIES = list(lookups.SUBCATEGORIES)
SUBWORDS = sorted({word for words in lookups.SUBCATEGORIES.values() for word in words})


def _picked(words: list[str], key: str, prime: int) -> str:
    return f"list_extract([{', '.join(repr(w) for w in words)}], CAST({key} * {prime} % {len(words)} + 1 AS INTEGER))"


@query("category_map", f"""
    SELECT p_partkey, (category, subcategory) IN (VALUES {CATEGORY_ROWS}) AS allowed
    FROM (SELECT p_partkey, {_picked(CATEGORIES, 'p_partkey', 1)} AS category,
                 {_picked(SUBWORDS, 'p_partkey', 7)} AS subcategory FROM part)""")
def _(t: Tables):
    key = F.col("p_partkey")
    pick = lambda words, prime: F.get(
        F.array(*[F.lit(w) for w in words]), (key * prime % len(words)).cast("int"))
    pairs = t.read("part").select("p_partkey", pick(CATEGORIES, 1).alias("category"), pick(SUBWORDS, 7).alias("subcategory"))
    return pairs.select("p_partkey", lookups.subcategory_allowed(F.col("category"), F.col("subcategory")).alias("allowed"))


@query("first_or_null", """
    SELECT place_id, CASE WHEN CAST(place_id AS BIGINT) % 3 = 0 THEN types[1] END AS first FROM places""")
def _(t: Tables):
    key = F.col("place_id").cast("bigint")
    items = F.when(key % 3 == 0, F.col("types")).when(key % 3 == 1, F.array().cast("array<string>"))
    return t.places().select("place_id", values.first_or_null(items).alias("first"))
