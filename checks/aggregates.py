"""Aggregations: user features, cleaning counters and catalogue groups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.base import Tables, query, r6
from checks.projections import DIRTY, GROUPS, dirty
from marquee.operators import catalog, features, lifecycle, marts
from marquee.plans.user_segments import prepared_features

# p_type has these six values in the test tables; contexts are three by construction.
SEGMENTS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
CONTEXTS = ["discover", "map", "planner"]


def rounded(df, keys=("user_id",)):
    """Doubles to six places."""
    return df.select(*[r6(name).alias(name) if kind == "double" and name not in keys else F.col(name)
                       for name, kind in df.dtypes])


@query("user_activity", """
    SELECT user_id, count(*) AS total_swipes, round(avg(CASE WHEN liked THEN 1.0::DOUBLE ELSE 0 END), 6) AS right_swipe_rate,
           round(avg(CASE WHEN liked THEN 0.0::DOUBLE ELSE 1 END), 6) AS left_swipe_rate,
           count(DISTINCT session_id) AS sessions_count, count(DISTINCT event_id) AS events_seen
    FROM clean GROUP BY user_id""")
def _(t: Tables):
    return rounded(features.user_activity(t.clean()))


@query("liked_diversity", """
    SELECT user_id, count(DISTINCT CASE WHEN liked THEN segment END) AS distinct_segments_liked,
           count(DISTINCT CASE WHEN liked THEN genre END) AS distinct_genres_liked,
           count(DISTINCT CASE WHEN liked THEN city END) AS distinct_cities_liked
    FROM clean GROUP BY user_id""")
def _(t: Tables):
    return features.liked_diversity(t.clean())


@query("price_lead_means", """
    SELECT user_id, round(avg(avg_price) FILTER (WHERE liked), 6) AS avg_liked_price,
           round(avg(avg_price) FILTER (WHERE NOT liked), 6) AS avg_disliked_price,
           round(avg(days_until_event) FILTER (WHERE liked), 6) AS avg_days_until_event_liked,
           round(avg(days_until_event) FILTER (WHERE NOT liked), 6) AS avg_days_until_event_disliked
    FROM clean GROUP BY user_id""")
def _(t: Tables):
    return rounded(features.price_lead_means(t.clean()))


def entropy_sql(value: str, condition: str) -> str:
    """Textbook form: minus the sum of p log2 p."""
    return f"""
    SELECT user_id, coalesce(e, 0.0)::DOUBLE AS entropy FROM (SELECT DISTINCT user_id FROM clean) LEFT JOIN (
        SELECT user_id, -sum(p * log2(p)) AS e FROM (
            SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM (
                SELECT user_id, {value}, count(*)::DOUBLE AS n FROM clean
                WHERE {value} IS NOT NULL AND {condition} GROUP BY user_id, {value}))
        GROUP BY user_id) USING (user_id)"""


@query("entropy", f"SELECT user_id, round(entropy, 6) + 0.0 AS entropy FROM ({entropy_sql('genre', 'TRUE')})")
def _(t: Tables):
    return rounded(features.entropy(t.clean(), ["user_id"], "genre"))


@query("entropy_liked_city", f"SELECT user_id, round(entropy, 6) + 0.0 AS entropy FROM ({entropy_sql('city', 'liked')})")
def _(t: Tables):
    return rounded(features.entropy(t.clean(), ["user_id"], "city", F.col("liked")))


RECENCY = """
    SELECT user_id,
           floor((epoch_us((SELECT max(event_timestamp) FROM clean)) - epoch_us(max(event_timestamp))) / 86400e6) AS recency_days,
           floor((epoch_us(max(event_timestamp)) - epoch_us(min(event_timestamp))) / 86400e6) AS activity_span_days
    FROM clean GROUP BY user_id"""


@query("recency_span", RECENCY)
def _(t: Tables):
    return features.recency_span(t.clean())


def affinity_columns() -> str:
    parts = []
    for word in SEGMENTS:
        slug = word.lower()
        parts.append(f"coalesce(avg(liked::INTEGER) FILTER (WHERE segment = '{word}'), 0) AS {slug}_like_rate")
        parts.append(f"avg(CASE WHEN segment = '{word}' THEN 1.0::DOUBLE ELSE 0 END) AS {slug}_swipe_share")
    return ", ".join(parts)


def context_columns() -> str:
    return ", ".join(f"avg(CASE WHEN recommendation_context = '{word}' THEN 1.0::DOUBLE ELSE 0 END) AS {word}_share"
                     for word in CONTEXTS)


AFFINITY_NAMES = [f"{word.lower()}_{part}" for word in SEGMENTS for part in ("like_rate", "swipe_share")]
SHARE_NAMES = [f"{word}_share" for word in CONTEXTS]


def rounded_sql(names: list[str]) -> str:
    return ", ".join(f"round({name}, 6) + 0.0 AS {name}" for name in names)


@query("segment_affinity", f"""
    SELECT user_id, {rounded_sql(AFFINITY_NAMES)} FROM (SELECT user_id, {affinity_columns()} FROM clean GROUP BY user_id)""")
def _(t: Tables):
    return rounded(features.segment_affinity(t.clean()))


@query("context_share", f"""
    SELECT user_id, {rounded_sql(SHARE_NAMES)} FROM (SELECT user_id, {context_columns()} FROM clean GROUP BY user_id)""")
def _(t: Tables):
    return rounded(features.context_share(t.clean()))


FEATURES = f"""
    SELECT * FROM (
        SELECT user_id, count(*) AS total_swipes, avg(liked::INTEGER) AS right_swipe_rate,
               avg((NOT liked)::INTEGER) AS left_swipe_rate,
               count(DISTINCT segment) FILTER (WHERE liked) AS distinct_segments_liked,
               count(DISTINCT genre) FILTER (WHERE liked) AS distinct_genres_liked,
               count(DISTINCT city) FILTER (WHERE liked) AS distinct_cities_liked,
               avg(avg_price) FILTER (WHERE liked) AS avg_liked_price,
               avg(avg_price) FILTER (WHERE NOT liked) AS avg_disliked_price,
               avg(days_until_event) FILTER (WHERE liked) AS avg_days_until_event_liked,
               avg(days_until_event) FILTER (WHERE NOT liked) AS avg_days_until_event_disliked,
               count(DISTINCT session_id) AS sessions_count, count(DISTINCT event_id) AS events_seen,
               {affinity_columns()}, {context_columns()}
        FROM clean GROUP BY user_id)
    JOIN (SELECT user_id, entropy AS genre_entropy_all FROM ({entropy_sql('genre', 'TRUE')})) USING (user_id)
    JOIN (SELECT user_id, entropy AS genre_entropy_liked FROM ({entropy_sql('genre', 'liked')})) USING (user_id)
    JOIN (SELECT user_id, entropy AS city_entropy_liked FROM ({entropy_sql('city', 'liked')})) USING (user_id)
    JOIN ({RECENCY}) USING (user_id)"""
ALL_NAMES = [*features.FIXED_FEATURES, *AFFINITY_NAMES, *SHARE_NAMES]
COUNTS = features.COUNT_FEATURES
RATES = [name for name in ALL_NAMES if name not in COUNTS]
AVERAGES = [name for name in ALL_NAMES if name.startswith("avg_")]
FILLED = ", ".join(f"coalesce({name}, (SELECT median({name}) FROM f)) AS {name}" for name in AVERAGES)


@query("user_features", f"SELECT user_id, {', '.join(COUNTS)}, {rounded_sql(RATES)} FROM ({FEATURES})")
def _(t: Tables):
    return rounded(features.user_features(t.clean()))


def thinned(t: Tables):
    """Features with some averages taken away, so that there is something to fill."""
    gone = F.col("user_id").cast("bigint") % 3 == 0
    return features.user_features(t.clean()).withColumns(
        {name: F.when(~gone, F.col(name)) for name in AVERAGES})


THINNED = f"""SELECT * REPLACE ({', '.join(
    f"CASE WHEN CAST(user_id AS BIGINT) % 3 <> 0 THEN {name} END AS {name}" for name in AVERAGES)}) FROM ({FEATURES})"""


@query("impute_features", f"""
    WITH f AS ({THINNED}) SELECT user_id, {', '.join(COUNTS)}, {rounded_sql(RATES)} FROM (SELECT * REPLACE ({FILLED}) FROM f)""")
def _(t: Tables):
    return rounded(features.impute_features(thinned(t)))


LOGGED = ", ".join(f"round(ln(1 + {name}), 6) AS {name}" for name in COUNTS)


@query("log_counts", f"SELECT user_id, {LOGGED}, {rounded_sql(RATES)} FROM ({FEATURES})")
def _(t: Tables):
    return rounded(features.log_counts(features.user_features(t.clean())))


@query("prepared_features", f"""
    WITH f AS ({FEATURES}) SELECT user_id, {LOGGED}, {rounded_sql(RATES)} FROM (SELECT * REPLACE ({FILLED}) FROM f)""")
def _(t: Tables):
    return rounded(prepared_features(t.clean()))


@query("cleaning_report", f"""
    WITH d AS (SELECT *, price_min IS NOT NULL AND price_max IS NOT NULL AND event_date IS NOT NULL
                         AND fixed IS NOT NULL AS complete, lower(interaction_type) = 'swipe' AS swipe
               FROM (SELECT *, CASE swipe_direction WHEN 'right' THEN TRUE WHEN 'left' THEN FALSE ELSE liked END AS fixed
                     FROM ({DIRTY})))
    SELECT 2 * count(*)::BIGINT AS input_rows, count(*) AS rows_after_dedup,
           count(*) FILTER (WHERE (swipe_direction = 'right' AND liked IS DISTINCT FROM TRUE)
                               OR (swipe_direction = 'left' AND liked IS DISTINCT FROM FALSE)) AS direction_liked_mismatches,
           count(*) FILTER (WHERE swipe) AS rows_after_interaction_filter,
           count(*) FILTER (WHERE swipe AND price_max < price_min) AS price_swaps,
           count(*) FILTER (WHERE swipe AND NOT complete) AS rows_dropped_invalid,
           count(*) FILTER (WHERE swipe AND complete) AS clean_rows,
           count(DISTINCT user_id) FILTER (WHERE swipe AND complete) AS unique_users
    FROM d""")
def _(t: Tables):
    rows = dirty(t)
    return features.cleaning_report(rows.unionByName(rows))


@query("dedupe_first", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def _(t: Tables):
    return features.dedupe_first(t.read("orders"), "o_custkey", [F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("list_categories", "SELECT DISTINCT segment FROM catalog WHERE segment <> '' AND latitude BETWEEN 37 AND 39 AND longitude BETWEEN -9 AND 3")
def _(t: Tables):
    return catalog.list_categories(t.catalog(), bbox=(37.0, 39.0, -9.0, 3.0))


@query("group_occurrences", GROUPS)
def _(t: Tables):
    groups = catalog.group_occurrences(catalog.mappable_events(t.catalog()))
    return groups.select("group_key", F.col("primary.id").alias("primary_id"), "primary.latitude", "primary.longitude",
                         "n_occurrences")


@query("build_schedule", """
    SELECT group_key, event_date AS date, event_time AS time, arg_min(coalesce(url, ''), sort_instant || ' ' || id) AS url
    FROM (SELECT *, row_number() OVER (PARTITION BY group_key, event_date, event_time ORDER BY sort_instant, id) AS n,
                 count(event_time) OVER (PARTITION BY group_key, event_date) AS timed FROM keyed)
    WHERE event_time IS NOT NULL OR timed = 0 GROUP BY 1, 2, 3""")
def _(t: Tables):
    # A timeless row stands for an empty date and has no URL; the SQL shows its first occurrence's, so blank both.
    timeless = F.col("time").isNull()
    schedule = catalog.build_schedule(t.catalog())
    first = catalog.with_group_key(t.catalog()).filter("event_time IS NULL").groupBy("group_key", F.col("event_date").alias("date")).agg(
        F.min(F.struct("sort_instant", "id", "url"))["url"].alias("_url"))
    shown = schedule.join(first, ["group_key", "date"], "left")
    return shown.select("group_key", "date", "time", F.coalesce(F.when(timeless, F.col("_url")).otherwise(F.col("url")),
                                                                F.lit("")).alias("url"))


AS_OF = [dt.date(2024, 1, 16), dt.date(2024, 1, 31)]


@query("rolling_user_features", """
    WITH r AS (SELECT c.*, a.as_of, 'NATION_' || (CAST(user_id AS BIGINT) % 25) = coalesce(city, '') AS local
               FROM clean c JOIN (VALUES (DATE '2024-01-16'), (DATE '2024-01-31')) a(as_of)
                 ON CAST(event_timestamp AS DATE) < as_of AND CAST(event_timestamp AS DATE) >= as_of - 10),
    top AS (SELECT as_of, user_id, avg(liked::INTEGER) AS rate, count(*) AS n, genre FROM r WHERE genre IS NOT NULL
            GROUP BY as_of, user_id, genre QUALIFY row_number() OVER (PARTITION BY as_of, user_id ORDER BY count(*) DESC, genre) = 1)
    SELECT CAST(as_of AS VARCHAR) AS as_of, user_id, count(*) AS total_swipes, round(avg(liked::INTEGER), 6) AS right_swipe_rate,
           round(avg((NOT liked)::INTEGER), 6) AS left_swipe_rate,
           count(DISTINCT segment) FILTER (WHERE liked) AS distinct_segments_liked,
           count(DISTINCT city) FILTER (WHERE liked) AS distinct_cities_liked,
           round(avg(avg_price) FILTER (WHERE liked), 6) AS avg_liked_price,
           round(avg(avg_price) FILTER (WHERE NOT liked), 6) AS avg_disliked_price,
           round(coalesce(avg(liked::INTEGER) FILTER (WHERE local), 0), 6) AS same_city_like_rate,
           round(avg(days_until_event) FILTER (WHERE liked), 6) AS days_until_event_avg_liked,
           round(coalesce(any_value(top.rate), 0), 6) AS top_genre_like_rate,
           CAST(as_of - max(CAST(event_timestamp AS DATE)) FILTER (WHERE liked) AS INTEGER) AS days_since_last_right_swipe
    FROM r LEFT JOIN top USING (as_of, user_id) GROUP BY as_of, user_id""")
def _(t: Tables):
    home = F.concat(F.lit("NATION_"), (F.col("user_id").cast("bigint") % 25).cast("string"))
    rows = rounded(features.rolling_user_features(t.clean().withColumn("home_city", home), AS_OF, 10))
    return rows.withColumn("as_of", F.col("as_of").cast("string"))


@query("daily_user_aggregate", """
    SELECT user_id, CAST(CAST(event_timestamp AS DATE) AS VARCHAR) AS day, count(*) AS swipes, count(*) FILTER (WHERE liked) AS likes,
           count(*) FILTER (WHERE NOT liked) AS dislikes, count(DISTINCT session_id) AS sessions,
           count(DISTINCT event_id) AS events_seen, round(sum(avg_price) FILTER (WHERE liked), 6) AS liked_price_sum,
           round(sum(avg_price) FILTER (WHERE NOT liked), 6) AS disliked_price_sum
    FROM clean GROUP BY user_id, CAST(event_timestamp AS DATE)""")
def _(t: Tables):
    return rounded(features.daily_user_aggregate(t.clean())).withColumn("day", F.col("day").cast("string"))


@query("plan_titles", """
    SELECT conv_id AS plan_id, left(arg_min(text, turn) FILTER (WHERE role = 'user'), 60) AS title, count(*) AS n_messages
    FROM conversations GROUP BY conv_id""")
def _(t: Tables):
    return lifecycle.plan_titles(t.turns())


@query("plan_transcripts", """
    SELECT conv_id AS plan_id, turn // 3 AS page, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript
    FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1, 2""")
def _(t: Tables):
    doubled = t.turns().unionByName(t.turns())
    line = lambda m: F.concat(m["role"], F.lit(": "), m["content"])
    return lifecycle.plan_transcripts(doubled, page=3).select(
        "plan_id", "page", F.array_join(F.transform("messages", line), "\n").alias("transcript"))


@query("append_batches", """
    SELECT id, segment, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN city END AS city FROM catalog""")
def _(t: Tables):
    even = F.col("id").cast("bigint") % 2 == 0
    first = t.catalog().filter(~even).select("id", "segment")
    return marts.append_batches(first, t.catalog().filter(even).select("city", "id", "segment"))
