"""Registry of queries, and the test tables' stand-ins for catalogue, messages, users and plans.

The stand-ins are defined twice: as DataFrames (`Tables`) and as SQL (`CTES`), following FIXTURES.md.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import features
from marquee.operators.marts import latest_interactions
from marquee.operators.staging import stage_interactions, valid_messages
from marquee.plans.interaction_fact import build_fact
from marquee.scale import shared_folder

NOW = "2024-01-31 00:00:00"
EMBEDDING = [f"e{i}" for i in range(64)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a function of `Tables` under a name, with the SQL that must give the same rows."""
    def register(build: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = with_ctes(oracle)
        return build

    return register


def ts_text(value: Column | str) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def r6(value: Column | str) -> Column:
    """Rounded to six places, with minus zero as zero."""
    return F.round(F.col(value) if isinstance(value, str) else value, 6) + F.lit(0.0)


def scratch(spark: SparkSession) -> str:
    """A new folder for files that a query writes and reads back."""
    return shared_folder(spark)


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._frames: dict[str, DataFrame] = {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def read(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
        return self._frames[name]

    # Messages

    def payloads(self, events: DataFrame | None = None) -> DataFrame:
        """Interaction payloads as the client sends them, with the row's `ts` and `k`."""
        rows = (self.read("events") if events is None else events).withColumn(
            "k", F.get_json_object("props", "$.k").cast("int"))
        kind = F.col("event_type")
        return rows.select(
            F.col("event_id").cast("string").alias("message_id"),
            F.col("ts").cast("timestamp").alias("ts"), "k",
            F.col("user_id").cast("string").alias("user_id"),
            F.col("k").cast("string").alias("event_id"),
            F.when(kind.isin("click", "purchase", "signup"), "right").when(kind == "view", "left").alias("direction"),
            F.col("ts").cast("timestamp").alias("swiped_at"),
            F.floor(F.col("value") * 10).cast("bigint").alias("dwell_ms"),
            F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("session_id"),
            F.element_at(F.array(F.lit("discover"), F.lit("map"), F.lit("planner")), F.col("k") % 3 + 1)
            .alias("recommendation_context"),
            F.when(F.col("k") % 11 == 0, "view_card").when(F.col("k") % 7 != 0, "swipe").alias("interaction_type"),
        )

    def raw(self, events: DataFrame | None = None) -> DataFrame:
        """Envelopes; messages with k < 5 are delivered twice, an hour apart."""
        rows = self.payloads(events)
        swiped = F.date_format("swiped_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        body = F.to_json(F.struct(
            "event_id", "user_id", "direction", swiped.alias("swiped_at"), "dwell_ms", "session_id",
            "recommendation_context", "interaction_type"))
        delays = F.when(F.col("k") < 5, F.array(F.lit(1), F.lit(3600))).otherwise(F.array(F.lit(1)))
        return rows.withColumn("data", body).withColumn("delay", F.explode(delays)).select(
            F.lit("interactions").alias("subscription_name"),
            "message_id",
            (F.col("ts") + F.make_dt_interval(secs=F.col("delay"))).alias("publish_time"),
            "data",
            F.to_json(F.create_map(F.lit("event_type"), F.lit("swipe"), F.lit("user_id"), F.col("user_id")))
            .alias("attributes"))

    def staged(self) -> DataFrame:
        return valid_messages(stage_interactions(self.raw()))

    def latest(self) -> DataFrame:
        return latest_interactions(self.staged())

    def fact(self) -> DataFrame:
        return build_fact(self.raw(), self.catalog())

    def clean(self) -> DataFrame:
        """Cleaned interactions. The fact is unique already, so the first step has nothing to do."""
        repaired = features.repair_price_order(features.only_swipes(features.repair_liked(self.fact())))
        return features.derive_interaction(features.drop_incomplete(repaired))

    # Catalogue

    def catalog(self) -> DataFrame:
        key = F.col("p_partkey")
        part = self.read("part").withColumns({
            "c_city": (key % 25).cast("int"), "c_venue": key % self.n_venues()})
        nation = self.read("nation").select(F.col("n_nationkey").alias("c_city"), "n_name")
        venue = self.read("supplier").select(
            F.col("s_suppkey").alias("c_venue"), "s_name",
            (F.lit(36.0) + (F.col("s_suppkey") * 37 % 700) / F.lit(100.0)).alias("v_lat"),
            (F.lit(-9.0) + (F.col("s_suppkey") * 53 % 1200) / F.lit(100.0)).alias("v_lng"))
        rows = part.join(nation, "c_city").join(venue, "c_venue")
        date = F.date_add(F.lit("2024-02-01").cast("date"), F.col("p_size"))
        time = F.when(key % 13 != 0, F.format_string("%02d:30", (key % 24).cast("int")))
        missing = key % 23 == 0
        return rows.select(
            key.cast("string").alias("id"),
            F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"),
            F.when(key % 19 != 0, F.concat(F.lit("https://tickets.example/"), key.cast("string"))).alias("url"),
            F.when(key % 17 == 0, True).when(key % 17 != 1, False).alias("is_test"),
            date.cast("string").alias("event_date"),
            time.alias("event_time"),
            F.try_to_timestamp(F.concat(date.cast("string"), F.lit(" "), time, F.lit(":00"))).alias("starts_at"),
            F.when(key % 5 == 0, "cancelled").otherwise("onsale").alias("status"),
            F.when(key % 29 != 0, F.col("p_type")).alias("segment"),
            F.when(key % 43 == 1, "Undefined").when(key % 31 != 0, F.col("p_brand")).alias("genre"),
            F.col("p_name").alias("subgenre"),
            F.col("c_venue").cast("string").alias("venue_id"),
            F.col("s_name").alias("venue_name"),
            F.when(key % 37 != 0, F.col("n_name")).alias("city"),
            F.concat(F.lit("Street "), (key % 50).cast("string")).alias("address"),
            F.when(~missing, F.col("v_lat")).alias("latitude"),
            F.when(~missing, F.col("v_lng")).alias("longitude"),
            F.when(key % 6 != 0, F.concat(F.lit("Artist "), (key % 40).cast("string"))).alias("artist_name"),
            F.when(key % 41 != 0, F.col("p_retailprice")).alias("price_min"),
            F.when(F.col("p_size") > 40, F.col("p_retailprice") - F.col("p_size"))
            .otherwise(F.col("p_retailprice") + F.col("p_size")).alias("price_max"),
        )

    def n_venues(self) -> Column:
        """Events and places are spread over all suppliers."""
        return self.read("supplier").agg(F.count("*")).scalar()

    def venues(self) -> DataFrame:
        return self.read("supplier").select(
            F.col("s_suppkey").cast("string").alias("venue_id"), F.col("s_name").alias("venue_name"),
            (F.lit(36.0) + (F.col("s_suppkey") * 37 % 700) / F.lit(100.0)).alias("latitude"),
            (F.lit(-9.0) + (F.col("s_suppkey") * 53 % 1200) / F.lit(100.0)).alias("longitude"))

    def places(self) -> DataFrame:
        key = F.col("c_custkey")
        base = key % self.n_venues()
        word = F.col("c_mktsegment")
        kinds = (F.when(word.isin("BUILDING", "FURNITURE"), F.array(F.lit("restaurant"), F.lit("bar")))
                 .when(word == "HOUSEHOLD", F.array(F.lit("lodging"), F.lit("hostel"), F.lit("hotel")))
                 .when(word == "MACHINERY", F.array(F.lit("lodging")))
                 .otherwise(F.array(F.lit("motel"), F.lit("spa"))))
        return self.read("customer").select(
            key.cast("string").alias("place_id"), F.col("c_name").alias("place_name"),
            (F.lit(36.0) + (base * 37 % 700) / F.lit(100.0) + (key * 7 % 101 - 50) / F.lit(1000.0)).alias("latitude"),
            (F.lit(-9.0) + (base * 53 % 1200) / F.lit(100.0) + (key * 11 % 103 - 51) / F.lit(1000.0)).alias("longitude"),
            kinds.alias("types"), word.alias("kind_word"))

    # Users, saved events, plans

    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        cities = F.array(*[F.lit(c) for c in ("Madrid", "Málaga", " BARCELONA ", "Bilbao", "Atlantis")], F.lit(None))
        stored = key % 5 == 0
        return self.read("customer").select(
            key.cast("string").alias("id"),
            F.when(key % 4 != 0, F.concat(F.lit("uid-"), key.cast("string"))).alias("auth_uid"),
            F.concat(F.lit("user"), key.cast("string"), F.lit("@mail.example")).alias("email"),
            F.concat(F.lit("user"), key.cast("string")).alias("username"),
            F.when(key % 7 != 0, F.col("c_name")).alias("full_name"),
            F.when(key % 3 != 0, F.concat(F.lit("https://img.example/"), key.cast("string"))).alias("avatar_url"),
            F.lit(True).alias("is_active"),
            (key % 2 == 0).alias("is_verified"),
            F.get(cities, (key % 6).cast("int")).alias("preferred_location"),
            F.when(stored, F.lit(40.0) + key / F.lit(1000.0)).alias("preferred_location_lat"),
            F.when(stored, F.lit(-3.0) - key / F.lit(1000.0)).alias("preferred_location_lng"),
            F.when(key % 8 == 0, F.array().cast("array<string>"))
            .when(key % 9 != 0, F.array("c_mktsegment")).alias("preferred_categories"),
        )

    def saved(self) -> DataFrame:
        return self.read("orders").groupBy(
            F.col("o_custkey").cast("string").alias("user_id"), (F.col("o_orderkey") % 100).cast("string").alias("event_id")
        ).agg(F.min("o_orderdate").cast("timestamp").alias("created_at"))

    def save_requests(self) -> DataFrame:
        """Requests to save, in order: every order asks for event key % 120, so there are repeats."""
        return self.read("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("user_id"),
            (F.col("o_orderkey") * 7 % 120).cast("string").alias("event_id"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"))

    def turns(self) -> DataFrame:
        return self.read("conversations").select(
            F.col("conv_id").alias("plan_id"), "turn", "role", F.col("text").alias("content"))

    def plan_headers(self) -> DataFrame:
        """One row per plan with its owner and times."""
        return self.read("conversations").groupBy(F.col("conv_id").alias("plan_id")).agg(
            F.count("*").alias("n_turns")).select(
            "plan_id", (F.col("plan_id") % 20).cast("string").alias("user_id"),
            F.when(F.col("plan_id") % 3 != 0, F.concat(F.lit("Plan "), F.col("plan_id").cast("string"))).alias("title"),
            F.lit("2024-01-01T00:00:00").alias("created_at"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("plan_id") * 13 % 37).cast("int")).cast("string")
            .alias("updated_at"))

    # Feature matrix

    def embeddings(self) -> DataFrame:
        return self.read("embeddings").select(
            "vec_id", "label", *[F.col("embedding")[i].cast("double").alias(name) for i, name in enumerate(EMBEDDING)])


def _embedding_columns() -> str:
    return ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {name}" for i, name in enumerate(EMBEDDING))


CTES = {
    "payloads": """
        SELECT CAST(event_id AS VARCHAR) AS message_id, ts, k, CAST(user_id AS VARCHAR) AS user_id,
               CAST(k AS VARCHAR) AS event_id,
               CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 'right'
                    WHEN event_type = 'view' THEN 'left' END AS direction,
               CAST(floor(value * 10) AS BIGINT) AS dwell_ms,
               CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id,
               CASE k % 3 WHEN 0 THEN 'discover' WHEN 1 THEN 'map' ELSE 'planner' END AS recommendation_context,
               CASE WHEN k % 11 = 0 THEN 'view_card' WHEN k % 7 <> 0 THEN 'swipe' END AS interaction_type
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "raw": """
        SELECT p.*, p.ts + d.delay AS publish_time FROM payloads p
        JOIN (SELECT 0 AS again, INTERVAL 1 SECOND AS delay UNION ALL SELECT 1, INTERVAL 1 HOUR) d
          ON d.again = 0 OR p.k < 5""",
    "staged": """
        SELECT message_id AS interaction_id, ts AS event_timestamp, user_id, session_id, event_id,
               coalesce(interaction_type, 'swipe') AS interaction_type, direction AS swipe_direction,
               direction = 'right' AS liked, recommendation_context, publish_time AS ingestion_timestamp
        FROM raw WHERE direction IS NOT NULL""",
    "latest": """
        SELECT * FROM staged
        QUALIFY row_number() OVER (PARTITION BY interaction_id ORDER BY ingestion_timestamp DESC) = 1""",
    "catalog": """
        SELECT CAST(p_partkey AS VARCHAR) AS id, split_part(p_name, ' ', 1) AS name,
               CASE WHEN p_partkey % 19 <> 0 THEN 'https://tickets.example/' || p_partkey END AS url,
               CASE WHEN p_partkey % 17 = 0 THEN TRUE WHEN p_partkey % 17 <> 1 THEN FALSE END AS is_test,
               CAST(day AS VARCHAR) AS event_date, clock AS event_time,
               CAST(CAST(day AS VARCHAR) || ' ' || clock || ':00' AS TIMESTAMP) AS starts_at,
               CASE WHEN p_partkey % 5 = 0 THEN 'cancelled' ELSE 'onsale' END AS status,
               CASE WHEN p_partkey % 29 <> 0 THEN p_type END AS segment,
               CASE WHEN p_partkey % 43 = 1 THEN 'Undefined' WHEN p_partkey % 31 <> 0 THEN p_brand END AS genre,
               p_name AS subgenre, CAST(s_suppkey AS VARCHAR) AS venue_id, s_name AS venue_name,
               CASE WHEN p_partkey % 37 <> 0 THEN n_name END AS city,
               'Street ' || (p_partkey % 50) AS address,
               CASE WHEN p_partkey % 23 <> 0 THEN v_lat END AS latitude,
               CASE WHEN p_partkey % 23 <> 0 THEN v_lng END AS longitude,
               CASE WHEN p_partkey % 6 <> 0 THEN 'Artist ' || (p_partkey % 40) END AS artist_name,
               CASE WHEN p_partkey % 41 <> 0 THEN p_retailprice END AS price_min,
               CASE WHEN p_size > 40 THEN p_retailprice - p_size ELSE p_retailprice + p_size END AS price_max
        FROM (SELECT *, CAST(DATE '2024-02-01' + p_size AS DATE) AS day,
                     CASE WHEN p_partkey % 13 <> 0 THEN lpad(CAST(p_partkey % 24 AS VARCHAR), 2, '0') || ':30' END AS clock
              FROM part)
        JOIN nation ON n_nationkey = p_partkey % 25
        JOIN (SELECT s_suppkey, s_name, CAST(36 + (s_suppkey * 37 % 700) / 100.0 AS DOUBLE) AS v_lat,
                     CAST(-9 + (s_suppkey * 53 % 1200) / 100.0 AS DOUBLE) AS v_lng FROM supplier)
          ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier)""",
    "fact": """
        SELECT l.interaction_id, l.event_timestamp, l.user_id, l.session_id, l.event_id, l.interaction_type,
               l.swipe_direction, l.liked, l.recommendation_context, c.segment, c.genre, c.subgenre, c.city,
               c.price_min, c.price_max, CAST(c.event_date AS DATE) AS event_date, c.venue_id, l.ingestion_timestamp
        FROM latest l LEFT JOIN catalog c ON c.id = l.event_id""",
    "clean": """
        SELECT *, date_diff('day', CAST(event_timestamp AS DATE), event_date) AS days_until_event,
               (price_min + price_max) / 2 AS avg_price,
               CASE WHEN swipe_direction = 'right' THEN 1 ELSE 0 END AS is_right_swipe
        FROM (SELECT * REPLACE (CASE WHEN price_max < price_min THEN price_max ELSE price_min END AS price_min,
                                CASE WHEN price_max < price_min THEN price_min ELSE price_max END AS price_max)
              FROM fact)
        WHERE lower(interaction_type) = 'swipe' AND price_min IS NOT NULL AND price_max IS NOT NULL
          AND event_date IS NOT NULL""",
    "venues": """
        SELECT CAST(s_suppkey AS VARCHAR) AS venue_id, s_name AS venue_name,
               CAST(36 + (s_suppkey * 37 % 700) / 100.0 AS DOUBLE) AS latitude,
               CAST(-9 + (s_suppkey * 53 % 1200) / 100.0 AS DOUBLE) AS longitude FROM supplier""",
    "places": """
        SELECT CAST(c_custkey AS VARCHAR) AS place_id, c_name AS place_name,
               CAST(36 + (base * 37 % 700) / CAST(100 AS DOUBLE)
                    + (c_custkey * 7 % 101 - 50) / CAST(1000 AS DOUBLE) AS DOUBLE) AS latitude,
               CAST(-9 + (base * 53 % 1200) / CAST(100 AS DOUBLE)
                    + (c_custkey * 11 % 103 - 51) / CAST(1000 AS DOUBLE) AS DOUBLE) AS longitude,
               CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN ['restaurant', 'bar']
                    WHEN c_mktsegment = 'HOUSEHOLD' THEN ['lodging', 'hostel', 'hotel']
                    WHEN c_mktsegment = 'MACHINERY' THEN ['lodging'] ELSE ['motel', 'spa'] END AS types
        FROM (SELECT *, c_custkey % (SELECT count(*) FROM supplier) AS base FROM customer)""",
    "users": """
        SELECT CAST(c_custkey AS VARCHAR) AS id,
               CASE WHEN c_custkey % 4 <> 0 THEN 'uid-' || c_custkey END AS auth_uid,
               'user' || c_custkey || '@mail.example' AS email, 'user' || c_custkey AS username,
               CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS full_name,
               CASE WHEN c_custkey % 3 <> 0 THEN 'https://img.example/' || c_custkey END AS avatar_url,
               TRUE AS is_active, c_custkey % 2 = 0 AS is_verified,
               CASE c_custkey % 6 WHEN 0 THEN 'Madrid' WHEN 1 THEN 'Málaga' WHEN 2 THEN ' BARCELONA '
                    WHEN 3 THEN 'Bilbao' WHEN 4 THEN 'Atlantis' END AS preferred_location,
               CASE WHEN c_custkey % 5 = 0 THEN CAST(40 AS DOUBLE) + c_custkey / CAST(1000 AS DOUBLE) END
                 AS preferred_location_lat,
               CASE WHEN c_custkey % 5 = 0 THEN CAST(-3 AS DOUBLE) - c_custkey / CAST(1000 AS DOUBLE) END
                 AS preferred_location_lng,
               CASE WHEN c_custkey % 8 = 0 THEN 0 WHEN c_custkey % 9 <> 0 THEN 1 END AS n_categories
        FROM customer""",
    "saved": """
        SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderkey % 100 AS VARCHAR) AS event_id,
               min(o_orderdate) AS created_at FROM orders GROUP BY 1, 2""",
    "save_requests": """
        SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS user_id,
               CAST(o_orderkey * 7 % 120 AS VARCHAR) AS event_id, o_orderdate AS created_at FROM orders""",
    "plan_headers": """
        SELECT DISTINCT conv_id AS plan_id, CAST(conv_id % 20 AS VARCHAR) AS user_id,
               CASE WHEN conv_id % 3 <> 0 THEN 'Plan ' || conv_id END AS title,
               '2024-01-01T00:00:00' AS created_at,
               CAST(CAST(DATE '2024-01-01' + CAST(conv_id * 13 % 37 AS INTEGER) AS DATE) AS VARCHAR) AS updated_at
        FROM conversations""",
    "keyed": """
        SELECT *, lower(trim(coalesce(name, ''))) || '|' || lower(trim(coalesce(venue_name, ''))) || '|'
                  || lower(trim(coalesce(city, ''))) AS group_key,
               coalesce(strftime(starts_at, '%Y-%m-%d %H:%M:%S'),
                        coalesce(event_date, '') || ' ' || coalesce(event_time, '')) AS sort_instant
        FROM catalog""",
    "matrix": f"SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x, {_embedding_columns()} FROM embeddings",
}


def with_ctes(statement: str) -> str:
    """Prefix a statement with the stand-ins it names, and with those that these name."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name, body in CTES.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                add(body)
                if name not in needed:
                    needed.append(name)

    add(statement)
    if not needed:
        return statement
    stands_for = ", ".join(f"{name} AS ({CTES[name]})" for name in needed)
    body = statement.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {stands_for}, {body[5:]}"
    return f"WITH {stands_for} {body}"
