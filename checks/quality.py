"""Data-quality checks, retention and tiering."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Tables, now, query, ts_text
from marquee.functions import lookups
from marquee.operators import lifecycle, quality
from marquee.plans import interaction_fact


def counted(rules: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) FILTER (WHERE {condition}) AS failures FROM {source}"
        for name, condition in rules.items())


CATALOG_COLUMNS = ["id", "segment", "genre", "city", "event_time", "latitude"]


@query("check_not_null", counted({f"not_null:{name}": f"{name} IS NULL" for name in CATALOG_COLUMNS}, "catalog"))
def _(t: Tables):
    return quality.check_not_null(t.catalog(), CATALOG_COLUMNS)


@query("check_unique", """
    SELECT 'unique:l_orderkey' AS rule, count(*) AS failures FROM (
        SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)""")
def _(t: Tables):
    return quality.check_unique(t.read("lineitem"), "l_orderkey")


@query("check_accepted", counted({"accepted:event_type": "event_type NOT IN ('view', 'click')"}, "events"))
def _(t: Tables):
    return quality.check_accepted(t.read("events"), "event_type", ["view", "click"])


@query("check_range", counted({"range:l_quantity": "l_quantity NOT BETWEEN 1 AND 45"}, "lineitem"))
def _(t: Tables):
    return quality.check_range(t.read("lineitem"), "l_quantity", 1, 45)


FRESH = """
    SELECT strftime(newest, '%Y-%m-%d %H:%M:%S.%f') AS newest, age AS age_hours,
           CASE WHEN age > {error} THEN 'error' WHEN age > {warn} THEN 'warn' ELSE 'pass' END AS status
    FROM (SELECT max(publish_time) AS newest, trunc((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(publish_time))) / 1e6) / 3600 AS age
          FROM raw)"""


def fresh(df):
    return df.withColumn("newest", ts_text("newest"))


@query("check_freshness", FRESH.format(warn=0.01, error=12))
def _(t: Tables):
    return fresh(quality.check_freshness(t.raw(), "publish_time", now(), 0.01, 12))


@query("stream_freshness", FRESH.format(warn=1, error=6))
def _(t: Tables):
    from marquee.streaming.interactions import stream_freshness
    return fresh(stream_freshness(t.raw(), now()))


def words(values: list[str], prime: int) -> str:
    listed = ", ".join(f"'{v}'" for v in [*values, "other"])
    return f"list_extract([{listed}], CAST(p_partkey * {prime} % {len(values) + 1} + 1 AS INTEGER))"


SUBWORDS = sorted({word for group in lookups.SUBCATEGORIES.values() for word in group})
PAIRS = ", ".join(f"('{c}', '{w}')" for c, group in lookups.SUBCATEGORIES.items() for w in group)


@query("check_attributes", counted({
    "attribute:mood": "mood = 'other'", "attribute:price_band": "band = 'other'", "attribute:setting": "setting = 'other'",
    "attribute:time_slot": "slot = 'other'", "attribute:minutes_ahead": "minutes NOT BETWEEN 15 AND 120",
    "attribute:reason": "p_partkey % 11 = 0", "attribute:occasion_tags": "p_partkey % 5 IN (0, 4) OR occasion = 'other'",
    "attribute:plan_pairings": "p_partkey % 5 IN (0, 4)", "attribute:duration_minutes": "p_partkey % 13 = 0",
    "attribute:subcategory": f"(category, subcategory) NOT IN (VALUES {PAIRS})",
    "attribute:romantic_score": "score > 100", "attribute:family_score": "score > 90",
    "attribute:group_score": "score < 10", "attribute:tourist_score": "p_partkey % 4 = 0",
}, f"""(SELECT *, {words(lookups.MOODS, 1)} AS mood, {words(lookups.PRICE_BANDS, 1)} AS band, {words(lookups.SETTINGS, 1)} AS setting,
        {words(lookups.TIME_SLOTS, 1)} AS slot, {words(lookups.OCCASIONS, 1)} AS occasion,
        {words(list(lookups.SUBCATEGORIES), 1)} AS category, {words(SUBWORDS, 7)} AS subcategory,
        p_partkey % 130 AS minutes, p_partkey % 110 AS score FROM part)"""))
def _(t: Tables):
    key = F.col("p_partkey")

    def word(values, prime):
        return F.get(F.array(*[F.lit(v) for v in [*values, "other"]]), (key * prime % (len(values) + 1)).cast("int"))

    occasion = word(lookups.OCCASIONS, 1)
    tags = F.array_repeat(occasion, (key % 5).cast("int"))
    score = (key % 110).cast("bigint")
    rows = t.read("part").select(
        word(lookups.MOODS, 1).alias("mood"), word(lookups.PRICE_BANDS, 1).alias("price_band"),
        word(lookups.SETTINGS, 1).alias("setting"), word(lookups.TIME_SLOTS, 1).alias("time_slot"),
        F.struct((key % 130).alias("minutes_ahead"), F.when(key % 11 != 0, "r").alias("reason")).alias("arrival_advice"),
        tags.alias("occasion_tags"), tags.alias("plan_pairings"), F.when(key % 13 != 0, 90).alias("duration_minutes"),
        word(list(lookups.SUBCATEGORIES), 1).alias("category"), word(SUBWORDS, 7).alias("subcategory"),
        score.alias("romantic_score"), (score + 10).alias("family_score"), (score - 10).alias("group_score"),
        F.when(key % 4 != 0, score % 100).alias("tourist_score"))
    return quality.check_attributes(rows)


STAGED_RULES = {f"not_null:{name}": f"{name} IS NULL" for name in (
    "interaction_id", "event_id", "user_id", "swipe_direction", "event_timestamp", "ingestion_timestamp")}


@query("staging_checks", counted(STAGED_RULES, "staged") + """
    UNION ALL SELECT 'unique:interaction_id', count(*) FROM (SELECT interaction_id FROM staged GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'accepted:swipe_direction', count(*) FILTER (WHERE swipe_direction NOT IN ('left', 'right')) FROM staged""")
def _(t: Tables):
    return interaction_fact.staging_checks(t.staged())


FACT_RULES = {f"not_null:{name}": f"{name} IS NULL" for name in (
    "interaction_id", "event_timestamp", "user_id", "event_id", "interaction_type", "swipe_direction", "liked",
    "ingestion_timestamp")}


@query("fact_checks", counted(FACT_RULES, "fact") + """
    UNION ALL SELECT 'unique:interaction_id', count(*) FROM (SELECT interaction_id FROM fact GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'accepted:interaction_type', count(*) FILTER (WHERE interaction_type <> 'swipe') FROM fact
    UNION ALL SELECT 'accepted:swipe_direction', count(*) FILTER (WHERE swipe_direction NOT IN ('left', 'right')) FROM fact""")
def _(t: Tables):
    return interaction_fact.fact_checks(t.fact())


@query("sweep_expired", "SELECT id FROM catalog WHERE starts_at IS NULL OR starts_at > TIMESTAMP '2024-03-01'")
def _(t: Tables):
    limit = F.lit("2024-03-01").cast("timestamp")
    return lifecycle.sweep_expired(t.catalog(), F.col("starts_at"), limit).select("id")


@query("tier_partitions", """
    SELECT CAST(day AS VARCHAR) AS day, CAST(date_diff('day', day, DATE '2024-03-31') AS INTEGER) AS age_days,
           CASE WHEN date_diff('day', day, DATE '2024-03-31') >= 90 THEN 'coldline'
                WHEN date_diff('day', day, DATE '2024-03-31') >= 30 THEN 'nearline' ELSE 'standard' END AS tier
    FROM (SELECT DISTINCT CAST(publish_time AS DATE) AS day FROM raw
          UNION SELECT DISTINCT CAST(CAST(publish_time AS DATE) + 60 AS DATE) FROM raw)""")
def _(t: Tables):
    days = t.raw().select(F.to_date("publish_time").alias("day"))
    parts = days.union(days.select(F.date_add("day", 60))).distinct()
    return lifecycle.tier_partitions(parts, F.lit("2024-03-31").cast("date")).withColumn("day", F.col("day").cast("string"))


@query("require_columns", "SELECT o_orderkey, o_custkey FROM orders")
def _(t: Tables):
    """Orders pass when they have the columns; a missing one is told by name before anything is read."""
    rows = t.read("orders")
    quality.require_columns(rows, ["o_orderkey", "o_custkey"])
    try:
        quality.require_columns(rows, ["o_orderkey", "no_such", "also_none"])
    except ValueError as error:
        assert "also_none" in str(error) and "no_such" in str(error)
        return rows.select("o_orderkey", "o_custkey")
    raise AssertionError("missing columns were not found")
