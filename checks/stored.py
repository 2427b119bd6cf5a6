"""Stored tables changed by key, by version and by erasure: written, changed, and read back whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Tables, query, scratch, ts_text
from marquee.operators import marts
from marquee.scale import durable
from marquee.schemas import FACT
from marquee.sources.stored import KeyedTable, erase_stored


def keyed(t: Tables, rows, key: list[str]) -> KeyedTable:
    path = scratch(t.spark)
    table = KeyedTable(t.spark, f"{path}/table", key, rows.schema, f"{path}/staging", 16)
    table.upsert(rows, F.col(key[0]), "made")
    return table


@query("upsert_into_path", """
    WITH u AS (SELECT *, CAST(id AS BIGINT) AS k FROM users)
    SELECT id, CASE WHEN k % 3 <> 0 THEN email END AS email, CASE WHEN k % 2 = 0 THEN 'second' WHEN k % 3 <> 0 THEN full_name END AS full_name,
           CASE WHEN k % 2 = 0 THEN avatar_url END AS picture FROM u WHERE k % 3 <> 0 OR k % 2 = 0""")
def _(t: Tables):
    """Two versions of every second user arrive; the later one counts, a new column appears, users without an id are refused."""
    key = F.col("id").cast("bigint")
    table = keyed(t, t.users().filter(key % 3 != 0).select("id", "email", "full_name"), ["id"])
    rows = t.users().filter(key % 2 == 0).select("id", F.col("avatar_url").alias("picture"))
    updates = (rows.select("*", F.lit("first").alias("full_name"), F.lit(1).alias("seq"))
               .unionByName(rows.select("*", F.lit("second").alias("full_name"), F.lit(2).alias("seq")))
               .unionByName(rows.select(F.lit(None).cast("string").alias("id"), "picture", F.lit("nobody").alias("full_name"), F.lit(3).alias("seq"))))
    table.upsert(updates, F.col("seq").desc(), "again")
    return table.read().select("id", "email", "full_name", "picture")


@query("insert_into_path", """
    SELECT user_id, event_id, CASE WHEN n = 1 AND NOT there THEN 'inserted' ELSE 'conflict' END AS outcome FROM (
        SELECT r.user_id, r.event_id, s.user_id IS NOT NULL AS there, row_number() OVER (PARTITION BY r.user_id, r.event_id ORDER BY r.created_at, r.id) AS n
        FROM save_requests r LEFT JOIN saved s ON s.user_id = r.user_id AND s.event_id = r.event_id)""")
def _(t: Tables):
    """Requests to save events, and what became of each."""
    table = keyed(t, t.saved().select("user_id", "event_id", "created_at"), ["user_id", "event_id"])
    return table.insert_ignore(t.save_requests(), F.struct("created_at", "id"), "requests")


@query("delete_by_key", """
    WITH asked AS (SELECT user_id, event_id, CAST(user_id AS BIGINT) % 2 = 0 AS theirs FROM saved WHERE CAST(event_id AS BIGINT) % 4 = 0)
    SELECT s.user_id, s.event_id, 'left' AS outcome FROM saved s LEFT JOIN asked a USING (user_id, event_id) WHERE NOT coalesce(a.theirs, FALSE)
    UNION ALL SELECT user_id, event_id, CASE WHEN theirs THEN 'deleted' ELSE 'not the owner' END FROM asked
    UNION ALL SELECT user_id, 'none', 'missing' FROM asked""")
def _(t: Tables):
    """Every fourth saved event is to go, half of them asked for by somebody else, and as many that are not there."""
    saved = t.saved().select("user_id", "event_id", F.col("user_id").alias("owner"))
    table = keyed(t, saved, ["user_id", "event_id"])
    theirs = F.col("user_id").cast("bigint") % 2 == 0
    asked = saved.filter(F.col("event_id").cast("bigint") % 4 == 0).withColumn("owner", F.when(theirs, F.col("owner")).otherwise("other"))
    report = table.delete_by_key(asked.unionByName(asked.withColumn("event_id", F.lit("none"))), "gone", owner="owner")
    return table.read().select("user_id", "event_id", F.lit("left").alias("outcome")).unionByName(report)


@query("patch_by_key", """
    SELECT 'row' AS kind, CAST(plan_id AS VARCHAR) AS plan_id, CASE WHEN plan_id % 4 = 1 THEN 'patched' ELSE title END AS title, updated_at AS told FROM plan_headers
    UNION ALL SELECT 'report', CAST(plan_id AS VARCHAR), NULL, CASE plan_id % 4 WHEN 1 THEN 'patched' ELSE 'not the owner' END
    FROM plan_headers WHERE plan_id % 4 IN (1, 2)
    UNION ALL SELECT 'report', CAST(-1 - plan_id AS VARCHAR), NULL, 'missing' FROM plan_headers WHERE plan_id % 4 = 3""")
def _(t: Tables):
    """Titles of half of all plans, half of these by their owner; times that a patch lacks stay."""
    plans = t.plan_headers()
    table = keyed(t, plans, ["plan_id"])
    part = F.col("plan_id") % 4
    patches = plans.filter(part > 0).select(
        F.when(part == 3, -1 - F.col("plan_id")).otherwise(F.col("plan_id")).alias("plan_id"),
        F.when(part == 2, "other").otherwise(F.col("user_id")).alias("user_id"), F.lit("patched").alias("title"),
        F.lit(None).cast("string").alias("updated_at"))
    report = table.patch_by_key(patches, F.col("title"), "patch", owner="user_id")
    rows = table.read().select(F.lit("row").alias("kind"), F.col("plan_id").cast("string").alias("plan_id"), "title", F.col("updated_at").alias("told"))
    return rows.unionByName(report.select(F.lit("report").alias("kind"), F.col("plan_id").cast("string").alias("plan_id"),
                                          F.lit(None).cast("string").alias("title"), F.col("outcome").alias("told")))


@query("erase_stored", """
    SELECT 'users' AS name, id AS user_id, email AS item FROM users WHERE CAST(id AS BIGINT) % 6 <> 0
    UNION ALL SELECT 'saved', user_id, event_id FROM saved WHERE CAST(user_id AS BIGINT) % 6 <> 0
    UNION ALL SELECT 'fact', user_id, interaction_id FROM fact WHERE CAST(user_id AS BIGINT) % 6 <> 0""")
def _(t: Tables):
    """Users, saved events and the day-partitioned fact, each stored, without every sixth user."""
    path = scratch(t.spark)
    users, saved, fact = (f"{path}/{name}" for name in ("users", "saved", "fact"))
    t.users().write.parquet(users)
    t.saved().repartitionByRange("user_id").write.parquet(saved)
    marts.write_fact(t.fact(), fact)
    ids = t.users().filter(F.col("id").cast("bigint") % 6 == 0).select("id")
    erase_stored(t.spark, {users: "id", saved: "user_id", fact: "user_id"}, ids, f"{path}/staging", "run", {fact: ["ingestion_date"]})
    read = t.spark.read
    left = [read.parquet(users).select(F.lit("users").alias("name"), F.col("id").alias("user_id"), F.col("email").alias("item")),
            read.parquet(saved).select(F.lit("saved"), "user_id", "event_id"), read.parquet(fact).select(F.lit("fact"), "user_id", "interaction_id")]
    return left[0].union(left[1]).union(left[2])


@query("merge_by_index", """
    SELECT interaction_id, strftime(CASE WHEN CAST(interaction_id AS BIGINT) % 97 = 0 THEN TIMESTAMP '1970-01-01'
               + to_hours(CAST(interaction_id AS BIGINT) % 48) ELSE ingestion_timestamp END, '%Y-%m-%d %H:%M:%S.%f') AS ingestion_timestamp, segment FROM fact
    WHERE CAST(interaction_id AS BIGINT) % 3 <> 0 OR CAST(interaction_id AS BIGINT) % 97 <> 0
    UNION ALL SELECT interaction_id, strftime(ingestion_timestamp, '%Y-%m-%d %H:%M:%S.%f'), segment FROM fact
    WHERE CAST(interaction_id AS BIGINT) % 3 = 0 AND CAST(interaction_id AS BIGINT) % 97 = 0""")
def _(t: Tables):
    """A stored fact lacks every third interaction; arrivals bring these and, again, a stray version from 1970 of some."""
    path, work = scratch(t.spark), scratch(t.spark)
    staged = durable(t.staged())
    key = F.col("interaction_id").cast("bigint")
    stray = (F.lit("1970-01-01").cast("timestamp") + F.make_dt_interval(hours=(key % 48).cast("int")))
    old = durable(marts.latest_interactions(staged.filter(key % 3 != 0)).withColumn(
        "ingestion_timestamp", F.when(key % 97 == 0, stray).otherwise(F.col("ingestion_timestamp"))))
    marts.write_fact(marts.stored_fact(old, t.catalog()), path)
    arrivals = staged.filter(key % 3 == 0).unionByName(old.filter(key % 97 == 0))
    for run in ("one", "two"):
        marts.merge_by_index(t.spark, path, arrivals, t.catalog(), work, run)
    return t.spark.read.schema(FACT).parquet(path).select("interaction_id", ts_text("ingestion_timestamp").alias("ingestion_timestamp"), "segment")
