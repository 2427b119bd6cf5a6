import datetime as dt

from pyspark.sql import functions as F

from marquee.operators.marts import merge_incremental
from marquee.operators.staging import stage_interactions, valid_messages
from marquee.schemas import ENVELOPE, FACT
from marquee.streaming import interactions

T0 = dt.datetime(2026, 1, 10)
BROKER = "message_id string, publish_time timestamp, data binary, attributes map<string,string>"


def body(event, direction="left"):
    return f'{{"event_id": "{event}", "user_id": "u", "direction": "{direction}", "swiped_at": "2026-01-10T00:00:00Z"}}'.encode()


def drop(spark, path, *messages):
    rows = [(m, at, data, {"event_type": "swipe"}) for m, at, data in messages]
    spark.createDataFrame(rows, BROKER).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return interactions.decode_envelopes(spark.readStream.schema(BROKER).parquet(path), "sub")


def test_landing_is_once_across_restarts_and_keeps_broken_bytes(spark, tmp_path):
    source, raw, state = (str(tmp_path / name) for name in ("in", "raw", "state"))
    drop(spark, source, ("1", T0, body("e1")), ("2", T0, b"\xff\xfe{"))
    for message in (None, ("3", T0 + dt.timedelta(1), body("e2"))):
        if message:
            drop(spark, source, message)
        interactions.land_envelopes(stream(spark, source), raw, state).awaitTermination()
    landed = spark.read.schema(ENVELOPE).parquet(raw)
    assert sorted(r.message_id for r in landed.collect()) == ["1", "2", "3"]
    broken = landed.filter("message_id = '2'").first()
    assert broken.data == "��{" and broken.attributes == '{"event_type":"swipe"}' and broken.subscription_name == "sub"
    assert spark.read.parquet(raw).select("publish_date").distinct().count() == 2


def test_stream_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    drop(spark, source, ("1", T0, body("e1")), ("2", T0, b"{oops"), ("3", T0, body("e2", "right")), ("1", T0 + dt.timedelta(hours=1), body("e1")))
    batch = interactions.decode_envelopes(spark.read.schema(BROKER).parquet(source), "sub")
    expected = valid_messages(stage_interactions(batch))

    def run(frame, name):
        (frame.writeStream.format("parquet").option("path", f"{out}/{name}").option("checkpointLocation", f"{out}/{name}-state")
         .trigger(availableNow=True).start().awaitTermination())
        return spark.read.schema(frame.schema).parquet(f"{out}/{name}")

    staged = interactions.stream_stage(stream(spark, source))
    assert sorted(map(tuple, run(staged, "staged").collect())) == sorted(map(tuple, expected.collect()))
    once = run(interactions.stream_dedupe(interactions.stream_stage(stream(spark, source))), "once")
    assert sorted(r.interaction_id for r in once.collect()) == ["1", "3"]
    interactions.stream_dead_letter(stream(spark, source), f"{out}/dead", f"{out}/dead-state").awaitTermination()
    assert [(r.message_id, r.error) for r in spark.read.json(f"{out}/dead").collect()] == [("2", "body is not JSON")]


def test_merged_stream_equals_batch_merges(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "fact")
    catalog = spark.createDataFrame([("e1", "Music"), ("e2", "Film")], "id string, segment string")
    batches = [[("1", T0, body("e1")), ("2", T0, body("e2"))],
               [("2", T0 + dt.timedelta(days=1), body("e1")), ("3", T0 - dt.timedelta(hours=5), body("e9"))],
               [("1", T0, body("e1"))]]
    now = T0 + dt.timedelta(days=1, hours=1)
    pure = spark.createDataFrame([], FACT)
    for messages in batches:
        drop(spark, source, *messages)
        interactions.stream_merge_fact(interactions.stream_stage(stream(spark, source)), target, catalog, str(tmp_path / "state"),
                                       str(tmp_path / "staging")).awaitTermination()
        rows = [("sub", m, at, data.decode(), None) for m, at, data in messages]
        staged = valid_messages(stage_interactions(spark.createDataFrame(rows, ENVELOPE)))
        pure = spark.createDataFrame(merge_incremental(pure, staged, catalog, F.lit(now), strict=False).collect(), FACT)
    stored = spark.read.parquet(target).select(*FACT.fieldNames())
    assert sorted(map(str, stored.collect())) == sorted(map(str, pure.collect()))
    assert {(r.interaction_id, r.segment) for r in stored.collect()} == {("1", "Music"), ("2", "Music"), ("3", None)}


def test_a_stream_that_catches_up_loses_nothing(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "fact")
    catalog = spark.createDataFrame([("e1", "Music")], "id string, segment string")
    day = dt.timedelta(days=1)
    batches = [[("1", T0 - 30 * day, body("e1")), ("2", T0, body("e1"))],
               [("3", T0 - 9 * day, body("e1")), ("1", T0 - 30 * day, body("e1")), ("2", T0 - 8 * day, body("e1"))]]
    for messages in batches:
        drop(spark, source, *messages)
        interactions.stream_merge_fact(interactions.stream_stage(stream(spark, source)), target, catalog, str(tmp_path / "state"),
                                       str(tmp_path / "staging")).awaitTermination()
    stored = spark.read.parquet(target).collect()
    assert sorted((r.interaction_id, r.ingestion_timestamp) for r in stored) == [("1", T0 - 30 * day), ("2", T0), ("3", T0 - 9 * day)]
