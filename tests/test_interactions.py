import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marquee.operators import features, marts, quality, staging
from marquee.schemas import FACT
from marquee.sources import readers
from marquee.streaming.interactions import rejected_messages

T0 = dt.datetime(2026, 1, 10)
NOW = dt.datetime(2026, 1, 12)


def envelopes(spark, *rows):
    """(message id, publish time, body)."""
    return spark.createDataFrame([("s", m, ts, body, None) for m, ts, body in rows],
                                 "subscription_name string, message_id string, publish_time timestamp, data string, attributes string")


GOOD = '{"event_id": "e", "user_id": 7, "direction": "up", "swiped_at": "2026-01-10 09:00:00+01:00", "session_id": {"x": 1}}'


def test_staging_of_odd_bodies(spark):
    bodies = [GOOD, "{oops", None, '{"event_id": null, "user_id": "u", "direction": "left", "swiped_at": "2026-01-10T00:00:00Z"}',
              '{"event_id": ["e"], "user_id": "u", "direction": "left", "swiped_at": "2026-01-10T00:00:00Z"}',
              '{"event_id": "[e]", "user_id": "u", "direction": "left", "swiped_at": "2026-01-10T00:00:00Z"}',
              '{"event_id": "e", "user_id": "u", "direction": "left", "swiped_at": "soon"}']
    raw = envelopes(spark, *[(str(i), T0, body) for i, body in enumerate(bodies)])
    rows = {r.interaction_id: r for r in staging.stage_interactions(raw).collect()}
    first = rows["0"]
    assert (first.user_id, first.session_id, first.interaction_type, first.liked) == ("7", None, "swipe", None)
    assert first.event_timestamp == dt.datetime(2026, 1, 10, 8)
    assert rows["1"].event_id is None and rows["2"].event_id is None
    assert rows["4"].event_id is None and rows["5"].event_id == "[e]"
    # A direction of another kind is kept; what it is does not matter here.
    valid = {r.interaction_id for r in staging.valid_messages(staging.stage_interactions(raw)).collect()}
    assert valid == {"0", "5"}
    errors = {r.message_id: r.error for r in rejected_messages(raw).collect()}
    assert errors == {"1": "body is not JSON", "2": "no body", "3": "no event_id", "4": "no event_id",
                      "6": "swiped_at is not an instant"}


def fact_row(key, at, user="u", liked=True, **other):
    values = {name: None for name in FACT.fieldNames()}
    values |= {"interaction_id": key, "event_timestamp": at, "user_id": user, "session_id": "s", "event_id": "e",
               "interaction_type": "swipe", "swipe_direction": "right" if liked else "left", "liked": liked,
               "segment": "Music", "genre": "Rock", "city": "Madrid", "price_min": 10.0, "price_max": 20.0,
               "event_date": dt.date(2026, 2, 1), "ingestion_timestamp": at, "recommendation_context": "map"}
    values |= other
    return tuple(values[name] for name in FACT.fieldNames())


def fact(spark, *rows):
    return spark.createDataFrame(list(rows), FACT)


def catalog(spark):
    return spark.createDataFrame([("e", "Music", "2026-02-01"), ("e", "Film", "2026-02-01")], "id string, segment string, event_date string")


def keys(df):
    return sorted((r.interaction_id, r.ingestion_timestamp) for r in df.collect())


HOUR, DAY = dt.timedelta(hours=1), dt.timedelta(days=1)


def test_merge_rules(spark):
    target = fact(spark, fact_row("old", NOW - 5 * DAY), fact_row("a", NOW - 2 * DAY), fact_row("b", NOW - DAY))
    source = fact(
        spark,
        fact_row("a", NOW - HOUR), fact_row("a", NOW - 2 * HOUR),  # redelivered twice: the latest replaces
        fact_row("old", NOW - HOUR),                                # its match lies before the lookback: inserted again
        fact_row("late", NOW - 2 * DAY),                            # earlier than the newest stored row
        fact_row("tie", NOW - DAY),                                 # exactly as new as the newest stored row
        fact_row("ancient", NOW - 4 * DAY))
    clock = F.lit(NOW)
    merged = marts.merge_incremental(target, source, catalog(spark), clock)
    assert keys(merged) == sorted([("old", NOW - 5 * DAY), ("old", NOW - HOUR), ("a", NOW - HOUR), ("b", NOW - DAY)])
    again = marts.merge_incremental(merged, source, catalog(spark), clock)
    assert keys(again) == keys(merged)
    loose = marts.merge_incremental(target, source, catalog(spark), clock, strict=False)
    assert keys(loose) == sorted(keys(merged) + [("late", NOW - 2 * DAY), ("tie", NOW - DAY)])
    assert keys(marts.merge_incremental(loose, source, catalog(spark), clock, strict=False)) == keys(loose)


def test_stored_merge_equals_the_pure_one_and_empties_a_lost_day(spark, tmp_path):
    path, work = str(tmp_path / "fact"), str(tmp_path / "staging")
    target = fact(spark, fact_row("old", NOW - 5 * DAY), fact_row("a", NOW - 2 * DAY), fact_row("b", NOW - DAY))
    source = fact(spark, fact_row("a", NOW - HOUR), fact_row("c", NOW - HOUR, user="w"))
    marts.write_fact(target, path)
    touched = marts.merge_into_path(spark, path, source, catalog(spark), NOW, work, "one")
    assert touched == [(NOW - 2 * DAY).date(), (NOW - HOUR).date()]
    stored = spark.read.parquet(path)
    assert keys(stored) == keys(marts.merge_incremental(target, source, catalog(spark), F.lit(NOW)))
    assert marts.merge_into_path(spark, path, source, catalog(spark), NOW, work, "two") == []
    # A table that does not exist yet is made.
    assert marts.merge_into_path(spark, str(tmp_path / "new"), source, catalog(spark), NOW, work, "three", strict=False)


def test_one_pass_checks(spark):
    df = fact(spark, fact_row("a", T0), fact_row("a", T0), fact_row(None, T0, swipe_direction="up"), fact_row("b", None))
    found = {r.rule: r.failures for r in quality.check_not_null(df, ["interaction_id", "event_timestamp"])
             .union(quality.check_unique(df, "interaction_id")).union(quality.check_accepted(df, "swipe_direction", ["left", "right"])).collect()}
    assert found == {"not_null:interaction_id": 1, "not_null:event_timestamp": 1, "unique:interaction_id": 1,
                     "accepted:swipe_direction": 1}
    statuses = [quality.check_freshness(df.limit(n), "ingestion_timestamp", F.lit(T0 + gap)).first().status
                for n, gap in ((1, HOUR), (1, 2 * HOUR), (1, 7 * HOUR), (0, HOUR))]
    assert statuses == ["pass", "warn", "error", "error"]


def test_csv_reports_missing_columns(spark, tmp_path):
    (tmp_path / "in.csv").write_text("interaction_id,user_id,ciudad,precio_min\n1,u,Madrid,5\n")
    with pytest.raises(ValueError, match="'event_id', 'event_timestamp'") as error:
        readers.read_interactions_csv(spark, str(tmp_path / "in.csv"))
    assert "city" not in str(error.value) and "price_max" in str(error.value)


def test_cleaning_and_its_counters(spark):
    df = fact(
        spark, fact_row("1", T0), fact_row("1", T0), fact_row("2", T0, liked=None), fact_row("3", T0, liked=False, swipe_direction="right"),
        fact_row("4", T0, price_min=30.0), fact_row("5", T0, price_max=None), fact_row("6", T0, interaction_type=None),
        fact_row("7", T0, interaction_type="SWIPE", liked=None, swipe_direction=None), fact_row("8", T0, user=None))
    clean = {r.interaction_id: r for r in features.clean_interactions(df).collect()}
    assert sorted(clean) == ["1", "2", "3", "4"]
    assert clean["2"].liked is False and clean["3"].liked is True  # `fact_row` writes left for a missing like
    assert (clean["4"].price_min, clean["4"].price_max, clean["4"].avg_price) == (20.0, 30.0, 25.0)
    assert clean["1"].days_until_event == 22
    assert features.cleaning_report(df).first().asDict() == {
        "input_rows": 9, "rows_after_dedup": 8, "direction_liked_mismatches": 2, "rows_after_interaction_filter": 7,
        "price_swaps": 1, "rows_dropped_invalid": 3, "clean_rows": 4, "unique_users": 1}


def derived(spark, *rows):
    return features.derive_interaction(fact(spark, *rows))


def test_features_of_one_sided_users(spark):
    df = derived(
        spark, fact_row("1", T0, user="likes"), fact_row("2", T0 + 36 * HOUR, user="likes", genre=None, segment=None),
        fact_row("3", T0, user="hates", liked=False, genre="Jazz"))
    rows = {r.user_id: r for r in features.user_features(df).collect()}
    likes, hates = rows["likes"], rows["hates"]
    assert (likes.total_swipes, likes.right_swipe_rate, likes.avg_disliked_price, likes.avg_liked_price) == (2, 1.0, None, 15.0)
    # A NULL segment counts in the share's denominator, a NULL genre not at all.
    assert (likes.music_swipe_share, likes.music_like_rate, likes.genre_entropy_all, likes.activity_span_days) == (0.5, 1.0, 0.0, 1.0)
    assert (hates.recency_days, hates.genre_entropy_liked, hates.distinct_genres_liked, hates.music_like_rate) == (1.0, 0.0, 0, 0.0)
    assert len(likes) == 1 + 17 + 2 + 1
    imputed = {r.user_id: r for r in features.impute_features(features.user_features(df)).collect()}
    assert imputed["likes"].avg_disliked_price == 15.0 and imputed["hates"].avg_liked_price == 15.0
    assert features.user_features(df.filter("false")).count() == 0


def test_segments_with_one_column_name_are_refused(spark):
    df = derived(spark, fact_row("1", T0, segment="Arts & Theatre"), fact_row("2", T0, segment="arts-and theatre"))
    with pytest.raises(ValueError, match="share a column name"):
        features.user_features(df)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["x", "y", "z", None]), st.booleans()), min_size=1, max_size=40))
def test_feature_properties(spark, draws):
    df = derived(spark, *[fact_row(str(i), T0, user=u, genre=g, liked=liked) for i, (u, g, liked) in enumerate(draws)])
    for row in features.user_features(df).collect():
        genres = {g for u, g, _ in draws if u == row.user_id and g}
        assert row.right_swipe_rate + row.left_swipe_rate == pytest.approx(1)
        assert -1e-12 <= row.genre_entropy_all <= math.log2(max(len(genres), 1)) + 1e-9
        assert row.music_swipe_share == 1.0 and row.map_share == 1.0


@pytest.mark.parametrize("small", [3, 10_000])
def test_medians_are_exact_with_hot_values(spark, small, monkeypatch):
    monkeypatch.setattr(features, "SMALL", small)
    values = [5.0] * 400 + [float(i) for i in range(-300, 301)] + [None] * 7
    rows = [(v, None if v is None or v == 5.0 else v * 2, 1.0 if i % 2 else None, None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(4)
    known = sorted(v for v in values if v is not None)
    middle = known[len(known) // 2]
    assert features.medians(df, ["a", "b", "c", "d"]) == {"a": middle, "b": pytest.approx(-1.0, abs=2.0), "c": 1.0, "d": None}
    evens = sorted(r[1] for r in rows if r[1] is not None)
    expected = (evens[len(evens) // 2 - 1] + evens[len(evens) // 2]) / 2 if len(evens) % 2 == 0 else evens[len(evens) // 2]
    assert features.medians(df, ["b"])["b"] == expected


def test_sent_times_have_six_digits_also_on_a_whole_second(spark):
    rows = spark.createDataFrame([("a", T0), ("b", T0 + dt.timedelta(microseconds=5)), ("c", None)], "event_id string, swiped_at timestamp").select(
        "*", F.lit("left").alias("direction"))
    built = staging.build_envelope(rows, F.lit("u"), F.lit(NOW)).orderBy("event_id").select(F.get_json_object("data", "$.swiped_at"))
    assert [row[0] for row in built.collect()] == [
        "2026-01-10T00:00:00.000000+00:00", "2026-01-10T00:00:00.000005+00:00", "2026-01-12T00:00:00+00:00"]
