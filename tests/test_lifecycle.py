import datetime as dt

import pytest
from pyspark.sql import functions as F

from marquee.functions import instants, lookups, text, values
from marquee.operators import enrich, lifecycle
from marquee.schemas import USERS
from marquee.sources import readers, sinks

T0 = dt.datetime(2026, 1, 1)


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


@pytest.mark.parametrize("given, wanted", [
    ("Arts & Theatre", "arts_and_theatre"), (" R&B / Soul-Funk ", "randb_soul_funk"), ("Ópera--(2)", "ópera_2"), ("__", ""),
])
def test_slugify(spark, given, wanted):
    assert one(spark, text.slugify(F.lit(given))) == wanted


@pytest.mark.parametrize("name, email, wanted", [
    ("José  Núñez", "x@y", "jose_nunez"), ("¿?", "a.b+c@y", "a_b_c"), (None, "ñ@y", "ñ"), ("", "@y", "user"), ("x" * 95, "e@y", "x" * 90),
])
def test_slugify_handle(spark, name, email, wanted):
    assert one(spark, text.slugify_handle(F.lit(name).cast("string"), F.lit(email))) == wanted


def test_small_functions(spark):
    assert one(spark, text.clean_label(F.lit("\t UNDEFINED "))) is None and one(spark, text.clean_label(F.lit(" Rock\n"))) == "Rock"
    assert one(spark, values.parse_bool(F.lit("YES\t"))) is True and one(spark, values.parse_bool(F.lit("2"))) is None
    assert one(spark, values.json_value(F.lit('{"a": {"b": 5}}'), "$.a.b")) == "5"
    assert one(spark, instants.iso_date_or_null(F.lit("2026-02-30"))) is None
    assert one(spark, instants.iso_text(F.lit(T0 + dt.timedelta(microseconds=5)))) == "2026-01-01T00:00:00.000005+00:00"
    assert one(spark, instants.elapsed_days(F.lit(T0), F.lit(T0 - dt.timedelta(hours=1)))) == -1
    assert one(spark, lookups.lookup_pin_category(F.lit(None).cast("string"))) == "food"
    assert one(spark, lookups.place_type(F.array(F.lit("hostel"), F.lit("motel")))) == "motel"
    assert one(spark, lookups.subcategory_allowed(F.lit("Deportes"), F.lit("Circo"))) is False
    assert lookups.category_map(spark).filter("subcategory = 'Circo'").count() == 2 and lookups.category_map(spark).count() == 27
    blank = F.lit(None).cast("string")
    assert one(spark, text.describe_event(blank, blank, F.lit("Undefined"), blank, blank, blank, blank, blank)) == \
        "Discover this event and plan your night out."
    grid = instants.single_month(spark, 2026, 2).orderBy("cell").collect()
    assert len(grid) == 35 and grid[5].day is None and grid[6].day == dt.date(2026, 2, 1) and grid[34].day is None


def test_cache_asks_once_per_key_and_does_not_store_failures(spark, tmp_path):
    rows = spark.createDataFrame([(i, ["a", "b", "bad", None][i % 4]) for i in range(40)], "id int, key string")
    cache = spark.createDataFrame([("a", "old"), ("z", "old")], "key string, answer string")
    log = str(tmp_path)

    def setup():
        def call(batch):
            import os
            import uuid
            for key in batch["key"]:
                open(os.path.join(log, f"{key}-{uuid.uuid4().hex}"), "w").close()
            return batch.assign(answer=[None if k == "bad" else f"new {k}" for k in batch["key"]])[["key", "answer"]]
        return call

    from pyspark.sql import types as T
    out = T.StructType([T.StructField("answer", T.StringType())])
    enriched, fresh = enrich.cache_aside(rows, cache, ["key"], F.lit(True), enrich.per_batch(setup, "key string, answer string"), out)
    assert [tuple(r) for r in fresh.collect()] == [("b", "new b")]
    asked = sorted(p.name.split("-")[0] for p in tmp_path.iterdir())
    assert asked == ["b", "bad"]  # one call per missing key
    answers = {(r.key, r.answer) for r in enriched.collect()}
    assert answers == {("a", "old"), ("b", "new b"), ("bad", None), (None, None)} and enriched.count() == 40


def test_upsert_keeps_absent_fields_and_takes_the_last_write(spark):
    target = spark.createDataFrame([("1", "x", "keep"), ("2", "y", "keep")], "id string, a string, b string")
    updates = spark.createDataFrame([("1", "first", 1), ("1", None, 2), ("3", "new", 1)], "id string, a string, seq int")
    rows = {r.id: (r.a, r.b) for r in sinks.upsert_by_key(target, updates, ["id"], F.col("seq").desc()).collect()}
    assert rows == {"1": (None, "keep"), "2": ("y", "keep"), "3": ("new", None)}


def test_identities(spark):
    users = spark.createDataFrame(
        [("1", "u1", "a@x", "ana", None, None, True, False), ("2", None, "b@x", "bob", None, "pic", True, False)],
        "id string, auth_uid string, email string, username string, full_name string, avatar_url string, is_active boolean, is_verified boolean")
    sign_ins = spark.createDataFrame([
        ("u1", "new@x", True, "Ana", "p", "google.com", T0),                      # known by uid: only the flag changes
        ("u2", "b@x", True, None, "other", "google.com", T0),                     # known by e-mail
        ("u2", "b@x", False, "Bob", None, "google.com", T0 + dt.timedelta(1)),
        ("u3", "c@x", True, "Ana", None, "google.com", T0), ("u4", "d@x", None, None, None, "google.com", T0),
        ("u5", "e@x", False, "Eve", None, "password", T0), (None, "f@x", True, "F", None, "google.com", T0)],
        "uid string, email string, email_verified boolean, name string, picture string, provider string, signed_at timestamp")
    rows = {r.email: (r.auth_uid, r.username, r.full_name, r.avatar_url, r.is_verified)
            for r in lifecycle.reconcile_identities(users, sign_ins).collect()}
    assert rows == {"a@x": ("u1", "ana", None, None, True), "b@x": ("u2", "bob", "Bob", "pic", False),
                    "c@x": ("u3", "ana_2", "Ana", None, True), "d@x": ("u4", "d", None, None, False)}


def test_saving_export_and_erasure(spark):
    saved = spark.createDataFrame([("1", "u", "e1")], "id string, user_id string, event_id string")
    rows = spark.createDataFrame([("2", "u", "e1", T0), ("3", "u", "e2", T0 + dt.timedelta(1)), ("4", "u", "e2", T0)],
                                 "id string, user_id string, event_id string, created_at timestamp")
    fresh, conflicts = lifecycle.save_if_absent(saved, rows)
    assert [r.id for r in fresh.collect()] == ["4"] and sorted(r.id for r in conflicts.collect()) == ["2", "3"]
    users = spark.createDataFrame([("u", "a"), ("w", None)], "id string, full_name string")
    ids = spark.createDataFrame([("u",), ("u",)], "id string")
    records = [tuple(r) for r in lifecycle.export_user_data(users, saved, None, ids).orderBy("section").collect()]
    assert records == [("u", "profile", "u", '{"id":"u","full_name":"a"}'),
                       ("u", "saved_event", "e1", '{"id":"1","user_id":"u","event_id":"e1"}')]
    left = lifecycle.erase_users({"users": users, "saved_events": saved}, ids)
    assert [r.id for r in left["users"].collect()] == ["w"] and left["saved_events"].count() == 0


def test_plans(spark):
    turns = spark.createDataFrame([("p", t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(25)] + [("q", 0, "system", "s")],
                                  "plan_id string, turn int, role string, content string")
    pages = lifecycle.plan_transcripts(turns, page=10).orderBy("page").collect()
    assert [len(p.messages) for p in pages] == [10, 10, 5] and [m.turn for m in pages[1].messages] == list(range(10, 20))
    titles = {r.plan_id: (r.title, r.n_messages) for r in lifecycle.plan_titles(turns).collect()}
    assert titles == {"p": ("m0", 25), "q": (None, 1)}


def test_operational_snapshot(spark, tmp_path):
    spark.createDataFrame([("1", "a@x")], "id string, email string").write.parquet(str(tmp_path / "users"))
    rows = readers.read_operational(spark, str(tmp_path), "users")
    assert rows.schema == USERS and rows.first().email == "a@x" and rows.first().is_active is None


def test_one_new_person_with_two_mails(spark):
    users = spark.createDataFrame([], "id string, auth_uid string, email string, username string, full_name string, avatar_url string, "
                                      "is_active boolean, is_verified boolean")
    sign_ins = spark.createDataFrame(
        [("u1", "a@x.org", True, "Ann", None, "google", 1), ("u1", "b@x.org", True, "Ann", None, "google", 2)],
        "uid string, email string, email_verified boolean, name string, picture string, provider string, signed_at long")
    assert [(r["id"], r["email"]) for r in lifecycle.reconcile_identities(users, sign_ins).collect()] == [("u1", "a@x.org")]


def test_different_messages_of_a_turn_stay(spark):
    turns = spark.createDataFrame([("p", 1, "user", "a"), ("p", 1, "assistant", "b"), ("p", 1, "user", "a")],
                                  "plan_id string, turn int, role string, content string")
    assert [m["content"] for m in lifecycle.plan_transcripts(turns).first()["messages"]] == ["b", "a"]
