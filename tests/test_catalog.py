import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marquee.operators import catalog
from marquee.schemas import RAW_EVENT, WAREHOUSE
from marquee.sources import readers, sinks


def raw(spark, tmp_path, *documents):
    path = tmp_path / "pages.json"
    path.write_text("\n".join([json.dumps({"_embedded": {"events": list(documents)}}), '{"page": {"totalElements": 0}}']))
    return readers.read_event_pages(spark, str(path))


def test_flatten_takes_first_elements_and_survives_missing_parts(spark, tmp_path):
    full = {
        "id": "1", "name": "Gig", "test": None,
        "dates": {"start": {"localDate": "2026-05-01", "dateTime": "2026-05-01T19:00:00Z"}, "status": {"code": "onsale"}},
        "classifications": [{"segment": {"name": "Music"}}, {"segment": {"name": "Other"}}],
        "_embedded": {"venues": [
            {"id": "v1", "city": {"name": "Madrid"}, "location": {"latitude": "40.4", "longitude": ""}}, {"id": "v2"}]},
        "images": [], "unknown": 1,
    }
    rows = catalog.flatten_event(raw(spark, tmp_path, full, {"id": "2", "classifications": []})).orderBy("id").collect()
    one, two = rows
    assert (one.segment, one.venue_id, one.city, one.latitude, one.longitude) == ("Music", "v1", "Madrid", 40.4, None)
    assert one.is_test is False and one.event_image is None and one.genre is None
    assert one.starts_at == dt.datetime(2026, 5, 1, 19)
    assert two.segment is None and two.venue_id is None and len(rows) == 2 and len(two) == 26


def test_bad_coordinates_and_instants_are_rejected(spark, tmp_path):
    def venue(lat):
        return {"_embedded": {"venues": [{"location": {"latitude": lat, "longitude": "1"}}]}}

    rows = raw(spark, tmp_path, {"id": "1", **venue("abc")}, {"id": "2", **venue("")}, {"id": "3", **venue("1.5")},
               {"id": "4", "dates": {"start": {"dateTime": "soon"}}}, {"name": "no id"})
    good, bad = catalog.split_valid(rows, catalog.raw_event_rules())
    assert sorted(r.id for r in good.collect()) == ["2", "3"]
    assert {r.id: r.error for r in bad.collect()} == {
        "1": "latitude is not a number", "4": "start is not an instant", None: "missing id"}
    sinks.write_dead_letters(bad, str(tmp_path / "dead"), dt.datetime(2026, 1, 2, 3, 4, 5))
    stored = spark.read.json(str(tmp_path / "dead" / "run_ts=20260102_030405"))
    assert stored.count() == 3 and set(stored.columns) == {"error", "id", "raw", "timestamp"}


@pytest.mark.parametrize("images, wanted", [
    ([("16_9", 1200, "a"), ("16_9", 1200, "b"), ("4_3", 5000, "c")], "a"),  # a tie goes to the first
    ([("16_9", 500, "a"), ("4_3", 400, "b")], "a"),                        # none is wide enough
    ([(None, 400, "a"), ("4_3", None, "b")], "a"),                         # no ratio, no width
    ([("16_9", 1500, None), ("16_9", 1000, "b")], None),
    ([], None), (None, None),
])
def test_pick_image(spark, images, wanted):
    df = spark.createDataFrame([(images,)], "images array<struct<ratio:string,width:bigint,url:string>>")
    assert df.select(catalog.pick_image(F.col("images"), "16_9", 1000)).first()[0] == wanted


def test_sort_places_puts_zero_and_unknown_last(spark):
    places = [("far", 12000), ("here", 0), ("near", 5), ("lost", None), ("mid", 9998)]
    df = spark.createDataFrame([(places,)], "p array<struct<name:string,distance_m:bigint>>")
    names = [p.name for p in df.select(catalog.sort_places(F.col("p"))).first()[0]]
    assert names == ["near", "mid", "here", "lost", "far"]


def events(spark, rows):
    schema = ("id string, name string, venue_name string, city string, event_date string, event_time string, "
              "starts_at timestamp, latitude double, longitude double, url string, segment string")
    return spark.createDataFrame(rows, schema)


def test_groups_and_schedule(spark):
    late, early = dt.datetime(2026, 5, 2, 20), dt.datetime(2026, 5, 1, 20)
    df = events(spark, [
        ("1", "Show ", "Hall", None, "2026-05-02", "20:00", late, 1.0, 1.0, "u1", "Music"),
        ("2", "show", "HALL", "", "2026-05-01", "20:00", early, 2.0, 2.0, None, "Music"),
        ("3", "show", "hall", None, "2026-05-01", "20:00", early, 3.0, 3.0, "u3", "Music"),
        ("4", "show", "hall", None, "", None, None, 4.0, 4.0, "u4", ""),
        ("5", "Solo", None, None, "2026-05-01", " ", early, None, 5.0, "u5", None),
    ])
    groups = {r.group_key: (r.primary.id, r.n_occurrences) for r in catalog.group_occurrences(df).collect()}
    # The row without any date or time sorts as a blank text, so it comes first.
    assert groups == {"show|hall|": ("4", 4), "solo||": ("5", 1)}
    schedule = {(r.group_key, r.date, r.time): r.url for r in catalog.build_schedule(df).collect()}
    # The first occurrence's URL wins even if it is NULL; a date without a time keeps one bare row.
    assert schedule == {("show|hall|", "2026-05-02", "20:00"): "u1", ("show|hall|", "2026-05-01", "20:00"): None,
                        ("show|hall|", "—", None): None, ("solo||", "2026-05-01", None): None}
    assert [r.segment for r in catalog.list_categories(df).collect()] == ["Music"]
    assert sorted(r.id for r in catalog.sibling_occurrences(df, df.filter("id in ('1', '2')")).collect()) == ["1", "2", "3", "4"]


def test_query_catalog_arguments(spark):
    df = events(spark, [(str(i), "n", "v", "c", "d", None, dt.datetime(2026, 1, 1 + i), float(i), 0.0, None, f"s{i}")
                        for i in range(12)])
    many = [f"s{i}" for i in range(12)]
    assert catalog.query_catalog(df, segments=many).count() == 12  # the whole list counts
    box = (5.0, 20.0, -1.0, 1.0)
    assert [r.id for r in catalog.query_catalog(df, bbox=box, limit=3).collect()] == ["5", "6", "7"]
    assert catalog.query_catalog(df, bbox=box, limit=3, box_first=False).count() == 0
    assert catalog.bbox_filter(df, 5.0, None, 0.0, 1.0).count() == 12
    with pytest.raises(ValueError):
        catalog.query_catalog(df, limit=5001)


def test_warehouse_projection(spark):
    df = spark.createDataFrame([("1", "2026-05-01", "not a date", True)], "id string, event_date string, sale_end string, is_test boolean")
    row = catalog.project_warehouse(df, WAREHOUSE).first()
    assert len(row) == 38 and row.event_date == dt.date(2026, 5, 1) and row.sale_end is None and row.occasion_tags == []
    assert len(RAW_EVENT.fields) == 11


def test_append_new_makes_table_and_keeps_ids_unique(spark, tmp_path):
    path = str(tmp_path / "warehouse")
    rows = spark.createDataFrame([("1", "2026-05-01"), ("1", "2026-05-01"), ("2", None)], "id string, event_date string")
    sinks.append_new(rows, path, WAREHOUSE, "event_date")
    sinks.append_new(rows.union(spark.createDataFrame([("3", "2026-05-02")], rows.schema)), path, WAREHOUSE, "event_date")
    assert sorted(r.id for r in readers.read_ids(spark, path).collect()) == ["1", "2", "3"]


def test_more_than_ten_segments_are_all_found(spark):
    rows = [(str(i), f"s{i}", i) for i in range(12)]
    events = spark.createDataFrame(rows, "id string, segment string, starts_at long")
    assert catalog.query_catalog(events, segments=[f"s{i}" for i in range(12)]).count() == 12


def test_rows_without_a_key_all_stay(spark):
    from marquee.operators.marts import new_events_only

    batch = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4), ("b", 5)], "id string, n int")
    kept = new_events_only(batch, spark.createDataFrame([("b",)], "id string"), dedupe=True)
    assert sorted(r["n"] for r in kept.collect()) == [1, 2, 3]


def test_duplicate_cache_rows_do_not_multiply(spark):
    from pyspark.sql import types as T

    from marquee.operators.enrich import cache_aside

    calls = spark.sparkContext.accumulator(0)

    def ask(batches):
        for batch in batches:
            calls.add(len(batch))
            yield batch[["k"]].assign(v="asked")

    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    cache = spark.createDataFrame([("a", "old"), ("a", "new")], "k string, v string")
    found, fresh = cache_aside(rows, cache, ["k"], F.lit(True), lambda df: df.mapInPandas(ask, "k string, v string"),
                               T.StructType([T.StructField("v", T.StringType())]))
    assert sorted(map(tuple, found.collect())) == [("a", "old"), ("a", "old"), ("b", "asked")]
    assert [tuple(r) for r in fresh.collect()] == [("b", "asked")] and calls.value == 1


def test_broken_pages_and_unknown_fields_are_kept(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    event = {"id": "1", "priceRanges": [{"min": 5}]}
    (pages / "a.json").write_text(json.dumps({"_embedded": {"events": [event]}}) + "\n{broken\n" + json.dumps({"page": {"totalElements": 0}}) + "\n")
    documents = readers.read_page_documents(spark, str(pages))
    sinks.land_documents(documents, str(tmp_path / "raw"), dt.datetime(2024, 1, 1))
    landed = spark.read.text(str(tmp_path / "raw" / "*")).collect()
    assert [json.loads(r["value"]) for r in landed] == [event]
    assert [(r["id"], r["error"], r["page"]) for r in readers.malformed_pages(spark, str(pages)).collect()] == [(None, "page is not JSON", "{broken")]
