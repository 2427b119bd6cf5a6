"""Stored tables: publishing that survives a stop anywhere, keyed changes, the version index and erasure."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from checks.base import QUERIES
import checks.stored  # noqa: F401
from marquee.operators import marts
from marquee.schemas import FACT
from marquee.sources import commits, stored
from tests.test_interactions import DAY, HOUR, NOW, fact, fact_row, keys


@pytest.fixture
def catalog(spark):
    return spark.createDataFrame([("e", "Music", "2026-02-01"), ("e", "Film", "2026-02-01")], "id string, segment string, event_date string")


class Stop(Exception):
    pass


def stop_after(monkeypatch, steps):
    """The given number of moves and deletions of files succeeds, then the run stops."""
    left = [steps]

    def counted(name):
        real = getattr(commits.Files, name)

        def run(self, *args):
            if args and "/part-" in args[0] or ".json" in args[0]:
                if not left[0]:
                    raise Stop
                left[0] -= 1
            return real(self, *args)

        monkeypatch.setattr(commits.Files, name, run)

    counted("move")
    counted("delete")


def tree(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, files in os.walk(path) for f in files if not f.startswith("."))


@pytest.mark.parametrize("steps", range(8))
def test_publishing_is_finished_after_any_stop(spark, tmp_path, monkeypatch, steps):
    table, staged = tmp_path / "table", tmp_path / "staged"
    for place, names in ((table, ["d=1/part-old1", "d=2/part-old2", "d=3/part-kept"]), (staged, ["d=1/part-new1", "d=4/part-new4", "_index/part-x"])):
        for name in names:
            (place / name).parent.mkdir(parents=True, exist_ok=True)
            (place / name).write_text(name)
    before = tree(table)
    with monkeypatch.context() as patch:
        stop_after(patch, steps)
        try:
            commits.publish(spark, str(table), str(staged), ["d=1/part-old1", "d=2/part-old2"], "run")
        except Stop:
            pass
    if steps == 0:  # stopped before the manifest was there
        (table / "_commits" / "run.json.writing").unlink()
        assert commits.finish(spark, str(table)) == [] and tree(table) == before
        return
    commits.finish(spark, str(table))
    assert tree(table) == ["_index/part-x", "d=1/part-new1", "d=3/part-kept", "d=4/part-new4"]
    assert commits.finish(spark, str(table)) == [] and not staged.exists()


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("base") / "fact")
    marts.write_fact(fact(spark, fact_row("old", NOW - 5 * DAY), fact_row("a", NOW - 2 * DAY), fact_row("b", NOW - DAY)), path)
    return path


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("steps", [0, 1, 2, 4])
def test_a_merge_that_stops_anywhere_ends_like_an_undisturbed_one(spark, base, catalog, tmp_path, monkeypatch, strict, steps):
    source = fact(spark, fact_row("a", NOW - HOUR), fact_row("c", NOW - HOUR, user="w"), fact_row("late", NOW - 2 * DAY - HOUR))
    expected = marts.merge_incremental(spark.read.schema(FACT).parquet(base), source, catalog, F.lit(NOW), strict=strict)
    path, work = f"file:{tmp_path / 'fact'}", f"file:{tmp_path / 'staging'}"
    shutil.copytree(base, tmp_path / "fact")
    with monkeypatch.context() as patch:
        stop_after(patch, steps)
        with pytest.raises(Stop):
            marts.merge_into_path(spark, path, source, catalog, NOW, work, "one", strict=strict)
    marts.merge_into_path(spark, path, source, catalog, NOW, work, "one", strict=strict)
    assert keys(spark.read.parquet(path)) == keys(expected)
    assert marts.merge_into_path(spark, path, source, catalog, NOW, work, "two", strict=strict) == []


def stamps(path):
    return {name: os.stat(os.path.join(path, name)).st_mtime_ns for name in tree(path) if "/part-" in name and not name.startswith("_")}


def test_one_stray_row_reads_one_stray_day(spark, catalog, tmp_path):
    path, work = str(tmp_path / "fact"), str(tmp_path / "staging")
    ages = [fact_row(f"k{n}", NOW - n * DAY) for n in range(30)] + [fact_row("stray", dt.datetime(1970, 1, 1))]
    marts.write_fact(fact(spark, *ages), path)
    before = stamps(path)
    source = fact(spark, fact_row("stray", dt.datetime(1970, 1, 2)), fact_row("k9", NOW), fact_row("new", NOW - HOUR), fact_row("k3", NOW - 20 * DAY))
    touched = marts.merge_by_index(spark, path, source, catalog, work, "one")
    # Days held and days of arrival; k3's arrival is older than what is held, so neither of its days counts.
    assert touched == sorted({dt.date(1970, 1, 1), dt.date(1970, 1, 2), (NOW - 9 * DAY).date(), NOW.date(), (NOW - HOUR).date()})
    after = stamps(path)
    untouched = {name: at for name, at in before.items() if name.split("=")[1][:10] not in {str(day) for day in touched}}
    assert len(untouched) == 27 and all(after[name] == at for name, at in untouched.items())
    held = dict(keys(spark.read.parquet(path)))
    assert len(held) == 32 and held["stray"] == dt.datetime(1970, 1, 2) and held["k9"] == NOW and held["k3"] == NOW - 3 * DAY
    assert marts.merge_by_index(spark, path, source, catalog, work, "two") == []
    # A lookback merge keeps the index right.
    marts.merge_into_path(spark, path, fact(spark, fact_row("new", NOW)), catalog, NOW + HOUR, work, "three")
    assert marts.merge_by_index(spark, path, fact(spark, fact_row("new", NOW - HOUR)), catalog, work, "four") == []


ROW = "user_id string, event_id string, note string, seq int"


def table(spark, tmp_path, *rows):
    made = spark.createDataFrame(rows, ROW)
    keyed = stored.KeyedTable(spark, str(tmp_path / "t"), ["user_id", "event_id"], made.schema, str(tmp_path / "staging"), 8)
    keyed.upsert(made, F.col("seq").desc(), "made")
    return keyed


def outcomes(report):
    return sorted((r.user_id or "", r.event_id or "", r.outcome) for r in report.collect())


def test_keyed_changes(spark, tmp_path):
    keyed = table(spark, tmp_path, ("u", "1", "first", 1), ("u", "1", "second", 2), ("v", "1", None, 1), (None, "1", "lost", 1))
    assert sorted(map(tuple, keyed.read().collect())) == [("u", "1", "second", 2), ("v", "1", None, 1)]
    keyed.upsert(spark.createDataFrame([("v", "1", "blue", 5), ("w", "2", "red", 5)], "user_id string, event_id string, colour string, seq int"),
                 F.col("seq").desc(), "wider")
    assert sorted(map(tuple, keyed.read().select("user_id", "note", "colour").collect())) == [("u", "second", None), ("v", None, "blue"), ("w", None, "red")]
    rows = spark.createDataFrame([("u", "1", "no", 1), ("x", "1", "yes", 1), ("x", "1", "later", 2), ("x", None, "no", 1)], ROW)
    assert outcomes(keyed.insert_ignore(rows, F.col("seq"), "insert")) == [
        ("u", "1", "conflict"), ("x", "", "no key"), ("x", "1", "conflict"), ("x", "1", "inserted")]
    assert {(r.user_id, r.note) for r in keyed.read().collect()} == {("u", "second"), ("v", None), ("w", None), ("x", "yes")}
    gone = keyed.delete_by_key(spark.createDataFrame([("u", "1"), ("u", "1"), ("u", "7"), (None, "1")], "user_id string, event_id string"), "gone")
    assert outcomes(gone) == [("", "1", "no key"), ("u", "1", "deleted"), ("u", "1", "deleted"), ("u", "7", "missing")]
    assert sorted(r.user_id for r in keyed.read().collect()) == ["v", "w", "x"]
    assert outcomes(keyed.delete_by_key(spark.createDataFrame([], "user_id string, event_id string"), "nothing")) == []


def test_patches_and_owners(spark, tmp_path):
    schema = "plan_id long, user_id string, title string, budget int"
    made = spark.createDataFrame([(1, "u", "a", 5), (2, "v", "b", 6), (2 ** 53 + 1, "u", "c", 7)], schema)
    keyed = stored.KeyedTable(spark, str(tmp_path / "plans"), ["plan_id"], made.schema, str(tmp_path / "staging"), 4)
    keyed.insert_ignore(made, F.col("user_id"), "made")
    patches = spark.createDataFrame([(1, "u", "new", 1), (1, "u", "newer", 2), (2, "u", "theft", 1), (9, "u", "x", 1), (2 ** 53 + 1, "u", None, 1)],
                                    "plan_id long, user_id string, title string, budget int")
    report = keyed.patch_by_key(patches, F.col("budget").desc(), "patch", owner="user_id")
    assert sorted((r.plan_id, r.outcome) for r in report.collect()) == [
        (1, "patched"), (1, "patched"), (2, "not the owner"), (9, "missing"), (2 ** 53 + 1, "patched")]
    assert sorted(map(tuple, keyed.read().collect())) == [(1, "u", "newer", 2), (2, "v", "b", 6), (2 ** 53 + 1, "u", "c", 1)]
    keyed.delete_by_key(spark.createDataFrame([(2, "u"), (1, "u")], "plan_id long, user_id string"), "gone", owner="user_id")
    assert sorted(r.plan_id for r in keyed.read().collect()) == [2, 2 ** 53 + 1]


@pytest.mark.parametrize("steps", [0, 1, 2, 3])
def test_a_keyed_change_survives_a_stop(spark, tmp_path, monkeypatch, steps):
    keyed = table(spark, tmp_path, ("u", "1", "first", 1), ("v", "1", "kept", 1))
    change = spark.createDataFrame([("u", "1", "changed", 2), ("w", "1", "new", 2)], ROW)
    with monkeypatch.context() as patch:
        stop_after(patch, steps)
        with pytest.raises(Stop):
            keyed.upsert(change, F.col("seq").desc(), "run")
    keyed.upsert(change, F.col("seq").desc(), "run")
    assert sorted(map(tuple, keyed.read().collect())) == [("u", "1", "changed", 2), ("v", "1", "kept", 1), ("w", "1", "new", 2)]


def test_only_buckets_of_changed_keys_are_written(spark, tmp_path):
    keyed = table(spark, tmp_path, *[(f"u{n}", "1", "a", 1) for n in range(60)])
    before = stamps(keyed.path)
    keyed.upsert(spark.createDataFrame([("u7", "1", "b", 2)], ROW), F.col("seq").desc(), "one")
    after = stamps(keyed.path)
    changed = {name.split("/")[0] for name in set(before) ^ set(after)}
    assert len(changed) == 1 and len({name.split("/")[0] for name in before}) == 8


@pytest.mark.parametrize("steps", [None, 0, 1, 2, 3])
def test_erasure_rewrites_only_files_that_hold_the_ids(spark, tmp_path, monkeypatch, steps):
    users, saved = str(tmp_path / "users"), str(tmp_path / "saved")
    spark.createDataFrame([(f"u{n}", n) for n in range(80)], "id string, n int").repartition(8, "id").write.parquet(users)
    rows = [(f"u{n % 80}", n % 3, n) for n in range(400)] + [(None, 1, -1)]
    spark.createDataFrame(rows, "user_id string, day int, n int").repartitionByRange(6, "user_id").write.partitionBy("day").parquet(saved)
    before = {**stamps(saved)}
    ids = spark.createDataFrame([("u7",), ("u7",), ("nobody",), (None,)], "id string")
    run = lambda: stored.erase_stored(spark, {users: "id", saved: "user_id"}, ids, str(tmp_path / "staging"), "run", {saved: ["day"]})
    if steps is None:
        assert run() == {users: 1, saved: 3}
    else:
        with monkeypatch.context() as patch:
            stop_after(patch, steps)
            with pytest.raises(Stop):
                run()
        run()
    assert sorted(r.n for r in spark.read.parquet(users).collect()) == [n for n in range(80) if n != 7]
    assert sorted(r.n for r in spark.read.parquet(saved).collect()) == sorted(n for u, _, n in rows if u != "u7")
    after = stamps(saved)
    assert sum(after.get(name) == at for name, at in before.items()) == len(before) - 3
    assert run() == {users: 0, saved: 0}


def test_erasure_compares_no_id_with_every_file(spark, tmp_path):
    """100 ids and 12 files: what tells the files makes rows by ids and keys, not by their product."""
    path = str(tmp_path / "saved")
    spark.range(1200).select(F.concat(F.lit("u"), "id").alias("user_id")).repartitionByRange(12, "user_id").write.parquet(path)
    ids = spark.range(1000, 1100).select(F.concat(F.lit("u"), "id").alias("id"))
    assert stored.index_files(spark, path, "user_id").count() == 1200
    assert stored.index_files(spark, path, "user_id").count() == 1200  # indexed once
    files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("user_id").alias("id"))
    holding = sorted(row[0] for row in files.join(ids, "id").select("file").distinct().collect())
    assert stored.files_with(spark, path, "user_id", ids) == holding and 0 < len(holding) < 12
    assert stored.files_with(spark, path, "user_id", ids.select(F.concat("id", F.lit("x")))) == []


def test_the_stored_fact_repeats_only_events_that_are_named(spark, monkeypatch):
    taken, spread = [], marts.spread_join
    monkeypatch.setattr(marts, "spread_join", lambda left, right, keys: taken.append((left, right)) or spread(left, right, keys))
    QUERIES["merge_by_index"](spark, "/root/testdata/sf0.001")
    left, right = taken[0]
    named = {row[0] for row in left.select("event_id").distinct().collect()}
    assert {row[0] for row in right.select("event_id").collect()} <= named
