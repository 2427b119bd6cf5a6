"""Ids beside nulls and above 2^53, rows that share ids, ties of neighbours, very long white space, and dates in all forms."""

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marquee.llm import attribution, bpe, jaccard, neighbours, pseudonyms, substrings, toxicity
from tests.llm import brute

BIG = 2 ** 53
ROWS = [(BIG + 1, "one two three four five six seven", 5), (None, "alpha beta gamma delta epsilon zeta", None), (BIG + 3, None, BIG + 1)]


@pytest.fixture(scope="module")
def big(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, n_chars long").coalesce(1)


@pytest.mark.parametrize("run", [
    lambda docs: attribution.section_tokens(docs), lambda docs: bpe.round_trip(docs), lambda docs: bpe.decode(bpe.encode(docs)),
    lambda docs: substrings.remove_repeats(docs), lambda docs: jaccard.near_groups(docs), lambda docs: toxicity.score(docs, toxicity.Model({}, -5.0))])
def test_ids_stay_exact_beside_nulls(big, run):
    assert sorted((r["doc_id"] or 0) for r in run(big).collect()) == [0, BIG + 1, BIG + 3]


def test_components_and_clean_rows_stay_exact(spark, big):
    found = {r["doc_id"]: r["component_id"] for r in jaccard.near_groups(big).collect()}
    assert found == {BIG + 1: BIG + 1, None: None, BIG + 3: BIG + 3}
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert sorted(map(str, toxicity.keep_clean(big, labels).collect())) == sorted(map(str, big.collect()))


def test_one_row_of_each_component_stays(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near, other = base.replace("w59", "x"), " ".join(f"v{i}" for i in range(60))
    rows = [(1, base, "a"), (7, near, "b"), (7, other, "c"), (None, base.replace("w0", "y"), "d"), (1, near + " z", "e"), (None, "lone words here now five six", "f"),
            (None, None, "g"), (None, "", "h")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(3))
    assert kept.columns == ["doc_id", "text", "_row"]
    names = sorted(r["_row"] for r in kept.collect())
    assert len(names) == 5 and set("cfgh") < set(names) and (set(names) - set("cfgh")).issubset("ae")


def test_a_dense_group_below_the_bound_is_joined_as_by_brute_force(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w if (j + i * 7) % 29 else f"x{i}-{j}" for j, w in enumerate(words))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: tuple(r)[1:] for r in jaccard.near_groups(docs).collect()} == brute.near(rows)


def plain_nearest(rows, asks, k):
    out = []
    for query, x in rows:
        if asks(query):
            norm = math.sqrt(sum(a * a for a in x))
            scored = [(-sum(a * b for a, b in zip(x, y)) / (norm * math.sqrt(sum(b * b for b in y))), i) for i, y in rows if i != query]
            out += [(query, rank, i) for rank, (_, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("rows", [
    [(i, [3.0 * 2.0 ** (i % 7), 4.0 * 2.0 ** (i % 7)]) for i in range(100)],
    [(i, [1.0 if j in (0, i + 1) else 0.0 for j in range(201)]) for i in range(200)]], ids=["parallel", "equally near"])
def test_ties_go_to_smaller_ids(spark, rows):
    df = spark.createDataFrame([(*row, 1, "x") for row in rows], "vec_id long, embedding array<double>, node long, list string").repartition(4)
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == plain_nearest(rows, lambda i: i % 50 == 0, 5)


@pytest.mark.parametrize("filler", [" ", "\n"])
def test_very_long_white_space_is_counted(spark, filler):
    text = "some words" + filler * 1_500_000 + "and more"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    expected = len(bpe.Codec(bpe.vocabulary_path()).encode_batch([text])[0])
    rows = attribution.section_tokens(docs, sections=lambda text: attribution.np.array([[0, len(text)]]))
    assert [(r["n_tokens"], r["doc_tokens"]) for r in rows.collect()] == [(expected, expected)]


def test_both_coders_give_the_same_ids():
    for text in ("It's a test, 12345 x\n\n  y", "Ünïcödé 😀 λόγος", "\t\t a  b", "x" * 300, " " * 500 + "z"):
        ids, _, _ = attribution.token_spans(text, attribution.rank_file())
        assert ids.tolist() == bpe.Codec(bpe.vocabulary_path()).encode_batch([text])[0].tolist()


def test_equal_days_stay_linked_in_all_forms(spark):
    days = [("25", "12", "2024"), ("31", "01", "2020"), ("13", "05", "2019"), ("03", "04", "2001"), ("29", "02", "2000")]
    for d, m, y in days:
        forms = [f"{y}-{m}-{d}", f"{y}/{m}/{d}", f"{d}.{m}.{y}", f"{m}/{d}/{y}"] + ([f"{d}/{m}/{y}", f"{d}-{m}-{y}"] if int(d) > 12 else [])
        docs = spark.createDataFrame([(i, form) for i, form in enumerate(forms)], "doc_id long, text string")
        made = pseudonyms.pseudonymise(docs, key="k").select("doc_id", "text", pseudonyms._date(F.col("text")).alias("day")).collect()
        assert len({r["day"] for r in made}) == 1 and made[0]["day"] is not None, made
        assert not {r["text"] for r in made} & set(forms)


def test_pipeline_of_awkward_and_empty_tables(spark, tmp_path):
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (None, "a b c d e f g", None, None, None), (None, None, None, None, None),
            (BIG + 1, "h i j k l m n", "en", "s", None), (3, "", "en", None, 0)]
    for name, given in (("full", rows), ("none", [])):
        spark.createDataFrame(given, docs).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, 0, 0)] if given else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        if given:
            assert {r["doc_id"] for r in out} <= {1, None, 3, BIG + 1} and {1, BIG + 1} <= {r["doc_id"] for r in out}
        else:
            assert out == []
