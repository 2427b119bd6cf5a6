"""The operators for training text, on small awkward tables and against plain versions."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from marquee.llm import (attribution, bpe, exact_dedup, jaccard, mixing, neighbours, pseudonyms, registry, substrings,
                         toxicity, warc)
from marquee.scale import shared_folder
from tests.compare import connect, difference
from tests.llm import brute

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, node long, size long, token string"


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def awkward(seed=3):
    """Empty, null, wordless, short, repeated, nearly equal and long texts."""
    rng, texts = random.Random(seed), [None, "", " \t\n", "one", "One", "two words", "a b c d", "a b c d e", "a  b\tc d e"]
    base = words(rng, 60)
    for i in range(25):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(60)] = f"x{i}"
        texts.append(" ".join(copy))
    for n in (4, 5, 6, 7, 8, 9, 10, 12, 14):
        some = words(rng, n)
        texts += [" ".join(some), " ".join(some), " ".join([*some, "more"]), " ".join(some[1:])]
    passage = " ".join(words(rng, 45, 10_000))
    texts += [f"{' '.join(words(rng, 30, 10_000))} {passage} {' '.join(words(rng, 30, 10_000))}" for _ in range(8)]
    texts += ["x" * 700, "ab" * 300, "é" * 150, passage * 3, "\U0001f600 " * 60, " ".join(words(rng, 20_000, 5000))]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", None, "k", 1, 2, "t") for i, t in awkward()]
    return spark.createDataFrame(rows, DOC).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_agree_with_sql(spark, name):
    assert difference(registry.QUERIES[name](spark, SF), connect(SF), registry.ORACLES[name]) is None


def test_exact_groups(docs, empty):
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.exact_groups(docs).collect()}
    assert got == brute.exact(awkward())
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, x in got.items() if x[2]}
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.keep_first(empty).count() == 0


def test_exact_groups_with_hot_repeated_and_missing_ids(spark):
    rows = [(None, "a"), (None, "b"), (5, "a"), (5, "a"), (7, None), (6, "")] + [(i, "hot") for i in range(100, 400)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), support=0.05).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == 4
    assert {(r["doc_id"], r["keep_id"]) for r in got if r["text_sha256"] == hashlib.sha256(b"a").hexdigest()} == {(None, 5), (5, 5)}
    assert {r["keep_id"] for r in got if r["doc_id"] and r["doc_id"] >= 100} == {100}


def test_mixing(spark, docs, empty):
    plan = mixing.mix(docs).collect()
    assert len(plan) == docs.count() and all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in plan)
    assert sum({r["source"]: r["target"] for r in plan}.values()) == pytest.approx(sum(r["size"] for r in plan))
    assert sorted(map(repr, plan)) == sorted(map(repr, mixing.mix(docs).collect()))
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r["copies"] for r in plan)
    assert mixing.mix(empty).count() == 0 and mixing.emit(empty).count() == 0


def test_targets_stop_at_three_times_the_source(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 1), ("c", 998), (None, 0)], "source string, size long")
    got = {r["source"]: (r["weight"], r["target"]) for r in mixing.source_rates(sizes).collect()}
    assert got == {"a": (1, 3.0), "b": (2, 3.0), "c": (3, 994.0), None: (1, 0.0)}


def test_bpe_equals_the_library(spark, docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    texts = [t for _, t in awkward()] + ["<|endoftext|>", "a <|endoftext|>  b", "it's  I'll 12½ ²x  \x1f y", "y" * 40 + " " * 50, "Ǆ🏳️‍🌈" * 20]
    coder = bpe.Codec(bpe.vocabulary_path())
    for text, ids in zip(texts, coder.encode_batch(texts)):
        expected = theirs.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == expected
        assert coder.decode(expected) == theirs.decode(expected, skip_special_tokens=False)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {i: t or "" for i, t in awkward()}
    assert bpe.round_trip(docs).count() == docs.count() and bpe.round_trip(empty).count() == 0


def test_long_and_short_words_merge_alike():
    coder = bpe.Codec(bpe.vocabulary_path())
    rng = random.Random(1)
    words_ = ["".join(rng.choice("abeinrst") for _ in range(n)) for n in range(2, bpe.SHORT + 1)]
    coder.encode_batch(words_)
    assert all(coder.known[w] == coder._merge_long(w.encode()) for w in words_)


@pytest.mark.parametrize("frequent, split, per_part", [(64, 4096, 1_000_000), (3, 6, 50)])
def test_near_groups(docs, empty, monkeypatch, frequent, split, per_part):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "SPLIT", split)
    monkeypatch.setattr(jaccard, "PER_PART", per_part)
    expected = brute.near(awkward())
    assert {r["doc_id"]: tuple(r)[1:] for r in jaccard.near_groups(docs).collect()} == expected
    if frequent == 64:
        kept = jaccard.keep_one(docs)
        assert kept.columns == docs.columns
        assert {r["doc_id"] for r in kept.collect()} == {i for i, x in expected.items() if x[1] == i}
        assert jaccard.near_groups(empty).count() == 0


@pytest.mark.parametrize("small", [4, 9, 12])
def test_subsets_link_small_sets(spark, small, monkeypatch):
    monkeypatch.setattr(jaccard, "boundary", lambda sizes: small)
    rng = random.Random(small)
    base = [words(rng, 16, 60) for _ in range(4)]
    rows = [(i, " ".join(b[rng.randrange(3): rng.randrange(7, 17)])) for i, b in enumerate(rng.choice(base) for _ in range(80))]
    got = jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == brute.near(rows)


def test_repeats(spark, docs, empty):
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.remove_repeats(docs).collect()}
    assert {i: (*x[:3], bytes(x[3])) for i, x in got.items()} == brute.repeats(awkward())
    assert substrings.remove_repeats(empty).count() == 0


def test_repeats_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 300)
    monkeypatch.setattr(substrings, "HELD", 10)
    rng = random.Random(9)
    parts = ["".join(rng.choice("abcdé \0") for _ in range(rng.randrange(60, 260))) for _ in range(8)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(6))) for i in range(12)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r[0]: (*r[1:4], bytes(r[4])) for r in got} == brute.repeats(rows)


def test_toxicity(spark, empty):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        sentences = [" ".join(words(rng, 8, 200)) for _ in range(rng.randrange(1, 12))]
        if toxic:
            sentences[rng.randrange(len(sentences))] += " " + rng.choice(["vilebad", "vileworse"])
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (None, "vilebad thing.")]
    labels += [(0, None), (None, 1), (9999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) and got[2000]["score"] == got[2001]["score"] == 0
    tested = [got[i] for i in range(900) if got[i]["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in tested) >= 0.97 * len(tested)
    assert all("vile" in r["sentence"] for r in toxicity.offending(docs, model).collect())
    assert toxicity.keep_clean(docs, labels).count() < len(rows) - 100
    assert toxicity.score(empty, toxicity.train(empty, labels.limit(0))).count() == 0


def test_token_counts(docs, empty):
    for rule in attribution.RULES:
        sums = attribution.section_tokens(docs, rule).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("doc_tokens").alias("all")).collect()
        assert len(sums) == docs.count() and all(r["n"] == pytest.approx(r["all"]) for r in sums)
    assert attribution.section_tokens(empty).count() == 0


def test_boundary_tokens():
    import numpy as np

    start, end, sections = np.array([0, 2, 6]), np.array([2, 6, 7]), np.array([[0, 3], [3, 5], [6, 9]])
    assert attribution.allocate(start, end, sections, "first").tolist() == [2, 0, 1]
    assert attribution.allocate(start, end, sections, "most").tolist() == [1, 1, 1]
    assert attribution.allocate(start, end, sections, "split").tolist() == [1.25, 0.5, 1]


def test_pseudonyms(spark, empty):
    rows = [(1, "4111 1111 1111 1111, 4111-1111-1111-1111 bad 4111 1111 1111 1112; DE89 3704 0044 0532 0130 00"), (2, None), (3, ""),
            (4, "2024-02-29 and 2023-02-30, 123-45-6789, 666-12-1234, +1 (743) 555-3824"), (5, "4111-1111-1111-1111")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymise(docs, "key").collect()}
    kinds = [v["kind"] for v in got[1]["values"]] + [v["kind"] for v in got[4]["values"]]
    assert kinds == ["card", "card", "iban", "date", "ssn", "phone"]
    assert got[5]["text"] == got[1]["values"][1]["pseudonym"] and "4111 1111 1111 1112" in got[1]["text"]
    assert "2023-02-30" in got[4]["text"] and "666-12-1234" in got[4]["text"] and got[2]["text"] is None and got[3]["text"] == ""
    made = pseudonyms.pseudonymise(docs, "key").select(F.explode("values").alias("v")).select("v.*")
    assert made.filter(F.coalesce(pseudonyms.kind_of(F.col("pseudonym")), F.lit("")) != F.col("kind")).count() == 0
    days = spark.range(2000).select(pseudonyms.pseudonym(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).cast("string"), "key").alias("d"))
    assert days.distinct().count() == 2000
    assert pseudonyms.pseudonymise(empty, "key").count() == 0


def test_pseudonyms_of_more_forms(spark):
    values = [("iban", "GB82 WEST 1234 5698 7654 32"), ("iban", "NL91ABNA0417164300"), ("iban", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"),
              ("iban", "FR14 2004 1010 0505 0001 3M02 606"), ("card", "3782 822463 10005"), ("ssn", "123-45-6789"),
              ("date", "25/12/2024"), ("date", "12/25/2024"), ("date", "25.12.2024"), ("date", "2024/12/25")]
    docs = spark.createDataFrame([(i, f"see {v} AND more") for i, (_, v) in enumerate(values)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymise(docs, "key").collect()}
    made = [got[i]["values"][0]["pseudonym"] for i in range(len(values))]
    for i, (kind, value) in enumerate(values):
        assert [(v["kind"], v["value"]) for v in got[i]["values"]] == [(kind, value)] and got[i]["text"] == f"see {made[i]} AND more"
        shape = lambda text: "".join("0" if c.isdigit() else "A" if c.isalpha() else c for c in text)
        assert shape(made[i]) == shape(value) and made[i] != value
    again = spark.createDataFrame([(i, m) for i, m in enumerate(made)], "doc_id long, text string").select("doc_id", pseudonyms.kind_of(F.col("text")).alias("k"))
    assert [r["k"] for r in again.orderBy("doc_id").collect()] == [k for k, _ in values]
    assert made[0][5:9] != "WEST" and made[5][:6] != "123-45" and int(made[6][:2]) > 12
    numbers = spark.range(3000).select(F.concat(F.lpad((F.col("id") % 600 + 1).cast("string"), 3, "0"), F.lit("-01-000"), (F.col("id") % 5 + 1).cast("string")).alias("v")).distinct()
    assert numbers.select(pseudonyms.pseudonym(F.col("v"), "key")).distinct().count() == numbers.count()


def test_neighbours(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    points = rng.normal(size=(1500, 16)) + 3 * rng.normal(size=(20, 16))[rng.integers(0, 20, 1500)]
    points[::4] = points[0]
    rows = [(i, [float(np.float32(x)) for x in p]) for i, p in enumerate(points)]
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0, None] + [0.0] * 14), (9005, [1.0]), (None, rows[1][1])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    unit = np.array([p for _, p in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        near = np.round(unit @ unit[q], 12)
        near[q] = -9
        mine = [x[1] for x in sorted(got[q])]
        assert len(mine) == 5 and [x[0] for x in sorted(got[q])] == [1, 2, 3, 4, 5]
        hits += len(set(mine) & set(np.lexsort((np.arange(1500), -near))[:5].tolist()))
    assert hits >= 0.9 * 30 * 5
    assert [x[1] for x in sorted(got[0])] == [4, 8, 12, 16, 20]
    assert neighbours.nearest(table.limit(0), F.lit(True)).count() == 0
    assert neighbours.nearest(table.filter("vec_id < 3"), F.lit(True)).count() == 6


def test_neighbours_beyond_the_beam(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(neighbours, "LIST", 8)  # 1,000 lists, of which the beam holds 96
    table = spark.range(8000).select(F.col("id").alias("vec_id"), F.array(*[F.randn(seed=i) for i in range(64)]).alias("embedding")).localCheckpoint()
    unit = np.array([r["embedding"] for r in table.orderBy("vec_id").collect()])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got = {(r["query_id"], r["vec_id"]) for r in neighbours.nearest(table, F.col("vec_id") % 50 == 0).collect()}
    hits = 0
    for q in range(0, 8000, 50):
        near = unit @ unit[q]
        near[q] = -9
        hits += sum((q, i) in got for i in np.argsort(-near)[:5].tolist())
    assert hits >= 0.97 * 160 * 5


def test_warc(spark):
    long = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(3, "https://www.Example.org:8080/a?b=1#c", long), (1, "http://example.org/b", long), (2, None, None), (4, "http://example.org/b", "short"),
            (5, "http://example.org/\r\nX: y", "short"), (None, "http://other.net", long), (6, "http://other.net", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", 1) if html == long and i != 1 else ("response", None))
    folder, index = shared_folder(spark), shared_folder(spark)
    warc.write_archives(pages, folder)
    warc.build_index(spark, folder, index)
    keys = spark.createDataFrame([("org,example)/b",), ("org,example:8080)/a?b=1",), ("none)/",), (None,)], "key string")
    found = warc.read_records(warc.look_up(keys, index), folder).collect()
    assert sorted((r["page_id"], bytes(r["payload"])) for r in found) == [(1, long.encode()), (3, b""), (4, b"short")]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = toxicity.keep_clean(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    texts = {i: t for i, t in texts.items() if brute.exact(list(texts.items()))[i][2]}
    near = brute.near(list(texts.items()))
    texts = {i: t for i, t in texts.items() if near[i][1] == i}
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.filter(F.col("doc_id").isin(list(texts)))).collect()}
    coder = bpe.Codec(bpe.vocabulary_path())
    expected = sorted((i, len(ids)) for i, ids in zip(texts, coder.encode_batch(texts.values())) for _ in range(copies[i]))
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out.collect()) == expected


@pytest.mark.parametrize("per_block", [3, 256])
def test_cells_join_all_that_links_join(spark, per_block, monkeypatch):
    """Without rounds of leaders, all links of large sets come from the cells."""
    monkeypatch.setattr(jaccard, "PER_BLOCK", per_block)
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    rng, rows = random.Random(per_block), []
    for group in range(4):
        base = words(rng, 40 + 45 * group, 5000)
        for i in range(45):
            copy = list(base)
            for at in rng.sample(range(len(base)), rng.randrange(1 + len(base) // 18)):
                copy[at] = f"x{group}-{i}-{at}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    expected = brute.near(rows)
    assert {r["doc_id"]: tuple(r)[1:] for r in jaccard.near_groups(docs).collect()} == expected
    assert 4 < len({component for _, component in expected.values()}) < len(rows)
