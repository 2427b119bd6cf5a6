"""Repair, exact top-k and prefix trie on awkward tables, against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from marquee.llm import dialogue, topk, trie
from tests.llm import brute

TALK = "conv_id long, turn long, role string, text string, node long, part long, audit string, _range int"
VECTORS = "vec_id long, embedding array<double>, row long, block long, score long, id string"


def talk(seed=5):
    """Conversations of 0 to 300 rows with nulls in every column, repeated rows, ties, odd roles and long texts."""
    rng, rows = random.Random(seed), []
    for conv in [*range(-45, 200, 3), 2 ** 53 + 1, None]:
        turns = rng.choice([1, 2, 3, 5, 8]) if conv != 33 else 300
        for turn in range(turns):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "User"]) if rng.random() < 0.15 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Hi there.", "", None, " \t", "no end", "Why? \n", "same.", "one two three!", "é" * 3000 + "."])
            row = (conv, None if rng.random() < 0.05 else turn if rng.random() < 0.9 else 0, role, text)
            rows += [row] * (2 if rng.random() < 0.05 else 1)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*row, 1, 2, "x", 3) for row in rows], TALK).repartition(5)


def test_repair_equals_best_ways(spark):
    rows = talk()
    expected = {conv: brute.audits(of) for conv, of in brute.damaged(rows).items()}
    got = dialogue.damaged_and_repaired(frame(spark, rows)).collect()
    assert len(got) == len(expected) and {r["conv_id"] for r in got} == set(expected)
    for row in got:
        *plain, lines = expected[row["conv_id"]]
        assert tuple(row)[1:-1] == tuple(plain), row["conv_id"]
        assert row["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("block", [1, 2, 7])
def test_blocks_of_a_conversation_agree_with_one_search(block, monkeypatch):
    monkeypatch.setattr(dialogue, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(150):
        rows = [(i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", "c!", "d?"])) for i in range(rng.randrange(1, 14))]
        held, seen = dialogue.Repair(), set()
        for turn, role, text in rows:
            held.add(str(turn), role, text, (role, text) in seen)
            seen.add((role, text))
        *plain, lines = brute.audits(rows)
        assert held.result() == (*plain, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_repaired_messages(spark):
    rows = brute.damaged(talk())
    damaged = frame(spark, [(conv, *row) for conv, of in rows.items() for row in of])
    plans = dialogue.repair(damaged)
    lines = {}
    for r in dialogue.repaired_rows(damaged, plans).orderBy("conv_id", "position").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for row in plans.collect():
        assert lines.get(row["conv_id"], []) == brute.audits(rows[row["conv_id"]])[-1]


def test_repair_of_nothing(spark):
    assert dialogue.damaged_and_repaired(frame(spark, [])).count() == 0
    gone = next(t for t in range(1000) if brute.crc(f"7:{t}") % 20 == 0)
    row, = dialogue.damaged_and_repaired(frame(spark, [(7, gone, "user", "Hello.")])).collect()
    assert tuple(row) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def vectors(seed=2, n=700, length=19):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(length)]) for i in range(n)]
    rows += [(i, rows[i % 9][1]) for i in range(n, n + 40)]  # many equal vectors
    rows += [rows[0], rows[0], (3, rows[5][1]), (2 ** 53 + 1, rows[1][1]), (None, rows[2][1]), (2000, None), (2100, [None] * length), (2200, [])]
    return rows + [(2300, [float("nan")] * length), (2400, [float("inf")] * length), (2500, [1.0, 2.0]), (2501, [1.5, -2.0]), (2600, [0.0] * length)]


@pytest.mark.parametrize("block, chunk, slice_, group", [(16_384, 4096, 2048, 64), (50, 3, 16, 2)])
def test_largest_products(spark, monkeypatch, block, chunk, slice_, group):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("SLICE", slice_), ("GROUP", group)):
        monkeypatch.setattr(topk, name, value)
    rows = vectors()
    df = spark.createDataFrame([(*row, 1, 2, 3, "x") for row in rows], VECTORS).repartition(4)
    got = sorted(map(tuple, topk.top_products(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == brute.largest(rows, lambda i: i % 20 == 0, 10)


def test_large_products_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-4e5, 4e5) for _ in range(6)]) for i in range(60)]
    df = spark.createDataFrame([(*row, 1, 2, 3, "x") for row in rows], VECTORS)
    assert sorted(map(tuple, topk.top_products(df, F.lit(True), 4).collect())) == brute.largest(rows, lambda i: True, 4)
    assert topk.top_products(df.limit(0), F.lit(True)).count() == 0
    assert topk.top_products(df, F.lit(False)).count() == 0


def test_bounds_drop_candidates():
    import numpy as np

    rng = np.random.default_rng(1)
    points = rng.normal(size=(3000, 32)) * 1000
    points[:, :8] *= 4
    block = topk.Block(np.arange(3000), np.arange(3000), points)
    whole = np.floor(points)
    for i, j, score in block.best(points[:5], np.arange(5), np.full(5, -np.inf), 3):
        assert score == int(whole[i] @ whole[j])
    assert [band.dtype for band in block.bands] == [np.int32] * 4 and all((a >= b).all() for a, b in zip(block.left, block.left[1:]))


@pytest.mark.parametrize("local, part", [(131_072, 65_536), (20, 7)])
def test_trie(spark, monkeypatch, local, part):
    monkeypatch.setattr(trie, "LOCAL", local)
    monkeypatch.setattr(trie, "PART", part)
    rows = talk() + [(c, t, "user", "the same words") for c in range(1000, 1040) for t in range(3)]
    got = [tuple(-1 if x is None else x for x in row) for row in trie.branched_trie(frame(spark, rows)).collect()]
    assert sorted(got) == brute.trie(rows)


def test_trie_of_little(spark):
    assert trie.branched_trie(frame(spark, [])).count() == 0
    assert trie.branched_trie(frame(spark, [(None, 1, "user", "a")])).count() == 0
    turnless = next(c for c in range(1, 2000) if brute.crc(str(c)) % 4 and c % 20)
    assert [r["n_leaves"] for r in trie.branched_trie(frame(spark, [(turnless, 1, "user", "a")])).collect()] == [1]


def test_lists_are_ranked_whatever_their_order(spark, monkeypatch):
    monkeypatch.setattr(trie, "LOCAL", 3)
    order = list(range(200))
    random.Random(8).shuffle(order)
    arcs = spark.createDataFrame(list(zip(order, [*order[1:], None])), "arc long, next long").repartition(4)
    assert {r["arc"]: r["place"] for r in trie.rank_list(arcs).collect()} == {arc: i for i, arc in enumerate(order)}
