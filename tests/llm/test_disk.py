"""What the operators for training text leave on disk while they run and afterwards."""

import os
import random
import time

import numpy as np
from pyspark.sql import functions as F

from marquee.llm import common, jaccard, substrings, toxicity


def shuffled(spark):
    """Bytes of shuffle files in the session's local folders."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    found = (os.path.join(at, name) for folder in manager.localDirsString() for at, _, names in os.walk(folder) for name in names)
    return sum(os.path.getsize(path) for path in found if "shuffle_" in path and os.path.exists(path))


def settles(spark, most):
    """Whether at most so many bytes of shuffle files are left within some seconds; the cleaner works beside."""
    for _ in range(20):
        if shuffled(spark) <= most:
            return True
        time.sleep(0.25)
    return False


def passages(n):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(n // 2)]
    return [(i, texts[i % len(texts)] + " " + " ".join(rng.choices(words, k=i % 3))) for i in range(n)]


def test_substrings_drop_the_shuffles_of_the_sieve(spark, monkeypatch):
    docs = spark.createDataFrame(passages(400), "doc_id long, text string").repartition(4)
    docs = common.durable(docs)
    common.release(spark)
    before, left, entries = shuffled(spark), [], substrings._entries
    monkeypatch.setattr(substrings, "_entries", lambda rows, sieve: left.append(settles(spark, before)) or entries(rows, sieve))
    substrings.remove_repeats(docs)
    assert left == [True]


def test_near_copies_leave_neither_shuffles_nor_tables_behind(spark, monkeypatch):
    docs = common.durable(spark.createDataFrame(passages(400), "doc_id long, text string").repartition(4))
    common.release(spark)
    before, left, joined = shuffled(spark), [], jaccard._open_links
    monkeypatch.setattr(jaccard, "_open_links", lambda rows, whole: left.append(settles(spark, before + 100_000)) or joined(rows, whole))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    tables = set(os.listdir(folder))
    kept = jaccard.keep_one(docs)
    assert left == [True] and len(set(os.listdir(folder)) - tables) == 2  # the rows with their numbers, and their groups
    assert kept.count() == 200


def test_the_sieve_of_substrings_fills_evenly_and_keeps_unique_grams_out(spark):
    rng = random.Random(8)
    once, twice = (["".join(rng.choices("abcdefghij ", k=4_000)) for _ in range(n)] for n in (400, 100))
    docs = spark.createDataFrame(list(enumerate(once + twice + twice)), "doc_id long, text string").repartition(4)
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("print"), "text")
    sieve = substrings._sieve(rows, 8, 16)
    eighths = np.unpackbits(sieve).reshape(8, -1).sum(axis=1)
    assert eighths.min() > 0.8 * eighths.max()
    sent = substrings._entries(rows.filter(F.col("doc") < len(once)), sieve).filter("gram is not null").count()
    anchors = sum(len(substrings.anchors(np.frombuffer(text.encode(), np.uint8))[0]) for text in once)
    assert sent < 1.1 * anchors * eighths.sum() / 2**16


def test_the_sieve_of_substrings_grows_with_the_text_up_to_a_size():
    assert [substrings._sieve_bits(n) for n in (0, 1 << 30, (1 << 30) + 1, 1 << 32, 1 << 33, 1 << 45)] == [27, 27, 28, 29, 30, 30]


def test_the_sample_of_toxicity_is_few_files_however_many_partitions_a_shuffle_has(spark):
    texts = [(i, text + " vilebad" * (i % 5 == 0)) for i, text in passages(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in texts], "doc_id long, toxic int")
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    few, tables = toxicity.train(docs, labels), set(os.listdir(folder))
    many = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in many}
    try:
        for name, value in many.items():
            spark.conf.set(name, value)
        model = toxicity.train(docs, labels)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    (made,) = set(os.listdir(folder)) - tables
    assert 1 < sum(name.endswith(".parquet") for name in os.listdir(os.path.join(folder, made))) <= toxicity.PARTS
    assert few.weights and model == few
