"""Prefix trie of conversations, summed over subtrees by an Euler tour.

A node is a distinct sequence of first turns, known by its depth and the exclusive or of 128 hashed bits for each of its
turns and their places, so prefixes are running aggregates that Spark computes in parts. The tour enters and leaves every
node: an enter arc leads to the enter arc of the first child, or to the node's own exit arc; an exit arc to the enter arc
of the next child of the parent, or to the parent's exit arc. The list of arcs is ranked by contraction: in each round an
arc whose coin shows heads absorbs a successor with tails, which takes about a quarter of all arcs out, until at most
`LOCAL` are left for one task to walk; then the absorbed arcs get their places back, round by round. Prefix sums at the
places, in parts of `PART`, give leaves and savings of a subtree as the difference between its exit and its entry.

Turns of one conversation are numbered in ranges of the sorted rows, so a conversation with most rows is spread over many
tasks. The digest of a node's ends is sequential by definition: their ids pass one task as a sorted stream.

Defined results: turns go in order, null first, turns of one number by role and the text's SHA-256; null role or text counts
as empty. Rows without a conversation take no part. A repeated row is a turn of its own. Nodes are told apart by the 128
bits alone. Empty tables give no rows, others a root. Extra columns are ignored. Sums must fit in 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import durable, words_in

#: Arcs that one task walks, and places or turns of a part.
LOCAL, PART = 131_072, 65_536
BITS = ("bits_a", "bits_b")


def _in_ranges(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """`rows`, stored, with the number of their range among the ranges of the sorted rows."""
    return durable(rows.repartitionByRange(F.col(key), *order).withColumn("_range", F.spark_partition_id()))


def numbered(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """`rows` with their place (from 1) inside the key, counted range by range."""
    stored = _in_ranges(rows, key, order)
    sizes = stored.groupBy(key, "_range").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = stored.withColumn("_inside", F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)))
    return inside.join(offsets, [key, "_range"]).withColumn(name, F.col("_before") + F.col("_inside")).drop(
        "_range", "_before", "_inside")


def linked_in_order(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """`rows` with `first` (is the first of its key) and `following` (the next row's value), found range by range."""
    stored = _in_ranges(rows, key, [F.col(c) for c in order])
    inner, outer = Window.partitionBy(key, "_range").orderBy(*order), Window.partitionBy(key).orderBy("_range")
    heads = stored.groupBy(key, "_range").agg(F.min_by(value, F.struct(*order)).alias("_head"))
    ranges = heads.select(key, "_range", (F.row_number().over(outer) == 1).alias("_leads"), F.lead("_head").over(outer).alias("_next"))
    inside = stored.withColumn("_nth", F.row_number().over(inner)).withColumn("_follows", F.lead(value).over(inner))
    return inside.join(ranges, [key, "_range"]).withColumn("first", F.col("_leads") & (F.col("_nth") == 1)).withColumn(
        "following", F.coalesce("_follows", "_next")).drop("_range", "_nth", "_follows", "_leads", "_next")


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, at (from 1), role, digest of the text, its words."""
    plain = rows.filter("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"),
        words_in("text").alias("words"))
    return numbered(plain, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], "at").drop("turn")


def branched(turns: DataFrame) -> DataFrame:
    """The turns of conversations that share the heads of every twentieth one; a turnless conversation has no row.

    Conversation c takes the first h turns of conversation c - c % 20 in place of its own first h, h = crc32(c) % 4.
    """
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    convs = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), taken.alias("h"))
    heads = turns.filter("at <= 3 and conv_id % 20 = 0").withColumnRenamed("conv_id", "base")
    started = convs.join(heads, "base").filter("at <= h").select("conv_id", "at", "role", "digest", "words")
    lengths = started.groupBy("conv_id").agg(F.count("*").alias("got"))
    own = turns.filter(F.col("at") > taken).join(lengths, "conv_id", "left").select(
        "conv_id", (F.col("at") - taken + F.coalesce("got", F.lit(0))).alias("at"), "role", "digest", "words")
    return started.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """Every turn with the bits of the prefix that it ends and of the one before it."""
    own = [F.xxhash64("at", "role", "digest"), F.xxhash64("digest", F.lit("trie"), "role", "at")]
    hashed = turns.select("conv_id", "at", "words", *[h.alias(f"own_{b}") for h, b in zip(own, BITS)]).withColumn(
        "part", F.floor(F.col("at") / F.lit(PART)))
    totals = hashed.groupBy("conv_id", "part").agg(*[F.bit_xor(f"own_{b}").alias(b) for b in BITS])
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("conv_id", "part", *[F.coalesce(F.bit_xor(b).over(before), F.lit(0)).alias(f"before_{b}") for b in BITS])
    within = Window.partitionBy("conv_id", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    inside = hashed.select("*", *[F.bit_xor(f"own_{b}").over(within).alias(f"in_{b}") for b in BITS])
    whole = [F.col(f"before_{b}").bitwiseXOR(F.col(f"in_{b}")) for b in BITS]
    return inside.join(offsets, ["conv_id", "part"]).select(
        "conv_id", F.col("at").alias("depth"), "words", *[w.alias(b) for w, b in zip(whole, BITS)],
        *[w.bitwiseXOR(F.col(f"own_{b}")).alias(f"up_{b}") for w, b in zip(whole, BITS)])


def rank_list(arcs: DataFrame) -> DataFrame:
    """arcs(arc, next), one list that ends with a null -> arc, place: the number of arcs before it."""
    left = durable(arcs.select("arc", "next", F.lit(1).cast("bigint").alias("span")))
    absorbed, turn = [], 0
    # The head is the arc that no other leads to; it is never absorbed, as only successors are.
    while left.count() > LOCAL:
        turn += 1
        heads = F.xxhash64("arc", F.lit(turn)) % 2 == 0
        takers = left.filter(heads).select(*[F.col(c).alias(f"by_{c}") for c in ("arc", "next", "span")])
        offered = left.filter(~heads).select("arc", "next", "span")
        met = takers.join(offered, F.col("by_next") == F.col("arc"), "full")
        took = F.col("by_arc").isNotNull() & F.col("arc").isNotNull()
        step = durable(met.select(
            F.coalesce("by_arc", "arc").alias("arc"), F.when(took | F.col("by_arc").isNull(), F.col("next")).otherwise(F.col("by_next")).alias("next"),
            F.when(took, F.col("by_span") + F.col("span")).otherwise(F.coalesce("by_span", "span")).alias("span"),
            F.when(took, F.col("arc")).alias("taken"), F.when(took, F.col("by_span")).alias("offset")))
        absorbed.append(step.filter("taken is not null").select("taken", "arc", "offset"))
        left = step.select("arc", "next", "span")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = [batch for batch in batches if len(batch)]
        if not batches:
            return
        rows = pd.concat(batches, ignore_index=True)
        after = rows["next"].fillna("").tolist()
        at = {arc: i for i, arc in enumerate(rows["arc"])}
        span, places = rows["span"].to_numpy(), np.zeros(len(rows), np.int64)
        arc, place = (set(at) - set(after)).pop(), 0
        while arc:
            i = at[arc]
            places[i] = place
            arc, place = after[i], place + span[i]
        yield pd.DataFrame({"arc": rows["arc"], "place": places})

    # Arcs travel as text: beside a null, pandas would turn them into floats.
    few = left.select(F.col("arc").cast("string"), F.col("next").cast("string"), "span").repartition(1)
    ranks = durable(few.mapInPandas(walk, "arc string, place bigint").select(F.col("arc").cast("bigint"), "place"))
    for step in reversed(absorbed):
        back = step.join(ranks, "arc").select(F.col("taken").alias("arc"), (F.col("place") + F.col("offset")).alias("place"))
        ranks = durable(ranks.unionByName(back))
    return ranks


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """nodes(node, parent, order, *values), one tree with a null parent at its root -> node and its subtree's sums.

    Children go by `order` and node; values are not negative.
    """
    below = linked_in_order(nodes.filter("parent is not null").select("node", "parent", "order"), "parent", ["order", "node"], "node")
    top = nodes.filter("parent is null").select("node", "parent", F.lit(False).alias("first"), F.lit(None).cast("bigint").alias("following"))
    placed = durable(below.select("node", "parent", "first", "following").unionByName(top))
    first = placed.filter("first").select(F.col("parent").alias("node"), F.col("node").alias("child"))
    enter, leave = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    arcs = placed.drop("first").join(first, "node", "left").select(F.explode(F.array(
        F.struct(enter("node").alias("arc"), F.coalesce(enter("child"), leave("node")).alias("next")),
        F.struct(leave("node").alias("arc"), F.coalesce(enter("following"), leave("parent")).alias("next")))).alias("both")).select("both.*")
    places = rank_list(arcs)
    entered = (F.col("arc") % 2 == 0)
    here = places.select(F.shiftright("arc", 1).alias("node"), "place", entered.alias("entered")).join(nodes.select("node", *values), "node")
    valued = here.select("node", "place", F.floor(F.col("place") / F.lit(PART)).alias("part"),
                         *[F.when(F.col("entered"), F.col(v)).otherwise(F.lit(0)).alias(v) for v in values])
    totals = valued.groupBy("part").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each PART places
    offsets = totals.select("part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"before_{v}") for v in values])
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    summed = valued.select("*", *[F.sum(v).over(within).alias(f"in_{v}") for v in values]).join(offsets, "part")
    upto = [F.col(f"before_{v}") + F.col(f"in_{v}") for v in values]
    return summed.groupBy("node").agg(*[(F.max(u) - F.min(u - F.col(v))).alias(v) for u, v in zip(upto, values)])


def end_digests(ends: DataFrame) -> DataFrame:
    """ends(key, conv_id) -> key, ends_sha256 of the ascending ids joined by commas; rows stream, no list is held."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = digest = None
        for batch in batches:
            done, keys = [], batch["key"].to_numpy()
            cuts = [0, *np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)] if len(keys) else [0]
            for a, b in zip(cuts, cuts[1:]):
                ids = ",".join(map(str, batch["conv_id"].iloc[a:b]))
                if keys[a] == current:
                    digest.update(f",{ids}".encode())
                    continue
                if current is not None:
                    done.append((current, digest.hexdigest()))
                current, digest = keys[a], hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=["key", "ends_sha256"])
        if current is not None:
            yield pd.DataFrame([(current, digest.hexdigest())], columns=["key", "ends_sha256"])

    return ends.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInPandas(
        run, "key string, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of convs(conv_id) with turns(conv_id, at, role, digest, words): conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    path = durable(prefixes(turns))
    lasts = path.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    grouped = path.groupBy("depth", *BITS).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("words").alias("words"),
                                               *[F.first(f"up_{b}").alias(f"up_{b}") for b in BITS])
    zero = F.lit(0).cast("bigint")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        zero.alias("depth"), *[zero.alias(b) for b in BITS], "conv_id", "n_convs", zero.alias("words"),
        *[F.lit(None).cast("bigint").alias(f"up_{b}") for b in BITS])
    nodes = durable(grouped.unionByName(root).withColumn("node", F.monotonically_increasing_id()))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"),
                         *[F.col(b).alias(f"up_{b}") for b in BITS])
    linked = nodes.join(above, ["depth", *[f"up_{b}" for b in BITS]], "left")
    children = linked.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    counted = durable(linked.join(children, "node", "left").select(
        "node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), *BITS,
        F.col("n_children").isNull().cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")))
    sums = subtree_sums(counted.withColumn("order", F.col("conv_id")), ["n_leaves", "saved_tokens"])
    key = F.concat_ws(":", "depth", *BITS).alias("key")
    ended = path.join(lasts, ["conv_id", "depth"], "left_semi").select("conv_id", key).unionByName(
        convs.join(lasts, "conv_id", "left_anti").select("conv_id", F.lit("0:0:0").alias("key")))
    told = counted.select("*", key).drop("n_leaves", "saved_tokens")
    return told.join(sums, "node").join(end_digests(ended), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def branched_trie(rows: DataFrame) -> DataFrame:
    """`prefix_trie` of the `branched` conversations."""
    turns = durable(turns_of(rows))
    return prefix_trie(branched(turns), turns.select("conv_id").distinct())
