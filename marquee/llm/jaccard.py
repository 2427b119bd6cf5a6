"""Size-aware heavy-light join of documents by the Jaccard similarity of their word shingles, and its components.

Equal sets are one node. Two nodes of sizes s <= t link when they share at least ceil(r (s + t) / (1 + r)) shingles.

* Light: of a small set all subsets of the size that a partner must share are enumerated; nodes with a common subset
  are linked without any check. The boundary between small and large is the one with the least cost, which is worked
  out from the histogram of the sizes.
* Heavy: a large set is listed under its first n - ceil(r n) + 1 shingles, and the inverted lists are scanned. All
  sets use one order of shingles: frequent ones last, else by hash. Two similar sets meet in at least one list.

Lists of frequent shingles and groups of near copies can hold a large share of all nodes, so pairs are not made per
list. First every node meets a few leaders of its lists, is checked against those it meets most often, and true links
are contracted to components; this is repeated with other leaders. Lists whose members are in one component are done.
Only members of different components then meet, in cells of bounded size, and of these pairs only those are checked
whose common lists leave room for enough common shingles. A shingle's frequency only sets the order: whatever it is, no link is lost.

Lists are built in blocks: a map task sends, for each part of the shingle space, one row with the packed shingles of
many documents, and a part is sorted by array operations. A list above `SPLIT` nodes is split over parts by node.

Defined results: words are cut at ASCII white space and A-Z are lower-cased. A text of fewer words than a shingle is
one shingle. A null, empty or wordless text has no shingles, links with nothing, and is a component of its own. Rows
with equal ids count as one document if their texts have equal sets. Rows without an id take part, but never
name a component; where all of its rows lack an id, it is null. An empty table gives no rows. Extra columns are ignored
by `near_groups` and carried along by `keep_one`. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import durable, fresh, passing, release, through_python
from marquee.llm.components import components
from marquee.llm.shingles import mixed, shingle_sets
from marquee.scale import top_per_key

#: Similarity as a fraction NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 4, 5
#: A shingle in more sets than this is frequent; at most this many frequent ones, the most frequent first, are ordered last.
FREQUENT, MOST_FREQUENT = 64, 200_000
#: Share of a set's hash-ordered shingles that are kept at first: enough unless a third of them is frequent.
KEPT, KEPT_AT_LEAST = 0.3, 64
#: Sizes up to which the boundary between small and large sets is looked for.
LARGEST_SMALL = 12
#: Nodes of a list in one part, and listed shingles in a part.
SPLIT, PER_PART = 4096, 1_000_000
#: Bits of the sieve that keeps most sets without candidates out of the check; its size never grows.
SIEVE_BITS = 24
#: Rounds with leaders, leaders of a list and of a node, and the share of its lists in which a node must meet a leader.
ROUNDS, LEADERS, CHECKED, LIKELY = 2, 8, 6, 0.65
#: Nodes of a block of pairs or of a part of a cell, lists counted at once, and the step of sizes (above 5/4).
PER_BLOCK, LISTS_AT_ONCE, SIZE_STEP = 256, 4096, 1.26
#: Nodes of a cell up to which lists are intersected pair by pair.
FEW = 16

#: The columns of a cell's rows.
Cell = dict[str, np.ndarray]
#: From a stored table with a column `node` to the whole sets of at least these nodes: node, tokens.
Whole = Callable[[DataFrame], DataFrame]


def needed(s: Column | np.ndarray | int, t: Column | np.ndarray | int):
    """Common shingles that sets of these sizes need to link."""
    if isinstance(s, Column):
        return F.floor((F.lit(NUMERATOR) * (s + t) + NUMERATOR + DENOMINATOR - 1) / F.lit(NUMERATOR + DENOMINATOR))
    return (NUMERATOR * (s + t) + NUMERATOR + DENOMINATOR - 1) // (NUMERATOR + DENOMINATOR)


def listed(n):
    """Length of the prefix under which a set of size n is listed."""
    return n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1


def _node(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _chunks(frame: pd.DataFrame, most: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """Parts of a batch with about `most` characters each."""
    part = frame["text"].str.len().fillna(0).cumsum() // most
    for _, piece in frame.groupby(part, sort=True):
        yield piece


def _signed(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64)


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, node, n and the first shingles in hash order (`tokens`, packed) of every document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _chunks(batch):
                out = []
                for tokens in shingle_sets(part["text"].tolist()):
                    kept = max(KEPT_AT_LEAST, int(np.ceil(len(tokens) * KEPT)))
                    out.append((_node(tokens) if len(tokens) else None, len(tokens), tokens[:kept].tobytes()))
                frame = pd.DataFrame(out, columns=["node", "n", "tokens"], index=part.index, dtype=object)  # else nodes become floats
                yield frame.assign(id=part["id"], node=frame["node"].astype("Int64"), n=frame["n"].astype("int64"))[["id", "node", "n", "tokens"]]

    return through_python(rows, run, "node bigint, n bigint, tokens binary")


def _sets(docs: DataFrame, id_col: str, text_col: str, sieves: tuple[bytes, bytes]) -> DataFrame:
    """node, tokens (packed, whole) of the nodes that pass the sieves, once each. Only texts whose id passes are cut into shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(sieves)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of_ids, of_nodes = (np.frombuffer(x, np.uint8) for x in shared.value)
        for batch in batches:
            at = batch["at"].to_numpy().view(np.uint64) >> np.uint64(64 - SIEVE_BITS)
            passes = of_ids[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1
            for part in _chunks(batch[passes.astype(bool)]):
                out = []
                for tokens in shingle_sets(part["text"].tolist()):
                    if len(tokens):
                        node = _node(tokens)
                        at = (node % 2**64) >> (64 - SIEVE_BITS)
                        if of_nodes[at >> 3] >> (at & 7) & 1:
                            out.append((node, tokens.tobytes()))
                yield pd.DataFrame(out, columns=["node", "tokens"])

    rows = docs.select(F.xxhash64(id_col).alias("at"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "node bigint, tokens binary").groupBy("node").agg(F.first("tokens").alias("tokens"))


def _sieves(nodes: DataFrame, firsts: DataFrame) -> tuple[bytes, bytes]:
    """A bit for the leading `SIEVE_BITS` bits of the hash of each node's first id, and for those of the node: 2 MB each, always."""
    hashes = nodes.select("node").join(firsts, "node").select(F.posexplode(F.array(F.xxhash64("first"), "node")).alias("which", "hash"))
    places = hashes.select("which", F.shiftrightunsigned("hash", 64 - SIEVE_BITS).alias("place"))
    words = places.groupBy("which", F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    tables = np.zeros((2, 1 << (SIEVE_BITS - 6)), np.int64)
    for row in words.toLocalIterator():
        tables[row["which"], row["word"]] = row["bits"]
    return tables[0].tobytes(), tables[1].tobytes()


def _frequent(nodes: DataFrame, parts: int) -> tuple[np.ndarray, dict[int, int]]:
    """Sorted shingles that are in more than `FREQUENT` nodes, as far as the kept part of their sets tells.

    Also the counts of those in more than `SPLIT` nodes.
    """
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = np.frombuffer(b"".join(batch["tokens"]), np.uint64)
            values, counts = np.unique(tokens, return_counts=True)
            yield from _packed(values, (values % np.uint64(parts)).astype(np.int64), counts.astype(np.int32))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(t, v) for batch in batches for t, v in zip(batch["tokens"], batch["extra"])]
        if held:
            tokens = np.frombuffer(b"".join(t for t, _ in held), np.uint64)
            counts = np.frombuffer(b"".join(v for _, v in held), np.int32)
            values, at = np.unique(tokens, return_inverse=True)
            total = np.bincount(at, weights=counts)
            many = total > FREQUENT
            yield pd.DataFrame({"token": _signed(values[many]), "count": total[many].astype(np.int64)})

    counts = (nodes.select("tokens").mapInPandas(pack, "part int, tokens binary, extra binary")
              .repartition(parts, "part").mapInPandas(count, "token bigint, count bigint"))
    rows = counts.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r["token"] for r in rows], np.int64).view(np.uint64)), {
        r["token"]: r["count"] for r in rows if r["count"] > SPLIT}


def _packed(tokens: np.ndarray, part: np.ndarray, *extra: np.ndarray) -> Iterator[pd.DataFrame]:
    """One row per part, with the packed values of the part."""
    order = np.argsort(part, kind="stable")
    ids, starts = np.unique(part[order], return_index=True)
    ends = [*starts[1:], len(order)]
    columns = {"part": ids.astype(np.int32), "tokens": [tokens[order[a:b]].tobytes() for a, b in zip(starts, ends)]}
    for i, values in enumerate(extra):
        columns["extra" if len(extra) == 1 else f"extra{i}"] = [values[order[a:b]].tobytes() for a, b in zip(starts, ends)]
    yield pd.DataFrame(columns)


def _in_order(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """The shingles with frequent ones last, and the number of the others."""
    if not len(frequent):
        return tokens, len(tokens)
    at = np.searchsorted(frequent, tokens)
    at[at == len(frequent)] = 0
    late = frequent[at] == tokens
    return np.concatenate((tokens[~late], tokens[late])), int((~late).sum())


def _lists(nodes: DataFrame, whole: Whole, least: int, frequent: np.ndarray, hot: dict[int, int], parts: int
           ) -> DataFrame:
    """token, node, n, last of every node of at least `least` shingles under each of its listed shingles.

    `last` is the place of the node's last listed shingle in the order of all shingles. Lists of one node are left out.
    """
    shared = nodes.sparkSession.sparkContext.broadcast((frequent, hot))

    def prefix(tokens: np.ndarray, n: int) -> tuple[np.ndarray, int] | None:
        """None if the kept shingles do not tell."""
        ordered, plain = _in_order(tokens, shared.value[0])
        end = int(listed(n))
        if plain < end and len(tokens) < n:
            return None
        return ordered[:end], int(ordered[end - 1] >> np.uint64(2)) + ((1 << 62) if end > plain else 0)

    def spread(found: list[tuple[tuple[np.ndarray, int], int]]) -> Iterator[pd.DataFrame]:
        if not found:
            return
        tokens = np.concatenate([t for (t, _), _ in found])
        lengths = [len(t) for (t, _), _ in found]
        node = np.repeat(np.array([x for _, x in found], np.int64), lengths)
        last = np.repeat(np.array([x for (_, x), _ in found], np.int64), lengths)
        at = tokens.copy()
        hot_lists = shared.value[1]
        if hot_lists:
            keys = np.sort(np.array(list(hot_lists), np.int64).view(np.uint64))
            split = np.array([hot_lists[int(k)] // SPLIT + 1 for k in _signed(keys)], np.uint64)
            where = np.searchsorted(keys, tokens)
            where[where == len(keys)] = 0
            is_hot = keys[where] == tokens
            salt = mixed(node[is_hot].view(np.uint64)) % split[where[is_hot]]
            at[is_hot] = mixed(tokens[is_hot] + salt)
        yield from _packed(tokens, (mixed(at) % np.uint64(parts)).astype(np.int64), node, last)

    def of_kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(prefix(np.frombuffer(t, np.uint64), n), node)
                     for node, n, t in zip(batch["node"], batch["n"], batch["tokens"]) if n >= least]
            yield from spread([x for x in found if x[0] is not None])

    def of_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for node, tokens in zip(batch["node"], batch["tokens"]):
                tokens = np.frombuffer(tokens, np.uint64)
                out.append((prefix(tokens, len(tokens)), node))
            yield from spread(out)

    def lacks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [n >= least and prefix(np.frombuffer(t, np.uint64), n) is None for n, t in zip(batch["n"], batch["tokens"])]
            yield batch[keep][["node"]]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [row for batch in batches for row in batch[["tokens", "extra0", "extra1"]].itertuples(index=False)]
        if not held:
            return
        tokens, node, last = (np.frombuffer(b"".join(row[i] for row in held), kind)
                              for i, kind in enumerate((np.uint64, np.int64, np.int64)))
        del held
        order = np.lexsort((node, tokens))
        tokens, node, last = tokens[order], node[order], last[order]
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (node[1:] != node[:-1])
        tokens, node, last = tokens[fresh], node[fresh], last[fresh]
        same = tokens[1:] == tokens[:-1]
        keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
        if shared.value[1]:
            keep |= np.isin(tokens, np.array(list(shared.value[1]), np.int64).view(np.uint64))
        tokens, node, last = tokens[keep], node[keep], last[keep]
        for a in range(0, len(tokens), 200_000):
            b = a + 200_000
            yield pd.DataFrame({"token": _signed(tokens[a:b]), "node": node[a:b], "last": last[a:b]})

    packed = "part int, tokens binary, extra0 binary, extra1 binary"
    rows = nodes.select("node", "n", "tokens").mapInPandas(of_kept, packed)
    if len(frequent):
        lacking = durable(nodes.select("node", "n", "tokens").mapInPandas(lacks, "node bigint"))
        release(nodes.sparkSession)
        sets = whole(lacking).join(lacking, "node", "left_semi")
        rows = rows.unionByName(sets.mapInPandas(of_texts, packed))
    found = durable(rows.repartition(parts, "part").mapInPandas(scan, "token bigint, node bigint, last bigint"))
    release(nodes.sparkSession)
    return found.join(nodes.select("node", "n"), "node").select("token", "node", "n", "last")


@lru_cache(maxsize=64)
def _shared_sizes(n: int, largest: int) -> tuple[tuple[int, int], ...]:
    """(smaller, larger) sizes of pairs of small sets of which one has size n."""
    return tuple((min(n, t), max(n, t)) for t in range(1, largest + 1)
                 if needed(n, t) <= min(n, t))


def _subset_cost(n: int) -> int:
    from math import comb

    return sum(comb(n, needed(n, t)) for t in range(1, n * DENOMINATOR // NUMERATOR + 1) if needed(n, t) <= min(n, t))


def boundary(sizes: dict[int, int]) -> int:
    """Largest size of a small set, by the least number of subsets and listed shingles.

    sizes: nodes by size, up to `LARGEST_SMALL` * 5/4. A listed shingle counts four times: it is sent, scanned, counted
    and checked, while a shared subset is a link already.
    """
    def cost(b: int) -> int:
        light = sum(count * _subset_cost(n) for n, count in sizes.items() if n <= b)
        return light + 4 * sum(count * int(listed(n)) for n, count in sizes.items() if n >= -(-NUMERATOR * (b + 1) // DENOMINATOR))

    return min(range(LARGEST_SMALL + 1), key=lambda b: (cost(b), b))


def _subset_links(nodes: DataFrame, largest: int) -> DataFrame:
    """u, v: links between small sets, one for each member of a subset's group to a member of the size it pairs with."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for node, n, packed in zip(batch["node"], batch["n"], batch["tokens"]):
                tokens = np.frombuffer(packed, np.uint64).tolist()
                for small, large in _shared_sizes(n, largest):
                    for subset in combinations(tokens, int(needed(small, large))):
                        key = hashlib.blake2b(np.array([small, large, *subset], np.uint64).tobytes(), digest_size=16)
                        out.append((key.digest(), small, large, node, n))
            yield pd.DataFrame(out, columns=["key", "small", "large", "node", "n"])

    rows = durable(nodes.filter(F.col("n").between(1, largest)).select("node", "n", "tokens").mapInPandas(
        run, "key binary, small bigint, large bigint, node bigint, n bigint"))
    leaders = durable(rows.groupBy("key").agg(
        F.min(F.when(F.col("n") == F.col("small"), F.col("node"))).alias("of_small"),
        F.min(F.when(F.col("n") == F.col("large"), F.col("node"))).alias("of_large")))
    partner = F.when(F.col("n") == F.col("small"), F.col("of_large")).otherwise(F.col("of_small"))
    return rows.join(leaders, "key").select(F.col("node").alias("u"), partner.alias("v")).filter("v is not null and u <> v")


def _blocked(pairs: DataFrame) -> DataFrame:
    """u, v, block of every pair: blocks of pairs whose ends mostly meet within the block.

    A node's home is the smallest node that it is paired with. Homes with many nodes are split by a hash of the node,
    so that a block holds some hundreds of sets, and a set is sent to few blocks however many pairs it is in.
    """
    ends = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    homes = durable(ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("home")))
    parts = durable(homes.groupBy("home").agg((F.floor(F.count("*") / PER_BLOCK) + 1).alias("parts")))
    placed = durable(homes.join(parts, "home").select(
        F.col("u").alias("node"), F.xxhash64("home", F.pmod(F.xxhash64("u"), F.col("parts"))).alias("place")))
    at = [placed.select(F.col("node").alias(c), F.col("place").alias(f"at_{c}")) for c in ("u", "v")]
    return durable(pairs.join(at[0], "u").join(at[1], "v").select(
        "u", "v", F.xxhash64(F.least("at_u", "at_v"), F.greatest("at_u", "at_v")).alias("block")))


def _true_links(blocked: DataFrame, whole: Whole) -> DataFrame:
    """Of pairs (u, v, block), those whose whole sets share enough. `blocked` must be a stored table."""
    ends = durable(blocked.select("block", F.col("u").alias("node")).unionByName(
        blocked.select("block", F.col("v").alias("node"))).distinct())
    nothing = F.lit(None).cast("binary")
    sets = whole(ends).join(ends, "node").select("block", F.col("node").alias("u"), F.col("node").alias("v"), "tokens")
    rows = sets.unionByName(blocked.select("block", "u", "v", nothing.alias("tokens")))

    def checked(block: Cell) -> Cell:
        u, v, is_set = block["u"], block["v"], block["u"] == block["v"]
        held = {node: np.frombuffer(tokens, np.uint64) for node, tokens in zip(u[is_set].tolist(), block["tokens"][is_set])}
        pairs = [(x, y) for x, y in zip(u[~is_set].tolist(), v[~is_set].tolist()) if _share_enough(held[x], held[y])]
        return dict(zip(("u", "v"), np.array(pairs, np.int64).reshape(-1, 2).T))

    return _by_cell(rows, ["block"], checked, "u bigint, v bigint")


def _share_enough(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two whole sets link."""
    few, many = sorted((a, b), key=len)
    at = np.searchsorted(many, few)
    at[at == len(many)] = 0
    return int((many[at] == few).sum()) >= needed(len(few), len(many))


def _in_mixed_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of lists whose members are in several components, with their component's label and the list's smallest node."""
    known = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_lists = durable(known.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                                   F.min("node").alias("home")).filter("lo <> hi").select("token", "home"))
    return durable(known.join(open_lists, "token"))


def _met(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of different components that meet in lists, the smaller set as `a`, with the number `k` of their lists."""
    a = rows.select("token", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "label", "last")])
    b = others.select("token", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "label", "last")])
    return (a.join(b, "token").filter((F.col("label_a") != F.col("label_b"))
                                      & (F.col("n_a") * DENOMINATOR >= F.col("n_b") * NUMERATOR)
                                      & (F.col("n_b") * DENOMINATOR >= F.col("n_a") * NUMERATOR)))


def _with_leaders(rows: DataFrame, salt: int) -> DataFrame:
    """u, v: each node and, of the `LEADERS` first nodes of its lists, the `CHECKED` ones that it meets most often.

    A node that meets it in few lists is left to the later search. Without a salt, those come first whose lists are the
    longest on average: of a group of near copies, the ones with the fewest changes, to which others are nearest. A salt
    gives other orders.
    """
    if salt:
        placed = rows.withColumn("place", F.xxhash64("node", F.lit(salt)))
    else:
        sizes = rows.groupBy("token").agg(F.count("*").alias("held"))
        central = durable(rows.select("token", "node").join(sizes, "token").groupBy("node").agg((-F.avg("held")).alias("place")))
        placed = rows.join(central, "node")
    first = top_per_key(placed, ["token"], [F.col("place"), F.col("node")], LEADERS)
    met = _met(rows, first).groupBy("node_a", "node_b").agg(F.count("*").alias("k"), F.first("n_a").alias("s"))
    often = met.filter(F.col("k") >= LIKELY * (F.col("s") - F.ceil(F.col("s") * NUMERATOR / DENOMINATOR) + 1))
    best = top_per_key(often, ["node_a"], [F.desc("k"), F.col("node_b")], CHECKED)
    return best.select(F.col("node_a").alias("u"), F.col("node_b").alias("v"))


def _may_link(cell: Cell, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs of places are of different components and of sizes that can link, and belong to this cell."""
    n, label, low, part = (cell[c] for c in ("n", "label", "low", "part"))
    ok = (label[a] != label[b]) & (low[a] | low[b]) & (DENOMINATOR * np.minimum(n[a], n[b]) >= NUMERATOR * np.maximum(n[a], n[b]))
    if cell["i"][0] != cell["j"][0]:  # pairs of one part have their own cell
        ok &= part[a] != part[b]
    return ok


def _common_lists(cell: Cell) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs that may link and have lists in common, and how many lists.

    In a cell of few nodes each pair's lists are intersected; else they are counted as a product of matrices, some
    thousand lists at a time.
    """
    size = len(cell["n"])
    if size <= FEW:
        a, b = np.triu_indices(size, 1)
        ok = _may_link(cell, a, b)
        a, b = a[ok], b[ok]
        if not len(a):
            return a, b, a
        lists = [set(x.tolist()) for x in cell["tokens"]]
        k = np.array([len(lists[u] & lists[v]) for u, v in zip(a.tolist(), b.tolist())], np.int64)
        return a[k > 0], b[k > 0], k[k > 0]
    lengths = np.array([len(x) for x in cell["tokens"]])
    _, at, held = np.unique(np.concatenate(cell["tokens"].tolist()), return_inverse=True, return_counts=True)
    row, several = np.repeat(np.arange(size), lengths), held > 1
    column = (np.cumsum(several) - 1)[at]
    row, column = row[several[at]], column[several[at]]
    common = np.zeros((size, size), np.float32)
    for start in range(0, int(several.sum()), LISTS_AT_ONCE):
        chosen = (column >= start) & (column < start + LISTS_AT_ONCE)
        table = np.zeros((size, min(LISTS_AT_ONCE, int(several.sum()) - start)), np.float32)
        table[row[chosen], column[chosen] - start] = 1
        common += table @ table.T
    a, b = np.nonzero(np.triu(common, 1))
    ok = _may_link(cell, a, b)
    a, b = a[ok], b[ok]
    return a, b, common[a, b].astype(np.int64)


def pairs_in_cell(cell: Cell) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a cell whose common lists leave room for a link.

    With k lists in common, the pair's other common shingles come after the listed ones of that set whose list ends
    first, so they are no more than that set has unlisted ones.
    """
    a, b, common = _common_lists(cell)
    n, last = cell["n"], cell["last"]
    unlisted = n - listed(n)
    others = np.where(last[a] < last[b], unlisted[a], np.where(last[a] > last[b], unlisted[b], np.maximum(unlisted[a], unlisted[b])))
    ok = common + others >= needed(n[a], n[b])
    a, b = a[ok], b[ok]
    # Of the homes that both have, the smallest one sees to a pair.
    homes, here = {x: set(cell["homes"][x].tolist()) for x in {*a.tolist(), *b.tolist()}}, cell["home"][0]
    ok = np.array([min(homes[u] & homes[v]) == here for u, v in zip(a.tolist(), b.tolist())], bool)
    return a[ok], b[ok]


def links_in_cell(cell: Cell) -> tuple[list[int], list[int]]:
    """Places of pairs that are linked, as few as join what the cell's links join: a pair that is joined already is skipped."""
    a, b = pairs_in_cell(cell)
    sets = [np.frombuffer(packed, np.uint64) for packed in cell["whole"]]
    _, own = np.unique(cell["label"], return_inverse=True)
    above = list(range(int(own.max()) + 1))
    found: tuple[list[int], list[int]] = ([], [])

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for u, v in zip(a.tolist(), b.tolist()):
        x, y = top(own[u]), top(own[v])
        if x == y:
            continue
        if _share_enough(sets[u], sets[v]):
            above[x] = y
            found[0].append(u)
            found[1].append(v)
    return found


def _open_links(rows: DataFrame, whole: Whole) -> DataFrame:
    """u, v: links that join all components that any links between them join.

    Lists with the same smallest node share a home, and near copies have few homes. A home's nodes of neighbouring
    sizes are dealt to parts, and every two parts are a cell: a node is sent with all its lists to the cells of its homes.
    A cell counts lists in memory and tells which of its nodes are in a pair to check. These are sent again with their whole
    sets, and the cell checks the pairs and sends a forest of links. Both times it gives fewer rows than it has nodes.
    """
    nodes = durable(rows.groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("n", "label", "last")], F.collect_list("token").alias("tokens"), F.collect_set("home").alias("homes")))
    of_size = F.floor(F.log("n") / F.log(F.lit(SIZE_STEP)))  # similar sets are at most one step apart
    at = nodes.select("node", "label", of_size.alias("own"), F.explode("homes").alias("home")).select(
        "node", "label", "own", "home", F.explode(F.array(F.col("own"), F.col("own") - 1)).alias("step"))
    sizes = durable(at.groupBy("home", "step").agg(
        F.count("*").alias("held"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("own").alias("least"))
        .filter("lo <> hi and least = step").select("home", "step", (F.floor(F.col("held") / PER_BLOCK) + 1).alias("parts")))
    placed = durable(at.join(sizes, ["home", "step"]).select(
        "node", "home", "step", (F.col("own") == F.col("step")).alias("low"), "parts", F.pmod(F.xxhash64("node"), "parts").alias("part")))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).select(
        "node", "home", "step", "low", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    key = ["home", "step", "i", "j"]

    full = nodes.select("node", "n", "label", "last", "tokens", "homes")

    def told(cell: Cell) -> Cell:
        at = np.union1d(*pairs_in_cell(cell))
        return {c: cell[c][at] for c in ("node", "low", "part", *key)}

    def linked(cell: Cell) -> Cell:
        u, v = (cell["node"][np.array(x, np.int64)] for x in links_in_cell(cell))
        return {"u": u, "v": v}

    part = "low boolean, part bigint, home bigint, step bigint, i bigint, j bigint"
    checked = durable(_by_cell(cells.join(full, "node"), key, told, f"node bigint, {part}"))
    release(rows.sparkSession)
    sets = whole(checked).withColumnRenamed("tokens", "whole")
    return _by_cell(checked.join(full, "node").join(sets, "node"), key, linked, "u bigint, v bigint")


def _by_cell(rows: DataFrame, key: list[str], work: Callable[[Cell], Cell], schema: str) -> DataFrame:
    """work(rows of a cell) for every cell with several rows. Cells stream through their task one after the other.

    Most cells have a few rows, so a cell is arrays cut from the batch's columns and not a frame of its own.
    """
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[Cell] = []  # the last cell may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            columns = {c: batch[c].to_numpy() for c in batch.columns}
            changes = np.logical_or.reduce([columns[c][1:] != columns[c][:-1] for c in key])
            edges = (np.flatnonzero(changes) + 1).tolist()
            pieces = [{c: x[a:b] for c, x in columns.items()} for a, b in zip([0, *edges], [*edges, len(batch)])]
            if rest and all(rest[0][c][0] == pieces[0][c][0] for c in key):
                rest.append(pieces.pop(0))
            if pieces:
                yield done([joined(rest), *pieces[:-1]] if rest else pieces[:-1])
                rest = [pieces[-1]]
        if rest:
            yield done([joined(rest)])

    def joined(parts: list[Cell]) -> Cell:
        return {c: np.concatenate([part[c] for part in parts]) for c in parts[0]} if len(parts) > 1 else parts[0]

    def done(ready: list[Cell]) -> pd.DataFrame:
        out = [work(cell) for cell in ready if len(cell[key[0]]) > 1]
        return pd.DataFrame(joined(out) if out else {c: [] for c in names}, columns=names)

    return rows.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, schema)


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links."""
    known = labels.select(F.col("node").alias("u"), F.col("label").alias("v"))
    return durable(components(known.unionByName(links.select("u", "v"))))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id."""
    sketches = durable(_sketches(docs, id_col, text_col))
    firsts = durable(sketches.filter("n > 0").groupBy("node").agg(F.min("id").alias("first")))
    copies = sketches.select("id", "node").join(firsts, "node").filter("id <> first").select("id", "node")
    nodes = sketches.filter("n > 0").join(copies, ["id", "node"], "left_anti")
    listed_n = F.col("n") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) + 1
    total = nodes.agg(F.sum(listed_n)).first()[0] or 0
    parts = max(8, total // PER_PART + 1)
    sizes = {r["n"]: r["c"] for r in nodes.filter(F.col("n") <= LARGEST_SMALL * DENOMINATOR // NUMERATOR).groupBy("n").agg(
        F.count("*").alias("c")).collect()}
    small = boundary(sizes)
    frequent, hot = _frequent(nodes, parts)
    release(docs.sparkSession)  # here and below: every large step starts without the shuffles of those before

    def whole(wanted: DataFrame) -> DataFrame:
        return _sets(docs, id_col, text_col, _sieves(wanted, firsts))

    lists = durable(_lists(nodes, whole, -(-NUMERATOR * (small + 1) // DENOMINATOR), frequent, hot, parts))
    release(docs.sparkSession)
    labels = durable(components(_subset_links(nodes, small)))
    for salt in range(ROUNDS):
        lists = _in_mixed_lists(lists, labels)
        labels = _joined(labels, _true_links(_blocked(durable(_with_leaders(lists, salt))), whole))
        lists = lists.drop("label", "home")
        release(docs.sparkSession)
    labels = _joined(labels, _open_links(_in_mixed_lists(lists, labels), whole))
    of_label = durable(labels.join(firsts, "node").groupBy("label").agg(F.min("first").alias("component")))
    settled = durable(firsts.join(labels, "node", "left").join(of_label, "label", "left").select(
        "node", F.coalesce("component", "first").alias("component")))
    return (sketches.select("id", "node", "n").join(settled, "node", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the least by id (none last), then by the number that it is given here.

    Rows are stored once and told apart by that number, so it does not matter whether ids are missing or shared.
    """
    row = fresh(docs, "row")
    stored = durable(docs.withColumn(row, F.monotonically_increasing_id()))
    release(docs.sparkSession)  # what the stages before have shuffled
    with passing(docs.sparkSession):
        groups = durable(near_groups(stored, row, text_col).select(row, F.col("component_id").alias("_component")))
    release(docs.sparkSession)
    # Only rows of components of several rows can go; near all others skip the sort.
    several = groups.groupBy("_component").agg(F.count("*").alias("_n")).filter("_n > 1").select("_component")
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(row))
    met = groups.join(several, "_component").join(stored.select(row, id_col), row).select("_component", row, order.alias("_order"))
    first = met.groupBy("_component").agg(F.min("_order").alias("_first"))
    lost = met.join(first, "_component").filter(F.col("_order") > F.col("_first")).select(row)
    return stored.join(lost, row, "left_anti").select(*docs.columns)
