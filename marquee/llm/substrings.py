"""Removal of repeated substrings by induced sorting of suffixes.

Every string of `LENGTH` bytes that also starts earlier (in a document with a smaller id, or earlier in the same one) is
a repeat, and all bytes that repeats cover are removed. Whatever is judged, it is judged on the input.

1. Every window of `LENGTH` bytes has an anchor: of its grams of `GRAM` bytes, the leftmost of those with the smallest
   hash. Equal windows have equal grams at equal distances, so they meet under the gram. Windows in a row share an
   anchor, which needs only one entry: the anchor's place and the bytes of its windows.
2. Grams that occur only once cannot belong to a repeat. The hashes of all anchors are counted, and a sieve with one
   bit for each trailing part of a hash keeps the others: an anchor's hash is the smallest around, so it begins with
   zeros. The sieve grows with the text up to a fixed size; what it lets through costs time and disk only.
3. Entries are sent to their gram's shard. Of entries with equal bytes in a task, only the earliest is sent: all windows
   of the others are repeats. A shard's suffixes are sorted from the anchors on by Spark's external sorter, whose runs
   lie on disk and are merged by a priority queue, so a shard can be far larger than memory.
4. Suffixes that start one byte further left are sorted by induction: the order before, dealt out stably by the byte in
   front, is the new order. The common prefix of neighbours is one more than the smallest between them before. Step by
   step the tuples (suffix, common prefix) move from the anchors to the farthest windows. Where the common prefix of
   neighbours reaches `LENGTH` bytes, their windows are equal, and all but the earliest are repeats.

Only the entries of one gram are in memory at a time, together with other small ones: after equal ones are left out in
every task, a gram has as many entries as there are different surroundings of its bytes.

Defined results: a null text counts as empty. Rows without an id come last. Rows that repeat id and text count as one
document, of rows with equal ids and different texts a hash of the text decides which is earlier. Grams and entries are
told apart by 64 bits of hash and by their bytes, respectively, so hashes never decide what is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import durable, release, through_python
from marquee.llm.shingles import _table, mixed

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Window starts handled in one go; longer texts are taken in pieces.
PIECE = 1 << 20
#: Least and most bits of the sieve, as powers of two, and entries sorted together.
SIEVE, HELD = (27, 30), 60_000
ENTRY = "gram bigint, right binary, left binary, least int, doc bigint, print bigint, anchor bigint"
LAST = 2**63 - 1


def anchors(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, place, first and last window) of every anchor of some bytes, at most `PIECE` + `LENGTH` of them."""
    windows = len(buf) - LENGTH + 1
    if windows <= 0:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    power, inverse = _table(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=sums[1:])
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(buf) - GRAM + 1])
    n = len(grams)
    key = np.full(-(-n // SPAN) * SPAN, np.iinfo(np.uint64).max, np.uint64)
    key[:n] = (grams >> np.uint64(22) << np.uint64(22)) | np.arange(n, dtype=np.uint64)
    blocks = key.reshape(-1, SPAN)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[:windows], ahead[SPAN - 1: SPAN - 1 + windows]) & np.uint64((1 << 22) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:] - 1, [windows - 1]))
    return grams[place[first]], place[first], first, last


def _pieces(text: str | None) -> Iterator[tuple[int, np.ndarray]]:
    buf = np.frombuffer((text or "").encode(), np.uint8)
    for at in range(0, max(len(buf) - LENGTH + 1, 0), PIECE):
        yield at, buf[at: at + PIECE + LENGTH - 1]


def _turned(hashes: np.ndarray) -> np.ndarray:
    """Hashes with their halves exchanged, so that those of anchors are spread evenly by their leading bits."""
    return hashes << np.uint64(32) | hashes >> np.uint64(32)


def _sieve_bits(n_bytes: int) -> int:
    """Bits of the sieve for so much text, as a power of two: one for each 8 bytes or more, up to the most."""
    return min(SIEVE[1], SIEVE[0] + int(max(n_bytes - 1, 0) >> 30).bit_length())


def _sieve(rows: DataFrame, parts: int, bits: int = SIEVE[0]) -> np.ndarray:
    """2^bits bits, packed: those of the turned gram hashes that more than one anchor has are set."""
    width = (1 << bits) // parts

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for batch in batches:
            for text in batch["text"]:
                held.extend(anchors(buf)[0] for _, buf in _pieces(text))
                if sum(map(len, held)) > 500_000:
                    yield from send(held)
                    held = []
        if held:
            yield from send(held)

    def send(held: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        hashes = np.sort(_turned(np.concatenate(held)))
        part = (hashes >> np.uint64(64 - bits)).astype(np.int64) // width
        ids, starts = np.unique(part, return_index=True)
        yield pd.DataFrame({"part": ids.astype(np.int32), "hashes": [hashes[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(hashes)])]})

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, hashes in zip(batch["part"], batch["hashes"]):
                held.setdefault(part, []).append(hashes)
        for part, found in held.items():
            hashes = np.sort(np.frombuffer(b"".join(found), np.uint64))
            again = hashes[1:][hashes[1:] == hashes[:-1]]
            marks = np.zeros(width, bool)
            marks[(again >> np.uint64(64 - bits)).astype(np.int64) - part * width] = True
            yield pd.DataFrame({"part": [part], "bits": [np.packbits(marks).tobytes()]})

    marked = (rows.select("text").mapInPandas(pack, "part int, hashes binary").repartition(parts, "part")
              .mapInPandas(mark, "part int, bits binary"))
    whole = np.zeros((1 << bits) // 8, np.uint8)
    each = len(whole) // parts
    for row in marked.toLocalIterator():
        whole[row["part"] * each: (row["part"] + 1) * each] = np.frombuffer(row["bits"], np.uint8)
    return whole


def _entries(rows: DataFrame, sieve: np.ndarray) -> DataFrame:
    """Entries of the anchors that pass the sieve, and (gram null) the spans of those whose equals in the task are earlier."""
    shared = rows.sparkSession.sparkContext.broadcast(sieve)
    unused = np.uint64(64 - (len(sieve) * 8 - 1).bit_length())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[bytes, tuple] = {}
            out: list[tuple] = []
            for doc, print_, text in zip(batch["doc"], batch["print"], batch["text"]):
                for at, buf in _pieces(text):
                    grams, place, first, last = anchors(buf)
                    bit = (_turned(grams) >> unused).astype(np.int64)
                    ok = np.flatnonzero(shared.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)
                    raw = buf.tobytes()
                    for gram, a, lo, hi in zip(grams[ok].view(np.int64).tolist(), place[ok].tolist(), first[ok].tolist(), last[ok].tolist()):
                        key = hashlib.blake2b(raw[lo: hi + LENGTH], digest_size=16).digest() + bytes((a - lo,))
                        row = (gram, raw[a: hi + LENGTH], raw[lo:a], a - hi, doc, print_, at + a)
                        known = seen.get(key)
                        if known is None:
                            seen[key] = row
                            continue
                        if row[4:] < known[4:]:
                            seen[key], row = row, known
                        if row[4:] != known[4:] or row is known:
                            out.append((row[4], row[5], row[6] - len(row[2]), row[6] + len(row[1])))
                if len(seen) > 40_000:
                    yield frame(seen, out)
                    seen, out = {}, []
            yield frame(seen, out)

    def merged(spans: list) -> list:
        """Spans of a document that overlap or touch, as one."""
        whole: list[list] = []
        for doc, print_, start, stop in sorted(spans):
            if whole and whole[-1][:2] == [doc, print_] and start <= whole[-1][3]:
                whole[-1][3] = max(whole[-1][3], stop)
            else:
                whole.append([doc, print_, start, stop])
        return whole

    def frame(seen: dict, out: list) -> pd.DataFrame:
        rows_ = [(*row, None) for row in seen.values()] + [(None, None, None, None, *span) for span in merged(out)]
        table = pd.DataFrame(rows_, columns=["gram", "right", "left", "least", "doc", "print", "anchor", "stop"], dtype=object)
        return table.astype({c: "Int64" for c in ("gram", "least", "doc", "print", "anchor", "stop")})

    return rows.mapInPandas(run, f"{ENTRY}, stop bigint")


def repeats(gram: np.ndarray, right: list[bytes], left: list[bytes], least: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(distance, entries): entries of which the window that starts so far before the anchor is a repeat.

    Entries are sorted by gram and `right`, the bytes from the anchor on. `left`: the bytes before it, as far as its
    windows reach; `least`: the smallest distance of a window; `order`: smaller is earlier.
    """
    n = len(gram)
    width = max(map(len, right))
    table = np.zeros((n, width), np.int16)
    for i, r in enumerate(right):
        table[i, : len(r)] = np.frombuffer(r, np.uint8)
    lengths = np.fromiter(map(len, right), np.int64, n)
    table[np.arange(width) < lengths[:, None]] += 1
    differ = table[1:] != table[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common[gram[1:] != gram[:-1]] = 0
    common = np.concatenate(([0], np.minimum(common, 250))).astype(np.uint8)  # with the entry before
    group = np.cumsum(np.concatenate(([False], gram[1:] != gram[:-1])))
    reach = np.fromiter(map(len, left), np.int64, n)
    before = np.zeros((n, int(reach.max(initial=0)) + 1), np.uint8)  # [:, d]: the byte d places before the anchor
    for i, x in enumerate(left):
        if x:
            before[i, 1: len(x) + 1] = np.frombuffer(x, np.uint8)[::-1]
    at = np.arange(n)
    for distance in range(before.shape[1]):
        if distance:
            on = reach[at] >= distance
            kept = np.flatnonzero(on)
            if not len(kept):
                return
            low = _range_minima(common)
            at, previous = at[kept], np.concatenate(([0], kept[:-1]))
            common = _least_between(low, previous, kept)
            common[0] = 0
            key = group[at] * 256 + before[at, distance]
            dealt = np.argsort(key, kind="stable")
            low = _range_minima(common)
            common = np.minimum(_least_between(low, np.concatenate(([0], dealt[:-1])), dealt), 249) + np.uint8(1)
            at, key = at[dealt], key[dealt]
            common[np.concatenate(([True], key[1:] != key[:-1]))] = 0
        first = np.flatnonzero(common < LENGTH)
        if len(first) < len(at):
            earliest = np.minimum.reduceat(order[at], first)
            repeat = (order[at] != np.repeat(earliest, np.diff(np.concatenate((first, [len(at)]))))) & (least[at] <= distance)
            if repeat.any():
                yield distance, at[repeat]


def _range_minima(values: np.ndarray) -> list[np.ndarray]:
    """Minima over spans of 1, 2, 4, ... values."""
    table = [values]
    while 2 ** len(table) <= len(values):
        last, step = table[-1], 2 ** (len(table) - 1)
        table.append(np.minimum(last[:-step], last[step:]))
    return table


def _least_between(table: list[np.ndarray], after: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Minimum of values[after + 1 .. upto] for each pair; any value where upto <= after."""
    n = np.maximum(upto - after, 1)
    level = np.floor(np.log2(n)).astype(np.int64)
    out = np.zeros(len(n), np.uint8)
    for k in np.unique(level):
        rows = np.flatnonzero(level == k)
        a, b = after[rows] + 1, upto[rows] + 1 - 2**k
        ok = b >= a
        top = len(table[k]) - 1
        out[rows] = np.where(ok, np.minimum(table[k][np.minimum(a, top)], table[k][np.clip(b, 0, top)]), 0)
    return out


def _spans(entries: DataFrame, shards: int) -> DataFrame:
    """doc, print, start, stop: spans that repeats cover, each from one anchor's windows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            known = batch["gram"].isna().to_numpy()
            if known.any():  # they come first
                yield batch[known].rename(columns={"anchor": "start"})[["doc", "print", "start", "stop"]]
            held.append(batch[~known])
            if sum(map(len, held)) > HELD:
                rows = pd.concat(held, ignore_index=True)
                cut = int(np.searchsorted(rows["gram"].to_numpy(np.int64), rows["gram"].iat[-1]))
                if cut:  # the last gram may go on
                    yield settled(rows.iloc[:cut])
                held = [rows.iloc[cut:]]
        if held:
            yield settled(pd.concat(held, ignore_index=True))

    def settled(rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return rows.rename(columns={"anchor": "start"})[["doc", "print", "start", "stop"]]
        gram = rows["gram"].to_numpy(np.int64)
        several = np.concatenate((gram[1:] == gram[:-1], [False])) | np.concatenate(([False], gram[1:] == gram[:-1]))
        rows = rows[several]
        if not len(rows):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("doc", "print", "start", "stop")})
        doc, print_, anchor = (rows[c].to_numpy() for c in ("doc", "print", "anchor"))
        order = np.zeros(len(rows), np.int64)
        order[np.lexsort((anchor, print_, doc))] = np.arange(len(rows))
        same = np.flatnonzero(np.diff(doc[(by := np.argsort(order))]) | np.diff(print_[by]) | np.diff(anchor[by]))
        order[by] = np.repeat(np.arange(len(same) + 1), np.diff(np.concatenate(([0], same + 1, [len(rows)]))))
        starts, who = [], []
        for distance, at in repeats(gram[several], rows["right"].tolist(), rows["left"].tolist(), rows["least"].to_numpy(), order):
            starts.append(anchor[at] - distance)
            who.append(at)
        if not who:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("doc", "print", "start", "stop")})
        start, at = np.concatenate(starts), np.concatenate(who)
        by = np.lexsort((start, at))
        start, at = start[by], at[by]
        first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))))
        last = np.concatenate((first[1:] - 1, [len(at) - 1]))
        return pd.DataFrame({"doc": doc[at[first]], "print": print_[at[first]], "start": start[first], "stop": start[last] + LENGTH})

    sent = entries.repartition(shards, F.coalesce("gram", "anchor")).sortWithinPartitions("gram", "right")
    return sent.mapInPandas(run, "doc bigint, print bigint, start bigint, stop bigint")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("doc"),
                       F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, n_bytes // 40_000_000 + 1)
    sieve = _sieve(rows, 2 ** min(12, max(3, int(n_bytes // 100_000_000).bit_length() + 2)), _sieve_bits(n_bytes))
    release(docs.sparkSession)  # what the sieve has shuffled need not lie beside the entries
    stored = durable(_spans(_entries(rows, sieve), shards))
    release(docs.sparkSession)
    spans = stored.groupBy("doc", "print").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text, found in zip(batch["id"], batch["text"], batch["spans"]):
                raw = (text or "").encode()
                kept, at, removed, n = [], 0, 0, 0
                end = -1
                for span in found if found is not None else ():
                    start, stop = span["start"], span["stop"]
                    if start > end:
                        kept.append(raw[at:start])
                        n, end = n + 1, start
                    removed += max(0, stop - max(end, start))
                    end = at = max(end, stop)
                kept.append(raw[at:])
                out.append((i, len(raw), removed, n, b"".join(kept)))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = rows.join(spans, ["doc", "print"], "left").select("id", "text", "spans")
    return through_python(joined, run, "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary", name=id_col)
