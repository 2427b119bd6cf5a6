"""Structure repair of conversations by iterative-deepening A*.

A conversation is sound when the initials of its roles read `(s?(ua)+)?`: an optional system message, then turns of user
and assistant. Edits: Keep (0), Rerole to user or assistant (2), Delete (3; blank and duplicate rows must go), Insert of
an empty user or assistant message (2); a truncated row that stays adds 1. The audit lists the initials of the cheapest
edits in order, and of equally cheap ones the least in ASCII.

The search goes depth first in the order D, I, K, R under a cost bound that grows by one until a path is accepted, so the
first accepted path is the answer. What the remaining rows cost at least prunes it, and so does a table of states (row, last
role) that are known to fail with as much budget left.

Rows are dealt by conversation once and streamed in order. A conversation is searched in blocks of `BLOCK` rows: for each
last role before a block and each one after it, the cheapest edits; the best way to reach each last role goes on to the
next block, with the hash of what it keeps. So a task holds one block, four hash states and one letter for each edit,
however long the conversation is. Only the hash, which is sequential by definition, needs all rows of a conversation to
pass one task.

Defined results: rows go by turn, nulls first, rows of one turn by role and text; a null role or text counts as one space,
and so does a null conversation or turn in the key that `damage` hashes. Rows without a conversation form one of their own.
A row counts with its first fault: blank, duplicate (same role and text earlier), truncated. A role's initial is its first
character; only roles that begin with s, u or a can be kept. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
#: The last role so far.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a made message, its role, and the state after keeping a row, by the state before.
AFTER_MADE = (USER, USER, ASSISTANT, USER)
MADE = ("user", "user", "assistant", "user")
AFTER_KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None), "x": (None,) * 4}
SOUND = (NONE, ASSISTANT)
GONE = "-"
SPACES = " \t\n\v\f\r"
FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(rows: DataFrame) -> DataFrame:
    """Drops, empties, strips, repeats or reroles a row by its number: crc32 of `conv_id:turn`, modulo 20."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fate, text = F.crc32(name.cast("binary")) % 20, F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _least_rest(codes: str) -> list[int]:
    """What the rows from each place on cost at least."""
    rest = [0]
    for code in reversed(codes):
        kind = code.lower()
        rest.append(rest[-1] + (3 if code == GONE else min(3, (2 if kind == "x" else 0) + (code != kind))))
    return rest[::-1]


@lru_cache(maxsize=1 << 15)
def search(codes: str, entry: int, exits: tuple[int, ...], closing: bool) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of rows that lead from the state `entry` to one of `exits`.

    A code is a row's kind (s, u, a or x for others), in capitals if it is truncated, or `-` if it must go. Only a
    `closing` block may insert behind its last row. There must be a way.
    """
    rest, n, failed, path = _least_rest(codes), len(codes), {}, []

    def visit(i: int, state: int, left: int) -> bool:
        if i == n and (state in exits or not closing):
            return state in exits
        if left < rest[i] or failed.get((i, state), -1) >= left:
            return False
        code = codes[i] if i < n else GONE
        kind = code.lower()
        cut = code != kind
        kept = AFTER_KEPT[kind][state] if code != GONE else None
        for letter, at, after, cost in (("D", i + 1, state, 3 if i < n else None), ("I", i, AFTER_MADE[state], 2),
                                        ("K", i + 1, kept, None if kept is None else cut),
                                        ("R", i + 1, AFTER_MADE[state], None if code == GONE else 2 + cut)):
            if cost is not None and cost <= left:
                path.append(letter)
                if visit(at, after, left - cost):
                    return True
                path.pop()
        failed[i, state] = left
        return False

    bound = rest[0]
    while not visit(0, entry, bound):
        bound += 1
    return bound, "".join(path)


def _reachable(codes: str, entry: int) -> list[int]:
    """States in which a block that does not close can end."""
    ends = [USER, ASSISTANT]
    if entry == NONE:
        ends.append(NONE)
    if entry == SYSTEM or entry == NONE and "s" in codes.lower():
        ends.append(SYSTEM)
    return ends


class Repair:
    """One conversation, row by row."""

    def __init__(self) -> None:
        self.turns, self.first, self.last, self.initial = 0, None, None, None
        self.counts = dict.fromkeys(FIELDS, 0)
        self.codes: list[str] = []
        self.rows: list[tuple[str, str]] = []
        #: state -> cost, place of its audit among those of all states, linked pieces of the audit, hash of what stays
        self.ways = {NONE: (0, 0, None, hashlib.sha256())}

    def add(self, turn: str | None, role: str, text: str, seen: bool) -> None:
        if len(self.codes) == BLOCK:
            self._step(False)
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.first = turn if self.first is None else self.first
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.initial = role[:1]
        code = role[:1] if role[:1] in ("s", "u", "a") else "x"
        said = text.rstrip(SPACES)
        if not said:
            fault, code = "blank", GONE
        elif seen:
            fault, code = "duplicate", GONE
        elif said[-1] not in ".!?":
            fault, code = "truncated", code.upper()
        else:
            fault = None
        if fault:
            self.counts[fault] += 1
        self.codes.append(code)
        self.rows.append((role, text))

    def _step(self, closing: bool) -> None:
        codes, best = "".join(self.codes), {}
        for entry, (cost, place, _, _) in self.ways.items():
            for exits in [SOUND] if closing else [(end,) for end in _reachable(codes, entry)]:
                more, letters = search(codes, entry, exits, closing)
                way = (cost + more, place, letters, entry)
                best[exits] = min(best.get(exits, way), way)
        order = sorted(best, key=lambda exits: best[exits][1:3])
        ways = {}
        for place, exits in enumerate(order):
            cost, _, letters, entry = best[exits]
            digest = self.ways[entry][3].copy()
            end = self._write(digest, letters, entry)
            ways[end] = (cost, place, (self.ways[entry][2], letters), digest)
        self.ways, self.codes, self.rows = ways, [], []

    def _write(self, digest, letters: str, state: int) -> int:
        rows = iter(self.rows)
        for letter in letters:
            role, text = next(rows) if letter != "I" else ("", "")
            if letter == "D":
                continue
            line = f"{role if letter == 'K' else MADE[state]}:{text}"
            digest.update((line if state == NONE else "\n" + line).encode())
            state = AFTER_KEPT[role[0]][state] if letter == "K" else AFTER_MADE[state]
        return state

    def result(self) -> tuple:
        self._step(True)
        (cost, _, piece, digest), = self.ways.values()
        pieces = []
        while piece:
            piece, letters = piece
            pieces.append(letters)
        self.counts["cost"] = cost
        if self.turns:
            self.counts["gaps"] = int(self.last) - int(self.first) + 1 - self.turns
        return (*self.counts.values(), "".join(reversed(pieces)), digest.hexdigest())


def repair(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) -> a row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256 (of the lines `role:text` that stay)."""
    plain = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    dealt = plain.repartition("conv_id").withColumn("digest", F.sha2("text", 256))
    earlier = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    ordered = (dealt.withColumn("seen", F.row_number().over(earlier) > 1).drop("digest")
               .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "seen"))
    kind = plain.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id string, {', '.join(f'{c} long' for c in FIELDS)}, audit string, repaired_sha256 string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", *FIELDS, "audit", "repaired_sha256"]
        current, held = None, None
        for batch in batches:
            done = []
            for conv, of_conv in groupby(batch.itertuples(index=False, name=None), key=lambda row: row[0]):
                if held is None or conv != current:
                    if held is not None:
                        done.append((current, *held.result()))
                    current, held = conv, Repair()
                for _, turn, role, text, seen in of_conv:
                    held.add(turn, role, text, seen)
            yield pd.DataFrame(done, columns=names)
        if held is not None:
            yield pd.DataFrame([(current, *held.result())], columns=names)

    # Numbers travel as text: beside nulls, pandas would turn them into floats.
    told = ordered.select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text", "seen").mapInPandas(run, schema)
    return told.withColumn("conv_id", F.col("conv_id").cast(kind))


def repaired_rows(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The messages that stay, from rows and their `repair`: conv_id, position (from 1), edit, role, text."""
    plain = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    earlier = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "seen")
    numbered = (plain.withColumn("digest", F.sha2("text", 256)).withColumn("seen", F.row_number().over(earlier))
                .withColumn("at", F.row_number().over(order)).select(F.col("conv_id").alias("conv"), "at", "role", "text"))
    edits = plans.filter("audit <> ''").select("conv_id", F.posexplode(F.split("audit", "")).alias("step", "edit"))
    so_far = Window.partitionBy("conv_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    placed = edits.withColumn("at", F.sum(F.when(F.col("edit") == "I", 0).otherwise(1)).over(so_far))
    # An inserted message has no row of its own.
    met = placed.join(numbered, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("edit") != "I")
                      & (placed["at"] == numbered["at"]), "left")
    stay = met.filter("edit <> 'D'").withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy("step")))
    lead = F.max(F.when((F.col("position") == 1) & (F.col("edit") == "K") & F.col("role").startswith("s"), 1).otherwise(0)).over(
        Window.partitionBy("conv_id"))
    made = F.when((F.col("position") - lead) % 2 == 1, "user").otherwise("assistant")
    return stay.withColumn("made", made).select(
        "conv_id", "position", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(F.col("made")).alias("role"),
        F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """`repair` of the damaged rows, with a row also for each conversation that lost all of its rows."""
    told = repair(damage(rows)).withColumnRenamed("conv_id", "told_id")
    every = rows.select("conv_id").distinct()
    joined = every.join(told, every["conv_id"].eqNullSafe(told["told_id"]), "left").drop("told_id")
    return joined.na.fill(0, list(FIELDS)).na.fill({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})
