"""Plain Python versions of operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACES, WORDS = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[^\x20\x09-\x0D]+")


def exact(rows: list[tuple]) -> dict:
    groups = defaultdict(list)
    for i, text in rows:
        groups[hashlib.sha256(SPACES.sub(" ", text or "").encode()).hexdigest()].append(i)
    return {i: (min(ids), len(ids), i == min(ids), digest) for digest, ids in groups.items() for i in ids}


def shingles(text: str | None) -> frozenset:
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i: i + 5]) for i in range(len(words) - 4))


def near(rows: list[tuple]) -> dict:
    sets, listed = [(i, shingles(text)) for i, text in rows], defaultdict(list)
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, s) in enumerate(sets):
        for j, k in Counter(j for x in s for j in listed[x]).items():
            if 100 * k >= 80 * (len(s) + len(sets[j][1]) - k):
                parent[root(i)] = root(j)
        for x in s:
            listed[x].append(i)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {doc: (len(s), least[root(i)]) for i, (doc, s) in enumerate(sets)}


def repeats(rows: list[tuple], length: int = 100) -> dict:
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if raw[i: i + length] in seen:
                gone[i: i + length] = b"\1" * length
            seen.add(raw[i: i + length])
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out[doc] = (len(raw), sum(gone), spans, bytes(c for c, x in zip(raw, gone) if not x))
    return out


def crc(text: str) -> int:
    return zlib.crc32(text.encode())


def damaged(rows: list[tuple]) -> dict:
    """conversation -> rows (turn, role, text) after damage, in order; also of conversations without any left."""
    out: dict = {}
    for conv, turn, role, text in rows:
        fate = crc(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}") % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        row = (turn, "user" if fate == 4 else role, text)
        out.setdefault(conv, []).extend([row] * (0 if fate == 0 else 2 if fate == 3 else 1))
    return {conv: sorted(of, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for conv, of in out.items()}


def audits(rows: list[tuple]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines of one conversation, by the best way to each state."""
    seen, faults, made = set(), [], {"": "u", "s": "u", "u": "a", "a": "u"}
    for _, role, text in rows:
        last = text.rstrip(" \t\n\v\f\r")[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    names = {"u": "user", "a": "assistant"}

    def inserted(ways: dict) -> dict:
        for _ in range(2):
            for state, (cost, audit, lines) in list(ways.items()):
                to = made[state]
                ways[to] = min(ways.get(to, (10 ** 9,)), (cost + 2, audit + "I", lines + [f"{names[to]}:"]))
        return ways

    ways = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults):
        after: dict = {}

        def offer(state, way):
            after[state] = min(after.get(state, (10 ** 9,)), way)

        for state, (cost, audit, lines) in inserted(ways).items():
            offer(state, (cost + 3, audit + "D", lines))
            if fault in ("", "truncated"):
                more, kind = cost + (fault == "truncated"), role[:1]
                if (kind == "s" and state == "") or (kind in ("u", "a") and made[state] == kind):
                    offer(kind, (more, audit + "K", lines + [f"{role}:{text}"]))
                offer(made[state], (more + 2, audit + "R", lines + [f"{names[made[state]]}:{text}"]))
        ways = after
    cost, audit, lines = min(way for state, way in inserted(ways).items() if state in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), pairs, cost, audit, lines)


def largest(rows: list[tuple], asks, k: int) -> list[tuple]:
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (query, ours) in enumerate(usable):
        if asks(query):
            scored = sorted((-sum(a * b for a, b in zip(ours, v)), i) for j, (i, v) in enumerate(usable) if j != at and len(v) == len(ours))
            out += [(query, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def trie(rows: list[tuple]) -> list[tuple]:
    """Every node of the branched conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved, ends."""
    own: dict = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(r[2], r[4]) for r in sorted(of)] for c, of in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = crc(str(c)) % 4
        path = turns.get(c - int(math.fmod(c, 20)), [])[:h] + turns[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    children = Counter(node[:-1] for node in members if node)
    return sorted((min(of), len(node), min(members[node[:-1]]) if node else -1, len(of), children[node],
                   sum(not children[x] for x in below[node]),
                   sum((len(members[x]) - 1) * len(WORDS.findall(x[-1][1])) for x in below[node] if x),
                   hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()) for node, of in members.items())
