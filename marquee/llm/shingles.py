"""Sets of word shingles as sorted 64-bit hashes, made by array operations over whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words of a shingle.
WIDTH = 5
#: Bytes hashed in one go; longer texts are hashed in pieces that end at white space.
PIECE = 1 << 20
#: Any odd number serves as base; its inverse modulo 2^64 shifts a hash back to the word's own start.
BASE = 0x9E3779B97F4A7C15
FACTORS = np.array([(BASE * (2 * i + 3) ** 7 | 1) % 2**64 for i in range(WIDTH)], np.uint64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(n: int) -> list[np.ndarray]:
    """Powers 0 .. n of the base and of its inverse."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, PIECE + 1)
        _powers[:] = []
        for base in (BASE, pow(BASE, -1, 2**64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
    return _powers


def _hash_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of the bytes."""
    edge = np.diff(np.concatenate(([True], _SPACE[buf], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _table(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * inverse[starts]
    return mixed(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of a lower-cased text, worked out in pieces."""
    hashes, places, at = [], [], 0
    buf = np.frombuffer(text, np.uint8)
    while at < len(buf):
        end = at + PIECE
        if end < len(buf):
            back = np.flatnonzero(_SPACE[buf[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:  # a word longer than a piece
                ahead = np.flatnonzero(_SPACE[buf[end:]])
                end = end + int(ahead[0]) + 1 if len(ahead) else len(buf)
        value, start = _hash_words(buf[at:end])
        hashes.append(value)
        places.append(start + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z in lower case; null and wordless texts have none."""
    raw = [(text or "").encode().lower() for text in texts]
    lengths = np.array([len(r) + 1 for r in raw], np.int64)
    ends = np.cumsum(lengths)
    value, start = words_of(b" ".join([*raw, b""]))
    cut = np.searchsorted(start, np.concatenate(([0], ends)))
    n = len(value) - width + 1
    if n > 0:
        total = np.zeros(n, np.uint64)
        for i in range(width):
            total += value[i: i + n] * FACTORS[i]
        total = mixed(total)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b - a >= width:
            yield np.unique(total[a: b - width + 1])
        elif b > a:  # fewer words than a shingle: the sequence as a whole, apart from all shingles by its length
            yield mixed((value[a:b] * FACTORS[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
