"""Byte-pair encoding and decoding with a contiguous array of ranks per word.

A text is cut into words by the vocabulary's pattern. A short word is a row of part ids beside a row of the ranks of
adjacent parts. Over and over, the smallest rank is found, the boundary between its two parts is deleted, and the ranks
to the left and right of the new part are looked up anew, until no pair can be merged. Many words of similar length
are rows of one matrix, so each step is a few array operations. Words above `SHORT` bytes keep their boundaries in a
linked list with a heap, which gives the same parts without scanning a long row again and again.

Defined results: a null text counts as empty and has no ids. The strings of added tokens in a text become their ids.
Bytes that are no UTF-8 decode to U+FFFD. Repeated rows are coded alike; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import through_python

#: Words of up to this many bytes are rows of a matrix; wider ones use a heap.
SHORT = 32
WIDTHS = (4, 8, 12, 16, 24, SHORT)
#: Words remembered by a Python worker; a full memory is emptied.
REMEMBERED = 300_000
NONE = np.int64(1 << 40)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


# Fixed value: the pattern that the vocabulary's library cuts texts with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=1)
def cutter() -> Callable[[str], list[str]]:
    """Cuts a text into the words of `PATTERN`.

    For texts within the basic plane the character classes are spelt out for `re`, which is the faster module, and the
    alternatives, which begin with different characters, are tried in the order of their frequency.
    """
    basic = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def ranges(kind: str) -> str:
        runs = [run for half in (basic[:0xD800], basic[0xD800:]) for run in regex.findall(kind + "+", half)]
        return "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in runs)

    letter, number, space = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")
    of_basic = re.compile(f" ?[{letter}]++| ?[{number}]++|'(?:s|t|re|ve|m|ll|d)| ?[^{space}{letter}{number}]++"
                          f"|[{space}]+(?![^{space}])|[{space}]+").findall
    of_any = regex.compile(PATTERN).findall
    return lambda text: of_basic(text) if len(text.encode("utf-16-le")) == 2 * len(text) else of_any(text)


class Codec:
    """Encoder and decoder of one vocabulary file with byte-level parts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] is not None:
            raise ValueError(f"{path} holds no plain byte-level BPE")
        if spec["pre_tokenizer"]["add_prefix_space"] or not spec["pre_tokenizer"]["use_regex"]:
            raise ValueError("only vocabularies without prefix space and with the usual pattern are supported")
        vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.none = max([*vocab.values(), *added.values()]) + 1  # stands for no part
        self.of_byte = np.full(257, self.none, np.int64)
        self.of_byte[:256] = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.bytes_of: list[bytes] = [b""] * self.none
        for text, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in text)
        for text, i in added.items():
            self.bytes_of[i] = text.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * (self.none + 1) + vocab[b] for a, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(merges))))
        self.added = added
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.words = cutter()
        self.known: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * (self.none + 1) + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def _merge_rows(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """ids: a word a row, filled up with `none` on the right. Gives (rows, their parts) as they are finished."""
        rows, ranks = np.arange(len(ids)), self._rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if not ranks.shape[1]:
                yield rows, ids
                return
            least = ranks.argmin(axis=1)
            rank = np.take_along_axis(ranks, least[:, None], 1)[:, 0]
            done = rank == NONE
            if done.any():
                yield rows[done], ids[done]
                live = ~done
                rows, ids, ranks, least, rank = rows[live], ids[live], ranks[live], least[live], rank[live]
                if not len(rows):
                    return
            here = np.arange(len(rows))
            ids[here, least] = self.merged[rank]
            columns = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, columns + (columns > least[:, None]), 1)
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= least[:, None]), 1)
            for at in (least - 1, least):
                ok = np.flatnonzero((at >= 0) & (at < ranks.shape[1]))
                ranks[ok, at[ok]] = self._rank(ids[ok, at[ok]], ids[ok, at[ok] + 1])

    def _merge_long(self, word: bytes) -> bytes:
        """The same merges for one word, smallest rank first and leftmost of equal ones, by a heap of pairs."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(ids) and (rank := self.rank_of.get(ids[i] * (self.none + 1) + ids[j])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else len(ids)
            if j == len(ids) or ids[j] != right:
                continue
            ids[i], ids[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return np.array([i for i in ids if i >= 0], np.uint32).tobytes()

    def _learn(self, words: Iterable[str]) -> None:
        new: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode()
            width = next((w for w in WIDTHS if len(raw) <= w), 0)
            if width:
                new.setdefault(width, []).append((word, raw))
            else:
                self.known[word] = self._merge_long(raw)
        for width, pairs in new.items():
            lengths = np.fromiter((len(raw) for _, raw in pairs), np.int64, len(pairs))
            matrix = np.full((len(pairs), width), 256, np.int64)
            matrix[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(raw for _, raw in pairs), np.uint8)
            for rows, ids in self._merge_rows(self.of_byte[matrix]):
                counts, flat = (ids != self.none).sum(axis=1).tolist(), ids.astype(np.uint32)
                for row, part, n in zip(rows.tolist(), flat, counts):
                    self.known[pairs[row][0]] = part[:n].tobytes()

    def _cut(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.words(text)
        found: list[str] = []
        for i, piece in enumerate(self.special.split(text)):
            found.extend([f"\0{piece}"] if i % 2 else self.words(piece))
        return found

    def encode_batch(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self._cut(text or "") for text in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if not self.known:  # an added token's string cannot be a word: words with a leading NUL never hold letters
            self.known.update({f"\0{t}": np.array([i], np.uint32).tobytes() for t, i in self.added.items()})
        self._learn({word for words in cut for word in words} - self.known.keys())
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), np.uint32) for words in cut]

    def decode(self, ids: Iterable[int]) -> str:
        get = self.bytes_of.__getitem__
        return b"".join(map(get, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """A worker's codec, kept between batches."""
    return Codec(path)


def _pieces(frame: pd.DataFrame, column: str, most: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Parts of a batch with about `most` characters each, so that memory does not follow the batch's row count."""
    sizes = frame[column].str.len().fillna(0).cumsum() // most
    for _, part in frame.groupby(sizes, sort=True):
        yield part


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids: the token ids of every text."""
    path = path or vocabulary_path()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _pieces(batch, "text"):
                yield pd.DataFrame({"id": part["id"], "ids": [x.astype(np.int32) for x in codec(path).encode_batch(part["text"])]})

    return through_python(rows, run, "ids array<int>", name=id_col)


def decode(coded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text: the text of every row of ids; null ids give a null text."""
    path = path or vocabulary_path()
    rows = coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "text": [None if x is None else codec(path).decode(x) for x in batch["ids"]]})

    return through_python(rows, run, "text string", name=id_col)


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded again in one pass over the rows."""
    path = path or vocabulary_path()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = codec(path)
        decimal = [str(i) for i in range(coder.none)]
        for batch in batches:
            for part in _pieces(batch, "text"):
                out = []
                for ids in coder.encode_batch(part["text"]):
                    ids = ids.tolist()
                    listed = ",".join(map(decimal.__getitem__, ids)).encode()
                    out.append((len(ids), hashlib.sha256(listed).hexdigest(),
                                hashlib.sha256(coder.decode(ids).encode()).hexdigest()))
                yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"], index=part.index).assign(id=part["id"])[
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"]]

    return through_python(rows, run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", name=id_col)


