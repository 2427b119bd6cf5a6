"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole. Its tokens have character spans, its sections too, and both are in order, so
the spans are joined as intervals. A token within one section counts there. A token that crosses a boundary is given
to sections by a rule:

* "first": the section in which the token begins (the default);
* "most": the section with most of its characters, the earlier one of equals;
* "split": every section gets the share of its characters.

Spans are counted in characters. Some tokens hold part of a character's bytes; such a token's span is the characters
that it touches, at least one, under all rules. With sections that cover the text, the counts of a document add up to
its tokens. Tokens outside all sections count nowhere.

Defined results: a null or empty text has no tokens; with the default sections it has none either, and gives one row with
section null and no tokens, so that no document vanishes. Repeated rows are counted each. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.bpe import codec, vocabulary_path
from marquee.llm.common import through_python

RULES = ("first", "most", "split")
#: Characters that are encoded in one go.
PIECE = 4_000_000
#: White space of this length overflows the library's stack; such texts take the coder of `bpe`, which has the same vocabulary.
LONG_RUN = re.compile(r"\s{100000}")


def rank_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoding(path: str):
    """A worker's encoding, and the number of bytes of each of its tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, start, end) of the tokens of a text, in characters."""
    encoding, lengths = _encoding(path)
    if LONG_RUN.search(text):
        ids = codec(vocabulary_path()).encode_batch([text])[0].astype(np.int64)
    else:
        ids = np.array(encoding.encode_ordinary(text), np.int64)
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    if text.isascii():
        return ids, starts, ends
    raw = np.frombuffer(text.encode(), np.uint8)
    char_of = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    return ids, char_of[starts], char_of[ends - 1] + 1


LINES = re.compile(r"[^\n]*\n|[^\n]+")


def lines(text: str) -> np.ndarray:
    """The default sections: the lines of a text, line ends included, which cover it."""
    ends = np.array([m.end() for m in LINES.finditer(text)], np.int64)
    return np.stack((np.concatenate(([0], ends[:-1])), ends), axis=1) if len(ends) else np.zeros((0, 2), np.int64)


def allocate(start: np.ndarray, end: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of every section. Sections are (start, end), sorted and apart from each other."""
    counts = np.zeros(len(sections))
    if not len(sections) or not len(start):
        return counts
    left, right = sections[:, 0], sections[:, 1]
    first = np.searchsorted(right, start, side="right")  # the first section that ends after the token begins
    if rule == "first":
        ok = first < len(sections)
        ok[ok] = left[first[ok]] <= start[ok]
        return np.bincount(first[ok], minlength=len(sections)).astype(float)
    last = np.searchsorted(left, end, side="left")  # one past the last section that begins before the token ends
    n = np.maximum(last - first, 0)
    token = np.repeat(np.arange(len(start)), n)
    section = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    shared = np.minimum(end[token], right[section]) - np.maximum(start[token], left[section])
    if rule == "split":
        return np.bincount(section, weights=shared / (end - start)[token], minlength=len(sections))
    order = np.lexsort((section, -shared, token))
    best = order[np.concatenate(([True], token[order][1:] != token[order][:-1]))] if len(order) else order
    return np.bincount(section[best], minlength=len(sections)).astype(float)


def section_tokens(docs: DataFrame, rule: str = "first", sections: Callable[[str], np.ndarray] = lines, path: str | None = None,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, section (from 0), start, end, n_tokens of every section, and doc_tokens of its document."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or rank_file()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    columns = ["section", "start", "end", "n_tokens", "doc_tokens"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids: list = []
            parts: list[np.ndarray] = []
            size = 0
            for i, text in zip(batch["id"], batch["text"]):
                text = text or ""
                tokens, start, end = token_spans(text, path)
                bounds = sections(text)
                counts = allocate(start, end, bounds, rule)
                table = np.full((max(1, len(bounds)), 5), np.nan)
                if len(bounds):
                    table[:, 0], table[:, 1:3], table[:, 3] = np.arange(len(bounds)), bounds, counts
                else:
                    table[0, 3] = 0
                table[:, 4] = len(tokens)
                ids.extend([i] * len(table))
                parts.append(table)
                size += len(text) + len(table)
                if size > PIECE:
                    yield frame(ids, parts)
                    ids, parts, size = [], [], 0
            if parts:
                yield frame(ids, parts)

    def frame(ids: list, parts: list[np.ndarray]) -> pd.DataFrame:
        out = pd.DataFrame(np.concatenate(parts), columns=columns)
        for name in ("section", "start", "end", "doc_tokens"):
            out[name] = out[name].astype("Int64")
        return out.assign(id=pd.Series(ids, dtype=object))[["id", *columns]]

    return through_python(rows, run, "section bigint, start bigint, end bigint, n_tokens double, doc_tokens bigint", name=id_col)
