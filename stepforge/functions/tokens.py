"""Terms of many texts at once: positions of tokens are found by array operations, words are numbered by Arrow."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Characters that are tokenised together; a longer text is taken alone.
CHARS = 4 << 20
DIGITS, LETTERS = range(48, 58), range(97, 123)


@cache
def _inside() -> np.ndarray:
    """Whether a code point is a letter, mark, number or underscore: tokens are the longest runs of such."""
    return np.array([c == 95 or unicodedata.category(chr(c))[0] in "LMN" for c in range(sys.maxunicode + 1)])


@cache
def _plain(digits: bool) -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, dtype=bool)
    out[list(LETTERS) + (list(DIGITS) if digits else [])] = True
    return out


class Tokens(NamedTuple):
    words: pa.Array  # the distinct terms
    ids: np.ndarray  # of each term that stands in the texts, its number in words
    line: np.ndarray  # and its line, counted over all texts
    doc: np.ndarray  # the text of each line
    pos: np.ndarray  # the place of each line in its text
    filled: np.ndarray  # whether it holds more than spaces


def tokens(texts: list[str | None], digits: bool, stop: tuple[str, ...] = ()) -> Tokens:
    """The terms of lower-cased texts: tokens of two ASCII letters (or digits) or more that aren't in ``stop``, by line."""
    lower = ["" if t is None else t.lower() for t in texts]
    code = np.frombuffer(("\n".join(lower) + "\n").encode("utf-32-le"), dtype=np.uint32)
    breaks = np.flatnonzero(code == 10)
    begin = np.concatenate(([0], breaks[:-1] + 1))
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in lower])[:-1])).astype(np.int64)
    doc = np.searchsorted(first, begin, side="right") - 1
    pos = np.arange(len(begin)) - np.searchsorted(begin, first)[doc]
    seen = np.concatenate(([0], np.cumsum(code != 32, dtype=np.int32)))
    filled = seen[breaks] > seen[begin]

    inside = _inside()[code]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    other = np.concatenate(([0], np.cumsum(inside & ~_plain(digits)[code], dtype=np.int32)))
    good = (end - start >= 2) & (other[end] == other[start])
    start, end = start[good], end[good]
    step = np.zeros(len(code) + 1, dtype=np.int8)
    step[start] = 1
    step[end] -= 1
    data = code[np.cumsum(step[:-1], dtype=np.int8).view(bool)].astype(np.uint8)
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
    held = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    ids, line = held.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(breaks, start)
    out = np.array([w in stop for w in held.dictionary.to_pylist()], dtype=bool) if stop else np.zeros(len(held.dictionary), dtype=bool)
    keep = ~out[ids] if len(ids) else np.zeros(0, dtype=bool)
    return Tokens(held.dictionary, ids[keep], line[keep], doc, pos, filled)


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch whose texts have ``CHARS`` bytes together, or one text."""
    texts = batch.column(column)
    size = np.cumsum(np.nan_to_num(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHARS, side="right")))
        part = batch.slice(at, upto - at)
        yield part, part.column(column).to_pylist()
        at = upto


def pairs(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of numbers (b below n), and how often each stands."""
    keys, count = np.unique(a.astype(np.int64) * n + b, return_counts=True)
    return keys // n, keys % n, count
