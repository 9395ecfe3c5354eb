"""Repeated windows found in two steps: shared anchors name candidate ranges, then the ranges' own units decide.

Used by the suffix-array dedup (windows of bytes) and by the fingerprint log (windows of words).  A range is a run of
consecutive windows of one text with the same least k-gram hash; equal windows always have the same one, so only
ranges whose hash comes from two places can hold repeats, and only their text is moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.llm import rolling

RANGES = "g long, tk long, a int, b int, inner boolean"


def range_rows(length: int, k: int, unit: str) -> Callable:
    """mapInArrow function: (tk, text) to the ranges of its windows. unit: byte or word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for first, end, data, offsets in rolling.chunks(batch.column(1)):
                if unit == "word":
                    data, starts, ends, offsets = rolling.words(data, offsets)
                    units = rolling.word_hashes(data, starts, ends)
                else:
                    units = rolling.byte_units(data)
                text, g, a, b, inner = rolling.anchors(rolling.prefix(units), offsets, length, k)
                if len(text):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g.view(np.int64)), pa.array(keys[first:end][text]), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(inner)],
                        names=["g", "tk", "a", "b", "inner"],
                    )

    return run


def context_rows(length: int, unit: str) -> Callable:
    """mapInArrow function: (doc_id, text, ranges of (g, salt, a, b)) to (g, salt, doc_id, a, ctx): the bytes of all windows of a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            flat, at = lists.flatten(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            g, salt, a, b = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            for first, end, data, offsets in rolling.chunks(batch.column(1)):
                lo, hi = int(at[first]), int(at[end])
                if lo == hi:
                    continue
                text = np.repeat(np.arange(end - first), np.diff(at[first : end + 1]))
                if unit == "word":
                    _, starts, ends, woff = rolling.words(data, offsets)
                    s, e = starts[woff[text] + a[lo:hi]], ends[woff[text] + b[lo:hi] + length - 1]
                else:
                    s, e = offsets[text] + a[lo:hi], offsets[text] + b[lo:hi] + length
                whole = data.tobytes()
                for i in range(0, hi - lo, 4096):
                    j = min(hi - lo, i + 4096)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g[lo + i : lo + j]), pa.array(salt[lo + i : lo + j]), pa.array(ids[first:end][text[i:j]]), pa.array(a[lo + i : lo + j]), pa.array([whole[x:y] for x, y in zip(s[i:j].tolist(), e[i:j].tolist(), strict=True)], pa.binary())],
                        names=["g", "salt", "doc_id", "a", "ctx"],
                    )

    return run


CONTEXTS = "g long, salt int, doc_id long, a int, ctx binary"


def groups(batches: Iterator[pa.RecordBatch], limit: int, keys: int = 2) -> Iterator[list[tuple]]:
    """Blocks of whole groups, from rows sorted by their first ``keys`` columns, of about ``limit`` bytes of contexts."""
    block: list[tuple] = []
    size, last = 0, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != last:
                if size >= limit:
                    yield block
                    block, size = [], 0
                last = row[:keys]
            block.append(row)
            size += len(row[4]) + 100
    if block:
        yield block


def salted(flagged: DataFrame, most: int) -> DataFrame:
    """(g, n) to the number of parts that a group's rows are dealt to, so that one part has about ``most`` rows."""
    return flagged.withColumn("salts", F.ceil(F.col("n") / F.lit(most)).cast("int"))


def pick_salt(salts: str = "salts") -> F.Column:
    return F.pmod(F.xxhash64("doc_id", "a"), F.col(salts)).cast("int")
