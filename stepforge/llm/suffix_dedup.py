"""Suffix-array dedup: removes bytes covered by long strings that start at two places.

A difference-cover suffix array is built block by block (``suffix_array``).  Its buckets are not cut by the suffixes'
first bytes but by the least hash of their 64-byte grams, which equal strings share and which is known from one scan.
A range is a run of windows of one text in one bucket; its hull is the text they cover.  Ranges with equal hulls are
repeats as they stand; of each hull one range stands for all in the sort, and buckets of a single place are left out
before any text moves.  The rest are sorted one block of buckets at a time, by bucket and suffix, long ties being
resolved by the ranks of the block's cover sample.  A bucket of too many different hulls (a passage in very many
contexts) is divided by longer grams, which equal strings share too, until each part fits or holds one window only; so
no bucket is dealt at random, and its rows grow with its places, not with their square.

Defined cases: a null text is empty; texts shorter than ``length`` keep everything; rows repeated with the same
doc_id are separate texts (and so remove each other); rows with a null doc_id are texts like others; without documents
nothing is returned; extra columns are ignored by ``dedup`` and kept, whatever their names, by ``strip_repeats``.
Texts are named by 128 bits, equal hulls by two independent 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.llm import rolling, suffix_array, windows
from stepforge.llm.common import discard, fresh, stored, table, text_keys

LENGTH = 400
#: Bytes of the grams whose least hash names a bucket.
GRAM = 64
#: Different hulls of one bucket that are sorted together; larger buckets are divided by grams shorter than the window by FINER bytes.
MOST = 2048
FINER = (48, 6, 0)
BLOCK = 1 << 20
KEY = ["k1", "k2"]
RANGES = "g long, k1 long, k2 long, a int, b int, hull long, inner boolean"
CONTEXTS = "g long, k1 long, k2 long, a int, ctx binary"
FOUND = "k1 long, k2 long, s int, e int"
CUT = "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _ranges(length: int, k: int) -> Callable:
    """(k1, k2, text) to the ranges of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, end, data, offsets in rolling.chunks(batch.column(2)):
                text, g, a, b, inner = rolling.anchors(rolling.prefix(rolling.byte_units(data)), offsets, length, k)
                if len(text):
                    p = rolling.prefix(rolling.byte_units(data, 1), 1)
                    hull = rolling.span(p, offsets[text] + a, offsets[text] + b + length, 1)
                    yield _batch(RANGES, [g.view(np.int64), k1[first:end][text], k2[first:end][text], a, b, hull.view(np.int64), inner])

    return run


def _structs(lists: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets by row, and the fields, of a column of arrays of structs."""
    flat, at = lists.flatten(), np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
    return at, [flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)]


def _divided(length: int, k: int) -> Callable:
    """(k1, k2, text, ranges of (g, a, b)) to the parts of these ranges by the least hash of longer grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at, (g, a, b) = _structs(batch.column(3))
            for first, end, data, offsets in rolling.chunks(batch.column(2)):
                text = np.repeat(np.arange(end - first), np.diff(at[first : end + 1]))
                own = slice(int(at[first]), int(at[end]))
                lo, hi = offsets[text] + a[own], offsets[text] + b[own]
                order = np.argsort(lo, kind="stable")
                text, lo, hi, parent = text[order], lo[order], hi[order], g[own][order].view(np.uint64)
                owner, fine, x, y, inner = rolling.anchors(rolling.prefix(rolling.byte_units(data)), offsets, length, k)
                x, y = offsets[owner] + x, offsets[owner] + y
                head, tail = np.searchsorted(y, lo, "left"), np.searchsorted(x, hi, "right")
                count = tail - head
                row = np.repeat(np.arange(len(lo)), count)
                part = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + head[row]
                s, e, inner = np.maximum(x[part], lo[row]), np.minimum(y[part], hi[row]), inner[part]
                hull = rolling.span(rolling.prefix(rolling.byte_units(data, 1), 1), s, e + length, 1)
                name = rolling.mix(parent[row] * np.uint64(0x9E3779B97F4A7C15) + fine[part])
                base = offsets[text[row]]
                if len(row):
                    yield _batch(RANGES, [name.view(np.int64), k1[first:end][text[row]], k2[first:end][text[row]], s - base, e - base, hull.view(np.int64), inner & (e > s)])

    return run


def _contexts(length: int) -> Callable:
    """(k1, k2, text, ranges of (g, a, b)) to the bytes that the windows of each range cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at, (g, a, b) = _structs(batch.column(3))
            for first, end, data, offsets in rolling.chunks(batch.column(2)):
                text = np.repeat(np.arange(end - first), np.diff(at[first : end + 1])) + first
                whole, low = data.tobytes(), int(at[first])
                for i in range(0, len(text), 4096):
                    t, own = text[i : i + 4096], slice(low + i, low + min(len(text), i + 4096))
                    s = offsets[t - first] + a[own]
                    e = offsets[t - first] + b[own] + length
                    yield _batch(CONTEXTS, [g[own], k1[t], k2[t], a[own], [whole[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)]])

    return run


def _sort_block(rows: list[tuple], length: int) -> list[tuple]:
    """Rows (g, k1, k2, a, ctx) of whole buckets to the spans (k1, k2, s, e) of their repeated strings."""
    lens = np.array([len(r[4]) for r in rows])
    text = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
    n = lens - length + 1
    base = np.concatenate(([0], np.cumsum(n)))
    starts = np.arange(base[-1]) - np.repeat(base[:-1] - (np.cumsum(lens) - lens), n)
    names = np.array([r[0] for r in rows], np.int64)
    bucket = np.repeat(np.cumsum(np.concatenate(([0], names[1:] != names[:-1]))), n)
    lo, hi = rolling.runs(suffix_array.repeated(text, starts, length, bucket))
    out = []
    for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
        row = int(np.searchsorted(base, x, "right")) - 1
        while x < y:  # a run may go on in the next row
            end = min(y, int(base[row + 1]))
            _, k1, k2, a, _ = rows[row]
            out.append((k1, k2, a + x - int(base[row]), a + end - int(base[row]) - 1 + length))
            x, row = end, row + 1
    return out


def _sorter(length: int, limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in windows.groups(batches, limit, 1):
            out = _sort_block(block, length)
            for i in range(0, len(out), 50_000):
                yield _batch(FOUND, list(zip(*out[i : i + 50_000], strict=True)))

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text, whole, spans) to what is left of each text."""
    for batch in batches:
        out, size = [], 0
        columns = [batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3), batch.column(4)]
        for k1, k2, raw, whole, spans in zip(*(c.to_pylist() for c in columns), strict=True):
            spans = [*(whole or ()), *(spans or ())]
            cuts = rolling.merged(np.array([x["s"] for x in spans]), np.array([x["e"] for x in spans]))
            kept, at = [], 0
            for a, b in cuts:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            rest = b"".join(kept)
            out.append((k1, k2, len(raw) - len(rest), len(cuts), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
            size += len(rest)
            if size > 8 << 20:
                yield _batch(CUT, list(zip(*out, strict=True)))
                out, size = [], 0
        if out:
            yield _batch(CUT, list(zip(*out, strict=True)))


def _judged(ranges: DataFrame, most: int, last: bool) -> DataFrame:
    """ranges (distinct) of buckets with more than one place or a self-repeat: g, k1, k2, a, b, whole, sort, hot.

    whole: equal hulls are repeats; sort: stands for its hull in its bucket's sort; hot: in the division of its bucket.
    """
    place, name = F.struct(*KEY, "a"), ["g", "hull", "w"]
    ranges = ranges.withColumn("w", F.col("b") - F.col("a"))
    hulls = ranges.groupBy(*name).agg(F.min(place).alias("p"), F.max(place).alias("q"), F.max("inner").alias("inner"))
    buckets = hulls.groupBy("g").agg(F.count("*").alias("m"), F.min("p").alias("low"), F.max("q").alias("high"))
    hulls = hulls.withColumn("many", F.col("p") != F.col("q")).join(buckets, "g")
    if last:  # a bucket is one window, or a run of equal ones
        hulls = hulls.select(*name, "p", ((F.col("low") != F.col("high")) | (F.col("w") > 0)).alias("whole"), F.lit(False).alias("sort"), F.lit(False).alias("hot"))
    else:
        more = (F.col("m") > 1) | (F.col("inner") & ~F.col("many"))
        hulls = hulls.select(*name, "p", F.col("many").alias("whole"), (more & (F.col("m") <= most)).alias("sort"), (more & (F.col("m") > most)).alias("hot"))
    hulls = hulls.where("whole or sort or hot")
    first = place == F.col("p")
    out = ranges.join(hulls, name).select("g", *KEY, "a", "b", "whole", (F.col("sort") & first).alias("sort"), (F.col("hot") & first).alias("hot"))
    return out.where("whole or sort or hot")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(texts, cuts) of docs (doc_id, text).

    texts: k1, k2, doc_id (the least), copies for every distinct text.  cuts: k1, k2, text, whole and spans (arrays of s,
    e; bytes covered by a repeated string, unmerged) for distinct texts that hold such bytes and aren't whole copies.
    """
    k1, k2 = text_keys(F.col("text"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"k1": k1, "k2": k2})
    texts = stored(rows.groupBy(*KEY).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "texts")
    long = rows.where(F.octet_length("text") >= length)
    ranges = stored(long.select(*KEY, "text").mapInArrow(_ranges(length, gram), RANGES), "ranges")
    place = F.struct(*KEY, "a")
    buckets = ranges.groupBy("g").agg(F.min(place).alias("p"), F.max(place).alias("q"), F.max("inner").alias("inner")).where("p <> q or inner").select("g")
    places = stored(ranges.join(buckets, "g").distinct(), "flagged")
    discard(ranges)
    judged = _judged(places, most, False)
    span, part = F.struct(F.col("a").alias("s"), (F.col("b") + length).alias("e")), F.struct("g", "a", "b")
    lists = judged.groupBy(*KEY).agg(*(F.collect_list(F.when(F.col(c), x)).alias(c) for c, x in (("whole", span), ("sort", part), ("hot", part))))
    lists = lists.join(texts, KEY)
    same = (F.col("r.k1") == F.col("l.k1")) & (F.col("r.k2") == F.col("l.k2")) & F.col("r.doc_id").eqNullSafe(F.col("l.doc_id"))
    candidates = stored(long.alias("r").join(lists.alias("l"), same).select("r.k1", "r.k2", "r.text", "l.whole", "l.sort", "l.hot", "l.copies"), "candidates")
    discard(places)
    contexts = candidates.where("size(sort) > 0").select(*KEY, "text", "sort").mapInArrow(_contexts(length), CONTEXTS)
    spans, read = None, [texts, candidates]
    hot = candidates.where("size(hot) > 0").select(*KEY, "text", "hot")
    for step in (x for x in FINER if length - x > gram):
        if not hot.limit(1).count():
            break
        parts = stored(hot.mapInArrow(_divided(length, length - step), RANGES).distinct(), "parts")
        judged = stored(_judged(parts, most, step == 0), "judged")
        own = judged.where("whole").select(*KEY, F.col("a").alias("s"), (F.col("b") + length).alias("e"))
        spans = own if spans is None else spans.union(own)
        again = judged.where("sort or hot").groupBy(*KEY).agg(*(F.collect_list(F.when(F.col(c), part)).alias(c) for c in ("sort", "hot")))
        again = stored(hot.select(*KEY, "text").join(again, KEY), "again")
        read += [parts, judged, again]
        contexts = contexts.union(again.where("size(sort) > 0").select(*KEY, "text", "sort").mapInArrow(_contexts(length), CONTEXTS))
        hot = again.where("size(hot) > 0").select(*KEY, "text", "hot")
    found = stored(contexts.repartition("g").sortWithinPartitions("g").mapInArrow(_sorter(length, block), FOUND), "found")
    spans = found if spans is None else found.union(spans)
    cuts = spans.groupBy(*KEY).agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    cuts = candidates.where("copies = 1").select(*KEY, "text", "whole").join(cuts, KEY, "left").where("size(whole) > 0 or spans is not null")
    cuts._stepforge_read = [*read, found]
    return texts, cuts


def dedup(docs: DataFrame, length: int = LENGTH, **how: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text)."""
    texts, cuts = repeats(docs, length, **how)
    cut = cuts.select(*KEY, "text", "whole", "spans").mapInArrow(_cut, CUT).drop("kept")
    k1, k2 = text_keys(F.col("text"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", k1.alias("k1"), k2.alias("k2"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    whole = F.when((F.col("copies") > 1) & (F.col("n_bytes") >= length), True)
    return (
        rows.join(texts.select(*KEY, "copies"), KEY)
        .join(cut, KEY, "left")
        .select(
            "doc_id",
            "n_bytes",
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        )
    )


def strip_repeats(docs: DataFrame, length: int = LENGTH, **how: int) -> DataFrame:
    """docs with every covered byte cut from its text, as ``dedup`` judges it, and n_chars (if there) counted anew.

    Rows of which nothing is left go; rows that came with an empty text stay.  Bytes of a character that a cut has
    broken are dropped.
    """
    texts, cuts = repeats(docs, length, **how)
    a, b, kept, gone = (fresh(docs, c) for c in ("text_key1", "text_key2", "kept_text", "whole_copy"))
    cut = cuts.select(*KEY, "text", "whole", "spans").mapInArrow(_cut, CUT).select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("kept").alias(kept))
    copied = texts.where("copies > 1").select(F.col("k1").alias(a), F.col("k2").alias(b), F.lit("").alias(gone))
    k1, k2 = text_keys(F.col("text"))
    rows = docs.withColumns({a: k1, b: k2}).join(cut, [a, b], "left").join(copied, [a, b], "left")
    rows = rows.withColumn(kept, F.coalesce(kept, F.when(F.octet_length("text") >= length, F.col(gone)))).where(F.col(kept).isNull() | (F.col(kept) != ""))
    rows = rows.withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    out = rows.select(*docs.columns)
    out._stepforge_read = cuts._stepforge_read  # tables for ``discard``, once the result is stored
    return out


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))

