"""Best-fit packing into bins of several permitted capacities.

Documents are dealt to shards of a bounded number of rows (the number of shards grows with the input), and each shard
is packed by itself: items in descending length go to the open bin with the least room that holds them.  The capacity
at which a bin opens depends on the least size that holds its first item, and these choices are optimised jointly: from
the best uniform choice, coordinate descent changes the opening size of one class of items at a time, as long as the
total cost of the shard, every bin downsized to the least size that holds its contents, goes down.  A policy that opens
the size of least cost for the tokens still to come competes with the result.

Lengths are tokens of the vocabulary of ``token_counts``, of whole texts.  Documents longer than the largest capacity
are cut in parts of it; nothing is dropped.  Defined cases: null and empty texts have length 0 and get no bin; without
documents there are no bins; null ids are packed like others; rows repeated with one doc_id are packed each, and dealt
to shards by row, not by id; ties in length go by doc_id; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.llm import rolling
from stepforge.llm.common import stored, table
from stepforge.llm.token_counts import VOCABULARY, count_tokens, encoder

SIZES = (512, 1024, 2048, 4096, 8192)
SHARD_ROWS = 20_000
SCHEMA = "bin_id long, capacity int, used int, doc_id long, part int, length int, start int"


def bin_cost(size: int, overhead: int = 64, square: int = 16_384) -> float:
    """Cost of one sequence: its tokens, a fixed share, and attention that grows with the square."""
    return size + overhead + size * size / square


def _fill(items: Sequence[int], opens: Callable[[int, int], int]) -> tuple[list[list[int]], list[int]]:
    """(items of each bin, room left when opened) for items in descending order; opens: (item, tokens to come) to a size."""
    bins: list[list[int]] = []
    used: list[int] = []
    room: list[tuple[int, int]] = []
    left = sum(items)
    for i, n in enumerate(items):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            r, b = room.pop(at)
        else:
            r, b = opens(n, left), len(bins)
            bins.append([])
            used.append(0)
        bins[b].append(i)
        used[b] += n
        left -= n
        if r > n:
            insort(room, (r - n, b))
    return bins, used


def pack(items: Sequence[int], sizes: Sequence[int] = SIZES, cost: Callable[[int], float] = bin_cost, passes: int = 3) -> tuple[list[list[int]], list[int], float]:
    """(items of each bin, its capacity, total cost) of the cheapest packing found. items: descending lengths, none above the largest size."""
    sizes = sorted(sizes)
    price = {c: cost(c) for c in sizes}
    least = lambda n: bisect_left(sizes, n)

    def packed(opens: Callable[[int, int], int]) -> tuple[list[list[int]], list[int], float]:
        bins, used = _fill(items, opens)
        caps = [sizes[least(u)] for u in used]
        return bins, caps, sum(price[c] for c in caps)

    def by_class(choice: Sequence[int]) -> tuple[list[list[int]], list[int], float]:
        return packed(lambda n, left: sizes[choice[least(n)]])

    k = len(sizes)
    choice, best = min((([max(i, j) for i in range(k)], by_class([max(i, j) for i in range(k)])) for j in range(k)), key=lambda x: x[1][2])
    classes = sorted({least(n) for n in items}, reverse=True)
    for _ in range(passes):
        before = best[2]
        for i in classes:
            for j in range(i, k):
                if j != choice[i]:
                    other = [*choice[:i], j, *choice[i + 1 :]]
                    got = by_class(other)
                    if got[2] < best[2]:
                        choice, best = other, got
        if best[2] == before:
            break
    greedy = packed(lambda n, left: min((c for c in sizes if c >= n), key=lambda c: (price[c] / min(c, left), c)))
    return greedy if greedy[2] < best[2] else best


def _pack_shard(sizes: Sequence[int]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    largest = max(sizes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        rows = rows.sort_values(["length", "doc_id"], ascending=[False, True], kind="stable", na_position="last")
        items = []
        for doc, n in zip(rows["doc_id"].tolist(), rows["length"].tolist(), strict=True):
            doc = None if pd.isna(doc) else int(doc)
            part = 0
            while n > largest:
                items.append((largest, doc, part))
                n, part = n - largest, part + 1
            items.append((int(n), doc, part))
        items.sort(key=lambda x: -x[0])
        bins, caps, _ = pack([x[0] for x in items], sizes)
        out = []
        for b, (inside, cap) in enumerate(zip(bins, caps, strict=True)):
            at, used = 0, sum(items[i][0] for i in inside)
            for i in inside:
                n, doc, part = items[i]
                out.append((shard << 32 | b, cap, used, doc, part, n, at))
                at += n
        got = pd.DataFrame(out, columns=["bin_id", "capacity", "used", "doc_id", "part", "length", "start"])
        got["doc_id"] = got["doc_id"].astype("Int64")
        return got

    return run


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, length): the tokens of each whole text."""
    with open(vocabulary, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, under 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(raw.value)
        for batch in batches:
            for first, end, data, offsets in rolling.chunks(batch.column(1)):
                n = [count_tokens(data[offsets[i] : offsets[i + 1]].tobytes(), known) for i in range(end - first)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(n, pa.int64())], names=["doc_id", "length"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, length long")


def pack_lengths(lengths: DataFrame, sizes: Sequence[int] = SIZES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Bins for lengths (doc_id, length): one row for each part of a document."""
    rows = stored(lengths.where("length > 0").select("doc_id", "length", F.monotonically_increasing_id().alias("row")), "lengths")
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.select("doc_id", "length", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("long").alias("shard"))
    return rows.groupBy("shard").applyInPandas(_pack_shard(tuple(sizes)), SCHEMA)


def pack_documents(docs: DataFrame, sizes: Sequence[int] = SIZES, shard_rows: int = SHARD_ROWS, vocabulary: str = VOCABULARY) -> DataFrame:
    return pack_lengths(token_lengths(docs, vocabulary), sizes, shard_rows)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
