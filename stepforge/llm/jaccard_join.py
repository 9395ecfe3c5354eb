"""Size-aware heavy-light join of shingle sets by Jaccard similarity, and the components of its links.

Sets of equal content are one class from the start.  Light (small) classes enumerate the fixed-size subsets that a
partner of a given size must share; heavy (large) ones are put in inverted lists by the prefix of their set, in a
global order that puts shingles of many documents last.  The boundary between them is the size at which the rows both
ways make cost least, computed from the sizes of all classes.  Each list first pairs its members with one pivot (as
many pairs as members); once the components of the verified links are known, members that may be linked with one of
another component are compared within their lists, block by block, and a block gives fewer links than it has members.
So no link between components is lost, and a group of m near copies costs m pairs.

Defined cases: null and empty texts have an empty set and are linked with nothing; a null doc_id is kept, and never
names a component unless it is alone; rows repeated with one doc_id are each returned; extra columns are ignored.
Shingles are 64-bit hashes, of which verification compares 48 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stepforge.llm import rolling
from stepforge.llm.common import components, discard, fresh, stored, table

WORDS = 5
PERCENT = 75
#: Shingles seen in so many sets (counted where a batch of rows holds two or more) come last in the order.  The order
#: decides cost only, never the result; at most ORDERED shingles, the most frequent ones, are sent to the executors.
FREQUENT = 8
ORDERED = 200_000
#: A row in an inverted list costs so many rows more, for verification.
VERIFY = 4
LIGHT_MOST = 12
#: Ids that are broadcast to fetch texts for verification; more are joined by a shuffle.
BROADCAST = 50_000
#: Members of a list that one task compares with as many others, where a list has several components.
PART = 4096
#: Shingles of the members of one part, where members that may be linked are compared by their sets.
PART_SHINGLES = 262_144


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    for first, end, data, offsets in rolling.chunks(column):
        data, starts, ends, woff = rolling.words(data, offsets, lower=True)
        p = rolling.prefix(rolling.word_hashes(data, starts, ends))
        g = rolling.grams(p, words)
        lo = woff.tolist()
        for i in range(end - first):
            a, b = lo[i], lo[i + 1]
            if b - a >= words:
                s = np.sort(g[a : b - words + 1])
                if len(s) > 1:
                    keep = np.empty(len(s), bool)
                    keep[0] = True
                    np.not_equal(s[1:], s[:-1], out=keep[1:])
                    s = s[keep]
            elif b > a:
                s = rolling.span(p, np.array([a]), np.array([b]))
            else:
                s = np.empty(0, np.uint64)
            yield first + i, s


def _key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    if not len(s):
        return 0, 0
    a = rolling.mix(np.array([np.bitwise_xor.reduce(s), np.add.reduce(rolling.mix(s ^ np.uint64(0x5851F42D4C957F2D)))], np.uint64))
    b = rolling.mix(a[:1] + np.uint64(3) * a[1:] + np.uint64(len(s)))
    return int(b.view(np.int64)[0]), int(a[1:].view(np.int64)[0])


def sketch(s: np.ndarray) -> bytes:
    """Parities of the shingles by bucket, at least two buckets a shingle: the number of differing bits of two sketches
    (the longer one folded) is at most the size of the sets' symmetric difference."""
    bits = max(512, 1 << int(2 * len(s) - 1).bit_length()) if len(s) else 512
    counts = np.bincount(((s >> np.uint64(13)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def may_link(x: bytes, y: bytes, s: int, t: int, percent: int = PERCENT) -> bool:
    """False only if sets of sizes s and t with these sketches can't be linked."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) <= s + t - 2 * overlap(s, t, percent)


def _classes(words: int) -> Callable:
    """(doc_id, text) to one row a text (kind 0: doc_id, n, k1, sketch) and the batch's repeated shingles (kind 1: hash, sets)."""
    names = ["kind", "id", "n", "k1", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, sketches, seen, held, size = [], [], [], set(), [], 0
            hashes, counts = [], []

            def counted(held: list) -> None:
                if held:
                    h, c = np.unique(np.concatenate(held), return_counts=True)
                    hashes.append(h[c > 1])
                    counts.append(c[c > 1])

            for _, s in shingle_sets(batch.column(1), words):
                key = _key(s)
                n.append(len(s))
                k1.append(key[0])
                sketches.append(sketch(s) if key not in seen else None)
                if key not in seen:
                    seen.add(key)
                    held.append(s)
                    size += len(s)
                    if size > 2_000_000:
                        counted(held)
                        held, size = [], 0
            counted(held)
            kind = np.zeros(len(n), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(kind), batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(sketches, pa.binary())], names=names)
            for h, c in zip(hashes, counts, strict=True):
                if len(h):
                    z = np.zeros(len(h), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32)), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64)), pa.array(z), pa.nulls(len(h), pa.binary())], names=names)

    return run


def overlap(s: int, t: int, percent: int = PERCENT) -> int:
    """Least intersection of linked sets of sizes s and t."""
    return -(-percent * (s + t) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def partner_sizes(n: int, percent: int = PERCENT) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_rows(n: int, bound: int, percent: int = PERCENT) -> int:
    return sum(comb(n, overlap(n, t, percent)) for t in partner_sizes(n, percent) if t <= bound)


def boundary(sizes: dict[int, int], percent: int = PERCENT, most: int = LIGHT_MOST) -> int:
    """The largest light size that makes the rows of both ways least, from the number of classes of each size."""

    def cost(b: int) -> int:
        total = 0
        for n, count in sizes.items():
            light = subset_rows(n, b, percent) if n <= b else 0
            lists = prefix_length(n, percent) * (1 + VERIFY) if n > b or 100 * n // percent > b else 0
            total += count * (light + lists)
        return total

    return min(range(most + 1), key=lambda b: (cost(b), b))


def subsets(s: np.ndarray, bound: int, percent: int = PERCENT) -> Iterator[int]:
    """Keys of the fixed-size subsets of a light set, one family for each partner size up to the boundary."""
    n = len(s)
    for t in partner_sizes(n, percent):
        if t <= bound:
            family = (min(n, t) * 1000 + max(n, t)) * 0x9E3779B97F4A7C15
            for part in combinations(s.tolist(), overlap(n, t, percent)):
                x = family
                for v in part:
                    x = (x ^ v) * 0xD6E8FEB86659FD93 & (2**64 - 1)
                    x ^= x >> 32
                yield x


def _postings(words: int, percent: int, bound: int, frequent: bytes, counts: bytes) -> Callable:
    """text to (h, k1): subsets of light sets, prefixes of heavy ones."""
    often, times = np.frombuffer(frequent, np.uint64), np.frombuffer(counts, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            h, k, lens = [], [], []
            size = 0

            def out() -> pa.RecordBatch:
                hashes = np.concatenate(h)
                return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.repeat(np.array(k, np.int64), lens))], names=["h", "k1"])

            for _, s in shingle_sets(batch.column(0), words):
                n = len(s)
                key = _key(s)[0] if n else 0
                if not n or key in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(key)
                rows = []
                if n <= bound:
                    rows.append(np.array(list(subsets(s, bound, percent)), np.uint64))
                if n > bound or 100 * n // percent > bound:
                    p = prefix_length(n, percent)
                    if len(often):
                        at = np.searchsorted(often, s)
                        at[at == len(often)] = 0
                        late = often[at] == s
                        if late.any():
                            end = s[late]
                            s = np.concatenate([s[~late], end[np.argsort(times[at[late]], kind="stable")]])
                    rows.append(s[:p])
                for r in rows:
                    h.append(r)
                    k.append(key)
                    lens.append(len(r))
                    size += len(r)
                if size > 200_000:
                    yield out()
                    h, k, lens, size = [], [], [], 0
            if h:
                yield out()

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, k1) sorted by both to (h, pivot, k1) of every list's members after its first."""
    h0 = k0 = pivot = None
    for batch in batches:
        h, k = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(h):
            continue
        new = np.empty(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new[0] = h0 is None or h[0] != h0
        again = np.zeros(len(h), bool)
        again[1:] = (k[1:] == k[:-1]) & ~new[1:]
        again[0] = not new[0] and k[0] == k0
        at = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        first = np.where(at < 0, 0 if pivot is None else pivot, k[np.maximum(at, 0)])
        keep = ~new & ~again
        h0, k0, pivot = h[-1], k[-1], first[-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(first[keep]), pa.array(k[keep])], names=["h", "pivot", "k1"])


def _set_bytes(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, s, size = [], [], 0
            for row, x in shingle_sets(batch.column(1), words):
                key = batch.column(0)[row].as_py()
                if _key(x)[0] != key:  # another text of a repeated doc_id
                    continue
                k.append(key)
                s.append((x >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                size += len(s[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(s, pa.binary())], names=["k1", "members"])
                    k, s, size = [], [], 0
            if k:
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(s, pa.binary())], names=["k1", "members"])

    return run


def _members(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _near(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            keep = pa.array([may_link(x, y, s, t, percent) for _, _, x, y, s, t in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def folded(raw: bytes, size: int = 64) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of each block; rows come sorted by their first ``keys`` columns."""
    rows: list[tuple] = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and rows[0][:keys] != r[:keys]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def _candidates(i: int, j: np.ndarray, root: np.ndarray, n: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """Those of j that are of another component than i and that size and folded sketch allow."""
    j = j[(root[j] != root[i]) & (n[j] * 100 >= n[i] * percent) & (n[i] * 100 >= n[j] * percent)]
    if not len(j):
        return j
    most = n[i] + n[j] - 2 * -(-percent * (n[i] + n[j]) // (100 + percent))
    return j[np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1) <= most]


def _cross(percent: int) -> Callable:
    """Members (h, p, q, k1, root, n, sketch, own) of two parts of a list to those that may be linked with a member of
    another component: at most one row a member of a block, however many partners it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, 3):
            root, n, own = (np.array([r[i] for r in rows], np.int64) for i in (4, 5, 7))
            bits = np.stack([folded(r[6]) for r in rows]).view(np.uint64)
            p, q = rows[0][1], rows[0][2]
            right, marked = np.flatnonzero(own == q), np.zeros(len(rows), bool)
            for i in np.flatnonzero(own == p).tolist():
                j = right[right > i] if p == q else right
                for x in _candidates(i, j[~marked[j]] if marked[i] else j, root, n, bits, percent).tolist():
                    if not (marked[i] and marked[x]) and may_link(rows[i][6], rows[x][6], n[i], n[x], percent):
                        marked[i] = marked[x] = True
            close = [rows[i][:7] for i in np.flatnonzero(marked).tolist()]
            if close:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 6 else pa.int64()) for i, c in enumerate(zip(*close, strict=True))], names=["h", "p", "q", "k1", "root", "n", "sketch"])

    return run


def _joined(percent: int) -> Callable:
    """Members (h, p, q, r, s, k1, root, n, sketch, members) of a block to verified links (a, b) that give its
    components: a pair that links found before already connect is not compared, so links are fewer than members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, 5):
            k, root, n = (np.array([r[i] for r in rows], np.int64) for i in (5, 6, 7))
            bits = np.stack([folded(r[8]) for r in rows]).view(np.uint64)
            a, b = [], []
            for i in range(len(rows)):
                left = None
                for j in _candidates(i, np.arange(i + 1, len(rows)), root, n, bits, percent).tolist():
                    if root[i] == root[j] or not may_link(rows[i][8], rows[j][8], n[i], n[j], percent):
                        continue
                    left = _members(rows[i][9]) if left is None else left
                    both = np.sort(np.concatenate([left, _members(rows[j][9])]))
                    shared = int(np.count_nonzero(both[1:] == both[:-1]))
                    if 100 * shared >= percent * (len(both) - shared):
                        a.append(min(k[i], k[j]))
                        b.append(max(k[i], k[j]))
                        root[root == root[j]] = root[i]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _verified(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                x, y = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                if x != last:
                    last, left = x, _members(x)
                right = _members(y)
                both = np.sort(np.concatenate([left, right]))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * shared >= percent * (len(both) - shared):
                    a.append(batch.column(0)[i].as_py())
                    b.append(batch.column(1)[i].as_py())
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(classes, edges): classes has doc_id, n, k1 for each row of docs (doc_id, text); edges (a, b) are links of different classes that give the components."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    both = stored(texts.mapInArrow(_classes(words), "kind int, id long, n long, k1 long, sketch binary"), "classes")
    classes = both.where("kind = 0").select(F.col("id").alias("doc_id"), "n", "k1")
    distinct = stored(both.where("kind = 0 and n > 0").withColumnRenamed("id", "doc_id").groupBy("k1").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("sketch").alias("sketch")), "distinct")
    often = both.where("kind = 1").groupBy(F.col("id").alias("h")).agg(F.sum("n").alias("c")).where(F.col("c") >= FREQUENT).orderBy(F.desc("c"), "h").limit(ORDERED)
    often = often.toPandas()
    h = often["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    sizes = {r["n"]: r["c"] for r in distinct.where(F.col("n") <= 100 * LIGHT_MOST // percent + 1).groupBy("n").agg(F.count("*").alias("c")).collect()}
    bound = boundary(sizes, percent)
    rows = texts.select("text").mapInArrow(_postings(words, percent, bound, h[order].tobytes(), often["c"].to_numpy(np.int64)[order].tobytes()), "h long, k1 long")
    lists = rows.repartition("h").sortWithinPartitions("h", "k1").mapInArrow(_lists, "h long, pivot long, k1 long")
    lists = stored(lists, "lists")

    def fetched(keys: DataFrame) -> DataFrame:
        """(k1, members) of every set named in keys (k1)."""
        needed = stored(keys.distinct().join(distinct.select("k1", F.col("doc_id").alias("holder")), "k1"), "needed")
        few = needed.limit(BROADCAST + 1).count() <= BROADCAST
        sets = texts.join(F.broadcast(needed) if few else needed, F.col("doc_id").eqNullSafe(F.col("holder"))).select("k1", "text").mapInArrow(_set_bytes(words), "k1 long, members binary")
        sets = stored(sets, "sets")
        discard(needed)
        return sets

    def verify(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b): by size, by sketch, and what is left by the sets themselves."""
        near = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
        for c in ("a", "b"):
            pairs = pairs.join(distinct.select(F.col("k1").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")), c)
        kept = stored(pairs.where(near).select("a", "b", "sa", "sb", "na", "nb").mapInArrow(_near(percent), "a long, b long"), "pairs")
        sets, pairs = fetched(kept.select(F.col("a").alias("k1")).union(kept.select("b"))), kept
        for c, m in (("b", "y"), ("a", "x")):
            pairs = pairs.join(sets.select(F.col("k1").alias(c), F.col("members").alias(m)), c)
        edges = stored(pairs.select("a", "b", "x", "y").mapInArrow(_verified(percent), "a long, b long"), "edges")
        discard(kept, sets)
        return edges

    stars = verify(lists.select(F.col("pivot").alias("a"), F.col("k1").alias("b")).distinct())
    roots = stored(components(stars), "roots")
    # lists of two hold one pair, which is done; so are lists whose members are of one component
    sized = lists.join(roots, lists.k1 == roots.node, "left").select("h", "pivot", "k1", F.coalesce("root", "k1").alias("root"))
    mark = F.xxhash64("k1").cast("decimal(38,0)")
    open_lists = sized.groupBy("h", "pivot").agg(F.count("*").alias("m"), F.sum(mark).alias("mark"), F.min("root").alias("p"), F.max("root").alias("q"))
    open_lists = open_lists.join(roots, open_lists.pivot == roots.node, "left").withColumn("r", F.coalesce("root", "pivot")).where("m > 1 and (p <> q or p <> r)")
    # many shingles have the same documents: one list of each is enough
    open_lists = stored(open_lists.groupBy("pivot", "m", "mark").agg(F.min("h").alias("h")).select("h", "pivot", (F.floor(F.col("m") / PART) + 1).alias("parts")), "open")
    members = lists.select("h", "k1").join(open_lists.select("h", "parts"), "h").union(open_lists.select("h", F.col("pivot").alias("k1"), "parts"))
    members = members.join(roots, members.k1 == roots.node, "left").select("h", "k1", F.coalesce("root", "k1").alias("root"), "parts")
    members = members.join(distinct.select("k1", "n", "sketch"), "k1").withColumn("own", F.pmod(F.xxhash64("k1"), F.col("parts")))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    members = members.select("h", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "k1", "root", "n", "sketch", "own")
    close = members.repartition("h", "p", "q").sortWithinPartitions("h", "p", "q").mapInArrow(_cross(percent), "h long, p long, q long, k1 long, root long, n long, sketch binary")
    close = stored(close, "close")
    # blocks of the same members are compared once, in parts of bounded size
    marks = [F.sum(F.xxhash64(F.lit(i), "k1").cast("decimal(38,0)")).alias(f"mark{i}") for i in (0, 1)]
    blocks = close.groupBy("h", "p", "q").agg(F.count("*").alias("m"), F.sum("n").alias("size"), *marks)
    blocks = blocks.groupBy("m", "mark0", "mark1").agg(F.min(F.struct("h", "p", "q")).alias("block"), F.max("size").alias("size"))
    blocks = blocks.select("block.*", (F.floor(F.col("size") / PART_SHINGLES) + 1).alias("parts"))
    chosen = close.join(blocks, ["h", "p", "q"]).withColumn("own", F.pmod(F.xxhash64(F.lit(2), "k1"), F.col("parts")))
    chosen = chosen.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    sets = fetched(close.select("k1"))
    chosen = chosen.join(sets, "k1")
    key = ["h", "p", "q", "r", "s"]
    chosen = chosen.select("h", "p", "q", F.least("own", "other").alias("r"), F.greatest("own", "other").alias("s"), "k1", "root", "n", "sketch", "members")
    more = stored(chosen.repartition(*key).sortWithinPartitions(*key).mapInArrow(_joined(percent), "a long, b long"), "more")
    discard(lists, open_lists, close, sets, roots, distinct)
    return classes, stars.union(more)


def _named(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(classes, named): doc_id, n_shingles, k1 of each row; and each class's root and component."""
    classes, edges = links(docs, words, percent)
    classes = classes.select("doc_id", F.col("n").alias("n_shingles"), "k1")
    roots = components(edges)
    sets = classes.where("n_shingles > 0").groupBy("k1").agg(F.min("doc_id").alias("least"))
    named = sets.join(roots, sets.k1 == roots.node, "left").select("k1", "least", F.coalesce("root", "k1").alias("root"))
    first = named.groupBy("root").agg(F.min("least").alias("component"))
    return classes, named.join(first, "root").select("k1", "root", "component")


def cluster(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    classes, named = _named(docs, words, percent)
    out = classes.join(named, "k1", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def _with_key(words: int, name: str) -> Callable:
    """Rows with their class added under that name (null: an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1 = [_key(s)[0] if len(s) else None for _, s in shingle_sets(batch.column(batch.schema.get_field_index("text")), words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k1, pa.int64())], names=[*batch.schema.names, name])

    return run


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component of docs: of the least doc_id (null last) and, where its texts differ, of the least class.

    Rows without shingles are linked with nothing and stay; of those repeated with one doc_id (not null) one stays.
    """
    classes, named = _named(docs, words, percent)
    rows = stored(classes.join(named, "k1", "left"), "named")
    own, key, first = fresh(docs, "spare_id"), fresh(docs, "class_key"), fresh(docs, "least_key")
    spare = rows.where("n_shingles > 0 and component < doc_id").select(F.col("doc_id").alias(own))
    odd = stored(rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias(own)), "odd")
    if not odd.limit(1).count():
        return docs.join(spare, F.col("doc_id") == F.col(own), "left_anti")
    # a doc_id that is null or repeated doesn't tell the row's component: its class does
    same = F.col("doc_id").eqNullSafe(F.col(own))
    plain = docs.join(odd, same, "left_anti").join(spare, F.col("doc_id") == F.col(own), "left_anti")
    many = docs.join(odd, same, "left_semi")
    many = many.mapInArrow(_with_key(words, key), StructType([*many.schema.fields, StructField(key, LongType())]))
    least = rows.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1")).alias("x"))
    least = least.select(F.col("x.doc_id").alias(own), F.col("x.k1").alias(first))
    chosen = many.join(least, (F.col(key) == F.col(first)) & same, "left_semi").dropDuplicates(["doc_id", key])
    bare = many.where(F.col(key).isNull())
    for part in (chosen, bare.where("doc_id is not null").dropDuplicates(["doc_id"]), bare.where("doc_id is null")):
        plain = plain.unionByName(part.drop(key))
    return plain


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i + 1 : i + 5], ' ') END AS g
  FROM d, LATERAL (SELECT unnest(range(0, greatest(len(w) - 4, 1))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS doc_id, a AS root FROM e2 UNION SELECT e2.b, r.root FROM r JOIN e2 ON e2.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce((SELECT min(root) FROM r WHERE r.doc_id = d.doc_id), d.doc_id)::BIGINT AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
"""
