"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Vectors are lengthened by one coordinate so that all have the same norm; the largest inner product is then the least
angle.  Codes are signs after learned rotations (iterative quantisation, fitted on at most ``FIT_ROWS`` rows chosen by
hash; several rotations give more bits than dimensions).  Each code is split into 16-bit substrings, each indexed:
codes within a Hamming radius r of a query agree with it in some substring up to r / (number of substrings) bits, so
probing those buckets finds every code within the radius (pigeonhole).  What is found is reranked by the inner product
of the original vectors in double precision.  The radius is the one that holds ``RECALL`` of the neighbours in the
sample, which lie farther away than those in all rows; a query with too few codes within it widens its radius.  How much
probing saves depends on the vectors: where neighbours differ from a query in nearly as many bits as any row does, their
share of the radius is wide and nearly all buckets are near; only the float rerank is then spared.

The queries are the stated set, dealt in blocks against blocks of rows; every row is indexed.  Defined cases: vectors
that are null, empty, zero, of another length than most, or hold null or non-finite components take no part, nor do
rows with a null id; rows repeated with one id are candidates each (and never for their own id); ties go to the
smaller id; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepforge.llm.common import table

TOP = 20
EVERY = 20
FIT_ROWS = 10_000
CALIBRATE = 256
ROTATIONS = 2
#: Codes have at least about so many bits.
BITS = 256
RECALL = 0.97
ROW_BLOCK = 8_192
QUERY_BLOCK = 16_384
SCHEMA = "query_id long, vec_id long, score double, n_codes long"
_MASKS: dict[int, np.ndarray] = {}


def near_masks(radius: int) -> np.ndarray:
    """The 16-bit values of at most ``radius`` ones: a substring's neighbours are its exclusive or with them."""
    if radius not in _MASKS:
        every = np.arange(1 << 16, dtype=np.uint16)
        _MASKS[radius] = every[np.bitwise_count(every) <= radius]
    return _MASKS[radius]


def valid(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v array<double>, square) of the vectors that take part."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    rows = vectors.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(~bad)
    rows = rows.withColumn("square", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).where((F.col("square") > 0) & (F.col("square") < float("inf")))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def lengthened(x: np.ndarray, square: float, query: bool = False) -> np.ndarray:
    """Rows with a coordinate that brings every norm to the greatest one; a query's is 0."""
    rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, square - (x * x).sum(axis=1)))
    return np.column_stack([x, rest])


def learn_rotations(x: np.ndarray, rotations: int, rounds: int = 15, seed: int = 5) -> np.ndarray:
    """Iterative quantisation from different random starts: columns are the directions whose signs are the bits."""
    rng, out = np.random.default_rng(seed), []
    d = x.shape[1]
    for _ in range(rotations):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds if len(x) >= d else 0):
            u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
            r = (u @ vt).T
        out.append(r)
    bits = np.concatenate(out, axis=1)
    return bits[:, : max(16, bits.shape[1] // 16 * 16)]


def codes(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """16-bit substrings of the codes, one column each (missing bits are 0)."""
    bits = x @ rotation >= 0
    lack = -bits.shape[1] % 16
    if lack:
        bits = np.pad(bits, ((0, 0), (0, lack)))
    return np.packbits(bits, axis=1).view(np.uint16)


class MultiIndex:
    """Buckets of each substring's values, over one block of codes."""

    def __init__(self, c: np.ndarray) -> None:
        self.codes = c
        self.tables = []
        for j in range(c.shape[1]):
            order = np.argsort(c[:, j], kind="stable")
            values, starts, counts = np.unique(c[order, j], return_index=True, return_counts=True)
            self.tables.append((order, values, starts, counts))

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Marks the rows of the buckets near the query's substrings: neighbouring values are enumerated and looked up, or
        the buckets' values compared where those are fewer."""
        mark, masks = np.zeros(len(self.codes), bool), near_masks(min(16, radius // len(self.tables)))
        for j, (order, values, starts, counts) in enumerate(self.tables):
            if len(masks) < len(values):
                wanted = code[j] ^ masks
                at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
                near = at[values[at] == wanted]
            else:
                near = np.flatnonzero(np.bitwise_count(values ^ code[j]) <= radius // len(self.tables))
            n = counts[near]
            mark[order[np.repeat(starts[near] - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
        return mark

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of every code within the radius: by the pigeonhole it agrees with the query's, in some
        substring, up to its share of the radius."""
        rows = np.flatnonzero(self.probe(code, radius))
        distance = np.bitwise_count(self.codes[rows] ^ code).sum(axis=1)
        inside = distance <= radius
        return rows[inside], distance[inside]


def calibrate(x: np.ndarray, square: float, rotation: np.ndarray, top: int, recall: float, queries: int = CALIBRATE) -> int:
    """The Hamming radius that holds that share of the ``top`` neighbours of sample rows (as queries) among the sample."""
    if len(x) < 2:
        return rotation.shape[1]
    q = x[: min(queries, len(x))]
    scores = q @ x.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(top, len(x) - 1)
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    c = codes(lengthened(x, square), rotation)
    distance = np.bitwise_count(c[near] ^ codes(lengthened(q, square, True), rotation)[:, None, :]).sum(axis=2)
    return int(np.quantile(distance, recall, method="higher"))


def _search(rotation: np.ndarray, radius: int, square: float, top: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        is_query = rows["is_query"].to_numpy(bool)
        ids = rows["id"].to_numpy(np.int64)
        if is_query.all() or not is_query.any():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "n_codes": []})
        x = np.array(rows["v"].tolist(), np.float64)
        q, q_ids, x, ids = x[is_query], ids[is_query], x[~is_query], ids[~is_query]
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        index = MultiIndex(codes(lengthened(x, square), rotation))
        query_codes = codes(lengthened(q, square, True), rotation)
        bits = rotation.shape[1]
        out = []
        for i in range(len(q)):
            r = radius
            while True:
                found, _ = index.within(query_codes[i], r)
                found = found[ids[found] != q_ids[i]]
                if len(found) >= min(top, len(ids)) or r >= bits:
                    break
                r = min(bits, r + max(1, bits // 32))
            if not len(found):
                continue
            scores = x[found] @ q[i]
            best = np.lexsort((ids[found], -scores))[:top]
            out.append(pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[found[best]], "score": scores[best], "n_codes": len(found)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "n_codes": []})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP, rotations: int = ROTATIONS, recall: float = RECALL, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for each of queries (id, v) against vectors (id, v, square), both from ``valid``."""
    n, square = vectors.agg(F.count("*"), F.max("square")).first()
    n_queries = queries.count()
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").collect()  # at most FIT_ROWS
    if not sample or not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = np.array([r["v"] for r in sample], np.float64)
    rotation = learn_rotations(lengthened(x, square), max(rotations, round(BITS / (x.shape[1] + 1))))
    radius = calibrate(x, square, rotation, top, recall)
    row_blocks, query_blocks = max(1, math.ceil(n / row_block)), max(1, math.ceil(n_queries / query_block))
    # rows are dealt by id and vector: many rows with one id or one vector still spread
    r = vectors.select("id", "v", F.lit(False).alias("is_query"), F.pmod(F.xxhash64("id", "v"), F.lit(row_blocks)).alias("rb"), F.explode(F.expr(f"sequence(0L, {query_blocks - 1}L)")).alias("qb"))
    q = queries.select("id", "v", F.lit(True).alias("is_query"), F.explode(F.expr(f"sequence(0L, {row_blocks - 1}L)")).alias("rb"), F.pmod(F.xxhash64("id"), F.lit(query_blocks)).alias("qb"))
    found = r.unionByName(q).groupBy("rb", "qb").applyInPandas(_search(rotation, radius, square, top), SCHEMA)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(by).alias("rank"), "vec_id", "score").where(F.col("rank") <= top)


def op1_ann_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid(table(spark, sf_dir, "embeddings"))
    return nearest(rows, rows.where(F.col("id") % EVERY == 0).select("id", "v"))


