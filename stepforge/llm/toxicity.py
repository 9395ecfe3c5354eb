"""Toxicity by classifier chains.

Categories are predicted one after another by logistic models over the words of a text and their beginnings (so that
inflected and compound forms share a feature).  Each later model also gets the log odds of the earlier categories: in
training those come from out-of-fold predictions, so that no model learns from answers its predecessor has seen.

The chain is fitted on at most ``max_rows`` labelled texts, chosen by the hash of their id.  Features are counted by
class and chosen on the executors; the driver gets the chosen ones (at most ``FEATURES`` a category) and the numbers of
those that each text holds.  Feature choice, folds and iterations are deterministic.  Scoring covers every text, whole.

Defined cases: null and empty texts get the probabilities of a text without known words; unlabelled texts are only
scored; labels repeated for an id count once (their greatest value), and so does one of its texts (the one with the
greatest hash); without labels of both kinds a category's probability is its smoothed share; without documents nothing
is returned; rows with a null or repeated doc_id are each judged by their own text; extra columns are ignored by ``score``
and kept, whatever their names, by ``reject_toxic``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.llm import rolling
from stepforge.llm.common import stored, table

MAX_ROWS = 8_000
FEATURES = 1_500
FOLDS = 3
PREFIXES = (4, 5, 6)
#: Chain of the query: derived from the labels' columns.
CATEGORIES = ("low_quality", "toxic", "flagged")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the lower-cased words and their beginnings of 4 to 6 bytes, repeated ones included."""
    data, starts, ends, woff = rolling.words(data, offsets, lower=True, separator=rolling.SEPARATOR)
    p = rolling.prefix(rolling.byte_units(data))
    text = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
    texts, hashes = [text], [rolling.span(p, starts, ends)]
    for k in PREFIXES:
        long = ends - starts > k
        texts.append(text[long])
        hashes.append(rolling.span(p, starts[long], starts[long] + k) ^ np.uint64(0x9E3779B97F4A7C15 * k & 2**64 - 1))
    return np.concatenate(texts), np.concatenate(hashes)


def distinct_pairs(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, text))
    t, v = text[order], value[order]
    keep = np.ones(len(t), bool)
    keep[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
    return t[keep], v[keep]


@dataclass
class Sparse:
    """Rows of 0/1 features: row and column of each one."""

    row: np.ndarray
    col: np.ndarray
    shape: tuple[int, int]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.shape[0])

    def tdot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.shape[1])

    def take(self, keep: np.ndarray) -> Sparse:
        at = np.cumsum(keep) - 1
        mine = keep[self.row]
        return Sparse(at[self.row[mine]], self.col[mine], (int(keep.sum()), self.shape[1]))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: Sparse, dense: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 80) -> np.ndarray:
    """Weights of (features, dense columns, bias), by Adam on the full batch."""
    d, e = x.shape[1], dense.shape[1]
    w = np.zeros(d + e + 1)
    share = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = math.log(share / (1 - share))
    if not len(y) or y.min() == y.max():
        return w
    m, v = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, rounds + 1):
        g = sigmoid(x.dot(w[:d]) + dense @ w[d:-1] + w[-1]) - y
        grad = np.concatenate([x.tdot(g) + ridge * w[:d], dense.T @ g + ridge * w[d:-1], [g.sum()]]) / len(y)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        w -= 0.15 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return w


@dataclass
class Chain:
    categories: Sequence[str]
    vocabulary: np.ndarray  # sorted hashes
    weights: list[np.ndarray] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)
    out_of_fold: np.ndarray | None = None

    def predict(self, x: Sparse) -> np.ndarray:
        out = np.zeros((x.shape[0], len(self.weights)))
        d = x.shape[1]
        for k, w in enumerate(self.weights):
            out[:, k] = sigmoid(x.dot(w[:d]) + logit(out[:, :k]) @ w[d:-1] + w[-1])
        return out

    def encode(self, text: np.ndarray, hashes: np.ndarray, n: int) -> Sparse:
        if not len(self.vocabulary):
            return Sparse(np.empty(0, np.int64), np.empty(0, np.int64), (n, 0))
        known = np.zeros(1 << 20, bool)
        known[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        near = known[(hashes >> np.uint64(44)).astype(np.int64)]
        text, hashes = text[near], hashes[near]
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        hit = self.vocabulary[at] == hashes
        row, col = distinct_pairs(text[hit], at[hit])
        return Sparse(row, col, (n, len(self.vocabulary)))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability nearest to one half above which F1 is within half a hundredth of its best.

    Texts without known words get about the share of positives, so a threshold as low as that would reject short clean ones.
    """
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    ps, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(ps[1:] < ps[:-1], True)
    f1 = np.where(last, f1, -1)
    good = np.flatnonzero(f1 >= f1.max() * 0.995)
    below = np.append(ps[1:], 0.0)[good]
    cut = np.clip(0.5, below, (ps[good] + below) / 2)
    return float(cut[np.argmin(np.abs(cut - 0.5))])


def fit_chain(x: Sparse, vocabulary: np.ndarray, y: np.ndarray, categories: Sequence[str] = CATEGORIES, folds: int = FOLDS) -> Chain:
    """x: the chosen features (columns in the order of vocabulary) of each training text; y: texts x categories of 0/1."""
    n, d = x.shape
    chain = Chain(categories, vocabulary)
    fold = np.arange(n) % folds
    held = np.zeros((n, len(categories)))
    for k in range(len(categories)):
        earlier = logit(held[:, :k])
        for f in range(folds):
            train, test = fold != f, fold == f
            w = fit_logistic(x.take(train), earlier[train], y[train, k])
            held[test, k] = sigmoid(x.take(test).dot(w[:d]) + earlier[test] @ w[d:-1] + w[-1])
        chain.weights.append(fit_logistic(x, earlier, y[:, k]))
        chain.thresholds.append(best_threshold(held[:, k], y[:, k]))
    chain.out_of_fold = held
    return chain


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, labels) to (doc_id, labels, distinct feature hashes)."""
    for batch in batches:
        for first, end, data, offsets in rolling.chunks(batch.column(1)):
            text, hashes = distinct_pairs(*features(data, offsets))
            cut = np.searchsorted(text, np.arange(end - first + 1))
            part = batch.slice(first, end - first)
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], names=["doc_id", "y", "hashes"])


def _columns(vocabulary: bytes) -> Callable:
    """(doc_id, y, hashes) to (doc_id, y, columns of the known hashes, as int32 bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(vocabulary, np.uint64)
        for batch in batches:
            rows = []
            for x in batch.column(2):
                h = x.values.to_numpy(zero_copy_only=False).view(np.uint64)
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                rows.append(np.sort(at[known[at] == h]).astype(np.int32).tobytes() if len(known) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "y", "cols"])

    return run


def choose(rows: DataFrame, k: int, n_features: int = FEATURES) -> np.ndarray:
    """Sorted hashes of the features that tell the classes apart best, at most ``n_features`` for each of k categories."""
    shares = rows.agg(*(F.coalesce(F.avg(F.col("y")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(k))).first()
    by = rows.select("y", F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("df"), *(F.sum(F.col("y")[i]).alias(f"n{i}") for i in range(k))).where("df >= 3")
    z = [F.abs((F.col(f"n{i}") - shares[i] * F.col("df")) / F.sqrt(F.greatest(F.col("df") * (shares[i] * (1 - shares[i])), F.lit(1e-9)) + 1)).alias(f"z{i}") for i in range(k)]
    by = stored(by.select("h", *z).where(" or ".join(f"z{i} > 2.5" for i in range(k))), "features")
    best = [by.where(f"z{i} > 2.5").orderBy(F.desc(f"z{i}"), "h").limit(n_features).select("h") for i in range(k)]  # the feature: the best of each category
    out = [r["h"] for b in best for r in b.collect()]
    return np.unique(np.array(out, np.int64).view(np.uint64))


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CATEGORIES, max_rows: int = MAX_ROWS) -> Chain:
    """labels: doc_id and an int column for each category."""
    k = len(categories)
    marked = labels.dropna(subset=["doc_id", *categories]).select(F.col("doc_id").alias("_id"), *(F.col(c).cast("int").alias(f"c{i}") for i, c in enumerate(categories)))
    marked = marked.groupBy("_id").agg(*(F.max(f"c{i}").alias(f"c{i}") for i in range(k)))
    marked = marked.orderBy(F.xxhash64("_id"), "_id").limit(max_rows).select("_id", F.array(*(f"c{i}" for i in range(k))).alias("_y"))
    texts = docs.select("doc_id", "text").join(F.broadcast(marked), F.col("doc_id") == F.col("_id"))  # at most max_rows ids
    one = texts.groupBy("doc_id").agg(F.max_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("_y").alias("y"))
    rows = stored(one.select("doc_id", "text", "y").mapInArrow(_training_rows, "doc_id long, y array<int>, hashes array<long>"), "training")
    vocabulary = choose(rows, k)
    got = rows.mapInArrow(_columns(vocabulary.tobytes()), "doc_id long, y array<int>, cols binary").orderBy("doc_id").collect()  # at most max_rows rows of chosen features
    cols = [np.frombuffer(r["cols"], np.int32) for r in got]
    y = np.array([r["y"] for r in got], np.float64).reshape(len(got), k)
    x = Sparse(np.repeat(np.arange(len(got), dtype=np.int32), [len(c) for c in cols]), np.concatenate(cols) if cols else np.empty(0, np.int32), (len(got), len(vocabulary)))
    return fit_chain(x, vocabulary, y, categories)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, a probability p_<category> for each category of the chain, and is_<category> of 0 or 1."""
    names = [f"p_{c}" for c in chain.categories] + [f"is_{c}" for c in chain.categories]
    k = len(chain.categories)
    schema = ", ".join(["doc_id long", *(f"{c} {'double' if i < k else 'int'}" for i, c in enumerate(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, end, data, offsets in rolling.chunks(batch.column(1)):
                out.append(chain.predict(chain.encode(*features(data, offsets), end - first)))
            p = np.concatenate(out) if out else np.empty((0, k))
            hard = (p > np.array(chain.thresholds)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, i]) for i in range(k)), *(pa.array(hard[:, i]) for i in range(k))], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query_labels(labels: DataFrame) -> DataFrame:
    """The chain's categories from labels (doc_id, quality, toxic)."""
    bad, toxic = 1 - F.col("quality"), F.col("toxic")
    return labels.select("doc_id", bad.alias("low_quality"), toxic.alias("toxic"), F.greatest(bad, toxic).alias("flagged"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, query_labels(table(spark, sf_dir, "labels"))))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose text the chain finds toxic; rows are filtered where they lie, without a join."""
    chain = train(docs, query_labels(labels))
    k = list(chain.categories).index("toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for first, end, data, offsets in rolling.chunks(batch.column(batch.schema.get_field_index("text"))):
                keep[first:end] = chain.predict(chain.encode(*features(data, offsets), end - first))[:, k] <= chain.thresholds[k]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
