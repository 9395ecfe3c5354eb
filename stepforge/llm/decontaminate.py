"""Benchmark decontamination by latent semantic retrieval.

Texts are cut in overlapping passages, which are TF-IDF vectors over the benchmark's words (document frequencies come
from all documents; words of more than ``MAX_DF`` of them are left out).  A distributed randomised SVD of all passages
and of the benchmark items (weighted to the same total, so that the leading directions also tell items apart) gives a
latent space; passages whose cosine with an item is high are candidates.  So are, whatever the number of items and the
rank, passages that hold ``HELD`` of the rare words (by weight) of a piece of an item; pieces are short enough to lie
whole in one passage, so no exact copy is missed.  A candidate is verified by the longest common subsequence of words of
the item and the text around the passage, and by the part of the item's end (its answer) in it.

The benchmark is the stated query set: it is read to the driver and sent to the executors in blocks of at most
``BLOCK`` items.  What one task sends back is a matrix of (words of the block) x ``RANK``, summed in two levels.
Defined cases: null and empty texts and items match nothing; items without rare words are compared by their common
ones; items repeated with one id are compared each; without items or documents nothing matches; in ``matches`` rows
repeated with one doc_id (null ones too) count once and extra columns are ignored; ``clean`` judges each row by its own
text and keeps extra columns, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.llm import rolling
from stepforge.llm.common import table

#: Words from one passage to the next; a passage has twice as many.
STEP = 48
RANK = 128
MAX_DF = 0.05
COSINE = 0.3
HELD = 0.3
#: Share of an item's words in common order that marks a text by itself, and with an answer that is found.
COPY, PARAPHRASE, ANSWER = 0.8, 0.5, 0.5
BLOCK = 4096
SUMS = "part int, deal int, n long, z binary"


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of letters and digits, and their offsets by text."""
    data, starts, ends, woff = rolling.words(data, offsets, lower=True, separator=rolling.SEPARATOR)
    return rolling.word_hashes(data, starts, ends), woff


@dataclass
class Lookup:
    """Positions of hashes in a sorted vocabulary; -1 for others."""

    words: np.ndarray

    def __post_init__(self) -> None:
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.words >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.near[(h >> np.uint64(44)).astype(np.int64)])
        if len(maybe):
            at = np.searchsorted(self.words, h[maybe])
            at[at == len(self.words)] = 0
            out[maybe] = np.where(self.words[at] == h[maybe], at, -1)
        return out


def _frequencies(words: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Lookup(np.frombuffer(words, np.uint64))
        total, n = np.zeros(len(find.words), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for first, end, data, offsets in rolling.chunks(batch.column(0)):
                h, woff = text_words(data, offsets)
                at = find(h)
                hit = np.flatnonzero(at >= 0)
                text = np.searchsorted(woff, hit, "right") - 1
                pair = np.unique(text * len(total) + at[hit])
                total += np.bincount(pair % max(1, len(total)), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *np.flatnonzero(total).tolist()], pa.int64()), pa.array([n, *total[total > 0].tolist()], pa.int64())], names=["word", "df"])

    return run


def passages(woff: np.ndarray, hit: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, entry, passage of entry) of the passages with at least one of the words at ``hit``.

    Passage j of a text holds its words [j * step, (j + 2) * step); each word lies in two, or in one at the start.
    """
    text = np.searchsorted(woff, hit, "right") - 1
    block = (hit - woff[text]) // step
    entry = np.concatenate([np.arange(len(hit)), np.flatnonzero(block > 0)])
    owner, number = text[entry], np.concatenate([block, block[block > 0] - 1])
    order = np.lexsort((entry, number, owner))
    entry, owner, number = entry[order], owner[order], number[order]
    new = np.ones(len(entry), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])
    return owner[new], number[new] * step, entry, np.cumsum(new) - 1


def vectors(at: np.ndarray, idf: np.ndarray, entry: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit-length weights of the entries: TF-IDF with raw counts; and each passage's length."""
    word = at[entry]
    order = np.lexsort((word, owner))
    w, o = word[order], owner[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(w)))
    norm = np.sqrt(np.bincount(o[head], (count * idf[w[head]]) ** 2, n))
    return idf[word] / np.maximum(norm, 1e-12)[owner], norm


def _sum_rows(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows with one owner (0, 1, 2, ... without gaps)."""
    return np.add.reduceat(values, np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))), axis=0)


def _sketch(words: bytes, idf_raw: bytes, omega_raw: bytes, rank: int, deal: int) -> Callable:
    """Sums A'(A Omega) over a task's passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        find, idf = Lookup(np.frombuffer(words, np.uint64)), np.frombuffer(idf_raw)
        omega = np.frombuffer(omega_raw, np.float32).reshape(-1, rank)
        z, n = np.zeros((len(idf), rank), np.float32), 0
        for batch in batches:
            for _, _, data, offsets in rolling.chunks(batch.column(0), 1 << 20):
                h, woff = text_words(data, offsets)
                at = find(h)
                hit = np.flatnonzero(at >= 0)
                hit = hit[idf[at[hit]] > 0]
                if not len(hit):
                    continue
                _, start, entry, owner = passages(woff, hit)
                weight, _ = vectors(at[hit], idf, entry, owner, len(start))
                word = at[hit][entry]
                y = _sum_rows(omega[word] * weight[:, None].astype(np.float32), owner)
                order = np.argsort(word, kind="stable")
                sorted_words = word[order]
                head = np.flatnonzero(np.concatenate(([True], sorted_words[1:] != sorted_words[:-1])))
                z[sorted_words[head]] += np.add.reduceat(y[owner[order]] * weight[order][:, None].astype(np.float32), head, axis=0)
                n += len(start)
        own = TaskContext.get().partitionId() % deal
        for part, i in enumerate(range(0, len(z), 512)):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own], pa.int32()), pa.array([n if not part else 0], pa.int64()), pa.array([z[i : i + 512].tobytes()], pa.binary())], names=["part", "deal", "n", "z"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums matrices of one (part, deal); rows come sorted by them."""
    key, total, n = None, None, 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "deal", "n", "z"])

    for batch in batches:
        for i in range(batch.num_rows):
            now = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            z = np.frombuffer(batch.column(3)[i].as_py(), np.float32)
            if now != key:
                if key is not None:
                    yield out()
                key, total, n = now, z.copy(), batch.column(2)[i].as_py()
            else:
                total += z
                n += batch.column(2)[i].as_py()
    if key is not None:
        yield out()


def common_subsequence(item_masks: dict[int, int], m: int, words: list[int]) -> int:
    """Bits of the item's places in a longest common subsequence with words (Hyyro's bit vector; a zero bit is a place gained)."""
    full = (1 << m) - 1
    v = full
    for w in words:
        x = item_masks.get(w, 0)
        if x:
            u = v & x
            v = ((v + u) | (v - u)) & full
    return ~v & full


@dataclass
class Item:
    item_id: int
    words: list[int]

    def __post_init__(self) -> None:
        self.masks: dict[int, int] = {}
        for i, w in enumerate(self.words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i

    def check(self, around: list[int]) -> tuple[int, float, float]:
        """(length of the subsequence, its share of the item, share found of the item's last quarter)."""
        m = len(self.words)
        got = common_subsequence(self.masks, m, around).bit_count()
        tail = self.words[-max(1, m // 4) :]
        masks: dict[int, int] = {}
        for i, w in enumerate(tail):
            masks[w] = masks.get(w, 0) | 1 << i
        return got, got / m, common_subsequence(masks, len(tail), around).bit_count() / len(tail)


def pieces(items: list[Item], vocabulary: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces of at most ``STEP`` words: the item of each; and by word (from, to in the first) the pieces that hold it and its share of their weight."""
    owner, word, piece, share = [], [], [], []
    for i, x in enumerate(items):
        for part in np.array_split(np.searchsorted(vocabulary, np.array(x.words, np.uint64)), -(-len(x.words) // STEP)):
            part = np.unique(part)
            part = part[idf[part] > 0]
            if len(part):
                word.append(part)
                piece.append(np.full(len(part), len(owner)))
                share.append(idf[part] / idf[part].sum())
                owner.append(i)
    word, piece, share = np.concatenate(word), np.concatenate(piece), np.concatenate(share)
    order = np.argsort(word, kind="stable")
    return np.searchsorted(word[order], np.arange(len(vocabulary) + 1)), piece[order], share[order], np.array(owner)


def held(first: np.ndarray, piece: np.ndarray, share: np.ndarray, n_pieces: int, word: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(passage, piece): the share of the piece's weight whose words the passage holds; (owner, word) are distinct."""
    count = first[word + 1] - first[word]
    at = np.repeat(first[word] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return np.bincount(np.repeat(owner, count) * n_pieces + piece[at], share[at], n * n_pieces).reshape(n, n_pieces)


def leaked(share: float, answer: float) -> bool:
    return share >= COPY or (share >= PARAPHRASE and answer >= ANSWER)


def _finder(words: bytes, idf_raw: bytes, basis_raw: bytes, rank: int, items: list[Item], latent_raw: bytes, parts: tuple[np.ndarray, ...]) -> Callable:
    """A function from a column of texts to (first row, {(row after it, item): (lcs, share, answer, cosine)}) of its chunks."""

    def run(column: pa.Array) -> Iterator[tuple[int, dict]]:
        find, idf = Lookup(np.frombuffer(words, np.uint64)), np.frombuffer(idf_raw)
        basis = np.frombuffer(basis_raw, np.float32).reshape(-1, rank)
        latent = np.frombuffer(latent_raw, np.float32).reshape(-1, rank)
        first_piece, piece, piece_share, piece_item = parts
        rows_at_once = max(1, min(8192, (1 << 21) // len(piece_item)))
        for first, _, data, offsets in rolling.chunks(column, 1 << 20):
            h, woff = text_words(data, offsets)
            at = find(h)
            hit = np.flatnonzero(at >= 0)
            hit = hit[idf[at[hit]] > 0]
            if not len(hit):
                continue
            text, start, entry, owner = passages(woff, hit)
            weight, _ = vectors(at[hit], idf, entry, owner, len(start))
            y = _sum_rows(basis[at[hit][entry]] * weight[:, None].astype(np.float32), owner)
            once = np.unique(owner * len(idf) + at[hit][entry])
            once_owner, once_word = once // len(idf), once % len(idf)
            best: dict[tuple[int, int], tuple] = {}
            for i in range(0, len(y), rows_at_once):
                cosine = y[i : i + rows_at_once] @ latent.T
                candidate = cosine >= COSINE
                a, b = np.searchsorted(once_owner, (i, i + len(cosine)))
                p, k = np.nonzero(held(first_piece, piece, piece_share, len(piece_item), once_word[a:b], once_owner[a:b] - i, len(cosine)) >= HELD)
                candidate[p, piece_item[k]] = True
                for p, q in zip(*np.nonzero(candidate), strict=True):
                    item, t = items[q], int(text[i + p])
                    m = len(item.words)
                    lo = max(int(woff[t]), int(woff[t] + start[i + p]) - m)
                    hi = min(int(woff[t + 1]), int(woff[t] + start[i + p]) + 2 * STEP + m)
                    got, share, answer = item.check(h[lo:hi].tolist())
                    if leaked(share, answer):
                        row = (got, share, answer, float(cosine[p, q]))
                        best[t, int(q)] = max(best.get((t, int(q)), row), row)
            if best:
                yield first, best

    return run


def _hits(found: Callable, items: list[Item]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, best in found(batch.column(1)):
                ids = batch.column(0).slice(first)
                rows = [(ids[t].as_py(), items[q].item_id, *r) for (t, q), r in sorted(best.items())]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "lcs", "share", "answer", "cosine"])

    return run


def _kept(found: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for first, best in found(batch.column(batch.schema.get_field_index("text"))):
                keep[[first + t for t, _ in best]] = False
            yield batch.filter(pa.array(keep))

    return run


HITS = "doc_id long, item_id long, lcs int, share double, answer double, cosine double"


def matches(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """doc_id, item_id, lcs, share, answer, cosine of every text of docs (doc_id, text) that holds an item of benchmark (item_id, text)."""
    out = docs.sparkSession.createDataFrame([], HITS)
    for found, items in finders(docs, benchmark, rank):
        part = docs.select("doc_id", "text").mapInArrow(_hits(found, items), HITS)
        out = out.unionByName(part.groupBy("doc_id", "item_id").agg(*(F.max(F.struct("lcs", "share", "answer", "cosine"))[c].alias(c) for c in ("lcs", "share", "answer", "cosine"))))
    return out


def finders(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> Iterator[tuple[Callable, list[Item]]]:
    """For each block of the benchmark's items: the function that finds them in texts, by the latent space of docs, and the items."""
    rows = benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").collect()  # the stated query set
    for i in range(0, len(rows), BLOCK):
        found = _finder_of(docs, rows[i : i + BLOCK], rank)
        if found is not None:
            yield found


def _finder_of(docs: DataFrame, rows: list, rank: int) -> tuple[Callable, list[Item]] | None:
    raw = [r["text"].encode() for r in rows]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    h, woff = text_words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    items = [Item(r["item_id"], h[woff[i] : woff[i + 1]].tolist()) for i, r in enumerate(rows) if woff[i + 1] > woff[i]]
    if not items:
        return None
    vocabulary = np.unique(h)
    counted = {r["word"]: r["df"] for r in docs.select("text").mapInArrow(_frequencies(vocabulary.tobytes()), "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()}
    n_docs = counted.pop(-1, 0) or 0
    df = np.zeros(len(vocabulary))
    for w, c in counted.items():
        df[w] = c
    idf = np.log((n_docs + 1) / (df + 1)) + 0.1
    rare = df <= max(2, MAX_DF * n_docs)
    keep_common = [not rare[np.searchsorted(vocabulary, np.array(x.words, np.uint64))].any() for x in items]
    for x, common in zip(items, keep_common, strict=True):
        if common:
            rare[np.searchsorted(vocabulary, np.array(x.words, np.uint64))] = True
    idf[~rare] = 0
    rank = min(rank, len(vocabulary))
    # items as unit vectors over the vocabulary
    b = np.zeros((len(items), len(vocabulary)), np.float32)
    for i, x in enumerate(items):
        at, c = np.unique(np.searchsorted(vocabulary, np.array(x.words, np.uint64)), return_counts=True)
        b[i, at] = c * idf[at]
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    omega = np.random.default_rng(7).standard_normal((len(vocabulary), rank)).astype(np.float32)
    deal = max(1, math.isqrt(docs.rdd.getNumPartitions()))
    sums = docs.select("text").mapInArrow(_sketch(vocabulary.tobytes(), idf.tobytes(), omega.tobytes(), rank, deal), SUMS)
    sums = sums.repartition("part", "deal").sortWithinPartitions("part", "deal").mapInArrow(_add, SUMS)
    sums = sums.repartition("part").sortWithinPartitions("part").withColumn("deal", F.lit(0)).mapInArrow(_add, SUMS)
    z, n = np.zeros((len(vocabulary), rank), np.float64), 0
    for r in sums.collect():  # words of the block x rank in all
        got = np.frombuffer(r["z"], np.float32).reshape(-1, rank)
        z[r["part"] * 512 : r["part"] * 512 + len(got)] = got
        n += r["n"]
    z += max(1.0, n / len(items)) * (b.T @ (b @ omega))
    basis = np.linalg.qr(z)[0].astype(np.float32)
    latent = (b @ basis).astype(np.float32)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-6)
    return _finder(vocabulary.tobytes(), idf.tobytes(), basis.tobytes(), rank, items, latent.tobytes(), pieces(items, vocabulary, idf)), items


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; rows are filtered where they lie, without a join."""
    out = docs
    for found, _ in finders(docs, benchmark):
        out = out.mapInArrow(_kept(found), docs.schema)
    return out
