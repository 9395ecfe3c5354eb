"""Substring dedup by a log-structured fingerprint index.

The log holds immutable runs, each a table bucketed and sorted by fingerprint: the least hash of the 8-word grams of a
window, one entry for each range of consecutive windows that share it, and a run of text hashes beside it.  A new
batch is written as a run of its own, merge-joined with the older runs on the fingerprint (both sides lie bucketed, so
nothing is shuffled), its matches are verified on the words themselves, and runs of like size are compacted into one.

Batches come in the order of doc_id; a window is removed if its word sequence also starts in a document with a smaller
doc_id, in the history or in the batch.  Windows are compared by two independent 64-bit hashes of their words.

Defined cases: a null text has no words; a null doc_id counts as larger than any other; rows repeated with one doc_id
never remove each other; texts under ``length`` words stay whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.llm import rolling, windows
from stepforge.llm.common import discard, fresh, remove_path, stored, table, table_path, text_keys

LENGTH = 50
GRAM = 8
MOST = 8192
BLOCK = 1 << 20
LAST = 2**63 - 1
FOUND = "doc_id long, s int, e int, h1 long, h2 long"
CUT = "tk long, n_removed long, kept string, kept_sha256 string"


def _verify(rows: list[tuple], length: int, out: list[tuple]) -> None:
    """rows: (g, salt, doc_id, a, ctx, salts) of whole groups.  A window's first holder is the least doc_id."""
    ctx = pa.array([r[4] for r in rows], pa.binary())
    docs, at, hashes, row_of = [], [], ([], []), []
    for first, _, data, offsets in rolling.chunks(ctx, BLOCK * 2):
        data, starts, ends, woff = rolling.words(data, offsets)
        n = np.diff(woff) - length + 1
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin = woff[row] + place
        for w in (0, 1):
            p = rolling.prefix(rolling.word_hashes(data, starts, ends, w), w)
            hashes[w].append(rolling.span(p, begin, begin + length, w))
        row_of.append(row + first)
        at.append(place)
    row, place = np.concatenate(row_of), np.concatenate(at)
    h1, h2 = (np.concatenate(h) for h in hashes)
    docs = np.array([r[2] for r in rows], np.int64)[row]
    order = np.lexsort((docs, h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
    head = np.flatnonzero(new)
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(docs[order[head]], np.diff(np.append(head, len(order))))
    hit = docs > least
    starts = np.concatenate(([0], np.flatnonzero(row[1:] != row[:-1]) + 1)) if len(row) else np.empty(0, int)
    for i, j in zip(starts.tolist(), np.append(starts[1:], len(row)).tolist(), strict=True):
        r = rows[int(row[i])]
        lo, hi = rolling.runs(hit[i:j])
        out.extend((r[2], r[3] + x, r[3] + y - 1 + length, None, None) for x, y in zip(lo.tolist(), hi.tolist(), strict=True))
        if r[5] > 1:
            # the group was dealt to several tasks: first holders meet again, window by window
            for k in np.flatnonzero(~hit[i:j]).tolist():
                out.append((r[2], r[3] + k, r[3] + k + length, int(h1[i + k].view(np.int64)), int(h2[i + k].view(np.int64))))


def _verifier(length: int, limit: int) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in windows.groups(batches, limit):
            out: list[tuple] = []
            _verify(block, length, out)
            for i in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 50_000], strict=True), schema, strict=True)], schema=schema)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for tk, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            all_words = text.encode().split()
            kept, at = [], 0
            for a, b in rolling.merged(np.array([x["s"] for x in spans]), np.array([x["e"] for x in spans])):
                kept += all_words[at:a]
                at = b
            kept += all_words[at:]
            rest = b" ".join(kept)
            out.append((tk, len(all_words) - len(kept), rest.decode(), hashlib.sha256(rest).hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["tk", "n_removed", "kept", "kept_sha256"])


def _cut_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans of words) to the texts without these words and the white space behind them."""
    for batch in batches:
        out = []
        for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode()
            begin = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)] + [len(raw)]
            kept, at = [], 0
            for a, b in rolling.merged(np.array([x["s"] for x in spans]), np.array([x["e"] for x in spans])):
                kept.append(raw[at : begin[a]])
                at = begin[b]
            out.append((doc, b"".join([*kept, raw[at:]]).decode()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.string()), strict=True)], names=["doc_id", "kept"])


class FingerprintLog:
    """Runs are (level, table name, path) of fingerprints; ``texts`` likewise of text hashes."""

    def __init__(self, spark: SparkSession, length: int = LENGTH, gram: int = GRAM, fanout: int = 2, most: int = MOST) -> None:
        self.spark, self.length, self.gram, self.fanout, self.most = spark, length, gram, fanout, most
        self.runs: list[tuple[int, str, str]] = []
        self.texts: list[tuple[int, str, str]] = []
        self.unfinished: list[tuple[int, str, str]] = []

    def _write(self, df: DataFrame, key: str, level: int) -> tuple[int, str, str]:
        name, path = f"run_{uuid.uuid4().hex}", table_path(self.spark, "run")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.unfinished.append((level, name, path))  # until a run is listed; a failed append leaves nothing behind
        df.repartition(key).sortWithinPartitions(key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
        return level, name, path

    def _compact(self, runs: list[tuple[int, str, str]], key: str) -> list[tuple[int, str, str]]:
        """Merges the newest runs while ``fanout`` of them have one level; entries of repeated texts fold into one."""
        while len(runs) >= self.fanout and len({r[0] for r in runs[-self.fanout :]}) == 1:
            old, runs = runs[-self.fanout :], runs[: -self.fanout]
            both = self.spark.table(old[0][1])
            for r in old[1:]:
                both = both.unionByName(self.spark.table(r[1]))
            both = both.distinct() if key == "g" else both.groupBy("tk").agg(F.min("doc_id").alias("doc_id"))
            runs = [*runs, self._write(both, key, old[0][0] + 1)]
            for _, name, path in old:
                self.spark.sql(f"DROP TABLE {name}")
                remove_path(self.spark, path)
        return runs

    def find(self, batch: DataFrame, history: DataFrame | None = None) -> tuple:
        """Adds batch (doc_id, text) to the runs; returns the first holders of texts, candidates (doc_id, text, tk), their spans
        (doc_id and an array of s, e in words), the new runs and the tables that the spans are read from."""
        L = self.length
        tk = text_keys(F.col("text"))[0]

        def rows_of(df: DataFrame) -> DataFrame:
            return df.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tk", tk)

        rows = rows_of(batch)
        new_texts = self._write(rows.groupBy("tk").agg(F.min("doc_id").alias("doc_id")), "tk", 0)
        first = self.spark.table(new_texts[1])
        for _, name, _ in self.texts:
            first = first.unionByName(self.spark.table(name))
        first = first.groupBy("tk").agg(F.min("doc_id").alias("first"))
        run = self._write(rows.where(F.octet_length("text") >= 2 * L - 1).select("tk", "text").mapInArrow(windows.range_rows(L, self.gram, "word"), windows.RANGES).drop("inner"), "g", 0)
        own = self.spark.table(run[1])
        place = F.struct("tk", "a")
        inside = own.groupBy("g").agg(F.min(place).alias("p"), F.max(place).alias("q"), F.count("*").alias("n")).select("g", "n", (F.col("p") != F.col("q")).alias("shared"))
        older = None
        for _, name, _ in self.runs:
            part = self.spark.table(name)
            part = part.join(inside.select("g"), "g", "left_semi")
            older = part if older is None else older.unionByName(part)
        marks = inside
        if older is not None:
            older = stored(older, "older")
            marks = inside.join(older.groupBy("g").agg(F.count("*").alias("m")), "g", "left")
            marks = marks.select("g", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), (F.col("shared") | F.col("m").isNotNull()).alias("shared"))
        marks = windows.salted(marks.where("shared"), self.most).select("g", "salts")
        entries = own if older is None else own.unionByName(older)
        flagged = entries.join(marks, "g").distinct()
        lists = flagged.withColumn("salt", F.pmod(F.xxhash64("tk", "a"), F.col("salts")).cast("int")).groupBy("tk").agg(F.collect_list(F.struct("g", "salt", "a", "b")).alias("ranges"))
        lists = lists.join(first, "tk")
        every = rows if history is None or older is None else rows.unionByName(rows_of(history))
        candidates = stored(every.alias("r").join(lists.alias("l"), (F.col("r.tk") == F.col("l.tk")) & (F.col("r.doc_id") == F.col("l.first"))).select("r.doc_id", "r.text", "r.tk", "l.ranges"), "candidates")
        contexts = candidates.select("doc_id", "text", "ranges").mapInArrow(windows.context_rows(L, "word"), windows.CONTEXTS)
        parted = marks.where("salts > 1")
        contexts = contexts.join(F.broadcast(parted) if parted.limit(10_001).count() <= 10_000 else parted, "g", "left").select("g", "salt", "doc_id", "a", "ctx", F.coalesce("salts", F.lit(1)).alias("salts"))
        found = stored(contexts.repartition("g", "salt").sortWithinPartitions("g", "salt").mapInArrow(_verifier(L, BLOCK), FOUND), "found")
        met = found.where("h1 is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.collect_list(F.struct("doc_id", "s", "e")).alias("at")).where("size(at) > 1")
        met = met.select("least", F.explode("at").alias("x")).where("x.doc_id > least").select("x.*")
        spans = found.where("h1 is null").select("doc_id", "s", "e").union(met).groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
        return first, candidates.select("doc_id", "tk", "text").distinct(), spans, run, new_texts, [older, candidates, found]

    def append(self, batch: DataFrame, history: DataFrame | None = None, last: bool = False) -> DataFrame:
        """Adds batch (doc_id, text) and returns doc_id, n_words, n_removed, kept_sha256 for its rows.

        history: the documents of earlier batches, from which texts of matching entries are read for verification.
        last: no batch follows, so compaction is left out.
        """
        L, tk = self.length, text_keys(F.col("text"))[0]
        first, candidates, spans, run, new_texts, read = self.find(batch, history)
        cut = candidates.join(spans, "doc_id").select("tk", "text", "spans").mapInArrow(_cut, CUT)
        flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
        base = batch.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("key"), tk.alias("tk"), flat.alias("flat"))
        base = base.select("doc_id", "key", "tk", F.when(F.col("flat") == "", 0).otherwise(F.length("flat") - F.length(F.replace("flat", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"), F.sha2(F.col("flat").cast("binary"), 256).alias("sha"))
        whole = F.when((F.col("key") > F.col("first")) & (F.col("n_words") >= L), True)
        result = (
            base.join(first, "tk")
            .join(cut.drop("kept"), "tk", "left")
            .select(
                "doc_id",
                "n_words",
                F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
            )
        )
        result = stored(result, "removed")
        discard(*read)
        self.runs, self.texts = [*self.runs, run], [*self.texts, new_texts]
        if not last:
            self.runs, self.texts = self._compact(self.runs, "g"), self._compact(self.texts, "tk")
        self.unfinished = []
        return result

    def drop(self) -> None:
        for name, path in dict.fromkeys((name, path) for _, name, path in [*self.runs, *self.texts, *self.unfinished]):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove_path(self.spark, path)
        self.runs, self.texts, self.unfinished = [], [], []


def dedup(docs: DataFrame, batches: int = 2, length: int = LENGTH, **how: int) -> DataFrame:
    """Runs ``docs`` (doc_id, text) through the log in ``batches`` parts of ascending doc_id."""
    log = FingerprintLog(docs.sparkSession, length, **how)
    cuts = docs.agg(F.percentile_approx("doc_id", [(i + 1) / batches for i in range(batches - 1)] or [0.5]).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts[: batches - 1]))
    out, low = None, None
    try:
        for i in range(len(cuts) + 1):
            part, before = docs, None
            if low is not None:
                part, before = part.where(F.col("doc_id").isNull() | (F.col("doc_id") > low)), docs.where(F.col("doc_id") <= low)
            if i < len(cuts):
                part, low = part.where(F.col("doc_id") <= cuts[i]), cuts[i]
            done = log.append(part, before, last=i == len(cuts))
            out = done if out is None else out.unionByName(done)
    finally:
        log.drop()
    return out


def strip_passages(docs: DataFrame, length: int = LENGTH, **how: int) -> DataFrame:
    """docs without the words covered by a window that also starts in a document with a smaller doc_id (null ones last), and
    the white space behind them; n_chars (if there) counted anew.  Rows of which nothing but white space is left go; other
    rows stay as they are.  Rows of one doc_id, or of none, with different texts are documents of their own, in any order.
    """
    spark, (k1, k2) = docs.sparkSession, text_keys(F.col("text"))
    row, one, two, kept, first = (fresh(docs, c) for c in ("passage_row", "passage_key1", "passage_key2", "passage_kept", "passage_first"))
    rows = docs.withColumns({row: F.col("doc_id").cast("long"), one: k1, two: k2})
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id IS NULL OR n > 1").limit(1).count():
        order = [F.asc_nulls_last("doc_id"), F.asc("k1"), F.asc("k2")]
        ids = docs.select("doc_id", k1.alias("k1"), k2.alias("k2")).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
        ids = stored(ids.select(F.monotonically_increasing_id().alias("row"), "doc_id", "k1", "k2"), "rows")
        same = (F.col(f"r.{one}") == F.col("i.k1")) & (F.col(f"r.{two}") == F.col("i.k2")) & F.col("r.doc_id").eqNullSafe(F.col("i.doc_id"))
        rows = rows.alias("r").join(ids.alias("i"), same).select(*(f"r.{c}" for c in docs.columns), F.col("i.row").alias(row), f"r.{one}", f"r.{two}")
    log = FingerprintLog(spark, length, **how)
    try:
        named = rows.select(F.col(row).alias("doc_id"), "text")
        _, candidates, spans, _, _, read = log.find(named)
        cuts = stored(candidates.join(spans, "doc_id").select("doc_id", "text", "spans").mapInArrow(_cut_bytes, "doc_id long, kept string"), "cuts")
        discard(*read)
    finally:
        log.drop()
    copies = rows.groupBy(one, two).agg(F.min(row).alias(first), F.count("*").alias("n")).where("n > 1").drop("n")
    flat = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    rows = rows.join(cuts.select(F.col("doc_id").alias(row), F.col("kept").alias(kept)), row, "left").join(copies, [one, two], "left")
    whole = (F.col(row) > F.col(first)) & (F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1 >= length)
    rows = rows.where(~F.coalesce(whole, F.lit(False)) & (F.col(kept).isNull() | F.col(kept).rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*docs.columns)


def op10_fingerprint_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the first two batches' runs are compacted; the third one is joined with the compacted run
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), batches=3)


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(0, len(w) - 49)) AS i)),
first AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
cov AS (SELECT DISTINCT doc_id, i + j AS pos FROM win JOIN first USING (h), LATERAL (SELECT unnest(range(0, 50)) AS j) WHERE doc_id > m),
gone AS (SELECT doc_id, list(pos) AS g FROM cov GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, p: NOT list_contains(g, p - 1)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
"""
