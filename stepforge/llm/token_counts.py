"""Offset-mapped token counts: a document is encoded once, as a whole, and its tokens are attributed to sections.

The spans of the tokens (bytes, from the vocabulary's entries; in characters by counting the bytes that begin one) are
joined as intervals with the spans of the sections.  A token that crosses a boundary goes by an explicit rule:
``first`` (the section of its first byte), ``majority`` (the section with most of its bytes; ties to the earlier) or
``split`` (to each section the share of its bytes).  Whatever the rule, a document's counts sum to its tokens.

The vocabulary file is a parameter, read on the driver and broadcast (under 2 MB); executors need no file.  Defined
cases: null and empty texts have one empty section and no tokens; rows repeated with one doc_id are each returned; very
long texts reach the encoder in parts cut where no token can cross; without documents nothing is returned; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stepforge.llm import rolling
from stepforge.llm.common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
SCHEMA = "doc_id long, section int, start_char long, end_char long, n_tokens double, n_crossing int"
RULES = ("first", "majority", "split")
_ENCODERS: dict[int, tuple] = {}


def encoder(raw: bytes, pattern: str = PATTERN) -> tuple:
    """(tiktoken encoding, length of each token in bytes) of a vocabulary file's content."""
    key = hash((raw, pattern))
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}
        lens = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            lens[rank] = len(piece)
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lens
    return _ENCODERS[key]


#: Bytes that are encoded at once; a longer text is cut where its pieces can't depend on the other side.
PART = 1 << 18
#: Between a letter and a blank before another letter the pattern always begins a new piece.
_SAFE = re.compile(rb"(?<=[a-z])(?= [a-z])")


def parts(raw: bytes) -> Iterator[bytes]:
    """Consecutive parts of a text whose tokens are those of the whole text; a part ends at the first safe place after PART bytes."""
    at = 0
    while len(raw) - at > PART and (cut := _SAFE.search(raw, at + PART)):
        yield raw[at : cut.start()]
        at = cut.start()
    yield raw[at:]


def count_tokens(raw: bytes, vocabulary: tuple) -> int:
    return sum(len(vocabulary[0].encode_ordinary(x.decode())) for x in parts(raw))


def token_ends(raw: bytes, vocabulary: tuple) -> np.ndarray:
    """Ends, in bytes, of the tokens of a text."""
    encoding, lens = vocabulary
    return np.cumsum(np.concatenate([lens[np.asarray(encoding.encode_ordinary(x.decode()), np.int64)] for x in parts(raw)]))


def attribute(ends: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, boundary-crossing tokens that touch it) of each section; cuts: the sections' first bytes, ascending from 0."""
    k = len(cuts)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    a = np.searchsorted(cuts, starts, "right") - 1
    b = np.searchsorted(cuts, ends - 1, "right") - 1
    crosses = np.flatnonzero(a != b)
    counts = np.bincount(a, minlength=k).astype(np.float64)
    touched = np.zeros(k, np.int64)
    for i in crosses.tolist():
        touched[a[i] : b[i] + 1] += 1
        if rule != "first":
            edges = np.concatenate(([starts[i]], cuts[a[i] + 1 : b[i] + 1], [ends[i]]))
            share = np.diff(edges)
            counts[a[i]] -= 1
            if rule == "majority":
                counts[a[i] + int(np.argmax(share))] += 1
            else:
                counts[a[i] : b[i] + 1] += share / share.sum()
    return counts, touched


def line_starts(data: np.ndarray) -> np.ndarray:
    """First bytes of the lines of a text; a line holds its newline."""
    cuts = np.concatenate(([0], np.flatnonzero(data == 10) + 1))
    return cuts[:-1] if len(cuts) > 1 and cuts[-1] == len(data) else cuts


def count(docs: DataFrame, rule: str = "majority", vocabulary: str = VOCABULARY, pattern: str = PATTERN, sections: Callable[[np.ndarray], np.ndarray] = line_starts) -> DataFrame:
    """A row for each section of docs (doc_id, text); sections: UTF-8 bytes to the first bytes of the sections."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(raw.value, pattern)
        for batch in batches:
            for first, end, data, offsets in rolling.chunks(batch.column(1)):
                ids, number, lo, hi, tokens, crossing = [], [], [], [], [], []
                for i in range(end - first):
                    own = data[offsets[i] : offsets[i + 1]]
                    cuts = sections(own)
                    counts, touched = attribute(token_ends(own.tobytes(), known), cuts, rule)
                    chars = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))
                    edges = chars[np.append(cuts, len(own))]
                    ids.append(np.full(len(cuts), first + i))
                    number.append(np.arange(len(cuts), dtype=np.int32))
                    lo.append(edges[:-1])
                    hi.append(edges[1:])
                    tokens.append(counts)
                    crossing.append(touched)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(number)), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (lo, hi)), pa.array(np.concatenate(tokens)), pa.array(np.concatenate(crossing).astype(np.int32))],
                    names=["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents"))
