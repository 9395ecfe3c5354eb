"""Vectorised rolling hashes over Arrow text columns.

Everything here runs inside Arrow batches on executors.  A batch is cut into chunks of whole texts (1 MB), and each
chunk is handled by numpy without a Python loop over texts, so memory is bounded by the chunk and the longest text.
Hashes are polynomials modulo 2**64 with mixed units; wherever an operator's result has to be exact, the candidate
places that hashes name are compared afterwards on bytes, or by two independent hashes (128 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_TABLE = np.random.default_rng(20240607).integers(0, 2**63, (2, 256), dtype=np.uint64) * _U(2) + _U(1)
#: ASCII white space: \x09-\x0D and the blank.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that aren't part of a word of letters and digits (bytes of other characters than ASCII are).
SEPARATOR = np.ones(256, bool)
SEPARATOR[128:] = False
for _c in (slice(48, 58), slice(65, 91), slice(97, 123)):
    SEPARATOR[_c] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POW.get(which)
    if have is None or len(have[0]) < n + 1:
        size = max(n + 1, CHUNK + 1)
        out = []
        for base in (_BASES[which], pow(_BASES[which], -1, 2**64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _POW[which] = (out[0], out[1])
    return have


def prefix(units: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums from which ``span`` takes the hash of any run of units."""
    p = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * _powers(len(units), which)[0][: len(units)], out=p[1:])
    return p


def span(p: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    return mix((p[end] - p[start]) * _powers(len(p), which)[1][start])


def grams(p: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of the k units that start at each place (len(units) - k + 1 of them)."""
    n = len(p) - k
    if n <= 0:
        return np.empty(0, np.uint64)
    return mix((p[k:] - p[:n]) * _powers(len(p), which)[1][:n])


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of at most ``limit`` bytes, or of one longer row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than separators (ASCII white space): (bytes, starts, ends, word offsets by text)."""
    if lower:
        data = _LOWER[data]
    inside = ~separator[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = True, True
    edge[1:-1] = ~inside[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(inside & edge[:-1])
    after = np.empty(len(data) + 1, bool)
    after[-1], after[:-1] = True, ~inside
    after[offsets] = True
    ends = np.flatnonzero(inside & after[1:]) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return span(prefix(_TABLE[which][data], which), starts, ends, which)


def byte_units(data: np.ndarray, which: int = 0) -> np.ndarray:
    return _TABLE[which][data]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` consecutive values."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    if done < width:
        x = np.minimum(x[: len(x) - (width - done)], x[width - done :])
    return x


def anchors(p: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Windows of ``length`` units, grouped by the least of their k-gram hashes.

    Equal windows hold the same k-grams and so have the same least hash; consecutive windows of a text that share it
    make one range.  Returns (text number, hash, first window, last window, whether equal windows may lie inside the
    range), windows counted from the start of their text.
    """
    n = len(p) - 1
    empty = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
    if n < length:
        return empty
    g = grams(p, k)
    bits = _U(max(24, int(n).bit_length()))
    least = sliding_min((g >> bits << bits) | np.arange(len(g), dtype=np.uint64), length - k + 1)
    lens = np.diff(offsets)
    owner_end = np.repeat(offsets[1:], lens)[: n - length + 1]
    at = np.flatnonzero(np.arange(n - length + 1) + length <= owner_end)
    if not len(at):
        return empty
    value = least[at] >> bits
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = (value[1:] != value[:-1]) | (np.diff(at) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    place = ((_U(1) << bits) - _U(1)) & least[at]
    text = np.searchsorted(offsets, at[first], "right") - 1
    return text, g[place[first].astype(np.int64)], at[first] - offsets[text], at[last] - offsets[text], place[first] != place[last]


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open intervals, touching ones joined, in order."""
    out: list[list[int]] = []
    order = np.argsort(starts, kind="stable")
    for a, b in zip(np.asarray(starts)[order].tolist(), np.asarray(ends)[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open runs of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
