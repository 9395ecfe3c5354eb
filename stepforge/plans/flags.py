"""Flags of cited steps (N-10, N-11, N-13, N-14) by array operations over whole samples, which are dealt out once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Rows that are worked on together, at most by one sample more.
ROWS = 200_000
FACTS = 3
HEAD = ["fact", "n", "step", "a", "b", "frequency"]
PHASES = np.array(["nodes", "edges", "math"], dtype=object)


def whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        at = table.column(key).to_numpy()
        cut = int(np.searchsorted(at, at[-1]))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        rows = len(at) - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


class Graph:
    """The citations of a table of whole samples, sorted by sample and step: each with its row, the row it names, and what it is."""

    def __init__(self, t: pa.Table) -> None:
        self.sample = np.unique(t.column("sample").to_numpy(), return_inverse=True)[1]
        step = t.column("step")
        self.named = step.is_valid().to_numpy(zero_copy_only=False)
        self.step = step.fill_null(0).to_numpy()
        cites = t.column("cites").combine_chunks()
        size = cites.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = cites.flatten()
        self.row = np.repeat(np.arange(len(self.step)), size)
        self.fact = flat.field("fact").to_numpy(zero_copy_only=False).astype(bool)
        self.n = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
        steps, number = np.unique(self.step, return_inverse=True)  # numbers in place of steps, so that pairs fit in 64 bits
        at = np.minimum(np.searchsorted(steps, self.n), max(len(steps) - 1, 0))
        there = np.flatnonzero(self.named)
        keys = self.sample[there] * len(steps) + number[there]
        order = np.argsort(keys, kind="stable")
        keys, there = keys[order], there[order]
        want = self.sample[self.row] * len(steps) + at
        place = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
        hit = (keys[place] == want) & (steps[at] == self.n) & ~self.fact if len(keys) else np.zeros(len(want), dtype=bool)
        self.src = np.where(hit, there[place] if len(there) else -1, -1)
        self.known = np.where(self.fact, (self.n >= 1) & (self.n <= FACTS), hit)
        self.own = ~self.fact & (self.n == self.step[self.row]) & self.named[self.row]
        self.edge = self.known & ~self.own & self.named[self.row]

    def any(self, which: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros(len(self.step), dtype=bool)
        out[(self.row if rows is None else rows)[which]] = True
        return out


def flags(t: pa.Table, weak: set[tuple[bool, int, int]]) -> np.ndarray:
    """The phase that removes each step, 3 where none does; ``weak`` are the edges (fact, n, step) of too little weight."""
    g = Graph(t)
    linked = g.any(g.edge) | g.any(g.edge & (g.src >= 0), g.src)
    bad = g.any(~g.known & ~g.own) | g.any(~g.fact & (g.n > g.step[g.row]) & g.named[g.row])
    edges = np.flatnonzero(g.edge)
    kinds, at = np.unique(np.stack([g.fact[edges], g.n[edges], g.step[g.row[edges]]]), axis=1, return_inverse=True) if len(edges) else (np.zeros((3, 0)), edges)
    light = np.array([(bool(f), int(n), int(s)) in weak for f, n, s in kinds.T], dtype=bool)
    loose = np.zeros(len(g.step), dtype=bool)
    loose[g.row[edges[light[at.ravel()]]]] = True
    holds = t.column("holds")
    fails = holds.fill_null(True).to_numpy() == False  # noqa: E712
    phase = np.select([~linked | bad, loose, fails], [0, 1, 2], 3)
    last = np.full(int(g.sample.max()) + 1, np.iinfo(np.int64).min)
    np.maximum.at(last, g.sample[g.named], g.step[g.named])
    stays = holds.fill_null(False).to_numpy() | ~g.named | (g.step >= last[g.sample])
    return np.where(stays, 3, phase)


def flagger(weak: set[tuple[bool, int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(sample, step, removed_by) of the steps that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole(batches, "sample"):
            phase = flags(t, weak)
            gone = np.flatnonzero(phase < 3)
            yield pa.RecordBatch.from_arrays([t.column("sample").combine_chunks().take(pa.array(gone)), t.column("step").combine_chunks().take(pa.array(gone)), pa.array(PHASES[phase[gone]], pa.string())], ["sample", "step", "removed_by"])

    return run


def rebuilder(weak: set[tuple[bool, int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(sample, before, after, text_md5) of the samples that keep a step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole(batches, "sample"):
            left = flags(t, weak) == 3
            at = t.column("sample").to_numpy()
            begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            before, after = np.diff(np.append(begin, len(at))), np.add.reduceat(left.astype(np.int64), begin)
            rows = t.filter(pa.array(left))
            lines = [f"Step {s}: {b}" if s is not None and b is not None else None for s, b in zip(rows.column("step").to_pylist(), rows.column("body").to_pylist(), strict=True)]
            ends = np.cumsum(after)
            texts = ["\n".join(x for x in lines[e - n : e] if x is not None) for e, n in zip(ends.tolist(), after.tolist(), strict=True) if n]
            kept = after > 0
            md5 = [hashlib.md5(x.encode()).hexdigest() for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array(at[begin][kept], pa.int64()), pa.array(before[kept], pa.int64()), pa.array(after[kept], pa.int64()), pa.array(md5, pa.string())], ["sample", "before", "after", "text_md5"])

    return run


def weigher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fact, n, step, a, b, frequency): how often each edge stands between ends of the modes a (null: a fact) and b; without an edge: how many samples there are."""
    for t in whole(batches, "sample"):
        g = Graph(t)
        edges = np.flatnonzero(g.edge)
        mode = t.column("mode").combine_chunks().dictionary_encode()
        of = mode.indices.fill_null(len(mode.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        a = np.where(g.src[edges] >= 0, of[g.src[edges]], -1) if len(edges) else edges
        row = g.row[edges]
        kinds, n = np.unique(np.stack([g.fact[edges], g.n[edges], g.step[row], a, of[row]]), axis=1, return_counts=True) if len(edges) else (np.zeros((5, 0), dtype=np.int64), edges)
        names = pa.concat_arrays([mode.dictionary, pa.nulls(1, pa.string())])
        src = names.take(pa.array(np.where(kinds[3] < 0, len(mode.dictionary), kinds[3])))
        columns = [pa.array(kinds[0].astype(bool)), pa.array(kinds[1], pa.int64()), pa.array(kinds[2], pa.int64()), src, names.take(pa.array(kinds[4])), pa.array(n, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, HEAD)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, c.type) for c in columns[:-1]] + [pa.array([g.sample[-1] + 1], pa.int64())], HEAD)
