"""Order-dependent operators that run per group in Arrow batches: graphs of one sample, steps of one trace."""

from __future__ import annotations

import difflib
import re
from collections import defaultdict
from collections.abc import Callable, Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.functions import answers, text
from stepforge.sources.tables import table

Edge = tuple[str, str, float]


def kahn_order(nodes: Iterable[str], edges: Iterable[tuple[str, str]]) -> list[str]:
    """Topological order, ready nodes by name; nodes on cycles come last, by name."""
    nodes = sorted(set(nodes))
    waiting, after = dict.fromkeys(nodes, 0), defaultdict(list)
    for a, b in set(edges):
        waiting[b] += 1
        after[a].append(b)
    ready, out = [n for n in nodes if not waiting[n]], []
    while ready:
        n = ready.pop(0)
        out.append(n)
        for b in after[n]:
            waiting[b] -= 1
            if not waiting[b]:
                ready.append(b)
        ready.sort()
    return out + [n for n in nodes if n not in set(out)]


def find_cycle(edges: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """Edges of one cycle, or nothing."""
    after = defaultdict(list)
    for a, b in sorted(set(edges)):
        after[a].append(b)
    state: dict[str, int] = {}
    for root in sorted(after):
        if root in state:
            continue
        path, stack = [], [(root, iter(after[root]))]
        state[root] = 1
        path.append(root)
        while stack:
            node, rest = stack[-1]
            for b in rest:
                if state.get(b) == 1:
                    ring = [*path[path.index(b) :], b]
                    return list(zip(ring, ring[1:], strict=False))
                if b not in state:
                    state[b] = 1
                    path.append(b)
                    stack.append((b, iter(after[b])))
                    break
            else:
                state[node] = 2
                path.pop()
                stack.pop()
    return []


def break_cycles(edges: Iterable[Edge]) -> list[Edge]:
    """Drops the lightest edge of a cycle until none is left (ties: the first by name)."""
    left = {(a, b): w for a, b, w in edges}
    while ring := find_cycle(left):
        left.pop(min(ring, key=lambda e: (left[e], e)))
    return [(a, b, w) for (a, b), w in sorted(left.items())]


def jaccard(a: set, b: set) -> float:
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def align(steps: list[tuple[int, int, frozenset]], least: float = 0.4) -> list[int]:
    """Group of each (trace, position, tokens): greedy, in order; a group takes one step of a trace."""
    members: list[list[frozenset]] = []
    used: list[set[int]] = []
    out = []
    for trace, _, tokens in steps:
        scores = [(max(jaccard(tokens, m) for m in group), -i) for i, group in enumerate(members) if trace not in used[i]]
        best = max(scores, default=(0.0, 0))
        if best[0] >= least:
            i = -best[1]
        else:
            i = len(members)
            members.append([])
            used.append(set())
        members[i].append(tokens)
        used[i].add(trace)
        out.append(i)
    return out


@lru_cache(1 << 16)
def _likeness(a: frozenset, b: frozenset) -> float:
    words = jaccard(a, b)
    x, y = (frozenset(t for t in tokens if t.startswith("fact")) for tokens in (a, b))
    return (words + jaccard(x, y)) / 2 if x or y else words


def align_cited(steps: list[tuple[int, int, frozenset]], least: float = 0.4) -> list[int]:
    """Number of the node of each (trace, place, tokens), given in order of traces and places: a step joins the best node that
    holds no step of its trace, by the likest of its members, the likeness being the mean of words and cited facts where
    either side cites any; nodes are numbered by their members' mean relative place, ties by their first."""
    last: dict[int, int] = {}
    for trace, place, _ in steps:
        last[trace] = max(last.get(trace, 0), place)
    nodes: list[list[int]] = []
    sets: list[set[frozenset]] = []  # of each node, its members' distinct token sets
    newest: list[int] = []  # and the trace of its last member: traces come one after another
    of = []
    for i, (trace, _, tokens) in enumerate(steps):
        score, at = 0.0, -1
        for node, held in enumerate(sets):
            if newest[node] != trace:
                best = max([_likeness(tokens, x) for x in held])
                if at < 0 or best > score:
                    score, at = best, node
        if score < least:
            at = len(nodes)
            nodes.append([])
            sets.append(set())
            newest.append(trace)
        nodes[at].append(i)
        sets[at].add(tokens)
        newest[at] = trace
        of.append(at)
    places = [sum(steps[j][1] / last[steps[j][0]] for j in node) / len(node) for node in nodes]
    rank = {at: n for n, at in enumerate(sorted(range(len(nodes)), key=lambda a: (places[a], a)), 1)}
    return [rank[at] for at in of]


def drop_weakest(edges: list[Edge]) -> list[Edge]:
    """The most confident edges that have no cycle: the fewest of the least confident go, ties by name (found by halving)."""
    order = sorted(edges, key=lambda e: (e[2], e[0], e[1]))
    low, high = 0, len(order)
    while low < high:
        mid = (low + high) // 2
        if find_cycle((a, b) for a, b, _ in order[mid:]):
            low = mid + 1
        else:
            high = mid
    return order[low:]


def trim_restated(steps: list[str], overlap: float = 0.75, ratio: float = 0.95) -> list[bool]:
    """Whether each step stays: it goes if an earlier kept one has nearly the same tokens and wording and it adds no token."""
    kept: list[tuple[str, frozenset]] = []
    out = []
    for s in steps:
        tokens = frozenset(re.findall(r"\w+", s.lower()))
        again = any(jaccard(tokens, t) > overlap and tokens <= t and difflib.SequenceMatcher(None, s, x, autojunk=False).ratio() > ratio for x, t in kept)
        out.append(not again)
        if not again:
            kept.append((s, tokens))
    return out


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"""SELECT user_id, src, dst, CAST(count(*) AS DOUBLE) AS w FROM (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst
        FROM parquet.`{sf_dir}/events.parquet`) WHERE dst IS NOT NULL AND src <> dst GROUP BY user_id, src, dst""")


def kept_edges(edges: DataFrame, group: str, weight: str, choose: Callable[[list[Edge]], list[Edge]]) -> DataFrame:
    """The edges (src, dst, weight) of each group's graph that ``choose`` keeps.  Graphs come as arrays, many in an Arrow batch."""

    @F.pandas_udf("array<int>")
    def run(src: pd.Series, dst: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for graph in zip(src, dst, w, strict=True):
            given = [(a, b, float(x)) for a, b, x in zip(*graph, strict=True)]
            kept = set(choose(given))
            out.append([i for i, e in enumerate(given) if e in kept])
        return pd.Series(out, dtype=object)

    graphs = edges.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("src", "dst", F.col(weight).alias("w")))).alias("e"))
    rows = graphs.select(group, "e", F.explode(run(F.col("e.src"), F.col("e.dst"), F.col("e.w"))).alias("i"))
    return rows.select(group, F.get("e", F.col("i")).alias("x")).select(group, "x.src", "x.dst", F.col("x.w").alias(weight))


def cycle_breaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acyclic transition graph of each user; a graph has at most as many nodes as there are event types."""
    return kept_edges(transitions(spark, sf_dir), "user_id", "w", break_cycles)


def topological_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written position of each node of the acyclic graphs."""

    @F.pandas_udf("array<string>")
    def order(src: pd.Series, dst: pd.Series) -> pd.Series:
        return pd.Series([kahn_order([*a, *b], zip(a, b, strict=True)) for a, b in zip(src, dst, strict=True)], dtype=object)

    graphs = cycle_breaking(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("e"))
    return graphs.select("user_id", F.posexplode(order(F.col("e.src"), F.col("e.dst"))).alias("i", "node")).select("user_id", "node", (F.col("i") + 1).alias("position"))


def greedy_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned groups of the turns of each conversation, its roles being the traces."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["role", "turn"], kind="stable")
        roles = {r: i for i, r in enumerate(sorted(g.role.unique()))}
        steps = [(roles[r], t, frozenset(re.findall(r"[a-z]{3,}", (x or "").lower()))) for r, t, x in zip(g.role, g.turn, g.text, strict=True)]
        return pd.DataFrame({"conv_id": g.conv_id, "role": g.role, "turn": g.turn, "step_group": align(steps)})

    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", "text").where("conv_id IS NOT NULL AND role IS NOT NULL AND turn IS NOT NULL")
    return rows.groupBy("conv_id").applyInPandas(run, "conv_id long, role string, turn long, step_group int")


def fuzzy_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each conversation that restate an earlier one."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["turn", "role"], kind="stable")
        return pd.DataFrame({"conv_id": g.conv_id, "turn": g.turn, "kept": trim_restated([x or "" for x in g.text])})

    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", "text").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    return rows.groupBy("conv_id").applyInPandas(run, "conv_id long, turn long, kept boolean")


def same_answer(pred: Column, gold: Column) -> Column:
    @F.pandas_udf("boolean")
    def same(preds: pd.Series, golds: pd.Series) -> pd.Series:
        return pd.Series([answers.equal(a, b) for a, b in zip(preds, golds, strict=True)])

    return same(pred, gold)


def answer_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By line number, the lines whose quantity a line, as a fraction, equals the same one times their tax in eighths; each distinct pair is compared once."""
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.round(F.col("l_tax") * 100).cast("int").alias("t"))
    pairs = rows.groupBy("l_linenumber", "q", "t").agg(F.count("*").alias("n"))
    pairs = pairs.withColumn("same", same_answer(F.format_string("\\frac{%d}{%d}", "q", "l_linenumber"), F.format_string("$%d/%d$", F.col("q") * F.col("t"), F.col("l_linenumber") * 8)))
    return pairs.groupBy("l_linenumber").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("n_equal"))


def label_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict read from each turn, and its number of tokens."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.verdict(F.col("text")).alias("verdict"), text.token_count(F.col("text")).alias("n_tokens"))


ORACLES = {
    "answer_equivalence": "SELECT l_linenumber, count(*) AS n, CAST(sum(CASE WHEN CAST(l_quantity AS INT) * CAST(round(l_tax * 100) AS INT) = CAST(l_quantity AS INT) * 8 THEN 1 ELSE 0 END) AS BIGINT) AS n_equal FROM lineitem GROUP BY l_linenumber",
    "label_cascade": r"""WITH t AS (SELECT *, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '' AND NOT contains(x, '[Step')) AS ls, coalesce(list_last(regexp_extract_all(text, '__(?:DIS)?PROVED__')),
  list_last(regexp_extract_all(text, '(?i)\*\*\s*((?:dis)?proved|true|false)\s*\*\*', 1)), list_last(regexp_extract_all(text, '(?i)conclusion\s*:\s*((?:dis)?proved|true|false)', 1))) AS u FROM conversations),
 w AS (SELECT *, array_to_string(list_slice(ls, greatest(len(ls) - 4, 1), len(ls)), ' ') AS tail, lower(list_last(regexp_extract_all(text, '(?i)\b(disproved|false|incorrect|refuted|hypothesis is not|proved|proven|true|correct|holds)\b', 1))) AS word FROM t)
 SELECT conv_id, turn, CASE WHEN upper(u) LIKE '%DISPROVED%' OR upper(u) = 'FALSE' THEN '__DISPROVED__' WHEN u IS NOT NULL THEN '__PROVED__' WHEN regexp_matches(tail, '(?i)\b(disproved|false|incorrect|refuted)\b') THEN '__DISPROVED__'
  WHEN regexp_matches(tail, '(?i)\b(proved|proven|true|correct|holds)\b') THEN '__PROVED__' WHEN word IN ('disproved', 'false', 'incorrect', 'refuted', 'hypothesis is not') THEN '__DISPROVED__' WHEN word IS NOT NULL THEN '__PROVED__' END AS verdict,
  len(regexp_extract_all(coalesce(text, ''), '\S+'))::BIGINT AS n_tokens FROM w""",
}
QUERIES = {f.__name__: f for f in (cycle_breaking, topological_plan, greedy_alignment, fuzzy_trim, answer_equivalence, label_cascade)}
