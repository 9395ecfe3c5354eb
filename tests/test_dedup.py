import itertools
import random

import pytest
from pyspark.sql import functions as F

from stepforge.operators import grouped
from stepforge.plans import dedup


def rows(spark, *bodies):
    return spark.createDataFrame([(1, i, b) for i, b in enumerate(bodies, 1)], "sample long, step long, body string")


def written(df):
    return [r.body for r in df.orderBy("sample", "number").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [(None, []), ("", []), ("From Step 3, 4 cases remain", [3]), ("Steps 9, 8, 5, and 4 show", [9, 8, 5, 4]), ("Steps 5–9 and Step 7/Step 8.", [5, 9, 7, 8]), ("Step 4 - 3 = 1", [4]), ("Steps 5-9", [5, 9]), ('he wrote "see Step 2 now" in Step 3', [3]), ("the problem's Step 2 rule", []), ("Step 2 of the algorithm", []), ("Footsteps 3", []), ("Step 6, 8, and 7 we infer", [6, 8, 7]), ("Step 99999999999999999999", [])],
)
def test_citations(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(dedup.cited_numbers(F.col("t")).alias("c")).first().c == want


def test_pieces_keep_the_text(spark):
    texts = ["Step 1 \"a Step 2\" b", "x" * 200_000 + " step 3", "\"open Step 4\n and", "a “q Step 5” Step 6, 7.", "\n\nStep 8"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.array_join(F.transform(dedup.pieces(F.col("t")), lambda x: F.concat(x["lead"], F.coalesce(x["n"].cast("string"), F.lit("")))), "").alias("again"))
    assert all(r.t == r.again for r in df.collect())


def test_repeats_go_and_citations_follow(spark):
    got = dedup.deduplicate(rows(spark, "By Fact 1, it is red", "By Step 1, thus blue", "By Step 2, it is red.", "From Steps 3 and 2, hence green", "By Step 3 and Step 4, it is big"))
    assert written(got) == ["By Fact 1, it is red", "By Step 1, thus blue", "From Steps 1 and 2, hence green", "By Step 1 and Step 3, it is big"]


def test_no_step_cites_itself(spark):
    got = dedup.deduplicate(rows(spark, "From Step 2, it is a", "By Step 1, it is a", "By Step 3, it is b"))
    assert written(got) == ["From this step, it is a", "By Step 1, it is b"]


def test_guard_and_empty(spark):
    bodies = ["By Fact 1, it is red", "so it is blue", "By Step 2, it is red"]
    assert written(dedup.deduplicate(rows(spark, *bodies))) == bodies
    assert written(dedup.deduplicate(rows(spark, None, "", "says nothing", ""))) == ["", "", "says nothing", ""]
    assert dedup.deduplicate(spark.createDataFrame([], "sample long, step long, body string")).count() == 0


@pytest.mark.parametrize(("edges", "left"), [([("a", "b", 0.5), ("b", "a", 0.6), ("x", "y", 0.1)], 1), ([("a", "b", 0.5), ("b", "c", 0.4)], 2), ([("a", "a", 0.9)], 0), ([], 0)])
def test_weakest_edges(edges, left):
    kept = grouped.drop_weakest(edges)
    order = sorted(edges, key=lambda e: (e[2], e[0], e[1]))
    most = next(k for k in itertools.count() if not grouped.find_cycle((a, b) for a, b, _ in order[k:]))
    assert len(kept) == left and kept == order[most:]


def test_aligned_by_words_and_facts():
    s = lambda *w: frozenset(w)
    steps = [(1, 1, s("fact1", "red", "big")), (1, 2, s("fact2", "blue")), (2, 1, s("fact2", "blue")), (2, 2, s("fact1", "red", "old")), (3, 1, s("fact9", "red", "big"))]
    assert grouped.align_cited(steps) == [1, 2, 2, 1, 3]
    assert grouped.align_cited([]) == []


def test_align_cited_by_its_definition(spark, monkeypatch):
    """Each step against every member of every node, as the rule says; likenesses of equal token sets are reckoned once."""
    r = random.Random(3)
    words = [frozenset(r.sample(["fact1", "fact2", "red", "slow", "mail", "air"], r.randrange(4))) for _ in range(9)]
    seen = []
    monkeypatch.setattr(grouped, "jaccard", lambda a, b, f=grouped.jaccard: seen.append(1) or f(a, b))
    grouped._likeness.cache_clear()
    for _ in range(30):
        steps = [(t, p, r.choice(words)) for t in range(8) for p in range(1, r.randrange(2, 7))]
        nodes, of = [], []
        for i, (trace, _, a) in enumerate(steps):
            best, at = 0.0, len(nodes)
            for k, node in enumerate(nodes):
                if all(steps[j][0] != trace for j in node):
                    likeness = max(grouped._likeness.__wrapped__(a, steps[j][2]) for j in node)
                    best, at = (likeness, k) if likeness >= 0.4 and likeness > best else (best, at)
            if at == len(nodes):
                nodes.append([])
            nodes[at].append(i)
            of.append(at)
        last = {t: max(p for u, p, _ in steps if u == t) for t, _, _ in steps}
        order = sorted(range(len(nodes)), key=lambda k: (sum(steps[j][1] / last[steps[j][0]] for j in nodes[k]) / len(nodes[k]), k))
        seen.clear()
        assert grouped.align_cited(steps) == [order.index(k) + 1 for k in of]
        assert len(seen) <= 2 * len(words) ** 2
