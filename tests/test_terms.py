import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from stepforge.functions import equations
from stepforge.plans import stage, terms

SF = "/root/testdata/sf0.001"


def test_step_filter_shuffles_numbers(spark):
    """No plan that ends in the result, or that it keeps, holds tokens by step: the last one reads a row for each score of a sample."""
    steps = terms.worked_steps(spark, SF)
    out = terms.math_step_filter(spark, SF)
    read = [f for f in out._jdf.inputFiles()]
    assert spark.read.parquet(*read).columns == ["sample", "holds", "score", "n", "m"]
    assert spark.read.parquet(*read).count() < steps.count() / 2


def brute(steps):
    """step_filter in plain Python; tokens and verdicts are read by Spark, step by step."""
    rows = steps.select("sample", "trace", "step", equations.math_tokens(F.col("body")).alias("t"), equations.checked(equations.equations(F.col("body"))).alias("holds")).collect()
    out = []
    for sample in {r.sample for r in rows} - {None}:
        own = [r for r in rows if r.sample == sample]
        traces = {r.trace for r in own} - {None}
        every, tf, held = Counter(), defaultdict(float), Counter()
        for r in own:
            every[r.trace] += len(r.t)
            held.update(set(r.t))
        for r in own:
            for w in r.t:
                tf[w] += 1 / every[r.trace]
        core = {w for w in tf if round(tf[w] / len(traces) * math.log(len(own) / held[w]), 9) > terms.ALPHA and round(held[w] / len(own), 9) >= terms.BETA}
        scored = [(r, round(len(core & set(r.t)) / len(core | set(r.t)), 9)) for r in own if r.t]
        if not scored:
            continue
        mu = sum(x for _, x in scored) / len(scored)
        sd = math.sqrt(sum((x - mu) ** 2 for _, x in scored) / len(scored))
        low = [sd > 1e-12 and round((x - mu) / sd, 6) < terms.GAMMA for _, x in scored]
        named = [(r, bad) for (r, _), bad in zip(scored, low, strict=True) if r.trace is not None and r.step is not None]
        out.append((sample, len(named), sum(bad for _, bad in named), sum(bad and not r.holds for r, bad in named)))
    return sorted(out)


def test_step_filter_of_odd_rows(spark, monkeypatch):
    """Without a sample no row, without a trace or number no count, empty and null texts aren't scored; the same where texts are shuffled."""
    rows = [(1, t, 1, "Multiply $2*3 = 6$ to get the area") for t in range(8)] + [(1, 8, 1, "So 2*3 = 7 and cabbages"), (1, 9, 1, "A zebra sleeps"), (1, None, 1, "A zebra sleeps"), (1, 10, None, "A zebra sleeps"), (1, 11, 1, None), (1, 12, 1, ""), (None, 1, 1, "A zebra sleeps"), (2, 1, 1, "Multiply $2*3 = 6$"), (3, 1, 1, "")]
    rows += [(4, t % 7, t, f"Consider the {'red' if t % 3 else 'blue blue'} garden") for t in range(30)] + [(4, 1, 30, "So 5*5 = 25"), (4, 1, 31, "So 5*5 = 24")]
    steps = spark.createDataFrame(rows, "sample long, trace long, step long, body string")
    want = brute(steps)
    assert any(low > gone > 0 for *_, low, gone in want) and len(want) == 3
    assert sorted(tuple(r) for r in terms.step_filter(steps).collect()) == want
    monkeypatch.setattr(stage, "SENT", -1)
    assert sorted(tuple(r) for r in terms.step_filter(steps).collect()) == want
    assert terms.step_filter(steps.where(F.lit(False))).count() == 0


def test_least_flag(spark, tmp_path):
    """Of a repeated line the least flag counts, null ones aside."""
    flags = {1: ["R", "A"], 2: ["A", "0"], 3: [None, "A"], 4: [None], 5: ["N", "R"], 6: [""]}
    rows = [(k, 4, 9, 2.0, f) for k, v in flags.items() for f in v]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    told = {r.trace: "9" in r.body for r in terms.worked_steps(spark, str(tmp_path)).where("trace % 4 < 2").collect()}
    assert told == {k: min((f for f in v if f is not None), default=None) == "A" for k, v in flags.items() if k % 4 < 2}
