import os

import pytest

from stepforge.functions import report
from stepforge.plans import runs


def test_run_resumes(spark, tmp_path):
    at = str(tmp_path / "run")
    stages = [("a", (), lambda s: s.range(3)), ("b", ("a",), lambda s, a: a.where("id > 0")), ("c", ("b",), lambda s, b: b)]
    assert runs.run(spark, at, stages[:1], {"k": 1}) == {"a": "made"}
    assert runs.run(spark, at, stages, {"k": 1}) == {"a": "kept", "b": "made", "c": "made"}
    assert set(runs.run(spark, at, stages, {"k": 1}).values()) == {"kept"}
    os.remove(f"{at}/b/_SUCCESS")
    assert runs.run(spark, at, stages, {"k": 1}) == {"a": "kept", "b": "made", "c": "made"}
    assert os.path.isdir(f"{at}/b.failed-1") and spark.read.parquet(f"{at}/c").count() == 2
    with pytest.raises(runs.SettingsDiffer):
        runs.run(spark, at, stages, {"k": 2})
    with pytest.raises(ValueError, match="needs"):
        runs.ordered(stages[1:])


def test_remaining(spark):
    assert [r.id for r in runs.remaining(spark.range(3), spark.range(2), "id").collect()] == [2]


def test_report():
    rows = [{"model": "m", "condition": "x", "mean_diff": -0.001, "ci_lo": -0.5, "ci_hi": 0.25, "p": 0.0004, "d": 1.0}, {"model": "n", "condition": "x", "mean_diff": 0.1, "p": 0.2, "d": None}]
    lines = report.latex_table(rows).split("\n")
    assert r"m & x & $0.00$ & $-0.50$ & $+0.25$ & $<0.01$ & $+1.00$ & *** \\" in lines
    assert r"n & x & $+0.10$ & $---$ & $---$ & $0.20$ & $---$ & ns \\" in lines and lines.count(r"\midrule") == 2
