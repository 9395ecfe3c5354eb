import json

import pytest
from pyspark.sql import functions as F

from stepforge.plans import datasets
from stepforge.sources import tables


def test_envelopes(spark, tmp_path):
    a, b = {"id": 1, "t": "x"}, {"id": 2}
    for name, body in {"list": [a, b], "env": {"results": [a, b]}, "values": {"one": a, "two": b}, "single": a}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
        got = sorted(tuple(r[c] for c in ("id", "t")) for r in tables.json_records(spark, str(tmp_path / f"{name}.json")).collect())
        assert got == ([(1, "x")] if name == "single" else [(1, "x"), (2, None)])


def test_paired_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "d", "raw"), (2, "d", "craft"), (3, "e", "raw")], "id int, dataset string, setting string")
    tables.write_json_by(df, str(tmp_path / "out"), "dataset", "setting")
    assert sorted(p.parent.name + "/" + p.name for p in (tmp_path / "out").glob("*/*")) == ["dataset=d/setting=craft", "dataset=d/setting=raw", "dataset=e/setting=raw"]
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "out")).select("id", "dataset", "setting").collect())) == [(1, "d", "raw"), (2, "d", "craft"), (3, "e", "raw")]


def test_score_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.5, None), (1, 0.25, 3.0), (30, None, 1.0)], "id int, m1 double, m2 double")
    tables.write_score_table(df, str(tmp_path / "t"), ["m1", "m2"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert lines[0] == "ID             m1             m2             " and lines[1].startswith("1              0.25")
    got = {(r.id, r.metric): r.value for r in tables.score_table(spark, str(tmp_path / "t")).collect()}
    assert got == {("1", "m1"): 0.25, ("1", "m2"): 3.0, ("2", "m1"): 0.5, ("2", "m2"): None, ("30", "m1"): None, ("30", "m2"): 1.0}


def test_adapters_by_shape_and_missing_columns(spark):
    rows = spark.createDataFrame([("odd", "q", "7"), (None, None, None), ("FLD", "facts", None)], "dataset string, input string, answer string")
    got = [tuple(r)[3:] for r in datasets.adapt(rows).collect()]
    assert got == [("q", "7", "7", None, "", "math"), ("", "", "", None, "", ""), ("facts", "", "", None, "FLD", "logical")]


@pytest.mark.parametrize(("text", "n", "want"), [(None, 1, ""), ("all of it\n", 1, "all of it"), ("all", 2, None), ("x Step 1: a\nb\n Step 2. c", 1, "a\nb"), ("Step 12: z", 1, None), ("step 2: q", 2, "q")])
def test_response_step(spark, text, n, want):
    assert spark.createDataFrame([(text,)], "t string").select(datasets.response_step(F.col("t"), F.lit(n)).alias("s")).first().s == want


def test_reference_answer(spark):
    rows = [None, "", datasets.MARKER + "work\nA: 42\n", "no marker\nlast", "A:5"]
    got = [r.a for r in spark.createDataFrame([(x,) for x in rows], "t string").select(datasets.reference_answer(F.col("t")).alias("a")).collect()]
    assert got == ["", "", "42", "last", "5"]


def test_sweep():
    left, asked = [8], []

    class Rows:
        def count(self):
            return left[0]

    def ask(_, concurrency):
        asked.append(concurrency)
        left[0] = max(2, left[0] - 3)

    assert datasets.sweep(Rows, ask, 8) == (2, 3) and asked == [8, 4, 2]
    left[0] = 0
    assert datasets.sweep(Rows, ask, 8) == (0, 0)


def test_reported_traces(spark):
    cells = spark.createDataFrame([("m", "s", "d")], "model string, setting string, source_dataset string")
    rows = spark.createDataFrame([("m", "s", "d", "t"), ("m", "s", "d", " "), ("m", "s", "d", None), ("other", "s", "d", "t")], "model string, setting string, source_dataset string, trace string")
    assert datasets.reported_traces(cells, rows).count() == 1
    with pytest.raises(FileNotFoundError, match="m/s/d"):
        datasets.reported_traces(cells, rows.where("model = 'other'"))
