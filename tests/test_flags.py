"""Flags of cited steps on odd lines, and how often they are shuffled."""

import random

import duckdb
import pytest

from stepforge.plans import flags, stage, steps


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    at, r = tmp_path_factory.mktemp("lines"), random.Random(4)
    rows = [(k, n, r.randrange(60), r.randrange(40), float(r.randrange(1, 51)), r.choice("RAN")) for k in [*range(200), -5, 1 << 40] for n in r.choices(range(1, 9), k=r.randrange(1, 9))]
    rows += [(900, 1_000_000_000, 6, 3, 7.0, "R"), (900, 1, 6, 3, 7.0, "R"), (901, -3, 2, 3, 7.0, "R"), (901, 7, 6, 2, 14.0, "N"), (902, 1, 6, 0, 7.0, "N")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").repartition(3).write.parquet(f"{at}/lineitem.parquet")
    return str(at)


@pytest.mark.parametrize(("rows", "sent"), [(1, stage.SENT), (200_000, -1)])
@pytest.mark.parametrize("name", ["filtered_steps", "rebuilt_traces"])
def test_flags_equal_sql(spark, lines, monkeypatch, name, rows, sent):
    """Lines that stand twice, far, negative and lone numbers; orders are dealt out once, not for every join as before."""
    monkeypatch.setattr(flags, "ROWS", rows)
    monkeypatch.setattr(stage, "SENT", sent)
    monkeypatch.setattr(steps, "SENT", sent)
    df = steps.QUERIES[name](spark, lines)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{lines}/lineitem.parquet/*.parquet'")
    want = con.sql(steps.ORACLES[name])
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall()) and df.count() > 20
    if sent > 0:
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
