import time

import duckdb
import numpy as np

from stepforge.plans import figures


def test_paired_tests(spark):
    got = figures.paired_tests(spark, "/root/testdata/sf0.01").collect()
    assert got and all(r.ci_lo <= r["diff"] <= r.ci_hi and 0 <= r.p <= 1 for r in got)


def test_bootstrap_and_wilcoxon():
    d = np.random.default_rng(1).normal(0.3, 1, 60)
    means = np.random.default_rng(42).choice(d, (5000, 60), replace=True).mean(axis=1)
    assert np.allclose(figures.bootstrap_interval(d), np.percentile(means, (2.5, 97.5)))
    assert figures.wilcoxon_p(0.0, 0, 0.0) == 1.0 and figures.wilcoxon_p(105.0, 20, 0.0) == 1.0 and figures.wilcoxon_p(0.0, 20, 0.0) < 0.001


def test_conclusion_keys_of_odd_texts(spark, tmp_path):
    """A long clause before the last one (read once from each of its characters before), no id, and lines that end with other breaks."""
    long = "garden " * 60_000
    texts = [(1, f"{long}. It holds here\n{'x' * 400_000}! So it holds here. \nthus it holds here"), (None, "It is red.\nso it is red\nIt is blue.."), (2, "It is red. \nit is red\n  \nIt is red. "), (3, None), (4, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    begin = time.time()
    got = {tuple(r) for r in figures.conclusion_keys(spark, str(tmp_path)).select("doc_id", "pos", "source_pos").collect()}
    assert time.time() - begin < 60
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.sql(figures.ORACLES["conclusion_keys"]).select("doc_id, pos, source_pos").fetchall()) and (None, 1, 0) in got and (1, 2, 0) in got
