"""Queries over documents' terms: the same rows as their SQL, without keeping or shuffling tokens."""

import pytest

from stepforge.functions import tokens
from stepforge.plans import catalog, texts

ODD = [
    "Red cabbages grow\n\n  \nRed cabbages and the garden grow slowly\nnothing",
    "red RED garden grow\n\tgarden\nİstanbul Kelvin K2 naïve café x_1 a1 ab\n",
    "", "\n\n", None, "the of and", "   ", "日本 garden 日本語garden ét́ red red 𝒳ed red𝒳 ÀB red-cabbages grow", "grow " * 300 + "\nzebra",
]


@pytest.fixture
def odd(spark, tmp_path):
    """A folder of documents, and a way to write others there."""

    def write(ids, sources=("a", "b", None, "á")):
        rows = [(k, t, "en", sources[i % len(sources)], 0 if t is None else len(t)) for i, (k, t) in enumerate(zip(ids, ODD * 9, strict=False))]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    bench = [(1, "Red garden, zebra"), (2, "grow grow cabbages x_1 a1"), (3, ""), (4, None), (5, "naïve nothing the")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return write


def by_sql(spark, name, sf):
    df = spark.sql(catalog.render(name, "spark", sf))
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def rows_of(spark, name, sf):
    df = catalog.query(name)(spark, sf)
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("chars", [1, tokens.CHARS])
@pytest.mark.parametrize("name", sorted(catalog.PLANS))
def test_plan_equals_sql(spark, odd, monkeypatch, name, chars):
    """Odd texts, samples and items; no rows of tokens are kept, as they were before."""
    sf = odd(range(70))
    want = by_sql(spark, name, sf)
    monkeypatch.setattr(tokens, "CHARS", chars)
    monkeypatch.setattr(catalog, "once", lambda df: pytest.fail("tokens are kept"))
    assert rows_of(spark, name, sf) == want and want


@pytest.mark.parametrize("name", sorted(catalog.PLANS))
@pytest.mark.parametrize("ids", [[i // 2 for i in range(40)], [None, *range(30)], []])
def test_ids_that_repeat(spark, odd, name, ids):
    """Documents that share an id or lack one, and none at all."""
    sf = odd(ids)
    assert texts.named_apart(texts.documents(spark, sf)) == (ids == [])
    assert rows_of(spark, name, sf) == by_sql(spark, name, sf)
