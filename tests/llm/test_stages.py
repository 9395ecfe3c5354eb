"""The pipeline's stages, one by one against brute force and all together, on nulls, empty tables and clashing columns."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_operators import brute6, brute9, prose  # noqa: E402

from stepforge.llm import packing, token_counts  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _kept string, k1 string, spans string, toxic int"


def rows():
    texts = {i: prose(120, 500 + i) for i in range(40)}
    for i in (3, 9, 15, 21, 27, 33):
        texts[i] += " idiot"
    texts[1] = texts[0]
    texts[2] = texts[0].replace(texts[0].split()[50], "changed", 1)
    passage = prose(100, 77)
    texts[4] += " " + passage
    texts[5] = passage + " " + texts[5]
    texts[6] = prose(20, 8) + " " + ITEM + " " + prose(20, 9)
    texts |= {i: prose(30, i) + " idiot" * (i % 5 == 0) for i in range(1000, 1240)}
    out = [(i, t) for i, t in texts.items()] + [(100, None), (101, ""), (102, "a b"), (None, prose(50, 901)), (None, prose(50, 902)), (None, None), (7, prose(60, 903)), (103, "é " * 90_000 + "end")]
    return [(i, t, "en", "web", len(t or ""), 5, "kept", "k", "s", 1) for i, t in out]


ITEM = prose(40, 4242)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    docs.write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(i % 2), int(" idiot" in (t or ""))) for i, t, *_ in rows() if i is not None and (i < 40 or i >= 1000)]
    spark.createDataFrame([*labels, (None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def read(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_toxicity(spark, sf):
    docs = read(spark, sf)
    out = corpus_pipeline.toxicity(spark, docs, sf)
    assert out.columns == docs.columns
    want = Counter({k: n for k, n in pairs(docs).items() if " idiot" not in (k[1] or "")})
    assert pairs(out) == want


def test_near_duplicates(spark, sf):
    docs = read(spark, sf)
    out = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert out.columns == docs.columns
    # 7 stands twice with different texts: both are of components of their own
    assert pairs(out) == Counter({k: n for k, n in pairs(docs).items() if k[0] not in (1, 2)})


def test_repeated_passages(spark, sf):
    docs = read(spark, sf)
    out = corpus_pipeline.repeated_passages(spark, docs, sf)
    assert out.columns == docs.columns
    raw = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 10_000]
    want = Counter()
    for (i, t), (_, n, gone, _, sha) in zip(raw, brute6(raw, 400), strict=True):
        if not (gone and gone == n):
            want[i, sha] += 1
    got = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect() if r.doc_id != 103)
    assert got == want
    assert out.where("n_chars <> coalesce(length(text), 0)").count() == 0
    # one text of a two-character period repeats itself all through; its end is cut with it, as it stands in the last window only
    assert out.where("doc_id = 103").first().text.strip().endswith("end")


def test_repeated_passages_of_fewer_bytes(spark):
    """60 short words, under 400 bytes, stay with the least doc_id only; documents without an id are separate; 49 words stay."""
    passage, some = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(49))
    texts = [(1, f"one\n{passage} end"), (2, f"{passage}\ntwo  lines\n"), (3, f"a b\t{passage}"), (4, passage), (None, f"five {passage} six"), (None, f"seven {passage}  eight"), (None, None), (8, f"{some} x"), (9, f"y {some}"), (9, f"z\n\n{some}"), (10, "")]
    docs = spark.createDataFrame([(i, t, len(t or ""), "k") for i, t in texts], "doc_id long, text string, n_chars long, k1 string")
    want = Counter([(1, texts[0][1]), (2, "two  lines\n"), (3, "a b\t"), (None, "five six"), (None, "seven eight"), (None, None), *texts[7:]])
    out = corpus_pipeline.repeated_passages(spark, docs, "")
    assert out.columns == docs.columns and pairs(out) == want
    assert out.where("n_chars <> coalesce(length(text), 0)").count() == 0
    unique = docs.where("doc_id <> 9")
    assert pairs(corpus_pipeline.repeated_passages(spark, unique, "")) == Counter({k: n for k, n in want.items() if k[0] not in (None, 9)})
    assert corpus_pipeline.repeated_passages(spark, docs.where("false"), "").count() == 0


def test_benchmark_leaks(spark, sf):
    docs = read(spark, sf)
    out = corpus_pipeline.benchmark_leaks(spark, docs, sf)
    assert out.columns == docs.columns
    assert pairs(out) == Counter({k: n for k, n in pairs(docs).items() if k[0] != 6})


def test_packing(spark, sf):
    got = corpus_pipeline.packing(spark, read(spark, sf), sf).collect()
    with open(token_counts.VOCABULARY, "rb") as f:
        known = token_counts.encoder(f.read())
    assert sum(r.length for r in got) == sum(len(known[0].encode_ordinary(t or "")) for _, t, *_ in rows())
    for cap, used in {r.bin_id: (r.capacity, r.used) for r in got}.values():
        assert used <= cap and cap in packing.SIZES


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf).collect()
    left = {r.doc_id for r in got}
    assert not left & {1, 2, 3, 6, 9, 15, 21, 27, 33, 100, 101} and {0, 4, 5, 7, 8, 102, 103, None} <= left


def test_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = read(spark, sf)
    assert pairs(corpus_pipeline.toxicity(spark, docs, str(tmp_path))) == pairs(docs) == pairs(corpus_pipeline.benchmark_leaks(spark, docs, str(tmp_path)))


def test_components_of_the_fixture():
    plain = [(i, t) for i, t, *_ in rows() if i is not None and i not in (7, 103)]
    assert {i: c for i, _, c in brute9(plain)}[2] == 0
