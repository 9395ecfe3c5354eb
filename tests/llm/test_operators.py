"""Small tables with nulls, empty and repeated rows, ties and clashing columns, against brute force."""

import hashlib
import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepforge.llm import ann, decontaminate, fingerprint_log, jaccard_join, license_scan, packing, rolling, suffix_array, suffix_dedup, token_counts, toxicity, warc

rng = np.random.default_rng(3)
VOCABULARY = ["".join(rng.choice(list("abcdefghé"), rng.integers(2, 7))) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


def corpus():
    shared = prose(90, 1)
    texts = [prose(120, i + 10) for i in range(14)]
    texts[3] = texts[2]
    texts[4] = texts[2].replace(texts[2].split()[60], "changed", 1)
    texts[5] = texts[5] + "\n" + shared + " end"
    texts[6] = shared + "  \t" + texts[6]
    texts[7] = texts[7] + " " + shared.upper()
    texts[8] = "ab " * 400
    texts[9] = "one two three"
    texts[10] = "ONE two\nthree"
    texts[11] = ""
    rows = [(i, t, "x", "en") for i, t in enumerate(texts)]
    return [*rows, (20, None, "x", None), (21, prose(60, 2), None, "en"), (21, prose(60, 2), None, "en"), (None, prose(70, 4), "y", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, g string, tk string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def key(rows):
    return sorted([tuple(r) for r in rows], key=str)


def brute6(rows, n):
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(x[k : k + n] for _, x in raw for k in range(len(x) - n + 1))
    out = []
    for i, x in raw:
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - n + 1):
            if seen[x[k : k + n]] > 1:
                gone[k : k + n] = True
        kept = bytes(c for c, f in zip(x, gone) if not f)
        out.append((i, len(x), len(x) - len(kept), len(rolling.runs(gone)[0]), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [4096, 2])
def test_suffix_dedup(docs, empty, most):
    assert key(suffix_dedup.dedup(docs, most=most).collect()) == key(brute6(corpus(), 400))
    if most == 2:
        assert suffix_dedup.dedup(empty).count() == 0
        out = suffix_dedup.strip_repeats(docs)
        assert out.columns == docs.columns
        kept = {r.doc_id: r.text for r in out.collect()}
        for i, n, gone, _, sha in brute6(corpus(), 400):
            if gone == n and n:
                assert i not in kept
            elif i is not None and i < 20 and i != 5:
                assert hashlib.sha256(kept[i].encode()).hexdigest() == sha


@pytest.mark.parametrize("most", [2, 7])
def test_suffix_dedup_divides_hot_buckets(spark, most):
    r = np.random.default_rng(5)
    passage, long = prose(85, 70), prose(140, 71)
    rows = [(i, prose(int(r.integers(3, 60)), 300 + i) + " " + passage[int(r.integers(0, 60)) :] + " " + prose(int(r.integers(3, 60)), 400 + i)) for i in range(24)]
    rows += [(100 + i, long.replace(long.split()[int(r.integers(0, 140))], f"w{i}", 1)) for i in range(24)]
    rows += [(200, "a" * 900), (201, "b" + "a" * 600), (202, "a" * 400), (203, "ab" * 300), (204, "x" + "ab" * 250), (205, "é" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert key(suffix_dedup.dedup(df, most=most).collect()) == key(brute6(rows, 400))


def test_suffix_array():
    r = np.random.default_rng(0)
    for _ in range(40):
        t = r.integers(97, 99, r.integers(150, 600)).astype(np.uint8)
        t[-60:] = t[:60]
        starts = np.arange(len(t) - 62)
        c = Counter(t[s : s + 62].tobytes() for s in starts)
        assert (suffix_array.repeated(t, starts, 62) == [c[t[s : s + 62].tobytes()] > 1 for s in starts]).all()


def brute10(rows, n=50):
    split = [(2**63 - 1 if i is None else i, i, (t or "").encode().split()) for i, t, *_ in rows]
    least = {}
    for k, _, w in split:
        for j in range(len(w) - n + 1):
            h = tuple(w[j : j + n])
            least[h] = min(least.get(h, k), k)
    out = []
    for k, i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if least[tuple(w[j : j + n])] < k:
                gone[j : j + n] = [True] * n
        kept = [x for x, f in zip(w, gone) if not f]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize(("batches", "most"), [(1, 8192), (4, 2)])
def test_fingerprint_log(docs, batches, most):
    assert key(fingerprint_log.dedup(docs, batches, most=most).collect()) == key(brute10(corpus()))


def test_fingerprint_log_query_joins_a_compacted_run(spark, monkeypatch):
    levels, append = [], fingerprint_log.FingerprintLog.append

    def noted(self, *args, **how):
        levels.append([r[0] for r in self.runs])
        return append(self, *args, **how)

    monkeypatch.setattr(fingerprint_log.FingerprintLog, "append", noted)
    got = fingerprint_log.op10_fingerprint_log(spark, "/root/testdata/sf0.001").collect()
    assert any(level > 0 for level in levels[-1])
    want = fingerprint_log.dedup(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"), batches=1).collect()
    assert key(got) == key(want)


def brute9(rows):
    sets = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [(i, len(s), least.get(find(a)) if s else i) for a, (i, s) in enumerate(sets)]


def test_jaccard_join(spark, docs, empty):
    assert key(jaccard_join.cluster(docs).collect()) == key(brute9(corpus()))
    # small sets around the boundary, and chains of near copies
    r = np.random.default_rng(5)
    rows = []
    for i in range(150):
        w = list(r.choice(VOCABULARY[:12], r.integers(1, 14)))
        rows.append((i, " ".join(w)))
        rows.append((1000 + i, " ".join(w[: len(w) - int(r.integers(0, 2))])))
    got = jaccard_join.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert key(got) == key(brute9(rows))
    assert jaccard_join.cluster(empty).count() == 0


def test_keep_one_of_null_and_repeated_ids(spark):
    t = [prose(60, 200 + i) for i in range(9)]
    near = t[0] + " " + VOCABULARY[0]
    rows = [(1, t[0], "a"), (2, near, "b"), (None, near, "c"), (None, t[1], "d"), (None, t[2], "e"), (None, t[2], "f"), (5, t[3], "g"), (5, t[4], "h"), (5, t[0], "i"), (6, t[5], "j"), (6, t[5], "k")]
    rows += [(7, t[5], "l"), (8, t[6], "m"), (9, "", "n"), (9, None, "o"), (9, t[7], "p"), (None, "", "q"), (None, None, "r"), (10, t[8], "s"), (10, t[8] + " " + VOCABULARY[1], "t"), (11, "", "u")]
    for order in (rows, rows[::-1]):
        got = jaccard_join.keep_one(spark.createDataFrame(order, "doc_id long, text string, name string").repartition(3))
        names = Counter(r.name for r in got.collect())
        assert max(names.values()) == 1 and got.columns == ["doc_id", "text", "name"]
        # one of each of these groups, and nothing else
        groups = ["a", "d", "ef", "g", "h", "jk", "m", "no", "p", "q", "r", "st", "u"]
        assert [len(set(g) & set(names)) for g in groups] == [1] * len(groups) and len(names) == len(groups)
    plain = jaccard_join.keep_one(spark.createDataFrame([x[:2] for x in rows if x[0] in (1, 2, 7, 8, 11)], "doc_id long, text string"))
    assert sorted(r.doc_id for r in plain.collect()) == [1, 7, 8, 11]


def test_cross_component_blocks():
    """Members of a list in two parts: the links that the blocks give connect what all pairs of linked sets connect."""
    r = np.random.default_rng(3)
    base = [np.unique(r.integers(0, 2**63, 80, dtype=np.uint64)) for _ in range(6)]
    sets = [np.sort(np.concatenate([b[int(r.integers(0, 12)) :], r.integers(0, 2**63, int(r.integers(0, 9)), dtype=np.uint64)])) for b in base for _ in range(9)]
    raw = [(s >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in sets]

    def connected(pairs):
        root = list(range(len(sets)))
        for a, b in pairs:
            root = [root[a] if x == root[b] else x for x in root]
        return {frozenset(i for i in range(len(sets)) if root[i] == x) for x in root}

    def rows(columns, names):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    found = []
    for p, q in ((0, 0), (0, 1), (1, 1)):
        at = [i for i in range(len(sets)) if i % 2 in (p, q)]
        n = len(at)
        block = rows([[7] * n, [p] * n, [q] * n, at, at, [len(sets[i]) for i in at], [jaccard_join.sketch(sets[i]) for i in at], [i % 2 for i in at]], list("hpqkrnso"))
        for close in jaccard_join._cross(75)(iter([block])):
            k = close.column(3).to_pylist()
            assert len(set(k)) == len(k)
            zero = [0] * len(k)
            columns = [c.to_pylist() for c in close.columns]
            joined = rows([*columns[:3], zero, zero, *columns[3:], [raw[i] for i in k]], list("hpqrsktnxm"))
            for out in jaccard_join._joined(75)(iter([joined])):
                assert out.num_rows < len(k)
                found += zip(*(c.to_pylist() for c in out.columns), strict=True)
    true = [(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(s := np.intersect1d(sets[a], sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - len(s))]
    assert set(found) <= set(true) and connected(found) == connected(true)


def test_sketch_bound():
    r = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(r.integers(0, 2**63, 400, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: r.integers(0, 400)], r.integers(0, 2**63, r.integers(0, 60), dtype=np.uint64)]))
        if len(b):
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= 75 * (len(a) + len(b) - shared):
                assert jaccard_join.may_link(jaccard_join.sketch(a), jaccard_join.sketch(b), len(a), len(b))


def test_license_scan(spark, empty):
    rows = [(1, "Under the MIT license, and cc-by-nc; CC BY NC."), (2, None), (3, ""), (4, license_scan.NOTICES[2][0].replace("source", "src", 1)), (None, "apache license version 2"), (1, "Under the MIT license, and cc-by-nc; CC BY NC.")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (11, 3, 0, 8, "cc-by-nc,mit")
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].labels, got[2].score) == (0, 0, None, "", 0.0)
    assert got[4].base_labels == "" and got[4].labels == "bsd" and got[None].base_labels == "apache-2"
    assert license_scan.scan(empty).count() == 0


def test_ann(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((600, 16)) * r.uniform(0.5, 2, (600, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, []), (702, [0.0] * 16), (703, [float("nan")] * 16), (704, [None] * 16), (None, [1.0] * 16), (705, [1.0] * 3)]
    v = ann.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert v.count() == 600
    got = ann.nearest(v, v.where("id % 20 = 0").select("id", "v"), row_block=200, query_block=16).collect()
    hits = 0
    for q in range(0, 600, 20):
        own = sorted((g for g in got if g.query_id == q), key=lambda g: g["rank"])
        assert [g["rank"] for g in own] == list(range(1, 21)) and all(abs(g.score - x[q] @ x[g.vec_id]) < 1e-9 for g in own)
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & {g.vec_id for g in own})
    assert hits >= 0.9 * 600
    few = v.where("id < 5")
    assert ann.nearest(few, few.select("id", "v")).count() == 20
    assert ann.nearest(v.where("false"), v.where("false").select("id", "v")).count() == 0


def test_ann_of_ties_and_repeated_ids(spark):
    x = np.random.default_rng(4).standard_normal((30, 8))
    rows = [(i, x[i % 10].tolist(), "e", 1.0) for i in range(60)] + [(20, x[3].tolist(), "e", 2.0), (20, x[4].tolist(), "e", 3.0), (0, x[5].tolist(), "e", 1.0)]
    v = ann.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, square double"))
    got = ann.nearest(v, v.where("id = 20 and v[0] = " + repr(float(x[0][0]))).select("id", "v"), top=50).collect()
    every = sorted(((-float(np.dot(x[0], r[1])), r[0]) for r in rows if r[0] != 20), key=lambda t: (round(t[0], 9), t[1]))[:50]
    assert [(g["rank"], g.vec_id) for g in sorted(got, key=lambda g: g["rank"])] == [(i + 1, t[1]) for i, t in enumerate(every)]
    index = ann.MultiIndex(np.array([[0, 0], [1, 3], [65535, 0], [7, 65535]], np.uint16))
    assert index.within(np.array([0, 0], np.uint16), 2)[0].tolist() == [0] and index.within(np.array([0, 0], np.uint16), 3)[0].tolist() == [0, 1]


def test_decontamination_of_repeated_rows(spark, empty):
    item = prose(30, 99)
    rows = [(1, prose(40, 1) + " " + item, "x", 1), (1, prose(40, 1) + " " + item, "x", 1), (None, item, "y", 2), (2, prose(60, 2), "z", 3), (3, prose(30_000, 3) + " " + item + " " + prose(20_000, 4), "l", 4), (4, "", "q", 1), (5, None, "q", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, word int")
    bench = spark.createDataFrame([(7, item, "e"), (7, item, "e"), (8, None, "e"), (9, "", "e")], "item_id long, text string, doc_id string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()} == {(1, 7), (None, 7), (3, 7)}
    assert decontaminate.matches(docs, bench).count() == 3
    assert [r.doc_id for r in decontaminate.clean(docs, bench).orderBy("doc_id").collect()] == [2, 4, 5]
    assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.clean(docs, bench.where("false")).count() == 7


def test_empty_tables_and_clashing_columns(spark, empty):
    assert fingerprint_log.dedup(empty).count() == 0
    docs = spark.createDataFrame([(1, prose(60, 1), "a", "b", "c"), (2, prose(60, 1), "a", "b", "c")], "doc_id long, text string, tk string, g string, first string")
    assert [(r.doc_id, r.n_removed) for r in fingerprint_log.dedup(docs.select("doc_id", "text", "tk", "g", "first")).orderBy("doc_id").collect()] == [(1, 0), (2, 60)]
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(empty, toxicity.train(empty, toxicity.query_labels(labels))).count() == 0
    many = docs.union(docs)
    assert toxicity.score(many, toxicity.train(many, toxicity.query_labels(labels))).count() == 4


def test_decontamination(spark, empty):
    item = prose(40, 77)
    words = item.split()
    rows = [(1, prose(200, 80) + " " + item.upper() + " " + prose(90, 81)), (2, prose(200, 82) + " " + " ".join(w for i, w in enumerate(words) if i % 6) + " " + prose(40, 83)), (3, prose(300, 84)), (4, None), (5, "")]
    rows += [(10 + i, prose(150, 100 + i)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, prose(35, 90))], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.matches(df, bench).collect()) == [(1, 7), (2, 7)]
    assert decontaminate.clean(df, bench).count() == len(rows) - 2
    assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.matches(df, bench.where("false")).count() == 0


def test_decontamination_finds_every_copy_of_many_items(spark):
    r = np.random.default_rng(12)
    vocabulary = np.array([f"w{i}" for i in range(4000)])
    items = [" ".join(r.choice(vocabulary, int(n))) for n in r.integers(14, 60, 1200)] + [" ".join(r.choice(vocabulary, 400)) for _ in range(5)]
    rows = [(i, " ".join([*r.choice(vocabulary, 150), x, *r.choice(vocabulary, 150)])) for i, x in enumerate(items)]
    rows += [(len(items) + i, " ".join(r.choice(vocabulary, 200))) for i in range(200)]
    got = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    whole = {(x.doc_id, x.item_id): x.share for x in got}
    assert [i for i in range(len(items)) if whole.get((i, i)) != 1.0] == []
    assert all(d == i for d, i in whole)


def test_common_subsequence():
    r = np.random.default_rng(4)
    for _ in range(50):
        a, b = r.integers(0, 6, 20).tolist(), r.integers(0, 6, 30).tolist()
        t = np.zeros((21, 31), int)
        for i in range(20):
            for j in range(30):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.Item(0, a).check(b)[0] == t[20, 30]


def test_token_counts(spark, docs):
    encoding = token_counts.encoder(open(token_counts.VOCABULARY, "rb").read())
    for rule in token_counts.RULES:
        got = token_counts.count(docs, rule).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("end_char").alias("c")).collect()
        want = Counter()
        for i, t, *_ in corpus():
            want[i] += len(token_counts.token_ends((t or "").encode(), encoding))
        assert {r.doc_id: round(r.n, 6) for r in got} == {k: float(v) for k, v in want.items()}
    # sections against brute force: each token, by its bytes
    known, lens = encoding
    for i, t, *_ in corpus()[:10]:
        raw, at, want, cuts = t.encode(), 0, Counter(), [0, *(m.end() for m in re.finditer(b"\n", t.encode()) if m.end() < len(t.encode()))]
        for token in known.encode_ordinary(t):
            share = Counter(max(c for c in range(len(cuts)) if cuts[c] <= b) for b in range(at, at + lens[token]))
            want[min(share, key=lambda c: (-share[c], c))] += 1
            at += lens[token]
        got = {r.section: r.n_tokens for r in token_counts.count(docs.where(F.col("doc_id") == i), "majority").collect()}
        assert at == len(raw) and got == {c: float(want[c]) for c in range(len(cuts))}
    long = "lorem ipsum d'or 12 " * 40_000
    assert len(list(token_counts.parts(long.encode()))) > 2 and len(token_counts.token_ends(long.encode(), encoding)) == len(known.encode_ordinary(long)) == token_counts.count_tokens(long.encode(), encoding)
    assert token_counts.count(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    counts, touched = token_counts.attribute(np.array([2, 5, 6]), np.array([0, 3]), "majority")
    assert counts.tolist() == [1, 2] and touched.tolist() == [1, 1]
    assert token_counts.attribute(np.array([2, 5, 6]), np.array([0, 3]), "first")[0].tolist() == [2, 1]


def test_packing(spark, docs, empty):
    r = np.random.default_rng(6)
    items = sorted(r.integers(1, 8193, 300).tolist(), reverse=True)
    bins, caps, cost = packing.pack(items)
    assert sorted(i for b in bins for i in b) == list(range(300))
    assert all(sum(items[i] for i in b) <= c for b, c in zip(bins, caps))
    assert cost <= min(packing.pack(items, sizes)[2] for sizes in ((8192,), (4096, 8192)))
    got = packing.pack_documents(docs, (64, 128)).collect()
    known = token_counts.encoder(open(token_counts.VOCABULARY, "rb").read())
    assert sum(x.length for x in got) == sum(len(known[0].encode_ordinary(t or "")) for _, t, *_ in corpus())
    by = Counter()
    for x in got:
        by[x.bin_id] += x.length
        assert x.used <= x.capacity
    assert all(by[x.bin_id] == x.used for x in got)
    assert packing.pack_documents(empty).count() == 0
    # equal ids, null or not, spread over the shards; ties in length lose nothing
    same = spark.createDataFrame([(None if i % 2 else 7, "a b c", "x") for i in range(400)], "doc_id long, text string, shard string")
    got = packing.pack_documents(same, (16, 64), shard_rows=50).collect()
    assert len(got) == 400 and len({x.bin_id >> 32 for x in got}) == 8


def test_packing_is_joint():
    """Against every vector of opening sizes on small inputs."""
    from itertools import product

    r = np.random.default_rng(11)
    for _ in range(20):
        sizes = (16, 32, 64)
        items = sorted(r.integers(1, 65, 25).tolist(), reverse=True)
        best = min(
            sum(packing.bin_cost(min(s for s in sizes if s >= u)) for u in packing._fill(items, lambda n, left: max(c[0 if n <= 16 else 1 if n <= 32 else 2], n))[1])
            for c in product(sizes, repeat=3)
            if c[1] >= 32 and c[2] >= 64
        )
        assert packing.pack(items, sizes)[2] <= best * 1.05


def test_toxicity(spark):
    r = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        rows.append((i, prose(40, 1000 + i) + (" idiot" + str(r.choice(["", "en", "isch"])) if toxic else "")))
        labels.append((i, 1, int(toxic)))
    rows += [(400, None), (401, ""), (402, "such an IDIOT")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = toxicity.query_labels(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {x.doc_id: x for x in toxicity.score(df, toxicity.train(df, lab)).collect()}
    assert sum(got[i].is_toxic == (i % 5 == 0) for i in range(300)) >= 295 and got[402].is_toxic == 1 and got[400].is_toxic == 0
    none = toxicity.train(df, lab.where("false"))
    assert toxicity.score(df, none).where("is_toxic = 1").count() == 0


def test_license_scan_takes_each_row_by_itself(spark, empty):
    import duckdb
    import pandas as pd

    rows = [(1, "under the MIT license"), (1, "under the mit license; cc by nc"), (1, "under the MIT license"), (None, "cc-by-nc"), (None, "plain"), (2, None), (3, ""), (4, "mit license " * 30_000 + "all rights reserved")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, row int, template string")
    got = license_scan.scan(df).collect()
    assert key((r.doc_id, r.n_words, r.n_base) for r in got) == key([(1, 4, 1), (1, 7, 2), (1, 4, 1), (None, 3, 1), (None, 1, 0), (2, 0, 0), (3, 0, 0), (4, 60_003, 0)])
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    names = sorted(got[0].asDict())
    assert key(tuple(r[c] for c in names) for r in got) == key(con.sql(f"SELECT {', '.join(names)} FROM ({license_scan.ORACLE})").fetchall())
    assert license_scan.scan(empty).count() == 0


class Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in warc.HIDDEN
        self.out += ["\n"] * (tag in warc.BLOCKS)

    def handle_endtag(self, tag):
        self.hidden -= tag in warc.HIDDEN
        self.out += ["\n"] * (tag in warc.BLOCKS)

    def handle_data(self, data):
        self.out += [data] * (not self.hidden)


def test_warc_text_against_a_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.block for r in warc.derive(warc.responses(pages)).where("warc_type = 'conversion'").collect()}
    for r in pages.collect():
        p = Text()
        p.feed(r.html or "")
        p.close()
        assert got[r.page_id].split() == "".join(p.out).split()


def test_warc_defined_cases(spark):
    began = time.time()
    for page in ("<a " * 400_000, "<title>" * 200_000, "<a href='" * 200_000, "<!--" * 300_000, "<script>" * 200_000, "< " * 400_000, "<p>" * 300_000, "</title " * 200_000):
        warc.read_page(page)
    assert time.time() - began < 30
    schema = "page_id long, url string, html string, warc_type string"
    rows = [(1, "http://a/\r\nWARC-Type: response", "<p>x", "w"), (1, "http://a/\r\nWARC-Type: response", "<p>x", "w"), (None, "u", "<a\nhref = /q?a>b>c<title>q > r</title", "w")]
    got = warc.derive(warc.responses(spark.createDataFrame(rows, schema))).collect()
    assert len(got) == 6 and len({r.record_id for r in got}) == 4
    for r in got:
        head, block = warc.parse_record(bytes(r.record))
        assert head["WARC-Type"] == r.warc_type and block.decode() == r.block and head["WARC-Target-URI"] == r.target_uri
    assert {r.target_uri for r in got} == {"http://a/%0D%0AWARC-Type:%20response", "u"}
    assert "outlink: /q?a" in next(r.block for r in got if r.page_id is None and r.warc_type == "metadata")
    assert warc.derive(warc.responses(spark.createDataFrame([], schema))).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/", "<html><title>T &amp; U</title><script>x('</p>')</script><p>One <b>two</b><br>three<!-- no --><a href='/l'>link</a>"), (2, None, None), (3, "http://b/", "")]
    got = warc.derive(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert len(got) == 6
    for x in got:
        head, block = warc.parse_record(bytes(x.record))
        assert block.decode() == x.block and head["WARC-Refers-To"] == x.refers_to and head["WARC-Block-Digest"] == warc.digest(block)
    one = {x.warc_type: x for x in got if x.page_id == 1}
    assert one["conversion"].block == "T & U\nOne two\nthreelink"
    assert "outlink: /l" in one["metadata"].block and "title: T & U" in one["metadata"].block
