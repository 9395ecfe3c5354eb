"""Figures over predictions, verifier scores and paired results; joins of runs; names; gates over answers.

The driver's tables stand for runs: an order is a sample with its label and vote, its lines are traces or scored steps,
customers are problems.  Every query has an oracle written by itself in another shape of SQL.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepforge.sources.tables import table


def hit(n: int, *columns: str) -> Column:
    return F.col(columns[0]) % n == 0


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, trace, truth, pred, tokens): the lines of an order as traces with a prediction each, some without."""
    t = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    pred = F.when(F.col("l_partkey") % 11 == 0, None).when(F.col("l_partkey") % 3 == 0, "O").otherwise("F")
    return t.select(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").alias("trace"), "l_partkey", F.when(F.col("o_orderstatus") == "O", "O").otherwise("F").alias("truth"), pred.alias("pred"), F.col("l_quantity").cast("double").alias("tokens"), (F.col("o_custkey") % 4).alias("dataset"))


_T = "t AS (SELECT l_orderkey AS sample, l_linenumber AS trace, l_partkey, CASE WHEN o_orderstatus = 'O' THEN 'O' ELSE 'F' END AS truth, CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 3 = 0 THEN 'O' ELSE 'F' END AS pred, l_quantity::DOUBLE AS tokens, o_custkey % 4 AS dataset FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def per_trace_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the samples' hit rates and mean over all traces, with population deviations; steps and tokens (A-09, A-10)."""
    t = _traces(spark, sf_dir).withColumn("hit", F.coalesce(F.col("pred") == F.col("truth"), F.lit(False)).cast("double"))
    per = t.groupBy("dataset", "sample").agg(F.avg("hit").alias("rate"), F.sum("hit").alias("hits"), F.sum(F.col("hit") * F.col("hit")).alias("squares"), F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    return per.groupBy("dataset").agg(
        F.round(F.avg("rate"), 6).alias("by_sample"), F.round(F.stddev_pop("rate"), 6).alias("by_sample_std"), F.round(F.sum("hits") / F.sum("n"), 6).alias("by_trace"),
        F.round(F.sqrt(F.sum("squares") / F.sum("n") - F.pow(F.sum("hits") / F.sum("n"), F.lit(2))), 6).alias("by_trace_std"),
        F.round(F.avg("n"), 2).alias("steps"), F.round(F.stddev_pop("n"), 2).alias("steps_std"), F.round(F.avg("tokens"), 1).alias("tokens"), F.round(F.stddev_pop("tokens"), 1).alias("tokens_std"),
    )


def math_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by equivalence of answers, blank answers wrong, and precision of the answered (A-08)."""
    from stepforge.operators.grouped import same_answer

    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_partkey") % 13 == 0, "").otherwise(F.format_string("%d/%d", q * (F.col("l_partkey") % 3 + 1), n * 2)).alias("pred"), F.format_string("\\frac{%d}{%d}", q, n).alias("gold"), (F.col("l_suppkey") % 5).alias("dataset"))
    pairs = rows.groupBy("dataset", "pred", "gold").agg(F.count("*").alias("n")).withColumn("ok", same_answer(F.col("pred"), F.col("gold")))
    right = F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0))
    return pairs.groupBy("dataset").agg(F.sum("n").alias("n"), F.round(right / F.sum("n"), 4).alias("accuracy"), F.round(right / F.sum(F.when(F.col("pred") != "", F.col("n"))), 4).alias("precision_answered"))


def upper_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of the samples' numbers of traces, by dataset (A-04): by counts of the lengths, not by a list of all."""
    n = _traces(spark, sf_dir).groupBy("dataset", "sample").agg(F.count("*").alias("n")).groupBy("dataset", "n").agg(F.count("*").alias("c"))
    by = Window.partitionBy("dataset").orderBy("n")
    below = F.sum("c").over(by) - F.col("c")
    rows = n.select("dataset", "n", "c", below.alias("below"), F.floor(F.sum("c").over(Window.partitionBy("dataset")) / 2).alias("at"))
    return rows.where("below <= at and at < below + c").select("dataset", F.col("n").alias("median_steps"))


def generation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, success rate, averages and the distinct temperatures of each dataset (A-20), and whether most rows are of the first kind (A-11)."""
    t = _traces(spark, sf_dir).withColumn("temperature", F.round(F.lit(0.5) + (F.col("l_partkey") % 5) * 0.1, 2))
    per = t.groupBy("dataset", "sample").agg(F.count("*").alias("n"), F.count("pred").alias("ok"), F.max("truth").alias("truth"), F.collect_set("temperature").alias("ts"))
    return per.groupBy("dataset").agg(F.count("*").alias("samples"), F.sum("n").alias("traces"), F.round(F.sum("ok") / F.sum("n"), 4).alias("success_rate"), F.round(F.avg("n"), 2).alias("per_sample"), (F.avg((F.col("truth") == "O").cast("int")) > 0.5).alias("mostly_open"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ts")))), ",").alias("temperatures"))


def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by the part of the reason before a colon or an arrow (A-21)."""
    reason = F.concat("event_type", F.element_at(F.array(F.lit(": no reply"), F.lit(" -> cut"), F.lit("")), (F.col("event_id") % 3 + 1).cast("int")))
    rows = table(spark, sf_dir, "events").select(F.trim(F.element_at(F.split(reason, ":|->"), 1)).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


def trace_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each sample the first trace whose prediction is the vote (ties: the one seen first), else the longest (A-22, A-01)."""
    t = _traces(spark, sf_dir).groupBy("sample", "trace").agg(F.min("l_partkey").alias("l_partkey"), F.max("tokens").alias("tokens"))
    t = t.withColumn("pred", F.when(F.col("l_partkey") % 11 == 0, None).when(F.col("l_partkey") % 3 == 0, "O").otherwise("F"))
    votes = t.where("pred is not null").groupBy("sample", "pred").agg(F.count("*").alias("c"), F.min("trace").alias("first"))
    vote = votes.groupBy("sample").agg(F.max_by(F.struct("pred", "first"), F.struct("c", -F.col("first"))).alias("v"))
    longest = t.groupBy("sample").agg(F.max_by("trace", F.struct("tokens", -F.col("trace"))).alias("longest"))
    return longest.join(vote, "sample", "left").select("sample", F.col("v.pred").alias("vote"), F.coalesce("v.first", "longest").cast("long").alias("trace"))


def update_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows replaced by the newer run's where it has them, its last row of a key winning (J-01, J-03); and whether it had one."""
    newer = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("new"))
    old = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.lit("none").alias("event_type"), F.lit(0.0).alias("value")).alias("old"))
    got = old.join(newer, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", F.coalesce("new", "old").alias("r"), F.col("new").isNotNull().alias("updated"))
    return got.select("c_custkey", "r.event_type", F.round("r.value", 6).alias("value"), "updated")


def common_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two settings on the problems that both have scored, with a truth (J-02, J-05, A-18); ids that only one has (J-04)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    full = docs.where("doc_id % 3 <> 0").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("a"))
    base = docs.where("doc_id % 4 <> 0").select("doc_id", (F.col("n_chars") > 900).cast("int").alias("b"))
    both = full.join(base, "doc_id", "full").join(labels.where("quality is not null").select("doc_id", "quality"), "doc_id")
    paired = F.col("a").isNotNull() & F.col("b").isNotNull()
    right = lambda c: F.avg(F.when(paired, (F.col(c) == F.col("quality")).cast("double")))
    return both.agg(F.count(F.when(paired, 1)).alias("n"), F.count(F.when(F.col("a").isNull() & F.col("b").isNotNull(), 1)).alias("only_base"), F.count(F.when(F.col("b").isNull() & F.col("a").isNotNull(), 1)).alias("only_full"), F.round((right("a") - right("b")) * 100, 1).alias("delta"))


def label_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows with the pool's label, null where the pool has none (J-07), matched by text first and by place if the text isn't there (J-09)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("k"))
    pool = docs.where("doc_id % 2 = 0").groupBy("k").agg(F.min("doc_id").alias("by_text"))
    place = docs.where("doc_id % 2 = 0 and doc_id % 3 <> 0").select((F.col("doc_id") + 1).alias("doc_id"), F.col("doc_id").alias("by_place"))
    rows = docs.where("doc_id % 2 = 1").join(pool, "k", "left").join(place, "doc_id", "left")
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("match")).agg(F.max("toxic").alias("toxic"))
    rows = rows.select("doc_id", F.coalesce("by_text", "by_place").alias("match"), F.when(F.col("by_text").isNotNull(), "text").when(F.col("by_place").isNotNull(), "place").otherwise("none").alias("how"))
    return rows.join(labels, "match", "left").select("doc_id", "match", "how", "toxic")


def positional_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of scores paired by place within a user, as far as the shorter one goes (J-08)."""
    place = lambda kind, name: table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("i"), F.col("value").alias(name))
    pairs = place("click", "a").join(place("view", "b"), ["user_id", "i"]).where("a is not null and b is not null and not isnan(a) and not isnan(b)")
    return pairs.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("diff"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, step, kind, ok, says): validity and redundancy scores of steps; for two kinds the redundancy decides (V-01)."""
    t = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("redundency", "circular", "counterfactual", "confidence"))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    says = F.when(F.col("l_orderkey") % 4 < 2, ~(F.col("l_tax") > 0.03)).otherwise(F.col("l_discount") > 0.02)
    return t.select(F.col("l_orderkey").alias("idx"), F.col("l_linenumber").alias("step"), kind.alias("kind"), (F.col("l_returnflag") != "R").alias("ok"), says.alias("says"))


_S = "s AS (SELECT l_orderkey AS idx, l_linenumber AS step, ['redundency', 'circular', 'counterfactual', 'confidence'][l_orderkey % 4 + 1] AS kind, l_returnflag <> 'R' AS ok, CASE WHEN l_orderkey % 4 < 2 THEN NOT l_tax > 0.03 ELSE l_discount > 0.02 END AS says FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def micro_verifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over all steps of a kind, positive and negative F1, and the total (V-01, V-03, V-04): -1 where undefined."""
    s = _scored(spark, sf_dir)
    n = lambda a, b: F.count(F.when((F.col("ok") == a) & (F.col("says") == b), 1))
    c = s.rollup("kind").agg(n(True, True).alias("tp"), n(False, True).alias("fp"), n(False, False).alias("tn"), n(True, False).alias("fn"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(-1.0)
    f1 = lambda p, r: F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(-1.0), 4)
    return c.select(F.coalesce("kind", F.lit("total")).alias("kind"), "tp", "fp", "tn", "fn", f1(share("tp", "fp"), share("tp", "fn")).alias("f1"), f1(share("tn", "fn"), share("tn", "fp")).alias("negative_f1"))


def item_accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy on right, wrong and first wrong steps of each item (V-02, V-05): -1 where there are none."""
    s = _scored(spark, sf_dir)
    first = s.where("not ok").groupBy("idx").agg(F.min("step").alias("first"))
    rows = s.join(first, "idx", "left").withColumn("right", (F.col("ok") == F.col("says")).cast("double"))
    mean = lambda w: F.round(F.coalesce(F.avg(F.when(w, F.col("right"))), F.lit(-1.0)), 4)
    return rows.groupBy("idx").agg(mean(F.col("ok")).alias("correct_acc"), mean(~F.col("ok")).alias("wrong_acc"), F.round(F.avg("right"), 4).alias("total_acc"), mean(~F.col("ok") & (F.col("step") == F.col("first"))).alias("first_error_acc"))


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by kind and setting, one column a setting (V-06)."""
    s = _scored(spark, sf_dir).withColumn("setting", F.when(F.col("idx") % 3 == 0, "with").otherwise("wout"))
    return s.groupBy("kind").pivot("setting", ["with", "wout"]).agg(F.round(F.avg((F.col("ok") == F.col("says")).cast("double")), 4))


def wilcoxon_p(t: float, n: int, ties: float) -> float:
    """Two-sided p by the normal approximation with tie correction; without differences 1."""
    spread = (n * (n + 1) * (2 * n + 1) - ties / 2) / 24
    return math.erfc(abs(t - n * (n + 1) / 4) / math.sqrt(spread) / math.sqrt(2)) if n and spread > 0 else 1.0


def bootstrap_interval(d: np.ndarray, rounds: int = 5000, seed: int = 42) -> tuple[float, float]:
    """Percentiles 2.5 and 97.5 of the means of resamples, by numpy's default generator (H-03)."""
    rng, means = np.random.default_rng(seed), np.empty(rounds)
    if not len(d):
        return math.nan, math.nan
    means = rng.choice(d, size=(rounds, len(d)), replace=True).mean(axis=1) if rounds * len(d) <= 1 << 24 else np.array([rng.choice(d, len(d)).mean() for _ in range(rounds)])
    return tuple(np.percentile(means, (2.5, 97.5)))


def paired_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired tests of two event types by country group of users: mean difference, d, bootstrap interval, p and stars (H-01 to H-05, H-07, H-08).

    A group is one report section of at most 50 values of user_id (the feature: sections of a published report), so its
    differences fit in a worker."""
    from stepforge.functions.report import stars

    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("b"))
    d = e.dropna().select((F.floor(F.col("user_id") / 50)).alias("section"), "user_id", F.round(F.col("a") - F.col("b"), 9).alias("d"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        d = g.sort_values("user_id")["d"].to_numpy()
        z = np.abs(d[d != 0])
        ranks = pd.Series(z).rank().to_numpy()
        t = min(ranks[d[d != 0] > 0].sum(), ranks[d[d != 0] < 0].sum()) if len(z) else 0.0
        c = np.unique(z, return_counts=True)[1].astype(float)
        p = wilcoxon_p(t, len(z), float((c**3 - c).sum()))
        low, high = bootstrap_interval(d, 1000)
        return pd.DataFrame([(int(g["section"].iloc[0]), len(d), round(float(d.mean()), 6), round(float(d.mean() / (d.std(ddof=1) + 1e-12)), 6) if len(d) > 1 else None, low, high, p, stars(p))], columns=["section", "n", "diff", "paired_d", "ci_lo", "ci_hi", "p", "stars"])

    return d.groupBy("section").applyInPandas(run, "section long, n long, diff double, paired_d double, ci_lo double, ci_hi double, p double, stars string")


def slug(c: Column) -> Column:
    """A model's name for folders (S-11)."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9._-]+", "-"), "^[-.]+|[-.]+$", "")


def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of models, settings, datasets and exports, made and read again (S-10, S-11, S-13, S-14)."""
    p = table(spark, sf_dir, "part")
    stem = F.concat(slug(F.col("p_name")), F.lit("_traces_"), F.when(F.col("p_partkey") % 2 == 0, "with_answer").otherwise("wout_answer"))
    alias = F.create_map(*[F.lit(x) for x in ("brand#1", "first", "brand#2", "second", "brand#3", "third")])
    dataset = F.lower(F.regexp_extract(F.concat(F.lit("/data/"), F.substring("p_brand", 1, 7), F.lit(".JSON")), r"([^/]+)\.[^.]+$", 1))
    read = lambda i: F.regexp_extract(stem, "^(.*)_traces_(with_answer|wout_answer)$", i)
    return p.select("p_partkey", slug(F.col("p_name")).alias("slug"), read(1).alias("model"), read(2).alias("setting"), F.coalesce(F.try_element_at(alias, dataset), dataset).alias("dataset"))


def as_text(c: Column) -> Column:
    """A list of texts as one (S-15)."""
    return F.array_join(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""), " ")


def problem_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems from records with several possible keys (S-05, S-15 to S-18): the first row of a key stays, lists become text,
    targets are the first that isn't blank, and a proof's length is its number of implications."""
    p = table(spark, sf_dir, "part")
    proof = F.concat(F.lit("a -> b; "), F.when(F.col("p_partkey") % 3 == 0, F.lit("fact; b -> c")).otherwise(F.lit("fact")))
    rows = p.select(
        "p_partkey", F.coalesce(F.when(F.col("p_partkey") % 4 > 0, F.col("p_type")), "p_brand").alias("key"), as_text(F.array(F.lit(" if "), F.col("p_name"), F.lit(""))).alias("premises"),
        F.coalesce(F.nullif(F.trim(F.when(F.col("p_size") > 25, F.lit(" "))), F.lit("")), F.nullif(F.trim(F.col("p_brand")), F.lit(""))).alias("target"),
        F.nullif(F.size(F.filter(F.split(F.when(F.col("p_partkey") % 5 == 0, F.lit("none")).otherwise(proof), ";"), lambda x: x.contains("->"))), F.lit(0)).cast("long").alias("proof_steps"),
    )
    return rows.groupBy("key").agg(F.min_by(F.struct("p_partkey", "premises", "target", "proof_steps"), "p_partkey").alias("r")).select("key", "r.*")


def answer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose and canonical keys of written answers, and labels (E-02, E-03, E-04, E-09, E-10): groups by key."""
    q = F.col("l_quantity").cast("int")
    forms = [F.format_string("$%d$", q), F.format_string("%d.0", q), F.format_string("\\text{%d}", q), F.format_string(" %d. ", q), F.format_string("{%d}", q), F.format_string("%d\\%%", q)]
    written = F.element_at(F.array(*forms), (F.col("l_partkey") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(written.alias("w"))
    return rows.groupBy(loose_key(F.col("w")).alias("loose"), canonical_key(F.col("w")).alias("canonical")).agg(F.count("*").alias("n"))


def loose_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"[\s{}$\\,]", "")), r"\.+$", "")


def canonical_key(c: Column) -> Column:
    """Spelling for grouping: wrappers and units gone, numbers to eight places (X-23)."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\\(?:text|mathrm)\{([^{}]*)\}", "$1"), r"[\s{}$]|\.+\s*$", "")
    value = F.regexp_replace(plain, r"\\%$", "").try_cast("double")
    return F.coalesce(F.when(value.isNotNull(), F.format_string("%.8f", F.when(plain.endswith("\\%"), value / 100).otherwise(value))), F.lower(plain))


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows of each source in a seeded order (P-04; the feature), and the temperature of each place, evenly spread (P-07)."""
    by = Window.partitionBy("source").orderBy(F.md5(F.concat(F.lit("11|"), F.col("doc_id").cast("string")).cast("binary")), "doc_id")
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.row_number().over(by).alias("place")).where("place <= 10")
    return rows.select("source", "doc_id", F.col("place").cast("long").alias("place"), F.round(F.lit(0.4) + (F.col("place") - 1) * (F.lit(1.0) - F.lit(0.4)) / 9, 2).alias("temperature"))


def best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction of the best scored trace, scores held to 0 to 10; ties by the more common prediction, then by name (P-08)."""
    t = _traces(spark, sf_dir).where("pred is not null").select("sample", "pred", F.least(F.greatest(F.col("tokens") - 20, F.lit(0.0)), F.lit(10.0)).alias("score"))
    per = t.groupBy("sample", "pred").agg(F.max("score").alias("top"))
    tied = t.join(per.groupBy("sample").agg(F.max("top").alias("best")), "sample").where("score = best").groupBy("sample", "pred", "best").agg(F.count("*").alias("c"))
    return tied.groupBy("sample", "best").agg(F.min_by("pred", F.struct(-F.col("c"), "pred")).alias("pred"))


def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples without any prediction are asked again, and the second answers merged (R-03, R-04, R-05): what is still missing after each sweep."""
    t = _traces(spark, sf_dir).groupBy("sample").agg(F.min("l_partkey").alias("k"))
    first = t.select("sample", "k", F.when(F.col("k") % 11 != 0, F.lit(1)).alias("sweep"))
    todo = first.where("sweep is null").select("sample", F.when(F.col("k") % 2 == 0, F.lit(2)).alias("again"))
    merged = first.join(todo, "sample", "left").select("sample", F.coalesce("sweep", "again").alias("sweep"))
    return merged.groupBy("sweep").agg(F.count("*").alias("n"))


def polish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrites accepted or the first reason against them (LLM-09, LLM-10, LLM-11): the same answer, 0.6 to 1.4 times the steps,
    no forbidden markup, at most twice the length; blocked words replaced as whole words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("old"))
    new = F.when(F.col("doc_id") % 5 == 0, F.concat("old", F.lit("\n"), "old", F.lit("\nmore"))).when(F.col("doc_id") % 7 == 0, F.concat(F.lit("## "), "old")).otherwise(F.regexp_replace("old", "(?i)(^|[^a-z])the([^a-z]|$)", "$1a$2"))
    rows = docs.withColumn("new", new)
    steps = lambda c: F.size(F.filter(F.split(F.col(c), "\n"), lambda x: F.trim(x) != ""))
    answer = lambda c: F.try_element_at(F.regexp_extract_all(F.col(c), F.lit("[0-9]+"), F.lit(0)), F.lit(-1))
    reason = F.when(~answer("old").eqNullSafe(answer("new")), "answer").when(~steps("new").between(0.6 * steps("old"), 1.4 * steps("old")), "steps").when(F.col("new").rlike("(?m)^#+ "), "markup").when(F.length("new") > 2 * F.length("old"), "length").otherwise("accepted")
    return rows.groupBy(reason.alias("outcome")).agg(F.count("*").alias("n"))


def conclusion_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later lines of a document that conclude what an earlier one did, by a normalised key of their last clause (D-06, D-07)."""
    line = F.regexp_replace(F.lower("line"), r"^\s+|(?<!\s)\s++\z", "")
    clause = F.regexp_extract(line, r"(?<![^.!?])([^.!?]++)[.!?]?\z", 1)  # each clause is read once
    key = F.trim(F.regexp_replace(F.regexp_replace(clause, r"(?<=^|\s)(?:so|thus|hence|therefore|then|we|have|the|a|an)(?=\s|$)", " "), r"[^\p{L}\p{M}\p{N}]+", " "))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", F.col("pos").cast("long").alias("pos"), key.alias("k")).where("length(k) >= 4")
    rows = rows.select("doc_id", "pos", F.xxhash64("k").alias("h"), F.xxhash64(F.lit(0x5EED), "k").alias("g"))  # 128 bits name a key
    return rows.withColumn("source_pos", F.min("pos").over(Window.partitionBy("doc_id", "h", "g"))).where("source_pos < pos").select("doc_id", "pos", "source_pos")


def alias_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropped entries followed to the one that stays, by doubling the pointers until none moves; entries on a cycle keep their own (D-11)."""
    n = F.col("c_custkey")
    at = table(spark, sf_dir, "customer").select(n.alias("id"), F.when(n % 10 == 0, n).otherwise(n - 1).alias("to"))
    for _ in range(4):  # chains are of at most nine links here: 2 ** 4 of them are followed
        at = at.alias("a").join(at.alias("b"), F.col("a.to") == F.col("b.id"), "left").select("a.id", F.coalesce("b.to", "a.to").alias("to"))
    return at


QUERIES = {f.__name__: f for f in (per_trace_accuracy, math_accuracy, upper_medians, generation_statistics, failure_reasons, trace_pool, update_merge, common_problems, label_pool, positional_pairs, micro_verifier, item_accuracies, run_comparison, paired_tests, export_names, problem_records, answer_keys, seeded_sample, best_of_n, retry_plan, polish_gate, conclusion_keys, alias_chains)}
ORACLES = {
    "per_trace_accuracy": f"WITH {_T}, h AS (SELECT *, CASE WHEN pred = truth THEN 1.0 ELSE 0.0 END AS hit FROM t), p AS (SELECT dataset, sample, avg(hit) AS rate, count(*) AS n, sum(tokens) AS tokens FROM h GROUP BY ALL), a AS (SELECT dataset, round(avg(rate), 6) AS by_sample, round(stddev_pop(rate), 6) AS by_sample_std, round(avg(n), 2) AS steps, round(stddev_pop(n), 2) AS steps_std, round(avg(tokens), 1) AS tokens, round(stddev_pop(tokens), 1) AS tokens_std FROM p GROUP BY 1), b AS (SELECT dataset, round(avg(hit), 6) AS by_trace, round(stddev_pop(hit), 6) AS by_trace_std FROM h GROUP BY 1) SELECT a.*, by_trace, by_trace_std FROM a JOIN b USING (dataset)",
    "math_accuracy": "SELECT l_suppkey % 5 AS dataset, count(*) AS n, round(count(*) FILTER (l_partkey % 13 <> 0 AND (l_partkey % 3 = 1 OR l_quantity::INT = 0)) / count(*), 4) AS accuracy, round(count(*) FILTER (l_partkey % 13 <> 0 AND (l_partkey % 3 = 1 OR l_quantity::INT = 0)) / count(*) FILTER (l_partkey % 13 <> 0), 4) AS precision_answered FROM lineitem GROUP BY 1",
    "upper_medians": f"WITH {_T}, p AS (SELECT dataset, sample, count(*) AS n FROM t GROUP BY ALL) SELECT dataset, list_sort(list(n))[count(*) // 2 + 1] AS median_steps FROM p GROUP BY dataset",
    "generation_statistics": f"WITH {_T}, p AS (SELECT dataset, sample, count(*) AS n, count(pred) AS ok, max(truth) AS truth FROM t GROUP BY ALL), k AS (SELECT dataset, array_to_string(list_sort(list(DISTINCT round(0.5 + (l_partkey % 5) * 0.1, 2)::DOUBLE)), ',') AS temperatures FROM t GROUP BY 1) SELECT p.dataset, count(*) AS samples, sum(n)::BIGINT AS traces, round(sum(ok) / sum(n), 4) AS success_rate, round(avg(n), 2) AS per_sample, avg((truth = 'O')::INT) > 0.5 AS mostly_open, any_value(temperatures) AS temperatures FROM p JOIN k ON k.dataset = p.dataset GROUP BY p.dataset",
    "failure_reasons": "SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1",
    "trace_pool": "WITH t AS (SELECT l_orderkey AS sample, l_linenumber AS trace, min(l_partkey) AS k, max(l_quantity::DOUBLE) AS tokens FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2), p AS (SELECT *, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 3 = 0 THEN 'O' ELSE 'F' END AS pred FROM t), v AS (SELECT sample, pred, min(trace) AS f, count(*) AS c FROM p WHERE pred IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY sample ORDER BY c DESC, f) = 1), l AS (SELECT sample, trace FROM p QUALIFY row_number() OVER (PARTITION BY sample ORDER BY tokens DESC, trace) = 1) SELECT l.sample, v.pred AS vote, coalesce(v.f, l.trace)::BIGINT AS trace FROM l LEFT JOIN v ON v.sample = l.sample",
    "update_merge": "WITH n AS (SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT c_custkey, CASE WHEN n.user_id IS NULL THEN 'none' ELSE event_type END AS event_type, CASE WHEN n.user_id IS NULL THEN 0 ELSE round(value, 6) END AS value, n.user_id IS NOT NULL AS updated FROM customer LEFT JOIN n ON user_id = c_custkey",
    "common_problems": "WITH d AS (SELECT d.doc_id, (n_chars > 500)::INT AS a, (n_chars > 900)::INT AS b, quality, d.doc_id % 3 <> 0 AS f, d.doc_id % 4 <> 0 AS g FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND quality IS NOT NULL) SELECT count(*) FILTER (f AND g) AS n, count(*) FILTER (g AND NOT f) AS only_base, count(*) FILTER (f AND NOT g) AS only_full, round((avg((a = quality)::INT) FILTER (f AND g) - avg((b = quality)::INT) FILTER (f AND g)) * 100, 1) AS delta FROM d",
    "label_pool": "WITH r AS (SELECT t.doc_id, (SELECT min(p.doc_id) FROM documents p WHERE p.doc_id % 2 = 0 AND coalesce(p.text, '') = coalesce(t.text, '')) AS x, (SELECT max(p.doc_id) FROM documents p WHERE p.doc_id % 2 = 0 AND p.doc_id % 3 <> 0 AND p.doc_id = t.doc_id - 1) AS y FROM documents t WHERE t.doc_id % 2 = 1) SELECT r.doc_id, coalesce(x, y) AS match, CASE WHEN x IS NOT NULL THEN 'text' WHEN y IS NOT NULL THEN 'place' ELSE 'none' END AS how, (SELECT max(toxic) FROM labels l WHERE l.doc_id = coalesce(x, y)) AS toxic FROM r",
    "positional_pairs": "WITH a AS (SELECT user_id, list(value ORDER BY ts, event_id) FILTER (event_type = 'click') AS a, list(value ORDER BY ts, event_id) FILTER (event_type = 'view') AS b FROM events GROUP BY 1), p AS (SELECT user_id, unnest(list_zip(a[1 : least(len(a), len(b))], b[1 : least(len(a), len(b))])) AS z FROM a) SELECT user_id, count(*) AS n, round(avg(z[1] - z[2]), 6) AS diff FROM p WHERE z[1] IS NOT NULL AND z[2] IS NOT NULL GROUP BY 1",
    "micro_verifier": f"WITH {_S}, c AS (SELECT kind, sum((ok AND says)::INT) AS tp, sum((NOT ok AND says)::INT) AS fp, sum((NOT ok AND NOT says)::INT) AS tn, sum((ok AND NOT says)::INT) AS fn FROM (SELECT kind, ok, says FROM s UNION ALL SELECT 'total', ok, says FROM s) GROUP BY 1) SELECT kind, tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, CASE WHEN tp > 0 THEN round(2 * tp / (2 * tp + fp + fn), 4) ELSE -1 END AS f1, CASE WHEN tn > 0 THEN round(2 * tn / (2 * tn + fp + fn), 4) ELSE -1 END AS negative_f1 FROM c",
    "item_accuracies": f"WITH {_S}, f AS (SELECT *, min(CASE WHEN NOT ok THEN step END) OVER (PARTITION BY idx) AS first FROM s) SELECT idx, coalesce(round(avg((ok = says)::INT) FILTER (ok), 4), -1) AS correct_acc, coalesce(round(avg((ok = says)::INT) FILTER (NOT ok), 4), -1) AS wrong_acc, round(avg((ok = says)::INT), 4) AS total_acc, coalesce(round(avg((ok = says)::INT) FILTER (NOT ok AND step = first), 4), -1) AS first_error_acc FROM f GROUP BY idx",
    "run_comparison": f'WITH {_S} SELECT kind, round(avg((ok = says)::INT) FILTER (idx % 3 = 0), 4) AS "with", round(avg((ok = says)::INT) FILTER (idx % 3 <> 0), 4) AS wout FROM s GROUP BY kind',
    "export_names": r"""WITH n AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9._-]+', '-', 'g'), '-.') AS slug, lower(substr(p_brand, 1, 7)) AS d FROM part) SELECT p_partkey, slug, slug AS model, CASE WHEN p_partkey % 2 = 0 THEN 'with_answer' ELSE 'wout_answer' END AS setting, CASE d WHEN 'brand#1' THEN 'first' WHEN 'brand#2' THEN 'second' WHEN 'brand#3' THEN 'third' ELSE d END AS dataset FROM n""",
    "problem_records": "WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 AND p_type IS NOT NULL THEN p_type ELSE p_brand END AS key, 'if ' || trim(p_name) AS premises, trim(p_brand) AS target, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS proof_steps FROM part) SELECT key, p_partkey, premises, target, proof_steps FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY p_partkey) = 1",
    "seeded_sample": "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('11|' || doc_id), doc_id) AS place FROM documents) SELECT source, doc_id, place, round(0.4 + (place - 1) * 0.6 / 9, 2)::DOUBLE AS temperature FROM r WHERE place <= 10",
    "best_of_n": f"WITH {_T}, s AS (SELECT sample, pred, least(greatest(tokens - 20, 0), 10)::DOUBLE AS score FROM t WHERE pred IS NOT NULL), b AS (SELECT *, max(score) OVER (PARTITION BY sample) AS best FROM s), c AS (SELECT sample, best, pred, count(*) AS c FROM b WHERE score = best GROUP BY ALL) SELECT sample, best, pred FROM c QUALIFY row_number() OVER (PARTITION BY sample ORDER BY c DESC, pred) = 1",
    "retry_plan": f"WITH {_T} SELECT CASE WHEN k % 11 <> 0 THEN 1 WHEN k % 2 = 0 THEN 2 END AS sweep, count(*) AS n FROM (SELECT sample, min(l_partkey) AS k FROM t GROUP BY sample) GROUP BY 1",
    "conclusion_keys": r"""WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
 k AS (SELECT doc_id, pos, array_to_string(list_filter(regexp_extract_all(array_to_string(list_filter(regexp_split_to_array(regexp_extract(regexp_replace(lower(line), '^[\s\x0B]+|[\s\x0B]+$', '', 'g'), '([^.!?]+)[.!?]?$', 1), '[\s\x0B]+'), lambda w: w NOT IN ('so', 'thus', 'hence', 'therefore', 'then', 'we', 'have', 'the', 'a', 'an')), ' '), '[\p{L}\p{M}\p{N}]+'), lambda x: x <> ''), ' ') AS k FROM l),
 f AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, k) AS source_pos FROM k WHERE length(k) >= 4) SELECT doc_id, pos::BIGINT AS pos, source_pos::BIGINT AS source_pos FROM f WHERE source_pos < pos""",
    "answer_keys": "WITH r AS (SELECT l_quantity::INT AS q, l_partkey % 6 AS f FROM lineitem) SELECT CASE f WHEN 1 THEN q || '.0' WHEN 2 THEN 'text' || q WHEN 5 THEN q || '%' ELSE q::VARCHAR END AS loose, printf('%.8f', CASE WHEN f = 5 THEN q / 100 ELSE q END::DOUBLE) AS canonical, count(*) AS n FROM r GROUP BY 1, 2",
    "polish_gate": r"""WITH r AS (SELECT doc_id, coalesce(text, '') AS old, CASE WHEN doc_id % 5 = 0 THEN concat(coalesce(text, ''), chr(10), coalesce(text, ''), chr(10), 'more') WHEN doc_id % 7 = 0 THEN concat('## ', coalesce(text, '')) ELSE regexp_replace(coalesce(text, ''), '(?i)(^|[^a-z])the([^a-z]|$)', '\1a\2', 'g') END AS new FROM documents),
 m AS (SELECT *, list_last(regexp_extract_all(old, '[0-9]+')) AS a, list_last(regexp_extract_all(new, '[0-9]+')) AS b, len(list_filter(string_split(old, chr(10)), lambda x: trim(x) <> '')) AS s, len(list_filter(string_split(new, chr(10)), lambda x: trim(x) <> '')) AS t FROM r)
 SELECT CASE WHEN a IS DISTINCT FROM b THEN 'answer' WHEN t < 0.6 * s OR t > 1.4 * s THEN 'steps' WHEN regexp_matches(new, '(?m)^#+ ') THEN 'markup' WHEN length(new) > 2 * length(old) THEN 'length' ELSE 'accepted' END AS outcome, count(*) AS n FROM m GROUP BY 1""",
    "alias_chains": "SELECT c_custkey AS id, CASE WHEN c_custkey < 10 THEN 0 ELSE c_custkey - c_custkey % 10 END AS \"to\" FROM customer",
}
