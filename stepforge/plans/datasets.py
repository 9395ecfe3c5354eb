"""Records of several datasets in one form, readers by domain, exports, score tables, loads by file and ablation tables.

Raw records are made of ``part`` and ``lineitem``; oracles are built from the tables' values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepforge.functions import text
from stepforge.plans.steps import strip
from stepforge.sources.tables import table

LOGICAL, MATH = ("FLD", "ProofWriter"), ("OlympiadBench", "OmniMATH")
#: Fixed value: what stands before a reference solution.
MARKER = "IGNORE THIS. Ground truth here for reference. "


def blank(c: Column) -> Column:
    """Null and blank are both no text."""
    return F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))


def proof_steps(c: Column) -> Column:
    """The number of implications of a proof, null without one (S-17)."""
    return F.nullif(F.size(F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: x.contains("->"))), F.lit(0)).cast("long")


def adapt(raw: DataFrame, name: str = "dataset") -> DataFrame:
    """Problems of raw records (S-16): premises, hypothesis, answer, steps of the reference, dataset and domain are appended.

    Columns that a file lacks are null.  The dataset's name decides; without a known one the record's own keys do: a conclusion
    beside facts is logical, an answer beside an input mathematical, anything else is read from what there is."""
    have = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    known = F.when(have(name).isin(*LOGICAL, *MATH), have(name))
    shape = F.when(have("Conclusion").isNotNull() & have("Facts").isNotNull(), "logical").when(have("answer").isNotNull() & have("input").isNotNull(), "math")
    kind = F.when(known.isin(*LOGICAL), "logical").when(known.isin(*MATH), "math").otherwise(shape)
    told, claim = F.coalesce(blank(have("Facts")), blank(have("input")), F.lit("")), F.coalesce(blank(have("Conclusion")), F.lit(""))
    asked, said = F.coalesce(blank(have("input")), F.lit("")), F.coalesce(blank(have("answer")), F.lit(""))
    label, depth, proof = F.coalesce(blank(have("proof_label")), F.lit("")), have("QDep").try_cast("long"), proof_steps(have("proofs"))
    by = lambda logical, math, other: F.when(kind == "logical", logical).when(kind == "math", math).otherwise(other)
    none = F.lit(None).cast("long")
    steps = F.when(known == "FLD", proof).when(known == "ProofWriter", depth).otherwise(F.coalesce(proof, depth))
    return raw.select(
        "*",
        by(told, asked, asked).alias("premises"),
        by(claim, said, F.coalesce(F.nullif(claim, F.lit("")), said)).alias("hypothesis"),
        by(label, said, F.coalesce(F.nullif(label, F.lit("")), said)).alias("target"),
        by(steps, none, none).alias("reference_steps"),
        F.coalesce(known, F.lit("")).alias("adapter"),
        F.coalesce(kind, F.lit("")).alias("domain"),
    )


def adapted_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 6
    only = lambda c, *ks: F.when(k.isin(*ks), c)
    raw = p.select(
        "p_partkey", F.element_at(F.array(*map(F.lit, ("FLD", "ProofWriter", "OlympiadBench", "OmniMATH", "other", ""))), (k + 1).cast("int")).alias("dataset"),
        only(F.col("p_name"), 0, 1, 4).alias("Facts"), only(F.concat(F.lit(" "), "p_type"), 2, 3, 5).alias("input"), only(F.col("p_brand"), 0, 1, 4).alias("Conclusion"),
        only(F.lit("__PROVED__"), 0, 1, 4).alias("proof_label"), only(F.col("p_size").cast("string"), 2, 3).alias("answer"), only(F.lit("a -> b; b -> c; fact"), 0).alias("proofs"), only(F.col("p_size").cast("string"), 1, 4).alias("QDep"),
    )
    return adapt(raw).select("p_partkey", "premises", "hypothesis", "target", "reference_steps", "adapter", "domain")


def reference_answer(c: Column) -> Column:
    """The answer of a reference solution: what follows the marker, its last line, without 'A:' (S-20)."""
    body = F.trim(F.element_at(F.split(F.coalesce(c, F.lit("")), F.lit(MARKER.replace(".", r"\."))), -1))
    return F.trim(F.regexp_replace(F.regexp_extract(body, r"([^\n]*)$", 1), r"^\s*A:", ""))


def premises(context: Column) -> Column:
    """The texts of a context's triples, trimmed, blank ones left out; in the order of their names (S-21)."""
    triples = F.from_json(context, "struct<triples: map<string, string>>")["triples"]
    texts = F.transform(F.array_sort(F.map_entries(triples)), lambda e: F.trim(e["value"]))
    return F.coalesce(F.filter(texts, lambda x: x != ""), F.array().cast("array<string>"))


def unified_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of verification sets in one form (S-19 to S-21): id, premise, hypothesis, the reference answer, explanations of those
    sets that have them, and the number of premises of a context."""
    k = F.col("p_partkey") % 3
    p = table(spark, sf_dir, "part").withColumn("set", F.element_at(F.array(*map(F.lit, ("esnli", "gsm8k", "drop"))), (k + 1).cast("int")))
    key = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("k"), "p_partkey"))
    hypothesis = F.when(k == 1, F.concat(F.lit(MARKER), "p_name", F.lit("\nA: "), "p_size", F.lit("\n"))).otherwise(F.col("p_name"))
    context = F.concat(F.lit('{"triples": {"sent2": " '), "p_type", F.lit(' ", "sent1": "'), "p_brand", F.lit('", "sent3": "'), F.when(F.col("p_size") % 2 == 0, " ").otherwise("x"), F.lit('"}}'))
    at = F.row_number().over(Window.partitionBy("set").orderBy("p_partkey")) - 1
    explained = F.when(k == 0, F.array(F.col("p_brand"), F.lit(""), F.col("p_type")))
    return p.select("p_partkey", F.coalesce(key, F.concat_ws("_", "set", at)).alias("id"), "set", reference_answer(hypothesis).alias("answer"), F.array_join(explained, "|").alias("explanations"), F.array_join(premises(context), "|").alias("premises"))


def predicted(c: Column, domain: Column) -> Column:
    """The answer read by the domain's own reader (X-19)."""
    return F.when(domain == "math", text.final_answer(c)).otherwise(text.verdict(c))


def response_step(c: Column, n: Column) -> Column:
    """The text of step n of a reply, up to the next header; a reply without headers is step 1; null if it isn't there (X-29)."""
    c = F.coalesce(c, F.lit(""))
    pattern = F.concat(F.lit(r"(?is)Step\s+"), n.cast("string"), F.lit(r"\s*[:.]\s*(.+?)(?=\n\s*Step\s+\d+\s*[:.]|\z)"))
    own = F.regexp_extract_all(c, pattern, F.lit(1))
    return F.when(F.size(own) > 0, strip(F.get(own, 0))).when((n == 1) & ~c.rlike(r"(?i)Step\s+\d+\s*[:.]"), strip(c))


def response_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step texts of replies, and the answers of replies by domain (X-19, X-29)."""
    n = F.col("l_linenumber")
    body = F.when(n % 3 == 0, F.concat(F.lit("only "), "l_quantity", F.lit(" \n"))).otherwise(F.concat(F.lit("Intro\nStep 1: first\n Step 2. two "), F.col("l_partkey"), F.lit("\nmore\nstep 10: \\boxed{"), "l_suppkey", F.lit("} __PROVED__")))
    which = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(10), F.lit(7)), (F.col("l_partkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", response_step(body, which).alias("step"), predicted(body, F.when(F.col("l_returnflag") == "A", "math").otherwise("logical")).alias("answer"))
    return rows.groupBy("l_returnflag", F.length("step").cast("long").alias("n_chars"), F.length("answer").cast("long").alias("n_answer")).agg(F.count("*").alias("n"))


def inferred_dataset(sample_id: Column) -> Column:
    """The dataset an id names (A-13)."""
    return F.when(sample_id.rlike("FLD|[Dd]ataset1"), "FLD").when(sample_id.rlike("ProofWriter|[Dd]ataset2"), "ProofWriter").otherwise("unknown")


def inferred_domain(domain: Column, target: Column) -> Column:
    """The domain a row states; else math if its target isn't a verdict (A-13)."""
    return F.when((domain == "math") | (F.coalesce(target, F.lit("")) != "") & ~target.startswith("__"), "math").otherwise("logical")


def scored_rows(kind: str, df: DataFrame) -> DataFrame:
    """(sample_id, dataset, domain, truth, predicted, correct) of a run's rows (A-14): predictions are always read from the text
    again.  ``kind`` names the text: 'synthesized' has one, 'k_traces' and 'cleaned' a list of traces, one row each."""
    body = F.col("text") if kind == "synthesized" else F.explode("traces")
    rows = df.select("sample_id", "domain", "target", body.alias("text"))
    rows = rows.select("sample_id", inferred_dataset(F.col("sample_id")).alias("dataset"), inferred_domain(F.col("domain"), F.col("target")).alias("domain"), F.col("target"), "text")
    truth = F.when(F.col("domain") == "math", F.trim("target")).otherwise(text.normal_label(F.col("target")))
    rows = rows.select("sample_id", "dataset", "domain", truth.alias("truth"), predicted(F.col("text"), F.col("domain")).alias("predicted"))
    return rows.withColumn("correct", F.coalesce(F.col("truth") == F.col("predicted"), F.lit(False)))


def run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of two kinds of runs by dataset and domain (A-13, A-14)."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    name = F.concat(F.element_at(F.array(*map(F.lit, ("FLD_", "x_dataset2_", "Dataset1_", "gsm_"))), (k + 1).cast("int")), "p_partkey")
    target = F.when(k == 3, F.col("p_size").cast("string")).otherwise(F.when(F.col("p_size") % 2 == 0, "__PROVED__").otherwise("__DISPROVED__"))
    said = lambda n: F.when(k == 3, F.concat(F.lit("so \\boxed{"), F.col("p_size") + F.col("p_partkey") % n, F.lit("}"))).otherwise(F.when(F.col("p_partkey") % n == 0, "__PROVED__").otherwise("Conclusion: disproved"))
    runs = p.select(name.alias("sample_id"), F.when(F.col("p_partkey") % 5 == 0, F.when(k == 3, "math").otherwise("logical")).alias("domain"), target.alias("target"), said(3).alias("text"), F.array(said(2), said(5)).alias("traces"))
    scored = scored_rows("synthesized", runs).withColumn("kind", F.lit("synthesized")).unionByName(scored_rows("k_traces", runs).withColumn("kind", F.lit("k_traces")))
    return scored.groupBy("kind", "dataset", "domain").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))


def score_summary(scores: DataFrame, group: str) -> DataFrame:
    """Per group, the number of traces and each metric's mean without missing ones (A-17), as a map from metrics to means; a metric that is never there is null.
    ``scores`` is in long form: id, metric, value."""
    means = scores.groupBy(group, "metric").agg(F.round(F.avg("value"), 4).alias("mean"))
    n = scores.groupBy(group).agg(F.count_distinct("id").alias("n_traces"))
    return means.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "mean")))).alias("metrics")).join(n, group)  # a few metrics a group


def metric_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of scores by event type (A-16, A-17); whole values above 400 stand for N/A."""
    e = table(spark, sf_dir, "events")
    metric = F.concat(F.lit("m"), F.col("event_id") % 3)
    scores = e.select("event_type", F.col("user_id").alias("id"), metric.alias("metric"), F.when((F.col("value") <= 400) & (F.col("event_id") % 3 < 2), F.floor("value")).alias("value"))
    out = score_summary(scores, "event_type")
    return out.select("event_type", "n_traces", F.array_join(F.transform(F.map_entries("metrics"), lambda x: F.concat(x["key"], F.lit("="), F.when(x["value"].isNull(), "N/A").otherwise(F.format_string("%.4f", x["value"])))), " ").alias("metrics"))


def ablation_table(rows: DataFrame, full: str, variants: Sequence[str]) -> DataFrame:
    """One row a variant, in the order given, whether it was run, its accuracy and its change against the full run over the samples
    both have (A-18, A-19, R-06); absent variants are reported, not left out.  ``rows``: variant, sample_id, correct."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(i, v) for i, v in enumerate([full, *variants])], "place int, variant string")  # the report's rows
    base = rows.where(F.col("variant") == full).select("sample_id", F.col("correct").alias("base"))
    both = rows.join(base, "sample_id", "left").groupBy("variant").agg(
        F.count("*").alias("n"), F.round(100 * F.avg(F.col("correct").cast("int")), 1).alias("accuracy"),
        F.round(100 * F.avg(F.when(F.col("base").isNotNull(), F.col("correct").cast("int") - F.col("base").cast("int"))), 2).alias("change"), F.count("base").alias("n_paired"),
    )
    return names.join(both, "variant", "left").select("place", "variant", F.col("n").isNotNull().alias("present"), F.coalesce("n", F.lit(0)).alias("n"), "accuracy", "change", F.coalesce("n_paired", F.lit(0)).alias("n_paired"))


def ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.max("l_quantity").alias("q"))
    rows = lines.select(F.col("l_returnflag").alias("variant"), F.col("l_orderkey").alias("sample_id"), ((F.col("q") + F.col("l_orderkey")) % 3 > 0).alias("correct"))
    return ablation_table(rows, "N", ["A", "R", "X"])


def balanced_load(df: DataFrame, file: str, label: str, domain: str, order: Sequence[str], per_class: int) -> DataFrame:
    """Of each file, every mathematical row and per_class rows of each label in the given order (P-05); rows without a label or answer go."""
    rank = F.row_number().over(Window.partitionBy(file, domain, label).orderBy(*order))
    return df.where(F.col(label).isNotNull()).withColumn("place", rank.cast("long")).where((F.col(domain) == "math") | (F.col("place") <= per_class))


def raw_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balanced load by files (P-05), in an order set by a seed."""
    label = F.when(F.col("p_size") % 9 == 0, F.lit(None)).when(F.col("p_size") % 2 == 0, "__PROVED__").otherwise("__DISPROVED__")
    domain = F.when(F.col("p_brand") == "Brand#1", "math").otherwise("logical")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("file"), label.alias("label"), domain.alias("domain"), F.md5(F.concat(F.lit("42-"), "p_partkey").cast("binary")).alias("draw"))
    return balanced_load(rows, "file", "label", "domain", ["draw", "p_partkey"], 5).select("p_partkey", "file", "label", "place")


def sweep(pending: Callable[[], DataFrame], ask: Callable[[DataFrame, int], None], concurrency: int, rounds: int = 10) -> tuple[int, int]:
    """Asks again for what has no answer yet, with half the concurrency each time, until nothing is left or a round recovers
    nothing (R-05).  ``pending`` reads what is left from the run's own output, so a stopped sweep goes on.  Returns (rows left, rounds)."""
    left = pending().count()
    for done in range(rounds):
        if not left:
            return 0, done
        ask(pending(), concurrency)
        now = pending().count()
        if now == left:
            return left, done + 1
        left, concurrency = now, max(1, concurrency // 2)
    return left, rounds


def reported_traces(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of a report over all its cells (model, setting, dataset), blank traces left out (S-09); fails if a cell has no rows."""
    keys = ["model", "setting", "source_dataset"]
    missing = cells.join(rows.select(*keys).distinct(), keys, "left_anti").limit(5).collect()  # five names for the message
    if missing:
        raise FileNotFoundError("no rows for " + ", ".join("/".join(r) for r in missing))
    return rows.join(F.broadcast(cells.select(*keys).distinct()), keys, "left_semi").where(F.trim(F.coalesce("trace", F.lit(""))) != "")  # the report's cells


QUERIES = {f.__name__: f for f in (adapted_problems, unified_items, response_steps, run_scores, metric_summaries, ablations, raw_problems)}
ORACLES = {
    "adapted_problems": """SELECT p_partkey, CASE k WHEN 5 THEN p_type WHEN 2 THEN p_type WHEN 3 THEN p_type ELSE p_name END AS premises, CASE WHEN k IN (0, 1, 4) THEN p_brand WHEN k = 5 THEN '' ELSE p_size::VARCHAR END AS hypothesis,
  CASE WHEN k IN (0, 1, 4) THEN '__PROVED__' WHEN k = 5 THEN '' ELSE p_size::VARCHAR END AS target, CASE WHEN k = 0 THEN 2 WHEN k IN (1, 4) THEN p_size END::BIGINT AS reference_steps, ['FLD', 'ProofWriter', 'OlympiadBench', 'OmniMATH', '', ''][k + 1] AS adapter,
  CASE WHEN k IN (0, 1, 4) THEN 'logical' WHEN k = 5 THEN '' ELSE 'math' END AS domain FROM (SELECT *, p_partkey % 6 AS k FROM part)""",
    "unified_items": """WITH r AS (SELECT *, ['esnli', 'gsm8k', 'drop'][p_partkey % 3 + 1] AS set, row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey) - 1 AS i FROM part)
 SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('k', p_partkey) ELSE concat(set, '_', i) END AS id, set, CASE WHEN set = 'gsm8k' THEN p_size::VARCHAR ELSE p_name END AS answer, CASE WHEN set = 'esnli' THEN concat(p_brand, '||', p_type) END AS explanations,
  concat(p_brand, '|', p_type, CASE WHEN p_size % 2 = 1 THEN '|x' ELSE '' END) AS premises FROM r""",
    "response_steps": """SELECT l_returnflag, n_chars, n_answer, count(*) AS n FROM (SELECT l_returnflag, CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN l_partkey % 4 = 0 THEN length(concat('only ', l_quantity)) END
  ELSE CASE l_partkey % 4 WHEN 0 THEN 5 WHEN 1 THEN length(concat('two ', l_partkey, chr(10), 'more')) WHEN 2 THEN length(concat('\\boxed{', l_suppkey, '} __PROVED__')) END END::BIGINT AS n_chars,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_returnflag = 'A' THEN length(l_suppkey::VARCHAR) ELSE 10 END::BIGINT AS n_answer FROM lineitem) GROUP BY ALL""",
    "run_scores": """WITH r AS (SELECT p_partkey AS k, p_partkey % 4 AS m, p_size, unnest([3, 2, 5]) AS n FROM part), s AS (SELECT CASE WHEN n = 3 THEN 'synthesized' ELSE 'k_traces' END AS kind, ['FLD', 'ProofWriter', 'FLD', 'unknown'][m + 1] AS dataset, CASE WHEN m = 3 THEN 'math' ELSE 'logical' END AS domain,
  CASE WHEN m = 3 THEN k % n = 0 ELSE (k % n = 0) = (p_size % 2 = 0) END AS correct FROM r) SELECT kind, dataset, domain, count(*) AS n, count(*) FILTER (correct) AS n_correct FROM s GROUP BY ALL""",
    "metric_summaries": """WITH m AS (SELECT event_type, 'm' || event_id % 3 AS metric, round(avg(CASE WHEN value <= 400 AND event_id % 3 < 2 THEN floor(value) END), 4) AS v FROM events GROUP BY 1, 2)
 SELECT event_type, n_traces, metrics FROM (SELECT event_type, string_agg(concat(metric, '=', coalesce(printf('%.4f', v), 'N/A')), ' ' ORDER BY metric) AS metrics FROM m GROUP BY 1) JOIN (SELECT event_type, count(DISTINCT user_id) AS n_traces FROM events GROUP BY 1) USING (event_type)""",
    "ablations": """WITH r AS (SELECT l_orderkey AS s, l_returnflag AS v, (max(l_quantity) + l_orderkey) % 3 > 0 AS ok FROM lineitem GROUP BY 1, 2), g AS (SELECT r.v, count(*) AS n, round(100.0 * count(*) FILTER (r.ok) / count(*), 1) AS accuracy, round(100 * avg(r.ok::INT - b.ok::INT), 2) AS change, count(b.s) AS n_paired FROM r LEFT JOIN r b ON b.s = r.s AND b.v = 'N' GROUP BY 1)
 SELECT place, variant, n IS NOT NULL AS present, coalesce(n, 0) AS n, accuracy, change, coalesce(n_paired, 0) AS n_paired FROM (VALUES (0, 'N'), (1, 'A'), (2, 'R'), (3, 'X')) t(place, variant) LEFT JOIN g ON g.v = variant""",
    "raw_problems": """WITH r AS (SELECT p_partkey, p_brand AS file, CASE WHEN p_size % 2 = 0 THEN '__PROVED__' ELSE '__DISPROVED__' END AS label FROM part WHERE p_size % 9 <> 0), o AS (SELECT *, row_number() OVER (PARTITION BY file, label ORDER BY md5('42-' || p_partkey), p_partkey) AS place FROM r)
 SELECT * FROM o WHERE file = 'Brand#1' OR place <= 5""",
}
