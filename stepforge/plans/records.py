"""Records read from prose and files: answers, facts, givens and score arrays; repeated displays; export and merge of shards.

Every query has an oracle written by itself in another shape of SQL, but for those that write files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepforge.plans.steps import _CITED, cited_steps, graph_edges, strip, text_lines
from stepforge.sources.tables import table

BOX = r"\\boxed\{([^{}]*)\}"


def final_answer(steps: Column) -> Column:
    """The answer of a list of steps: the last box of the last step, else of all; else what follows 'answer is' (60 characters at most); else the last step (X-22)."""
    boxes = lambda c: F.try_element_at(F.regexp_extract_all(c, F.lit(BOX), F.lit(1)), F.lit(-1))
    last, every = F.try_element_at(steps, F.lit(-1)), F.array_join(steps, "\n")
    said = F.try_element_at(F.regexp_extract_all(every, F.lit(r"(?i)answer is:?\s*([^.\n]{1,60})"), F.lit(1)), F.lit(-1))
    return F.coalesce(boxes(last), boxes(every), F.trim(said), last)


def process_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final answers of processes that say them in different ways (X-22, X-15)."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey").cast("string")
    ways = [F.concat(F.lit("so \\boxed{"), n, F.lit("} and \\boxed{x}")), F.concat(F.lit("The answer is: "), n, F.lit(" . Done")), F.concat(F.lit("we get "), n)]
    last = F.element_at(F.array(*ways), (F.col("p_partkey") % 3 + 1).cast("int"))
    first = F.when(F.col("p_partkey") % 6 == 2, F.lit("early \\boxed{7}")).otherwise("p_name")
    return p.select("p_partkey", final_answer(F.array(first, last)).alias("answer"))


def facts(c: Column) -> Column:
    """array of (n, text): each 'Fact N:' up to the next one; the tail ends at the hypothesis, question or conclusion (X-24)."""
    body = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)(?:Hypothesis|Question|Conclusion)\s*:.*$", "")
    parts = F.slice(F.split(body, r"Fact\s*(?=\d+\s*:)"), 2, 1_000_000)
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("long").alias("n"), strip(F.regexp_replace(x, r"^\d+\s*:", "")).alias("text")))


def stated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of problems, and the first text of each number over a problem's traces (X-24, X-26)."""
    p = table(spark, sf_dir, "part")
    body = F.concat(F.lit("Fact 1: "), "p_name", F.lit(" is big. Fact 2: a "), "p_type", F.lit(" holds.\nFact "), F.col("p_partkey") % 2 + 1, F.lit(": again "), "p_brand", F.lit("\nHypothesis: all Fact 9: no"))
    rows = p.select((F.col("p_partkey") % 50).alias("problem"), F.col("p_partkey").alias("trace"), F.posexplode(facts(body)).alias("pos", "f"))
    first = rows.groupBy("problem", F.col("f.n").alias("n")).agg(F.min_by("f.text", F.struct("trace", "pos")).alias("text"), F.count("*").alias("mentions"))
    return first


def givens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that give something, numbered; a text without one is a problem node of its first 300 characters (X-25)."""
    own = F.filter(text_lines(F.col("text")), lambda x: x.rlike(r"(?i)^(?:given|let|assume|suppose|the|in)(?:\s|$)"))
    listed = F.when(F.size(own) > 0, own).otherwise(F.array(F.substring(F.coalesce("text", F.lit("")), 1, 300)))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.size(own) > 0).alias("stated"), F.posexplode(listed).alias("i", "g"))
    return rows.select("doc_id", F.when(F.col("stated"), F.concat(F.lit("Given"), F.col("i") + 1)).otherwise("Problem").alias("node"), F.md5(F.col("g").cast("binary")).alias("text_md5"))


def score_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores read from replies (X-27, X-28): an object among prose, whose array must hold one number a step; else numbers found by name; else null."""
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.round(F.col("l_discount").cast("double") * 10, 1))).alias("s"), F.count("*").alias("n"))
    numbers = F.array_join(F.transform("s", lambda x: x.cast("string")), ", ")
    reply = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("Here it is: {\"validity\": ["), numbers, F.lit("]} as asked"))).when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit("validity = ["), numbers, F.lit(", 9]"))).otherwise(F.lit("no scores"))
    rows = o.select("l_orderkey", "n", reply.alias("reply"))
    parsed = F.from_json(F.regexp_extract("reply", r"(\{[^{}]*\})", 1), "validity array<double>")["validity"]
    named = F.transform(F.regexp_extract_all(F.regexp_extract("reply", r"validity\s*=\s*\[([^\]]*)\]", 1), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    fits = lambda c: F.when(F.size(c) == F.col("n"), c)
    got = F.coalesce(fits(parsed), fits(F.slice(named, 1, F.col("n").cast("int"))))
    return rows.select("l_orderkey", F.round(F.aggregate(got, F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size(got).cast("long").alias("n_scores"))


def repeated_displays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displayed formulas of a trace that stood in it before, but for blanks; answers stay (D-01, D-13)."""
    lines = table(spark, sf_dir, "lineitem")
    display = F.when(F.col("l_linenumber") % 5 == 0, F.concat(F.lit("$$\\boxed{"), F.col("l_quantity").cast("int"), F.lit("}$$"))).otherwise(F.concat(F.lit("$$ x = "), (F.col("l_quantity").cast("int") % 4), F.when(F.col("l_linenumber") % 2 == 0, "  + 1 $$").otherwise(" + 1$$")))
    rows = lines.select("l_orderkey", "l_linenumber", display.alias("d"))
    key = F.regexp_replace("d", r"\s+", "")
    first = rows.where(~F.col("d").contains("\\boxed")).groupBy("l_orderkey", key.alias("k")).agg(F.count("*").alias("n"))
    return first.groupBy("l_orderkey").agg(F.sum(F.col("n") - 1).alias("n_dropped"), F.count("*").alias("n_kept"))


def guarded_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers by their score against the group's mean, unless the scores hardly spread (N-06): nothing goes where the deviation is under 0.05."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.when(F.col("event_type") == "view", F.lit(0.5) + F.col("value") / 1e6).otherwise(F.col("value")).alias("x"))
    spread = e.groupBy("event_type").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = F.when(F.col("s") >= 0.05, F.round((F.col("x") - F.col("m")) / F.col("s"), 6) < -1).otherwise(False)
    return e.join(F.broadcast(spread), "event_type").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(z.cast("int")).alias("n_dropped"))  # one row an event type


def restored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of renamed nodes under their old names; samples in which two nodes have one old name are flagged and left out (G-10)."""
    edges = graph_edges(cited_steps(spark, sf_dir))
    old = lambda c: F.regexp_replace(c, "^Step([67])$", "Step5")
    nodes = edges.select("sample", F.explode(F.array("src", "dst")).alias("node")).distinct()
    odd = nodes.groupBy("sample", old("node").alias("o")).agg(F.count("*").alias("n")).where("n > 1").select("sample").distinct()
    return edges.join(odd, "sample", "left_anti").select("sample", old("src").alias("src"), old("dst").alias("dst"))


def type_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each step number the mode with most weight, ties to the one seen first, and the majority of the flags (G-12)."""
    s = cited_steps(spark, sf_dir).withColumn("w", 1.0 / (1 + F.col("sample") % 5))
    texts = s.groupBy("step", "mode").agg(F.round(F.sum("w"), 6).alias("w"), F.min("sample").alias("first"))
    kinds = s.groupBy("step", "l_returnflag").agg(F.count("*").alias("c"))
    a = texts.groupBy("step").agg(F.max_by("mode", F.struct("w", -F.col("first"))).alias("mode"), F.max("w").alias("w"))
    b = kinds.groupBy("step").agg(F.min_by("l_returnflag", F.struct(-F.col("c"), "l_returnflag")).alias("flag"))
    return a.join(b, "step")


def indexed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a folder of part files as samples: the file's stem and the row's place in its order, rows with an empty answer type left out (S-03, S-04)."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), F.lit(".jsonl")).alias("file"), F.when(F.col("p_size") % 7 == 0, "").otherwise("num").alias("answer_type"))
    stem = F.regexp_extract("file", r"^(.*)\.[^.]+$", 1)
    at = F.row_number().over(Window.partitionBy("file").orderBy("p_partkey")) - 1
    return rows.withColumn("i", at).where("answer_type <> ''").select("p_partkey", F.concat(stem, F.lit("_"), F.col("i").cast("string")).alias("sample_id"), F.col("i").cast("long").alias("source_index"))


def complete_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose every expected shard is there and holds rows, with their totals (S-07); incomplete ones wait."""
    expected = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("shard"), F.col("n_regionkey").alias("grp"))
    have = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("shard")).agg(F.count("*").alias("n"))
    both = expected.join(have, "shard", "left").groupBy("grp").agg(F.count("*").alias("shards"), F.count("n").alias("present"), F.sum("n").alias("rows"))
    return both.select("grp", "shards", "present", F.when(F.col("present") == F.col("shards"), F.col("rows")).alias("merged_rows"))


QUERIES = {f.__name__: f for f in (process_answers, stated_facts, givens, score_arrays, repeated_displays, guarded_outliers, restored_edges, type_votes, indexed_files, complete_shards)}
ORACLES = {
    "process_answers": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN p_partkey::VARCHAR ELSE CASE WHEN p_partkey % 6 = 2 THEN '7' ELSE concat('we get ', p_partkey) END END AS answer FROM part",
    "stated_facts": """WITH f AS (SELECT p_partkey % 50 AS problem, p_partkey AS trace, unnest([{'n': 1, 'pos': 0, 't': concat(p_name, ' is big.')}, {'n': 2, 'pos': 1, 't': concat('a ', p_type, ' holds.')}, {'n': p_partkey % 2 + 1, 'pos': 2, 't': concat('again ', p_brand)}]) AS f FROM part) SELECT problem, f.n::BIGINT AS n, arg_min(f.t, trace * 10 + f.pos) AS text, count(*) AS mentions FROM f GROUP BY 1, 2""",
    "givens": r"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')), lambda x: x <> '') AS ls FROM documents), g AS (SELECT doc_id, text, list_filter(ls, lambda x: regexp_matches(x, '(?i)^(?:given|let|assume|suppose|the|in)(?:[\s\x0B]|$)')) AS g FROM l)
 SELECT doc_id, 'Given' || generate_subscripts(g, 1) AS node, md5(unnest(g)) AS text_md5 FROM g UNION ALL SELECT doc_id, 'Problem', md5(substr(coalesce(text, ''), 1, 300)) FROM g WHERE len(g) = 0""",
    "score_arrays": "SELECT l_orderkey, CASE WHEN l_orderkey % 3 < 2 THEN round(sum(round(l_discount::DOUBLE * 10, 1)), 4) END AS total, CASE WHEN l_orderkey % 3 < 2 THEN count(*) END AS n_scores FROM lineitem GROUP BY l_orderkey",
    "repeated_displays": "WITH r AS (SELECT l_orderkey, l_quantity::INT % 4 AS k FROM lineitem WHERE l_linenumber % 5 <> 0) SELECT l_orderkey, count(*) - count(DISTINCT k) AS n_dropped, count(DISTINCT k) AS n_kept FROM r GROUP BY 1",
    "guarded_outliers": "WITH x AS (SELECT event_type, CASE WHEN event_type = 'view' THEN 0.5 + value / 1e6 ELSE value END AS x FROM events), z AS (SELECT *, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s FROM x WINDOW w AS (PARTITION BY event_type)) SELECT event_type, count(*) AS n, count(*) FILTER (s >= 0.05 AND round((x - m) / s, 6) < -1) AS n_dropped FROM z GROUP BY 1",
    "restored_edges": f"WITH {_CITED}, o AS (SELECT DISTINCT sample, src, dst FROM edges), n AS (SELECT sample, src AS v FROM o UNION SELECT sample, dst FROM o), odd AS (SELECT sample FROM n WHERE v IN ('Step5', 'Step6', 'Step7') GROUP BY sample HAVING count(*) > 1) SELECT sample, CASE WHEN src IN ('Step6', 'Step7') THEN 'Step5' ELSE src END AS src, CASE WHEN dst IN ('Step6', 'Step7') THEN 'Step5' ELSE dst END AS dst FROM o WHERE sample NOT IN (SELECT sample FROM odd)",
    "type_votes": f"WITH {_CITED}, t AS (SELECT step, mode, round(sum(1.0::DOUBLE / (1 + sample % 5)), 6) AS w, min(sample) AS f FROM steps GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY step ORDER BY w DESC, f) = 1), k AS (SELECT step, l_returnflag AS flag FROM steps GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY step ORDER BY count(*) DESC, l_returnflag) = 1) SELECT t.step, mode, w, flag FROM t JOIN k ON k.step = t.step",
    "indexed_files": "WITH r AS (SELECT p_partkey, p_size, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS stem, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part) SELECT p_partkey, stem || '_' || i AS sample_id, i AS source_index FROM r WHERE p_size % 7 <> 0",
    "complete_shards": "SELECT n_regionkey AS grp, count(*) AS shards, count(k) AS present, CASE WHEN count(k) = count(*) THEN sum(k)::BIGINT END AS merged_rows FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS k FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey GROUP BY 1",
}
