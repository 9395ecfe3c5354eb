"""Reasoning steps as rows: segmentation, readers, citations, graphs and step filters, as declarative plans.

Two tables of steps come from the driver's tables.  ``traces``: every document's lines as the steps of one trace, each
second line opening a step, with a verdict at the end.  ``cited_steps``: the lines of an order as steps that cite each
other and three facts.  Every query has an oracle written by itself in another shape of SQL.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepforge.plans.flags import flagger, rebuilder, weigher
from stepforge.plans.stage import SENT, kept, near
from stepforge.sources.tables import table

HEADER = r"^\s*\**\s*[Ss]tep\s*\d+\s*\**\s*[:.\-]"
CONCLUSION = r"^\s*\**\s*(?:Final Conclusion|Final Answer|Answer|Conclusion)\s*\**\s*:|__(?:DIS)?PROVED__"
TRAILER = r"^\s*\**\s*Summary\s*\**\s*:"
CITATION = r"(?i)\b(step|fact)\s*(\d+)"
CONFIDENCE, LAMBDA = 0.6, 0.3
MODES = ("slow red mail", "fast red air", "slow ship", "fast blue rail", "air")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def text_lines(c: Column) -> Column:
    """The non-blank lines of a text, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), strip), lambda x: x != "")


def split_steps(c: Column) -> Column:
    """The steps of a text: a block begins at a header or a conclusion line, other lines go to the open block, lines before
    the first header and summaries go; without a header every line is a step.  One pass over the lines, without a shuffle."""
    lines = text_lines(c)
    opens = lambda x: x.rlike(HEADER) | x.rlike(CONCLUSION)
    start = F.struct(F.array().cast("array<string>").alias("steps"), F.lit(False).alias("skip"))

    def add(acc: Column, x: Column) -> Column:
        last = F.concat(F.element_at(acc["steps"], -1), F.lit("\n"), x)
        more = F.concat(F.slice(acc["steps"], 1, F.greatest(F.size(acc["steps"]) - 1, F.lit(0))), F.array(last))
        return (
            F.when(x.rlike(TRAILER), F.struct(acc["steps"].alias("steps"), F.lit(True).alias("skip")))
            .when(opens(x), F.struct(F.concat(acc["steps"], F.array(x)).alias("steps"), F.lit(False).alias("skip")))
            .when((F.size(acc["steps"]) > 0) & ~acc["skip"], F.struct(more.alias("steps"), F.lit(False).alias("skip")))
            .otherwise(acc)
        )

    return F.when(F.exists(lines, lambda x: x.rlike(HEADER)), F.aggregate(lines, start, add)["steps"]).otherwise(lines)



def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text_lines(F.col("text"))
    numbered = F.transform(lines, lambda x, i: F.when(i % 2 == 0, F.concat(F.lit("Step "), (i / 2).cast("int") + 1, F.lit(": "), x)).otherwise(x))
    verdict = F.when(F.col("doc_id") % 2 == 0, "Conclusion: __PROVED__").otherwise("Conclusion: __DISPROVED__")
    body = F.concat(F.lit("To begin.\n"), F.array_join(numbered, "\n"), F.lit("\n"), verdict)
    return table(spark, sf_dir, "documents").select("doc_id", "source", body.alias("body"))


_TRACES = r"""nb AS (SELECT doc_id, source, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),
traces AS (SELECT doc_id, source, ls, list_concat(list_concat(['To begin.'], list_transform(ls, lambda x, i: CASE WHEN i % 2 = 1 THEN concat('Step ', (i + 1) // 2, ': ', x) ELSE x END)), [CASE WHEN doc_id % 2 = 0 THEN 'Conclusion: __PROVED__' ELSE 'Conclusion: __DISPROVED__' END]) AS body FROM nb)"""
_BLOCKS = r"""flagged AS (SELECT doc_id, unnest(body) AS line, generate_subscripts(body, 1) AS i FROM traces),
marked AS (SELECT *, CASE WHEN regexp_matches(line, '^\s*\**\s*[Ss]tep\s*\d+\s*\**\s*[:.\-]') OR regexp_matches(line, '^\s*\**\s*(?:Final Conclusion|Final Answer|Answer|Conclusion)\s*\**\s*:|__(?:DIS)?PROVED__') THEN 1 ELSE 0 END AS opens,
  CASE WHEN regexp_matches(line, '^\s*\**\s*Summary\s*\**\s*:') THEN 1 ELSE 0 END AS stops FROM flagged),
grouped AS (SELECT *, sum(opens) OVER w AS block, max(CASE WHEN opens = 1 THEN i END) OVER w AS o, max(CASE WHEN stops = 1 THEN i END) OVER w AS s FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
heads AS (SELECT doc_id, bool_or(regexp_matches(line, '^\s*\**\s*[Ss]tep\s*\d+\s*\**\s*[:.\-]')) AS any_head FROM flagged GROUP BY doc_id),
blocks AS (SELECT g.doc_id, CASE WHEN any_head THEN block - 1 ELSE i - 1 END AS pos, string_agg(line, chr(10) ORDER BY i) AS step FROM grouped g JOIN heads h ON h.doc_id = g.doc_id WHERE NOT any_head OR (block > 0 AND (s IS NULL OR s < o)) GROUP BY 1, 2)"""


def trace_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of every trace: its number, its hash and its length (X-01, X-02)."""
    rows = traces(spark, sf_dir).select("doc_id", F.posexplode(split_steps(F.col("body"))).alias("pos", "step"))
    number = F.expr("coalesce(try_cast(nullif(regexp_extract(step, '(?i)^[^0-9a-z]*step[ ]*([0-9]+)', 1), '') AS BIGINT), pos + 1)")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), number.alias("step_number"), F.md5(F.col("step").cast("binary")).alias("step_md5"), F.length("step").cast("long").alias("n_chars"))


def step_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps by marked lines, conclusion lines with them, else by lines; and which it was (X-03, X-04)."""
    lines = text_lines(F.col("body"))
    marked = F.filter(lines, lambda x: x.rlike(r"^Step\s*\d+\s*:"))
    ends = F.filter(lines, lambda x: x.rlike(CONCLUSION) & ~x.rlike(r"^Step\s*\d+\s*:"))
    rows = traces(spark, sf_dir).select("doc_id", F.size(marked).alias("m"), F.size(F.array_distinct(ends)).alias("e"), F.size(lines).alias("n"))
    return rows.select("doc_id", F.when(F.col("m") > 0, F.col("m") + F.col("e")).otherwise(F.col("n")).cast("long").alias("n_steps"), F.when(F.col("n") == 0, "empty").when(F.col("m") > 0, "markers").otherwise("lines").alias("basis"))


def scoring_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a text that are scored: steps, else lines, else sentences (X-06)."""
    steps, lines = split_steps(F.col("text")), text_lines(F.col("text"))
    sentences = F.filter(F.split(strip(F.coalesce("text", F.lit(""))), r"(?<=[.!?])\s+"), lambda x: x != "")
    parts = F.when(F.size(steps) > 1, steps).when(F.size(lines) > 1, lines).otherwise(sentences)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).cast("long").alias("n_parts"), F.md5(F.array_join(parts, "|").cast("binary")).alias("parts_md5"))


IMPERATIVE = r"(?i)^(?:Step\s*\d+\s*:\s*)?(?:find|compute|let|use|show|note|consider|assume|apply|write|prove|add|take)\b"


def trace_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers of whole traces (X-07, X-20, X-21, X-30, X-31, X-33): lines without numbers, the label written last, the last
    line that is neither a step nor the conclusion, whether the last two lines argue by absence, what stands before the
    step that holds the label, and the share of steps in the imperative."""
    lines, steps = text_lines(F.col("body")), split_steps(F.col("body"))
    bare = F.transform(F.filter(lines, lambda x: ~x.rlike(CONCLUSION)), lambda x: F.regexp_replace(x, r"^(?:[Ss]tep\s*)?\d+[.):\-]\s*", ""))
    labels = F.regexp_extract_all(F.col("body"), F.lit(r"Conclusion:\s*(__(?:DIS)?PROVED__)"), F.lit(1))
    said = F.filter(lines, lambda x: ~x.rlike(HEADER) & ~x.rlike(CONCLUSION))
    before = F.filter(steps, lambda x: ~x.rlike("__(?:DIS)?PROVED__"))
    orders = F.size(F.filter(before, lambda x: x.rlike(IMPERATIVE)))
    return traces(spark, sf_dir).select(
        "doc_id",
        F.md5(F.array_join(bare, "|").cast("binary")).alias("bare_md5"),
        F.try_element_at(labels, F.lit(-1)).alias("label"),
        F.md5(F.try_element_at(said, F.lit(-1)).cast("binary")).alias("statement_md5"),
        F.exists(F.slice(lines, F.greatest(F.size(lines) - 1, F.lit(1)), 2), lambda x: x.rlike(r"(?i)(?:no|not|cannot)[^a-z]")).alias("by_absence"),
        F.length(F.array_join(before, "\n")).cast("long").alias("n_before"),
        F.round(F.try_divide(orders, F.size(before)), 6).alias("imperative"),
    )


def logical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of texts with predicate applications as atoms: Name(arg) is one token and masked before the words are read (T-01)."""
    atom = r"[¬~]?[A-Z][a-z]+\([a-z]+\)"
    text = F.coalesce(F.col("body"), F.lit(""))
    atoms = F.transform(F.regexp_extract_all(text, F.lit(f"({atom})"), F.lit(1)), lambda x: F.concat(F.lit("LOGIC:"), F.regexp_replace(x, "[¬~]", "not ")))
    words = F.regexp_extract_all(F.lower(F.regexp_replace(text, atom, " ")), F.lit(r"[\p{L}\p{M}\p{N}_]+(?:-[\p{L}\p{M}\p{N}_]+)*"), F.lit(0))
    words = F.filter(words, lambda x: x.rlike(r"^[a-z0-9]{2,}(?:-[a-z0-9]+)*$") & ~x.isin(*STOP))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("If Big(x) and ~Red(y) then "), "p_name", F.lit(" is a well-known "), "p_brand", F.lit(" of the "), "p_type").alias("body"), "p_partkey")
    return rows.select("p_partkey", F.explode(F.concat(atoms, words)).alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("df"))


STOP = "the of and to in is that for on with as was be by it an or at from this are not have has if then".split()


def key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent words of three letters or more of a turn, ties to the one seen first (T-18)."""
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(words).alias("i", "w")).where(F.col("w").rlike("^[a-zA-Z]{3,}$"))
    counts = rows.groupBy("conv_id", "turn", F.lower("w").alias("term")).agg(F.count("*").alias("n"), F.min("i").alias("first"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.desc("n"), "first"))
    return counts.withColumn("rk", rank).where("rk <= 10").select("conv_id", "turn", "term", "n", F.col("rk").cast("long").alias("rk"))


def cited_steps(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """(sample, step, body, mode): the lines of an order as steps that cite others; ``whole``: an order's in one partition, by one shuffle."""
    mode = F.element_at(F.array(*map(F.lit, MODES)), (F.col("l_suppkey") % len(MODES) + 1).cast("int"))
    again = F.when(F.col("l_returnflag") == "R", F.concat(F.lit(" with step "), "l_linenumber")).otherwise(F.lit(""))
    body = F.concat(F.lit("By Step "), F.col("l_partkey") % 7 + 1, F.lit(" and Fact "), F.col("l_suppkey") % 4 + 1, again, F.lit(", it is "), mode)
    lines = table(spark, sf_dir, "lineitem")
    lines = (lines.repartition("l_orderkey") if whole else lines).groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag", "l_quantity")))  # a line number may stand twice
    return lines.select(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").cast("long").alias("step"), body.alias("body"), mode.alias("mode"), "l_returnflag", "l_quantity")


_CITED = f"""steps AS (SELECT l_orderkey AS sample, l_linenumber::BIGINT AS step, {list(MODES)}[l_suppkey % {len(MODES)} + 1] AS mode, l_returnflag, l_quantity, l_partkey % 7 + 1 AS s1, l_suppkey % 4 + 1 AS f1, CASE WHEN l_returnflag = 'R' THEN l_linenumber END AS s2 FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)),
mentions AS (SELECT sample, step, 'Step' || s1 AS src, s1 AS n FROM steps UNION ALL SELECT sample, step, 'Fact' || f1, NULL FROM steps UNION ALL SELECT sample, step, 'Step' || s2, s2 FROM steps WHERE s2 IS NOT NULL),
ids AS (SELECT sample, 'Step' || step AS id FROM steps UNION SELECT sample, 'Fact' || f FROM (SELECT DISTINCT sample FROM steps), (VALUES (1), (2), (3)) t(f)),
edges AS (SELECT DISTINCT m.sample, m.src, 'Step' || m.step AS dst, m.step, m.n FROM mentions m JOIN ids ON ids.sample = m.sample AND ids.id = m.src WHERE m.src <> 'Step' || m.step)"""


def citations(steps: DataFrame) -> DataFrame:
    """(sample, step, kind, n) of every mention of a step or a fact in a body."""
    found = F.regexp_extract_all("body", F.lit(CITATION), F.lit(0))
    rows = steps.select("sample", "step", F.explode(found).alias("m"))
    return rows.select("sample", "step", F.initcap(F.regexp_extract("m", "^[A-Za-z]+", 0)).alias("kind"), F.regexp_extract("m", r"\d+", 0).cast("long").alias("n"))


def graph_nodes(steps: DataFrame) -> DataFrame:
    """(sample, node, kind): three facts and the steps of each sample, its last step being the conclusion."""
    last = F.max("step").over(Window.partitionBy("sample"))
    own = steps.select("sample", F.concat(F.lit("Step"), "step").alias("node"), F.when(F.col("step") == last, "conclusion").otherwise("step").alias("kind"))
    facts = steps.select("sample").distinct().select("sample", F.explode(F.array(*(F.lit(f"Fact{i}") for i in (1, 2, 3)))).alias("node"), F.lit("fact").alias("kind"))
    return own.unionByName(facts)


def graph_edges(steps: DataFrame) -> DataFrame:
    """(sample, src, dst, confidence): a mention is an edge from the mentioned node; unknown nodes, loops and repeats go."""
    found = citations(steps).select("sample", F.concat("kind", "n").alias("src"), F.concat(F.lit("Step"), "step").alias("dst"))
    known = graph_nodes(steps).select("sample", F.col("node").alias("src"))
    return found.where("src <> dst").distinct().join(known, ["sample", "src"], "left_semi").select("sample", "src", "dst", F.lit(CONFIDENCE).alias("confidence"))


def cited_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges read from citations (G-01)."""
    return graph_edges(cited_steps(spark, sf_dir))


def trace_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each sample by kind, with their degrees (G-03)."""
    steps = cited_steps(spark, sf_dir)
    edges = graph_edges(steps)
    ends = edges.select("sample", F.explode(F.array("src", "dst")).alias("node")).groupBy("sample", "node").agg(F.count("*").alias("degree"))
    return graph_nodes(steps).join(ends, ["sample", "node"], "left").select("sample", "node", "kind", F.coalesce("degree", F.lit(0)).alias("degree"))


def bad_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of each step, and whether one is of itself or of a later step (X-32)."""
    return citations(cited_steps(spark, sf_dir)).groupBy("sample", "step").agg(F.count("*").alias("n_citations"), F.max((F.col("kind") == "Step") & (F.col("n") >= F.col("step"))).alias("bad"))


def structural_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps without an edge, with a citation of a node that isn't there, or of a later step (N-10)."""
    return anomalies(cited_steps(spark, sf_dir))


def anomalies(steps: DataFrame) -> DataFrame:
    cites = citations(steps).where("not (kind = 'Step' and n = step)")
    there = graph_nodes(steps).select("sample", F.col("node"), F.lit(True).alias("there"))
    seen = cites.withColumn("node", F.concat("kind", "n")).join(there, ["sample", "node"], "left")
    seen = seen.groupBy("sample", "step").agg(F.max(F.col("there").isNull()).alias("missing"), F.max((F.col("kind") == "Step") & (F.col("n") > F.col("step"))).alias("later"))
    ends = graph_edges(steps).select("sample", F.explode(F.array("src", "dst")).alias("node")).distinct().where("node like 'Step%'").select("sample", F.substring("node", 5, 9).cast("long").alias("step"), F.lit(True).alias("linked"))
    rows = steps.select("sample", "step").join(seen, ["sample", "step"], "left").join(ends, ["sample", "step"], "left")
    reasons = F.array_compact(F.array(F.when(F.col("linked").isNull(), "isolated"), F.when(F.col("missing"), "missing"), F.when(F.col("later"), "later")))
    return rows.select("sample", "step", F.array_join(reasons, ",").alias("reasons")).where("reasons <> ''")


def edge_weights(steps: DataFrame) -> DataFrame:
    """(src, dst, w, frequency) over all samples: the edge's confidence and the overlap of the kinds of its ends, as the mean over all samples (G-11)."""
    total = steps.agg(F.count_distinct("sample").alias("k"))
    words = steps.select("sample", F.concat(F.lit("Step"), "step").alias("node"), F.array_distinct(F.split(F.lower("mode"), " ")).alias("words"))
    edges = graph_edges(steps).join(words.select("sample", F.col("node").alias("dst"), F.col("words").alias("b")), ["sample", "dst"])
    edges = edges.join(words.select("sample", F.col("node").alias("src"), F.col("words").alias("a")), ["sample", "src"], "left")
    shared = F.coalesce(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), F.lit(0.0))
    edges = edges.groupBy("src", "dst").agg(F.sum((1 - LAMBDA) * F.col("confidence") + LAMBDA * shared).alias("w"), F.count("*").alias("frequency"))
    return edges.crossJoin(F.broadcast(total)).select("src", "dst", F.round(F.col("w") / F.col("k"), 4).alias("w"), "frequency")  # one row of totals


def citation_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_weights(cited_steps(spark, sf_dir))


WEAK = 0.05


def filtered_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that a phase flags, with the first phase that does: structure, then a weak edge into the step, then
    arithmetic, which also rescues what holds; the last step of a sample always stays (N-11, N-13)."""
    return flagged(cited_steps(spark, sf_dir, whole=True))


def _with_cites(steps: DataFrame) -> DataFrame:
    """Steps in whole samples, in order, with what each body cites; a body is read once, however many steps hold it."""
    found = F.transform(F.regexp_extract_all("body", F.lit(CITATION), F.lit(0)), lambda m: F.struct((F.lower(F.substring(m, 1, 4)) == "fact").alias("fact"), F.regexp_extract(m, r"\d+", 0).try_cast("long").alias("n")))
    cites = F.array_distinct(F.filter(found, lambda x: x["n"].isNotNull()))
    texts = kept(steps.select("body").distinct().where("body is not null").select("body", cites.alias("cites")))
    weight = texts.agg(F.sum(64 + F.octet_length("body") + 16 * F.size("cites"))).first()[0] or 0
    holds = F.when(F.col("l_quantity") % 5 == 0, True).when(F.col("l_quantity") % 7 == 0, False)
    rows = steps.where("sample is not null").select("sample", "step", "body", "mode", holds.alias("holds")).join(near(texts, weight), "body", "left")
    return (rows if weight <= SENT else rows.repartition("sample")).sortWithinPartitions("sample", "step")


def _weak(rows: DataFrame) -> set[tuple[bool, int, int]]:
    """Edges of too little weight (``edge_weights``): one for a pair of step numbers or facts."""
    kinds = rows.select("sample", "step", "mode", "cites").mapInArrow(weigher, "fact boolean, n long, step long, a string, b string, frequency long")
    kinds = kept(kinds.groupBy("fact", "n", "step", "a", "b").agg(F.sum("frequency").alias("frequency")))
    k = kinds.where("fact is null").agg(F.sum("frequency")).first()[0]
    a, b = (F.array_distinct(F.split(F.lower(c), " ")) for c in "ab")
    shared = F.coalesce(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), F.lit(0.0))
    w = F.sum(F.col("frequency") * ((1 - LAMBDA) * CONFIDENCE + LAMBDA * shared))
    weak = kinds.where("fact is not null").groupBy("fact", "n", "step").agg(w.alias("w")).where(F.round(F.col("w") / max(k or 0, 1), 4) < WEAK)
    return {(r.fact, r.n, r.step) for r in weak.collect()}


def flagged(steps: DataFrame) -> DataFrame:
    """The steps must stand in whole samples (``cited_steps``)."""
    rows = _with_cites(steps)
    return rows.select("sample", "step", "holds", "cites").mapInArrow(flagger(_weak(rows)), "sample long, step long, removed_by string")


def rebuilt_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces without their flagged steps, written anew, and whether too little of them is left (N-09, N-14)."""
    steps = cited_steps(spark, sf_dir, whole=True)
    rows = _with_cites(steps)
    left = rows.select("sample", "step", "body", "holds", "cites").mapInArrow(rebuilder(_weak(rows)), "sample long, before long, after long, text_md5 string")
    return left.select("sample", "before", "after", ((F.col("before") - F.col("after")) / F.col("before") > 0.3).alias("underthinking"), "text_md5")


def shared_conclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with each sample's conclusions (steps that hold a verdict, else its last) as one shared node of the highest; loops go (G-08)."""
    steps = cited_steps(spark, sf_dir)
    ends = steps.groupBy("sample").agg(F.max(F.when(F.col("l_returnflag") == "N", F.col("step"))).alias("top"), F.max("step").alias("last"))
    ends = ends.select("sample", F.coalesce("top", "last").alias("top"))
    holders = steps.join(ends, "sample").where("l_returnflag = 'N' or step = top").select("sample", F.concat(F.lit("Step"), "step").alias("node"), (F.col("step") == F.col("top")).alias("kept"))
    edges = graph_edges(steps)
    for side in ("src", "dst"):
        h = holders.select("sample", F.col("node").alias(side), F.col("kept").alias(f"{side}_kept"))
        edges = edges.join(h, ["sample", side], "left")
    edges = edges.where("coalesce(src_kept, true) and coalesce(dst_kept, true)")
    named = lambda c: F.when(F.col(f"{c}_kept").isNotNull(), "ConcShared").otherwise(F.col(c)).alias(c)
    return edges.select("sample", named("src"), named("dst")).where("src <> dst").distinct()


def plan_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written plan: steps numbered on from 1, with the positions of the steps they use and the mean confidence, 0.7 without edges (G-15, G-19)."""
    steps = cited_steps(spark, sf_dir)
    kept = steps.where("l_returnflag <> 'A'").select("sample", F.concat(F.lit("Step"), "step").alias("node"), F.row_number().over(Window.partitionBy("sample").orderBy("step")).cast("long").alias("position"))
    edges = graph_edges(steps).join(kept.select("sample", F.col("node").alias("src"), F.col("position").alias("p")), ["sample", "src"], "left")
    used = edges.groupBy("sample", F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("p")).alias("uses"), F.avg("confidence").alias("c"))
    return kept.join(used, ["sample", "node"], "left").select("sample", "node", "position", F.coalesce(F.array_join("uses", ","), F.lit("")).alias("uses"), F.round(F.coalesce("c", F.lit(0.7)), 4).alias("confidence"))


def acyclic_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each sample's step graph has no cycle: paths are doubled three times, which reaches all of seven steps (G-04)."""
    edges = graph_edges(cited_steps(spark, sf_dir)).where("src like 'Step%'").select("sample", "src", "dst")
    paths = edges
    for _ in range(3):
        longer = paths.alias("a").join(paths.alias("b"), (F.col("a.sample") == F.col("b.sample")) & (F.col("a.dst") == F.col("b.src"))).select("a.sample", "a.src", "b.dst")
        paths = paths.union(longer).distinct()
    return paths.groupBy("sample").agg(F.max(F.col("src") == F.col("dst")).alias("cyclic"))


def trace_depth_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of each trace by how near its number of steps is to the known depth (G-07), and the weighted vote (A-03)."""
    steps = cited_steps(spark, sf_dir).groupBy("sample").agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample"), F.col("o_custkey").alias("problem"), F.col("o_orderstatus").alias("label"), (F.col("o_custkey") % 5 + 1).alias("depth"))
    votes = orders.join(steps, "sample").withColumn("w", F.pow(1.0 / (1 + F.abs(F.col("n") - F.col("depth"))), F.lit(4.0)))
    votes = votes.groupBy("problem", "label").agg(F.sum("w").alias("w"))
    best = votes.groupBy("problem").agg(F.sum("w").alias("total"), F.max(F.struct(F.round("w", 9).alias("w"), F.negative(F.ascii("label")).alias("o"), "label")).alias("b"))
    return best.select("problem", F.col("b.label").alias("label"), F.round(F.col("b.w") / F.col("total"), 6).alias("strength"))


def pairwise_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation with no other that shares enough of their words (N-07), by joins on the words; and the best weighted overlap (N-02)."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0)), lambda x: x.rlike("^[a-z]{3,}$"))
    rows = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(words).alias("w"))
    tf = rows.groupBy("conv_id", "turn", "w").agg(F.count("*").alias("c"))
    size = tf.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.sum("c").alias("mass"))
    a, b = tf.alias("a"), tf.alias("b")
    pairs = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.w") == F.col("b.w")) & (F.col("a.turn") != F.col("b.turn")))
    pairs = pairs.groupBy(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"), F.col("b.turn").alias("other")).agg(F.count("*").alias("both"), F.sum((F.col("a.c") + F.col("b.c")) / 2).alias("mean"), F.sum(F.least("a.c", "b.c")).alias("low"))
    pairs = pairs.join(size, ["conv_id", "turn"]).join(size.select("conv_id", F.col("turn").alias("other"), F.col("n").alias("m"), F.col("mass").alias("mass2")), ["conv_id", "other"])
    plain, weighted = F.col("both") / (F.col("n") + F.col("m") - F.col("both")), F.col("mean") / (F.col("mass") + F.col("mass2") - F.col("low"))
    best = pairs.groupBy("conv_id", "turn").agg(F.max(plain).alias("best"), F.sum(F.when(plain >= 0.3, 1).otherwise(0)).alias("near"), F.max(weighted).alias("weighted"))
    out = size.join(best, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", F.round(F.coalesce("best", F.lit(0.0)), 6).alias("best"), F.round(F.coalesce("weighted", F.lit(0.0)), 6).alias("weighted"), ((F.coalesce("best", F.lit(0.0)) < 0.3) | (F.coalesce("near", F.lit(0)) < 2)).alias("dropped"))


def arithmetic_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the equation that each line states holds exactly; null where none is stated (N-08): products in hundredths."""
    stated = F.when(F.col("l_linenumber") < 6, F.format_string("%d*%d=%d", F.col("l_quantity").cast("int"), F.col("l_linenumber"), (F.col("l_quantity") * F.col("l_linenumber")).cast("int") + (F.col("l_partkey") % 3 == 0).cast("int")))
    part = lambda i: F.regexp_extract("eq", r"^(\d+)\*(\d+)=(\d+)$", i).cast("long")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", stated.alias("eq"))
    return rows.select("l_orderkey", "l_linenumber", F.when(F.col("eq").isNotNull(), part(1) * part(2) == part(3)).alias("holds"))


QUERIES = {f.__name__: f for f in (trace_steps, step_basis, scoring_parts, trace_readers, logical_tokens, key_terms, cited_edges, trace_graphs, bad_citations, structural_anomalies, citation_weights, filtered_steps, rebuilt_traces, shared_conclusions, plan_entries, acyclic_graphs, trace_depth_weights, pairwise_outliers, arithmetic_checks)}

_ANOMALIES = """cites AS (SELECT sample, step, src, n FROM mentions WHERE NOT (src = 'Step' || step)),
linked AS (SELECT sample, src AS node FROM edges UNION SELECT sample, dst FROM edges),
anomalies AS (SELECT s.sample, s.step, array_to_string(list_filter([CASE WHEN NOT EXISTS (SELECT 1 FROM linked l WHERE l.sample = s.sample AND l.node = 'Step' || s.step) THEN 'isolated' END,
  CASE WHEN EXISTS (SELECT 1 FROM cites c WHERE c.sample = s.sample AND c.step = s.step AND NOT EXISTS (SELECT 1 FROM ids i WHERE i.sample = c.sample AND i.id = c.src)) THEN 'missing' END,
  CASE WHEN EXISTS (SELECT 1 FROM cites c WHERE c.sample = s.sample AND c.step = s.step AND c.n > c.step) THEN 'later' END], lambda x: x IS NOT NULL), ',') AS reasons FROM steps s)"""
_WEIGHTS = f"""weights AS (SELECT src, dst, round(sum(ws) / (SELECT count(DISTINCT sample) FROM steps), 4) AS w, count(*) AS frequency FROM (SELECT e.src, e.dst, {1 - LAMBDA} * {CONFIDENCE} + {LAMBDA} * coalesce(len(list_intersect(list_distinct(string_split(lower(a.mode), ' ')), list_distinct(string_split(lower(b.mode), ' ')))) * 1.0
  / len(list_distinct(list_concat(string_split(lower(a.mode), ' '), string_split(lower(b.mode), ' ')))), 0) AS ws FROM edges e JOIN steps b ON b.sample = e.sample AND b.step = e.step LEFT JOIN steps a ON a.sample = e.sample AND 'Step' || a.step = e.src) GROUP BY src, dst)"""
_FLAGGED = f"""phased AS (SELECT s.sample, s.step, CASE WHEN a.reasons <> '' THEN 'nodes' WHEN EXISTS (SELECT 1 FROM edges e LEFT JOIN weights w ON w.src = e.src AND w.dst = e.dst WHERE e.sample = s.sample AND e.step = s.step AND coalesce(w.w, 0) < {WEAK}) THEN 'edges' WHEN s.l_quantity % 7 = 0 AND s.l_quantity % 5 <> 0 THEN 'math' END AS removed_by,
  s.l_quantity % 5 = 0 AS rescued, max(s.step) OVER (PARTITION BY s.sample) AS last FROM steps s LEFT JOIN anomalies a ON a.sample = s.sample AND a.step = s.step),
flagged AS (SELECT sample, step, removed_by FROM phased WHERE removed_by IS NOT NULL AND NOT rescued AND step < last)"""
_WORDS = r"""words AS (SELECT conv_id, turn, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}_]+'), lambda x: regexp_matches(x, '^[a-z]{3,}$'))) AS w FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
tf AS (SELECT conv_id, turn, w, count(*) AS c FROM words GROUP BY ALL)"""
ORACLES = {
    "scoring_parts": r"""WITH nb AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS t, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),
 p AS (SELECT doc_id, CASE WHEN len(ls) > 1 THEN ls ELSE list_filter(string_split(regexp_replace(t, '([.!?])[\s\x0B]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') END AS parts FROM nb) SELECT doc_id, len(parts)::BIGINT AS n_parts, md5(array_to_string(parts, '|')) AS parts_md5 FROM p""",
    "trace_steps": f"WITH {_TRACES}, {_BLOCKS} SELECT doc_id, pos::BIGINT AS pos, coalesce(try_cast(nullif(regexp_extract(step, '(?i)^[^0-9a-z]*step[ ]*([0-9]+)', 1), '') AS BIGINT), pos + 1)::BIGINT AS step_number, md5(step) AS step_md5, length(step)::BIGINT AS n_chars FROM blocks",
    "step_basis": rf"WITH {_TRACES}, c AS (SELECT doc_id, count(*) FILTER (regexp_matches(x, '^Step\s*\d+\s*:')) AS m, count(DISTINCT x) FILTER (NOT regexp_matches(x, '^Step\s*\d+\s*:') AND regexp_matches(x, '^\s*\**\s*(?:Final Conclusion|Final Answer|Answer|Conclusion)\s*\**\s*:|__(?:DIS)?PROVED__')) AS e, count(*) AS n FROM (SELECT doc_id, unnest(body) AS x FROM traces) GROUP BY doc_id) SELECT doc_id, CASE WHEN m > 0 THEN m + e ELSE n END::BIGINT AS n_steps, CASE WHEN n = 0 THEN 'empty' WHEN m > 0 THEN 'markers' ELSE 'lines' END AS basis FROM c",
    "trace_readers": rf"""WITH {_TRACES}, {_BLOCKS}, l AS (SELECT doc_id, line, i, max(i) OVER (PARTITION BY doc_id) AS n, regexp_matches(line, '^\s*\**\s*(?:Final Conclusion|Final Answer|Answer|Conclusion)\s*\**\s*:|__(?:DIS)?PROVED__') AS ends, regexp_matches(line, '^\s*\**\s*[Ss]tep\s*\d+\s*\**\s*[:.\-]') AS head FROM flagged),
 a AS (SELECT doc_id, md5(string_agg(regexp_replace(line, '^(?:[Ss]tep\s*)?\d+[.):\-]\s*', ''), '|' ORDER BY i) FILTER (NOT ends)) AS bare_md5, arg_max(regexp_extract(line, '__(?:DIS)?PROVED__'), i) FILTER (regexp_matches(line, 'Conclusion:\s*__(?:DIS)?PROVED__')) AS label, md5(arg_max(line, i) FILTER (NOT ends AND NOT head)) AS statement_md5, bool_or(regexp_matches(line, '(?i)(?:no|not|cannot)[^a-z]')) FILTER (i >= n - 1) AS by_absence FROM l GROUP BY doc_id),
 b AS (SELECT doc_id, coalesce(sum(length(step)) FILTER (k) + count(*) FILTER (k) - 1, 0) AS n_before, round(count(*) FILTER (k AND regexp_matches(step, '(?i)^(?:Step\s*\d+\s*:\s*)?(?:find|compute|let|use|show|note|consider|assume|apply|write|prove|add|take)\b')) / nullif(count(*) FILTER (k), 0), 6) AS imperative FROM (SELECT *, NOT regexp_matches(step, '__(?:DIS)?PROVED__') AS k FROM blocks) GROUP BY doc_id)
 SELECT a.*, greatest(n_before, 0)::BIGINT AS n_before, imperative FROM a JOIN b ON b.doc_id = a.doc_id""",
    "logical_tokens": r"""WITH r AS (SELECT p_partkey, concat('If Big(x) and ~Red(y) then ', p_name, ' is a well-known ', p_brand, ' of the ', p_type) AS body FROM part), t AS (SELECT p_partkey, unnest(list_concat(['LOGIC:Big(x)', 'LOGIC:not Red(y)'], list_filter(regexp_extract_all(lower(replace(replace(body, 'Big(x)', ' '), '~Red(y)', ' ')), '[\p{L}\p{M}\p{N}_]+(?:-[\p{L}\p{M}\p{N}_]+)*'), lambda x: regexp_matches(x, '^[a-z0-9]{2,}(?:-[a-z0-9]+)*$') AND x NOT IN (STOPS)))) AS token FROM r)
 SELECT token, count(*) AS n, count(DISTINCT p_partkey) AS df FROM t GROUP BY token""".replace("STOPS", ", ".join(f"'{w}'" for w in STOP)),
    "key_terms": r"""WITH w AS (SELECT conv_id, turn, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}_]+') AS l FROM conversations)), c AS (SELECT conv_id, turn, lower(w) AS term, count(*) AS n, min(i) AS f FROM w WHERE regexp_matches(w, '^[a-zA-Z]{3,}$') GROUP BY ALL) SELECT conv_id, turn, term, n, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, f) AS rk FROM c QUALIFY rk <= 10""",
    "cited_edges": f"WITH {_CITED} SELECT DISTINCT sample, src, dst, {CONFIDENCE}::DOUBLE AS confidence FROM edges",
    "trace_graphs": f"WITH {_CITED}, d AS (SELECT sample, node, count(*) AS degree FROM (SELECT sample, src AS node, dst AS o FROM edges UNION ALL SELECT sample, dst, src FROM edges) GROUP BY ALL), l AS (SELECT sample, max(step) AS last FROM steps GROUP BY sample) SELECT i.sample, i.id AS node, CASE WHEN i.id LIKE 'Fact%' THEN 'fact' WHEN i.id = 'Step' || l.last THEN 'conclusion' ELSE 'step' END AS kind, coalesce(degree, 0)::BIGINT AS degree FROM ids i JOIN l ON l.sample = i.sample LEFT JOIN d ON d.sample = i.sample AND d.node = i.id",
    "bad_citations": f"WITH {_CITED} SELECT sample, step, count(*) AS n_citations, coalesce(bool_or(n >= step), false) AS bad FROM mentions GROUP BY ALL",
    "structural_anomalies": f"WITH {_CITED}, {_ANOMALIES} SELECT sample, step, reasons FROM anomalies WHERE reasons <> ''",
    "citation_weights": f"WITH {_CITED}, {_WEIGHTS} SELECT src, dst, w::DOUBLE AS w, frequency FROM weights",
    "filtered_steps": f"WITH {_CITED}, {_ANOMALIES}, {_WEIGHTS}, {_FLAGGED} SELECT * FROM flagged",
    "rebuilt_traces": f"""WITH {_CITED}, {_ANOMALIES}, {_WEIGHTS}, {_FLAGGED}, k AS (SELECT s.*, f.step IS NULL AS stays FROM steps s LEFT JOIN flagged f ON f.sample = s.sample AND f.step = s.step) SELECT sample, count(*) AS before, count(*) FILTER (stays) AS after, (count(*) - count(*) FILTER (stays)) / count(*) > 0.3 AS underthinking,
 md5(string_agg(concat('Step ', step, ': By Step ', s1, ' and Fact ', f1, CASE WHEN s2 IS NULL THEN '' ELSE concat(' with step ', s2) END, ', it is ', mode), chr(10) ORDER BY step) FILTER (stays)) AS text_md5 FROM k GROUP BY sample""",
    "shared_conclusions": f"""WITH {_CITED}, t AS (SELECT sample, coalesce(max(step) FILTER (l_returnflag = 'N'), max(step)) AS top FROM steps GROUP BY sample), h AS (SELECT s.sample, 'Step' || s.step AS node, s.step = t.top AS kept FROM steps s JOIN t ON t.sample = s.sample WHERE s.l_returnflag = 'N' OR s.step = t.top),
 r AS (SELECT e.sample, CASE WHEN a.kept THEN 'ConcShared' ELSE e.src END AS src, CASE WHEN b.kept THEN 'ConcShared' ELSE e.dst END AS dst FROM edges e LEFT JOIN h a ON a.sample = e.sample AND a.node = e.src LEFT JOIN h b ON b.sample = e.sample AND b.node = e.dst WHERE coalesce(a.kept, true) AND coalesce(b.kept, true)) SELECT DISTINCT * FROM r WHERE src <> dst""",
    "plan_entries": f"WITH {_CITED}, k AS (SELECT sample, 'Step' || step AS node, row_number() OVER (PARTITION BY sample ORDER BY step) AS position FROM steps WHERE l_returnflag <> 'A'), u AS (SELECT e.sample, e.dst, array_to_string(list_sort(list(DISTINCT k.position) FILTER (k.position IS NOT NULL)), ',') AS uses FROM (SELECT DISTINCT sample, src, dst FROM edges) e LEFT JOIN k ON k.sample = e.sample AND k.node = e.src GROUP BY ALL) SELECT k.sample, k.node, k.position, coalesce(u.uses, '') AS uses, CASE WHEN u.sample IS NULL THEN 0.7 ELSE {CONFIDENCE} END::DOUBLE AS confidence FROM k LEFT JOIN u ON u.sample = k.sample AND u.dst = k.node",
    "acyclic_graphs": f"WITH RECURSIVE {_CITED}, reach AS (SELECT sample, src, dst FROM edges WHERE src LIKE 'Step%' UNION SELECT r.sample, r.src, e.dst FROM reach r JOIN edges e ON e.sample = r.sample AND e.src = r.dst) SELECT sample, bool_or(src = dst) AS cyclic FROM reach GROUP BY sample",
    "trace_depth_weights": "WITH v AS (SELECT o_custkey AS problem, o_orderstatus AS label, sum((1.0 / (1 + abs(n - (o_custkey % 5 + 1)))) ** 4) AS w FROM orders JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT problem, label, round(w / sum(w) OVER (PARTITION BY problem), 6) AS strength FROM v QUALIFY row_number() OVER (PARTITION BY problem ORDER BY round(w, 9) DESC, label) = 1",
    "pairwise_outliers": f"""WITH {_WORDS}, pl AS (SELECT conv_id, turn, list(w ORDER BY w) AS ws, map_from_entries(list((w, c))) AS m, sum(c) AS mass FROM tf GROUP BY ALL), p AS (SELECT a.conv_id, a.turn, len(list_intersect(a.ws, b.ws)) AS n_both, len(list_distinct(list_concat(a.ws, b.ws))) AS n_any, list_sum(list_transform(list_intersect(a.ws, b.ws), lambda x: (a.m[x] + b.m[x]) / 2.0)) AS mean, list_sum(list_transform(list_distinct(list_concat(a.ws, b.ws)), lambda x: greatest(coalesce(a.m[x], 0), coalesce(b.m[x], 0)))) AS top FROM pl a LEFT JOIN pl b ON b.conv_id = a.conv_id AND b.turn <> a.turn),
 q AS (SELECT conv_id, turn, coalesce(max(n_both * 1.0 / n_any), 0) AS best, coalesce(max(coalesce(mean, 0) / top), 0) AS weighted, count(*) FILTER (n_both * 1.0 / n_any >= 0.3) AS near FROM p GROUP BY ALL) SELECT conv_id, turn, round(best, 6)::DOUBLE AS best, round(weighted, 6)::DOUBLE AS weighted, best < 0.3 OR near < 2 AS dropped FROM q""",
    "arithmetic_checks": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 6 THEN l_partkey % 3 <> 0 END AS holds FROM lineitem",
}
