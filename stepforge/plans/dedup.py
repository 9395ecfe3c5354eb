"""Whole-trace operators: the grammar of citations, removal of repeated steps with renumbering, gates of rechecked proofs,
consensus over the graphs of a problem, alignment of cited steps.

Steps are those of ``steps.cited_steps``; a problem is ten orders, each a trace.  Oracles are built from the tables' numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepforge.operators.grouped import align_cited, drop_weakest, kept_edges
from stepforge.plans.flags import whole
from stepforge.plans.stage import kept, near
from stepforge.plans.steps import _CITED, cited_steps, edge_weights, graph_edges
from stepforge.plans.terms import alignment_tokens
from stepforge.sources.tables import table

PROBLEM, THETA, CITED = 10, 0.001, 2
QUOTED = r"[“\"][^”\"\n]{3,300}[”\"]"
#: A citation and the rest of its run: further steps; numbers after a word, an ampersand or a dash; bare numbers after a comma
#: or a slash only where the list goes on or ends, so that "From Step 3, 4 cases remain" cites one step (D-14).
RUN = r"\bsteps?\s*+\d++(?:\s*+(?:(?:[,/&–-]|and\b|to\b|through\b)\s*+(?:and\s++)?+steps?\s*+\d++|(?:[&–]|,\s*+and\b|and\b|to\b|through\b)\s*+\d++|(?:[,/]\s*+|(?<=\d)-)\d++(?=\s*+(?:[,/&–)\].;:-]|and\b|$))))*+"
OWN_BEFORE = r"(?i)(?:(?:problem|algorithm|procedure|instruction|game|rule)[’']s|(?:the|its|each)\s+(?:given|stated))\s*$"
OWN_AFTER = r"(?i)^\s+(?:of|in)\s+the\s+(?:algorithm|procedure|problem|process|instructions?|game|puzzle)\b"
_PIECE = rf"(?is){QUOTED}|{RUN}|(?:(?!\bsteps?\s*+\d).)(?:(?!\bsteps?\s*+\d|[“\"]).)*+"


def pieces(c: Column) -> Column:
    """array of (lead, n): a text cut at the numbers its citations name; ``lead`` is what stands before the number, n is null
    for other text.  Quoted text and the problem's own procedure ("the problem's Step 2", "Step 2 of the algorithm") hold none."""
    cut = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_PIECE), F.lit(0))
    plain = lambda x: F.array(F.struct(x.alias("lead"), F.lit(None).cast("long").alias("n")))

    def split(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(cut, i - 1), F.lit(""))
        after = F.coalesce(F.get(cut, i + 1), F.lit(""))
        cites = x.rlike(r"(?i)^steps?\s*\d") & ~before.rlike(OWN_BEFORE) & ~after.rlike(OWN_AFTER)
        numbers = F.transform(F.regexp_extract_all(x, F.lit(r"\D*\d+"), F.lit(0)), lambda y: F.struct(F.regexp_extract(y, r"^\D*", 0).alias("lead"), F.regexp_extract(y, r"\d+$", 0).try_cast("long").alias("n")))
        return F.when(cites, numbers).otherwise(plain(x))

    return F.flatten(F.transform(cut, split))


def cited_numbers(c: Column) -> Column:
    """The numbers of the steps a text cites, in order (D-14)."""
    return F.transform(F.filter(pieces(c), lambda x: x["n"].isNotNull()), lambda x: x["n"])


def citation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps named by runs, ranges, quotes and own procedures (D-14): how often each number is cited, by wording."""
    a, b = F.col("l_linenumber"), F.col("l_partkey") % 9 + 1
    ways = ["From Steps %1$d, %2$d, and 3 we get x", "Step %1$d/Step %2$d – by Step %1$d, 4 cases remain", "He said \"see Step %1$d\" but Steps %1$d–%2$d show", "The problem's Step %1$d and Step %2$d of the algorithm", "By steps %1$d and %2$d; Step 4 - 3 = 1"]
    kind = F.col("l_partkey") % 5
    body = F.element_at(F.array(*(F.format_string(w, a, b) for w in ways)), (kind + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(kind.alias("kind"), F.explode(cited_numbers(body)).alias("cited"))
    return rows.groupBy("kind", "cited").agg(F.count("*").alias("n"))


def conclusion(c: Column) -> Column:
    """What a step lands on, without case, citations and blanks; null if it doesn't say."""
    said = F.regexp_extract(F.lower(c), r"(?s).*\b(?:it is|it follows that|therefore|thus|hence)[,\s]+(.*)$", 1)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(said, RUN, ""), r"[\s.]+", " ")), F.lit(""))


def deduplicate(steps: DataFrame) -> DataFrame:
    """(sample, step, number, body) of the steps that stay (D-12): a step whose conclusion an earlier one reached goes, the rest
    are numbered from 1, citations of a step that went name the one it repeats, and a step that would cite itself names the one
    before it ("this step" if it is the first).  If the trace's last conclusion would change, the whole trace stays as it was.

    Windows and joins are on the trace; nothing is collected but one step's pieces and one trace's steps."""
    by_sample = Window.partitionBy("sample").orderBy("step")
    s = steps.select("sample", "step", "body", conclusion(F.col("body")).alias("k"))
    s = s.withColumn("source", F.when(F.col("k").isNull(), F.col("step")).otherwise(F.min("step").over(Window.partitionBy("sample", F.coalesce("k", F.col("step").cast("string"))))))
    s = s.withColumn("number", F.sum((F.col("source") == F.col("step")).cast("int")).over(by_sample))
    s = s.withColumn("guarded", F.max(F.struct("step", (F.col("source") < F.col("step")).alias("gone"))).over(Window.partitionBy("sample"))["gone"])
    moved = s.where("source = step").select("sample", F.col("step").alias("source"), F.col("number").alias("new"))
    renamed = s.select("sample", "step", "source").join(moved, ["sample", "source"]).select("sample", F.col("step").alias("n"), "new")
    kept = s.where("guarded or source = step").select("sample", "step", F.when(F.col("guarded"), F.col("step")).otherwise(F.col("number")).alias("number"), "guarded", F.posexplode_outer(pieces(F.col("body"))).alias("i", "p"))
    kept = kept.select("*", F.col("p.lead").alias("lead"), F.col("p.n").alias("n")).drop("p").join(renamed, ["sample", "n"], "left")
    word = F.regexp_replace("lead", r"(?i)steps?\s*$", "")
    text = (
        F.when(F.col("n").isNull(), F.col("lead"))
        .when(F.col("guarded") | F.col("new").isNull(), F.concat("lead", F.col("n").cast("string")))
        .when(F.col("new") != F.col("number"), F.concat("lead", F.col("new").cast("string")))
        .when(F.col("number") > 1, F.concat("lead", (F.col("number") - 1).cast("string")))
        .when(F.col("lead").rlike(r"(?i)steps?\s*$"), F.concat(word, F.lit("this step")))
        .otherwise(F.concat("lead", F.col("n").cast("string")))
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", text.alias("t")))), lambda x: x["t"]), "")
    return kept.groupBy("sample", "step", "number").agg(body.alias("body"))


def deduplicated_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces without their repeated steps, renumbered (D-12)."""
    steps = cited_steps(spark, sf_dir)
    lines = F.array_sort(F.collect_list(F.struct("number", "body")))
    text = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("Step "), x["number"], F.lit(": "), x["body"])), "\n")
    return deduplicate(steps).groupBy("sample").agg(F.count("*").alias("n_steps"), F.md5(text.cast("binary")).alias("text_md5"))


def accepted_rewrite(c: Column, want: Column) -> Column:
    """Why a rewritten derivation is refused, or 'accepted' (LLM-07): it must hold steps, the wanted label once, no other and at
    the end, and cite two facts or earlier steps besides its own heads."""
    c = F.coalesce(c, F.lit(""))
    labels = F.transform(F.regexp_extract_all(c, F.lit("(?i)__(?:DIS)?PROVED__"), F.lit(0)), lambda x: F.upper(x))
    heads = F.size(F.regexp_extract_all(c, F.lit(r"(?m)^\s*\**\s*Step\s*(\d+)\s*\**\s*[:.\-]"), F.lit(0)))
    cites = F.regexp_count(c, F.lit(r"(?i)\b(?:fact|premise)s?\s*\d+")) + F.regexp_count(c, F.lit(r"\bStep\s*\d+\b")) - heads
    ends = F.regexp_replace(c, r"[\s.]+$", "").endswith(want)
    return F.when(heads == 0, "no steps").when((F.size(labels) != 1) | (F.get(labels, 0) != want), "labels").when(~ends, "label not last").when(cites < CITED, "uncited").otherwise("accepted")


def flips(label: Column, want: Column, cites: Column) -> Column:
    """Whether a recheck turns a verdict: it reached the wanted one and cites enough (LLM-07)."""
    return F.coalesce(label == want, F.lit(False)) & (cites >= CITED)


def recheck_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a recheck by what the gate says of them (LLM-07)."""
    k = F.col("l_linenumber")
    end = F.element_at(F.array(*map(F.lit, ("__PROVED__", "__DISPROVED__", "__PROVED__.\n", "__PROVED__ as said", "__PROVED__ and __PROVED__"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    cite = F.when(F.col("l_suppkey") % 3 == 0, "it holds").when(F.col("l_suppkey") % 3 == 1, "Fact 2 gives it").otherwise("Fact 2 and Step 1 give it")
    reply = F.concat(F.when(k % 2 == 0, F.concat(F.lit("Step "), k, F.lit(": "))).otherwise(F.lit("")), F.lit("Since fact 1, "), cite, F.lit(", so "), end)
    rows = table(spark, sf_dir, "lineitem").select(accepted_rewrite(reply, F.lit("__PROVED__")).alias("outcome"))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


def _problems(steps: DataFrame) -> DataFrame:
    return steps.withColumn("problem", F.floor(F.col("sample") / PROBLEM).cast("long"))


def consensus_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus graph of each problem (G-21): nodes and edges of its traces' union, edges that are heavy enough, and nodes that those leave alone."""
    steps = cited_steps(spark, sf_dir)
    edges = graph_edges(steps).join(F.broadcast(edge_weights(steps)), ["src", "dst"])  # one row a pair of step numbers or facts
    union = _problems(edges).groupBy("problem", "src", "dst").agg(F.max("w").alias("w"))
    ends = union.select("problem", F.explode(F.array("src", "dst")).alias("node"), (F.col("w") >= THETA).alias("strong")).groupBy("problem", "node").agg(F.max("strong").alias("linked"))
    nodes = ends.groupBy("problem").agg(F.count("*").alias("n_nodes"), F.count_if(~F.col("linked")).alias("n_isolated"))
    return union.groupBy("problem").agg(F.count("*").alias("n_edges"), F.count_if(F.col("w") >= THETA).alias("n_kept")).join(nodes, "problem")


def revoted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels voted anew from stored edges (G-20): a trace's vote, its last flag, weighs the mean weight of its edges in ten-thousandths; ties to the smaller flag."""
    steps = cited_steps(spark, sf_dir)
    weight = graph_edges(steps).join(F.broadcast(edge_weights(steps)), ["src", "dst"]).groupBy("sample").agg((F.sum(F.round(F.col("w") * 10_000).cast("long")) / F.count("*")).alias("w"))
    votes = steps.groupBy("sample").agg(F.max_by("l_returnflag", "step").alias("label")).join(weight, "sample")
    by_label = _problems(votes).groupBy("problem", "label").agg(F.round(F.sum("w"), 3).alias("w"))
    return by_label.groupBy("problem").agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("label"), F.max("w").alias("strength"))


def confidence_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step graphs without cycles, the least confident edges dropped first, on a cycle or not (G-05)."""

    edges = graph_edges(cited_steps(spark, sf_dir)).withColumn("confidence", F.round(F.lit(0.5) + F.pmod(F.xxhash64("src", "dst"), F.lit(97)) / 200, 4))
    return kept_edges(edges, "sample", "confidence", drop_weakest)


def aligned_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a problem's traces that are one node, by their words and the facts they cite, numbered by their mean relative place (G-09)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole(batches, "problem"):
            words = t.column("words").combine_chunks().dictionary_encode()
            sets = [frozenset(w.split()) for w in words.dictionary.to_pylist()]
            rows = list(zip(t.column("sample").to_pylist(), t.column("step").to_pylist(), map(sets.__getitem__, words.indices.to_pylist()), strict=True))
            at = t.column("problem").to_numpy()
            ends = [*(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(rows)]
            nodes = [n for a, b in zip([0, *ends], ends) for n in align_cited(rows[a:b])]  # noqa: B905
            yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks() for c in ("problem", "sample", "step")] + [pa.array(nodes, pa.int32())], ["problem", "sample", "step", "node"])

    steps = _problems(cited_steps(spark, sf_dir)).select("problem", "sample", "step", "body")
    words = F.array_join(F.array_sort(alignment_tokens(F.col("body"))), " ")
    texts = kept(steps.select(F.coalesce("body", F.lit("")).alias("body")).distinct().select("body", words.alias("words")))  # a body is read once, however many steps hold it
    weight = texts.agg(F.sum(64 + F.octet_length("body") + F.octet_length("words"))).first()[0] or 0
    steps = steps.withColumn("body", F.coalesce("body", F.lit(""))).join(near(texts, weight), "body").select("problem", "sample", "step", "words")
    return steps.repartition("problem").sortWithinPartitions("problem", "sample", "step").mapInArrow(run, "problem long, sample long, step long, node int")


QUERIES = {f.__name__: f for f in (citation_runs, deduplicated_traces, recheck_gate, consensus_graphs, revoted_labels, confidence_cycles, aligned_steps)}
_WEIGHTED = f"""{_CITED}, word AS (SELECT sample, 'Step' || step AS node, string_split(mode, ' ') AS ws FROM steps), ow AS (SELECT e.*, a.ws AS wa, b.ws AS wb FROM edges e JOIN word b ON b.sample = e.sample AND b.node = e.dst LEFT JOIN word a ON a.sample = e.sample AND a.node = e.src),
 we AS (SELECT src, dst, round(sum(0.7 * 0.6 + 0.3 * CASE WHEN wa IS NULL THEN 0 ELSE len(list_intersect(wa, wb))::DOUBLE / len(list_distinct(list_concat(wa, wb))) END) / (SELECT count(DISTINCT sample) FROM steps), 4) AS w FROM (SELECT DISTINCT ON (sample, src, dst) * FROM ow) GROUP BY 1, 2),
 u AS (SELECT DISTINCT sample, src, dst, w, sample // {PROBLEM} AS problem FROM edges JOIN we USING (src, dst))"""
ORACLES = {
    "citation_runs": "SELECT kind, cited, count(*) AS n FROM (SELECT l_partkey % 5 AS kind, unnest(CASE l_partkey % 5 WHEN 0 THEN [l_linenumber, l_partkey % 9 + 1, 3] WHEN 1 THEN [l_linenumber, l_partkey % 9 + 1, l_linenumber] WHEN 2 THEN [l_linenumber, l_partkey % 9 + 1] WHEN 3 THEN []::BIGINT[] ELSE [l_linenumber, l_partkey % 9 + 1, 4] END)::BIGINT AS cited FROM lineitem) GROUP BY kind, cited",
    "deduplicated_traces": f"""WITH {_CITED}, src AS (SELECT *, min(step) OVER (PARTITION BY sample, mode) AS o, max(step) OVER (PARTITION BY sample) AS top FROM steps), num AS (SELECT *, count(*) FILTER (o = step) OVER (PARTITION BY sample ORDER BY step) AS pos, bool_or(step = top AND o < step) OVER (PARTITION BY sample) AS same FROM src),
 ren AS (SELECT a.sample, a.step AS n, b.pos FROM num a JOIN num b ON b.sample = a.sample AND b.step = a.o),
 fin AS (SELECT k.sample, CASE WHEN same THEN k.step ELSE k.pos END AS no, same, k.pos, f1, s1, s2, mode, x.pos AS x, y.pos AS y FROM num k LEFT JOIN ren x ON x.sample = k.sample AND x.n = k.s1 LEFT JOIN ren y ON y.sample = k.sample AND y.n = k.s2 WHERE same OR o = k.step),
 txt AS (SELECT sample, no, concat('Step ', no, ': By ', CASE WHEN same OR x IS NULL THEN concat('Step ', s1) WHEN x <> no THEN concat('Step ', x) WHEN no > 1 THEN concat('Step ', no - 1) ELSE 'this step' END, ' and Fact ', f1,
  CASE WHEN s2 IS NULL THEN '' WHEN same THEN concat(' with step ', s2) WHEN y <> no THEN concat(' with step ', y) WHEN no > 1 THEN concat(' with step ', no - 1) ELSE ' with this step' END, ', it is ', mode) AS line FROM fin)
 SELECT sample, count(*) AS n_steps, md5(string_agg(line, chr(10) ORDER BY no)) AS text_md5 FROM txt GROUP BY sample""",
    "recheck_gate": "SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'no steps' WHEN l_partkey % 5 IN (1, 4) THEN 'labels' WHEN l_partkey % 5 = 3 THEN 'label not last' WHEN l_suppkey % 3 = 0 THEN 'uncited' ELSE 'accepted' END AS outcome, count(*) AS n FROM lineitem GROUP BY 1",
    "consensus_graphs": f"""WITH {_WEIGHTED}, g AS (SELECT problem, src, dst, max(w) AS w FROM u GROUP BY 1, 2, 3), v AS (SELECT problem, node, max(w) AS w FROM (SELECT problem, src AS node, w FROM g UNION ALL SELECT problem, dst, w FROM g) GROUP BY 1, 2)
 SELECT problem, n_edges, n_kept, n_nodes, n_isolated FROM (SELECT problem, count(*) AS n_edges, count(*) FILTER (w >= {THETA}) AS n_kept FROM g GROUP BY 1) JOIN (SELECT problem, count(*) AS n_nodes, count(*) FILTER (w < {THETA}) AS n_isolated FROM v GROUP BY 1) USING (problem)""",
    "revoted_labels": f"""WITH {_WEIGHTED}, t AS (SELECT sample, problem, sum(round(w * 10000)::BIGINT)::DOUBLE / count(*) AS w FROM u GROUP BY 1, 2), l AS (SELECT sample, l_returnflag AS label FROM steps QUALIFY row_number() OVER (PARTITION BY sample ORDER BY step DESC) = 1),
 b AS (SELECT problem, label, round(sum(w), 3) AS w FROM t JOIN l USING (sample) GROUP BY 1, 2) SELECT problem, label, w AS strength FROM b QUALIFY row_number() OVER (PARTITION BY problem ORDER BY w DESC, label) = 1""",
}
