"""Terms of steps: mathematical and logical tokens, equations that hold, consensus cores, quotas, hints and the step filter.

The driver's tables hold no traces, so two are made of them, as in ``steps.py``.  ``worked_steps``: every line of an order is
a step that multiplies, in one of four wordings, every third-class one wrongly; a supplier is a sample and an order one of
its traces.  ``argued_parts``: every part is a trace of its brand's sample.  Oracles build the tokens from the tables' numbers and
never parse a text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepforge.functions import equations
from stepforge.functions.words import ALIGN_STOP, COMMON_LOGICAL, LOGICAL, OVERLAP_STOP
from stepforge.plans.stage import discard, kept, near
from stepforge.sources.tables import table

ALPHA, BETA, GAMMA = 0.001, 0.05, -1.0
CORE, TOP, MIN_TF, MIN_IDF, TOP_K, SEMANTIC, HINT = 0.3, 20, 0.001, 0.1, 10, 0.3, 0.3


def worked_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, trace, step, body, kind)."""
    flag = F.col("l_returnflag")
    side = F.when(flag < "A", 0).when(flag == "A", 1).when(flag > "A", 2)  # the least flag is an A if the least side is 1; numbers are summed up by hash
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_quantity").alias("l_quantity"), F.min(side).alias("side"))  # a line number may stand twice
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    p = q * n + F.when(F.col("side") == 1, 1).otherwise(0)
    ways = [
        F.format_string("Multiply $%d \\cdot %d = %d$ to get the area of the garden", q, n, p),
        F.format_string("We substitute %d*%d = %d into the formula", n, q, p),
        F.format_string("So %d × %d = %d, hence $y + 3x = 7$ and 5 + %d*%d = 9", q, n, p, q, n),
        F.format_string("Consider the red garden and the price of $%d = 7", q),
    ]
    kind = (F.col("l_orderkey") + n) % 4
    return lines.select(F.col("l_suppkey").alias("sample"), F.col("l_orderkey").alias("trace"), n.cast("long").alias("step"), reduce(lambda c, i: c.when(kind == i, ways[i]), range(1, len(ways)), F.when(kind == 0, ways[0])).alias("body"), kind.alias("kind"))


_WORKED = """w AS (SELECT l_suppkey AS sample, l_orderkey AS trace, l_linenumber::BIGINT AS step, l_quantity::INT AS q, l_linenumber AS n, l_returnflag AS f, (l_orderkey + l_linenumber) % 4 AS kind, l_quantity::INT * l_linenumber + CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS p
  FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)),
m AS (SELECT *, concat('*(', least(q::VARCHAR, n::VARCHAR), ',', greatest(q::VARCHAR, n::VARCHAR), ')') AS prod FROM w),
e AS (SELECT *, concat('EQN:', least(prod, p::VARCHAR), '|', greatest(prod, p::VARCHAR)) AS eq FROM m),
tok AS (SELECT sample, trace, step, unnest(CASE kind WHEN 0 THEN ['MATH:' || eq, 'multiply', 'get', 'area', 'garden'] WHEN 1 THEN ['EQ:' || eq, 'substitute', 'formula']
  WHEN 2 THEN ['EQ:' || eq, 'MATH:EQN:+(*(3,x),y)|7', concat('EQ:EQN:+(', prod, ',5)|9'), 'hence', 'and'] ELSE ['consider', 'red', 'garden', 'and', 'price'] END) AS term FROM e)"""


def math_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each token of the mathematical tokeniser stands, and in how many traces (T-02, T-04, T-05, T-07)."""
    rows = worked_steps(spark, sf_dir).select("trace", F.explode(equations.math_tokens(F.col("body"))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("trace").alias("df"))


def equation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps whose closed equations all hold, one of which fails, or that have none, by wording; a price isn't the side of an equation (N-08, T-05)."""
    rows = worked_steps(spark, sf_dir).select("kind", equations.equations(F.col("body")).alias("found"))
    rows = rows.select("kind", F.size("found").alias("k"), equations.checked(F.col("found")).alias("ok"))
    return rows.groupBy("kind").agg(F.sum("k").alias("n_equations"), F.count_if(F.col("ok")).alias("n_hold"), F.count_if(~F.col("ok")).alias("n_fail"), F.count_if(F.col("ok").isNull()).alias("n_none"))


def _texts(steps: DataFrame) -> tuple[DataFrame, int]:
    """(text, body, holds, all, terms) of each distinct body, and their weight in bytes: terms has (id, c) for each distinct
    token and all their sum.  A body is tokenised once, however many steps hold it."""
    found = kept(steps.select("body").distinct().select(F.monotonically_increasing_id().alias("text"), "body", equations.math_tokens(F.col("body")).alias("t"), equations.checked(equations.equations(F.col("body"))).alias("holds")))
    words = kept(found.select(F.explode("t").alias("term")).distinct().select(F.monotonically_increasing_id().alias("id"), "term"))
    held = found.select("text", F.explode("t").alias("term")).groupBy("text", "term").agg(F.count("*").alias("c")).join(words, "term")
    held = held.groupBy("text").agg(F.collect_list(F.struct("id", "c")).alias("terms"))
    none = F.array().cast("array<struct<id:bigint,c:bigint>>")
    texts = kept(found.join(held, "text", "left").select("text", "body", "holds", F.size("t").alias("all"), F.coalesce("terms", none).alias("terms")))
    discard(found, words)
    return texts, texts.agg(F.sum(64 + F.octet_length("body") + 24 * F.size("terms"))).first()[0] or 0


def _core(placed: DataFrame, texts: DataFrame) -> tuple[DataFrame, int]:
    """(sample, core), and their weight in bytes: the terms of a sample whose mean frequency over its traces, times the log of
    how rare their steps are, is above ALPHA, and that stand in a share of BETA of its steps."""
    totals = kept(placed.groupBy("sample").agg(F.count("*").alias("n_steps"), F.count_if("new").alias("k")))
    used = placed.join(texts.select("text", "terms"), "text").select("sample", "all", F.explode("terms").alias("x"))
    tf = used.groupBy("sample", F.col("x.id").alias("id")).agg(F.sum(F.col("x.c") / F.col("all")).alias("tf"), F.count("*").alias("s"))
    rf = F.col("s") / F.col("n_steps")
    con = tf.join(near(totals, 24 * totals.count()), "sample").where((F.round(F.try_divide("tf", "k") * F.log(1 / rf), 9) > ALPHA) & (F.round(rf, 9) >= BETA))
    con = con.groupBy("sample").agg(F.collect_list("id").alias("core"))
    core = kept(totals.join(con, "sample", "left").select("sample", F.coalesce("core", F.array().cast("array<bigint>")).alias("core")))
    discard(totals)
    return core, core.agg(F.sum(64 + 8 * F.size("core"))).first()[0] or 0


def step_filter(steps: DataFrame) -> DataFrame:
    """The step filter of mathematical traces (N-05) over steps (sample, trace, step, body): a step's score is the Jaccard
    similarity of its tokens and its sample's consensus terms; with two scored steps and a spread, a step whose z-score is
    below GAMMA goes, unless its equations hold.

    What is kept between the passes is small: a row for each step with the number of its text, in the order of samples, so
    that sums by sample and term shrink before they are shuffled; then a row for each score of a sample.  Steps without
    a sample, and in the counts those without a trace or number, are left out.
    """
    steps = kept(steps.select("sample", "trace", "step", F.coalesce("body", F.lit("")).alias("body")))
    texts, weight = _texts(steps)
    trace = Window.partitionBy("sample", "trace")
    rows = steps.join(near(texts.select("text", "body", F.col("all").alias("own")), weight), "body").repartitionByRange("sample", "trace")
    rows = rows.withColumns({"all": F.sum("own").over(trace), "place": F.row_number().over(trace.orderBy("step"))})
    named = F.col("trace").isNotNull()
    placed = kept(rows.select("sample", "text", "all", (named & (F.col("place") == 1)).alias("new"), (named & F.col("step").isNotNull()).alias("named")))
    discard(steps)
    texts = near(texts, weight)
    core, weight = _core(placed, texts)
    both, ids = F.size(F.array_intersect("core", "ids")), F.size("ids")
    scored = placed.join(near(core, weight), "sample").join(texts.select("text", "holds", F.col("terms.id").alias("ids")), "text").where(ids > 0)
    scored = scored.select("sample", "holds", "named", F.round(both / (ids + F.size("core") - both), 9).alias("score"))
    scores = kept(scored.groupBy("sample", "holds", "score").agg(F.count("*").alias("n"), F.count_if("named").alias("m")))
    discard(placed, core)
    own, n = Window.partitionBy("sample"), F.col("n")
    out = scores.withColumn("all", F.sum(n).over(own)).withColumn("mu", F.sum(n * F.col("score")).over(own) / F.col("all"))
    out = out.withColumn("sd", F.sqrt(F.sum(n * (F.col("score") - F.col("mu")) * (F.col("score") - F.col("mu"))).over(own) / F.col("all")))
    low = (F.col("all") > 1) & (F.col("sd") > 1e-12) & (F.round((F.col("score") - F.col("mu")) / F.col("sd"), 6) < GAMMA)
    out = out.select("sample", "m", low.alias("low"), (low & ~F.coalesce("holds", F.lit(False))).alias("gone"))
    counts = {"n_scored": F.lit(True), "n_low": F.col("low"), "n_dropped": F.col("gone")}
    return out.groupBy("sample").agg(*(F.sum(F.when(c, F.col("m")).otherwise(0)).alias(k) for k, c in counts.items())).where("n_scored > 0")


def math_step_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mathematical step filter over worked steps, by sample."""
    return step_filter(worked_steps(spark, sf_dir))


def argued_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, trace, body)."""
    says = F.element_at(F.array(*map(F.lit, ("Hence it is equal to", "Assume that", "Thus we infer from", "First, but then", "The premise is"))), F.col("p_size") % 5 + 1)
    body = F.concat(says, F.lit(" Is_big("), F.col("p_size").cast("string"), F.lit(") and ¬Red(X): a "), "p_name", F.lit(" well-known as "), "p_type")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("sample"), F.col("p_partkey").alias("trace"), body.alias("body"))


_ARGUED = """tok AS (SELECT p_brand AS sample, p_partkey AS trace, unnest(list_concat(list_concat(list_concat([['hence', 'equal'], ['assume'], ['thus', 'infer'], ['first', 'but', 'then'], ['premise']][p_size % 5 + 1],
  ['LOGIC:is_big(' || p_size || ')', 'LOGIC:¬red(x)', 'and', 'well-known']), string_split(lower(p_name), ' ')), string_split(lower(p_type), ' '))) AS term FROM part)"""


def logic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each token of the logical tokeniser stands, and in how many traces (T-01)."""
    rows = argued_parts(spark, sf_dir).select("trace", F.explode(equations.logical_tokens(F.col("body"))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("trace").alias("df"))


def important_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample's TOP_K terms by mean frequency over its traces times rarity over all traces (T-10, T-11): words that argue
    take 30 % of the places, and first; common words, and terms under the least frequency or rarity, go; ties by term."""
    docs = argued_parts(spark, sf_dir).select("sample", "trace", equations.logical_tokens(F.col("body")).alias("t"))
    counts = docs.select("sample", "trace", F.size("t").alias("all"), F.explode("t").alias("term")).groupBy("sample", "trace", "all", "term").agg(F.count("*").alias("c"))
    by_sample = counts.groupBy("sample", "term").agg(F.sum(F.col("c") / F.col("all")).alias("tf"), F.count("*").alias("df"))
    k = docs.groupBy("sample").agg(F.count("*").alias("k"))
    total = F.broadcast(docs.agg(F.count("*").alias("n")))  # one row
    df = by_sample.groupBy("term").agg(F.sum("df").alias("docs"))
    tf, idf = F.col("tf") / F.col("k"), F.log(F.col("n") / F.col("docs"))
    scored = by_sample.drop("df").join(k, "sample").join(df, "term").crossJoin(total)
    common = set(COMMON_LOGICAL)
    scored = scored.where((tf >= MIN_TF) & (idf >= MIN_IDF) & ~F.col("term").isin(*COMMON_LOGICAL))
    scored = scored.select("sample", "term", F.round(tf * idf, 9).alias("score"), F.col("term").isin([w for w in LOGICAL if w not in common]).alias("semantic"))
    quota = max(1, int(TOP_K * SEMANTIC))
    place = F.row_number().over(Window.partitionBy("sample", "semantic").orderBy(F.desc("score"), "term"))
    return scored.withColumn("place", place.cast("long")).where(F.when(F.col("semantic"), F.col("place") <= quota).otherwise(F.col("place") <= TOP_K - quota))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, step, term, c, all, i): conversations are samples and their turns steps; i is where a term stands first."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    own = F.filter(words, lambda w: w.rlike("^[a-z]{3,}$"))
    rows = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("conv_id").alias("sample"), F.col("turn").alias("step"), F.size(own).alias("all"), F.explode(own).alias("term"))
    return rows.groupBy("sample", "step", "term").agg(F.count("*").alias("c"), F.max("all").alias("all"))


_TURNS = r"""tok AS (SELECT conv_id AS sample, turn AS step, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{3,}'))) AS term FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)"""


def legacy_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in at least CORE of the steps' sets of TOP terms by frequency in the step times rarity over the sample's steps (T-12, T-15)."""
    t = _turns(spark, sf_dir)
    steps = t.select("sample", "step").distinct().groupBy("sample").agg(F.count("*").alias("n"))
    df = t.groupBy("sample", "term").agg(F.count("*").alias("df"))
    scored = t.join(df, ["sample", "term"]).join(steps, "sample").withColumn("score", F.round(F.col("c") / F.col("all") * F.log(F.col("n") / F.col("df")), 9))
    place = F.row_number().over(Window.partitionBy("sample", "step").orderBy(F.desc("score"), "term"))
    top = scored.withColumn("place", place).where(F.col("place") <= TOP)
    return top.groupBy("sample", "n", "term").agg(F.count("*").alias("held")).where(F.col("held") / F.col("n") >= CORE).select("sample", "term", "held")


def hint_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each step number, the terms that at least 30 % of the traces use there, at least one, the first TOP by traces (T-17)."""
    t = _turns(spark, sf_dir)
    traces = t.groupBy("step").agg(F.count_distinct("sample").alias("k"))
    used = t.groupBy("step", "term").agg(F.count("*").alias("frequency"))
    kept = used.join(traces, "step").where(F.col("frequency") >= F.greatest(F.lit(1), F.floor(F.col("k") * HINT)))
    place = F.row_number().over(Window.partitionBy("step").orderBy(F.desc("frequency"), "term"))
    return kept.withColumn("place", place.cast("long")).where(F.col("place") <= TOP).select("step", "term", "frequency", "place")


def overlap_tokens(c: Column) -> Column:
    """Distinct words of three ASCII letters or more that aren't stop words (T-19)."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin(*OVERLAP_STOP)))


def alignment_tokens(c: Column) -> Column:
    """Distinct tokens by which steps of traces are matched (T-20): cited facts, words of three letters or more and numbers; step numbers go."""
    text = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\bstep\s*\d+\s*:?", " "))
    cited = F.transform(F.regexp_extract_all(text, F.lit(r"\bfact\s*(\d+)"), F.lit(1)), lambda n: F.concat(F.lit("fact"), n))
    rest = F.regexp_extract_all(F.regexp_replace(text, r"\bfact\s*\d+", " "), F.lit(r"[a-z]{3,}|\d+(?:\.\d+)?"), F.lit(0))
    return F.array_distinct(F.concat(cited, F.filter(rest, lambda w: ~w.isin(*ALIGN_STOP))))


def neighbour_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the words of each turn with those of the turn before it; 0 where one has none (N-03, T-19)."""
    rows = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", overlap_tokens(F.col("text")).alias("a"))
    rows = rows.withColumn("b", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(F.coalesce(F.try_divide(F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))), F.lit(0.0)), 6).alias("overlap"))


def matched_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each alignment token stands in steps that cite facts and steps (T-20)."""
    body = F.concat(F.lit("Step "), "l_linenumber", F.lit(": From step 3 and Fact "), F.col("l_suppkey") % 5 + 1, F.lit(", the "), F.lit("total"), F.lit(" is "), F.col("l_quantity").cast("int"), F.lit(".5 since fact 9 holds"))
    rows = table(spark, sf_dir, "lineitem").select(F.explode(alignment_tokens(body)).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (math_tokens, equation_checks, math_step_filter, logic_tokens, important_terms, legacy_core, hint_terms, neighbour_overlap, matched_tokens)}
_SEMANTIC = ", ".join(f"'{w}'" for w in LOGICAL if w not in set(COMMON_LOGICAL))
_COMMON = ", ".join(f"'{w}'" for w in COMMON_LOGICAL)
_OVERLAP = ", ".join(f"'{w}'" for w in OVERLAP_STOP)
ORACLES = {
    "math_tokens": f"WITH {_WORKED} SELECT term, count(*) AS n, count(DISTINCT trace) AS df FROM tok GROUP BY term",
    "equation_checks": f"""WITH {_WORKED} SELECT kind, sum(CASE kind WHEN 2 THEN 3 WHEN 3 THEN 0 ELSE 1 END)::BIGINT AS n_equations, count(*) FILTER (kind < 2 AND f <> 'A' OR kind = 2 AND f <> 'A' AND q * n = 4) AS n_hold,
  count(*) FILTER (kind < 2 AND f = 'A' OR kind = 2 AND (f = 'A' OR q * n <> 4)) AS n_fail, count(*) FILTER (kind = 3) AS n_none FROM w GROUP BY kind""",
    "math_step_filter": f"""WITH {_WORKED}, t AS (SELECT sample, trace, step, term, count(*) AS c FROM tok GROUP BY ALL), size AS (SELECT sample, count(*) AS n_steps, count(DISTINCT trace) AS k FROM w GROUP BY 1),
 tf AS (SELECT DISTINCT sample, trace, term, sum(c) OVER (PARTITION BY sample, trace, term)::DOUBLE / sum(c) OVER (PARTITION BY sample, trace) AS tf FROM t),
 held AS (SELECT sample, term, count(*)::DOUBLE AS s FROM t GROUP BY 1, 2), con AS (SELECT a.sample, a.term FROM (SELECT sample, term, sum(tf) AS tf FROM tf GROUP BY 1, 2) a JOIN held USING (sample, term) JOIN size USING (sample)
  WHERE round(tf / k * ln(n_steps / s), 9) > {ALPHA} AND round(s / n_steps, 9) >= {BETA}),
 s AS (SELECT t.sample, t.trace, t.step, count(*) AS n, count(*) FILTER ((t.sample, t.term) IN (SELECT sample, term FROM con)) AS b FROM t GROUP BY 1, 2, 3),
 x AS (SELECT s.*, round(b::DOUBLE / (n + (SELECT count(*) FROM con WHERE con.sample = s.sample) - b), 9) AS score FROM s),
 z AS (SELECT *, avg(score) OVER v AS mu, stddev_pop(score) OVER v AS sd, count(*) OVER v AS m FROM x WINDOW v AS (PARTITION BY sample)),
 g AS (SELECT z.*, m > 1 AND sd > 1e-12 AND round((score - mu) / sd, 6) < {GAMMA} AS low FROM z)
 SELECT sample, count(*) AS n_scored, count(*) FILTER (low) AS n_low, count(*) FILTER (low AND NOT (w.kind < 2 AND w.f <> 'A' OR w.kind = 2 AND w.f <> 'A' AND w.q * w.n = 4)) AS n_dropped FROM g JOIN w USING (sample, trace, step) GROUP BY sample""",
    "logic_tokens": f"WITH {_ARGUED} SELECT term, count(*) AS n, count(DISTINCT trace) AS df FROM tok GROUP BY term",
    "important_terms": f"""WITH {_ARGUED}, d AS (SELECT sample, term, trace, count(*)::DOUBLE / any_value(a) AS tf FROM (SELECT *, count(*) OVER (PARTITION BY trace) AS a FROM tok) GROUP BY ALL),
 m AS (SELECT sample, term, sum(tf) / (SELECT count(*) FROM part WHERE p_brand = sample) AS tf FROM d GROUP BY 1, 2), i AS (SELECT term, ln((SELECT count(*) FROM part)::DOUBLE / count(DISTINCT trace)) AS idf FROM d GROUP BY 1),
 r AS (SELECT sample, term, round(tf * idf, 9) AS score, term IN ({_SEMANTIC}) AS semantic FROM m JOIN i USING (term) WHERE tf >= {MIN_TF} AND idf >= {MIN_IDF} AND term NOT IN ({_COMMON}))
 SELECT *, row_number() OVER (PARTITION BY sample, semantic ORDER BY score DESC, term) AS place FROM r QUALIFY place <= CASE WHEN semantic THEN 3 ELSE 7 END""",
    "legacy_core": f"""WITH {_TURNS}, t AS (SELECT sample, step, term, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY sample, step) AS tf FROM tok GROUP BY 1, 2, 3), n AS (SELECT sample, count(DISTINCT step) AS n FROM tok GROUP BY 1),
 s AS (SELECT t.*, n, round(tf * ln(n::DOUBLE / count(*) OVER (PARTITION BY t.sample, term)), 9) AS score FROM t JOIN n USING (sample)), top AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY sample, step ORDER BY score DESC, term) <= {TOP})
 SELECT sample, term, count(*) AS held FROM top GROUP BY sample, term HAVING count(*)::DOUBLE / any_value(n) >= {CORE}""",
    "hint_terms": f"""WITH {_TURNS}, u AS (SELECT step, term, count(DISTINCT sample) AS frequency FROM tok GROUP BY 1, 2), k AS (SELECT step, greatest(1, floor(count(DISTINCT sample) * {HINT})) AS least_n FROM tok GROUP BY 1)
 SELECT step, term, frequency, row_number() OVER (PARTITION BY step ORDER BY frequency DESC, term) AS place FROM u JOIN k USING (step) WHERE frequency >= least_n QUALIFY place <= {TOP}""",
    "neighbour_overlap": rf"""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN ({_OVERLAP}))) AS a FROM conversations),
 p AS (SELECT *, lag(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w WHERE conv_id IS NOT NULL AND turn IS NOT NULL), c AS (SELECT conv_id, turn, len(list_intersect(a, b)) AS s, len(a) + len(b) AS n FROM p WHERE b IS NOT NULL)
 SELECT conv_id, turn, CASE WHEN n = s THEN 0.0 ELSE round(s::DOUBLE / (n - s), 6) END AS overlap FROM c""",
    "matched_tokens": "SELECT token, count(*) AS n FROM (SELECT DISTINCT ON (r, token) token FROM (SELECT row_number() OVER () AS r, unnest(['fact' || (l_suppkey % 5 + 1), 'fact9', 'total', l_quantity::INT || '.5', 'holds']) AS token FROM lineitem)) GROUP BY token",
}
