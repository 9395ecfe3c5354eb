"""Named queries of the trace engine, declared once as SQL and run by Spark or checked by DuckDB.

A query is a chain of common table expressions over the driver's tables: a source is a sample, a document one of its
traces, a non-blank line a step.  Only the dialects' ways to split text differ; they are in ``PRELUDE``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stepforge.plans import texts
from stepforge.plans.stage import once

#: Function words that carry no term.
STOP = "the of and to in is that for on with as was be by it an or at from this are not have has de la le der die und et en el que"
ALPHA, BETA, GAMMA, THETA, LAMBDA = 0.001, 0.1, -1.0, 0.02, 0.3

_WORDS = tuple(STOP.split())
_STOP = ", ".join(f"'{w}'" for w in _WORDS)
PRELUDE = {
    "spark": {
        "lines": r"lines AS (SELECT source AS sample, doc_id AS trace, CAST(p AS BIGINT) AS pos, trim(s) AS step FROM {documents} LATERAL VIEW posexplode(split(text, '\n')) x AS p, s WHERE trim(s) <> '')",
        "tokens": r"tokens AS (SELECT sample, trace, pos, CAST(i AS BIGINT) AS i, term FROM lines LATERAL VIEW posexplode(regexp_extract_all(lower(step), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+', 0)) x AS i, term)",
    },
    "duckdb": {
        "lines": r"lines AS (SELECT source AS sample, doc_id AS trace, CAST(p AS BIGINT) AS pos, trim(s) AS step FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM {documents}) WHERE trim(s) <> '')",
        "tokens": r"tokens AS (SELECT sample, trace, pos, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS i, unnest(t) AS term FROM (SELECT sample, trace, pos, regexp_extract_all(lower(step), '[\p{{L}}\p{{M}}\p{{N}}_]+') AS t FROM lines))",
    },
}
#: Terms: ASCII words of two letters or more that aren't stop words.
_TERMS = f"terms AS (SELECT sample, trace, pos, i, term FROM tokens WHERE regexp_like(term, '^[a-z0-9]{{{{2,}}}}$') AND term NOT IN ({_STOP}))"
_STEPSETS = "stepterms AS (SELECT sample, trace, pos, term, count(*) AS c FROM terms GROUP BY sample, trace, pos, term)"
_TCON = f"""
nsteps AS (SELECT sample, count(*) AS n_steps, count(DISTINCT trace) AS k FROM lines GROUP BY sample),
tracetf AS (SELECT sample, trace, term, sum(c) * 1e0 / sum(sum(c)) OVER (PARTITION BY sample, trace) AS tf FROM stepterms GROUP BY sample, trace, term),
weights AS (SELECT t.sample, t.term, t.tf / n.k AS tf, r.s * 1e0 / n.n_steps AS rf FROM (SELECT sample, term, sum(tf) AS tf FROM tracetf GROUP BY sample, term) t
  JOIN (SELECT sample, term, count(*) AS s FROM stepterms GROUP BY sample, term) r ON r.sample = t.sample AND r.term = t.term JOIN nsteps n ON n.sample = t.sample),
tcon AS (SELECT sample, term, tf, rf, tf * ln(1e0 / rf) AS w FROM weights WHERE tf * ln(1e0 / rf) > {ALPHA} AND rf >= {BETA})"""
_SCORES = f"""
ncon AS (SELECT sample, count(*) AS n_con FROM tcon GROUP BY sample),
shared AS (SELECT s.sample, s.trace, s.pos, count(*) AS n, count(t.term) AS both_n FROM stepterms s LEFT JOIN tcon t ON t.sample = s.sample AND t.term = s.term GROUP BY s.sample, s.trace, s.pos),
scored AS (SELECT s.sample, s.trace, s.pos, s.both_n * 1e0 / (s.n + coalesce(c.n_con, 0) - s.both_n) AS score FROM shared s LEFT JOIN ncon c ON c.sample = s.sample),
spread AS (SELECT sample, avg(score) AS mu, stddev_pop(score) AS sd FROM scored GROUP BY sample),
z AS (SELECT s.sample, s.trace, s.pos, round(s.score, 9) AS score, m.mu, m.sd FROM scored s JOIN spread m ON m.sample = s.sample),
lastpos AS (SELECT sample, trace, max(pos) AS lastp FROM lines GROUP BY sample, trace),
flags AS (SELECT z.sample, z.trace, z.pos, z.score, CASE WHEN sd > 1e-12 AND round((z.score - mu) / sd, 6) < {GAMMA} AND z.pos < l.lastp THEN 1 ELSE 0 END AS dropped
  FROM z JOIN lastpos l ON l.sample = z.sample AND l.trace = z.trace)"""
_LABELLED = "labelled AS (SELECT d.doc_id, d.source, d.lang, l.quality AS truth, CASE WHEN d.n_chars IS NULL OR d.n_chars < 40 THEN NULL WHEN d.n_chars >= 600 THEN 1 ELSE 0 END AS pred FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL)"
_EDGES = f"""
seq AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM {{events}}),
used AS (SELECT user_id, src, dst, count(*) AS n FROM seq WHERE dst IS NOT NULL AND src <> dst GROUP BY user_id, src, dst),
total AS (SELECT user_id, sum(n) AS n FROM used GROUP BY user_id),
conf AS (SELECT u.user_id, u.src, u.dst, (1 - {LAMBDA}) * u.n / t.n + {LAMBDA} * CASE WHEN substr(u.src, 1, 1) = substr(u.dst, 1, 1) THEN 1e0 ELSE 0e0 END AS ws FROM used u JOIN total t ON t.user_id = u.user_id),
kall AS (SELECT count(DISTINCT user_id) AS k FROM {{events}}),
edge AS (SELECT src, dst, sum(ws) / max(k) AS w, count(*) AS frequency FROM conf CROSS JOIN kall GROUP BY src, dst)"""
_VERIFIER = "steps AS (SELECT l_orderkey AS idx, l_linenumber AS step, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS ok, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS says FROM {lineitem})"
_ITEMS = """
items AS (SELECT idx, sum(ok * says) AS tp, sum((1 - ok) * says) AS fp, sum((1 - ok) * (1 - says)) AS tn, sum(ok * (1 - says)) AS fn, count(*) AS n, min(CASE WHEN ok = 0 THEN step END) AS first_error FROM steps GROUP BY idx),
pr AS (SELECT i.*, CASE WHEN tp + fp > 0 THEN tp * 1e0 / (tp + fp) ELSE -1e0 END AS p, CASE WHEN tp + fn > 0 THEN tp * 1e0 / (tp + fn) ELSE -1e0 END AS r FROM items i)"""
_PAIRS = "pairs AS (SELECT user_id, avg(CASE WHEN event_type = 'click' THEN value END) AS a, avg(CASE WHEN event_type = 'view' THEN value END) AS b FROM {events} GROUP BY user_id), d AS (SELECT user_id, a, b, round(a - b, 9) AS diff FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL)"

#: name: (names from the prelude, common table expressions, final select)
QUERIES: dict[str, tuple[str, str, str]] = {
    "step_split_counts": ("lines tokens", "", "SELECT d.doc_id, coalesce(s.n, 0) AS n_steps, coalesce(t.n, 0) AS n_tokens FROM {documents} d LEFT JOIN (SELECT trace, count(*) AS n FROM lines GROUP BY trace) s ON s.trace = d.doc_id LEFT JOIN (SELECT trace, count(*) AS n FROM tokens GROUP BY trace) t ON t.trace = d.doc_id"),
    "token_doc_freq": ("lines tokens", _TERMS, "SELECT term, count(*) AS n, count(DISTINCT trace) AS df FROM terms GROUP BY term"),
    "idf_variants": ("lines tokens", _TERMS + ", nd AS (SELECT count(DISTINCT trace) AS n FROM terms), df AS (SELECT term, count(DISTINCT trace) AS df FROM terms GROUP BY term)", "SELECT term, df, round(ln(n * 1e0 / df), 6) AS idf, round(ln(n * 1e0 / df) / ln(n * 1e0), 6) AS idf_scaled, 1e0 AS idf_flat FROM df CROSS JOIN nd"),
    "tfidf_topk_per_sample": ("lines tokens", _TERMS + ", " + _STEPSETS + ", nd AS (SELECT count(DISTINCT trace) AS n FROM terms), df AS (SELECT term, count(DISTINCT trace) AS df FROM terms GROUP BY term), tt AS (SELECT sample, trace, term, sum(c) * 1e0 / sum(sum(c)) OVER (PARTITION BY sample, trace) AS tf FROM stepterms GROUP BY sample, trace, term), kk AS (SELECT sample, count(DISTINCT trace) AS k FROM terms GROUP BY sample), w AS (SELECT t.sample, t.term, round(sum(t.tf) / max(k.k) * ln(max(nd.n) * 1e0 / max(df.df)), 9) AS w FROM tt t JOIN df ON df.term = t.term JOIN kk k ON k.sample = t.sample CROSS JOIN nd GROUP BY t.sample, t.term), r AS (SELECT sample, term, w, row_number() OVER (PARTITION BY sample ORDER BY w DESC, term) AS rnk FROM w)", "SELECT sample, term, w, CAST(rnk AS BIGINT) AS rnk FROM r WHERE rnk <= 20"),
    "step_terms_top20": ("lines tokens", _TERMS + ", " + _STEPSETS + ", ns AS (SELECT sample, count(*) AS n FROM lines GROUP BY sample), sf AS (SELECT sample, term, count(*) AS s FROM stepterms GROUP BY sample, term), w AS (SELECT t.sample, t.trace, t.pos, t.term, round(t.c * 1e0 / sum(t.c) OVER (PARTITION BY t.trace, t.pos) * ln(ns.n * 1e0 / sf.s), 9) AS w FROM stepterms t JOIN sf ON sf.sample = t.sample AND sf.term = t.term JOIN ns ON ns.sample = t.sample), r AS (SELECT trace, pos, term, w, row_number() OVER (PARTITION BY trace, pos ORDER BY w DESC, term) AS rnk FROM w)", "SELECT trace, pos, term, w, CAST(rnk AS BIGINT) AS rnk FROM r WHERE rnk <= 20"),
    "consensus_terms": ("lines tokens", _TERMS + ", " + _STEPSETS + ", " + _TCON, "SELECT sample, term, round(tf, 9) AS tf, round(rf, 9) AS rf, round(w, 9) AS w FROM tcon"),
    "terms_by_position": ("lines tokens", _TERMS + ", place AS (SELECT sample, trace, pos, row_number() OVER (PARTITION BY trace ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY trace) AS n FROM lines), b AS (SELECT p.sample, p.trace, p.pos, CASE WHEN n > 1 THEN least(CAST(floor(i * 10e0 / (n - 1)) AS BIGINT), 9) ELSE 0 END AS bucket FROM place p)", "SELECT b.bucket, t.term, count(*) AS n, count(DISTINCT t.trace) AS traces FROM terms t JOIN b ON b.trace = t.trace AND b.pos = t.pos GROUP BY b.bucket, t.term"),
    "step_zscore_filter": ("lines tokens", _TERMS + ", " + _STEPSETS + ", " + _TCON + ", " + _SCORES, "SELECT sample, count(*) AS n_scored, sum(dropped) AS n_dropped, round(avg(score), 6) AS mean_score FROM flags GROUP BY sample"),
    "filter_stats": ("lines tokens", _TERMS + ", " + _STEPSETS + ", " + _TCON + ", " + _SCORES + ", per AS (SELECT l.sample, l.trace, count(*) AS before, count(*) - coalesce(sum(f.dropped), 0) AS after FROM lines l LEFT JOIN flags f ON f.trace = l.trace AND f.pos = l.pos GROUP BY l.sample, l.trace)", "SELECT sample, count(*) AS n_traces, round(avg(before), 6) AS mean_before, round(avg(after), 6) AS mean_after, round(stddev_pop(before), 6) AS std_before, round(stddev_pop(after), 6) AS std_after, CAST(sum(before - after) AS BIGINT) AS removed FROM per GROUP BY sample"),
    "underthinking_traces": ("lines", "per AS (SELECT sample, trace, count(*) AS n FROM lines GROUP BY sample, trace), cons AS (SELECT sample, avg(n) AS m FROM per GROUP BY sample)", "SELECT p.sample, p.trace, p.n FROM per p JOIN cons c ON c.sample = p.sample WHERE (c.m - p.n) / c.m > 0.3"),
    "embedding_centroid_alignment": ("", "", ""),
    "transition_edges": ("", "seq AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM {events})", "SELECT src, dst, count(*) AS frequency FROM seq WHERE dst IS NOT NULL GROUP BY src, dst"),
    "consensus_edge_weights": ("", _EDGES, f"SELECT src, dst, round(w, 6) AS w, frequency, CASE WHEN w >= {THETA} THEN 1 ELSE 0 END AS kept FROM edge"),
    "isolated_nodes": ("", _EDGES + f", kept AS (SELECT src, dst FROM edge WHERE w >= {THETA}), touched AS (SELECT src AS node FROM kept UNION SELECT dst FROM kept)", "SELECT DISTINCT e.event_type AS node, CASE WHEN t.node IS NULL THEN 1 ELSE 0 END AS isolated FROM {events} e LEFT JOIN touched t ON t.node = e.event_type"),
    "node_text_vote": ("", "v AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first_pos FROM {documents} GROUP BY source, lang), r AS (SELECT source, lang, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, first_pos) AS rk FROM v)", "SELECT source, lang, n FROM r WHERE rk = 1"),
    "majority_vote_ties": ("", "v AS (SELECT d.source, d.lang, l.quality, count(*) AS n, min(d.doc_id) AS first_pos FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id GROUP BY d.source, d.lang, l.quality), r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n DESC, first_pos) AS rk FROM v)", "SELECT source, lang, quality, n FROM r WHERE rk = 1"),
    "weighted_vote_strength": ("", "v AS (SELECT d.source, l.quality, sum(1e0 / (1 + abs(d.n_chars - 2000) / 1000e0)) AS w FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id GROUP BY d.source, l.quality), r AS (SELECT *, sum(w) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY w DESC, quality) AS rk FROM v)", "SELECT source, quality, round(w / total, 6) AS strength FROM r WHERE rk = 1"),
    "accuracy_overall": ("", _LABELLED, "SELECT count(*) AS n, sum(CASE WHEN pred IS NOT NULL THEN 1 ELSE 0 END) AS n_answered, round(avg(CASE WHEN pred = truth THEN 1e0 ELSE 0e0 END), 4) AS accuracy FROM labelled"),
    "accuracy_by_group": ("", _LABELLED, "SELECT coalesce(source, 'total') AS source, count(*) AS n, round(avg(CASE WHEN pred = truth THEN 1e0 ELSE 0e0 END), 4) AS accuracy FROM labelled GROUP BY ROLLUP(source)"),
    "confusion_matrix": ("", _LABELLED, "SELECT truth, sum(CASE WHEN pred = 1 THEN 1 ELSE 0 END) AS pred_1, sum(CASE WHEN pred = 0 THEN 1 ELSE 0 END) AS pred_0, sum(CASE WHEN pred IS NULL THEN 1 ELSE 0 END) AS pred_none FROM labelled GROUP BY truth"),
    "macro_f1": ("", _LABELLED + ", cls AS (SELECT c.truth AS cls, sum(CASE WHEN l.truth = c.truth AND l.pred = c.truth THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN l.truth <> c.truth AND l.pred = c.truth THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN l.truth = c.truth AND (l.pred IS NULL OR l.pred <> c.truth) THEN 1 ELSE 0 END) AS fn FROM labelled l CROSS JOIN (SELECT 0 AS truth UNION ALL SELECT 1) c GROUP BY c.truth), f AS (SELECT cls, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2e0 * tp / (2 * tp + fp + fn), 4) ELSE 0e0 END AS f1 FROM cls)", "SELECT max(CASE WHEN cls = 0 THEN f1 END) AS f1_0, max(CASE WHEN cls = 1 THEN f1 END) AS f1_1, round(avg(f1), 4) AS macro_f1 FROM f"),
    "ablation_delta_paired": ("", "a AS (SELECT l.doc_id, CASE WHEN d.n_chars >= 600 AND l.quality = 1 OR d.n_chars < 600 AND l.quality = 0 THEN 1e0 ELSE 0e0 END AS full_hit, CASE WHEN l.quality = 1 THEN 1e0 ELSE 0e0 END AS base_hit FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id)", "SELECT count(*) AS n, round((avg(full_hit) - avg(base_hit)) * 100, 1) AS delta FROM a"),
    "verifier_step_confusion": ("", _VERIFIER, "SELECT CAST(sum(ok * says) AS BIGINT) AS tp, CAST(sum((1 - ok) * says) AS BIGINT) AS fp, CAST(sum((1 - ok) * (1 - says)) AS BIGINT) AS tn, CAST(sum(ok * (1 - says)) AS BIGINT) AS fn FROM steps"),
    "verifier_item_metrics": ("", _VERIFIER + ", " + _ITEMS, "SELECT idx, CAST(n AS BIGINT) AS n_steps, round((tp + tn) * 1e0 / n, 4) AS step_acc, round(p, 4) AS p, round(r, 4) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE -1e0 END, 4) AS f1, first_error FROM pr"),
    "verifier_dimension_rollup": ("", _VERIFIER + ", " + _ITEMS, "SELECT coalesce(o.o_orderpriority, 'total') AS dimension, count(*) AS n_items, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fn) AS BIGINT) AS fn, round(sum(tp + tn) * 1e0 / sum(n), 4) AS acc FROM pr JOIN {orders} o ON o.o_orderkey = pr.idx GROUP BY ROLLUP(o.o_orderpriority)"),
    "paired_mean_diff": ("", _PAIRS, "SELECT count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(diff), 6) AS diff, round(avg(diff) / (stddev_samp(diff) + 1e-12), 6) AS paired_d FROM d"),
    "wilcoxon_signed_rank": ("", _PAIRS + ", nz AS (SELECT diff, abs(diff) AS m FROM d WHERE diff <> 0), grp AS (SELECT m, count(*) AS t, sum(CASE WHEN diff > 0 THEN 1 ELSE 0 END) AS plus FROM nz GROUP BY m), cum AS (SELECT m, t, plus, sum(t) OVER (ORDER BY m) - t + (t + 1) / 2e0 AS rk FROM grp), s AS (SELECT sum(t) AS n, sum(plus * rk) AS rp, sum((t - plus) * rk) AS rm, sum(t * t * t - t) AS ties FROM cum)", "SELECT CAST(n AS BIGINT) AS n, round(least(rp, rm), 4) AS t_stat, round(abs(least(rp, rm) - n * (n + 1) / 4e0) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2e0) / 24e0), 6) AS z FROM s"),
    "verbatim_dedup_first": ("lines", "k AS (SELECT trace, pos, step, row_number() OVER (PARTITION BY trace, step ORDER BY pos) AS rk FROM lines WHERE length(step) >= 25)", "SELECT trace, count(*) AS n_lines, sum(CASE WHEN rk > 1 THEN 1 ELSE 0 END) AS n_dropped FROM k GROUP BY trace"),
    "verbatim_dedup_last": ("lines", "k AS (SELECT trace, pos, row_number() OVER (PARTITION BY trace, step ORDER BY pos DESC) AS rk FROM lines WHERE length(step) >= 25)", "SELECT trace, pos FROM k WHERE rk > 1"),
    "repeated_lead_lag": ("lines tokens", ", ".join(["heads AS (SELECT trace, pos, max(CASE WHEN i = 0 THEN term END) AS t0, max(CASE WHEN i = 1 THEN term END) AS t1 FROM tokens GROUP BY trace, pos)", "l AS (SELECT trace, pos, t0, t1, lag(t0) OVER (PARTITION BY trace ORDER BY pos) AS p0, lag(t1) OVER (PARTITION BY trace ORDER BY pos) AS p1 FROM heads)"]), "SELECT trace, count(*) AS n FROM l WHERE t0 = p0 AND t1 = p1 GROUP BY trace"),
    "repeated_key_map": ("lines", "f AS (SELECT trace, pos, min(pos) OVER (PARTITION BY trace, step) AS source_pos FROM lines WHERE length(step) >= 10)", "SELECT trace, pos, source_pos FROM f WHERE source_pos < pos"),
    "bm25_topk": ("lines tokens", "dl AS (SELECT trace, count(*) AS dl FROM tokens WHERE regexp_like(term, '^[a-z]{{2,}}$') GROUP BY trace), tf AS (SELECT trace, term, count(*) AS tf FROM tokens WHERE regexp_like(term, '^[a-z]{{2,}}$') GROUP BY trace, term), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS f FROM tf GROUP BY term), q AS ({queryterms}), s AS (SELECT q.item_id, tf.trace AS doc_id, round(sum(ln((n - f + 0.5e0) / (f + 0.5e0) + 1) * tf.tf * 2.5e0 / (tf.tf + 1.5e0 * (0.25e0 + 0.75e0 * dl.dl / greatest(avgdl, 1e0)))), 6) AS score FROM q JOIN tf ON tf.term = q.term JOIN df ON df.term = q.term JOIN dl ON dl.trace = tf.trace CROSS JOIN st GROUP BY q.item_id, tf.trace), r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rk FROM s)", "SELECT item_id, doc_id, score, CAST(rk AS BIGINT) AS rk FROM r WHERE rk <= 5"),
    "balanced_sample": ("", "r AS (SELECT d.source, l.quality, d.doc_id, row_number() OVER (PARTITION BY d.source, l.quality ORDER BY md5(concat('42', CAST(d.doc_id AS STRING))), d.doc_id) AS rk FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id)", "SELECT source, quality, doc_id FROM r WHERE rk <= 3"),
    "stratified_split": ("", "r AS (SELECT l.quality, l.doc_id, row_number() OVER (PARTITION BY l.quality ORDER BY md5(concat('7', CAST(l.doc_id AS STRING))), l.doc_id) AS rk, count(*) OVER (PARTITION BY l.quality) AS n FROM {labels} l)", "SELECT doc_id, quality, CASE WHEN rk <= greatest(1, round(n * 0.2e0)) THEN 'test' ELSE 'train' END AS part FROM r"),
    "round_robin": ("", "r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rk FROM {documents}), o AS (SELECT source, doc_id, row_number() OVER (ORDER BY rk, source) AS place FROM r WHERE rk <= 100)", "SELECT CAST(place AS BIGINT) AS place, source, doc_id FROM o WHERE place <= 100"),
    "left_default_merge": ("", "", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id"),
    "missing_ids": ("", "", "SELECT d.doc_id FROM {documents} d LEFT ANTI JOIN {labels} l ON l.doc_id = d.doc_id"),
    "score_mean_ignore_na": ("", "", "SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 1 THEN value END), 4) AS mean_value FROM {events} GROUP BY event_type"),
    "turn_answer_groups": ("", "t AS (SELECT conv_id, role, lower(trim(text)) AS k, count(*) AS n, min(turn) AS first_turn FROM {conversations} GROUP BY conv_id, role, lower(trim(text)))", "SELECT conv_id, role, count(*) AS n_groups, max(n) AS largest FROM t GROUP BY conv_id, role"),
}
QUERIES["embedding_centroid_alignment"] = ("", "long AS ({longvectors}), c AS (SELECT label, i, avg(x) AS m FROM long GROUP BY label, i), n AS (SELECT label, sqrt(sum(m * m)) AS nm FROM c GROUP BY label), s AS (SELECT v.vec_id, v.label, sum(v.x * c.m) AS dot, sqrt(sum(v.x * v.x)) AS nv FROM long v JOIN c ON c.label = v.label AND c.i = v.i GROUP BY v.vec_id, v.label)", "SELECT s.vec_id, s.label, round(greatest(0e0, least(1e0, dot / (nv * nm))), 6) AS alignment FROM s JOIN n ON n.label = s.label")
PARTS = {
    "spark": {
        "queryterms": r"SELECT DISTINCT item_id, term FROM {benchmark} LATERAL VIEW explode(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+', 0)) x AS term",
        "longvectors": "SELECT vec_id, label, i, CAST(x AS DOUBLE) AS x FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS i, x",
    },
    "duckdb": {
        "queryterms": r"SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+')) AS term FROM {benchmark}",
        "longvectors": "SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM {embeddings}",
    },
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def render(name: str, dialect: str, sf_dir: str = "") -> str:
    names, ctes, select = QUERIES[name]
    parts = [PRELUDE[dialect][n] for n in names.split()] + ([ctes] if ctes else [])
    sql = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" if dialect == "spark" else t for t in TABLES}
    inner = {k: v.format(**tables) for k, v in PARTS[dialect].items()}
    sql = sql.format(**tables, **inner)
    if dialect == "duckdb":
        sql = sql.replace("regexp_like(", "regexp_matches(").replace("AS STRING)", "AS VARCHAR)").replace("LEFT ANTI JOIN", "ANTI JOIN")
    return sql


def _once(spark: SparkSession, sql: str) -> str:
    """Name of a view of the query's rows, computed once."""
    name = f"stepforge_{uuid.uuid4().hex}"
    once(spark.sql(sql)).createOrReplaceTempView(name)
    return name


def shared_parts(spark: SparkSession, sql: str, sf_dir: str) -> str:
    """sql with its texts split and tokenised once, and its step terms counted once, however often it refers to them."""
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    lines, tokens = (PRELUDE["spark"][n].format(**tables) for n in ("lines", "tokens"))
    if tokens not in sql:
        return sql
    rows = _once(spark, f"WITH {lines} SELECT sample, trace, pos, regexp_extract_all(lower(step), '[\\\\p{{L}}\\\\p{{M}}\\\\p{{N}}_]+', 0) AS t FROM lines")
    kept = f"lines AS (SELECT sample, trace, pos FROM {rows})", f"tokens AS (SELECT sample, trace, pos, CAST(i AS BIGINT) AS i, term FROM {rows} LATERAL VIEW posexplode(t) x AS i, term)"
    sql = sql.replace(lines, kept[0]).replace(tokens, kept[1])
    if _STEPSETS in sql:
        counted = _once(spark, f"WITH {', '.join(kept)}, {_TERMS.format()}, {_STEPSETS} SELECT * FROM stepterms")
        sql = sql.replace(_STEPSETS, f"stepterms AS (SELECT * FROM {counted})")
    return sql


#: Queries with a plan of their own where documents are named apart.
PLANS: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "step_zscore_filter": lambda docs, sf_dir: texts.step_zscore_filter(docs, _WORDS, ALPHA, BETA, GAMMA),
    "filter_stats": lambda docs, sf_dir: texts.filter_stats(docs, _WORDS, ALPHA, BETA, GAMMA),
    "tfidf_topk_per_sample": lambda docs, sf_dir: texts.tfidf_topk_per_sample(docs, _WORDS),
    "bm25_topk": lambda docs, sf_dir: texts.bm25_topk(docs, docs.sparkSession.sql(PARTS["spark"]["queryterms"].format(benchmark=f"parquet.`{sf_dir}/benchmark.parquet`"))),
}


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if name in PLANS and texts.named_apart(docs := texts.documents(spark, sf_dir)):
            return PLANS[name](docs, sf_dir)
        return spark.sql(shared_parts(spark, render(name, "spark", sf_dir), sf_dir))

    run.__name__ = name
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query(name) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: render(name, "duckdb") for name in QUERIES}
