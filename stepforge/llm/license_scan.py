"""License scan by diagonal voting, with DataFrame functions only.

Every rolling 3-word gram of every text is hashed and joined with the positions of the same grams in the templates (a
fixed table of a few hundred rows, so it is broadcast).  A match votes for the diagonal text position - template
position; votes are summed by diagonal, neighbouring diagonals of a template (words put in or left out) are merged, and
a merged span counts if it covers enough of the template in not too many words.  Grams are compared as strings after
the hash join, so the votes are exact.  The phrases of the base label are templates whose one diagonal must be full.

Defined cases: a null or empty text has no words, no label and score 0; first_word and last_word are null without a
phrase; every row is a document of its own, whatever its doc_id (null and repeated ones too); without documents nothing
is returned; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepforge.llm.common import ascii_lower, stored, table

#: Phrases and labels of the base scan.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notice sentences of public licenses, in the words of the scan.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("all rights reserved", "all-rights-reserved"),
)
K = 3
#: Words that may be missing or put in between two neighbouring diagonals of one span.
BAND = 2
COVERED = 0.8
STRETCH = 1.5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _templates() -> list[tuple]:
    out = []
    for exact, rows in ((True, PHRASES), (False, NOTICES)):
        for i, (words, label) in enumerate(rows):
            w = words.split()
            for j in range(len(w) - K + 1):
                out.append((f"{'p' if exact else 'n'}{i:02d}", label, exact, len(w) - K + 1, len(w), j, " ".join(w[j : j + K])))
    return out


def _template_sql() -> str:
    rows = ", ".join(f"('{t}', '{label}', {str(exact).lower()}, {n}, {size}, {j}, '{g}')" for t, label, exact, n, size, j, g in _templates())
    return f"(VALUES {rows}) AS t(template, label, exact, n_grams, n_template, tpos, gram)"


def votes(docs: DataFrame) -> DataFrame:
    """Votes by (row, doc_id, template, diagonal), and one row with null template for every document.

    Written once, so that the scan is made once and rows keep their numbers.
    """
    spark = docs.sparkSession
    t = spark.sql(f"SELECT * FROM {_template_sql()}")
    t = t.withColumn("h", F.xxhash64(*[F.element_at(F.split("gram", " "), i + 1) for i in range(K)]))
    w = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", word_list(F.col("text")).alias("w"))
    w = w.select("row", "doc_id", "w", F.size("w").cast("long").alias("n_words"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - K, F.lit(0)))).alias("pos"))
    parts = [F.get("w", F.col("pos") + i) for i in range(K)]
    found = F.concat_ws(" ", *parts)
    w = w.select("row", "doc_id", "n_words", "pos", F.xxhash64(*parts).alias("h"), found.alias("found"))
    joined = w.join(F.broadcast(t), "h", "left").where((F.col("pos") == 0) | F.col("template").isNotNull())
    hit = (F.instr("found", F.col("gram")) == 1) & (F.length("found") == F.length("gram"))
    joined = joined.where((F.col("pos") == 0) | hit)
    keep = [F.when(hit, F.col(c)).alias(c) for c in ("template", "label", "exact", "n_grams", "n_template")]
    joined = joined.select("row", "doc_id", "n_words", *keep, F.when(hit, F.col("pos") - F.col("tpos")).cast("long").alias("diagonal"), F.when(hit, F.col("tpos")).alias("tpos"))
    by = joined.groupBy("row", "doc_id", "template", "label", "exact", "n_grams", "n_template", "diagonal")
    return stored(by.agg(F.max("n_words").alias("n_words"), F.count_distinct("tpos").alias("votes"), F.min("tpos").alias("low"), F.max("tpos").alias("high")), "votes")


def spans(voted: DataFrame) -> DataFrame:
    """Neighbouring diagonals merged: row, doc_id, template, label, first_word, last_word, covered, verified."""
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    m = voted.where("not exact").withColumn("gap", F.col("diagonal") - F.lag("diagonal").over(by))
    m = m.withColumn("span", F.sum(F.when(F.col("gap") <= BAND, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.groupBy("row", "doc_id", "template", "label", "n_grams", "n_template", "span").agg(
        F.min(F.col("diagonal") + F.col("low")).alias("first_word"), F.max(F.col("diagonal") + F.col("high") + (K - 1)).alias("last_word"), F.sum("votes").alias("votes")
    )
    covered = F.least(F.col("votes").cast("double") / F.col("n_grams"), F.lit(1.0))
    tight = (F.col("last_word") - F.col("first_word") + 1) <= F.col("n_template") * F.lit(STRETCH)
    return m.select("row", "doc_id", "template", "label", "first_word", "last_word", covered.alias("covered"), ((covered >= COVERED) & tight).alias("verified"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs (doc_id, text)."""
    voted = votes(docs)
    full = F.col("exact") & (F.col("votes") == F.col("n_grams"))
    none = F.lit(None)
    base = voted.select("row", "doc_id", "n_words", F.when(full, F.col("diagonal")).alias("at"), F.when(full, F.col("label")).alias("base"), F.when(full, F.col("label")).alias("any"), F.when(full, 1.0).otherwise(0.0).alias("score"))
    s = spans(voted).select("row", "doc_id", none.cast("long").alias("n_words"), none.cast("long").alias("at"), none.cast("string").alias("base"), F.when(F.col("verified"), F.col("label")).alias("any"), F.col("covered").alias("score"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return base.unionByName(s).groupBy("row", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.count("at").alias("n_base"),
        F.min("at").alias("first_word"),
        F.max("at").alias("last_word"),
        joined("base").alias("base_labels"),
        joined("any").alias("labels"),
        F.round(F.max("score"), 6).alias("score"),
    ).drop("row")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = rf"""
WITH t AS (SELECT * FROM {_template_sql()}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
k AS (SELECT rid, i AS pos, array_to_string(w[i + 1 : i + {K}], ' ') AS gram FROM d, LATERAL (SELECT unnest(range(0, len(w) - {K - 1})) AS i)),
v AS (SELECT rid, template, label, exact, n_grams, n_template, pos - tpos AS diagonal, count(DISTINCT tpos) AS votes, min(tpos) AS low, max(tpos) AS high
  FROM k JOIN t USING (gram) GROUP BY 1, 2, 3, 4, 5, 6, 7),
g AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) <= {BAND} THEN 0 ELSE 1 END AS brk FROM v WHERE NOT exact),
c AS (SELECT *, sum(brk) OVER (PARTITION BY rid, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM g),
m AS (SELECT rid, label, least(sum(votes)::DOUBLE / any_value(n_grams), 1.0) AS covered, max(diagonal + high + {K - 1}) - min(diagonal + low) + 1 <= any_value(n_template) * {STRETCH} AS tight
  FROM c GROUP BY rid, template, label, span),
b AS (SELECT rid, diagonal AS pos, label AS base, label AS lab, 1.0::DOUBLE AS score FROM v WHERE exact AND votes = n_grams
  UNION ALL SELECT rid, NULL, NULL, CASE WHEN covered >= {COVERED} AND tight THEN label END, covered FROM m),
r AS (SELECT rid, count(pos) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT base, ',' ORDER BY base) AS base_labels, string_agg(DISTINCT lab, ',' ORDER BY lab) AS labels, max(score) AS score FROM b GROUP BY rid)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM d LEFT JOIN r ON r.rid = d.rid
"""
