"""Readers and writers: Parquet tables, JSON envelopes, JSON lines, paired exports and padded score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_records(spark: SparkSession, path: str, keys: tuple[str, ...] = ("results", "samples", "predictions")) -> DataFrame:
    """Records of a JSON file that is a list, one object, an envelope with a list under one of the keys, or an object whose every value is a record."""
    df = spark.read.json(path, multiLine=True)
    for key in keys:
        if key in df.columns:
            return df.select(F.explode(key).alias("r")).select("r.*")
    if df.columns and all(isinstance(f.dataType, StructType) for f in df.schema.fields):
        fields = {f.name: f.dataType for s in df.schema.fields for f in s.dataType.fields}
        named = [F.struct(*(F.col(f"`{s.name}`.`{n}`") if n in s.dataType.names else F.lit(None) for n in fields)) for s in df.schema.fields]
        like = StructType([StructField(n, t) for n, t in fields.items()])
        return df.select(F.explode(F.array(*(c.cast(like) for c in named))).alias("r")).select("r.*")
    return df


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def write_json_by(df: DataFrame, path: str, *keys: str) -> None:
    """One folder of JSON lines for each value of the keys, such as dataset and setting (S-08).  A group is written by as many tasks as it has parts."""
    df.write.partitionBy(*keys).mode("overwrite").json(path)


def write_score_table(df: DataFrame, path: str, metrics: Sequence[str], width: int = 15) -> None:
    """A padded table of (id, metrics): the first line names the columns, missing values are N/A (S-06).  It is a report, written as one file in the order of ids."""
    cell = lambda c: F.rpad(c, F.greatest(F.lit(width), F.length(c) + 1), " ")
    head = "".join(x.ljust(width) for x in ("ID", *metrics))
    line = F.concat(cell(F.col("id").cast("string")), *(cell(F.coalesce(F.col(m).cast("string"), F.lit("N/A"))) for m in metrics))
    rows = df.select(F.lit(1).alias("part"), F.col("id").alias("at"), line.alias("value"))
    top = df.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(None).cast(df.schema["id"].dataType).alias("at"), F.lit(head).alias("value"))
    top.unionByName(rows).orderBy("part", "at").coalesce(1).select("value").write.mode("overwrite").text(path)


def score_table(spark: SparkSession, path: str) -> DataFrame:
    """Long form (id, metric, value) of a white-space padded table whose first line names the columns; N/A is null."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("c"))
    names = rows.where(F.element_at("c", 1) == "ID").limit(1).select(F.col("c").alias("names"))
    return (
        rows.where(F.element_at("c", 1) != "ID")
        .crossJoin(F.broadcast(names))  # one row
        .select(F.element_at("c", 1).alias("id"), F.posexplode(F.arrays_zip("names", "c")).alias("at", "x"))
        .where("at > 0")
        .select("id", F.col("x.names").alias("metric"), F.expr("try_cast(x.c AS DOUBLE)").alias("value"))
    )
