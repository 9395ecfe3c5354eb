"""Shared pieces: the folder all executors see, components by stars, and small helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset and all runs in one local JVM, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at is None and current.isDefined():
        at = current.get()
    if at is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="stepforge-")
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_keys(c: Column) -> tuple[Column, Column]:
    """128 bits that name a text (null: the empty one)."""
    c = F.coalesce(c, F.lit(""))
    return F.xxhash64(c), F.xxhash64(F.lit(0x5EED), c)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b of one ordered type); root is the least node reachable.

    Alternating large and small stars: each round hooks every node on the least node nearby, so the number of rounds
    grows with the logarithm of the diameter.  A hub's edges always point from the many to the one least node, and
    the minimum is pre-aggregated before each shuffle, so a hot component doesn't land in one task.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = checkpoint(e)
    before = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: the larger neighbours of u go to u's least neighbour
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = e.union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = checkpoint(e)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def free(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished work now, not when the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table in the shared folder and reads it again: lineage ends there, and executors can be lost after it."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    free(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stepforge_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes tables written by ``stored`` that no plan reads any more."""
    for df in tables:
        if df is not None:
            remove_path(df.sparkSession, df._stepforge_path)
