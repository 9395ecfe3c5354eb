"""Results that several parts of a plan read are computed once and kept in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame

#: Bytes up to which a table that ``near`` has weighed is sent to every executor.
SENT = 8 << 20


def _folder(df: DataFrame) -> str:
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if at is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="stepforge-"))
    return context._jsc.sc().getCheckpointDir().get()


def once(df: DataFrame) -> DataFrame:
    """df, computed and checkpointed under spark.checkpoint.dir; Spark's cleaner removes it with the last plan that reads it."""
    _folder(df)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """df, written as Parquet in the same folder, where it takes a small part of a checkpoint's bytes; shuffle files of its plan can go."""
    spark, path = df.sparkSession, f"{_folder(df).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._stepforge_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``kept`` that no plan reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(df._stepforge_path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def near(df: DataFrame, weight: int) -> DataFrame:
    """df, of ``weight`` bytes, marked to be sent to every executor if it is small; otherwise joins shuffle it."""
    return df.hint("broadcast") if weight <= SENT else df
