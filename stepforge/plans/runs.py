"""Runs of ordered stages that can be taken up again, with a manifest of their settings, in any folder Spark can reach."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

Stage = tuple[str, tuple[str, ...], Callable[..., DataFrame]]


class SettingsDiffer(ValueError):
    """The folder holds a run with other settings."""


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def put_aside(spark: SparkSession, path: str) -> str:
    """Renames an output to the first free name ending in .failed-N."""
    n = 1
    while exists(spark, f"{path}.failed-{n}"):
        n += 1
    fs, at = _at(spark, path)
    if not fs.rename(at, _at(spark, f"{path}.failed-{n}")[1]):
        raise OSError(f"{path} can't be renamed")
    return f"{path}.failed-{n}"


def ordered(stages: Sequence[Stage]) -> None:
    """Every stage has a name of its own and takes only outputs of earlier ones."""
    seen: set[str] = set()
    for name, needs, _ in stages:
        if name in seen or set(needs) - seen:
            raise ValueError(f"stage {name} is named twice or needs {sorted(set(needs) - seen)}")
        seen.add(name)


def settle(spark: SparkSession, folder: str, settings: Mapping[str, object]) -> None:
    """Writes the settings once; refuses a folder made with others."""
    path, now = f"{folder}/manifest", json.dumps(dict(settings), sort_keys=True)
    if exists(spark, f"{path}/_SUCCESS"):
        before = spark.read.text(path).first()[0]
        if before != now:
            raise SettingsDiffer(f"{folder} was made with {before}, not with {now}")
    else:
        spark.createDataFrame([(now,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def run(spark: SparkSession, folder: str, stages: Sequence[Stage], settings: Mapping[str, object]) -> dict[str, str]:
    """What became of each stage: kept or made.

    A stage gets the outputs it needs, in order, and its rows are written as Parquet in the folder.  Finished outputs are
    kept up to the first stage that has to run; all after it run again.  Outputs cut short are put aside by name."""
    ordered(stages)
    settle(spark, folder, settings)
    done: dict[str, str] = {}
    for name, needs, make in stages:
        path = f"{folder}/{name}"
        finished = exists(spark, f"{path}/_SUCCESS")
        if finished and "made" not in done.values():
            done[name] = "kept"
            continue
        if exists(spark, path) and not finished:
            put_aside(spark, path)
        make(spark, *(spark.read.parquet(f"{folder}/{n}") for n in needs)).write.mode("overwrite").parquet(path)
        done[name] = "made"
    return done


def remaining(todo: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't finished yet."""
    return todo.join(finished.select(key).distinct(), key, "left_anti")
