"""Cutting lineage at tables that every executor can read again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one below /tmp where the session
    names none and its executors are in this process, as in local tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a reader of
    it, so that several consumers and recomputed tasks start from the files."""
    path = f"{shared_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, tag: str) -> DataFrame:
    """``materialize`` in as many files as there are cores, so that passes over rows that
    come from few files use all of them."""
    return materialize(df.repartition(df.sparkSession.sparkContext.defaultParallelism), tag)


def in_parts(df: DataFrame, key: str, groups: int, most: int = 16) -> DataFrame:
    """Dealt by ``key``, which has about ``groups`` values of bounded size, to tasks whose
    number grows with them, so that a task gets about ``most`` groups at any size."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(groups, max(4 * cores, -(-groups // most)))), key)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a job go when it has ended, in place of staying until
    the driver's memory is collected; what is read again is in tables."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
