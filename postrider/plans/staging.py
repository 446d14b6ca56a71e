"""Cutting lineage through the folder that the whole cluster shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, one under /tmp in local mode (tests); a cluster must set it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir(path or "/tmp/checkpoints")
    return sc.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    The files survive lost executors and give later plans true sizes, from
    which Spark itself decides whether a side is small enough to broadcast.
    They go when the application ends. Shuffle files of the plan go as soon as
    they are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _with_conf(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """What is written within it leaves no shuffle files behind.

    Otherwise they stay until the driver happens to collect its garbage; those of
    a loop of many steps add up, at some files for each task even of tiny tables.
    """
    return _with_conf(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def joins_by_shuffle(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it, Spark broadcasts no side of a join of its own accord.

    Each broadcast passes through the driver. In loops of many joins over staged
    tables these add up, and grow with the tables until each reaches Spark's limit.
    """
    return _with_conf(spark, "spark.sql.autoBroadcastJoinThreshold", "-1")


def saved(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; Spark deletes it when it is out of use."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
