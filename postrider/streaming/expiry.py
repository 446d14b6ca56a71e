"""Rows that go after some days: laid out by day, dropped as whole folders."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def by_day(df: DataFrame, path: str, ts: str) -> None:
    """Appends rows to the table at ``path``, in a folder for each day of ``ts``; rows without a time are in a folder that never goes."""
    df.withColumn("day", F.to_date(ts)).repartition("day", F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("append").partitionBy("day").parquet(path)


def days(spark: SparkSession, path: str) -> list[datetime.date]:
    """Days that have a folder, rising."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(place)]
    return sorted(datetime.date.fromisoformat(n[4:]) for n in names if n.startswith("day=") and n[4:5].isdigit())


def expire(spark: SparkSession, path: str, clock: datetime.datetime, keep: int) -> list[datetime.date]:
    """Drops the days that ended ``keep`` days before the clock or earlier; returns them.

    No row is read or written. A run that broke off is taken up by the next one;
    one that has nothing to do changes nothing. A reader that filters by time
    as well sees no row that should be gone, even of the day that is cut.
    """
    gone = [d for d in days(spark, path) if datetime.datetime.combine(d, datetime.time()) + datetime.timedelta(days=keep + 1) <= clock]
    for d in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={d.isoformat()}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return gone


def unexpired(spark: SparkSession, path: str, ts: str, clock: datetime.datetime, keep: int) -> DataFrame:
    """The rows of the last ``keep`` days before the clock, and those without a time; other days' folders are not read."""
    least = F.lit(clock.isoformat(sep=" ")).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(keep))
    df = spark.read.parquet(path)
    return df.filter(F.col("day").isNull() | ((F.col("day") >= F.to_date(least)) & (F.col(ts) >= least))).drop("day")
