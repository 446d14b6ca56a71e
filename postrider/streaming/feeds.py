"""Change feeds as Structured Streaming: sources, keyed state, and a sink that replays can't double."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..plans.staging import shared_dir


def feed(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """The files of a table as a stream, so many in a batch at most; a glob takes one file and a folder alike."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{name}.parque[t]")


def drained(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over all that is there now, and returns the rows that it left.

    Each batch writes its own folder, over what an earlier try of the batch
    wrote; so a replay after a lost executor or driver adds nothing. With
    ``keys`` the stream updates rows, and the last batch with a key counts;
    without, it appends. A stream without data leaves no rows.
    """
    spark = rows.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], rows.schema).write.parquet(f"{root}/rows/batch=-1")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

    query = rows.writeStream.outputMode("update" if keys else "append").trigger(availableNow=True).option("checkpointLocation", f"{root}/state").foreachBatch(put).start()
    query.awaitTermination()
    left = spark.read.schema(StructType([*rows.schema.fields, StructField("batch", LongType())])).parquet(f"{root}/rows")
    if not keys:
        return left.drop("batch")
    others = [c for c in rows.columns if c not in keys]
    return left.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, "r.*")


def timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    """The stream with event time: rows later than ``late`` may be dropped, and state older than it goes."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def once(stream: DataFrame, key: str) -> DataFrame:
    """Of deliveries with one key, the first within the watermark; state is as long as the watermark."""
    return stream.dropDuplicatesWithinWatermark([key])


def latest(stream: DataFrame, keys: list[str], order: str, *values: str) -> DataFrame:
    """The last values of each key, and how many changes it had."""
    return stream.groupBy(*keys).agg(*[F.max_by(v, order).alias(v) for v in values], F.max(order).alias(order), F.count("*").alias("changes"))


def live(stream: DataFrame, ts: str, clock: Column, days: int) -> DataFrame:
    """Rows of the last days before the clock; the clock is given, so that reruns agree."""
    return stream.filter(F.col(ts) >= clock - F.make_dt_interval(days=F.lit(days)))


def completed(heads: DataFrame, parts: DataFrame, key: str, value: str) -> DataFrame:
    """Heads with a value that may come later, or never: either side updates the row of its key."""
    h = heads.select(key, F.lit(1).alias("is_head"), F.lit(None).cast(parts.schema[value].dataType).alias(value))
    p = parts.select(key, F.lit(0).alias("is_head"), value)
    return h.unionByName(p).groupBy(key).agg(F.max("is_head").alias("is_head"), F.max(value).alias(value))
