"""Tables dealt into a fixed number of folders by a key, of which a lookup reads those of its keys only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of a table, and files of a folder at least, so that a key with very many rows is several tasks.
BUCKETS, FILES = 64, 4


def bucket_of(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def dealt(df: DataFrame, path: str, column: str, spread: str | None = None) -> None:
    """Writes ``df`` by buckets of ``column``; rows of a bucket are spread over files by the column ``spread``.

    Without it they are not shuffled: each task adds a file to its buckets. That
    is for rows that come in large parts by something else than ``column``.
    """
    bucketed = df.withColumn("bucket", bucket_of(column))
    if spread is not None:
        bucketed = bucketed.repartition("bucket", F.pmod(F.xxhash64(spread), F.lit(FILES)))
    bucketed.write.partitionBy("bucket").parquet(path)


def of_values(spark: SparkSession, path: str, schema: str, column: str, values: list[str]) -> DataFrame:
    """Rows with one of a few given values."""
    wanted = spark.createDataFrame([(v,) for v in values], "v string")
    buckets = [r[0] for r in wanted.select(bucket_of("v")).distinct().collect()] if values else []
    rows = spark.read.schema(f"{schema}, bucket int").parquet(path)
    return rows.filter(F.col("bucket").isin(buckets) & F.col(column).isin(values)).drop("bucket")


def of_rows(spark: SparkSession, path: str, schema: str, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``column`` is in ``wanted``, which has a column of that name; Spark prunes the folders while it runs, or else reads on."""
    rows = spark.read.schema(f"{schema}, bucket int").parquet(path)
    return rows.join(wanted.select(column).distinct().withColumn("bucket", bucket_of(column)), ["bucket", column], "left_semi").drop("bucket")
