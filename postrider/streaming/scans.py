"""Scans that go on where they stopped, and typed changes between two states of a table."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.staging import stage


class ResumableScan:
    """Pages of a table by rising keys under ``path``; a page is there whole or not at all.

    A page is written to a folder of its own, with its last keys in its rows, and
    moved into place in one step. What is in place is what was emitted: the next
    page starts after its greatest keys. A run that stops anywhere, and is
    started again, emits each row once; rows that came later, with greater keys,
    are taken up by the next run.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...]):
        self.spark, self.path, self.keys = spark, path, keys

    def _fs(self, at: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{at}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def pages(self) -> list[int]:
        place, fs = self._fs("pages")
        names = [x.getPath().getName() for x in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(int(n.removeprefix("page=")) for n in names if n.startswith("page="))

    def emitted(self) -> DataFrame:
        """All rows of pages that are in place, with the number of their page."""
        return self.spark.read.parquet(f"{self.path}/pages")

    def cursor(self) -> tuple | None:
        """The greatest keys emitted; None before the first page."""
        pages = self.pages()
        if not pages:
            return None
        top = self.spark.read.parquet(f"{self.path}/pages/page={pages[-1]}").agg(F.max(F.struct(*self.keys)).alias("k")).head()
        return tuple(top.k) if top.k else None

    def _after(self, rows: DataFrame, cursor: tuple) -> DataFrame:
        """Rows with greater keys; one comparison of the first key reaches the scan."""
        fields = [F.lit(v).cast(rows.schema[k].dataType) for k, v in zip(self.keys, cursor, strict=True)]
        beyond = functools.reduce(operator.or_, [functools.reduce(operator.and_, [F.col(k) == f for k, f in zip(self.keys[:i], fields, strict=False)], F.col(self.keys[i]) > fields[i]) for i in range(len(self.keys))])
        return rows.filter((F.col(self.keys[0]) >= fields[0]) & beyond)

    def step(self, rows: DataFrame, page: int) -> bool:
        """Emits the next page, of about ``page`` rows; False if nothing is left. Keys are unique and not null."""
        cursor, number = self.cursor(), (self.pages() or [-1])[-1] + 1
        left = rows if cursor is None else self._after(rows, cursor)
        end = self._end(left, page)
        if end is None:
            return False
        within = left.filter(F.struct(*self.keys) <= F.struct(*[F.lit(v).cast(rows.schema[k].dataType) for k, v in zip(self.keys, end, strict=True)]))
        within.write.mode("overwrite").parquet(f"{self.path}/open")
        (source, fs), (target, _), (parent, _) = self._fs("open"), self._fs(f"pages/page={number}"), self._fs("pages")
        fs.mkdirs(parent)
        fs.rename(source, target)
        return True

    def _end(self, left: DataFrame, page: int) -> tuple | None:
        """The keys of the page's last row: of ranges of rows by keys, counted, the last that still belongs to it."""
        key = F.struct(*self.keys)
        parts = stage(left.select(key.alias("k")).repartitionByRange("k").withColumn("part", F.spark_partition_id()))
        # As many rows as the sort has partitions.
        sizes = parts.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
        before = 0
        for r in sizes:
            if before + r.n >= page:
                place = parts.filter(F.col("part") == r.part).withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("k")))
                return tuple(place.filter(F.col("place") == page - before).head().k)
            before += r.n
        return tuple(parts.agg(F.max("k").alias("k")).head().k) if before else None

    def run(self, rows: DataFrame, page: int) -> int:
        """Steps until nothing is left; returns how many pages it emitted."""
        n = 0
        while self.step(rows, page):
            n += 1
        return n


def typed_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, kind, changed, before, after): created, deleted and updated rows of two states with unique keys and the same columns; ``changed`` names the columns that differ, all for a row that came or went."""
    names = [c for c in before.columns if c != key]
    whole = lambda df, name: df.select(F.col(key), F.struct(*names).alias(name), F.lit(True).alias(f"in_{name}"))
    j = whole(before, "before").join(whole(after, "after"), key, "outer")
    differs: list[Column] = [F.when(~F.col(f"before.{n}").eqNullSafe(F.col(f"after.{n}")) | F.col("in_before").isNull() | F.col("in_after").isNull(), n) for n in names]
    kind = F.when(F.col("in_before").isNull(), "created").when(F.col("in_after").isNull(), "deleted").otherwise("updated")
    out = j.select(key, kind.alias("kind"), F.array_compact(F.array(*differs)).alias("changed"), "before", "after")
    return out.filter((F.col("kind") != "updated") | (F.size("changed") > 0))
