"""Answers that depend on connected rows, kept up to date under inserts, changes and deletes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import joins_by_shuffle, stage

#: Folders that rows and keys are dealt into; a lookup reads those of its keys only.
BUCKETS = 64


class Maintained:
    """A table of rows with answers that a batch of changes updates, at a cost of the rows it connects to.

    ``keys(rows)`` gives (id, key): rows that share a key may change each
    other's answers. ``compute(rows)`` gives (id, columns of ``answer``) for
    rows that include all that are connected to them. Three versioned tables lie
    under ``path``: the rows, the ids of each key, and the answers, each dealt
    into buckets by id or key. A batch writes its own version of what changed,
    and a mark when all is written. So a batch that runs again, after a lost
    executor or driver, writes over what it wrote before and changes nothing;
    readers see whole batches only.
    """

    def __init__(self, spark: SparkSession, path: str, row: str, answer: str, keys: Callable[[DataFrame], DataFrame], compute: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS):
        """``row`` and ``answer`` are DDL lists of columns; the first of ``row`` is ``id``, which ``answer`` lacks."""
        self.spark, self.path, self.keys, self.compute, self.buckets = spark, path, keys, compute, buckets
        empty = lambda ddl: spark.createDataFrame([], ddl).schema
        self.row = [f.name for f in empty(row)]
        self.answer = [f.name for f in empty(answer)]
        id_type = empty(row)["id"].dataType.simpleString()
        head = f"id {id_type}, gone boolean, "
        tail = ", version long, bucket int"
        self.schemas = {"rows": head + f"r struct<{self._struct(row)}>" + tail, "keys": f"key string, id {id_type}" + tail, "answers": head + f"r struct<{self._struct(answer)}>" + tail}

    def _struct(self, ddl: str) -> str:
        return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in self.spark.createDataFrame([], ddl).schema)

    # Files

    def _fs(self, at: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{at}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, at: str) -> list[str]:
        place, fs = self._fs(at)
        return [x.getPath().getName() for x in fs.listStatus(place)] if fs.exists(place) else []

    def versions(self) -> list[int]:
        """Whole versions, rising. An even one is a batch, an odd one has all that the batches up to it left."""
        found = sorted(int(x) for x in self._children("done") if not x.startswith((".", "_")))
        whole = [v for v in found if v % 2]
        return [v for v in found if not whole or v >= whole[-1]]

    def _mark(self, version: int) -> None:
        place, fs = self._fs(f"done/{version}")
        fs.create(place, True).close()

    def _write(self, table: str, df: DataFrame, bucket_of: str, version: int) -> None:
        dealt = df.withColumn("bucket", F.pmod(F.xxhash64(bucket_of), F.lit(self.buckets)).cast("int"))
        dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/version={version}")

    def _read(self, table: str, versions: list[int]) -> DataFrame:
        """What versions wrote; folders of other versions are not listed."""
        there = set(self._children(table))
        paths = [f"{self.path}/{table}/version={v}" for v in versions if f"version={v}" in there]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).option("basePath", f"{self.path}/{table}").parquet(*paths)

    # Reads

    def _of(self, table: str, wanted: DataFrame, column: str, versions: list[int]) -> DataFrame:
        """Rows of a table with one of the wanted values; reads the buckets of these only, of which there are a fixed number."""
        bucket = F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")
        buckets = [r[0] for r in wanted.select(bucket.alias("b")).distinct().collect()]
        return self._read(table, versions).filter(F.col("bucket").isin(buckets)).join(wanted, column, "left_semi")

    @staticmethod
    def _last(table: DataFrame) -> DataFrame:
        """(id, gone, r) as the last version left it."""
        return table.groupBy("id").agg(F.max_by(F.struct("gone", "r"), "version").alias("x")).select("id", "x.gone", "x.r")

    def _rows(self, ids: DataFrame, versions: list[int]) -> DataFrame:
        return self._last(self._of("rows", ids, "id", versions)).filter("NOT gone").select(*[F.col(f"r.`{c}`").alias(c) for c in self.row])

    def current(self) -> DataFrame:
        """(id, answer columns) of all rows."""
        return self._last(self._read("answers", self.versions())).filter("NOT gone").select("id", *[F.col(f"r.`{c}`").alias(c) for c in self.answer])

    def rows(self) -> DataFrame:
        """All rows."""
        return self._last(self._read("rows", self.versions())).filter("NOT gone").select(*[F.col(f"r.`{c}`").alias(c) for c in self.row])

    # Writes

    def connected(self, seeds: DataFrame, keys: DataFrame, versions: list[int]) -> DataFrame:
        """(id): the seeds and all rows that they reach over shared keys, from the seeds outwards.

        A round looks up the ids of new keys, and the keys of new ids; it ends
        when there are none. Rounds are as many as steps to the farthest row.
        """
        seen, frontier = stage(seeds.select("id").distinct()), stage(keys.select("key").distinct())
        met = frontier
        while frontier.head(1):
            found = self._of("keys", frontier, "key", versions).select("id").distinct()
            rows = self._rows(stage(found.join(seen, "id", "left_anti")), versions)
            # A posting of an earlier version may not hold any more.
            own = stage(self.keys(rows).select("id", "key").distinct())
            reached = stage(own.join(frontier, "key", "left_semi").select("id").distinct())
            frontier = stage(own.join(reached, "id", "left_semi").select("key").distinct().join(met, "key", "left_anti"))
            seen, met = seen.union(reached), met.union(frontier)
        return seen

    def apply(self, changes: DataFrame, number: int) -> DataFrame:
        """Takes up batch ``number``: rows (columns of the rows, gone, seq); of several with one id the last ``seq`` counts. Returns (id, gone, r): the answers that changed.

        A row that is ``gone`` needs its id only. A batch that is applied again
        has the same effect, as long as no later batch is.
        """
        # A batch of a stream has a session of its own.
        with joins_by_shuffle(self.spark), joins_by_shuffle(changes.sparkSession):
            return self._applied(changes, number)

    def _applied(self, changes: DataFrame, number: int) -> DataFrame:
        version = 2 * number
        before = [v for v in self.versions() if v < version]
        last = changes.groupBy("id").agg(F.max_by(F.struct(F.coalesce("gone", F.lit(False)).alias("gone"), F.struct(*self.row).alias("r")), "seq").alias("x"))
        new = stage(last.select("id", "x.gone", "x.r"))
        ids = stage(new.select("id"))
        old = self._rows(ids, before)
        live = new.filter("NOT gone").select(*[F.col(f"r.`{c}`").alias(c) for c in self.row])
        own = stage(self.keys(live).select("key", "id").distinct())
        self._write("rows", new, "id", version)
        self._write("keys", own, "key", version)
        now = [*before, version]
        touched = self.connected(ids, self.keys(old).select("key").union(own.select("key")), now)
        wanted = self.compute(self._rows(touched, now)).select("id", F.struct(*self.answer).alias("r"))
        stored = self._last(self._of("answers", touched, "id", before)).filter("NOT gone").select("id", F.col("r").alias("was"))
        both = stored.join(wanted, "id", "outer").filter(~F.col("was").eqNullSafe(F.col("r")))
        changed = stage(both.select("id", F.col("r").isNull().alias("gone"), "r"))
        self._write("answers", changed, "id", version)
        self._mark(version)
        return changed

    def compact(self) -> None:
        """Writes all that the versions left as one, then drops the earlier ones. Not to run beside :meth:`apply`."""
        versions = self.versions()
        if len(versions) < 2:
            return
        top = versions[-1] | 1
        rows = stage(self._last(self._read("rows", versions)).filter("NOT gone"))
        self._write("rows", rows, "id", top)
        self._write("keys", self.keys(rows.select(*[F.col(f"r.`{c}`").alias(c) for c in self.row])).select("key", "id").distinct(), "key", top)
        self._write("answers", self._last(self._read("answers", versions)).filter("NOT gone"), "id", top)
        self._mark(top)
        for v in versions:
            if v < top:
                for at in (f"done/{v}", *[f"{t}/version={v}" for t in self.schemas]):
                    place, fs = self._fs(at)
                    fs.delete(place, True)

    def follow(self, stream: DataFrame, checkpoint: str, every: int = 0) -> None:
        """Applies the batches of a stream of changes until there are no more; ``every`` so many it compacts."""

        def put(batch: DataFrame, number: int) -> None:
            # What a compaction has taken in is not applied again.
            if 2 * number < (self.versions() or [0])[0]:
                return
            self.apply(stage(batch), number)
            if every and number % every == every - 1:
                self.compact()

        stream.writeStream.foreachBatch(put).trigger(availableNow=True).option("checkpointLocation", checkpoint).start().awaitTermination()
