"""Exact deduplication by 128-bit content hash, bytes compared inside groups. Native."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.columns import only
from ..plans.staging import saved, stage
from .text import one_spaced


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash128=F.md5) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same bytes after each run of ASCII white
    space has become one space. Rows are first counted by a short hash; texts
    whose hash is alone have no copies and are left out, before any shuffle as
    long as Spark finds the other hashes small enough to broadcast. The group
    key is the 128-bit content hash followed by the normalised text itself, so
    two texts share a group only if their bytes agree, whatever the hash does;
    equal rows meet already before the shuffle, so a text with very many copies
    is one row a task.

    Null and empty texts are equal to each other. The smallest id stays; a null
    id stays only in a group without other ids. Rows that repeat id and text
    are the same document: each is counted and all have the same flag. An empty
    table gives an empty result; other columns are not read.
    """
    d = only(docs, doc_id=id_col, text=one_spaced(F.col(f"`{text_col}`")))
    short = F.xxhash64(hash128("text")).alias("short")
    several = stage(d.groupBy(short).count().filter("count > 1").select("short"))
    groups = d.select("doc_id", "text", short).join(several, "short", "left_semi").groupBy(hash128("text").alias("h"), "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # Only groups with copies are looked up. The saved table is a plain side of
    # the join: Spark broadcasts it if it is small and splits hot keys if not.
    copies = saved(groups.filter("group_size > 1").select("h", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    signed = d.select("doc_id", hash128("text").alias("h"), F.sha2("text", 256).alias("text_sha256"))
    found = signed.join(copies, ["h", "text_sha256"], "left")
    single = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that :func:`exact_duplicates` drops; of rows that repeat id and text one stays.

    Which of these it is, if their other columns differ, is not defined. Rows
    with a null id stay if no other row has their text, one of each text.
    """
    names = docs.columns
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.sha2(one_spaced(F.col(f"`{text_col}`")), 256).alias("sha"))
    found = exact_duplicates(docs, id_col, text_col).filter("group_size > 1").groupBy("doc_id", "text_sha256", "kept").count()
    found = saved(found.filter("NOT kept OR count > 1").select("doc_id", "text_sha256", "kept"))
    same = boxed["id"].eqNullSafe(F.col("doc_id")) & (F.col("sha") == F.col("text_sha256"))
    left = boxed.join(found.select("doc_id", "text_sha256"), same, "left_anti")
    if not found.filter("kept").head(1):
        return left.select("row.*")
    one = boxed.join(found.filter("kept"), same, "left_semi").dropDuplicates(["id", "sha"])
    return left.unionByName(one).select("row.*")
