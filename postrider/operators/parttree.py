"""The body and the attachments of messages from their trees of parts, open JSON as servers describe them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.columns import only

#: Fixed value: levels of parts below the message.
MOST_DEPTH = 64


def _of(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("node", F.lit(path), kind)


def leaf_parts(trees: DataFrame, id_col: str = "id", tree_col: str = "tree") -> DataFrame:
    """(id, path, node): the parts without parts of their own, from a tree or an array of trees of type VARIANT.

    ``path`` has a part's place at each level, so that paths in order are the
    parts in order. A message's tree is opened level by level within its row;
    parts below :data:`MOST_DEPTH` do not count, nor does one whose parts are
    all too deep. A tree that is null or no object gives no rows.
    """
    t = only(trees, id=id_col, node=tree_col)
    kind = "array<struct<path:array<int>,node:variant>>"
    children = lambda x: F.try_variant_get(x["node"], F.lit("$.childNodes"), "array<variant>")
    many = lambda x: F.size(F.coalesce(children(x), F.array().cast("array<variant>"))) > 0
    placed = lambda nodes, path: F.transform(nodes, lambda c, i: F.struct(F.concat(path, F.array(i)).alias("path"), c.alias("node")))
    top = F.coalesce(F.try_variant_get("node", F.lit("$"), "array<variant>"), F.array("node"))
    start = F.struct(placed(top, F.array().cast("array<int>")).cast(kind).alias("open"), F.array().cast(kind).alias("done"))

    def opened(acc: Column, _: Column) -> Column:
        nodes = F.filter(acc["open"], lambda x: F.startswith(F.schema_of_variant(x["node"]), F.lit("OBJECT")))
        below = F.flatten(F.transform(F.filter(nodes, many), lambda x: placed(children(x), x["path"])))
        return F.struct(below.cast(kind).alias("open"), F.concat(acc["done"], F.filter(nodes, lambda x: ~many(x))).alias("done"))

    found = F.aggregate(F.sequence(F.lit(0), F.lit(MOST_DEPTH)), start, opened)["done"]
    return t.filter("node IS NOT NULL").select("id", F.inline(found))


def described(leaves: DataFrame) -> DataFrame:
    """(id, path, part, type, disposition, filename, content_id, encoding, size) of leaves; blank part numbers are null."""
    first = lambda c: F.trim(F.split(F.lower(F.coalesce(c, F.lit(""))), ";")[0])
    main, sub = first(_of("$.type")), first(_of("$.subtype"))
    kind = F.when(F.contains(main, F.lit("/")), main).when(sub != "", F.concat(main, F.lit("/"), sub)).otherwise(main)
    # A disposition is a string, or an object with its own parameters.
    text = F.when(F.schema_of_variant(_of("$.disposition", "variant")) == "STRING", _of("$.disposition"))
    disposition = F.nullif(F.lower(F.coalesce(text, _of("$.disposition.type"))), F.lit(""))
    name = F.coalesce(F.nullif(_of("$.disposition.params.filename"), F.lit("")), _of("$.dispositionParameters.filename"), _of("$.parameters.name"))
    return leaves.select(
        "id", "path", F.nullif(F.trim(_of("$.part")), F.lit("")).alias("part"), F.regexp_replace(kind, "/+$", "").alias("type"), disposition.alias("disposition"),
        name.alias("filename"), _of("$.id").alias("content_id"), F.lower(_of("$.encoding")).alias("encoding"), _of("$.size", "long").alias("size"),
    )


def body_parts(parts: DataFrame, prefer: str = "plain") -> DataFrame:
    """(id, part, format): the first inline text of the preferred format, or else the first of the other; a part without a number is TEXT."""
    inline = parts.filter(F.col("type").isin("text/plain", "text/html", "text/x-amp-html") & (F.coalesce("disposition", F.lit("inline")) == "inline"))
    form = F.when(F.col("type") == "text/plain", "plain").otherwise("html")
    rows = inline.select("id", form.alias("format"), F.coalesce("part", F.lit("TEXT")).alias("part"), "path")
    return rows.groupBy("id").agg(F.min_by(F.struct("part", "format"), F.struct(F.col("format") != prefer, "path")).alias("x")).select("id", "x.part", "x.format")


def attached(parts: DataFrame) -> DataFrame:
    """(id, path, part, filename, mime, bytes, disposition, content_id) of numbered parts that are attachments: by disposition, or inline with a file name or an id. Of base64 three quarters are the size."""
    inline = (F.col("disposition") == "inline") & ((F.coalesce("filename", F.lit("")) != "") | (F.coalesce("content_id", F.lit("")) != ""))
    rows = parts.filter(F.col("part").isNotNull() & (inline | (F.col("disposition") == "attachment")))
    size = F.when(F.col("encoding") == "base64", F.floor(F.col("size") * 3 / 4)).otherwise(F.col("size")).cast("long")
    return rows.select("id", "path", "part", "filename", F.nullif("type", F.lit("")).alias("mime"), size.alias("bytes"), F.when(inline, "inline").otherwise("attachment").alias("disposition"), "content_id")
