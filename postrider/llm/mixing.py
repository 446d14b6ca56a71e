"""Mixing sources to target weights, in blocks drawn through index permutations. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.columns import only
from ..plans.staging import stage
from .text import n_words, one_spaced

#: Fixed values of the contract: weights by the rank of the source, the mix's share of all words, the most of a source.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Words in a block, slots in an output shard.
BLOCK = 512
SHARD = 1024
#: Documents are numbered in groups of about so many.
GROUP = 256
#: Groups, or shards, of a source that one window sums.
SPAN = 4096


def _draw(*parts) -> Column:
    """A pseudorandom number from 0 to 2^62 - 1 that the parts fix."""
    return F.shiftright(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), 2).bitwiseAND(F.lit((1 << 62) - 1))


def permuted(x: Column, n: Column, *key) -> Column:
    """Where the pseudorandom permutation of 0..n-1 that the key fixes takes x.

    A square of a x b numbers, a the root of n, is shuffled by adding to the
    row a draw from the column, then the reverse: bijections of the square for
    any draw. A square at the start and one at the end of the range take turns,
    so that the numbers beyond a * b move too. The turns are a fold over an
    array; written out, the expression would grow with the power of the turns.
    """
    a = F.greatest(F.lit(1), F.floor(F.sqrt(n))).cast("long")
    b = F.floor(n / a).cast("long")

    def turned(at: Column, turn: Column) -> Column:
        start = F.when(turn % 2 == 0, F.lit(0).cast("long")).otherwise(n - a * b)
        y = at - start
        row, col = F.floor(y / b).cast("long"), F.pmod(y, b)
        row = F.pmod(row + _draw(turn, 0, col, *key), a)
        col = F.pmod(col + _draw(turn, 1, row, *key), b)
        return F.when((y >= 0) & (y < a * b), start + row * b + col).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(3)), x.cast("long"), turned)


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, rank, weight, source_size, target) from rows (source, size).

    Targets share ``SHARE`` of all sizes by weight, none above ``MOST`` times
    its source's size: in rising order of limit by weight, the sources before
    some place are at their limit and the rest get one level times their
    weight. One row for each source goes through one task.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("limit", F.col("source_size") * MOST)
    before = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(every) * SHARE - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level)
    # Too few or too many sources at their limit only give a lower level.
    s = s.withColumn("level", F.max("level").over(every))
    target = F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight"))
    return s.select("source", "rank", "weight", "source_size", target.alias("target"))


def _before(rows: DataFrame, by: str, at: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of the same ``by`` that come before by ``at``, a number from 0.

    Sums go over spans of ``at`` first, then within each: no window holds more
    than a span's rows, or a source's spans.
    """
    spans = rows.withColumn("span", F.floor(F.col(at) / SPAN))
    totals = spans.groupBy(by, "span").agg(F.sum(value).alias("of_span"))
    order = Window.partitionBy(by).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(by, "span", F.coalesce(F.sum("of_span").over(order), F.lit(0)).alias("spans_before"))
    inner = Window.partitionBy(by, "span").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    summed = spans.withColumn("within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return summed.join(totals, [by, "span"]).withColumn(name, F.col("spans_before") + F.col("within")).drop("span", "spans_before", "within")


def _spans(sized: DataFrame, n_docs: int) -> DataFrame:
    """Rows (rank, doc key, start, end): each document's place among its source's words, without a global order.

    Documents are numbered within small groups of a source by hash, and the
    groups within the source: no window holds the rows of a source.
    """
    groups = max(1, n_docs // GROUP)
    g = sized.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups)))
    within = Window.partitionBy("rank", "g").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    totals = g.groupBy("rank", "g").agg(F.sum("size").alias("of_g"))
    totals = _before(totals, "rank", "g", "of_g", "base").select("rank", "g", "base")
    placed = g.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    start = F.col("base") + F.col("inner")
    return placed.join(totals, ["rank", "g"]).select("rank", "key", "size", start.alias("start"), (start + F.col("size")).alias("end"))


def draw_slots(targets: DataFrame, seed: int = 11) -> DataFrame:
    """The mix as slots: (shard, slot, rank, epoch, block, words).

    A source's target is its slots: whole blocks, and one that stops where the
    target is reached. Each slot of each shard draws a source with the slots'
    shares as chances, which makes the counts of a shard multinomial. What a
    source draws beyond its slots goes to those that drew too few. Its draws are
    numbered over the shards; the number, through the permutation of the
    source's blocks for that pass, names the block.
    """
    spark = targets.sparkSession
    t = targets.withColumn("words", F.round("target").cast("long")).filter("source_size > 0")
    full = F.floor(F.col("source_size") / BLOCK).cast("long")
    t = t.withColumn("full", full).withColumn("blocks", F.ceil(F.col("source_size") / BLOCK).cast("long"))
    passes = F.floor(F.col("words") / F.col("source_size")).cast("long")
    slots = passes * F.col("blocks") + F.ceil((F.col("words") - passes * F.col("source_size")) / BLOCK).cast("long")
    t = t.withColumn("slots", slots)
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    t = stage(t.withColumn("first", F.coalesce(F.sum("slots").over(upto), F.lit(0))))
    total = t.agg(F.sum("slots")).head()[0] or 0
    # Each slot draws a number below the total; the source whose range holds it
    # is found by cutting all ranges at the same places, an equal join.
    step = max(1, total // 1024)
    pieces = t.filter("slots > 0").withColumn("piece", F.explode(F.sequence(F.floor(F.col("first") / step), F.floor((F.col("first") + F.col("slots") - 1) / step))))
    drawn = spark.range(total).select(F.floor(F.col("id") / SHARD).cast("long").alias("shard"), F.pmod(_draw(seed, "slot", F.col("id")), F.lit(total)).alias("drawn"))
    drawn = drawn.withColumn("piece", F.floor(F.col("drawn") / step))
    named = drawn.join(pieces.select("piece", "rank", "first", "slots"), "piece").filter("drawn >= first and drawn < first + slots")
    counts = stage(named.groupBy("shard", "rank").agg(F.count("*").alias("n")))
    counts = _before(counts, "rank", "shard", "n", "from").join(t.select("rank", "slots"), "rank")
    kept = counts.withColumn("n_kept", F.greatest(F.lit(0), F.least(F.col("n"), F.col("slots") - F.col("from"))))
    kept = stage(kept)
    # A few rows here stand for very many slots: they are spread before they are expanded.
    spread = kept.filter("n_kept > 0").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "rank")
    valid = spread.select("shard", "rank", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n_kept") - 1)).alias("number"))
    # Draws beyond a source's slots, and slots that were not drawn, are as many:
    # both are numbered and paired. Their number grows with the root of the slots.
    over = kept.filter("n > n_kept").select("shard", "rank", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - F.col("n_kept"))).alias("i"))
    over = over.select("shard", F.row_number().over(Window.orderBy("shard", "rank", "i")).alias("pair"))
    got = kept.groupBy("rank").agg(F.sum("n_kept").alias("got"))
    lacking = t.join(got, "rank", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < slots")
    lacking = lacking.select("rank", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("number"))
    lacking = lacking.withColumn("pair", F.row_number().over(Window.orderBy("rank", "number")))
    numbered = valid.union(over.join(lacking, "pair").select("shard", "rank", "number"))
    s = numbered.join(t.select("rank", "source_size", "words", "full", "blocks"), "rank")
    s = s.withColumn("epoch", F.floor(F.col("number") / F.col("blocks")).cast("long")).withColumn("place", F.pmod("number", F.col("blocks")))
    # The block that the end of the source leaves short is the last of each pass.
    moved = permuted(F.col("place"), F.greatest("full", F.lit(1)), seed, F.col("rank"), F.col("epoch"))
    block = F.when(F.col("place") >= F.col("full"), F.col("full")).otherwise(moved)
    in_block = F.least(F.lit(BLOCK).cast("long"), F.col("source_size") - F.col("place") * BLOCK)
    left = F.col("words") - F.col("epoch") * F.col("source_size") - F.col("place") * BLOCK
    return s.select("shard", "rank", "epoch", block.alias("block"), F.least(in_block, left).alias("words"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs``: (documents, pieces).

    documents: one row for each row of ``docs``: doc_id, source, size,
    source_size, target, taken. pieces: (shard, epoch, rank, block, key, doc_id,
    first, n): the words of a document that a slot takes, by number from 0.

    Sizes are words; a null text has none. A source may be null and is then the
    last. Documents without words are in no block and take 0; a mix of no words
    is empty. No document is taken more than ``MOST`` times. Rows that repeat an
    id are documents of their own, told apart by their text; equal rows are
    joined as one document, and each gets an equal share of what that takes.
    Draws depend on the ids, the texts and ``seed`` alone: reruns agree. Other
    columns are not read.
    """
    d = only(docs, doc_id=F.col(f"`{id_col}`").cast("long"), source=source_col, text=text_col)
    key = F.xxhash64("doc_id", "text")
    d = d.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("text_key"))
    d = stage(d.groupBy("doc_id", "source", "text_key").agg(F.sum("size").alias("size"), F.count("*").alias("rows")))
    targets = stage(source_targets(d))
    of_source = d.source.eqNullSafe(targets.source)
    sized = d.join(targets.drop("weight"), of_source).select("doc_id", d.source, "text_key", "rows", "size", "rank", "source_size", "target")
    sized = stage(sized.withColumn("key", F.xxhash64("text_key", "doc_id", "rank")))
    spans = _spans(sized.select("rank", "key", "size").filter("size > 0"), d.count())
    each = F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK)))
    parts = spans.select("rank", "key", "start", "end", each.alias("block"))
    low, high = F.greatest("start", F.col("block") * BLOCK), F.least("end", (F.col("block") + 1) * BLOCK)
    parts = parts.select("rank", "block", "key", (low - F.col("block") * BLOCK).alias("low"), (high - low).alias("len"), (low - F.col("start")).alias("first"))
    slots = draw_slots(targets, seed)
    pieces = parts.join(slots, ["rank", "block"]).withColumn("n", F.least(F.col("len"), F.col("words") - F.col("low"))).filter("n > 0")
    pieces = stage(pieces.select("shard", "epoch", "rank", "block", "key", "first", "n"))
    taken = pieces.groupBy("key").agg(F.sum("n").alias("taken"))
    out = sized.join(stage(taken), "key", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    share = F.floor(F.col("taken") / F.col("rows")) + F.when(F.col("row") <= F.col("taken") % F.col("rows"), 1).otherwise(0)
    out = out.select("doc_id", "source", F.floor(F.col("size") / F.col("rows")).cast("long").alias("size"), "source_size", "target", share.cast("long").alias("taken"), "key", "text_key", "rank")
    return out, pieces


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> DataFrame:
    """The mix as rows with the columns of ``docs``: one for each document and pass that takes words of it.

    A pass that takes all of a document's words gives its text unchanged, another
    one the taken words in order, joined by a space. Null texts have no words
    and do not occur; null ids and sources are values like others.
    """
    out, pieces = mixed(docs, id_col, text_col, source_col, seed)
    passes = pieces.groupBy("key", "epoch").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("first", F.col("n").alias("len")))).alias("parts"))
    meta = out.groupBy("key").agg(F.first("doc_id").alias("of_id"), F.first("text_key").alias("of_text"), F.first("size").alias("size"), F.count("*").alias("rows"), F.first("source").alias("of_source"))
    taken = stage(passes.join(meta, "key"))
    doc_id, text, source = (F.col(f"row.`{c}`") for c in (id_col, text_col, source_col))
    # A text is in a row once, and is shuffled once.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = own.withColumn("text_key", F.xxhash64(doc_id.cast("long"), text))
    same = (F.col("text_key") == F.col("of_text")) & doc_id.cast("long").eqNullSafe(F.col("of_id")) & source.eqNullSafe(F.col("of_source"))
    found = own.join(taken.filter("rows = 1"), same)
    several = stage(taken.filter("rows > 1"))
    if several.head(1):
        # Equal rows are one document, which has their words one after the other.
        found = found.unionByName(own.join(several, same).dropDuplicates(["key", "epoch"]))
    words = F.flatten(F.array_repeat(F.split(F.trim(one_spaced(text)), " "), F.col("rows").cast("int")))
    cut = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(words, (p["first"] + 1).cast("int"), p["len"].cast("int")))), " ")
    new = F.when((F.col("rows") == 1) & (F.col("n") >= F.col("size")), text).otherwise(cut)
    return found.select(*[new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
