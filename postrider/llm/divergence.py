"""Audit of sources: how far the terms of each source lie from those of other sources of its language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.columns import only
from ..plans.staging import stage
from .text import sliced

#: Fixed value: what parts terms, all of ASCII but letters.
NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Probabilities are whole numbers of so many parts; the division goes by thousands, three times.
STEP, STEPS = 1000, 3
#: Bytes of text that are counted at a time, and rows of counts that a task holds before it sends them on.
SLICE, HELD = 8 << 20, 600_000
#: Cells (terms times sources) of a shard.
CELLS = 400_000


def batch_counts(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of rows (lang, source, text): how often a term occurs and in how many rows."""
    lang, source = (c.fill_null("").dictionary_encode() for c in batch.columns[:2])
    of_row = pc.add(pc.multiply(lang.indices.cast(pa.int64()), pa.scalar(len(source.dictionary), pa.int64())), source.indices.cast(pa.int64()))
    parts = pc.split_pattern_regex(pc.ascii_lower(batch.column(2).fill_null("")), NO_TERM)
    terms, row = pc.list_flatten(parts), pc.list_parent_indices(parts)
    some = pc.greater(pc.binary_length(terms), 0)
    coded = terms.filter(some).dictionary_encode()
    by_row = pa.table({"row": row.filter(some), "term": coded.indices}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
    by_row = pa.table({"group": of_row.take(by_row["row"]), "term": by_row["term"], "n": by_row["count_all"]})
    sums = by_row.group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    group = sums["group"].to_numpy()
    named = {"lang": lang.dictionary.take(pa.array(group // max(1, len(source.dictionary)))), "source": source.dictionary.take(pa.array(group % max(1, len(source.dictionary))))}
    return pa.table(named | {"term": coded.dictionary.take(sums["term"].combine_chunks()), "n": sums["n_sum"].cast(pa.int64()), "docs": sums["n_count"].cast(pa.int64())})


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a task's rows, merged until they are too many to hold."""
    held, rows = [], 0

    def merged() -> pa.Table:
        sums = pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return pa.table({c: sums[s] for c, s in (("lang", "lang"), ("source", "source"), ("term", "term"), ("n", "n_sum"), ("docs", "docs_sum"))})

    for batch in batches:
        for part in sliced(batch, 2, 1 << 20, SLICE):
            held.append(batch_counts(part))
            rows += held[-1].num_rows
            if rows > HELD:
                held = [merged()]
                rows = held[0].num_rows
                if rows > HELD // 2:
                    yield from held[0].to_batches(1 << 16)
                    held, rows = [], 0
    if held:
        yield from merged().to_batches(1 << 16)


def kept_terms(docs: DataFrame, least_docs: int, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, term, found): the terms in ``least_docs`` rows of a language or more, with an array of (source, n), one for each source that has the term."""
    d = only(docs, lang=lang_col, source=source_col, text=text_col)
    counts = d.mapInArrow(partial_counts, "lang string, source string, term string, n long, docs long")
    # One shuffle serves both groupings.
    sums = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("found"))
    return terms.filter(F.col("docs") >= least_docs).select("lang", "term", "found")


def scaled(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """floor(count * 10^9 / total), exact as long as a thousand totals fit into 64 bits."""
    out, rest = np.divmod(count, total)
    for _ in range(STEPS):
        more, rest = np.divmod(rest * STEP, total)
        out = out * STEP + more
    return out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q), whole numbers."""
    return (p - q) ** 2 // q


def shard_values(terms: pd.DataFrame, groups: pd.DataFrame, top: int) -> pd.DataFrame:
    """(lang, source, part, item, value) of one shard of a language's terms: sums for each pair of sources, and each source's foremost terms.

    ``terms`` (term, found) are the shard's, ``groups`` (lang, source, n, v) all sources of the language.
    """
    groups = groups.sort_values("source")
    sources = groups["source"].to_numpy()
    n, v = groups["n"].to_numpy(), int(groups["v"].iat[0])
    at = {s: i for i, s in enumerate(sources)}
    # In order of the terms, so that a stable sort by value leaves ties in it.
    terms = terms.sort_values("term")
    counts = np.zeros((len(terms), len(sources)), np.int64)
    for row, found in enumerate(terms["found"]):
        for x in found:
            counts[row, at[x["source"]]] = x["n"]
    p = 1 + scaled(counts + 1, np.maximum(n + v, 1))
    named = terms["term"].to_numpy()
    of_lang = 1 + scaled(counts.sum(axis=1) + 1, max(int(n.sum()) + v, 1))
    out = []
    for i, source in enumerate(sources):
        sums = distance(p[:, i : i + 1], p).sum(axis=0)
        others = np.arange(len(sources)) != i
        out.append(pd.DataFrame({"source": source, "part": "pair", "item": sources[others], "value": sums[others]}))
        own = np.nonzero((counts[:, i] > 0) & (p[:, i] > of_lang))[0]
        value = distance(p[own, i], of_lang[own])
        first = np.argsort(-value, kind="stable")[:top]
        out.append(pd.DataFrame({"source": source, "part": "term", "item": named[own[first]], "value": value[first]}))
    found = pd.concat(out)
    found.insert(0, "lang", groups["lang"].iat[0])
    return found


def source_divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language differs from the others, and by which terms.

    Terms are runs of ASCII letters and of all characters beyond ASCII; only
    A-Z are lower-cased. A language keeps the V terms in ``least_docs`` of its
    rows or more. With N occurrences of kept terms, a source, and a language,
    gives a term that occurs ``count`` times there p = 1 + floor(10^9 (count + 1)
    / (N + V)); f = floor((p - q)^2 / q). Part ``pair`` has for each other
    source of the language the sum of f over all kept terms, q its p. Part
    ``term`` has the ``top`` terms that the source has more often than the
    language, q the language's p. ``rank`` counts from 1 in each source and
    part, by falling value, ties by item in byte order. All numbers are exact.

    Null lang, source and text are ''. A source without terms takes part with
    N = 0; where V is 0 all pairs are at 0. A source that is alone in its
    language has no pairs. Each row counts as a document, rows that repeat an id
    too. An empty table gives an empty result; other columns are not read.

    Tasks count in Arrow and send one row for each source and term that they
    saw; the terms of a language are then dealt into shards of bounded size by
    hash, each with all sources' counts, so a source or language with most of
    the rows is in many tasks. The result, and the sums that shards send, grow
    with the square of the sources of a language, since each pair is listed.
    """
    terms = stage(kept_terms(docs, least_docs, lang_col, source_col, text_col))
    d = only(docs, lang=F.coalesce(F.col(f"`{lang_col}`"), F.lit("")), source=F.coalesce(F.col(f"`{source_col}`"), F.lit("")))
    sizes = terms.select("lang", F.explode("found").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    of_lang = terms.groupBy("lang").agg(F.count("*").alias("v"))
    zero = F.lit(0).cast("long")
    groups = d.distinct().join(sizes, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = stage(groups.select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("v", zero).alias("v")))
    in_shard = F.greatest(F.lit(CELLS) / F.col("sources"), F.least("sources", F.lit(2000)))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("v").alias("v"))
    langs = stage(langs.select("lang", F.greatest(F.lit(1), F.ceil(F.col("v") / in_shard)).cast("int").alias("shards")))
    left = terms.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "term", "found")
    right = groups.join(langs, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "source", "n", "v")

    def values(t: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        return shard_values(t, g, top)

    found = left.groupBy("lang", "shard").cogroup(right.groupBy("lang", "shard")).applyInPandas(values, "lang string, source string, part string, item string, value long")
    found = stage(found)
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    foremost = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.unionByName(foremost).select("lang", "source", "part", "item", "value", "rank")
