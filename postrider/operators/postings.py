"""Full-text search from postings: for each word and block of messages, who has it, how often and where.

An index is built once and read by many searches. A search reads the folders of
its own words; ranking by text alone also skips blocks whose best possible score
is below what was found.
"""

from __future__ import annotations

import functools
import math
import operator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemming import stem
from ..plans.buckets import dealt, of_values
from ..plans.staging import stage
from .ranking import Terms, once, tokens

#: Messages of a block, about.
BLOCK = 512
#: Weights of header and body in the score of a text.
WEIGHTS = {"head": 0.6, "body": 0.2}
#: Messages of a block that have a word, how many words each has, and the places of the word in all of them: those of a message end before its ``end``.
_BLOCKS = "word string, field string, block long, top double, ids array<long>, ns array<int>, ends array<int>, places array<int>"


def _words(terms: Terms) -> list[str]:
    return sorted({w for t in (*terms.words, *terms.without) for w in t.lower().split()})


def frequency(term: str) -> Column:
    """How often a word or a phrase occurs in ``of``, a map of words to their places; occurrences of a phrase do not overlap."""
    parts = term.lower().split()
    places = lambda w: F.coalesce(F.try_element_at("of", F.lit(w)), F.array().cast("array<int>"))
    if len(parts) == 1:
        return F.size(places(parts[0]))
    starts = functools.reduce(F.array_intersect, [_shifted(places(w), i) for i, w in enumerate(parts)])
    count = lambda s, p: F.when(p >= s["free"], F.struct((s["n"] + 1).alias("n"), (p + len(parts)).cast("int").alias("free"))).otherwise(s)
    return F.aggregate(F.array_sort(starts), F.struct(F.lit(0).alias("n"), F.lit(0).cast("int").alias("free")), count)["n"]


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: (p - F.lit(by)).cast("int"))


def _rank(terms: Terms) -> Column:
    met = functools.reduce(operator.and_, [functools.reduce(operator.or_, [frequency(t) > 0 for t in g]) for g in terms.groups], F.lit(True))
    hits = functools.reduce(operator.add, [frequency(t) for t in terms.words], F.lit(0))
    return F.when(met, hits / (1 + F.log(F.col("n") + 1))).otherwise(0.0)


class TextIndex:
    """Postings of the header fields and bodies of messages under ``path``."""

    def __init__(self, spark: SparkSession, path: str, stemmed: bool = False):
        """``stemmed``: words are kept and looked for by their English stems."""
        self.spark, self.path, self.stemmed = spark, path, stemmed

    def _by_stems(self, terms: Terms) -> Terms:
        if not self.stemmed:
            return terms
        one = lambda t: " ".join(map(stem, t.lower().split()))
        return Terms(tuple(tuple(dict.fromkeys(map(one, g))) for g in terms.groups), tuple(map(one, terms.without)))

    def build(self, messages: DataFrame, head: Column, body: Column) -> None:
        """From messages with an ``id``, and the texts of their header fields and bodies."""
        n = max(1, messages.count() // BLOCK)
        # Words as one text are shuffled once; all postings of a block are made where its messages are.
        text = lambda c: F.array_join(tokens(c), " ")
        rows = messages.select(F.col("id").cast("long").alias("id"), text(head).alias("head"), text(body).alias("body"))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)))

        form = stem if self.stemmed else str

        def inverted(t: pa.Table) -> pa.Table:
            block, t = t["block"][0].as_py(), t.sort_by("id")
            lists: dict[tuple[str, str], tuple[list, list, list, list]] = {}
            tops: dict[tuple[str, str], float] = {}
            for field in WEIGHTS:
                for i, text in zip(t["id"].to_pylist(), t[field], strict=True):
                    words = (text.as_py() or "").split()
                    found: dict[str, list[int]] = {}
                    for p, w in enumerate(map(form, words)):
                        found.setdefault(w, []).append(p)
                    part = 1 + math.log(len(words) + 1)
                    for w, at in found.items():
                        ids, ns, ends, places = lists.setdefault((w, field), ([], [], [], []))
                        ids.append(i)
                        ns.append(len(words))
                        places.extend(at)
                        ends.append(len(places))
                        tops[w, field] = max(tops.get((w, field), 0.0), len(at) / part)
            columns = [[w for w, _ in lists], [f for _, f in lists], [block] * len(lists), [tops[k] for k in lists], *zip(*lists.values(), strict=True)] if lists else [[]] * 8
            ints = pa.list_(pa.int32())
            kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.list_(pa.int64()), ints, ints, ints)
            return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "field", "block", "top", "ids", "ns", "ends", "places"])

        blocks = rows.groupBy("block").applyInArrow(inverted, _BLOCKS)
        dealt(blocks, f"{self.path}/words", "word")

    def _postings(self, terms: Terms) -> DataFrame:
        return of_values(self.spark, f"{self.path}/words", _BLOCKS, "word", _words(terms))

    def _ranked(self, postings: DataFrame, terms: Terms, wide: Terms | None = None) -> DataFrame:
        """(id, head, body, wide_head, wide_body): ranks of the messages that have any of the words; those with a word that none may have are left out."""
        rows = postings.select("word", "field", "places", F.inline(F.arrays_zip("ids", "ns", "ends", F.concat(F.array(F.lit(0)), "ends").alias("starts")))).filter("ids IS NOT NULL")
        rows = rows.select("word", "field", F.col("ids").alias("id"), F.col("ns").alias("n"), F.slice("places", F.col("starts") + 1, F.col("ends") - F.col("starts")).alias("places"))
        g = rows.groupBy("id", "field").agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("of"))
        barred = functools.reduce(operator.or_, [frequency(w) > 0 for w in terms.without], F.lit(False))
        none = F.lit(0.0)
        g = once(g, rank=_rank(terms), wide=_rank(wide) if wide and wide.groups else none, barred=barred)
        of = lambda field, column: F.coalesce(F.max(F.when(F.col("field") == field, F.col(column))), none)
        found = g.groupBy("id").agg(of("head", "rank").alias("head"), of("body", "rank").alias("body"), of("head", "wide").alias("wide_head"), of("body", "wide").alias("wide_body"), F.bool_or("barred").alias("barred"))
        return found.filter("NOT barred AND (head > 0 OR body > 0 OR wide_head > 0 OR wide_body > 0)").drop("barred")

    def ranks(self, terms: Terms, wide: Terms | None = None) -> DataFrame:
        """Ranks of all messages that the terms, or the wider ones, find; as a scan of all texts gives them."""
        terms, wide = self._by_stems(terms), wide and self._by_stems(wide)
        every = Terms(terms.groups + (wide.groups if wide else ()), terms.without)
        return self._ranked(self._postings(every), terms, wide)

    def best(self, terms: Terms, k: int = 25) -> DataFrame:
        """(id, text_rel) of the ``k`` best by their text, ties to the larger id.

        A block's bound is what its messages would have with the most of each
        word. The blocks with the highest bounds are scored first; of the others
        only those whose bound reaches the k-th score found are read.
        """
        terms = self._by_stems(terms)
        postings = self._postings(terms)
        tops = postings.select("word", "field", "block", "top").groupBy("block", "field").agg(F.map_from_entries(F.collect_list(F.struct("word", "top"))).alias("of"))
        top = lambda t: functools.reduce(F.least, [F.coalesce(F.try_element_at("of", F.lit(w)), F.lit(0.0)) for w in t.lower().split()])
        may = functools.reduce(operator.and_, [functools.reduce(operator.or_, [top(t) > 0 for t in g]) for g in terms.groups], F.lit(True))
        weight = F.when(F.col("field") == "head", WEIGHTS["head"]).otherwise(WEIGHTS["body"])
        bound = F.when(may, functools.reduce(operator.add, [top(t) for t in terms.words], F.lit(0.0)) * weight).otherwise(0.0)
        bounds = stage(tops.groupBy("block").agg(F.sum(bound).alias("bound")).filter("bound > 0"))
        order = [F.desc("text_rel"), F.desc("id")]
        scored = lambda p: self._ranked(p, terms).select("id", F.round(WEIGHTS["head"] * F.col("head") + WEIGHTS["body"] * F.col("body"), 9).alias("text_rel")).filter("text_rel > 0")
        first = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(4).collect()]
        found = scored(postings.filter(F.col("block").isin(first))).orderBy(*order).limit(k)
        least = [r.text_rel for r in found.collect()]
        left = bounds.filter(F.col("bound") >= (least[-1] - 1e-9 if len(least) == k else 0.0))
        return scored(postings.join(left.select("block"), "block", "left_semi")).orderBy(*order).limit(k)
