"""Recall by similar spelling from postings of three-letter parts.

A term and a field are alike by the best extent of the field: the run of its
parts, in order, whose distinct parts have most in common with the term's. A
field that is alike enough has so many of the term's parts that at least one of
the rarest is among them; only postings of these are read, and what they name is
then compared in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.buckets import dealt, of_rows, of_values
from .ranking import tokens

#: Least likeness of a match.
LEAST = 0.4
_POSTINGS, _SIZES, _TEXTS = "gram string, id long, field string", "gram string, n long", "id long, field string, words array<string>"


def parts_of(words: list[str]) -> list[str]:
    """The parts of words in order, each word with two blanks before and one behind."""
    return [p[i : i + 3] for p in (f"  {w} " for w in words) for i in range(len(p) - 2)]


def word_similarity(term: set[str], parts: list[str]) -> float:
    """The most of |common| / |either| over the extents of ``parts``; an extent counts its distinct parts."""
    hits = [i for i, p in enumerate(parts) if p in term]
    best = 0.0
    for at, first in enumerate(hits):
        seen, common = set(), 0
        for i in range(first, hits[-1] + 1):
            if parts[i] not in seen:
                seen.add(parts[i])
                common += parts[i] in term
            best = max(best, common / (len(term) + len(seen) - common))
            if len(term) / (len(term) + len(seen) - common) <= best:
                break  # what follows only makes it longer
        if len(hits) - at <= 1:
            break
    return best


def rarest(sizes: dict[str, int], parts: set[str], least: float) -> list[str]:
    """The parts of which a field has one at least if it has as many of them as the likeness ``least`` needs."""
    needed = max(1, math.ceil(least * len(parts) - 1e-9))
    return sorted(parts, key=lambda p: (sizes.get(p, 0), p))[: len(parts) - needed + 1]


class SpellingIndex:
    """Postings of the parts of named fields under ``path``; built once, read by many searches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, fields: DataFrame) -> None:
        """From rows (id, field, text), one for each field of a row; null texts have no parts."""
        f = fields.select(F.col("id").cast("long").alias("id"), "field", tokens(F.col("text")).alias("words")).filter(F.size("words") > 0)
        padded = F.transform("words", lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
        grams = F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))))
        postings = f.select(F.explode(grams).alias("gram"), "id", "field")
        dealt(postings, f"{self.path}/postings", "gram", "id")
        dealt(f, f"{self.path}/texts", "id", "field")
        written = self.spark.read.schema(f"{_POSTINGS}, bucket int").parquet(f"{self.path}/postings")
        dealt(written.groupBy("gram").agg(F.count("*").alias("n")), f"{self.path}/sizes", "gram", "gram")

    def search(self, terms: tuple[str, ...], least: float = LEAST) -> DataFrame:
        """(id, field, term, near) of all fields whose likeness to a term is ``least`` or more."""
        sets = {t: set(parts_of([t])) for t in terms}
        every = sorted(set().union(*sets.values())) if sets else []
        # A few dozen parts of the terms.
        sizes = {r.gram: r.n for r in of_values(self.spark, f"{self.path}/sizes", _SIZES, "gram", every).collect()}
        probes = [(t, p) for t, s in sets.items() for p in rarest(sizes, s, least)]
        asked = self.spark.createDataFrame(probes, "term string, gram string")
        found = of_values(self.spark, f"{self.path}/postings", _POSTINGS, "gram", sorted({p for _, p in probes}))
        candidates = found.join(F.broadcast(asked), "gram").select("id", "field", "term").distinct()
        texts = of_rows(self.spark, f"{self.path}/texts", _TEXTS, "id", candidates)
        return self._compared(texts.join(candidates, ["id", "field"]), sets).filter(F.col("near") >= least)

    @staticmethod
    def _compared(rows: DataFrame, sets: dict[str, set[str]]) -> DataFrame:
        """(id, field, term, near) of rows (id, field, words, term)."""

        def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                value = [word_similarity(sets[t], parts_of(list(w))) for t, w in zip(f["term"], f["words"], strict=True)]
                yield f[["id", "field", "term"]].assign(near=value)

        return rows.select("id", "field", "term", "words").mapInPandas(near, "id long, field string, term string, near double")

    def scores(self, ids: DataFrame, terms: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
        """(id, score): of some rows the most that one of the fields is like one of the terms; rows without these fields are left out."""
        texts = of_rows(self.spark, f"{self.path}/texts", _TEXTS, "id", ids).filter(F.col("field").isin(*fields))
        each = texts.withColumn("term", F.explode(F.array(*map(F.lit, terms))))
        return self._compared(each, {t: set(parts_of([t])) for t in terms}).groupBy("id").agg(F.max("near").alias("score"))
