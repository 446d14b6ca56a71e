"""Ordinal cumulative-link regression on graded ratings, with hashed-text weights."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.columns import only
from ..plans.staging import stage

#: Words, of up to 40 bytes, whose feature numbers a Python worker remembers; the first ones stay.
REMEMBERED = 100_000
_KNOWN: dict[bytes, tuple[int, ...]] = {}


def _numbers(word: bytes, bits: int) -> tuple[int, ...]:
    """Hashed features of a lower-cased word: itself, its first 4 and 5 letters, its last 3."""
    mask = (1 << bits) - 1
    return tuple({zlib.crc32(kind + part) & mask for kind, part in ((b"w", word), (b"4", word[:4]), (b"5", word[:5]), (b"s", word[-3:]))})


def features(text: str | None, bits: int = 20) -> np.ndarray:
    """Distinct feature numbers of a whole text: those of its words, and four shapes in tenths."""
    raw = (text or "").encode()
    words = raw.lower().split()
    distinct = set(words)
    found: set[int] = set()
    for w in distinct:
        k = _KNOWN.get(w)
        if k is None:
            k = _numbers(w, bits)
            if len(w) <= 40 and len(_KNOWN) < REMEMBERED:
                _KNOWN[w] = k
        found.update(k)
    n = max(len(raw), 1)
    letters = sum(map(len, words)) or 1
    upper = n - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = n - len(raw.translate(None, b"!#$%&*+/<=>@[]^_{|}~"))
    shapes = (len(distinct) / max(len(words), 1), upper / letters, marks / letters, min(len(words), 90) / 100)
    mask = (1 << bits) - 1
    found.update(zlib.crc32(b"shape%d:%d" % (i, int(10 * s))) & mask for i, s in enumerate(shapes))
    return np.fromiter(found, np.int32, len(found))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(thresholds[k] - weights . features), the weights shared by all thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def score(self, text: str | None) -> float:
        return float(self.weights[features(text, self.bits)].sum(dtype=np.float64))

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, one column each."""
        return _sigmoid(score[:, None] - self.thresholds)


def telling(rows: list[np.ndarray], grades: np.ndarray, bits: int, least: float = 0.04, floor: float = 30.0) -> np.ndarray:
    """Which features' presence depends on the grade: chi-square of at least ``floor``, and of ``least`` for each row.

    Most words of a text are in few others, and with weights of their own they
    would only learn the sample by heart.
    """
    size = np.bincount(grades)
    counts = np.stack([np.bincount(np.concatenate([rows[i] for i in np.nonzero(grades == k)[0]] or [np.empty(0, np.int32)]), minlength=1 << bits) for k in range(len(size))])
    share = size[:, None] / max(len(rows), 1)
    n = counts.sum(axis=0)
    have, lack = share * n, share * (len(rows) - n)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.nansum((counts - have) ** 2 / have, axis=0) + np.nansum((size[:, None] - counts - lack) ** 2 / lack, axis=0)
    return chi >= max(floor, least * len(rows))


def fit(rows: list[np.ndarray], grades: np.ndarray, bits: int = 20, epochs: int = 40, rate: float = 0.1, batch: int = 32, seed: int = 1) -> OrdinalModel:
    """Maximum likelihood over the telling features, with adaptive steps.

    Thresholds stay in order. With a single grade or no rows the model is constant.
    """
    if len(rows):
        keep = telling(rows, grades, bits)
        rows = [x[keep[x]] for x in rows]
    top = int(grades.max(initial=0))
    w = np.zeros(1 << bits, np.float64)
    seen = np.full(1 << bits, 1e-8)
    theta = np.arange(top, dtype=np.float64) * 2 - (top - 1)
    seen_theta = np.full(top, 1e-8)
    r = np.random.default_rng(seed)
    for _ in range(epochs if top else 0):
        order = r.permutation(len(rows))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            sizes = np.array([len(rows[i]) for i in chosen])
            idx = np.concatenate([rows[i] for i in chosen])
            of = np.repeat(np.arange(len(chosen)), sizes)
            z = np.bincount(of, w[idx], len(chosen))
            y = grades[chosen]
            cum = np.concatenate([np.zeros((len(y), 1)), _sigmoid(theta - z[:, None]), np.ones((len(y), 1))], axis=1)
            slope = cum * (1 - cum)
            each = np.arange(len(y))
            p = np.maximum(cum[each, y + 1] - cum[each, y], 1e-9)
            gz = (slope[each, y + 1] - slope[each, y]) / p / len(y)
            gt = np.zeros(top + 2)
            np.add.at(gt, y + 1, -slope[each, y + 1] / p / len(y))
            np.add.at(gt, y, slope[each, y] / p / len(y))
            touched, inverse = np.unique(idx, return_inverse=True)
            g = np.bincount(inverse, gz[of])
            seen[touched] += g * g
            w[touched] -= rate * g / np.sqrt(seen[touched])
            seen_theta += gt[1:-1] ** 2
            theta -= rate * gt[1:-1] / np.sqrt(seen_theta)
            theta = np.maximum.accumulate(theta + np.arange(top) * 1e-6)
    return OrdinalModel(w.astype(np.float32), theta, bits)


def fit_ratings(docs: DataFrame, ratings: DataFrame, per_grade: int = 1000, bits: int = 20, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> OrdinalModel:
    """Fit on a bounded sample: of each grade the ``per_grade`` rated ids with the smallest hashes.

    Rows without id or grade take no part; of an id's grades the lowest counts;
    texts of an id in several rows all count. Empty tables give a constant
    model. What reaches the driver are the sampled texts' feature numbers, so it
    is bounded by ``per_grade`` and the number of grades, not by the input.
    """
    r = only(ratings, id=id_col, grade=F.col(f"`{grade_col}`").cast("int")).dropna()
    r = stage(r.groupBy("id").agg(F.min("grade").alias("grade")))
    # Each task hands on its smallest hashes of a grade only. Written first: the
    # bounded sample is then small enough to broadcast for Spark to see, and the
    # texts need no shuffle.
    grades = sorted(x["grade"] for x in r.select("grade").distinct().collect())
    tops = [r.filter(F.col("grade") == g).orderBy(F.xxhash64("id"), "id").limit(per_grade) for g in grades]
    r = stage(reduce(DataFrame.union, tops, r.limit(0)))
    d = only(docs, id=id_col, text=text_col)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([features(t.as_py(), bits).tobytes() for t in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), x], ["id", "grade", "x"])

    found = d.join(r, "id").select(F.col("id").cast("long"), "grade", "text").mapInArrow(extracted, "id long, grade int, x binary").toArrow()
    rows = sorted(zip(found["id"].to_pylist(), found["grade"].to_pylist(), found["x"].to_pylist(), strict=True))
    rows = list({x: (i, g, x) for i, g, x in reversed(rows)}.values())  # copies would count as evidence again
    return fit([np.frombuffer(x, np.int32) for _, _, x in rows], np.array([g for _, g, _ in rows], np.int64), bits)


def graded(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, expected_grade, tail (probability of the top grade).

    Whole texts are scored; null counts as empty. Null and repeated ids are
    passed through, other columns are not read. Tasks get the weights (4 MB for
    20 bits). No shuffle.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            z = np.fromiter((m.score(t.as_py()) for t in b.column(1)), np.float64, b.num_rows)
            tails = m.tails(z)
            top = tails[:, -1] if tails.shape[1] else np.ones(len(z))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tails.sum(axis=1)), pa.array(top)], ["doc_id", "expected_grade", "tail"])

    d = only(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=text_col)
    return d.mapInArrow(run, "doc_id long, expected_grade double, tail double")


def accepted(docs: DataFrame, model: OrdinalModel, least: float = 0.25, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without rows whose probability of the top grade is under ``least``. One pass, no join."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            z = np.fromiter((m.score(t.as_py()) for t in b.column(at)), np.float64, b.num_rows)
            tails = m.tails(z)
            yield b.filter(pa.array(tails[:, -1] >= least if tails.shape[1] else np.ones(len(z), bool)))

    return docs.mapInArrow(run, docs.schema)
