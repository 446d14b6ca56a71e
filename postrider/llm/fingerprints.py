"""Fingerprints of documents by consistent weighted sampling of their words."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.columns import only
from ..plans.staging import stage

#: Samples of a fingerprint; each is 12 bits, three hex digits.
SAMPLES, BITS = 128, 12
#: Weighted terms whose samples a worker remembers; terms of a text that are compared at a time.
KNOWN, AT_ONCE = 120_000, 4096
#: Rows of the sample that finds the bounds of ranges, for each range.
PER_RANGE = 64
_NUMBERS = (np.arange(SAMPLES, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
#: The sample of a text without terms; no term has it.
NONE = 0


def gamma_quantiles(n: int) -> np.ndarray:
    """The middles of n equal parts of the gamma(2, 1) distribution, whose function is 1 - (1 + x) e^-x, by Newton's steps."""
    p = (np.arange(n) + 0.5) / n
    x = np.where(p < 0.5, np.sqrt(2 * p), 1 - np.log(1 - p))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), x / 4)
    return x


_GAMMA = gamma_quantiles(1 << 16).astype(np.float32)
_LN_GAMMA = np.log(gamma_quantiles(1 << 16)).astype(np.float32)
_BETA = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)


def samples_of(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each weighted term and each sample a number; of a text's terms the one with the least number is sampled.

    For a term and a sample, r and c are drawn from gamma(2, 1) and beta from
    (0, 1), each by 16 bits of a hash of both. With t = floor(ln w / r + beta),
    the term is taken at ln a = ln c - r (t + 1 - beta); the least a over the
    terms of a text is at the same (term, t) in two texts with a chance of the
    sum of their lesser weights by the sum of their greater ones. The upper 20
    bits of the numbers are ln a in the order of its single precision, the lower
    12 name (term, t).
    """
    h = (hashes[:, None] ^ _NUMBERS) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    drawn = h.view(np.uint16).reshape(len(hashes), SAMPLES, 4)
    r, beta = _GAMMA.take(drawn[..., 0]), _BETA.take(drawn[..., 2])
    t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + beta)
    bits = (_LN_GAMMA.take(drawn[..., 1]) - r * (t + 1 - beta)).view(np.int32)
    rising = (bits ^ (bits >> 31 | np.int32(-(1 << 31)))).view(np.uint32)
    # For one term, neighbouring t have different names.
    name = np.maximum((drawn[..., 3] + t.astype(np.uint32) * np.uint32(40503)) & np.uint32((1 << BITS) - 1), np.uint32(NONE + 1))
    return rising >> np.uint32(BITS) << np.uint32(BITS) | name


def spelled(signature: np.ndarray) -> str:
    """A signature as text: three hex digits for each sample."""
    return "".join([f"{x:03x}" for x in signature.tolist()])


class Sampler:
    """Signatures of texts; remembers the samples of weighted terms, those that it met first for good."""

    def __init__(self) -> None:
        self.place: dict[tuple[bytes, int], int] = {}
        self.known = np.empty((KNOWN, SAMPLES), np.uint32)

    def _rows(self, terms: list[tuple[bytes, int]]) -> np.ndarray:
        if len(self.place) + len(terms) > KNOWN:
            # What was met first is frequent and stays.
            self.place = dict(islice(self.place.items(), min(KNOWN // 2, KNOWN - len(terms))))
        place = self.place
        new = [t for t in terms if t not in place]
        if new:
            start = len(place)
            self.known[start : start + len(new)] = samples_of(np.fromiter((xxhash.xxh64_intdigest(w) for w, _ in new), np.uint64, len(new)), np.array([n for _, n in new], np.float64))
            place.update(zip(new, range(start, start + len(new)), strict=True))
        return self.known.take(np.fromiter(map(place.__getitem__, terms), np.int64, len(terms)), axis=0)

    def signature(self, text: str) -> np.ndarray:
        """The samples of a text, :data:`NONE` each for a text without words."""
        terms = list(Counter(text.encode().lower().split()).items())
        least = np.full(SAMPLES, (1 << 32) - 1, np.uint32)
        for at in range(0, len(terms), AT_ONCE):
            np.minimum(least, self._rows(terms[at : at + AT_ONCE]).min(axis=0), out=least)
        return least & np.uint32((1 << BITS) - 1) if terms else np.full(SAMPLES, NONE, np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples, which estimates the generalised Jaccard similarity of the words' counts."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last half of the characters replaced by as many, or all, of the first of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): 128 samples of 12 bits, in hex, of each text's words by their counts.

    Words are runs of other characters than ASCII white space, A-Z in lower
    case. The share of equal samples of two fingerprints estimates the sum of
    the lesser counts by the sum of the greater ones. Null and empty texts, and
    texts of white space, have the fingerprint of all zeros. A row for each row;
    other columns are not read.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for b in batches:
            prints = [spelled(sampler.signature(t.as_py() or "")) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return only(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=text_col).mapInArrow(signed, "doc_id long, fingerprint string")


def _bounds(keys: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """Keys (id, tie) at which ranges of about as many rows begin, from a sample of :data:`PER_RANGE` rows a range."""
    n = keys.count()
    drawn = sorted(map(tuple, keys.sample(min(1.0, PER_RANGE * ranges / max(n, 1)), 7).collect()))
    return sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """Number of bounds at or below (id, tie): a search by halves, written as nested conditions."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        i, tie = bounds[middle]
        below = (F.col("id") < i) | ((F.col("id") == i) & (F.col("tie") < tie))
        return F.when(below, within(low, middle)).otherwise(within(middle + 1, high))

    return within(0, len(bounds))


def followed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (range, guest, id, tie, doc_id, text), ordered in partitions: there, each row that is no guest is followed by the row of the next document.

    Documents are in ascending order of id, null first, then of a hash of the
    text and of the text. Ranges of ids are partitions. The last document of a
    range is followed by a guest, the first of the next range that has any; the
    last of all by the first of all. So texts are shuffled once, and a range
    more than once only its first text.
    """
    spark = docs.sparkSession
    d = only(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    # Null is below all ids; it shares its place with the least of them.
    d = d.select(F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("id"), F.xxhash64("text").alias("tie"), "doc_id", "text")
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = d.withColumn("range", _range_of(_bounds(d.select("id", "tie"), ranges)).cast("int"))
    firsts = stage(ranged.groupBy("range").agg(F.min(F.struct("id", "tie")).alias("first")).select("range", "first.id", "first.tie"))
    # As many rows as there are ranges.
    order = sorted(map(tuple, firsts.collect()))
    before = {r: order[i - 1][0] for i, (r, _, _) in enumerate(order)}
    guests = spark.createDataFrame([(before[r], i, tie) for r, i, tie in order], "host int, id long, tie long")
    # Equal keys have equal texts, but for a hash that meets by chance; then the least text is the guest.
    guests = d.join(F.broadcast(guests), ["id", "tie"]).groupBy("host", "id", "tie").agg(F.min(F.struct("doc_id", "text")).alias("x"))
    own = ranged.select("range", F.lit(False).alias("guest"), "id", "tie", "doc_id", "text")
    every = own.unionByName(guests.select(F.col("host").alias("range"), F.lit(True).alias("guest"), "id", "tie", "x.doc_id", "x.text"))
    return every.repartitionById(ranges, "range").sortWithinPartitions("range", "guest", "id", "tie", "text")


def compared_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) characters
    replaced by the first as many, or all, of the next document's; next is in
    ascending order of id, the first after the last. ``near_edited`` and
    ``near_next`` are the likeness of the text's fingerprint (see
    :func:`fingerprints`) to those of the edited and of the next text. Equal
    texts have equal fingerprints; texts without words are alike, and unlike
    all others.

    A null text is empty. Null ids come first. Rows that repeat an id are
    documents of their own, in the order of a hash of their text, then of the
    text. A single document is its own next. An empty table gives an empty
    result; other columns are not read.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        last = None  # range, id, text, signature
        out: list[tuple] = []

        def rows() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

        for b in batches:
            for of, guest, i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                text = text.as_py()
                own = sampler.signature(text)
                if last is not None and last[0] == of:
                    _, at, before, print_ = last
                    new = edited(before, text)
                    changed = sampler.signature(new)
                    out.append((at, len(before), hashlib.sha256(new.encode()).hexdigest(), spelled(print_), spelled(changed), likeness(print_, changed), likeness(print_, own)))
                last = None if guest else (of, i, text, own)
                if len(out) >= 1000:
                    yield rows()
                    out.clear()
        yield rows()

    ordered = followed(docs, id_col, text_col).select("range", "guest", "doc_id", "text")
    return ordered.mapInArrow(compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
