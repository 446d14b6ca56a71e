"""SimHash near-duplicates by pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..plans.columns import only
from ..plans.staging import stage
from .chunks import mix

#: Rows of one key that a task compares among themselves; keys with more are dealt out in tiles.
TILE = 4096
#: Groups of up to so many rows are compared together, by shifts.
SMALL = 48
#: Bands in the longest keys: at 9 of 12 and a radius of 3, 16 bits are open.
LONGEST = 9


def shingles(text: str | None, words: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each shingle, in order; a text of fewer words is one shingle, one without words has none."""
    parts = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not parts:
        return []
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    xx = xxhash.xxh64_intdigest
    return [xx(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=False)] or [xx(joined, seed)]


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Majority of the bits of the shingles' XXH64; 0 for a text without words."""
    return majority(np.array(shingles(text, words, seed), np.uint64))


def key_bands(n: int, radius: int) -> int:
    """Bands of bits for n fingerprints: keys of ``bands - radius`` of them are 8 bits longer than n, if 12 bands suffice.

    Then a fingerprint meets few others by chance, whatever n is; which pairs are
    found does not depend on it.
    """
    bands = radius + 2
    while bands < 12 and 64 * (bands - radius) // bands < np.log2(max(n, 2)) + 8:
        bands += 1
    return bands


class PivotTable:
    """Hamming distances of fingerprints to reference fingerprints.

    The references are a base, the base with one bit turned over for each of the
    64 bits, and random ones. By the triangle inequality no coordinate of two
    fingerprints within ``radius`` differs by more than it. The coordinate of a
    turned base is that of the base plus or minus one, by the turned bit alone,
    so two fingerprints within the radius have equal differences at all but
    ``radius`` of these pivots, and of ``bands`` groups of pivots ``bands -
    radius`` are equal throughout. Who meets is decided by these: they are the
    keys of an equality join. The random coordinates discard pairs that met.
    """

    def __init__(self, radius: int = 3, bands: int = 5, random: int = 10, seed: int = 7):
        r = np.random.default_rng(seed)
        self.radius = radius
        self.base = r.integers(0, 2**64, dtype=np.uint64)
        self.turned = self.base ^ (np.uint64(1) << r.permutation(64).astype(np.uint64))
        self.others = r.integers(0, 2**64, random, dtype=np.uint64)
        self.bands = np.array_split(np.arange(64), bands)
        self.choices = list(combinations(range(bands), bands - radius))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """The keys of each fingerprint, one column for each choice of bands."""
        to_base = np.bitwise_count(x ^ self.base)
        of_band = []
        for band in self.bands:
            k = np.zeros(len(x), np.uint64)
            for j in band:
                k = (k << np.uint64(1)) | (np.bitwise_count(x ^ self.turned[j]) > to_base).astype(np.uint64)
            of_band.append(k)
        out = np.empty((len(x), len(self.choices)), np.int64)
        for c, choice in enumerate(self.choices):
            k = mix(np.full(len(x), c + 1, np.uint64))
            for b in choice:
                k = mix(k ^ of_band[b])
            out[:, c] = k.view(np.int64)
        return out

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Coordinates to the random references, one row for each reference."""
        return np.stack([np.bitwise_count(x ^ p).astype(np.int8) for p in self.others])

    def near(self, x: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the given index pairs those within the radius."""
        for row in table:
            ok = np.abs(row[a] - row[b]) <= self.radius
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(x[a] ^ x[b]) <= self.radius
        return a[ok], b[ok]

    def near_in_block(self, x: np.ndarray, table: np.ndarray, left: slice, right: slice) -> tuple[np.ndarray, np.ndarray]:
        """Pairs within the radius of two ranges of rows."""
        ok = np.ones((left.stop - left.start, right.stop - right.start), bool)
        for row in table:
            ok &= np.abs(row[left, None] - row[None, right]) <= self.radius
        a, b = np.nonzero(ok)
        a, b = a + left.start, b + right.start
        ok = np.bitwise_count(x[a] ^ x[b]) <= self.radius
        return a[ok], b[ok]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row that each of n rows is linked with, by the given pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(pivots: PivotTable, key: np.ndarray, x: np.ndarray, part: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, root row) within whole groups of rows; a group with two parts is linked across them."""
    table = pivots.distances(x)
    starts = np.concatenate(([0], ends[:-1]))
    sizes = ends - starts
    found = []
    small = np.repeat(np.where(sizes <= SMALL, sizes, 0), sizes)
    place = np.arange(len(x)) - np.repeat(starts, sizes)
    for shift in range(1, int(small.max(initial=1))):
        a = np.nonzero(place + shift < small)[0]
        if not len(a):
            break
        found.append(pivots.near(x, table, a, a + shift))
    for start, end in zip(starts[sizes > SMALL], ends[sizes > SMALL], strict=True):
        split = start + int(np.searchsorted(part[start:end], part[start], "right"))
        across = split < end
        for at in range(start, split if across else end, 256):
            left = slice(at, min(at + 256, split if across else end))
            found.append(pivots.near_in_block(x, table, left, slice(split if across else at, end)))
    a, b = (np.concatenate(v) if found else np.empty(0, np.int64) for v in (zip(*found, strict=True) if found else ((), ())))
    root = roots(len(x), a, b)
    linked = np.nonzero(root != np.arange(len(x)))[0]
    return linked, root[linked]


def near_links(prints: DataFrame, radius: int) -> DataFrame:
    """(src, dst) fingerprints: links within the radius that connect all that all such links connect.

    ``prints`` has the distinct fingerprints in column fp. A key that more than
    ``TILE`` of them share is not compared: its fingerprints go into another
    round with longer keys, which parts them. In the last round a key leaves so
    few bits open that its fingerprints are bounded whatever the input; they are
    dealt out in tiles.
    """

    def by_keys(pivots: PivotTable):
        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 2000):
                    x = whole.slice(at, 2000).column(0).to_numpy(zero_copy_only=False)
                    k = pivots.keys(x.view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(x, k.shape[1]))], ["key", "fp"])

        return keyed

    def by_links(pivots: PivotTable):
        def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept, rows = [], 0

            def done(frame: pd.DataFrame) -> pd.DataFrame:
                k, x, p = (frame[c].to_numpy() for c in ("group", "fp", "part"))
                ends = np.append(np.nonzero(k[1:] != k[:-1])[0] + 1, len(k))
                a, b = _links(pivots, k, x.view(np.uint64), p, ends)
                return pd.DataFrame({"src": x[a], "dst": x[b]})

            for b in batches:
                if not len(b):
                    continue
                kept.append(b)
                rows += len(b)
                if rows >= 20_000:  # all groups but the last are whole
                    frame = pd.concat(kept, ignore_index=True)
                    cut = int(frame["group"].searchsorted(frame["group"].iloc[-1], "left"))
                    if cut:
                        yield done(frame[:cut])
                    kept, rows = [frame[cut:]], len(frame) - cut
            if rows:
                yield done(pd.concat(kept, ignore_index=True))

        return compared

    links, rest, least = None, prints.select("fp"), 0
    while True:
        bands = max(key_bands(rest.count(), radius), least)
        pivots, last = PivotTable(radius, bands), bands >= LONGEST + radius
        keys = rest.mapInArrow(by_keys(pivots), "key long, fp long")
        # A key without a partner needs no comparison.
        shared = stage(keys.groupBy("key").count().filter("count > 1"))
        hot = shared.filter(F.col("count") > TILE).select("key")
        meeting = shared if last else shared.filter(F.col("count") <= TILE)
        met = keys.join(meeting, "key").withColumn("parts", F.ceil(F.col("count") / TILE).cast("int")).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)) if last else F.lit(0)
        tiles = met.select("key", "fp", "part", other.alias("other"))
        tiles = tiles.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("group"), "part", "fp")
        dealt = tiles.repartition("group").sortWithinPartitions("group", "part")
        found = dealt.mapInPandas(by_links(pivots), "src long, dst long").distinct()
        links = found if links is None else links.union(found)
        if last or not hot.head(1):
            return links
        rest = stage(keys.join(hot, "key").select("fp").distinct())
        least = min(bands + 3, LONGEST + radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp, fingerprint (16 hex digits), component_id.

    Fingerprints are linked at ``radius`` or fewer differing bits; component_id
    is the smallest id that links reach, itself included. Equal fingerprints
    are one node, so copies of a text make no pairs. Texts without words (null,
    empty, white space) have fingerprint 0 and are linked like any other. A null
    id is never the smallest unless a component has no other; rows that repeat
    an id each get a row. An empty table gives an empty result; other columns
    are not read.
    """

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x.view(np.int64))], ["doc_id", "fp"])

    d = only(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=text_col)
    prints = stage(d.mapInArrow(printed, "doc_id long, fp long"))
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    parts = stage(components(near_links(distinct, radius)))
    named = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    named = stage(named)
    firsts = stage(named.groupBy("component").agg(F.min("first_id").alias("component_id")))
    named = stage(named.join(firsts, "component").select("fp", "component_id"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select("doc_id", "fp", text.alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """``docs``, all columns, with only the smallest id of each component; rows with a null id stay."""
    found = near_duplicates(docs, id_col, text_col, words, radius)
    dropped = stage(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__dropped")).distinct())
    return docs.join(dropped, docs[id_col] == F.col("__dropped"), "left_anti")
