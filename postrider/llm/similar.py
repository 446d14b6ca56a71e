"""Near copies by the Jaccard similarity of their shingles: found by SimHash and min-hash keys, then verified."""

from __future__ import annotations

from collections.abc import Iterator

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
from .simhash import majority, near_links, roots, shingles

#: Two texts of similarity s share a min-hash key with probability 1 - (1 - s^ROWS)^KEYS: 0.9993 at 0.8.
KEYS, ROWS = 24, 6
#: Shingles of one candidate group that a task compares; a larger group is dealt out in parts.
TILE = 200_000
_FACTORS = np.random.default_rng(11).integers(0, 2**64, KEYS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct shingle hashes, sorted; texts without words have the one hash 0, so they are alike."""
    return np.unique(np.array(shingles(text, words) or [0], np.uint64))


def min_keys(hashes: np.ndarray) -> np.ndarray:
    """KEYS numbers, each of ROWS minima of the hashes in other orders."""
    least = np.full(KEYS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, np.multiply.outer(hashes[at : at + 1024], _FACTORS).min(axis=0), out=least)
    key = np.arange(KEYS, dtype=np.uint64)
    for row in least.reshape(KEYS, ROWS).T:
        key = mix(key ^ row)
    return key.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def similar_links(sets: list[np.ndarray], part: np.ndarray, cluster: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of at least that similarity which connect all that such pairs connect; of two parts, across them only.

    Rows that are connected already, by ``cluster`` or by a pair found before,
    are not compared again, so a group of near copies costs about a comparison
    for each row.
    """
    sizes = np.array([len(s) for s in sets])
    root = np.unique(cluster, return_inverse=True)[1]
    two = part.min() != part.max()
    found = []
    for j in range(1, len(sets)):
        ok = (root[:j] != root[j]) & (np.minimum(sizes[:j], sizes[j]) >= least * np.maximum(sizes[:j], sizes[j]))
        if two:
            ok &= part[:j] != part[j]
        left = np.nonzero(ok)[0][::-1]
        at = 0
        while at < len(left):
            i = int(left[at])
            at += 1
            if similarity(sets[i], sets[j]) >= least:
                found.append((i, j))
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
                left, at = left[at:][root[left[at:]] != low], 0
    return found


def verified_links(sets: DataFrame, least: float) -> DataFrame:
    """(src, dst): what links of ``least`` or more connect among rows (node, component, size, hashes) of one candidate component.

    A task gives each row that it finds linked with the smallest that these
    links reach there, not the links themselves: chains of near copies would
    take :func:`components` many rounds.

    A component that is too large for a task is dealt out in parts. First each
    part is linked within, then one row for each cluster found is compared with
    the others'. Only rows that are still apart from the largest cluster of
    their component then meet all others in tiles. So a component of any size
    that is mostly near copies of each other costs a few comparisons a row.
    """

    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        links = similar_links([np.frombuffer(h, np.uint64) for h in frame["hashes"]], frame["part"].to_numpy(), frame["cluster"].to_numpy(), least)
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        order = np.argsort(frame["node"].to_numpy())
        rank = np.argsort(order)
        low = roots(len(frame), rank[a], rank[b])
        far = np.nonzero(low != np.arange(len(low)))[0]
        node = frame["node"].to_numpy()[order]
        return pd.DataFrame({"src": node[far], "dst": node[low[far]]}, dtype="int64")

    def parts_of(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("component").agg(F.ceil(F.sum("size") / TILE).cast("int").alias(name))

    def place(parts: str):
        return F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")

    def every(parts: str):
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    def linked(rows: DataFrame) -> DataFrame:
        return rows.groupBy("component", "low", "high").applyInPandas(compared, "src long, dst long")

    def in_tiles(rows: DataFrame) -> DataFrame:
        t = rows.join(stage(parts_of(rows, "parts")), "component").withColumn("part", place("parts")).withColumn("other", every("parts"))
        return linked(t.select("component", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "cluster", "hashes"))

    parts = stage(parts_of(sets, "parts"))
    alone = sets.join(parts, "component").withColumn("low", place("parts"))
    links = stage(linked(alone.select("component", "low", F.lit(0).alias("high"), F.lit(0).alias("part"), "node", F.col("node").alias("cluster"), "hashes")))
    large = parts.filter("parts > 1").select("component")
    if not large.head(1):
        return links

    def clustered(rows: DataFrame, links: DataFrame) -> DataFrame:
        of = stage(components(links)).select("node", F.col("component").alias("cluster"))
        return rows.join(of, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))

    rows = sets.join(large, "component")
    links = stage(links.union(in_tiles(stage(clustered(rows, links).filter("node = cluster")))))
    rows = stage(clustered(rows, links))
    weights = stage(rows.groupBy("component", "cluster").agg(F.sum("size").alias("size")))
    largest = stage(weights.groupBy("component").agg(F.max_by("cluster", F.struct("size", "cluster")).alias("largest"), F.count("*").alias("n")).filter("n > 1"))
    if not largest.head(1):
        return links
    rows = rows.join(largest, "component")
    minor = stage(rows.filter("cluster <> largest"))
    major = rows.filter("cluster = largest")
    counts = stage(parts_of(minor, "minor_parts").join(parts_of(major, "major_parts"), "component"))
    columns = ["component", "low", "high", "part", "node", "cluster", "hashes"]
    across = major.join(counts, "component").withColumns({"low": place("major_parts"), "high": every("minor_parts"), "part": F.lit(0)}).select(*columns)
    across = across.union(minor.join(counts, "component").withColumns({"low": every("major_parts"), "high": place("minor_parts"), "part": F.lit(1)}).select(*columns))
    return stage(links.union(in_tiles(minor)).union(linked(across)))


def without_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, words: int = 5, radius: int = 3) -> DataFrame:
    """``docs``, all columns, with only the smallest id of each component of similar texts.

    Two texts are linked if the Jaccard similarity of their sets of shingles of
    ``words`` words is ``least`` or more; every link is verified on the sets
    (of 64-bit hashes). Candidates are texts whose SimHash fingerprints differ
    in up to ``radius`` bits, and those that share a min-hash key: fingerprints
    alone find few pairs near 0.8, where about 10 bits differ, and no radius as
    large has selective keys.

    Texts are compared without case (A-Z) and by words; a text of fewer words is
    one shingle, texts without words are alike. Rows with a null id take no part
    and stay. An id on several rows stands for all of them. An empty table gives
    an empty result.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                node, fp, keys = [], [], []
                for t in b.column(1):
                    s = shingle_set(t.as_py(), words)
                    node.append(xxhash.xxh64_intdigest(s.tobytes()))
                    fp.append(majority(s))
                    keys.append(min_keys(s))
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)], pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "node", "fp", "keys"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                sets = [shingle_set(t.as_py(), words) for t in b.column(2)]
                same = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64) == b.column(0).to_numpy(zero_copy_only=False)
                out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "component", "size", "hashes"])
                yield out.filter(pa.array(same))

    d = only(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=text_col).filter("doc_id IS NOT NULL")
    prints = stage(d.mapInArrow(signed, "doc_id long, node long, fp long, keys array<long>"))
    # Texts with equal sets are one node.
    nodes = stage(prints.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = stage(keyed.groupBy("key").agg(F.min("node").alias("dst"), F.count("*").alias("n")).filter("n > 1").select("key", "dst"))
    by_key = keyed.join(shared, "key").select(F.col("node").alias("src"), "dst")
    prints_of = stage(nodes.groupBy("fp").agg(F.min("node").alias("dst")))
    near = near_links(prints_of.select("fp"), radius)
    a, b = (prints_of.select(F.col("fp").alias(x), F.col("dst").alias(f"{x}_node")) for x in ("src", "dst"))
    by_print = near.join(a, "src").join(b, "dst").select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))
    equal = nodes.join(prints_of, "fp").filter("node <> dst").select(F.col("node").alias("src"), "dst")
    groups = stage(components(by_key.filter("src <> dst").union(by_print).union(equal)))
    # One text for each node of a group; of an id's texts only the one that is the node.
    wanted = stage(nodes.join(groups, "node").select("first_id", "node", "component"))
    texts = d.join(wanted, d.doc_id == wanted.first_id).select("node", "component", "text")
    sets = stage(texts.mapInArrow(hashed, "node long, component long, size long, hashes binary").dropDuplicates(["node"]))
    verified = stage(components(verified_links(sets, least)))
    named = stage(nodes.join(verified, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("component")))
    firsts = stage(named.groupBy("component").agg(F.min("first_id").alias("component_id")))
    kept = stage(named.join(firsts, "component").select("node", "component_id"))
    dropped = stage(prints.join(kept, "node").filter("doc_id <> component_id").select("doc_id").distinct())
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    return boxed.join(dropped, "doc_id", "left_anti").select("row.*")
