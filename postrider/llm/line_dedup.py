"""Line deduplication by a sharded minimal perfect hash with fingerprint and count arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.columns import only
from ..plans.staging import stage

#: Distinct lines in a shard; probes that one task answers from a shard.
SHARD = 50_000
PROBES = 200_000
#: Fixed value: ASCII white space.
SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """Stripped of ASCII white space, A-Z in lower case."""
    return line.strip(SPACE).lower()


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode()) >= least)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of 128-bit keys: levels of bits, a key's place is the rank of its bit.

    At each level the keys that are left fall on twice as many bits; those alone
    on a bit set it, the others go on. About three bits a key, built and asked
    for whole arrays.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.sizes = [8 * len(b) for b in levels]
        self.bits = np.concatenate([np.unpackbits(b, bitorder="little") for b in levels] or [np.zeros(0, np.uint8)])
        self.ranks = np.cumsum(self.bits, dtype=np.int64) - 1

    @staticmethod
    def place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mix(_mix(a + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)) ^ b) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels = []
        while len(a):
            size = -(-2 * len(a) // 8) * 8
            at = cls.place(a, b, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            a, b = a[~alone[at]], b[~alone[at]]
            if len(levels) > 200:
                raise ValueError("two keys are equal")
        return cls(levels)

    def index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each key; -1 for some keys, and any place for others, that were not built in."""
        out = np.full(len(a), -1, np.int64)
        left, base = np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            at = base + self.place(a[left], b[left], level, size)
            hit = self.bits[at] == 1
            out[left[hit]] = self.ranks[at[hit]]
            left, base = left[~hit], base + size
        return out


def _built(frame: pd.DataFrame) -> pd.DataFrame:
    """One row for a shard: the hash, and by place a fingerprint, the number of documents and the last of them."""
    a, b = (frame[c].to_numpy().view(np.uint64) for c in ("a", "b"))
    h = PerfectHash.build(a, b)
    at = h.index(a, b)
    prints, counts, last = np.empty(len(a), np.uint32), np.empty(len(a), np.uint8), np.empty(len(a), np.int64)
    prints[at] = (b & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    counts[at] = np.minimum(frame["n"].to_numpy(), 255)
    last[at] = frame["last"].to_numpy()
    n = int(frame["n"].sum())
    return pd.DataFrame({"shard": [frame["shard"].iat[0]], "parts": [-(-n // PROBES)], "levels": [[x.tobytes() for x in h.levels]], "prints": [prints.tobytes()], "counts": [counts.tobytes()], "last": [last.tobytes()]})


def repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, drops): for each id with lines to drop, the 16-byte hashes of their keys, joined."""
    if not 1 <= least_docs <= 255:
        raise ValueError("counts are kept in a byte")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = {xxhash.xxh3_128_digest(k) for x in (t.as_py() or "").encode().split(b"\n") if _long(k := line_key(x), least_chars)}
                ids += [i] * len(found)
                keys += found
            h = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))], ["doc_id", "a", "b"])

    d = only(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=text_col)
    lines = stage(d.mapInArrow(hashed, "doc_id long, a long, b long"))
    # A null id is below all others.
    lowest = F.lit(-(2**63)).cast("long")
    stats = stage(lines.groupBy("a", "b").agg(F.count("*").alias("n"), F.max(F.coalesce("doc_id", lowest)).alias("last")))
    shards = max(1, stats.count() // SHARD)
    shard = F.pmod(F.col("a"), F.lit(shards)).cast("int")
    index = stage(stats.withColumn("shard", shard).groupBy("shard").applyInPandas(_built, "shard int, parts int, levels array<binary>, prints binary, counts binary, last binary"))
    # A shard that is asked often, since one line is in very many documents, is copied.
    parts = stage(index.select("shard", "parts"))
    probes = lines.withColumn("shard", shard).join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def probed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not (len(left) and len(right)):
            return pd.DataFrame({"doc_id": [], "a": [], "b": []})
        r = right.iloc[0]
        a, b = (left[c].to_numpy().view(np.uint64) for c in ("a", "b"))
        at = PerfectHash([np.frombuffer(x, np.uint8) for x in r["levels"]]).index(a, b)
        prints, counts, last = np.frombuffer(r["prints"], np.uint32), np.frombuffer(r["counts"], np.uint8), np.frombuffer(r["last"], np.int64)
        if (at < 0).any() or (prints[at] != (b & np.uint64(0xFFFFFFFF))).any():
            raise ValueError("a line is not in its shard")
        drop = (counts[at] >= least_docs) & (last[at] != left["id"].to_numpy())
        return left.loc[drop, ["doc_id", "a", "b"]]

    asked = probes.select("doc_id", F.coalesce("doc_id", lowest).alias("id"), "a", "b", "shard", "part")
    dropped = asked.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInPandas(probed, "doc_id long, a long, b long")
    # As many entries as the document has lines; joined in a fixed byte order.
    return dropped.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("drops"))


def without_repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines (before), n_dropped, kept (text).

    Whole texts are split at line feeds; a null or empty text is one empty line.
    Lines with equal keys (see :func:`line_key`) of ``least_chars`` code points
    or more, in ``least_docs`` documents or more, stay only in the document with
    the largest id, there all of them. Each row counts as a document; rows that
    repeat an id are treated alike. A null id is below all others. An empty
    table gives an empty result; other columns are not read.

    Keys are compared by a 128-bit hash. Rows of a shard reach a task in
    bounded parts; the documents' texts are shuffled once, by id.
    """
    drops = repeated_lines(docs, least_chars, least_docs, id_col, text_col)
    d = only(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    drops = stage(drops).withColumnRenamed("doc_id", "id")
    joined = d.join(drops, d.doc_id.eqNullSafe(F.col("id")), "left").select("doc_id", "text", F.col("drops.a").alias("a"), F.col("drops.b").alias("b"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines_of, dropped_of, kept_of = [], [], []
            for t, a, b in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                lines = t.as_py().encode().split(b"\n")
                kept = lines
                if a.is_valid:
                    gone = set(zip(a.as_py(), b.as_py(), strict=True))
                    kept = [x for x in lines if not (_long(k := line_key(x), least_chars) and tuple(np.frombuffer(xxhash.xxh3_128_digest(k), np.int64).tolist()) in gone)]
                lines_of.append(len(lines))
                dropped_of.append(len(lines) - len(kept))
                kept_of.append(b"\n".join(kept).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines_of, pa.int64()), pa.array(dropped_of, pa.int64()), pa.array(kept_of, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept string")
