"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.columns import only
from ..plans.staging import stage

#: Entries, and queries, that meet in one group; queries that a task compares at a time.
BLOCK, AT_ONCE = 8192, 256


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of the rows of x (Lloyd); an empty cluster keeps its place."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest_centroid(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)


def cells_by_distance(a: np.ndarray, b: np.ndarray, counts: np.ndarray, wanted: float) -> list[int]:
    """Cells (i, j) by rising a[i] + b[j] until they hold ``wanted`` entries or all.

    The heap holds at most one open pair for each centroid of the first half:
    a pair follows its left and upper neighbours only.
    """
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap = [(a[by_a[0]] + b[by_b[0]], 0, 0)]
    at = [0] * len(a)  # how far each row of pairs has come
    cells, held = [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(by_a[i]) * len(b) + int(by_b[j])
        if counts[cell]:
            cells.append(cell)
            held += counts[cell]
        at[i] = j + 1
        if j + 1 < len(b) and (i == 0 or at[i - 1] > j + 1):
            heapq.heappush(heap, (a[by_a[i]] + b[by_b[j + 1]], i, j + 1))
        if i + 1 < len(a) and at[i + 1] == j:
            heapq.heappush(heap, (a[by_a[i + 1]] + b[by_b[j]], i + 1, j))
    return cells


class MultiIndex:
    """Centroids of both halves of unit vectors and the number of ids in each pair."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        self.counts = np.zeros(len(first) * len(second))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        h = self.first.shape[1]
        return nearest_centroid(unit[:, :h], self.first) * len(self.second) + nearest_centroid(unit[:, h:], self.second)

    def probe(self, unit: np.ndarray, wanted: float) -> list[int]:
        h = self.first.shape[1]
        a = ((self.first - unit[:h]) ** 2).sum(axis=1)
        b = ((self.second - unit[h:]) ** 2).sum(axis=1)
        return cells_by_distance(a, b, self.counts, wanted)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) if len(column) else np.empty((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; the largest component goes first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: no null, non-finite or only zero components, and an id."""
    v = only(vectors, vec_id=F.col(f"`{id_col}`").cast("long"), v=F.col(f"`{vector_col}`").cast("array<double>"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def index_size(n: int, most: int = 1024) -> int:
    """Centroids of each half for n entries: about the power 0.4 of n, a power of two from 8 to ``most``."""
    return int(min(most, max(8, 2 ** round(0.4 * np.log2(max(n, 2))))))


def probed_share(n: int) -> float:
    """Share of n entries that a query compares: all of up to 370, two fifths of 50,000, a 13th of 600 million."""
    return min(1.0, 2.9 * max(n, 1) ** -0.18)


def fit_index(entries: DataFrame, centroids: int, sample: int = 20_000) -> MultiIndex:
    """Centroids from the ``sample`` entries with the smallest hashed ids; all entries are indexed later."""
    chosen = entries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    unit = _unit(_matrix(chosen["v"].combine_chunks()))
    if unit.shape[1] < 2:
        raise ValueError("vectors of two components or more are needed")
    h = unit.shape[1] // 2
    return MultiIndex(kmeans(unit[:, :h], centroids), kmeans(unit[:, h:], centroids))


def best_of(q: np.ndarray, own: np.ndarray, x: np.ndarray, flags: np.ndarray, second: np.ndarray, ids: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, cosine) of the k best ids of each query, ties with the last included, its own id left out.

    ``own`` has the queries' ids, ``ids`` those of each entry; an id counts by
    its best entry, however many it has. ``flags[r, j]`` says whether query r
    goes through the cells of the second centroid j, ``second`` has the second
    centroid of each entry.
    """
    size = np.array([len(z) for z in ids])
    entry, named = np.repeat(np.arange(len(x)), size), np.concatenate(ids)
    order = np.argsort(named, kind="stable")
    entry, named = entry[order], named[order]
    start = np.nonzero(np.concatenate([[True], named[1:] != named[:-1]]))[0]
    length = np.diff(np.append(start, len(named)))
    out = []
    for at in range(0, len(q), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        s = np.where(flags[part][:, second], q[part] @ x.T, -np.inf)[:, entry]
        s[own[part][:, None] == named] = -np.inf
        best = np.maximum.reduceat(s, start, axis=1)
        n = min(k, best.shape[1])
        least = np.partition(best, best.shape[1] - n, axis=1)[:, -n]
        i, j = np.nonzero((best >= least[:, None] - 1e-12) & (best > -np.inf))
        # The cosine of every entry of the id that may be its best, by one sum in a fixed order.
        row = np.repeat(np.arange(len(i)), length[j])
        col = np.arange(len(row)) - np.repeat(np.cumsum(length[j]) - length[j], length[j]) + start[j][row]
        near = s[i[row], col] >= best[i, j][row] - 1e-12
        row, col = row[near], col[near]
        out.append((i[row] + at, named[col], np.einsum("ij,ij->i", q[i[row] + at], x[entry[col]])))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 20_000, centroids: int | None = None, probed: float | None = None) -> DataFrame:
    """The ``k`` nearest found of each query row: query_id, rank (from 1), vec_id, score.

    Queries are the rows for which ``is_query(id column)`` holds, candidates all
    rows but the query's own id. The score is the cosine in double precision,
    ties go to the smaller id. Rows with a null id, and vectors that are null,
    zero or hold null or non-finite components, take no part; all vectors must
    have one length. With fewer candidates than ``k`` all are returned. Rows that
    repeat id and vector count once; an id counts by the best of its vectors,
    and takes one place however many it has. An empty table gives an empty
    result. Other columns are not read.

    A query goes through pairs of centroids by summed distance, with a heap,
    until the pairs hold the share ``probed`` of all ids, and ``k + 1`` at
    least (an id with m vectors counts 1/m for each); these are compared exactly. Centroids grow and the share falls with
    the number of entries (:func:`index_size`, :func:`probed_share`); recall at
    several sizes is in the README.

    Equal vectors are one entry with its ``k + 1`` smallest ids, which is all
    that a result can name. Entries meet queries by the centroid of their first
    half, in blocks of bounded size: a query is sent once for each such
    centroid that it goes through, with flags for the second halves.
    """
    spark = vectors.sparkSession
    v = stage(usable(vectors, id_col, vector_col).distinct())
    # The row limit of this window already holds before the shuffle.
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    few = v.withColumn("n", F.row_number().over(by_vector)).filter(F.col("n") <= k + 1)
    entries = stage(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("vec_id", F.col("ids")[0]))
    n_entries = entries.count()
    if not n_entries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit_index(entries, centroids or index_size(n_entries), sample)
    width = len(index.second)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = index.cells(_unit(_matrix(b.column(0))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((cell // width).astype(np.int32)), pa.array((cell % width).astype(np.int32))], [*b.schema.names, "first", "second"])

    # Most ids have one vector; the others share their place among their vectors.
    several = stage(entries.select(F.explode("ids").alias("id")).groupBy("id").count().filter("count > 1"))
    alone = F.size("ids")
    shared = entries.select("vec_id", "v", F.explode("ids").alias("id")).join(several, "id").groupBy("v").agg(F.sum(1 - 1 / F.col("count")).alias("less"))
    weighed = entries.join(shared, "v", "left").withColumn("weight", alone - F.coalesce("less", F.lit(0.0))).drop("less")
    indexed = stage(weighed.mapInArrow(placed, "v array<double>, ids array<long>, vec_id long, weight double, first int, second int"))
    # Bounded by centroids squared, whatever the input.
    held = indexed.groupBy("first", "second").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).toArrow()
    at = held["first"].to_numpy().astype(np.int64) * width + held["second"].to_numpy()
    index.counts[at] = held["weight"].to_numpy()
    n_in = np.zeros(len(index.counts), np.int64)
    n_in[at] = held["n"].to_numpy()
    # What rounding of the sums may lack must not end a search too early or keep it from its end.
    wanted = min(max((probed_share(n_entries) if probed is None else probed) * index.counts.sum(), k + 1.001), index.counts.sum() * 2)
    blocks = np.maximum(1, -(-n_in.reshape(-1, width).sum(axis=1) // BLOCK))
    shipped = spark.sparkContext.broadcast(index)

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids, firsts, flags, vectors = [], [], [], []
                for i, u in zip(part.column(0).to_pylist(), _unit(_matrix(part.column(1))), strict=True):
                    through = np.zeros((len(shipped.value.first), width), bool)
                    through.reshape(-1)[shipped.value.probe(u, wanted)] = True
                    own = np.nonzero(through.any(axis=1))[0]
                    ids += [i] * len(own)
                    firsts += own.tolist()
                    flags += [f.tobytes() for f in np.packbits(through[own], axis=1)]
                    vectors += [u.tobytes()] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(firsts, pa.int32()), pa.array(flags, pa.binary()), pa.array(vectors, pa.binary())], ["query_id", "first", "flags", "u"])

    queries = v.filter(is_query(F.col("vec_id"))).select("vec_id", "v")
    probes = queries.mapInArrow(probing, "query_id long, first int, flags binary, u binary")
    parts = max(1, -(-queries.count() // BLOCK))
    of_first = F.array(*[F.lit(int(n)) for n in blocks])[F.col("first")]
    q = probes.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), of_first - 1)))
    e = indexed.withColumn("block", F.pmod(F.xxhash64("vec_id"), of_first).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def compared(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not (len(left) and len(right)):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q = np.frombuffer(b"".join(left["u"]), np.float64).reshape(len(left), -1)
        flags = np.unpackbits(np.frombuffer(b"".join(left["flags"]), np.uint8).reshape(len(left), -1), axis=1, count=width).view(bool)
        i, found, score = best_of(q, left["query_id"].to_numpy(), _unit(np.stack(right["v"].to_numpy())), flags, right["second"].to_numpy(), list(right["ids"]), k)
        return pd.DataFrame({"query_id": left["query_id"].to_numpy()[i], "vec_id": found, "score": score})

    keys = ["first", "block", "part"]
    found = q.groupBy(*keys).cogroup(e.select("v", "ids", "second", *keys).groupBy(*keys)).applyInPandas(compared, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
