"""Repeated passages by suffix trees over groups of suffixes that share a few words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.columns import only
from ..plans.staging import shared_dir, stage
from .chunks import Chunk, chunks, deltas, mix, pack, unpack

#: Suffixes in a group, about, unless longer prefixes cannot part them.
GROUP = 1_000_000
#: Words of a gram; the least of a window's grams names its group, so that most neighbours go to one.
GRAM = 3
#: Grams are told apart by so many hash values at least and at most, and by so many more in each further step.
FIRST, MOST, NEXT = 1024, 65_536, 64
#: Steps that tell grams apart, before prefixes of words do.
STEPS = 2
#: Words in a chunk; a document with more is a chunk of its own.
WORDS = 1_000_000
#: Bits of a window's hash, at least, and beyond those that number all words.
LEAST_BITS, SPARE = 32, 10
#: A null id is above all others.
LAST = 2**63 - 1


def paths(chunk: Chunk, depth: int, firsts: int = 0) -> list[np.ndarray | None]:
    """For each depth from 1, the hash of the path of so many words from each word on (0 where the row ends before).

    Only those of the ``firsts`` least depths, of a gram and of the last are kept; the others are None.
    """
    w = chunk.hashes[chunk.words]
    left = (np.repeat(np.cumsum(chunk.sizes), chunk.sizes) - np.arange(len(w))).astype(np.int32)
    out, h = [], np.zeros(len(w), np.uint64)
    for k in range(depth):
        h = mix(h[: len(w) - k] ^ w[k:]) if k < len(w) else h[:0]
        p = None
        if k < firsts or k in (min(GRAM, depth) - 1, depth - 1):
            p = np.zeros(len(w), np.uint64)
            np.maximum(h, np.uint64(1), out=p[: len(h)])
            p[: len(h)][left[: len(h)] <= k] = 0
        out.append(p)
    return out


class Prefixes:
    """Which group a suffix belongs to: by the least gram of its window, and where that is very frequent by its first words too.

    Neighbouring windows mostly have the same least gram, so a group gets them as
    one run of words. ``split`` has, by step, the numbers that need one more. A
    number comes from the words of the window alone, so it is the same in all tasks.
    """

    def __init__(self, first: int = FIRST):
        self.split: list[np.ndarray] = []
        self.first, self.groups = first, 1

    def depths(self) -> int:
        """Prefixes of so many lengths are needed."""
        return max(0, len(self.split) - STEPS)

    def numbers(self, path: list[np.ndarray], gram: np.ndarray, where: np.ndarray) -> np.ndarray:
        """The number of the group's words, of suffixes ``where`` whose least grams are ``gram``."""
        number, rest = (gram % np.uint64(self.first)).astype(np.int64), gram // np.uint64(self.first)
        for k, frequent in enumerate(self.split, 1):
            more = np.isin(number, frequent)
            digit = rest[more] if k <= STEPS else path[k - STEPS - 1][where[more]]
            rest = rest // np.uint64(NEXT)
            number[more] = number[more] * NEXT + (digit % np.uint64(NEXT)).astype(np.int64) + self.first * (k + 1)
        return number

    def group(self, number: np.ndarray) -> np.ndarray:
        return (mix(number.view(np.uint64)) % np.uint64(self.groups)).astype(np.int32)


def small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16 if x.max(initial=0) < 65536 else np.uint32)


def written(c: Chunk) -> bytes:
    """A chunk of rows (id, missing) as one value."""
    ids, missing = np.array([r[0] for r in c.rows], np.int64), np.array([r[1] for r in c.rows], np.uint8)
    return pack(ids, missing, small(c.sizes), small(c.words), np.frombuffer(b"\n".join(c.named), np.uint8))


def read_back(state: bytes) -> Chunk:
    ids, missing, sizes, words, named = unpack(state)
    known = named.tobytes().split(b"\n") if len(words) else []
    return Chunk(list(zip(ids.tolist(), missing.tolist(), strict=True)), sizes.astype(np.int64), words.astype(np.int32), known)


class Windows:
    """The windows of a chunk of rows, by the least bits of the hash of their words that tell most of them apart."""

    def __init__(self, chunk: Chunk, words: int, bits: int, levels: int = 0):
        self.words, self.chunk = words, chunk
        self.path = paths(self.chunk, words, levels)
        self.where = np.nonzero(self.path[-1])[0]
        self.hash = self.path[-1][self.where] >> np.uint64(64 - bits)
        self.ids = np.array([r[0] for r in self.chunk.rows], np.int64)[self.chunk.row_of_word()[self.where]]
        #: Each hash once, and where it is among them.
        self.known, self.at = np.unique(self.hash, return_inverse=True)

    def dealt(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The order that brings the known hashes together by part, and where each part begins."""
        part = (mix(self.known) % np.uint64(parts)).astype(np.int64)
        return np.argsort(part, kind="stable"), np.append(0, np.cumsum(np.bincount(part, minlength=parts)))

    def met(self, found: dict[int, bytes], parts: int) -> np.ndarray:
        """Places in ``where`` whose hash occurs in several rows, by the answers of the parts."""
        order, cuts = self.dealt(parts)
        again = np.zeros(len(self.known), bool)
        for p, value in found.items():
            x, y = cuts[p], cuts[p + 1]
            again[order[x:y]] = np.unpackbits(np.frombuffer(value, np.uint8), count=y - x).view(bool)
        return np.nonzero(again[self.at])[0]

    @cached_property
    def grams(self) -> np.ndarray:
        """Of the window from each word on, the hash of its least gram."""
        g = self.path[min(GRAM, self.words) - 1]
        width, span = self.words - min(GRAM, self.words) + 1, 1
        while span < width:
            step = min(span, width - span)
            g = np.minimum(g[: max(0, len(g) - step)], g[step:])
            span += step
        return mix(g)

    def numbers(self, where: np.ndarray, prefixes: Prefixes) -> np.ndarray:
        return prefixes.numbers(self.path, self.grams[where], where)

    def suffixes(self, met: np.ndarray, prefixes: Prefixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, group, least id, largest id, place of each met window): the distinct suffixes, by group and place in the chunk."""
        where, ids = self.where[met], self.ids[met]
        full = self.path[-1][where]
        _, first, place = np.unique(full, return_index=True, return_inverse=True)
        words = self.chunk.words
        if any((words[where + k] != words[where[first] + k][place]).any() for k in range(self.words)):
            # Different words under one hash: they are told apart by the words themselves.
            rows = [b" ".join([self.chunk.named[w] for w in words[a : a + self.words].tolist()]) for a in where.tolist()]
            _, first, place = np.unique(np.array(rows, object), return_index=True, return_inverse=True)
        least, most = np.full(len(first), LAST), np.full(len(first), -LAST - 1)
        np.minimum.at(least, place, ids)
        np.maximum.at(most, place, ids)
        starts = where[first]
        group = prefixes.group(self.numbers(starts, prefixes))
        order = np.lexsort((starts, group))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return starts[order], group[order], least[order], most[order], rank[place]

    def packed(self, starts: np.ndarray, depth: int | None = None) -> list[np.ndarray]:
        """The first words of suffixes: each word once, and its number for each place, by columns."""
        matrix = self.chunk.words[starts + np.arange(depth or self.words)[:, None]]
        used = np.zeros(len(self.chunk.named), bool)
        used[matrix] = True
        named = b"\n".join([self.chunk.named[w] for w in np.nonzero(used)[0].tolist()])
        number = (np.cumsum(used) - 1)[matrix]
        return [np.frombuffer(named, np.uint8), *number.astype(np.uint16 if used.sum() < 65536 else np.uint32)]

    def in_runs(self, starts: np.ndarray) -> list[np.ndarray]:
        """The words of suffixes in rising order: how many start at neighbouring words, and the words of each such run once."""
        begins = np.flatnonzero(np.append(True, np.diff(starts) != 1))
        n = np.diff(np.append(begins, len(starts)))
        return [small(n), *self.packed(starts[begins].repeat(n + self.words - 1) + within(n + self.words - 1), 1)]


def within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes."""
    return np.arange(sizes.sum()) - (np.cumsum(sizes) - sizes).repeat(sizes)


def from_runs(n: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes as rows of ``depth`` words, from the runs of :meth:`Windows.in_runs`."""
    n = n.astype(np.int64)
    sizes = n + depth - 1
    starts = (np.cumsum(sizes) - sizes).repeat(n) + within(n)
    return words[starts[:, None] + np.arange(depth)]


def deep_nodes(suffixes: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, node): suffixes (rows of word numbers) as leaves in order, and the deep internal node that each hangs under.

    The tree is known by its leaves in order and the lengths of the prefixes
    that neighbours share: the leaves between two shorter ones hang under one
    internal node. Nodes of ``least_words`` and more are deep.
    """
    columns = [c.astype(np.int64) for c in suffixes.T]
    pairs = [(a << 32) | b for a, b in zip(columns[::2], columns[1::2], strict=False)] + columns[len(columns) // 2 * 2 :]
    order = np.lexsort(pairs[::-1])
    s = suffixes[order]
    differs = s[1:] != s[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), suffixes.shape[1]) if len(s) > 1 else np.zeros(0, np.int64)
    return order, np.append(0, np.cumsum(shared < least_words))[: len(s)]


def repeated_passages(docs: DataFrame, least_words: int = 13, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, int, int, Prefixes]:
    """(chunks of documents, answers to them, and what :class:`Windows` needs to read these).

    1. Texts are written in chunks, each word once and its number at each place,
       bucketed, and not shuffled again.
    2. A window whose words occur in one row only lies under no deep node. So
       each chunk asks which of its windows' hashes (of just as many bits as
       tell most apart) others have too; it sends each once and gets a bit back.
    3. What is left are suffixes that may repeat. They are counted by the hash
       of the least gram among their first ``least_words`` words; numbers with too
       many are parted by more of that hash and then word by word, again and
       again, until each group fits into memory.
    4. Each chunk sends its distinct suffixes, cut at ``least_words`` words, with
       these words to their groups; neighbours that go to one group are a run,
       whose words are sent once. A group sorts them, finds the deep nodes from the
       prefixes that neighbours share, and answers with the smallest id of each
       suffix's node. Here words are compared, so hashes decide nothing.

    A suffix that very many documents share is one entry of a chunk throughout.
    """
    spark = docs.sparkSession

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() * 1_000_000
        for k, c in enumerate(chunks(batches, lower=False, words=WORDS)):
            yield pa.RecordBatch.from_arrays([pa.array([first + k]), pa.array([len(c.words)], pa.int64()), pa.array([written(c)], pa.binary())], ["chunk", "n", "state"])

    own = F.col(f"`{id_col}`").cast("long")
    plain = only(docs, id=F.coalesce(own, F.lit(LAST)), missing=own.isNull(), text=text_col)
    table, path = f"passages_{uuid.uuid4().hex}", f"{shared_dir(spark)}/passages-{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = plain.mapInArrow(numbered, "chunk long, n long, state binary")
    named.write.bucketBy(buckets, "chunk").sortBy("chunk").format("parquet").option("path", path).saveAsTable(table)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    n_words = spark.table(table).agg(F.sum("n")).head()[0] or 0
    d = spark.table(table).select("chunk", "state")
    bits = int(min(64, max(LEAST_BITS, np.ceil(np.log2(n_words + 2)) + SPARE)))
    parts = int(max(1, n_words // 2_000_000))
    prefixes = Prefixes(1 << int(np.clip(4 * n_words // GROUP, FIRST, MOST) - 1).bit_length())

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, state in ((n, s) for b in batches for n, s in zip(b.column(0).to_pylist(), b.column(1), strict=True)):
            w = Windows(read_back(state.as_py()), least_words, bits)
            low, high = np.full(len(w.known), LAST), np.full(len(w.known), -LAST - 1)
            np.minimum.at(low, w.at, w.ids)
            np.maximum.at(high, w.at, w.ids)
            order, cuts = w.dealt(parts)
            rows = [(p, pack(deltas(w.known[order[x:y]]), np.packbits((high > low)[order[x:y]]))) for p, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if x < y]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([name] * len(rows), pa.int64()), pa.array([v for _, v in rows], pa.binary())], ["part", "chunk", "value"])

    def met_elsewhere(frame: pd.DataFrame) -> pd.DataFrame:
        asked = [unpack(v) for v in frame["value"]]
        hashes = [np.cumsum(a[0], dtype=np.uint64) for a in asked]
        _, back, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        several = n[back] > 1
        out, at = [], 0
        for a, h in zip(asked, hashes, strict=True):
            out.append(np.packbits(several[at : at + len(h)] | np.unpackbits(a[1], count=len(h)).view(bool)).tobytes())
            at += len(h)
        return pd.DataFrame({"chunk": frame["chunk"], "kind": 0, "part": frame["part"], "value": out})

    answer = "chunk long, kind int, part int, value binary"
    bitmaps = stage(d.mapInArrow(asking, "part int, chunk long, value binary").groupBy("part").applyInPandas(met_elsewhere, answer))

    def windows_of(rows: pd.DataFrame, bitmap: pd.DataFrame, levels: int) -> tuple[Windows, np.ndarray]:
        w = Windows(read_back(rows["state"].iat[0]), least_words, bits, levels)
        return w, w.met(dict(zip(bitmap["part"], bitmap["value"], strict=True)), parts)

    def counted(rows: pd.DataFrame, bitmap: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"number": [], "n": []})
        w, met = windows_of(rows, bitmap, prefixes.depths())
        _, first = np.unique(w.hash[met], return_index=True)
        number, n = np.unique(w.numbers(w.where[met[first]], prefixes), return_counts=True)
        return pd.DataFrame({"number": number, "n": n})

    while True:
        asked = d.groupBy("chunk").cogroup(bitmaps.groupBy("chunk"))
        counts = stage(asked.applyInPandas(counted, "number long, n long").groupBy("number").agg(F.sum("n").alias("n")))
        # There are no more frequent prefixes than groups that they would fill.
        frequent = np.array(sorted(r["number"] for r in counts.filter(F.col("n") > GROUP).collect()), np.int64)
        new = frequent[~np.isin(frequent, np.concatenate([np.zeros(0, np.int64), *prefixes.split]))]
        if not len(new) or len(prefixes.split) == STEPS + least_words:
            break
        prefixes.split.append(new)
    prefixes.groups = int(max(1, 4 * (counts.agg(F.sum("n")).head()[0] or 0) // GROUP))

    def sent(rows: pd.DataFrame, bitmap: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            w, met = windows_of(rows, bitmap, prefixes.depths())
            starts, group, least, _, _ = w.suffixes(met, prefixes)
            for g, x, y in runs_of(group):
                out.append((g, int(rows["chunk"].iat[0]), pack(*indexed(least[x:y]), *w.in_runs(starts[x:y]))))
        return pd.DataFrame(out, columns=["group", "chunk", "value"])

    def answered(frame: pd.DataFrame) -> pd.DataFrame:
        asked = [unpack(v) for v in frame["value"]]
        number: dict[bytes, int] = {}
        put = number.setdefault
        leaves = []
        for a in asked:
            own = np.array([put(w, len(number)) for w in a[3].tobytes().split(b"\n")], np.int32)
            leaves.append(from_runs(a[2], own[a[4]], least_words))
        ids = np.concatenate([a[0][a[1]] for a in asked])
        order, node = deep_nodes(np.concatenate(leaves), least_words)
        least = np.empty(len(ids), np.int64)
        starts = np.nonzero(np.append(True, node[1:] != node[:-1]))[0]
        least[order] = np.minimum.reduceat(ids[order], starts)[node]
        out, at = [], 0
        for x in leaves:
            out.append(pack(*indexed(least[at : at + len(x)])))
            at += len(x)
        return pd.DataFrame({"chunk": frame["chunk"], "kind": 1, "part": frame["group"], "value": out})

    grouped = d.groupBy("chunk").cogroup(bitmaps.groupBy("chunk")).applyInPandas(sent, "group int, chunk long, value binary")
    return d, bitmaps.union(grouped.groupBy("group").applyInPandas(answered, answer)), bits, parts, prefixes


def runs_of(group: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of the runs of equal values."""
    if len(group):
        cuts = np.append(0, np.append(np.nonzero(group[1:] != group[:-1])[0] + 1, len(group))).tolist()
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(group[x]), x, y


def indexed(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, and each id's place among them."""
    own, back = np.unique(ids, return_inverse=True)
    return own, back.astype(np.uint16 if len(own) < 65536 else np.uint32)


def passages(docs: DataFrame, least_words: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept, and spans.

    spans are the maximal passages of the row that consist of repeated windows:
    (start, n_words, first_id), by word from 0; first_id is the smallest id in
    which a window of the passage starts. The other columns are those of
    :func:`without_repeated_passages`.
    """
    d, told, bits, parts, prefixes = repeated_passages(docs, least_words, id_col, text_col)

    def cut(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "missing", "n_words", "n_removed", "kept", "spans"]
        if not len(rows):
            return pd.DataFrame(columns=columns)
        w = Windows(read_back(rows["state"].iat[0]), least_words, bits, prefixes.depths())
        of = {k: dict(zip(f["part"], f["value"], strict=True)) for k, f in found.groupby("kind")}
        met = w.met(of.get(0, {}), parts)
        _, group, _, _, place = w.suffixes(met, prefixes)
        least = np.full(len(group), LAST)
        for g, x, y in runs_of(group):
            own, back = unpack(of[1][g])
            least[x:y] = own[back]
        n = len(w.chunk.words)
        first = np.full(n, LAST)
        again = least[place] < w.ids[met]
        first[w.where[met[again]]] = least[place[again]]
        starts = np.zeros(n + least_words + 1, np.int64)
        at = w.where[met[again]]
        starts[at] += 1
        starts[at + least_words] -= 1
        gone = np.cumsum(starts)[:n] > 0
        out, at = [], 0
        named, words = w.chunk.named, w.chunk.words
        for (i, missing), size in zip(w.chunk.rows, w.chunk.sizes.tolist(), strict=True):
            mine = gone[at : at + size]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0]))))
            spans = [(int(x), int(y - x), int(first[at + x : at + y].min())) for x, y in zip(edge[::2], edge[1::2], strict=True)]
            kept = b" ".join([named[k] for k in words[at : at + size][~mine].tolist()]).decode()
            out.append((i, missing == 1, size, int(mine.sum()), kept, spans))
            at += size
        return pd.DataFrame(out, columns=columns)

    schema = "id long, missing boolean, n_words long, n_removed long, kept string, spans array<struct<start: long, n_words: long, first_id: long>>"
    out = d.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(cut, schema)
    return out.select(F.when(~F.col("missing"), F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept", "spans")


def without_repeated_passages(docs: DataFrame, least_words: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept (words joined by a space).

    A word goes if a window of ``least_words`` words of its document covers it
    whose words also start somewhere in a document with a smaller id. Windows
    are judged on the input. Words are runs of other characters than ASCII white
    space, unchanged; a null text has none. Rows that repeat an id are not
    smaller than each other; a null id is above all others. An empty table
    gives an empty result; other columns are not read.

    Windows are compared by their words; see :func:`repeated_passages`.
    """
    return passages(docs, least_words, id_col, text_col).drop("spans")
