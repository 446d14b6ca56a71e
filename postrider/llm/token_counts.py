"""Exact token counts at every prefix of a text, by dynamic programming over prefixes."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.columns import only

#: The published splitting pattern of byte-level vocabularies, and its contractions.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CONTRACTIONS = frozenset({"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"})
#: Bytes, about, of the tables that a Python worker remembers, and token pairs; then it starts anew. Only speed depends on them.
REMEMBERED = 48_000_000
PAIRS = 200_000
#: Bytes that an entry takes besides its letters and counts: two objects and a place in the table.
ENTRY = 220


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabulary files write for each byte, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter:
    """Counts for a byte-level BPE file of the ``tokenizers`` library.

    For each prefix of a piece exactly one token can be the last of its
    encoding: the one that stays whole beside the last token of the prefix it
    follows. So the table of last tokens fills from left to right, and the
    count at a prefix is one more than at the prefix before its last token.
    """

    def __init__(self, raw: bytes):
        file = json.loads(raw)
        letters = _byte_letters()
        ids = file["model"]["vocab"]
        self.ids = {bytes(letters[c] for c in t): i for t, i in ids.items() if all(c in letters for c in t)}
        self.longest = max(map(len, self.ids))
        self.joined: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(file["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            whole = ids[a + b]
            self.joined[ids[a], ids[b]] = r
            self.rank[whole] = r
            self.halves[whole] = ids[a], ids[b]
        special = [t["content"] for t in file.get("added_tokens", ())]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.special_set = frozenset(special)
        self.fits: dict[tuple[int, int], bool] = {}
        self.tables: dict[str, bytes | list[int]] = {}
        self.held = 0

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of tokens a and b gives just these two."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            known = self.fits[a, b] = self._stay_apart(a, b)
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        # Undo the merges of both, the latest first. At each step the tokens at
        # the border must not have merged before the merge that was undone last.
        rank, halves = self.rank, self.halves
        ra, rb = rank.get(a, -1), rank.get(b, -1)
        before = float("inf")  # a merge over the border of this rank or later came too late
        left_first = False  # at equal ranks the left merge came first
        while True:
            r = self.joined.get((a, b))
            if r is not None and (r < before or (r == before and not left_first)):
                return False
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before, left_first, a = ra, True, halves[a][1]
                ra = rank.get(a, -1)
            else:
                before, left_first, b = rb, False, halves[b][0]
                rb = rank.get(b, -1)

    def table(self, piece: str) -> bytes | list[int]:
        """Token count at each prefix of a piece, by bytes, from the empty prefix on."""
        found = self.tables.get(piece)
        if found is None:
            if self.held > REMEMBERED:
                self.tables.clear()
                self.held = 0
            found = self.tables[piece] = self._table(piece.encode())
            self.held += ENTRY + 2 * len(piece) + (len(found) if isinstance(found, bytes) else 36 * len(found))
        return found

    def _table(self, b: bytes) -> bytes | list[int]:
        ids, longest, fits = self.ids, self.longest, self.fits
        counts, last = [0], [-1]
        for end in range(1, len(b) + 1):
            for start in range(end - 1, max(-1, end - longest - 1), -1):
                t = ids.get(b[start:end])
                if t is None:
                    continue
                if start:
                    fit = fits.get((last[start], t))
                    if not (self.stay_apart(last[start], t) if fit is None else fit):
                        continue
                counts.append(counts[start] + 1)
                last.append(t)
                break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return bytes(counts) if len(b) < 256 else counts

    def parts(self, text: str) -> list[str]:
        """The text's pieces in order; special strings are pieces of their own."""
        if self.special is None or not self.special.search(text):
            return PIECES.findall(text)
        return [p for s in self.special.split(text) for p in ([s] if s in self.special_set else PIECES.findall(s))]

    def count(self, text: str) -> int:
        known, n = self.tables, 0
        for p in self.parts(text):
            t = known.get(p)
            if t is None:
                if p in self.special_set:
                    n += 1
                    continue
                t = self.table(p)
            n += t[-1]
        return n


class PrefixCounts:
    """The stored counts of one text: ``at(i)`` is the exact count of ``text[:i]``."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text, self.parts = counter, text, counter.parts(text)
        self.starts, self.counts = [], []
        start = n = 0
        for p in self.parts:
            self.starts.append(start)
            self.counts.append(n)
            start += len(p)
            n += 1 if p in counter.special_set else counter.table(p)[-1]
        self.total = n

    def at(self, i: int) -> int:
        if i <= 0:
            return 0
        if i >= len(self.text):
            return self.total
        k = bisect_right(self.starts, i - 1) - 1
        piece, start = self.parts[k], self.starts[k]
        whole = i == start + len(piece)
        if self.text[i - 1].isspace() and not (whole and piece in self.counter.special_set):
            # White space at the end of a prefix is one piece, wherever the whole text splits it.
            while k and self.parts[k - 1].isspace():
                k -= 1
            return self.counts[k] + self.counter.table(self.text[self.starts[k] : i])[-1]
        if whole:
            return self.counts[k] + (1 if piece in self.counter.special_set else self.counter.table(piece)[-1])
        if piece in self.counter.special_set:  # cut inside: an ordinary string, which may join the piece before
            k -= bool(k)
            return self.counts[k] + self.counter.count(self.text[self.starts[k] : i])
        if piece in CONTRACTIONS:
            return self.counts[k] + (i - start)
        return self.counts[k] + self.counter.table(piece)[len(self.text[start:i].encode())]

    def longest(self, budget: int) -> int:
        """Characters of the longest prefix of which no shorter prefix has more tokens than the budget."""
        if self.total <= budget:
            return len(self.text)
        k = max(0, bisect_right(self.counts, budget) - 2)
        i = self.starts[k]
        while i < len(self.text) and self.at(i + 1) <= budget:
            i += 1
        return i


_COUNTERS: dict[int, PrefixCounter] = {}


def _counter(raw: bytes) -> PrefixCounter:
    key = hash(raw)
    if key not in _COUNTERS:
        _COUNTERS[key] = PrefixCounter(raw)
    return _COUNTERS[key]


def _vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    ``vocabulary`` is a byte-level BPE file on the driver; tasks get its bytes
    (1.5 MB for 50,000 tokens). Texts are counted whole, special strings count
    one, nothing is added. A null text counts as empty (0 tokens); null and
    repeated ids are passed through; other columns are not read. No shuffle.
    """
    raw = docs.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(raw.value).count
        for b in batches:
            n = pa.array([count(t.as_py()) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], ["doc_id", "n_tokens"])

    d = only(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    # The byte count rides along as a column, so that no text leaves the JVM twice.
    d = d.select(F.struct("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).alias("key"), "text")
    out = d.mapInArrow(run, "doc_id struct<doc_id: long, n_bytes: long>, n_tokens long")
    return out.select("doc_id.doc_id", "doc_id.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def truncated(docs: DataFrame, vocabulary: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, kept_tokens, kept_text: the longest prefix within ``budget`` tokens, from the stored counts."""
    raw = docs.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(raw.value)
        for b in batches:
            total, kept, texts = [], [], []
            for t in b.column(1):
                p = PrefixCounts(counter, t.as_py())
                i = p.longest(budget)
                total.append(p.total)
                kept.append(p.at(i))
                texts.append(p.text[:i])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(kept, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "kept_tokens", "kept_text"])

    d = only(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return d.mapInArrow(run, "doc_id long, n_tokens long, kept_tokens long, kept_text string")
