"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda."""

from __future__ import annotations

import re
import string
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.columns import only
from .text import sliced

#: Bytes, about, of the chunks that a Python worker remembers; the first ones stay. Only speed depends on it.
REMEMBERED = 48_000_000
#: Bytes that an entry takes besides its letters and ids: two objects and a place in the table.
ENTRY = 250
#: Texts that are encoded together: rows, and bytes unless one has more. Their chunks, as objects, take some forty times that.
ROWS, LETTERS = 1000, 250_000
#: Fixed value: the letter that stands for a space in vocabularies.
BLANK = "▁"


class MergeEncoder:
    """Encodes and decodes like the library's model of the same file, which must be of merge type with byte fallback."""

    def __init__(self, model: bytes):
        sp = self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): (-sp.get_score(i), i) for i in plain}
        self.bytes_of = {i: bytes([int(sp.id_to_piece(i)[3:-1], 16)]) for i in range(n) if sp.is_byte(i)}
        self.byte_ids = {b[0]: i for i, b in self.bytes_of.items()}
        self.texts = {i: p.replace(BLANK, " ").encode() for p, (_, i) in self.pieces.items()} | self.bytes_of
        self.end = sp.eos_id()
        if len(self.byte_ids) < 256 or sp.encode("  a", out_type=str)[0][:1] != BLANK:
            raise ValueError("a vocabulary with byte fallback and kept white space is needed")
        # No merge goes over a border that no piece spans: before a blank that
        # follows another letter, and around line ends.
        if any(BLANK in p.lstrip(BLANK) or ("\n" in p and len(p) > 1) for p in self.pieces):
            raise ValueError("pieces of this vocabulary span words")
        # Nor over the border before a mark that follows another letter, once
        # all letters that stand before marks inside pieces count as marks too.
        marks, found = set(), set(string.punctuation)
        while found - marks:
            marks |= found
            found = {x for p in self.pieces for x, y in zip(p, p[1:], strict=False) if y in marks and x != BLANK}
        m = re.escape("".join(sorted(marks)))
        self.chunks = re.compile(f"{BLANK}*[^{BLANK}\n{m}]+|{BLANK}*[{m}]+[^{BLANK}\n{m}]*|{BLANK}+|\n").findall
        self.known: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}
        self.held = 0

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk: the best-scored adjacent pair merges first, the leftmost among equals."""
        pieces = self.pieces
        symbols: list[str] = list(chunk)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            found = pieces.get(symbols[i] + symbols[i + 1])
            if found:
                agenda.append((found[0], i, i + 1, 2))
        heapify(agenda)
        while agenda:
            _, i, j, length = heappop(agenda)
            left, right = symbols[i], symbols[j]
            if not left or not right or after[i] != j or len(left) + len(right) != length:
                continue  # one of the two has merged since
            both = symbols[i] = left + right
            symbols[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = pieces.get(both + symbols[k])
                if found:
                    heappush(agenda, (found[0], i, k, length + len(symbols[k])))
            h = before[i]
            if h >= 0:
                found = pieces.get(symbols[h] + both)
                if found:
                    heappush(agenda, (found[0], h, i, length + len(symbols[h])))
        ids: list[int] = []
        for s in symbols:
            if s:
                found = pieces.get(s)
                if found:
                    ids.append(found[1])
                else:
                    ids.extend(self.byte_ids[b] for b in s.encode())
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of a whole encoding; ids without text (the end) are left out."""
        t = b"".join([self.texts.get(i, b"") for i in ids]).decode("utf-8", "replace")
        return t[1:] if t[:1] == " " else t

    def learn(self, chunks: set[str]) -> tuple[dict[str, bytes], dict[str, str]]:
        """Encode new chunks and hold each against the library, in one call for all; remember them while there is room."""
        new, ids_of, odd = list(chunks), {}, {}
        # After a line end, which never merges, the library sees a chunk as it is.
        for c, want in zip(new, self.library.encode(["\n" + c.replace(BLANK, " ") for c in new], num_threads=1), strict=True):
            ids = self.merge(c)
            if ids != want[2:]:
                raise ValueError(f"the library encodes {c!r} as {want[2:]}, the agenda as {ids}")
            ids_of[c] = array("i", ids).tobytes()
            text = b"".join([self.texts[i] for i in ids]).decode("utf-8", "replace")
            if text != c.replace(BLANK, " "):
                odd[c] = text
        for c, i in ids_of.items():
            if self.held >= REMEMBERED:
                return ids_of, odd
            self.known[c] = i
            if c in odd:
                self.odd[c] = odd[c]
            self.held += ENTRY + 2 * len(c) + len(i)
        return {}, {}

    def batch(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Of each text the ids with the end, as bytes of int32, and what they decode to."""
        parts = [self.chunks(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        known = self.known
        new = {c for p in parts for c in p if c not in known}
        fresh, odd = self.learn(new) if new else ({}, {})
        end = array("i", [self.end]).tobytes()
        if fresh:
            ids = [b"".join([known.get(c) or fresh[c] for c in p]) + end for p in parts]
        else:
            ids = [b"".join([known[c] for c in p]) + end for p in parts]
        odd = self.odd | odd if odd else self.odd
        if odd:
            return ids, ["".join([odd.get(c) or c.replace(BLANK, " ") for c in p])[1:] for p in parts]
        return ids, [t.replace(BLANK, " ") for t in texts]


_ENCODERS: dict[int, MergeEncoder] = {}


def _encoder(model: bytes) -> MergeEncoder:
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS[key] = MergeEncoder(model)
    return _ENCODERS[key]


def encoded_batches(encoder: MergeEncoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches of an id and a text, batches of the id, the ids of the encoding and what they decode to."""
    for whole in batches:
        for b in sliced(whole, 1, ROWS, LETTERS):
            ids, decoded = encoder.batch(b.column(1).to_pylist())
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=ends[1:])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, ids (array of int, end id last), decoded.

    ``model`` is a SentencePiece file on the driver; tasks get its bytes (0.5 MB
    for 32,000 pieces). Each distinct chunk is encoded by the agenda once in a
    worker and held against the library in the same Arrow batch; a difference
    raises. Null counts as the empty text, whose encoding is the end id alone.
    Null and repeated ids are passed through, other columns are not read. No
    shuffle; memory is that of an Arrow batch and of the remembered chunks.
    """
    with open(model, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encoded_batches(_encoder(raw.value), batches)

    d = only(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return d.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (decimal, joined by a space) and of the decoded text."""
    e = encoded(docs, model, id_col, text_col)
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return e.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
