"""Documents as chunks of hashed words, and compact arrays for rows that Spark shuffles.

Jobs over all words of a corpus would shuffle a row for each word. Instead a
task packs what it sends to one partition into one binary row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame

from ..plans.staging import shared_dir

#: Words in a chunk; a document with more is a chunk of its own.
WORDS = 1_000_000
#: Rows whose texts are split at a time.
SLICE = 500
#: One for all values of a task, most of which are small.
_UNZIP = zstandard.ZstdDecompressor()


@dataclass
class Chunk:
    """Words of some rows: ``words[i]`` numbers into ``hashes`` and ``named``; row r has ``sizes[r]`` of them."""

    rows: list
    sizes: np.ndarray
    words: np.ndarray
    named: list[bytes]

    @cached_property
    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.named), np.uint64, len(self.named))

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def split_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array]:
    """(words in each text, all words one after the other); words are what ASCII white space parts, only A-Z are lower-cased."""
    texts = texts.cast(pa.string()).fill_null("")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    found, text = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    # White space at an end of a text leaves an empty string there.
    there = pc.not_equal(found, "")
    return np.bincount(text[there.to_numpy(zero_copy_only=False)], minlength=len(texts)), found.filter(there)


def chunks(batches: Iterator[pa.RecordBatch], lower: bool, words: int = WORDS) -> Iterator[Chunk]:
    """Chunks of the rows of Arrow batches; the last column is the text, the others stay as tuples."""
    rows, sizes, found = [], [], []
    total = 0

    def chunk() -> Chunk:
        # Numbers in the order in which words first occur.
        known = pa.concat_arrays(found).dictionary_encode()
        # As one value: a Python object for each word comes from one split, which is faster than Arrow's.
        lines = pc.binary_join(pa.ListArray.from_arrays([0, len(known.dictionary)], known.dictionary), "\n")[0].as_buffer().to_pybytes()
        return Chunk(rows, np.concatenate(sizes).astype(np.int64), known.indices.to_numpy(), lines.split(b"\n") if lines else [])

    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            others = list(zip(*[c.to_pylist() for c in batch.columns[:-1]], strict=True))
            n, named = split_words(batch.columns[-1], lower)
            ends = np.cumsum(n)
            row = 0
            while row < len(n):
                before = int(ends[row] - n[row])
                # Up to the row that fills the chunk.
                last = min(int(np.searchsorted(ends, before + words - total)) + 1, len(n))
                rows += others[row:last]
                sizes.append(n[row:last])
                found.append(named.slice(before, int(ends[last - 1]) - before))
                total += int(ends[last - 1]) - before
                row = last
                if total >= words:
                    yield chunk()
                    rows, sizes, found, total = [], [], [], 0
    if rows:
        yield chunk()


def bucketed(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder in buckets of its column chunk, so that joins and groups by it need no shuffle; it goes when the application ends."""
    spark = df.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, "chunk").sortBy("chunk").format("parquet").option("path", path).saveAsTable(name)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.table(name)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as one compressed value; bytes of equal rank lie together."""
    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), a.dtype.itemsize, ord(a.dtype.kind))]], np.int64)
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(planes))


def unpack(value: bytes) -> list[np.ndarray]:
    raw = _UNZIP.decompress(value)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(n, 3)
    at, out = 8 + 24 * n, []
    for size, width, kind in head.tolist():
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"{chr(kind)}{width}"))
        at += size * width
    return out


def deltas(x: np.ndarray) -> np.ndarray:
    """Differences of rising numbers, which pack smaller; ``np.cumsum`` with the same type reverses it."""
    return np.diff(x, prepend=x.dtype.type(0))


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
