"""What the corpus operators share on text: column expressions of built-in functions, and slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, and runs of it that are not one plain space.
SPACE = r"[\x20\x09-\x0D]"
NOT_ONE_SPACE = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"


def one_spaced(text: Column) -> Column:
    """Each run of white space becomes one space; null becomes the empty text.

    The pattern leaves out single spaces, which would only be replaced by
    themselves, so that nearly all of a text is copied as it is.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), NOT_ONE_SPACE, " ")


def n_words(text: Column) -> Column:
    """Number of runs of other characters than white space (null: 0)."""
    t = F.trim(one_spaced(text))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def sliced(batch: pa.RecordBatch, text: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and ``size`` bytes in column ``text``, unless one row has more."""
    at = held = 0
    for end, n in enumerate(pc.binary_length(batch.column(text)).fill_null(0).to_pylist()):
        if end > at and (held + n > size or end - at >= rows):
            yield batch.slice(at, end - at)
            at, held = end, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)
