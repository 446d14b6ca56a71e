"""Column names that cannot clash with those of the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only(df: DataFrame, **named: str | Column) -> DataFrame:
    """``df`` cut down to the given columns under fixed names; other columns play no part."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in named.items()])
