"""All queries of the mailbox operators, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

GROUPS = [importlib.import_module(f"postrider.queries.{m}").group for m in ("filtering", "relational", "searching", "mirroring", "evaluating", "texts", "threading", "identity", "mimes", "streams")]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["search_smart"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for g in GROUPS for name, q in g.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for g in GROUPS for name, sql in g.SQL.items()}
