"""Every query that SQL can express gives DuckDB's rows on the same tables."""

import datetime
import decimal
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import duckdb
import pytest

from postrider import registry

SF_DIR = "/root/testdata/sf0.001"
NAMES = sorted(registry.oracle_sql())


def plain(x):
    """A value that does not depend on the engine that made it."""
    if isinstance(x, decimal.Decimal):
        return plain(float(x))
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return int(x) if x.is_integer() else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, bytes | bytearray):
        return bytes(x)
    if isinstance(x, list):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    return x


def rows(names, found):
    """The names in order, and the rows with their columns in that order, sorted."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([plain(r[i]) for i in order] for r in found), key=repr)


@pytest.fixture(scope="module")
def answers(spark):
    def one(name):
        try:
            df = registry.queries()[name](spark, SF_DIR)
            return rows(df.columns, df.collect())
        except Exception as e:  # shown by the test of this query
            return e

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(NAMES, pool.map(one, NAMES), strict=True))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(name, answers, duck):
    if isinstance(answers[name], Exception):
        raise answers[name]
    found = duck.execute(registry.oracle_sql()[name])
    assert answers[name] == rows([c[0] for c in found.description], found.fetchall())


def test_flagship_is_a_query(spark):
    assert registry.flagship(spark, SF_DIR).columns
