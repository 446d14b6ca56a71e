"""Quoted texts with ends and line ends that the shared tables lack."""

import duckdb
import pytest
from pyspark.sql import functions as F

from postrider import registry
from postrider.functions import text as t

TEXTS = [
    "one line", "a\nb", "a\n", "a\n\n", "\n", "\n\n", "\na", "", None, " ", "\r", "a\r\nb", "a\rb", "a\r\n", "a\n\rb", "a\x0bb\x0cc",
    "a\u0085b", "a\u2028b\u2029c", "a\u0085", "a\u2029", "> a\n> b", "$1\\1\n$0", "é\n\U0001f600\nß", "a\x00b\n",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("quoting"))
    rows = [(17 * k + 1, x, "en", "src1", len(x or "")) for k, x in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


def test_quotes_of_odd_texts_are_those_of_the_sql(spark, tables):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tables}/documents.parquet/*.parquet')")
    want = dict(con.execute(registry.oracle_sql()["txt_quote"]).fetchall())
    found = {r["id"]: r["value"] for r in registry.queries()["txt_quote"](spark, tables).collect()}
    assert len(want) == len(TEXTS)
    assert {TEXTS[i // 17]: (found.get(i), v) for i, v in want.items() if found.get(i, 0) != v} == {}


@pytest.mark.parametrize(
    ("text", "quoted"),
    [("first\n\nlast\n", "> first\n> \n> last\n> "), ("a\rb\u2028c", "> a\rb\u2028c"), ("\n", "> \n> "), ("", ""), (None, "")],
)
def test_a_reply_quotes_each_line(spark, text, quoted):
    c = spark.createDataFrame([(text,)], "c string").select(t.quoted_reply(F.col("c")).alias("c"))
    assert c.first()["c"] == quoted
