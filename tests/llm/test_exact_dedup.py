from pyspark.sql import functions as F

from postrider.llm.exact_dedup import exact_duplicates, without_copies

ROWS = [(3, "a b"), (1, "a \t\n b"), (2, "A b"), (None, None), (9, ""), (None, "x"), (None, "x"), (7, "long " * 50_000), (8, "long " * 50_000), (5, " a b"), (5, " a b")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep_id", F.lit("clash")).withColumn("h", F.lit(0))


def expected(rows):
    import re

    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for ids in groups.values():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep) for i in ids]
    return sorted(out, key=str)


def test_brute_force_and_collisions(spark):
    for h in (F.md5, lambda c: F.lit("all collide")):
        got = exact_duplicates(frame(spark), hash128=h).collect()
        assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got], key=str) == expected(ROWS)


def test_stage_keeps_columns(spark):
    out = without_copies(frame(spark))
    assert out.columns == ["doc_id", "text", "keep_id", "h"]
    # Rows that repeat id and text leave one.
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, [1, 2, 9, None, 7, 5]))


def test_stage_with_clashing_columns(spark):
    names = ["row", "id", "sha", "doc_id_2", "text_sha256", "kept", "count", "group_size", "__id", "__sha"]
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    out = without_copies(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == 6 and all(r[n] == n for r in rows for n in names)


def test_empty(spark):
    assert exact_duplicates(frame(spark, [])).count() == 0
