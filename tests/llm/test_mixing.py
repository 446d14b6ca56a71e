import random

import pytest
from pyspark.sql import functions as F

from postrider.llm import mixing
from postrider.llm.mixing import mixed, mixed_documents, permuted


def plain_targets(sizes):
    """Share by weight, cap, reshare the excess among the others until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = 1.5 * sum(sizes.values())
    done, left = {}, set(names)
    while left:
        rest = total - sum(done.values())
        w = sum(weight[s] for s in left)
        above = {s for s in left if rest * weight[s] / w > 2 * sizes[s]}
        if not above:
            done |= {s: rest * weight[s] / w for s in left}
            break
        done |= {s: 2.0 * sizes[s] for s in above}
        left -= above
    return done


def corpus():
    r = random.Random(4)
    rows = []
    for i in range(400):
        n = r.choice([0, 1, 30, 90, 2000 if i % 50 == 0 else 5])
        rows.append((i, " \n".join(f"w{i}.{j}" for j in range(n)), r.choice(["hot", "hot", "b", "É", "a", None])))
    return rows + [(None, "no id here", "b"), (None, None, "b"), (7, "same row", "a"), (7, "same row", "a"), (8, "", "only empty")]


def test_permutation(spark):
    df = spark.createDataFrame([(n, i) for n in (1, 2, 3, 10, 97, 1000) for i in range(n)], "n long, i long")
    got = df.select("n", permuted(F.col("i"), F.col("n"), F.lit(5)).alias("p")).groupBy("n").agg(F.countDistinct("p"), F.min("p"), F.max("p")).collect()
    assert all((r[1], r[2], r[3]) == (r.n, 0, r.n - 1) for r in got)


@pytest.mark.parametrize("block", [512, 16])
def test_mix(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "GROUP", 16)
    monkeypatch.setattr(mixing, "SHARD", 8)
    monkeypatch.setattr(mixing, "SPAN", 3)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rank", F.lit("clash")).withColumn("size", F.lit(0))
    documents, pieces = mixed(docs)
    got = documents.collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len((t or "").split())) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-9 for s in sizes)
    # The pieces of a pass do not overlap and lie within their document.
    for r in pieces.groupBy("key", "epoch").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("p")).collect():
        assert all(a.first + a.n <= b.first for a, b in zip(r.p, r.p[1:], strict=False))
    again = mixed(docs.repartition(5))[0].collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    words = [w for r in out.collect() for w in r.text.split()]
    assert len(words) == sum(taken.values())
    assert max(words.count(w) for w in ("w0.0", "w50.1", "here")) <= 2


def test_stage_with_clashing_columns(spark):
    names = ["row", "key", "n", "parts", "epoch", "rows", "of_id", "of_text", "of_source", "size", "text_key", "__id", "__rows", "__own", "shard", "rank", "block"]
    docs = spark.createDataFrame([(i, f"w{i} " * (i % 9), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string").withColumns({n: F.lit(n) for n in names})
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[n] == n for r in rows for n in names) and all(set(r.text.split()) == {f"w{r.doc_id}"} for r in rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixed(docs)[0].count() == 0 and mixed_documents(docs).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.taken, r.target) for r in mixed(one)[0].collect()] == [(0, 0, 0.0)]


def test_texts_are_shuffled_once(spark):
    """One join takes the texts, each once, unless rows repeat; repeated rows are still one document."""
    rows = [(i, f"w{i} " * (i % 9 + 1), "ab"[i % 2]) for i in range(60)]
    plan = lambda docs: mixed_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    schema = "doc_id long, text string, source string"
    docs = spark.createDataFrame(rows, schema)
    p = plan(docs)
    assert p.count("Join ") == 1 and " AS text#" not in p.partition("Join ")[2]
    twice = mixed_documents(spark.createDataFrame(rows + rows[8:9], schema)).filter("doc_id = 8").collect()
    size, taken = mixed(spark.createDataFrame(rows + rows[8:9], schema))[0].filter("doc_id = 8").selectExpr("sum(size)", "sum(taken)").head()
    assert size == 18 and sum(len(x.text.split()) for x in twice) == taken
