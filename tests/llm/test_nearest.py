import numpy as np
import pytest
from pyspark.sql import functions as F

from postrider.llm import nearest as module
from postrider.llm.nearest import cells_by_distance, nearest


def test_heap_order():
    r = np.random.default_rng(1)
    a, b, counts = r.random(7), r.random(5), r.integers(0, 3, 35)
    got = cells_by_distance(a, b, counts, counts.sum())
    want = [c for c in np.argsort((a[:, None] + b).ravel(), kind="stable") if counts[c]]
    assert got == want
    assert cells_by_distance(a, b, counts, 1) == want[:1]


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v) / np.sqrt((np.array(v) ** 2).sum())
    return {i: sorted(((-float(u @ v), j) for j, v in ok.items() if j != i))[:k] for i, u in ok.items() if i % 50 == 0}


@pytest.mark.parametrize("block", [1024, 40])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    r = np.random.default_rng(2)
    rows = [(i, list(map(float, r.normal(size=8)))) for i in range(600)]
    rows += [(i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, -1.0]) for i in range(600, 900)]  # a hot vector
    rows += [(1000, None), (1050, [0.0] * 8), (1100, [float("nan")] + [1.0] * 7), (1150, [float("inf")] + [1.0] * 7), (1200, [None] + [1.0] * 7), (None, [1.0] * 8), (1250, [1e200] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("clash"))
    want = brute(rows[:900] + [(1250, [1.0] * 8)], 5)
    full = nearest(df, lambda i: i % 50 == 0, probed=1.0, centroids=4).collect()
    got = {}
    for x in sorted(full, key=lambda x: x["rank"]):
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert got.keys() == want.keys()
    for q in want:
        assert [j for j, _ in got[q]] == [j for _, j in want[q]]
        assert np.allclose([s for _, s in got[q]], [-s for s, _ in want[q]])
    part = nearest(df, lambda i: i % 50 == 0, probed=0.75, centroids=4).collect()
    assert len({(x.query_id, x.vec_id) for x in part} & {(q, j) for q in want for _, j in want[q]}) >= 0.9 * 5 * len(want)


def test_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest(spark.createDataFrame([], schema), lambda i: i % 50 == 0).count() == 0
    two = nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], schema), lambda i: i % 50 == 0).collect()
    assert [(x.query_id, x["rank"], x.vec_id) for x in two] == [(0, 1, 1)] and abs(two[0].score - 0.5**0.5) < 1e-9


@pytest.mark.parametrize("n", range(2, 13))
def test_all_of_few(spark, n):
    """With few vectors the share probed holds all candidates that a result needs."""
    r = np.random.default_rng(n)
    rows = [(i, list(map(float, r.normal(size=4)))) for i in range(n)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0).collect()
    assert [(x["rank"], x.vec_id) for x in sorted(got, key=lambda x: x["rank"])] == [(k, j) for k, (_, j) in enumerate(brute(rows, 5)[0], 1)]


def test_repeated_rows(spark):
    """Rows that repeat, of queries and of others, change nothing."""
    r = np.random.default_rng(6)
    rows = [(i, list(map(float, r.normal(size=4)))) for i in range(60)] + [(i, [1.0, 0.0, 2.0, 0.0]) for i in range(60, 70)]
    more = rows + [rows[0]] * 3 + [rows[50]] + [rows[60]] * 8
    got = nearest(spark.createDataFrame(more, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0, probed=1.0, centroids=4).collect()
    want = {(q, k, j) for q, found in brute(rows, 5).items() for k, (_, j) in enumerate(found, 1)}
    assert sorted((x.query_id, x["rank"], x.vec_id) for x in got) == sorted(want)


def by_id(rows, k):
    """Brute force where ids have several vectors: an id counts by its best."""
    v = [(i, np.array(x) / np.linalg.norm(x)) for i, x in rows]
    out = {}
    for q in {i for i, _ in v if i % 50 == 0}:
        best = {}
        for own in (u for i, u in v if i == q):
            for j, u in v:
                if j != q:
                    best[j] = max(best.get(j, -2.0), float(own @ u))
        out[q] = sorted((-s, j) for j, s in best.items())[:k]
    return out


@pytest.mark.parametrize("block", [8192, 64])
def test_ids_with_many_vectors(spark, monkeypatch, block):
    """One id's vectors take one place: neither those of the query itself nor those of a neighbour push others out."""
    monkeypatch.setattr(module, "BLOCK", block)
    r = np.random.default_rng(8)
    base, other = r.normal(size=8), r.normal(size=8)
    near = lambda v, off: list(map(float, v + off * r.normal(size=8)))
    rows = [(0, near(base, 1e-6)) for _ in range(200)] + [(i, near(base, 1e-4)) for i in range(1, 9)]
    rows += [(50, list(map(float, other)))] + [(51, near(other, 1e-6)) for _ in range(200)] + [(i, near(other, 1e-3)) for i in range(52, 59)]
    rows += [(i, list(map(float, r.normal(size=8)))) for i in range(101, 300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = by_id(rows, 5)
    for probed, centroids in ((None, None), (1.0, 4), (0.01, 8)):
        got = {}
        for x in nearest(df, lambda i: i % 50 == 0, probed=probed, centroids=centroids).collect():
            got.setdefault(x.query_id, []).append((x["rank"], x.vec_id))
        full = {q: [(k, j) for k, (_, j) in enumerate(found, 1)] for q, found in want.items()}
        assert {q: len(g) for q, g in got.items()} == dict.fromkeys(want, 5)
        for q in (0, 50) if probed == 0.01 else want:
            if probed == 1.0:
                assert sorted(got[q]) == full[q]
            assert {j for _, j in got[q]} == {j for _, j in full[q]} or probed is None and q not in (0, 50)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall(spark, sf):
    """The registered query's parameters find nine tenths of the five nearest, by brute force over the whole table."""
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()], 5)
    got = {(r.query_id, r.vec_id) for r in nearest(df, lambda i: i % 50 == 0).collect()}
    true = {(q, j) for q, found in want.items() for _, j in found}
    assert len(got & true) >= 0.93 * len(true) and len(got) == len(true)
