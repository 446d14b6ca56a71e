import random
from itertools import combinations

import numpy as np

from postrider.llm.similar import without_similar


def plain_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def plain_kept(rows, least=0.8):
    """Smallest ids of the components of brute-force Jaccard."""
    sets = {i: plain_set(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted(i for i in sets if find(i) == i)


def corpus():
    r = random.Random(4)
    rows = [(None, "a b c d e f"), (None, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One\ttwo"), (5, "one three")]
    for i in range(150):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([30, 120, 500]))]
        rows.append((1000 + i * 10, " ".join(base)))
        for j in range(1, 4):  # about 1 to 4 % of the words, so similarities lie on both sides of 0.8
            w = base[:]
            for _ in range(max(1, round(len(w) * r.uniform(0.005, 0.04)))):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            rows.append((1000 + i * 10 + j, " ".join(w)))
    return rows


def test_against_brute_force(spark, monkeypatch):
    from postrider.llm import similar

    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain_kept(rows)
    assert 150 < len(want) < 500
    got = without_similar(docs)
    assert got.columns == docs.columns
    ids = [x.doc_id for x in got.collect()]
    assert ids.count(None) == 2
    assert sorted(i for i in ids if i is not None) == want
    monkeypatch.setattr(similar, "TILE", 400)  # groups in tiles
    assert sorted(x.doc_id for x in without_similar(docs).collect() if x.doc_id is not None) == want
    assert without_similar(docs.limit(0)).count() == 0


def test_stage_with_clashing_columns(spark):
    names = ["row", "node", "fp", "keys", "hashes", "component", "size", "part", "__dropped"]
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x")], "doc_id long, text string")
    from pyspark.sql import functions as F

    docs = docs.withColumns({n: F.lit(n) for n in names})
    out = without_similar(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, *[r[n] for n in names]) for r in out.collect()) == [(1, *names), (3, *names)]


def test_stage(spark):
    """The pipeline's stage drops a near copy that differs in some 2 % of its words and keeps what is below 0.8."""
    import corpus_pipeline

    rows = [(i, t) for i, t in corpus() if i is not None]
    kept = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(x.doc_id for x in kept.collect()) == plain_kept(rows)


def test_links_of_a_chain_lead_to_the_smallest(spark):
    """Chains of near copies would take many rounds of components."""
    from postrider.llm.similar import verified_links

    rows = [(100 - i, 1, 10, np.arange(i, i + 20, dtype=np.uint64).tobytes()) for i in range(30)]
    links = verified_links(spark.createDataFrame(rows, "node long, component long, size long, hashes binary"), 0.8).collect()
    assert sorted((x.src, x.dst) for x in links) == [(i, 71) for i in range(72, 101)]
