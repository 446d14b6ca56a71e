import random

import numpy as np
from pyspark.sql import functions as F

from postrider.llm import line_dedup
from postrider.llm.line_dedup import PerfectHash, without_repeated_lines


def plain(rows, chars=20, docs=3):
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\v\f\r"))
    n, last = {}, {}
    below = -1
    for i, t in rows:
        for k in {low(x) for x in (t or "").split("\n")}:
            n[k] = n.get(k, 0) + 1
            last[k] = max(last.get(k, below - 1), below if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(k := low(x)) >= chars and n[k] >= docs and last[k] != (below if i is None else i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_perfect_hash():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**64, (2, 5000), dtype=np.uint64)
    a[:100] = a[0]
    h = PerfectHash.build(a, b)
    assert sorted(h.index(a, b)) == list(range(5000))
    assert len(PerfectHash.build(a[:0], b[:0]).index(a[:0], b[:0])) == 0


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD", 40)
    monkeypatch.setattr(line_dedup, "PROBES", 30)
    r = random.Random(2)
    common = ["  A common LINE of some length É\t", "a common line of some length É", "a common line of some length é", "é" * 19, "é" * 20, "x" * 19, "x" * 20, "", "  "]
    rows = [(i, "\n".join(r.choice(common + [f"own line number {i} of this document"] * 4) for _ in range(r.randint(1, 12)))) for i in range(150)]
    rows += [(None, None), (None, "x" * 20), (500, ""), (7, "x" * 20 + "\n" + "y " * 30_000), (501, "\n".join(["X" * 20] * 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("a", F.lit("clash")).withColumn("id", F.lit(1))
    assert sorted(map(tuple, without_repeated_lines(docs).collect()), key=str) == plain(rows)
    assert without_repeated_lines(docs.limit(0)).count() == 0
