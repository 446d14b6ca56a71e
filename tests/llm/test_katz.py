import math
import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from postrider.llm import katz
from postrider.llm.katz import LARGE, discounts, scored


def corpus():
    r = random.Random(4)
    word = lambda: "W" + str(int(r.paretovariate(0.8)))
    rows = [(i, r.choice([" ", "\n"]).join(word() for _ in range(r.randint(0, 60)))) for i in range(400)]
    return rows + [(None, None), (None, "w1 new"), (3, ""), (9, "a b " * 3000), (9, "a b")]


def factors(types):
    """Good-Turing factors from the line through the logarithms of the counts of counts."""
    n = {r: sum(c == r for c in types.values()) for r in range(1, LARGE + 2)}
    there = [r for r in n if n[r]]
    slope = -2.0
    if len(there) > 1:
        points = []
        for k, r in enumerate(there):
            q = there[k - 1] if k else 0
            t = there[k + 1] if k + 1 < len(there) else 2 * r - q
            points.append((math.log(r), math.log(2 * n[r] / (t - q))))
        slope = min(-1.1, np.polyfit(*zip(*points, strict=True), 1)[0])
    line = lambda r: r**slope
    cut = (LARGE + 1) * line(LARGE + 1) / line(1)
    return {r: ((r + 1) * line(r + 1) / line(r) / r - cut) / (1 - cut) for r in range(1, LARGE + 1)}


def plain(rows, order):
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    tokens = lambda t: [*(t or "").encode().lower().split(), "END"]
    grams = lambda w, n: [tuple((["BEGIN"] * (n - 1) + w)[k : k + n]) for k in range(len(w))]
    seen = {n: Counter() for n in range(1, order + 1)}
    for i, t in rows:
        if not held(i):
            for n in seen:
                seen[n].update(grams(tokens(t), n))
    d = {n: factors(seen[n]) for n in seen}
    cut = lambda g: seen[len(g)][g] * d[len(g)].get(seen[len(g)][g], 1.0)
    size = sum(seen[1].values())
    mass = sum(map(cut, seen[1]))
    total = size if size - mass > 0 else size + 1
    after = defaultdict(list)
    for n in range(2, order + 1):
        for g in seen[n]:
            after[g[:-1]].append(g)

    @cache
    def weights(h):
        if h not in after:
            return 1, 1.0
        count, kept = sum(seen[len(g)][g] for g in after[h]), sum(map(cut, after[h]))
        den = count if count - kept > 1e-9 * count else count + 1
        return den, (1 - kept / den) / (1 - sum(p(g[1:]) for g in after[h]))

    @cache
    def p(g):
        if len(g) == 1:
            return (cut(g) if g in seen[1] else total - mass) / total
        den, alpha = weights(g[:-1])
        return cut(g) / den if g in seen[len(g)] else alpha * p(g[1:])

    words = [g[0] for g in seen[1]] + ["never seen"]
    for h in [(), *list(after)[:20], *list(after)[-20:]]:
        assert abs(sum(p((*h, w)) for w in words) - 1) < 1e-9
    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((seen[1][x,] + 0.5) / (size + 0.5 * (len(seen[1]) + 1))) for x in w)
        out.append((i, held(i), len(w), sum((x,) in seen[1] for x in w), size, base, sum(math.log10(p(g)) for g in grams(w, order))))
    return out


def test_discounts():
    # On a line the factors are those of the numbers themselves.
    n = [0, *[10**9 * r**-2.5 for r in range(1, LARGE + 2)]]
    cut = (LARGE + 1) * n[LARGE + 1] / n[1]
    want = [((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut) for r in range(1, LARGE + 1)]
    assert np.allclose(discounts(n[1:])[1:], want)
    for irregular in ([5, 0, 0, 0, 0, 0], [0] * 6, [10, 500, 3, 0, 80, 1], [1, 1, 1, 1, 1, 1], [100, 400, 300, 500, 20, 900]):
        d = discounts(irregular)[1:]
        assert (d > 0).all() and (d < 1).all() and (np.diff(d) > 0).all()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_counts_of_the_shared_tables(spark, sf):
    """There copies make the plain factors leave (0, 1]; the smoothed ones are in it for every length, and near the plain ones where those are."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    for n in (1, 2, 3):
        seen = Counter()
        for r in docs:
            if not katz.held_out(r.doc_id):
                w = ["BEGIN"] * (n - 1) + [*(r.text or "").encode().lower().split(), "END"]
                seen.update(zip(*[w[i:] for i in range(n)]))
        found = [sum(c == r for c in seen.values()) for r in range(1, LARGE + 2)]
        d = discounts(found)[1:]
        assert (d > 0).all() and (d < 1).all() and d[-1] > d[0]


@pytest.mark.parametrize(("words", "order"), [(1_000_000, 3), (700, 3), (300, 4), (700, 2)])
def test_against_brute_force(spark, monkeypatch, words, order):
    monkeypatch.setattr(katz, "KEYS", 500)
    monkeypatch.setattr(katz, "WORDS", words)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("score", F.lit(1))
    got, want = map(tuple, scored(docs, order).collect()), plain(rows, order)
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])) and abs(g[6] - w[6]) < 1e-6 * max(1, abs(w[6]))


def test_equal_hashes(monkeypatch):
    monkeypatch.setattr(katz, "mix", lambda x: x * np.uint64(0))
    sent = [katz.named([np.array(c) for c in columns]) for columns in (([1, 1, 4], [7, 8, 7]), ([1, 4], [8, 9]))]
    number = katz.same(sent)
    assert number[1] == number[3] and len(set(number)) == 4


@pytest.mark.parametrize("most", [50, 2**62])
def test_distinct(most):
    keys = np.random.default_rng(3).integers(0, most, 1000)[np.random.default_rng(4).integers(0, 1000, 3000)]
    for got, want in zip(katz.distinct(keys), np.unique(keys, return_index=True, return_inverse=True), strict=True):
        assert (got == want).all()
    assert [len(x) for x in katz.distinct(keys[:0])] == [0, 0, 0]


def test_empty(spark):
    assert scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = scored(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].n_tokens == 1 and math.isfinite(one[0].score)
