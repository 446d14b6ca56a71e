import random
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from postrider.llm import simhash
from postrider.llm.simhash import PivotTable, fingerprint, key_bands, near_duplicates, near_links, without_near_duplicates


def plain_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, prints):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            root[find(j)] = find(i)
    out = {}
    for i, (d, _) in enumerate(rows):
        out.setdefault(find(i), []).append(d)
    least = {r: min((d for d in ids if d is not None), default=None) for r, ids in out.items()}
    return [least[find(i)] for i in range(len(rows))]


def corpus():
    r = random.Random(3)
    words = [f"w{i}É" for i in range(300)] + ["AbC", "x,"]
    rows = [(None, None), (4, ""), (2, "  \n"), (9, "one"), (8, "One TWO"), (None, "solo text here now")]
    for i in range(10, 60):
        base = [r.choice(words) for _ in range(r.choice([4, 80, 400]))]
        rows.append((i, " ".join(base)))
        for j in range(r.randint(0, 4)):
            w = base[:]
            w[r.randrange(len(w))] = "changed"
            rows.append((i * 100 + j, "\n".join(w) if j % 2 else " ".join(base)))
    return rows


def test_documents(spark):
    rows = corpus()
    prints = [plain_fingerprint(t) for _, t in rows]
    assert prints == [fingerprint(t) for _, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component", F.lit(1))
    got = near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    want = [(d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, plain_components(rows, prints), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(d) for d, _, c in want if d is None or d == c)
    assert near_duplicates(docs.limit(0)).count() == 0


def classes(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        root[find(a)] = find(b)
    out = {}
    for n in nodes:
        out.setdefault(find(n), set()).add(n)
    return sorted(map(sorted, out.values()))


def test_links_of_a_large_group(spark, monkeypatch):
    """Hundreds of fingerprints around one: through all rounds of longer keys and in tiles, the same components as by brute force."""
    monkeypatch.setattr(simhash, "TILE", 40)
    r = np.random.default_rng(5)
    x = np.full(900, 0x123456789ABCDEF0, np.uint64)
    for _ in range(5):
        x ^= np.uint64(1) << r.integers(0, 64, 900).astype(np.uint64)
    x = np.unique(np.concatenate([x, r.integers(0, 2**64, 300, dtype=np.uint64)])).view(np.int64).tolist()
    links = [(e.src, e.dst) for e in near_links(spark.createDataFrame([(v,) for v in x], "fp long"), 3).collect()]
    near = [(a, b) for a, b in combinations(x, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    assert classes(x, links) == classes(x, near)
    assert all(a != b for a, b in links) and len(links) < 20 * len(x)


def test_keys():
    """Fingerprints within the radius share a key, whatever the bands; keys grow with the number of fingerprints."""
    r = np.random.default_rng(6)
    x = r.integers(0, 2**64, 200, dtype=np.uint64)
    for bands in (5, 6, 8, 12):
        p = PivotTable(3, bands)
        y = x.copy()
        for _ in range(3):
            y ^= np.uint64(1) << r.integers(0, 64, len(y)).astype(np.uint64)
        assert (p.keys(x) == p.keys(y)).any(axis=1).all()
    assert [key_bands(n, 3) for n in (0, 50_000, 250_000, 10**7, 10**10, 10**14)] == [5, 5, 6, 6, 9, 12]
