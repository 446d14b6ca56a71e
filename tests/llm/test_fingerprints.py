import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from postrider.llm import fingerprints as module
from postrider.llm.fingerprints import SAMPLES, Sampler, compared_with_next, edited, fingerprints, likeness, spelled


def test_quantiles():
    x = module.gamma_quantiles(1 << 12)
    assert (np.diff(x) > 0).all() and np.allclose(1 - (1 + x) * np.exp(-x), (np.arange(1 << 12) + 0.5) / (1 << 12), atol=1e-9)


def jaccard(a, b):
    x, y = (Counter(t.lower().split()) for t in (a, b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_likeness_is_the_generalised_jaccard_similarity():
    r = random.Random(4)
    sampler, off, bias = Sampler(), [], []
    for n in range(1500):  # with words of their own, as errors of shared words add up
        a = r.choices([f"w{n}.{i}" for i in range(60)], [1 / (i + 1) for i in range(60)], k=r.randint(1, 200))
        b = [w for w in a if r.random() < 0.7] + r.choices([f"w{n}.{i}" for i in range(90)], k=r.randint(0, 100))
        a, b = " ".join(a), " ".join(b)
        want, got = jaccard(a, b), likeness(sampler.signature(a), sampler.signature(b))
        bias.append(got - want)
        off.append(abs(got - want) / max(0.02, (want * (1 - want) / SAMPLES) ** 0.5))
    assert max(off) < 5 and abs(np.mean(bias)) < 0.004


def test_samples_depend_on_the_counts_alone(monkeypatch):
    r = random.Random(5)
    words = [f"Word{i}" for i in range(300)] * 2 + ["the"] * 50
    want = Sampler().signature(" ".join(words))
    monkeypatch.setattr(module, "KNOWN", 64)
    monkeypatch.setattr(module, "AT_ONCE", 32)
    small = Sampler()
    for _ in range(3):
        r.shuffle(words)
        assert (small.signature("\t".join(words).upper()) == want).all()
    assert (Sampler().signature(" \n") == 0).all() and (want != 0).all()


def plain(rows):
    """Next documents by a sort of all rows."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    sampler = Sampler()
    out = []
    for at, i in enumerate(order):
        text, following = rows[i][1] or "", rows[order[(at + 1) % len(order)]][1] or ""
        new = edited(text, following)
        a, b, c = (sampler.signature(x) for x in (text, new, following))
        out.append((rows[i][0], len(text), hashlib.sha256(new.encode()).hexdigest(), spelled(a), spelled(b), likeness(a, b), likeness(a, c)))
    return sorted(out, key=str)


def test_edited():
    assert [edited(a, b) for a, b in (("abcd", "xyz"), ("abcde", "x"), ("a", "x"), ("", "x"), ("éö", ""))] == ["abxy", "abcx", "a", "", "é"]


def test_documents(spark):
    r = random.Random(6)
    words = ["The", "the", "naïve", "É", "of"] + [f"w{i}" for i in range(40)]
    rows = [(r.randint(-(10**12), 10**12), " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for _ in range(300)]
    rows += [(2**63 - 1, "last"), (-(2**63) + 1, None), (None, "no id"), (5, ""), (6, "  "), (7, "long words " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("range", "id", "tie", "guest", "host", "copies")})
    got = compared_with_next(docs.repartition(5))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
    prints = {x.doc_id: x.fingerprint for x in fingerprints(docs).collect()}
    assert prints == {x.doc_id: x.fingerprint for x in got.collect()}


def test_few_rows_and_repeated_ids(spark):
    for rows in ([], [(1, "a b")], [(1, "a b c d"), (2, "e f g h")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, compared_with_next(docs).collect()), key=str) == plain(rows)
    # A third of the rows has one id; equal rows follow each other.
    rows = [(3, "same text of this id")] * 40 + [(3, f"other {i}") for i in range(10)] + [(i, f"text number {i}") for i in range(10, 80)]
    got = compared_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(x.doc_id for x in got) == Counter(i for i, _ in rows)
    sampler = Sampler()
    same = [x for x in got if x.fingerprint == spelled(sampler.signature("same text of this id"))]
    assert len(same) == 40 and sum(x.near_next == 1.0 for x in same) == 39
