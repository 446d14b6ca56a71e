import random

import numpy as np
from pyspark.sql import functions as F

from postrider.llm.quality import accepted, features, fit, fit_ratings, graded


def corpus(n, seed):
    r = random.Random(seed)
    syllables = ["ka", "mo", "ri", "te", "lu", "so", "ne", "pa", "di", "gu"]
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 6))) for _ in range(100_000)]
    rows = []
    for i in range(n):
        grade = i % 3
        w = [r.choice(words) for _ in range(r.choice([20, 200, 1500]))]
        if grade == 0:
            for bad in ("Nasty", "vile", "nasty,"):
                w.insert(r.randrange(len(w)), bad)
        if grade == 1:
            w = [x + "%%%" for x in w]
        rows.append((i, " ".join(w), grade))
    return rows


def test_gradient():
    """A step along the slope lowers the loss; thresholds end in order."""
    rows = [features(t, 12) for _, t, _ in corpus(90, 1)]
    m = fit(rows, np.array([i % 3 for i in range(90)]), bits=12)
    assert m.thresholds[0] < m.thresholds[1]
    assert fit([], np.array([], int)).tails(np.zeros(2)).shape == (2, 0)


def test_held_out(spark):
    rows = corpus(900, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (-1, "")], "doc_id long, text string").withColumn("tail", F.lit("x"))
    rated = spark.createDataFrame([(i, g) for i, _, g in rows if i < 600] + [(None, 1), (5, None)], "doc_id long, grade int")
    model = fit_ratings(docs, rated, per_grade=250)
    got = {r.doc_id: r for r in graded(docs, model).collect()}
    assert len(got) == 902
    kept = {r.doc_id for r in accepted(docs, model).collect()}
    held = [(i, g) for i, _, g in rows if i >= 600]
    assert all(0 <= got[i].tail <= 1 and 0 <= got[i].expected_grade <= 2 for i in got)
    assert np.mean([(i in kept) == (g == 2) for i, g in held]) > 0.97
    means = [np.mean([got[i].expected_grade for i, g in held if g == k]) for k in range(3)]
    assert means == sorted(means)
    assert accepted(docs, model).columns == docs.columns
    assert graded(docs.limit(0), model).count() == 0


def plain_grades(text, model):
    """Expected grade and tail of one text, feature by feature and threshold by threshold."""
    import math
    import zlib

    mask = (1 << model.bits) - 1
    words = (text or "").encode().lower().split()
    found = set()
    for w in words:
        for kind, part in ((b"w", w), (b"4", w[:4]), (b"5", w[:5]), (b"s", w[-3:])):
            found.add(zlib.crc32(kind + part) & mask)
    raw = (text or "").encode()
    letters = sum(len(w) for w in words) or 1
    upper = sum(65 <= b <= 90 for b in raw) + (1 if not raw else 0)
    marks = sum(b in b"!#$%&*+/<=>@[]^_{|}~" for b in raw) + (1 if not raw else 0)
    for i, s in enumerate((len(set(words)) / max(len(words), 1), upper / letters, marks / letters, min(len(words), 90) / 100)):
        found.add(zlib.crc32(b"shape%d:%d" % (i, int(10 * s))) & mask)
    z = sum(float(model.weights[f]) for f in found)
    above = [1 / (1 + math.exp(t - z)) for t in model.thresholds]
    return sum(above), above[-1]


def test_against_brute_force(spark):
    """Grades of all rows equal those of a plain loop; of an id's grades the lowest counts, so a fit can be repeated."""
    rows = [(i, t) for i, t, _ in corpus(120, 4)] + [(None, None), (7, ""), (-1, "A%B !! Ä")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rated = spark.createDataFrame([(i, i % 3) for i in range(100)] + [(i, 2) for i in range(0, 100, 7)], "doc_id long, grade int")
    a, b = fit_ratings(docs, rated, per_grade=30), fit_ratings(docs.repartition(5), rated.repartition(3), per_grade=30)
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()
    got = sorted(((r.doc_id, round(r.expected_grade, 6), round(r.tail, 6)) for r in graded(docs, a).collect()), key=str)
    want = sorted(((i, *(round(x, 6) for x in plain_grades(t, a))) for i, t in rows), key=str)
    assert got == want
