"""Searches by index find what scans find."""

import random

import pytest
from pyspark.sql import functions as F

from postrider.operators import postings as p
from postrider.operators import ranking as r
from postrider.operators import spelling as s


def brute(term, words):
    """The best extent, over all of them."""
    q, parts = set(s.parts_of([term])), s.parts_of(words)
    best = 0.0
    for i in range(len(parts)):
        for j in range(i + 1, len(parts) + 1):
            d = set(parts[i:j])
            best = max(best, len(q & d) / len(q | d))
    return best


def test_word_similarity():
    x = random.Random(1)
    for _ in range(400):
        term = "".join(x.choice("abc") for _ in range(x.randint(1, 6)))
        words = ["".join(x.choice("abc") for _ in range(x.randint(1, 6))) for _ in range(x.randint(0, 5))]
        assert s.word_similarity(set(s.parts_of([term])), s.parts_of(words)) == pytest.approx(brute(term, words))
    assert s.word_similarity(set(s.parts_of(["word"])), s.parts_of(["two", "words"])) == pytest.approx(0.8)


def test_spelling(spark, tmp_path):
    x = random.Random(2)
    vocabulary = ["invoice", "invoices", "invioce", "meeting", "meting", "Märchen", "marchen", "plan", "plain", "x", "report"]
    rows = [(i, f, " ".join(x.choice(vocabulary) for _ in range(x.randint(0, 4)))) for i in range(120) for f in ("subject", "sender")] + [(500, "subject", None)]
    index = s.SpellingIndex(spark, str(tmp_path / "i"))
    index.build(spark.createDataFrame(rows, "id long, field string, text string"))
    terms = ("invoice", "meeting", "maerchen", "zzzz")
    for least in (0.4, 0.7):
        got = {(a.id, a.field, a.term): a.near for a in index.search(terms, least).collect()}
        fold = str.maketrans(r.ACCENTED, r.FOLDED)
        want = {(i, f, t): n for i, f, text in rows for t in terms if (n := brute(t, (text or "").translate(fold).lower().split())) >= least}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    probed = s.rarest({"  i": 90, " in": 80, "inv": 3}, set(s.parts_of(["invoice"])), 0.4)
    assert len(probed) == 5 and "  i" not in probed


def messages(spark, n=300):
    x = random.Random(3)
    words = ["the", "of", "and", "plan", "über", "a", "x"] + [f"w{i}" for i in range(60)]
    text = lambda k: " ".join(x.choices(words, [30, 20, 10, 3, 2, 9, 5] + [1] * 60, k=x.randint(0, k)))
    return spark.createDataFrame([(i, text(6), text(80)) for i in range(n)] + [(9000, None, "the the the the plan"), (9001, "", None)], "id long, head string, body string")


@pytest.mark.parametrize("block", [512, 20])
def test_postings_are_the_scan(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(p, "BLOCK", block)
    m = messages(spark).cache()
    index = p.TextIndex(spark, str(tmp_path / "i"))
    index.build(m, F.col("head"), F.col("body"))
    scan = r.once(m, hw=r.tokens(F.col("head")), bw=r.tokens(F.col("body")))
    wide = r.Terms((("plan", "uber"),))
    for terms in (r.Terms((("the",),)), r.Terms((("the", "of"), ("plan",)), ("w3",)), r.Terms((("of the",), ("and", "x"))), r.Terms((("the the",),)), r.Terms((("nothing",),))):
        barred = F.lit(False)
        for w in terms.without:
            barred = barred | F.array_contains("hw", w) | F.array_contains("bw", w)
        one = scan.filter(~barred).select("id", r.rank(F.col("hw"), terms).alias("h"), r.rank(F.col("bw"), terms).alias("b"), r.rank(F.col("hw"), wide).alias("wh"), r.rank(F.col("bw"), wide).alias("wb"))
        want = {a.id: tuple(round(v, 9) for v in a[1:]) for a in one.filter("h > 0 OR b > 0 OR wh > 0 OR wb > 0").collect()}
        got = {a.id: tuple(round(v, 9) for v in (a.head, a.body, a.wide_head, a.wide_body)) for a in index.ranks(terms, wide).collect()}
        assert got == want
        ordered = sorted(((round(0.6 * a.h + 0.2 * a.b, 9), a.id) for a in one.collect() if a.h > 0 or a.b > 0), reverse=True)[:7]
        assert [(a.text_rel, a.id) for a in index.best(terms, 7).collect()] == ordered


def test_only_the_words_folders_are_read(spark, tmp_path):
    index = p.TextIndex(spark, str(tmp_path / "i"))
    index.build(messages(spark, 60), F.col("head"), F.col("body"))
    plan = index._postings(r.Terms((("plan",),)))._jdf.queryExecution().executedPlan().toString()
    # One folder by its number; the word itself is pushed down as well.
    assert "PartitionFilters: [isnotnull(bucket" in plan and plan.count("(bucket#") >= 1 and "EqualTo(word,plan)" in plan


def test_postings_are_not_shuffled(spark, tmp_path, monkeypatch):
    """What is shuffled to build the index are the messages' words as texts, by block; the postings go straight to their folders."""
    plans = []
    monkeypatch.setattr(p, "dealt", lambda df, path, *by: plans.append((df, by)))
    p.TextIndex(spark, str(tmp_path / "i")).build(messages(spark, 60), F.col("head"), F.col("body"))
    ((blocks, by),) = plans
    assert by == ("word",)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(block") == 1 and plan.count("Exchange") == 1 and "Aggregate" not in plan
