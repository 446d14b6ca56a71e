import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postrider.llm import collocations as module
from postrider.llm.collocations import collocations, tile_counts


def plain(rows, least, most=5, top=2000):
    """The contract, phrase by phrase, in Python's whole numbers."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(zip(*[w[i:] for i in range(k)]))
    out = []
    for lang, found in f.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= candidates[p[i:j]]}
        scored = []
        for p, a in candidates.items():
            if p not in gone:
                score, _, left, right = min((1000 * a * n[lang] // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        scored.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(scored[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_tiles(monkeypatch):
    r = np.random.default_rng(1)
    for side, dense in ((2, 3), (3, 8), (9, 1 << 14)):
        monkeypatch.setattr(module, "SIDE_BITS", side)
        monkeypatch.setattr(module, "DENSE", dense)
        monkeypatch.setattr(module, "LOW", 4)
        a, b = (r.geometric(0.05, 5000) - 1), (r.geometric(0.1, 5000) - 1)
        codes, n = tile_counts(a, b)
        assert dict(zip(codes.tolist(), n.tolist(), strict=True)) == Counter(((a << 30) | b).tolist())
    assert [len(x) for x in tile_counts(a[:0], b[:0])] == [0, 0]


@pytest.mark.parametrize("small", [400_000, 32, 0])
def test_phrases(spark, monkeypatch, small):
    """All ranks are sent to the tasks, or those of the words only, or none."""
    monkeypatch.setattr(module, "SMALL", small)
    monkeypatch.setattr(module, "WORDS", 300)
    monkeypatch.setattr(module, "SIDE_BITS", 2)
    monkeypatch.setattr(module, "DENSE", 3)
    r = random.Random(3)
    fixed = ["New York city hall", "of the the the the", "as well as", "naïve Éa", "one two three four five six"]
    words = ["a", "B", "the", "of", "york", "é", "x\x1fy", "\x1c"]

    def text():
        parts = []
        for _ in range(r.randint(0, 30)):
            parts.append(r.choice(fixed) if r.random() < 0.4 else r.choice(words))
        return "".join(p + r.choice([" ", "  ", "\t", ". ", ",", "\n", " ", " "]) for p in parts)

    rows = [(r.choice(["en", "en", "fr", None, ""]), text()) for _ in range(200)]
    rows += [("en", None), ("en", ""), ("fr", "hot pair " * 3000), ("de", "rare words"), ("fr", "..;")]
    rows += [("en", "same text of copies")] * 70
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(1) for c in ("chunk", "n", "code", "rank", "word", "phrase", "a", "l", "r", "score")})
    for least, top in ((20, 2000), (7, 10)):
        assert rows_of(collocations(docs, least=least, top=top)) == plain(rows, least, top=top)
    assert rows_of(collocations(docs, least=12, most_words=3)) == plain(rows, 12, 3)


def test_no_rows_and_no_phrases(spark):
    docs = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    assert collocations(docs.limit(0)).count() == 0
    assert collocations(docs).count() == 0
