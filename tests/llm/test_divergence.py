import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from postrider.llm import divergence
from postrider.llm.divergence import scaled, source_divergence


def plain(rows, top=200):
    """The contract, term by term, in Python's whole numbers."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low))
        counts[lang, source] += found
        docs[lang].update(found.keys())
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]
        p = {}
        for s in [*sources, None]:
            c = {t: counts[lang, s][t] if s is not None else sum(counts[lang, x][t] for x in sources) for t in kept}
            n = sum(c.values())
            p[s] = {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_scaled_is_exact():
    r = random.Random(1)
    for _ in range(300):
        d = r.randint(1, 9 * 10**15)
        c = r.randint(0, d)
        assert scaled(np.array([c]), d)[0] == c * 10**9 // d


def test_sources(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 12)
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "SLICE", 300)
    r = random.Random(2)
    words = ["The", "the", "a", "naïve", "Éa", "éa", "x1y", "don't", "zz", "Ω", "b\0c", "q~r"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(r.choice(["en", "fr"]), r.choice(["s1", "s2", "s3", "é"]), " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for _ in range(120)]
    rows += [("en", "s1", "the " * 5000), ("en", "bare", "123"), (None, None, None), ("", "", "x x"), (None, "s", "x"), ("de", "only", "ja nein")]
    rows += [("en", "s1", "hot hot common")] * 60  # one group has a third of the rows
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit(1) for c in ("term", "n", "docs", "found", "v", "shard", "value", "part")})
    assert rows_of(source_divergence(docs)) == plain(rows)
    assert rows_of(source_divergence(docs, top=2)) == plain(rows, 2)


def test_no_rows_and_no_terms(spark):
    docs = spark.createDataFrame([("en", "a", "x"), ("en", "b", None)], "lang string, source string, text string")
    assert rows_of(source_divergence(docs.limit(0))) == []
    assert rows_of(source_divergence(docs)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
