import random
from itertools import islice

import numpy as np
import pyarrow as pa
import pytest

from postrider.llm import chunks as module
from postrider.llm.chunks import chunks


def plain_chunks(rows, lower, words):
    out, total = [[]], 0
    for i, text in rows:
        raw = (text or "").encode()
        out[-1].append((i, (raw.lower() if lower else raw).split()))
        total += len(out[-1][-1][1])
        if total >= words:
            out.append([])
            total = 0
    return [c for c in out if c]


def as_lists(chunk):
    at = np.cumsum(chunk.sizes).tolist()
    named = [chunk.named[w] for w in chunk.words]
    return [(row[0], named[a:b]) for row, a, b in zip(chunk.rows, [0, *at], at)]


@pytest.mark.parametrize("words", [1, 7, 60, 10**6])
@pytest.mark.parametrize("lower", [True, False])
def test_chunks_against_plain_ones(lower, words, monkeypatch):
    monkeypatch.setattr(module, "SLICE", 13)
    r = random.Random(3)
    signs = [chr(c) for c in range(128)] + list("ÄßİK\x85\xa0 ") + ["ab", "Ab", " ", " ", "\n"]
    rows = [(None, None), (1, ""), (2, " \t"), (3, " a "), *[(i, "".join(r.choices(signs, k=r.randrange(60)))) for i in range(4, 90)], (90, None)]
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(("doc_id", "text"), x)) for x in rows[a : a + 40]], schema) for a in range(0, len(rows), 40)]
    got = list(chunks(iter(batches), lower, words))
    assert [as_lists(c) for c in got] == plain_chunks(rows, lower, words)
    for c in got:
        assert len(set(c.named)) == len(c.named)
        assert list(dict.fromkeys(c.words.tolist())) == list(range(len(c.named)))


def test_texts_are_split_without_a_step_for_each_word(monkeypatch):
    """Words are numbered by Arrow: no Python call for each new word."""
    asked = []
    monkeypatch.setattr(module.Numbers, "__missing__", lambda self, word: asked.append(word) or self.setdefault(word, len(self)))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b c a"]})
    (c,) = islice(chunks(iter([batch]), True), 2)
    assert (c.named, c.words.tolist(), asked) == ([b"a", b"b", b"c"], [0, 1, 2, 0], [])
