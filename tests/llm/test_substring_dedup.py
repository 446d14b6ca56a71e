import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from postrider.llm import chunks, substring_dedup
from postrider.llm.substring_dedup import without_repeated_passages


def words_of(t):
    return (t or "").encode().split()


def plain(rows, k=13):
    last = 2**63 - 1
    first = {}
    for i, t in rows:
        w = words_of(t)
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            first[key] = min(first.get(key, last), last if i is None else i)
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for a in range(len(w) - k + 1):
            if first[tuple(w[a : a + k])] < (last if i is None else i):
                gone.update(range(a, a + k))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(8)
    word = lambda: r.choice(["a", "b", "Ä", "the"]) + str(r.randrange(40))
    passages = [[word() for _ in range(n)] for n in (12, 13, 14, 60, 200)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(r.randint(0, 5)):
            w += [word() for _ in range(r.randint(0, 40))] + (r.choice(passages) if r.random() < 0.6 else [])
        rows.append((r.choice([i, i, 1000 - i]), (" ", "\n")[i % 2].join(w)))
    return rows + [(None, None), (None, " ".join(passages[3])), (3, ""), (5, "x " * 500), (6, "x " * 700), (7, " ".join(passages[4])), (7, " ".join(passages[4]))]


def test_packing():
    x = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    a, b = chunks.unpack(chunks.pack(chunks.deltas(x), np.arange(3, dtype=np.uint16)))
    assert (np.cumsum(a, dtype=np.uint64) == x).all() and b.tolist() == [0, 1, 2]
    assert [len(v) for v in chunks.unpack(chunks.pack(x[:0]))] == [0]


def test_documents(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("group", F.lit(1))
    want = plain(rows)
    assert sorted(map(tuple, without_repeated_passages(docs).collect()), key=str) == want
    monkeypatch.setattr(substring_dedup, "GROUP", 300)  # prefixes of several words
    assert sorted(map(tuple, without_repeated_passages(docs).collect()), key=str) == want
    assert without_repeated_passages(docs.limit(0)).count() == 0


def test_one_entry_for_a_suffix_of_a_chunk():
    """A passage in 500 documents of a chunk is one entry for each of its windows, not one for each document."""
    t = pa.RecordBatch.from_arrays([pa.array(range(7, 507)), pa.array([False] * 500), pa.array([" ".join(f"w{i}" for i in range(14))] * 500)], ["id", "missing", "text"])
    (c,) = chunks.chunks(iter([t]), lower=False)
    w = substring_dedup.Windows(substring_dedup.read_back(substring_dedup.written(c)), 13, 40, 1)
    assert len(w.where) == 1000 and len(w.known) == 2
    starts, _, least, most, place = w.suffixes(np.arange(1000), substring_dedup.Prefixes())
    named, *columns = w.packed(starts)
    words = np.array(named.tobytes().decode().split("\n"))
    assert sorted(map(tuple, words[np.stack(columns, axis=1)].tolist())) == [tuple(f"w{i}" for i in range(a, a + 13)) for a in (0, 1)]
    assert least.tolist() == [7, 7] and most.tolist() == [506, 506] and np.bincount(place).tolist() == [500, 500]


def test_deep_nodes():
    """Leaves that share the least number of words hang under one node; the tree is that of all shared prefixes."""
    r = np.random.default_rng(3)
    s = r.integers(0, 2, (200, 6)).astype(np.int32)
    for least in (3, 6):
        order, node = substring_dedup.deep_nodes(s, least)
        found = {}
        for k, n in zip(order.tolist(), node.tolist(), strict=True):
            found.setdefault(n, set()).add(tuple(s[k, :least].tolist()))
        assert all(len(v) == 1 for v in found.values()) and len(found) == len(np.unique(s[:, :least], axis=0))


def test_collisions_and_spans(spark, monkeypatch):
    """With two bits of hash nearly all windows collide, and nothing changes, as words are compared; spans are what was removed."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(substring_dedup, "LEAST_BITS", 2)
    monkeypatch.setattr(substring_dedup, "SPARE", -60)
    got = substring_dedup.passages(docs).collect()
    assert sorted([tuple(x)[:4] for x in got], key=str) == plain(rows)
    assert all(sum(p.n_words for p in x.spans) == x.n_removed and all(p.first_id < (2**63 - 1 if x.doc_id is None else x.doc_id) for p in x.spans) for x in got)



def test_several_chunks(spark, monkeypatch):
    """Chunks of a few documents find their own rows by the answers."""
    monkeypatch.setattr(substring_dedup, "WORDS", 300)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    named, answers, *_ = substring_dedup.repeated_passages(docs)
    n = named.select("chunk").distinct().count()
    assert n > 3 and answers.count() >= 1
    assert sorted(map(tuple, without_repeated_passages(docs).collect()), key=str) == plain(rows)


def test_neighbours_are_sent_as_runs():
    """Windows of one passage go to few groups, with far fewer words than all windows have; equal windows go to the same group from any chunk."""
    r = random.Random(4)
    passage = [f"w{r.randrange(10_000)}" for _ in range(3000)]
    prefixes = substring_dedup.Prefixes()
    prefixes.groups, found = 50, []
    for rows in ([" ".join(passage)], ["other words before " + " ".join(passage[:2000]), "y " * 20 + " ".join(passage[1500:])]):
        t = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array([False] * len(rows)), pa.array(rows)], ["id", "missing", "text"])
        (c,) = chunks.chunks(iter([t]), lower=False)
        w = substring_dedup.Windows(c, 13, 40)
        starts, group, *_ = w.suffixes(np.arange(len(w.where)), prefixes)
        sent, of = 0, {}
        for g, x, y in substring_dedup.runs_of(group):
            n, named, words = w.in_runs(starts[x:y])
            sent += len(words)
            known = named.tobytes().decode().split("\n")
            for s in substring_dedup.from_runs(n, words, 13).tolist():
                of[tuple(known[k] for k in s)] = g
        assert sent < 4.5 * len(starts)
        found.append(of)
    windows = {tuple(passage[a : a + 13]) for a in range(len(passage) - 12)}
    assert found[0].keys() == windows and windows <= found[1].keys() and all(found[1][k] == found[0][k] for k in windows)


def test_groups_parted_by_every_step(spark, monkeypatch):
    """A gram that all windows share is parted by the words before and after it."""
    monkeypatch.setattr(substring_dedup, "GROUP", 4)
    monkeypatch.setattr(substring_dedup, "WORDS", 60)
    r = random.Random(6)
    rows = [(i, " ".join(r.choice("ab") for _ in range(40))) for i in range(8)] + [(20, "a " * 30), (21, "a " * 30 + "b " * 14)]
    rows += [(30 + i, rows[i][1]) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, without_repeated_passages(docs).collect()), key=str) == plain(rows)
