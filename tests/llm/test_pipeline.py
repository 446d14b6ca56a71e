import hashlib
import random

import public_tokenizers
import sentencepiece

import corpus_pipeline
from test_quality import corpus
from test_similar import plain_kept


def test_stages(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, t, 2 if g == 2 else g) for i, t, g in corpus(450, 5)]
    good = [(i, t) for i, t, g in rows if g == 2 and len(t.split()) > 100][:40]
    copies = [(1000 + i, t.replace(" ", "\n", 1)) for i, t in good[:15]]
    near = []
    for i, t in good[15:30]:
        w = t.split()
        w[r.randrange(len(w))] = "kamori"
        near.append((2000 + i, " ".join(w)))
    docs = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in [(i, t) for i, t, _ in rows] + copies + near]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(g != 1), int(g == 0)) for i, _, g in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        before, d = d, spark.read.parquet(f"{tmp_path}/out{k}")
        kept[name] = d
        if k < 4:
            assert d.columns == before.columns, name
    q, e, n, m, s = (kept[name].collect() for name, _ in corpus_pipeline.STAGES)
    grade = {i: g for i, _, g in rows}
    assert not any(grade.get(x.doc_id) == 0 for x in q)
    assert sum(grade.get(x.doc_id) == 2 for x in q) > 0.97 * sum(g == 2 for g in grade.values())
    first = {}
    for x in q:
        t = " ".join(x.text.split())
        first[t] = min(first.get(t, x.doc_id), x.doc_id)
    assert sorted(x.doc_id for x in e) == sorted(first.values())
    assert sorted(x.doc_id for x in n) == plain_kept([(x.doc_id, x.text) for x in e]) and len(n) < len(e)
    size = {x.doc_id: len(x.text.split()) for x in n}
    taken = dict.fromkeys(size, 0)
    for x in m:
        taken[x.doc_id] += len(x.text.split())
    assert all(taken[i] <= 2 * size[i] for i in size)
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < 10
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((x.doc_id, len(i := sp.encode(x.text) + [2]), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest()) for x in m)
    assert sorted((x.doc_id, x.n_tokens, x.ids_sha256) for x in s) == want


def test_entry_without_llm():
    """Where the corpus operators cannot be imported, the entry module names all other queries."""
    import subprocess
    import sys
    from pathlib import Path

    hide = "import sys; sys.modules['postrider.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    said = subprocess.run([sys.executable, "-c", hide], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True).stdout.split()
    import __spark_entry__ as entry

    corpus_queries = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert said == [str(len(entry.queries()) - len(corpus_queries)), "0"] and len(corpus_queries) == 14
