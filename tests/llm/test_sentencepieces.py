import hashlib
import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

from postrider.llm import sentencepieces
from postrider.llm.sentencepieces import MergeEncoder, digests, encoded, encoded_batches

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
LETTERS = "aabbeetthhnnsrtlioc     \n\n\t▁.,é漢ß　\x00ⅷ़-1<>s/"


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_like_the_library():
    e = MergeEncoder(open(PATH, "rb").read())
    sample = texts(3000, 5) + ["", " ", "  ", "\n", " \n ", "aaaaaaaaaaaaaaa" * 50, "<s>x</s>", "<0x41>"]
    ids, decoded = e.batch(sample)
    for t, i, d in zip(sample, ids, decoded, strict=True):
        want = LIBRARY.encode(t) + [2]
        got = memoryview(i).cast("i").tolist()
        assert got == want, t
        assert d == LIBRARY.decode(want) == e.decode(got)


def test_documents(spark):
    rows = list(enumerate(texts(200, 6))) + [(None, None), (3, "word " * 30_000), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "") + [2]
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids))))
    assert sorted(map(tuple, digests(docs, PATH).collect()), key=str) == sorted(want, key=str)
    assert encoded(docs.limit(0), PATH).count() == 0


def test_remembers_up_to_its_bound(monkeypatch):
    """Of a text with very many distinct words only what fits is remembered; the rest is right all the same."""
    monkeypatch.setattr(sentencepieces, "REMEMBERED", 300_000)
    e = MergeEncoder(open(PATH, "rb").read())
    r = random.Random(7)
    for _ in range(3):
        t = " ".join("".join(r.choices("abehtins漢\x00", k=6)) for _ in range(5000)) + " ⅷ <s>"
        (ids,), (decoded,) = e.batch([t])
        want = LIBRARY.encode(t) + [2]
        assert memoryview(ids).cast("i").tolist() == want and decoded == LIBRARY.decode(want)
    assert 0 < sum(sentencepieces.ENTRY + 2 * len(c) + len(i) for c, i in e.known.items()) < 310_000
    assert e.odd.keys() <= e.known.keys()


def test_memory_of_a_batch():
    """The chunks of a batch of many texts are not in memory all at once."""
    e = MergeEncoder(open(PATH, "rb").read())
    text = "the mail of a week " * 100
    b = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([text] * 2000)], ["doc_id", "text"])
    want = LIBRARY.encode(text) + [2]
    tracemalloc.start()
    try:
        rows = 0
        for x in encoded_batches(e, iter([b])):
            assert x.column(1)[0].as_py() == want
            rows += x.num_rows
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 2000 and most < 20e6, most
