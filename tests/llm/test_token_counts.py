import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postrider.llm.token_counts import PrefixCounter, PrefixCounts, token_counts, truncated

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LETTERS = "aabbeetthhnn''srtl  \n\t!?.12é漢ß　\x85²ⅷ़"


def of_library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def texts(n, seed):
    r = random.Random(seed)
    for _ in range(n):
        t = "".join(r.choice(LETTERS) for _ in range(r.randint(0, 25)))
        yield t + "<|endoftext|>" + t[:5] if r.random() < 0.2 else t


def test_every_prefix_against_the_library():
    counter = PrefixCounter(open(PATH, "rb").read())
    for t in texts(400, 1):
        p = PrefixCounts(counter, t)
        assert [p.at(i) for i in range(len(t) + 1)] == [of_library(t[:i]) for i in range(len(t) + 1)]


def test_documents(spark):
    rows = [(i, t) for i, t in enumerate(texts(300, 2))] + [(None, None), (1, "word " * 40_000), (7, "x" * 3000), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit(1))
    got = token_counts(docs, PATH, limit=10).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, len((t or "").encode()), of_library(t or ""), of_library(t or "") > 10) for i, t in rows), key=str)
    assert token_counts(docs.limit(0), PATH).count() == 0
    for r in truncated(docs, PATH, 5).collect():
        assert r.kept_tokens <= 5 and of_library(r.kept_text) == r.kept_tokens
        assert r.n_tokens > 5 or r.kept_tokens == r.n_tokens
