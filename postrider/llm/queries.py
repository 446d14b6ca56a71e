"""The corpus operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .divergence import source_divergence
from .exact_dedup import exact_duplicates
from .fingerprints import compared_with_next
from .katz import scored
from .line_dedup import without_repeated_lines
from .mixing import mixed
from .nearest import nearest
from .quality import fit_ratings, graded
from .simhash import near_duplicates
from .sentencepieces import digests
from .substring_dedup import without_repeated_passages
from .token_counts import token_counts


#: Documents stay if the probability of the top grade, learned from as many rows of each grade, is as large.
LEAST_TAIL = 0.25


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=3, radius=3).select("doc_id", "fingerprint", "component_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeated_lines(_table(spark, sf_dir, "documents"), least_chars=20, least_docs=3)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.last AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mixed(_table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=512)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of the labelled documents: 0 toxic, 1 poor, 2 good."""
    labels = _table(spark, sf_dir, "labels")
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = graded(docs, fit_ratings(docs, ratings(spark, sf_dir)))
    return scored.withColumn("kept", F.col("tail") >= LEAST_TAIL)


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeated_passages(_table(spark, sf_dir, "documents"), least_words=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
a AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM d),
k AS (SELECT doc_id, pos, word, string_agg(word, ' ') OVER w AS key, count(*) OVER w AS n FROM a
      WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE n = 13 GROUP BY key),
s AS (SELECT k.*, coalesce(f.first < k.doc_id AND k.n = 13, false) AS again FROM k LEFT JOIN f USING (key)),
c AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM s),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
             string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"), least_docs=3, top=200)


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (
  SELECT lang, source, coalesce(n, 0)::HUGEINT AS n, coalesce(v, 0)::HUGEINT AS v
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN v USING (lang)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + v) AS p
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (cn + 1) // (gn + v) AS q
  FROM (SELECT lang, term, sum(n) AS cn FROM c GROUP BY ALL) JOIN (SELECT lang, sum(n) AS gn, max(v) AS v FROM g GROUP BY lang) USING (lang)),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"), least=100, most_words=5, top=2000)


OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS row,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
x AS (SELECT lang, row, unnest(parts) AS piece, unnest(range(len(parts))) AS part
      FROM (SELECT lang, row, string_split_regex(text, '[.,;:!?\x0A-\x0D]') AS parts FROM d)),
w AS (SELECT lang, row, part, unnest(ws) AS word, unnest(range(len(ws))) AS pos
      FROM (SELECT lang, row, part, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM x)),
g AS (SELECT lang, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4, lead(word, 4) OVER o AS w5
      FROM w WINDOW o AS (PARTITION BY lang, row, part ORDER BY pos)),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
f AS (SELECT lang, ws, count(*) AS a FROM (
        SELECT lang, [w1] AS ws FROM g UNION ALL SELECT lang, [w1, w2] FROM g WHERE w2 IS NOT NULL
        UNION ALL SELECT lang, [w1, w2, w3] FROM g WHERE w3 IS NOT NULL UNION ALL SELECT lang, [w1, w2, w3, w4] FROM g WHERE w4 IS NOT NULL
        UNION ALL SELECT lang, [w1, w2, w3, w4, w5] FROM g WHERE w5 IS NOT NULL) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, ws, a, unnest(range(1, len(ws))) AS k FROM f WHERE len(ws) > 1),
s AS (SELECT c.lang, c.ws, c.a, c.k, l.a AS l, r.a AS r, n, 1000::HUGEINT * c.a * n // (l.a::HUGEINT * r.a) AS score
      FROM c JOIN f l ON l.lang = c.lang AND l.ws = c.ws[1:k] JOIN f r ON r.lang = c.lang AND r.ws = c.ws[k + 1:] JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
y AS (SELECT lang, ws, a, unnest(range(2, len(ws))) AS size FROM f WHERE len(ws) > 2),
z AS (SELECT lang, ws[start:start + size - 1] AS ws, max(a) AS longer
      FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS start FROM y) GROUP BY ALL),
o AS (SELECT b.*, array_to_string(b.ws, ' ') AS phrase FROM b LEFT JOIN z ON z.lang = b.lang AND z.ws = b.ws WHERE longer IS NULL OR longer < b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM o QUALIFY rank <= 2000
"""


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_next(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the top of the repository; it imports this module

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_exact_dedup, op3_nearest, op4_sentencepiece, op5_line_dedup, op6_mixing, op7_token_counts, op8_quality, op9_katz, op10_substring_dedup, op11_source_divergence, op12_collocations, op13_fingerprints, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op5_line_dedup": OP5_SQL, "op10_substring_dedup": OP10_SQL, "op11_source_divergence": OP11_SQL, "op12_collocations": OP12_SQL}
