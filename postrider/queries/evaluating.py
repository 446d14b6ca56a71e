"""Evaluation of rankings and clusterings, on documents with labels as judgments."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as e
from ..sources.tables import messages, read
from . import Group

group = Group()
add = group.add

RANKED = """j AS (SELECT source AS query, d.doc_id AS id, quality + 1 AS grade FROM documents d JOIN labels USING (doc_id) WHERE toxic = 0),
r AS (SELECT source AS query, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
h AS (SELECT r.query, r.id, r.rank, grade FROM r LEFT JOIN j USING (query, id) WHERE rank <= 10),
g AS (SELECT query, count(grade) AS hits, min(rank) FILTER (WHERE grade IS NOT NULL) AS first, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM h GROUP BY query),
p AS (SELECT query, grade, row_number() OVER (PARTITION BY query ORDER BY grade DESC, id) AS place FROM j),
i AS (SELECT query, count(*) AS relevant, sum((pow(2, grade) - 1) / log2(place + 1)) FILTER (WHERE place <= 10) AS ideal FROM p GROUP BY query),
s AS (SELECT query, hits / 10 AS precision, hits / relevant AS recall, coalesce(1 / first, 0) AS rr, coalesce(dcg, 0) / ideal AS ndcg, (hits > 0)::INT AS success, coalesce(dcg, 0) AS dcg FROM g LEFT JOIN i USING (query))"""


def tables(spark, d):
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    judged = docs.join(labels.filter("toxic = 0"), "doc_id").select(F.col("source").alias("query"), F.col("doc_id").alias("id"), (F.col("quality") + 1).alias("grade"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return docs.select(F.col("source").alias("query"), F.col("doc_id").alias("id"), rank.alias("rank")), judged


def measure(name, column):
    @add(name, f"WITH {RANKED} SELECT query, round({column}, 6)::DOUBLE AS value FROM s")
    def _(spark, d):
        return e.measures(*tables(spark, d)).select("query", F.round(F.col(column).cast("double"), 6).alias("value"))


for _name, _column in (("ev_precision", "precision"), ("ev_recall", "recall"), ("ev_rr", "rr"), ("ev_ndcg", "ndcg"), ("ev_dcg", "dcg"), ("ev_success", "success")):
    measure(_name, _column)


@add("agg_mean_vec", f"WITH {RANKED} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg, round(avg(success), 6) AS success FROM s")
def agg_mean_vec(spark, d):
    return e.means(e.measures(*tables(spark, d)))


@add("ev_category", f"WITH {RANKED} SELECT length(query) AS category, round(avg(ndcg), 6) AS ndcg, count(*) FILTER (WHERE ndcg >= 0.95) AS saturated FROM s GROUP BY 1")
def ev_category(spark, d):
    m = e.measures(*tables(spark, d)).withColumn("category", F.length("query").cast("long"))
    return m.groupBy("category").agg(F.round(F.avg("ndcg"), 6).alias("ndcg"), F.count_if(F.col("ndcg") >= 0.95).alias("saturated"))


@add("ev_diversity", f"WITH {RANKED}, x AS (SELECT h.query, coalesce(CASE WHEN id % 6 = 0 THEN 'p' || (id % 90) END, md5(text)) AS conversation FROM h JOIN documents ON doc_id = id) SELECT query, round(count(DISTINCT conversation)::DOUBLE / count(*), 6) AS diversity FROM x GROUP BY query")
def ev_diversity(spark, d):
    """Distinct conversations in the first ten results: provider threads, or else copies of one text."""
    ranked, _ = tables(spark, d)
    m = messages(spark, d).select("id", F.coalesce("provider_thread", F.md5("body")).alias("conversation"))
    return ranked.filter("rank <= 10").join(m, "id").groupBy("query").agg(F.round(F.countDistinct("conversation") / F.count("*"), 6).alias("diversity"))


@add("ev_guard", f"WITH {RANKED} SELECT query, id FROM h WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def ev_guard(spark, d):
    """Results that are not among the allowed ones."""
    ranked, _ = tables(spark, d)
    allowed = read(spark, d, "labels").filter("toxic = 0").select(F.col("doc_id").alias("id"))
    return ranked.filter("rank <= 10").join(allowed, "id", "left_anti").select("query", "id")


@add("ev_pairwise", """WITH c AS (SELECT doc_id, md5(text) AS truth, n_chars || lang AS found FROM documents),
s AS (SELECT (SELECT coalesce(sum(n * (n - 1) // 2), 0) FROM (SELECT count(*) AS n FROM c GROUP BY truth, found)) AS tp, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM c GROUP BY truth)) AS t, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM c GROUP BY found)) AS f)
SELECT tp::BIGINT AS tp, (f - tp)::BIGINT AS fp, (t - tp)::BIGINT AS fn, round(tp / f, 6) AS precision, round(tp / t, 6) AS recall, round(2 * (tp / f) * (tp / t) / (tp / f + tp / t), 6) AS f1 FROM s""")
def ev_pairwise(spark, d):
    c = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("truth"), F.concat(F.col("n_chars").cast("string"), "lang").alias("found"))
    return e.pair_scores(c)


@add("ev_false_merge", "WITH p AS (SELECT doc_id AS a, doc_id + 1 AS b FROM documents WHERE doc_id % 2 = 0) SELECT count(*)::BIGINT AS merged FROM p JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b WHERE x.source = y.source")
def ev_false_merge(spark, d):
    """Forbidden pairs that ended up in one class."""
    docs = read(spark, d, "documents").select("doc_id", "source")
    x = docs.filter("doc_id % 2 = 0").select(F.col("source").alias("sa"), (F.col("doc_id") + 1).alias("doc_id"))
    return x.join(docs, "doc_id").filter("sa = source").agg(F.count("*").alias("merged"))


@add("ev_compare")
def ev_compare(spark, d):
    """Paired significance of two rankings by language length; seeded, but random draws have no SQL twin."""
    a = e.measures(*tables(spark, d)).select("query", F.col("ndcg").alias("baseline"))
    pairs = a.withColumn("candidate", F.least(F.lit(1.0), F.col("baseline") + 0.1)).withColumn("category", F.length("query").cast("string")).na.drop()
    return e.resampled(pairs, rounds=2000)
