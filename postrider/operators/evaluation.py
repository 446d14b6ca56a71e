"""Retrieval and clustering measures as aggregations over result and judgment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def measures(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """For each query: precision, recall, reciprocal rank, ndcg and success at ``k``.

    ``ranked`` has (query, id, rank from 1), ``judged`` (query, id, grade above
    0). Precision divides by k even if fewer were returned; the ideal order is
    that of all judgments. Queries without judgments have null recall and ndcg.
    """
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    j = ranked.filter(F.col("rank") <= k).join(judged, ["query", "id"], "left").withColumn("hit", F.col("grade").isNotNull().cast("int"))
    got = j.groupBy("query").agg(
        F.sum("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("hit") == 1, gain / F.log2(F.col("rank") + 1))).alias("dcg"),
    )
    best = judged.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "id")))
    ideal = best.groupBy("query").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("place") <= k, gain / F.log2(F.col("place") + 1))).alias("ideal"))
    m = ranked.select("query").union(judged.select("query")).distinct().join(got, "query", "left").join(ideal, "query", "left").na.fill(0, ["hits"])
    return m.select(
        "query", (F.col("hits") / k).alias("precision"), (F.col("hits") / F.col("relevant")).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"), (F.col("hits") > 0).cast("int").alias("success"), F.coalesce("dcg", F.lit(0.0)).alias("dcg"),
    )


def means(per_query: DataFrame, *by: str) -> DataFrame:
    names = ("precision", "recall", "rr", "ndcg", "success")
    return per_query.groupBy(*by).agg(*[F.round(F.avg(n), 6).alias(n) for n in names])


def pair_scores(clustered: DataFrame) -> DataFrame:
    """Pairwise agreement of two clusterings (id, truth, found), from the sizes of their classes and overlaps.

    No pair is made: a class of n rows has n (n - 1) / 2 of them.
    """
    pairs = lambda *c: clustered.groupBy(*c).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("p"))
    both, truth, found = pairs("truth", "found").toDF("tp"), pairs("truth").toDF("t"), pairs("found").toDF("f")
    s = both.crossJoin(truth).crossJoin(found)  # one row each
    s = s.withColumn("precision", F.when(F.col("f") == 0, 1.0).otherwise(F.col("tp") / F.col("f"))).withColumn("recall", F.when(F.col("t") == 0, 1.0).otherwise(F.col("tp") / F.col("t")))
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return s.select(F.col("tp").cast("long").alias("tp"), (F.col("f") - F.col("tp")).cast("long").alias("fp"), (F.col("t") - F.col("tp")).cast("long").alias("fn"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def resampled(pairs: DataFrame, rounds: int = 10_000, seed: int = 0x5EED) -> DataFrame:
    """For each category of (category, query, baseline, candidate): mean difference, two-sided p by random signs, and a 95 % interval.

    The signs and draws come from a seeded hash of (round, query) in plain
    columns, so all rounds are one distributed aggregation.
    """
    d = pairs.withColumn("diff", F.col("candidate") - F.col("baseline"))
    order = Window.partitionBy("category").orderBy("query")
    d = d.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("category")))
    r = d.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    sign = F.when(F.xxhash64(F.lit(seed), "round", "query") % 2 == 0, 1.0).otherwise(-1.0)
    flips = r.groupBy("category", "round").agg((F.sum(F.col("diff") * sign) / F.count("*")).alias("mean"))
    seen = d.groupBy("category").agg(F.avg("diff").alias("observed"), F.max(F.abs("diff")).alias("largest"))
    p = flips.join(seen, "category").groupBy("category").agg(F.first("observed").alias("observed"), F.when(F.first("largest") == 0, 1.0).otherwise((F.count_if(F.abs("mean") >= F.abs("observed") - 1e-12) + 1) / (F.count("*") + 1)).alias("p"))
    draw = r.select("category", "round", F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "round", "i"), F.col("n")).alias("i"))
    boot = draw.join(d.select("category", "i", "diff"), ["category", "i"]).groupBy("category", "round").agg(F.avg("diff").alias("mean"))
    ci = boot.groupBy("category").agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    sure = (F.col("p") < 0.05) & ((F.col("low") > 0) | (F.col("high") < 0))
    return p.join(ci, "category").withColumn("verdict", F.when(sure & (F.col("observed") > 0), "improvement").when(sure, "regression").otherwise("no difference"))
