from pathlib import Path

from pyspark.sql import functions as F

from postrider.plans.staging import joins_by_shuffle, stage


def test_a_staged_table_leaves_no_shuffle_files(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    folders = [Path(d.getPath()) for d in env.blockManager().diskBlockManager().localDirs()]

    def files():
        return {f.name for d in folders for f in d.rglob("shuffle_*")}

    before = files()
    out = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not files() - before
    assert sorted((r.k, r["count"]) for r in out.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]


def test_settings_are_put_back(spark):
    names = ["spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.autoBroadcastJoinThreshold"]
    before = [spark.conf.get(n, None) for n in names]
    with joins_by_shuffle(spark):
        assert spark.conf.get(names[1]) == "-1"
    stage(spark.range(3))
    assert [spark.conf.get(n, None) for n in names] == before
