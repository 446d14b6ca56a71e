"""Conversations from stored copies: deliveries, the reply graph between them, its components, and their names.

Rows are copies as in ``identity``, with provider_thread. All steps are joins
and aggregations over the rows given, so that the rows of some components give
the same answers as all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage
from .graph import components
from .identity import anchors, deliveries_v2, merged, nodes
from .threads import conversation_id


def reply_graph(merged_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((account, delivery, node), (account, parent, child)): each delivery's own node, and the steps of its chain of references up to it."""
    own, refs = nodes(merged_rows)
    placed = merged_rows.select("account", "delivery", F.posexplode("refs").alias("pos", "token")).join(refs.distinct(), ["account", "delivery", "token"])
    chain = placed.select("account", "delivery", "pos", "node").union(own.select("account", "delivery", F.lit(1_000_000), "node"))
    before = F.lag("node").over(Window.partitionBy("account", "delivery").orderBy("pos"))  # a header's references
    steps = chain.withColumn("parent", before).filter("parent IS NOT NULL AND parent <> node")
    return own, steps.select("account", "parent", F.col("node").alias("child")).distinct()


def conversations(copies: DataFrame) -> DataFrame:
    """(account, id, delivery, conversation_id, provisional) of each copy.

    Deliveries that a chain of references or a provider's thread connects are
    one conversation. It is named by :func:`.identity.anchors`; a root is a node
    that answers nothing. A conversation that lacks a referenced message is
    provisional: its name may change once that arrives.
    """
    of = stage(deliveries_v2(copies).select("account", "id", "delivery"))
    rows = copies.join(of, ["account", "id"])
    own, steps = map(stage, reply_graph(stage(merged(rows).select("account", "delivery", "refs", "message_id"))))
    key = lambda c: F.concat_ws("\0", "account", c)
    # Deliveries of one thread meet at a node of the thread's own.
    threads = rows.filter("provider_thread IS NOT NULL").select("account", "delivery", "provider_thread").distinct()
    hub = F.concat_ws("\0", F.lit("thread"), "account", "provider_thread")
    links = steps.select(key("parent").alias("src"), key("child").alias("dst"))
    links = links.union(threads.join(own, ["account", "delivery"]).select(hub.alias("src"), key("node").alias("dst")))
    parts = stage(components(links))
    placed = own.withColumn("at", key("node")).join(parts.withColumnRenamed("node", "at"), "at", "left").withColumn("component", F.coalesce("component", "at"))
    ends = steps.select("account", F.col("parent").alias("node")).union(steps.select("account", "child")).union(own.select("account", "node")).distinct()
    answers = steps.select("account", F.col("child").alias("node"), F.lit(False).alias("is_root")).distinct()
    graph = ends.join(answers, ["account", "node"], "left").withColumn("at", key("node")).join(parts.withColumnRenamed("node", "at"), "at", "left")
    kind, rest = F.substring_index("node", ":", 1), F.regexp_replace("node", "^[a-z]+:", "")
    graph = graph.select(
        F.coalesce("component", "at").alias("component"), F.col("node").alias("key"), F.when(kind.isin("reference", "missing"), rest).alias("reference"),
        F.coalesce("is_root", F.lit(True)).alias("is_root"), (kind == "ambiguous").alias("ambiguous"), (kind == "missing").alias("placeholder"),
    )
    several = threads.groupBy("account", "provider_thread").agg(F.count("*").alias("n")).filter("n > 1").select("account", "provider_thread")
    members = placed.join(threads.join(several, ["account", "provider_thread"]), ["account", "delivery"], "left")
    members = members.select("component", F.col("delivery").cast("string").alias("delivery"), "provider_thread", F.lit(False).alias("fallback_root"))
    named = anchors(graph, members)
    out = placed.select("account", "delivery", "component").join(named, "component")
    out = out.select("account", "delivery", conversation_id(F.col("account"), F.col("anchor")).alias("conversation_id"), "provisional")
    return of.join(out, ["account", "delivery"]).select("account", "id", "delivery", "conversation_id", "provisional")


def evidence(copies: DataFrame) -> DataFrame:
    """(id, key): what a copy shares with all copies that can change its delivery or conversation: Message-IDs that it has or refers to, and its provider's thread."""
    ids = F.array_distinct(F.array_compact(F.concat(F.array("message_id"), F.coalesce("refs", F.array().cast("array<string>")))))
    keys = F.concat(F.transform(ids, lambda x: F.concat_ws("\0", F.lit("message"), F.col("account"), x)), F.array_compact(F.array(F.when(F.col("provider_thread").isNotNull(), F.concat_ws("\0", F.lit("thread"), "account", "provider_thread")))))
    return copies.select("id", F.explode(keys).alias("key"))
