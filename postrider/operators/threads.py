"""Conversation threading: deliveries, reply edges, components, identities and comparisons of runs.

Everything is joins and aggregations; only sizes of single messages are held in
a row. Where a rule is in doubt it splits rather than merges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components

#: References that count, characters of an id, days of the subject rule.
MOST_REFERENCES, MOST_CHARS, SUBJECT_DAYS = 256, 998, 14
NAMESPACE = "postrider-thread-v1"


def checked(messages: DataFrame) -> DataFrame:
    """Raises for a blank account or id; repeated ids are left to :func:`repeated_ids`."""
    blank = (F.trim(F.coalesce("account", F.lit(""))) == "") | (F.trim(F.coalesce("id", F.lit(""))) == "")
    return messages.withColumn("id", F.when(blank, F.raise_error(F.lit("a message needs an account and an id"))).otherwise(F.col("id")))


def repeated_ids(messages: DataFrame) -> DataFrame:
    return messages.groupBy("account", "id").count().filter("count > 1")


def selected_references(references: Column, in_reply_to: Column, own: Column) -> Column:
    """The last references without the message itself; where there are none, the first In-Reply-To."""
    refs = F.filter(F.coalesce(references, F.array().cast("array<string>")), lambda x: (x != own) & (F.length(x) <= MOST_CHARS))
    refs = F.slice(refs, F.greatest(F.lit(1), F.size(refs) - (MOST_REFERENCES - 1)), F.lit(MOST_REFERENCES))
    reply = F.filter(F.coalesce(in_reply_to, F.array().cast("array<string>")), lambda x: x != own)
    return F.when(F.size(refs) > 0, refs).otherwise(F.slice(reply, 1, 1))


def deliveries(messages: DataFrame) -> DataFrame:
    """(account, id, delivery): copies of one delivery share a Message-ID and a fingerprint.

    A Message-ID under which different fingerprints occur parts them: a reused
    id is no proof of a copy. Without a Message-ID the fingerprint decides,
    without both the row stands alone.
    """
    key = F.when(F.col("rfc_id").isNotNull() & F.col("fingerprint").isNotNull(), F.concat_ws("\0", F.lit("m"), "rfc_id", "fingerprint")).when(F.col("fingerprint").isNotNull(), F.concat_ws("\0", F.lit("f"), "fingerprint")).otherwise(F.concat_ws("\0", F.lit("r"), "id"))
    return messages.select("account", "id", F.sha2(F.concat_ws("\0", "account", key), 256).alias("delivery"))


def representatives(messages: DataFrame) -> DataFrame:
    """One row for each delivery: the earliest, then the smallest id."""
    w = Window.partitionBy("account", "delivery").orderBy("date", "id")
    return messages.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def edges(messages: DataFrame) -> DataFrame:
    """(account, src, dst) between Message-IDs along each chain of references up to the message."""
    chain = F.concat("refs", F.array("rfc_id"))
    pairs = F.zip_with(F.slice(chain, F.lit(1), F.greatest(F.size(chain) - 1, F.lit(0))), F.slice(chain, F.lit(2), F.greatest(F.size(chain) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    return messages.select("account", F.inline(pairs)).distinct()


def subject_edges(messages: DataFrame, alone: DataFrame) -> DataFrame:
    """Replies without references to the one root of their subject.

    Both stand alone, the root came at most two weeks before, the senders wrote
    to each other, neither is automatic, and there is exactly one such root.

    Roots open at their date and close two weeks later; a sweep over the dates of
    a subject and a pair of people counts those that are open when a reply
    comes, and keeps the exclusive or of their hashes, which names the root if
    it is one. So no pairs of replies and roots are made. Time is cut into
    spans of two weeks, so that a common subject is many groups.
    """
    a = messages.join(alone, ["account", "rfc_id"], "left_semi").filter(~F.col("automated") & F.col("date").isNotNull())
    length = SUBJECT_DAYS * 86_400 * 1_000_000
    at = F.unix_micros(F.col("date").cast("timestamp"))
    reply, root = a.filter("is_reply"), a.filter("not is_reply")
    keys = ["account", "base_subject", "one", "other"]
    people = F.explode(F.array_distinct(F.array_compact("recipients")))
    own = root.select("account", "base_subject", F.col("sender").alias("one"), people.alias("other"), "rfc_id", at.alias("at")).distinct()
    own = own.withColumn("hash", F.xxhash64("rfc_id", "at"))
    spans = F.explode(F.array(F.floor(F.col("at") / length), F.floor(F.col("at") / length) + 1))
    begins = own.withColumn("span", spans).withColumn("start", F.greatest("at", F.col("span") * length))
    event = lambda when, kind, n, rfc: F.struct(F.col(when).alias("when") if isinstance(when, str) else when.alias("when"), F.lit(kind).alias("kind"), F.lit(n).alias("n"), rfc.alias("dst"))
    none = F.lit(None).cast("string")
    both = begins.select(*keys, "span", "hash", F.explode(F.array(event("start", 0, 1, none), event(F.col("at") + length, 2, -1, none))).alias("e"))
    asked = reply.select("account", "base_subject", people.alias("one"), F.col("sender").alias("other"), F.floor(at / length).alias("span"), F.lit(0).cast("long").alias("hash"), event(at, 1, 0, F.col("rfc_id")).alias("e"))
    # What closes in a later span need not close in this one.
    events = both.filter("e.kind < 2 OR e.when < (span + 1) * %d" % length).union(asked).select(*keys, "span", "hash", "e.*")
    sweep = Window.partitionBy(*keys, "span").orderBy("when", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = events.select(*keys, "kind", "dst", "when", F.sum("n").over(sweep).alias("n"), F.bit_xor("hash").over(sweep).alias("hash")).filter("kind = 1 AND n > 0")
    # A reply to several people may find roots of each of them; a message id on several rows asks several times.
    one_root = met.groupBy("account", "base_subject", "dst", "when").agg(F.sum("n").alias("n"), F.max("hash").alias("hash")).filter("n = 1")
    named = own.select("account", "base_subject", "hash", F.col("rfc_id").alias("src")).distinct()
    found = one_root.join(named, ["account", "base_subject", "hash"])
    return found.groupBy("account", "dst").agg(F.count("*").alias("n"), F.min("src").alias("src")).filter("n = 1").select("account", "src", "dst")


def conversation_id(account: Column, anchor: Column) -> Column:
    return F.concat(F.lit("thread_"), F.substring(F.sha2(F.concat_ws("\0", F.lit(NAMESPACE), account, anchor), 256), 1, 32))


def assigned(messages: DataFrame, provider: bool = True, subjects: bool = True) -> DataFrame:
    """(account, id, delivery, conversation_id, method, confidence) for each message.

    ``messages`` has account, id, rfc_id, fingerprint, refs (selected
    references), provider_thread, date, sender, recipients, base_subject,
    is_reply and automated. Placeholders of ids that were never seen keep
    replies to a lost message together. The anchor, and so the conversation's
    id, is the smallest known root: it does not depend on the order of rows.
    """
    m = messages.withColumn("rfc_id", F.coalesce("rfc_id", F.concat(F.lit("row:"), "id")))
    m = m.join(deliveries(messages), ["account", "id"])
    node = lambda c: F.concat_ws("\0", "account", c)
    links = edges(m).select(node("src").alias("src"), node("dst").alias("dst"))
    known = m.select("account", "rfc_id").distinct()
    if provider:
        p = m.filter(F.col("provider_thread").isNotNull()).groupBy("account", "provider_thread").agg(F.min("rfc_id").alias("first"))
        same = m.join(p, ["account", "provider_thread"]).select(node("first").alias("src"), node("rfc_id").alias("dst"))
        links = links.union(same)
    used = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    if subjects:
        alone = known.withColumn("node", node("rfc_id")).join(used, "node", "left_anti").select("account", "rfc_id")
        extra = subject_edges(m, alone)
        links = links.union(extra.select(node("src"), node("dst")))
        weak = extra.select("account", F.col("dst").alias("rfc_id")).union(extra.select("account", "src")).distinct().withColumn("weak", F.lit(True))
        m = m.join(weak, ["account", "rfc_id"], "left")
    else:
        m = m.withColumn("weak", F.lit(None).cast("boolean"))
    parts = components(links.filter("src <> dst"))
    m = m.withColumn("node", node("rfc_id")).join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    out = m.withColumn("conversation_id", conversation_id(F.col("account"), F.col("component")))
    method = F.when(F.size("refs") > 0, "references").when(F.col("weak"), "subject_fallback").when(F.col("provider_thread").isNotNull() & F.lit(provider), "provider_thread").otherwise("standalone")
    out = out.withColumn("method", method)
    level = F.when(F.col("method") == "subject_fallback", "low").when(F.col("method") == "provider_thread", "medium").otherwise("high")
    return out.select("account", "id", "delivery", "conversation_id", "method", level.alias("confidence"))


def closure(seeds: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Messages that seeds reach over shared (kind, key) rows, by components of the bipartite graph."""
    e = edge_rows.select(F.concat(F.lit("m:"), "id").alias("src"), F.concat_ws(":", F.lit("k"), "kind", "key").alias("dst"))
    parts = components(e)
    mine = parts.join(seeds.select(F.concat(F.lit("m:"), "id").alias("node")), "node").select("component").distinct()
    return parts.join(mine, "component", "left_semi").filter(F.startswith("node", F.lit("m:"))).select(F.substring("node", 3, 1_000_000).alias("id"))


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row of counts on how two runs (id, conversation_id) differ: changed, only in one, splits, merges."""
    j = old.select("id", F.col("conversation_id").alias("o")).join(new.select("id", F.col("conversation_id").alias("n")), "id", "outer")
    base = j.agg(F.count_if(F.col("o").isNull()).alias("only_new"), F.count_if(F.col("n").isNull()).alias("only_old"), F.count_if(F.col("o") != F.col("n")).alias("changed"))
    split = j.dropna().groupBy("o").agg(F.countDistinct("n").alias("k")).agg(F.count_if(F.col("k") > 1).alias("splits"))
    merge = j.dropna().groupBy("n").agg(F.countDistinct("o").alias("k")).agg(F.count_if(F.col("k") > 1).alias("merges"))
    return base.crossJoin(split).crossJoin(merge)  # one row each
