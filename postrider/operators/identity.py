"""Which stored copies are one delivery, which node of the reply graph it is, and what names a conversation.

Rows are physical copies: account, id, folder, provider_key, message_id,
raw_hash, parsed, authored (digests), metadata (digest), date, refs. In doubt a
rule splits. All rules are joins and aggregations, so a message id that very
many rows reuse is no group of one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components

#: Replies of one subject that are still compared; days a retired run stays.
MOST_OF_SUBJECT, STANDBY_DAYS = 5000, 30


def tagged(kind: str, c: Column | str) -> Column:
    """``kind:value``, null where the value is null or blank."""
    value = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(value != "", F.concat(F.lit(f"{kind}:"), value))


def copy_fingerprint() -> Column:
    """The raw digest, or else the parsed one."""
    return F.coalesce(tagged("raw", "raw_hash"), tagged("parsed", "parsed"))


def copy_fingerprints() -> Column:
    return F.array_distinct(F.array_compact(F.array(copy_fingerprint(), tagged("parsed", "parsed"), tagged("authored", "authored"))))


def base_key() -> Column:
    """Provider id, Message-ID, fingerprint or the row: the first that there is."""
    return F.coalesce(tagged("provider", "provider_key"), tagged("message-id", "message_id"), F.concat(F.lit("fingerprint:"), copy_fingerprint()), F.concat(F.lit("row:"), F.col("id").cast("string")))


def deliveries_v1(copies: DataFrame) -> DataFrame:
    """(account, id, delivery): a Message-ID that rows of different fingerprints carry is parted by fingerprint, and by row without one."""
    c = copies.select("account", "id", base_key().alias("base"), F.coalesce(copy_fingerprint(), F.concat(F.lit("physical:"), F.col("id").cast("string"))).alias("variant"))
    of = c.groupBy("account", "base").agg((F.min("variant") != F.max("variant")).alias("several"))
    parted = F.startswith("base", F.lit("message-id:")) & F.col("several")
    return c.join(of, ["account", "base"]).select("account", "id", F.when(parted, F.concat_ws("|", "base", "variant")).otherwise(F.col("base")).alias("delivery"))


def _linked(rows: DataFrame, key: Column) -> DataFrame:
    """(id, root): ids that rows (id, key columns) connect over equal keys, with the smallest of them."""
    pairs = rows.select(F.concat(F.lit("m:"), F.col("id").cast("string")).alias("src"), F.concat(F.lit("k:"), key).alias("dst"))
    parts = components(pairs)
    members = parts.filter(F.startswith("node", F.lit("m:"))).select(F.substring("node", 3, 64).cast("long").alias("id"), "component")
    return members.join(members.groupBy("component").agg(F.min("id").alias("root")), "component").select("id", "root")


def deliveries_v2(copies: DataFrame) -> DataFrame:
    """(account, id, delivery): rows of one Message-ID that share any fingerprint, directly or over others; delivery is the smallest id."""
    f = copies.filter("message_id IS NOT NULL").select("account", "message_id", "id", F.explode(copy_fingerprints()).alias("f"))
    root = _linked(f, F.concat_ws("|", "account", "message_id", "f"))
    return copies.select("account", "id").join(root, "id", "left").select("account", "id", F.coalesce("root", "id").alias("delivery"))


def deliveries_v3(copies: DataFrame) -> DataFrame:
    """(account, id, delivery, conflict): as v2, but different authored digests are never one delivery.

    Rows that share a fingerprint join within one authored digest, or where all
    lack one. What lacks one then joins the only authored digest that it shares
    a fingerprint with; with several it is in conflict. Equal metadata joins
    what is left if no two authored digests and no conflict are among it and no
    folder occurs twice: copies of one delivery lie in different folders.
    """
    c = copies.filter("message_id IS NOT NULL").select("account", "message_id", "id", F.trim("folder").alias("folder"), "metadata", tagged("authored", "authored").alias("a"), copy_fingerprints().alias("fs"))
    f = c.select("account", "message_id", "id", "a", F.explode("fs").alias("f"))
    root = _linked(f, F.concat_ws("|", "account", "message_id", "f", F.coalesce("a", F.lit(""))))
    c = c.join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    f = f.join(root, "id").select("account", "message_id", "f", "a", "root").distinct()
    known = f.filter("a IS NOT NULL").select("account", "message_id", "f", F.col("a").alias("near"), F.col("root").alias("near_root"))
    open_ = f.filter("a IS NULL").join(known, ["account", "message_id", "f"]).groupBy("root").agg(F.min("near").alias("lo"), F.max("near").alias("hi"), F.min("near_root").alias("near_root"))
    c = c.join(open_, "root", "left").withColumn("conflict", F.col("lo").isNotNull() & (F.col("lo") != F.col("hi")))
    c = c.withColumn("part", F.when(F.col("lo") == F.col("hi"), F.col("near_root")).otherwise(F.col("root"))).select("account", "message_id", "id", "folder", "metadata", "a", "conflict", "part")
    c = c.drop("conflict", "a").join(c.groupBy("part").agg(F.max("a").alias("a"), F.bool_or("conflict").alias("conflict")), "part")
    m = c.filter("metadata IS NOT NULL").select("account", "message_id", "metadata", "part", "a", "conflict").distinct()
    folders = m.select("account", "message_id", "metadata", "part").join(c.select("part", "folder").distinct(), "part")
    per = folders.groupBy("account", "message_id", "metadata").agg((F.count("folder") == F.countDistinct("folder")).alias("apart"), F.bool_or(F.coalesce("folder", F.lit("")) == "").alias("nowhere"))
    sums = m.groupBy("account", "message_id", "metadata").agg(F.countDistinct("a").alias("n_a"), F.bool_or("conflict").alias("any_conflict"))
    good = per.join(sums, ["account", "message_id", "metadata"]).filter("apart AND NOT nowhere AND NOT any_conflict")
    joined = m.join(good.select("account", "message_id", "metadata", "n_a"), ["account", "message_id", "metadata"])
    # Where two authored digests are among it, only parts of equal digest join.
    key = F.concat_ws("|", "account", "message_id", "metadata", F.when(F.col("n_a") > 1, F.coalesce("a", F.lit(""))).otherwise(F.lit("")))
    top = _linked(joined.withColumn("id", F.col("part")), key).withColumnRenamed("id", "part").withColumnRenamed("root", "top")
    c = c.join(top, "part", "left").withColumn("top", F.coalesce("top", "part"))
    least = c.groupBy("top").agg(F.min("id").alias("delivery"))
    c = c.join(least, "top").select("id", "delivery", "conflict")
    return copies.select("account", "id").join(c, "id", "left").select("account", "id", F.coalesce("delivery", "id").alias("delivery"), F.coalesce("conflict", F.lit(False)).alias("conflict"))


def merged(copies: DataFrame) -> DataFrame:
    """One row for each delivery: its best copy, the earliest date, and provider and Message-ID where all copies agree.

    The best copy has the strongest and longest references, then a Message-ID,
    then the smallest id. References are the best copy's, unless another copy's
    are not a suffix of them: then there are none.
    """
    quality = F.when(F.size("refs") > 0, 2000).otherwise(0) + F.size("refs") * 10 + F.col("message_id").isNotNull().cast("int")
    best = copies.groupBy("account", "delivery").agg(
        F.max_by(F.struct("id", "refs"), F.struct(quality, -F.col("id"))).alias("best"), F.min("date").alias("date"), F.count("*").alias("n_copies"),
        *[F.when(F.min(c) == F.max(c), F.min(c)).alias(c) for c in ("provider_key", "message_id")],
    )
    long = F.col("best.refs")
    suffix = F.slice(long, F.greatest(F.size(long) - F.size("refs") + 1, F.lit(1)), F.size("refs"))
    agree = copies.join(best.select("account", "delivery", "best"), ["account", "delivery"]).groupBy("account", "delivery").agg(F.bool_and(suffix == F.col("refs")).alias("agree"))
    out = best.join(agree, ["account", "delivery"])
    return out.select("account", "delivery", F.col("best.id").alias("id"), F.when(F.col("agree"), long).otherwise(F.array().cast("array<string>")).alias("refs"), "date", "n_copies", "provider_key", "message_id")


def nodes(deliveries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((account, delivery, node), (account, delivery, token, node)): where deliveries and their references lie in the graph.

    A Message-ID with one owner is a node that references reach. A reused one is
    nobody's: its deliveries stand for themselves, and a reference to it is a
    node of the delivery that makes it. A reference to nothing known is a
    placeholder that all such references share.
    """
    owners = deliveries.filter("message_id IS NOT NULL").groupBy("account", F.col("message_id").alias("token")).agg(F.count("*").alias("n"))
    own = deliveries.join(owners.withColumnRenamed("token", "message_id"), ["account", "message_id"], "left")
    own = own.select("account", "delivery", F.when(F.col("n") == 1, F.concat(F.lit("reference:"), "message_id")).otherwise(F.concat(F.lit("delivery:"), F.col("delivery").cast("string"))).alias("node"))
    refs = deliveries.select("account", "delivery", F.explode("refs").alias("token")).join(owners, ["account", "token"], "left")
    node = F.when(F.col("n") == 1, F.concat(F.lit("reference:"), "token")).when(F.col("n") > 1, F.concat_ws(":", F.lit("ambiguous"), "token", F.col("delivery").cast("string"))).otherwise(F.concat(F.lit("missing:"), "token"))
    return own, refs.select("account", "delivery", "token", node.alias("node"))


def anchors(graph: DataFrame, members: DataFrame) -> DataFrame:
    """(component, anchor, provisional): what names a conversation, by the first rule that gives one answer.

    ``graph`` has component, key, reference, is_root, ambiguous, placeholder for
    each node; ``members`` component, delivery, provider_thread (of a group of
    several), fallback_root. In order: the root found by subject, the only root
    reference, the only provider thread, the only ambiguous root, the smallest
    delivery.
    """
    root = F.col("is_root")
    g = graph.groupBy("component").agg(
        F.min(F.when(root, F.col("reference"))).alias("lo"), F.max(F.when(root, F.col("reference"))).alias("hi"),
        F.count_if(root & F.col("ambiguous")).alias("n_open"), F.min(F.when(root & F.col("ambiguous"), F.col("key"))).alias("open"), F.bool_or("placeholder").alias("lacking"),
    )
    m = members.groupBy("component").agg(
        F.min(F.when(F.col("fallback_root"), F.col("delivery"))).alias("fallback"), F.min("provider_thread").alias("plo"), F.max("provider_thread").alias("phi"), F.min("delivery").alias("first"),
    )
    one = (F.col("lo") == F.col("hi")) & (F.col("n_open") == 0)
    anchor = F.coalesce(
        F.concat(F.lit("delivery:"), "fallback"), F.when(one, F.concat(F.lit("reference:"), "lo")), F.when(F.col("plo") == F.col("phi"), F.concat(F.lit("provider:"), "plo")),
        F.when(F.col("n_open") == 1, F.concat(F.lit("ambiguity:"), F.sha2("open", 256))), F.concat(F.lit("delivery:"), "first"),
    )
    return m.join(g, "component", "left").select("component", anchor.alias("anchor"), (F.coalesce("lacking", F.lit(False)) | F.col("fallback").isNotNull()).alias("provisional"))


def reconciled(explicit: Column, parsed: Column, most: int = 998) -> Column:
    """Token list of two occurrences of a header: the longer one if the other is its suffix; else, or if too long, none."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(explicit, none), F.coalesce(parsed, none)
    long, short = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    fits = (F.size(short) == 0) | (F.slice(long, F.greatest(F.size(long) - F.size(short) + 1, F.lit(1)), F.size(short)) == short)
    small = F.length(F.array_join(a, "")) + F.length(F.array_join(b, "")) <= most
    return F.when(fits & small, long).otherwise(none)


def header_warning(explicit: Column, parsed: Column, most: int = 998) -> Column:
    none = F.array().cast("array<string>")
    a, b = F.coalesce(explicit, none), F.coalesce(parsed, none)
    large = F.length(F.array_join(a, "")) + F.length(F.array_join(b, "")) > most
    lost = (F.size(reconciled(explicit, parsed, most)) == 0) & (F.size(a) + F.size(b) > 0)
    return F.when(large, "oversized").when(lost, "conflict")


def bounded_subjects(messages: DataFrame, most: int = MOST_OF_SUBJECT) -> tuple[DataFrame, DataFrame]:
    """(rows of subjects that are worked on, (account, base_subject, n) of those that are too common to prove anything)."""
    n = messages.groupBy("account", "base_subject").agg(F.count("*").alias("n"))
    common = n.filter(F.col("n") > most)
    return messages.join(common, ["account", "base_subject"], "left_anti"), common


def changed_edges(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, kind, key, action): what turns the stored edge rows into the wanted ones; equal rows are not touched."""
    keys = ["id", "kind", "key"]
    gone = stored.select(*keys).distinct().join(wanted, keys, "left_anti").withColumn("action", F.lit("delete"))
    return gone.union(wanted.select(*keys).distinct().join(stored, keys, "left_anti").withColumn("action", F.lit("insert")))


def activation(runs: DataFrame) -> DataFrame:
    """(account, active, standby, refused) from runs (account, run, state, covered, revision, evidence, certified).

    The newest ready run becomes active if it covers all messages, is of the
    evidence's revision and is certified; the run active before goes on standby.
    """
    fit = (F.col("state") == "ready") & (F.col("covered") >= 1.0) & (F.col("revision") == F.col("evidence")) & F.col("certified")
    g = runs.groupBy("account").agg(F.max(F.when(fit, F.col("run"))).alias("next"), F.max(F.when(F.col("state") == "active", F.col("run"))).alias("now"), F.count_if((F.col("state") == "ready") & ~F.coalesce(fit, F.lit(False))).alias("refused"))
    moves = F.col("next").isNotNull()
    return g.select("account", F.coalesce("next", "now").alias("active"), F.when(moves, F.col("now")).alias("standby"), "refused")


def rolled_back(runs: DataFrame) -> DataFrame:
    """(account, run, state): the newest standby run is active again and the active one is retired; without a standby nothing moves."""
    w = Window.partitionBy("account")
    back = F.max(F.when(F.col("state") == "standby", F.col("run"))).over(w)
    state = F.when(back.isNull(), F.col("state")).when(F.col("run") == back, "active").when(F.col("state") == "active", "retired").otherwise(F.col("state"))
    return runs.select("account", "run", state.alias("state"))


def retained(runs: DataFrame, now: Column, days: int = STANDBY_DAYS) -> DataFrame:
    """(account, run, action): standby runs of ``days`` and more are retired, runs that ended as long ago go, the rest stay."""
    old = F.col("ended") <= now - F.make_dt_interval(days=F.lit(days))
    action = F.when((F.col("state") == "standby") & old, "retire").when(F.col("state").isin("retired", "failed", "cancelled") & old, "delete").otherwise("keep")
    return runs.select("account", "run", action.alias("action"))


def coverage(messages: DataFrame, assignments: DataFrame) -> DataFrame:
    """(account, n, missing, complete): a run that lacks an assignment for any message is not complete."""
    j = messages.select("account", "id").join(assignments.select("id", F.lit(1).alias("there")).distinct(), "id", "left")
    g = j.groupBy("account").agg(F.count("*").alias("n"), F.count_if(F.col("there").isNull()).alias("missing"))
    return g.withColumn("complete", F.col("missing") == 0)


def history(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, previous, next) of the assignments (id, delivery) that an operation changes, adds or takes away."""
    j = before.select("id", F.col("delivery").alias("previous")).join(after.select("id", F.col("delivery").alias("next")), "id", "outer")
    return j.filter(~F.col("previous").eqNullSafe(F.col("next")))


def restored(after: DataFrame, kept: DataFrame) -> DataFrame:
    """The assignments (id, delivery) as they were before the operation whose history is given."""
    j = after.select("id", "delivery").join(kept.select("id", "previous", F.lit(True).alias("moved")), "id", "outer")
    return j.select("id", F.when(F.col("moved"), F.col("previous")).otherwise(F.col("delivery")).alias("delivery")).filter("delivery IS NOT NULL")


def recomputed(copies: DataFrame, stored: DataFrame, dirty: DataFrame) -> DataFrame:
    """(id, delivery) after changes of the ``dirty`` ids, from ``stored`` (id, message_id, delivery) before them.

    Only Message-IDs that a changed row has, or had, are worked on again; all
    other assignments stay as they are stored.
    """
    ids = dirty.select("id").distinct()
    touched = copies.join(ids, "id").select("message_id").union(stored.join(ids, "id").select("message_id")).filter("message_id IS NOT NULL").distinct()
    again = copies.join(touched, "message_id", "left_semi").select(*copies.columns)
    loose = copies.filter("message_id IS NULL").join(ids, "id", "left_semi").select(*copies.columns)
    new = deliveries_v2(again.union(loose)).select("id", "delivery")
    return stored.join(new.select("id"), "id", "left_anti").join(copies.select("id"), "id", "left_semi").select("id", "delivery").union(new)


def repaired(queue: DataFrame, messages: DataFrame, most: int = 100) -> DataFrame:
    """(id, parsed, authored) digests for the ``most`` ids that wait longest in ``queue`` (id, enqueued_at)."""
    next_ = queue.groupBy("id").agg(F.min("enqueued_at").alias("since")).orderBy("since", "id").limit(most)
    text = F.regexp_replace(F.col("body"), r"\s+", " ")
    return messages.join(next_, "id").select("id", F.sha2("body", 256).alias("parsed"), F.sha2(F.concat_ws("|", "subject", text), 256).alias("authored"))


def evidence_digests(messages: DataFrame, evidence: DataFrame) -> DataFrame:
    """(account, id, digest): a digest of all that is known beside the text, from rows (id, kind, namespace, key); the same for any order of these, and for none that of nothing."""
    own = evidence.select("id", F.concat_ws("|", "kind", "namespace", F.sha2("key", 256)).alias("e")).distinct()
    held = own.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("e")), "\n").alias("es"))
    return messages.select("account", "id").join(held, "id", "left").select("account", "id", F.sha2(F.coalesce("es", F.lit("")), 256).alias("digest"))
