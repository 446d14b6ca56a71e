"""Threading of conversations, and reads of threads."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import threads as o
from ..sources.tables import SQL, live_messages, messages, read
from . import Group

group = Group()
add = group.add


def turns(spark, d):
    """Conversations as messages: each turn answers the one before, and refers to the two before."""
    t = lambda k: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), (F.col("turn") - k).cast("string"), F.lit("@x"))
    none = F.array().cast("array<string>")
    refs = F.when(F.col("turn") >= 2, F.array(t(2), t(1))).when(F.col("turn") == 1, F.array(t(1))).otherwise(none)
    return read(spark, d, "conversations").select(
        F.lit("acc").alias("account"), F.concat_ws(".", "conv_id", "turn").alias("id"), t(0).alias("rfc_id"), F.sha2("text", 256).alias("fingerprint"),
        o.selected_references(refs, none, t(0)).alias("refs"), F.lit(None).cast("string").alias("provider_thread"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("turn").cast("int"))).alias("date"),
        F.col("role").alias("sender"), F.array(F.when(F.col("role") == "user", "assistant").otherwise("user")).alias("recipients"),
        F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("base_subject"), (F.col("turn") > 0).alias("is_reply"), F.lit(False).alias("automated"),
    )


CONV = """t AS (SELECT conv_id, turn, conv_id || '.' || turn AS id, 'c' || conv_id || '.' || turn || '@x' AS rfc_id, sha256(text) AS fp FROM conversations),
e AS (SELECT rfc_id AS src, 'c' || conv_id || '.' || (turn - 1) || '@x' AS dst FROM t WHERE turn >= 1 UNION SELECT 'c' || conv_id || '.' || (turn - 1) || '@x', 'c' || conv_id || '.' || (turn - 2) || '@x' FROM t WHERE turn >= 2),
s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (WITH RECURSIVE w(a, b) AS (SELECT rfc_id, rfc_id FROM t UNION SELECT w.a, s.dst FROM w JOIN s ON s.src = w.b) SELECT a, min(b) AS root FROM w GROUP BY a)"""


@add("thr_components", f"WITH {CONV} SELECT id, 'thread_' || substr(sha256('postrider-thread-v1' || chr(0) || 'acc' || chr(0) || 'acc' || chr(0) || root), 1, 32) AS conversation_id FROM t JOIN r ON r.a = t.rfc_id")
def thr_components(spark, d):
    """Conversation ids from reply headers alone."""
    return o.assigned(turns(spark, d), subjects=False).select("id", "conversation_id")


@add("thr_method_conf", f"WITH {CONV} SELECT CASE WHEN turn > 0 THEN 'references' ELSE 'standalone' END AS method, 'high' AS confidence, count(*) AS n FROM t GROUP BY ALL")
def thr_method_conf(spark, d):
    return o.assigned(turns(spark, d), subjects=False).groupBy("method", "confidence").agg(F.count("*").alias("n"))


@add("thr_provider", f"WITH {SQL} SELECT provider_thread, count(*) AS members FROM m_all WHERE provider_thread IS NOT NULL GROUP BY account, provider_thread")
def thr_provider(spark, d):
    """Deliveries of one provider thread and account are one conversation."""
    a = o.assigned(mails(spark, d), subjects=False)
    p = messages(spark, d).filter(F.col("provider_thread").isNotNull()).select(F.col("id").cast("string").alias("id"), "provider_thread")
    return a.join(p, "id").groupBy("conversation_id").agg(F.first("provider_thread").alias("provider_thread"), F.count("*").alias("members")).select("provider_thread", "members")


def mails(spark, d):
    m = messages(spark, d)
    return m.select(
        "account", F.col("id").cast("string").alias("id"), F.col("rfc_id"), F.sha2("body", 256).alias("fingerprint"), F.array().cast("array<string>").alias("refs"), "provider_thread", "date",
        F.col("from_email").alias("sender"), F.col("to_emails").alias("recipients"), F.lower("subject").alias("base_subject"), (F.col("id") % 2 == 1).alias("is_reply"), F.lit(False).alias("automated"),
    )


SUBJECTS = """x AS (SELECT source AS account, doc_id, '<' || doc_id || '>' AS rfc_id, lang AS s, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (doc_id * 37 % 525600) AS date, 'u' || (doc_id // 20 % 3) AS sender,
  list_distinct(['u' || (doc_id // 60 % 4), 'u' || (doc_id // 140 % 3)]) AS people, doc_id % 13 = 0 AS automated, doc_id // 20 % 4 <> 1 AS reply, doc_id % 11 <> 0 AS alone FROM documents)"""


def subjects(spark, d):
    """Mail on a few subjects between a few people: replies and roots, some of them automatic or with references."""
    i, k = F.col("doc_id"), F.floor(F.col("doc_id") / 20)
    person = lambda x: F.concat(F.lit("u"), x.cast("string"))
    return read(spark, d, "documents").select(
        F.col("source").alias("account"), i.alias("id"), F.concat(F.lit("<"), i.cast("string"), F.lit(">")).alias("rfc_id"), F.col("lang").alias("base_subject"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(i * 37 % 525600).cast("int"))).alias("date"), person(k % 3).alias("sender"),
        F.array(person(F.floor(i / 60) % 4), person(F.floor(i / 140) % 3)).alias("recipients"), (i % 13 == 0).alias("automated"), (k % 4 != 1).alias("is_reply"),
    )


@add("thr_subject_fallback", f"""WITH {SUBJECTS}, y AS (SELECT * FROM x WHERE alone AND NOT automated),
p AS (SELECT r.account, r.rfc_id AS dst, count(*) AS n, min(q.rfc_id) AS src FROM y r JOIN y q ON q.account = r.account AND q.s = r.s AND r.reply AND NOT q.reply AND r.date >= q.date AND r.date <= q.date + INTERVAL 14 DAY
  AND list_contains(r.people, q.sender) AND list_contains(q.people, r.sender) GROUP BY ALL)
SELECT account, src, dst FROM p WHERE n = 1""")
def thr_subject_fallback(spark, d):
    """A reply without references and the only root of its subject within two weeks, between people who wrote to each other; none of it automatic."""
    m = subjects(spark, d)
    return o.subject_edges(m, m.filter("id % 11 <> 0").select("account", "rfc_id").distinct())


@add("thr_refs_select", "SELECT conv_id, turn, CASE WHEN turn >= 2 THEN (turn - 2) || ',' || (turn - 1) WHEN turn = 1 THEN '0' ELSE '' END AS refs FROM conversations")
def thr_refs_select(spark, d):
    s = lambda k: (F.col("turn") - k).cast("string")
    refs = F.when(F.col("turn") >= 2, F.array(s(2), s(1), s(0)))
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(o.selected_references(refs, F.when(F.col("turn") == 1, F.array(s(1))), s(0)), ",").alias("refs"))


@add("thr_edges", f"WITH {CONV} SELECT src, dst FROM e")
def thr_edges(spark, d):
    e = o.edges(turns(spark, d))
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


@add("thr_closure", f"WITH {SQL} SELECT DISTINCT y.id::VARCHAR AS id FROM m_all x JOIN m_all y ON y.body = x.body WHERE x.id % 20 = 0")
def thr_closure(spark, d):
    """All messages that share a body with a seed, directly or over others."""
    rows = messages(spark, d).select(F.col("id").cast("string").alias("id"), F.lit("body").alias("kind"), F.md5("body").alias("key"))
    return o.closure(messages(spark, d).filter("id % 20 = 0").select(F.col("id").cast("string").alias("id")), rows)


@add("thr_validate", f"WITH {SQL} SELECT count(*)::BIGINT AS repeated FROM (SELECT id FROM m_all GROUP BY account, id HAVING count(*) > 1)")
def thr_validate(spark, d):
    return o.repeated_ids(o.checked(mails(spark, d))).agg(F.count("*").alias("repeated"))


@add("thr_compare", f"""WITH {SQL}, p AS (SELECT id, account AS o, CASE WHEN id % 10 = 0 THEN folder ELSE account END AS n FROM m_all)
SELECT 0::BIGINT AS only_new, 0::BIGINT AS only_old, count(*) FILTER (WHERE o <> n) AS changed, (SELECT count(*) FROM (SELECT o FROM p GROUP BY o HAVING count(DISTINCT n) > 1)) AS splits, (SELECT count(*) FROM (SELECT n FROM p GROUP BY n HAVING count(DISTINCT o) > 1)) AS merges FROM p""")
def thr_compare(spark, d):
    m = messages(spark, d)
    return o.compared(m.select("id", F.col("account").alias("conversation_id")), m.select("id", F.when(F.col("id") % 10 == 0, F.col("folder")).otherwise(F.col("account")).alias("conversation_id")))


@add("thr_participants", f"WITH {SQL}, p AS (SELECT account, unnest(list_concat([from_email], to_emails)) AS email, date, id FROM m) SELECT account, lower(email) AS email, min(date) AS first FROM p GROUP BY ALL")
def thr_participants(spark, d):
    p = live_messages(spark, d).select("account", F.explode(F.concat(F.array("from_email"), "to_emails")).alias("email"), "date")
    return p.groupBy("account", F.lower("email").alias("email")).agg(F.min("date").alias("first"))


@add("thr_walk_legacy", f"WITH {SQL}, s AS (SELECT * FROM m WHERE id = 12) SELECT m.id FROM m, s WHERE m.provider_thread = s.provider_thread OR m.id = s.id OR m.rfc_id = s.rfc_id")
def thr_walk_legacy(spark, d):
    """One hop from a seed: the same provider thread, the row itself, or its id."""
    m = live_messages(spark, d)
    s = m.filter("id = 12").select(F.col("id").alias("sid"), F.col("provider_thread").alias("sp"), F.col("rfc_id").alias("sr"))
    keys = s.select(F.inline(F.array(F.struct(F.lit("p").alias("k"), F.col("sp").alias("v")), F.struct(F.lit("i").alias("k"), F.col("sid").cast("string").alias("v")), F.struct(F.lit("r").alias("k"), F.col("sr").alias("v")))))
    own = m.select("id", F.inline(F.array(F.struct(F.lit("p").alias("k"), F.col("provider_thread").alias("v")), F.struct(F.lit("i").alias("k"), F.col("id").cast("string").alias("v")), F.struct(F.lit("r").alias("k"), F.col("rfc_id").alias("v")))))
    return own.join(keys, ["k", "v"], "left_semi").select("id").distinct()


@add("thr_batch", f"WITH {SQL}, s AS (SELECT unnest([40, 3, 120, 77]) AS id, unnest([0, 1, 2, 3]) AS ord) SELECT s.id::BIGINT AS seed, ord::INT AS ord, m.account, first_value(s.id) OVER (PARTITION BY m.account ORDER BY ord)::BIGINT AS first_seed FROM s LEFT JOIN m USING (id)")
def thr_batch(spark, d):
    """Several seeds at once; one that repeats a conversation points to the first."""
    s = spark.createDataFrame([(40, 0), (3, 1), (120, 2), (77, 3)], "seed long, ord int")
    j = s.join(live_messages(spark, d).select(F.col("id").alias("seed"), "account"), "seed", "left")
    return j.withColumn("first_seed", F.first("seed").over(Window.partitionBy("account").orderBy("ord")))


@add("thr_targets", f"WITH {SQL} SELECT account, id FROM m QUALIFY row_number() OVER (PARTITION BY account ORDER BY date, id) <= 100")
def thr_targets(spark, d):
    """Rows to act on: no collapse of copies, the oldest hundred of each conversation."""
    w = Window.partitionBy("account").orderBy("date", "id")
    return live_messages(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn <= 100").select("account", "id")


@add("thr_delivery_keys", f"WITH {SQL} SELECT id, sha256(lower(rfc_id)) AS delivery FROM m WHERE id IN (1, 2, 3, 500)")
def thr_delivery_keys(spark, d):
    wanted = spark.createDataFrame([(1,), (2,), (3,), (500,)], "id long")
    return live_messages(spark, d).join(wanted, "id", "left_semi").select("id", F.sha2(F.lower("rfc_id"), 256).alias("delivery"))


@add("thr_bridge", f"WITH {SQL} SELECT md5(body) AS body, count(DISTINCT account) AS accounts FROM m_all GROUP BY 1 HAVING count(DISTINCT account) > 1")
def thr_bridge(spark, d):
    return messages(spark, d).groupBy(F.md5("body").alias("body")).agg(F.countDistinct("account").alias("accounts")).filter("accounts > 1")
