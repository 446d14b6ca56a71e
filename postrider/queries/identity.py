"""Deliveries, graph nodes, anchors and runs of threading."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import identity as o
from ..operators.conversations import conversations, evidence
from ..operators.incremental import Maintained
from ..plans.staging import shared_dir, stage
from ..sources.tables import SQL, attachments, messages, read
from ..streaming.scans import ResumableScan
from . import Group

group = Group()
add = group.add


def copies(spark, d):
    """Documents as stored copies: digests and ids repeat over neighbouring rows, in steps that do not fall together."""
    i = F.col("doc_id")
    each = lambda letter, k: F.concat(F.lit(letter), F.floor(i / k).cast("string"))
    none = F.array().cast("array<string>")
    refs = F.when(i % 3 == 0, F.array(each("m", 16), each("m", 4))).when(i % 3 == 1, F.array(each("m", 4))).otherwise(none)
    return read(spark, d, "documents").select(
        F.lit("acc").alias("account"), i.alias("id"), F.col("lang").alias("folder"), F.when(i % 10 == 0, each("p", 20)).alias("provider_key"), F.when(i % 7 != 0, each("m", 4)).alias("message_id"),
        F.when(i % 3 == 0, each("r", 8)).alias("raw_hash"), F.when(i % 5 < 3, each("s", 6)).alias("parsed"), F.when(i % 4 == 1, each("w", 5)).alias("authored"), F.when(i % 2 == 0, each("d", 12)).alias("metadata"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(i * 37 % 525600).cast("int"))).alias("date"), refs.alias("refs"),
    )


COPIES = """c AS (SELECT 'acc' AS account, doc_id AS id, lang AS folder, CASE WHEN doc_id % 10 = 0 THEN 'p' || (doc_id // 20) END AS provider_key, CASE WHEN doc_id % 7 <> 0 THEN 'm' || (doc_id // 4) END AS message_id,
  CASE WHEN doc_id % 3 = 0 THEN 'raw:r' || (doc_id // 8) END AS raw, CASE WHEN doc_id % 5 < 3 THEN 'parsed:s' || (doc_id // 6) END AS parsed, CASE WHEN doc_id % 4 = 1 THEN 'authored:w' || (doc_id // 5) END AS a,
  CASE WHEN doc_id % 2 = 0 THEN 'd' || (doc_id // 12) END AS metadata, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (doc_id * 37 % 525600) AS date,
  CASE doc_id % 3 WHEN 0 THEN ['m' || (doc_id // 16), 'm' || (doc_id // 4)] WHEN 1 THEN ['m' || (doc_id // 4)] ELSE [] END AS refs FROM documents),
f AS (SELECT id, message_id, a, unnest(list_distinct(list_filter([coalesce(raw, parsed), parsed, a], lambda x: x IS NOT NULL))) AS f FROM c WHERE message_id IS NOT NULL)"""
V2 = f"""{COPIES}, e2 AS (SELECT DISTINCT x.id AS p, y.id AS q FROM f x JOIN f y ON x.message_id = y.message_id AND x.f = y.f),
v2 AS (SELECT c.id, coalesce(min(w.q), c.id) AS delivery FROM c LEFT JOIN (WITH RECURSIVE w(p, q) AS (SELECT p, q FROM e2 UNION SELECT w.p, e2.q FROM w JOIN e2 ON e2.p = w.q) SELECT * FROM w) w ON w.p = c.id GROUP BY c.id)"""


@add("thr_fingerprints", f"WITH {COPIES} SELECT id, array_to_string(list_sort(list_distinct(list_filter([coalesce(raw, parsed), parsed, a], lambda x: x IS NOT NULL))), ' ') AS prints FROM c")
def thr_fingerprints(spark, d):
    return copies(spark, d).select("id", F.array_join(F.array_sort(o.copy_fingerprints()), " ").alias("prints"))


@add("thr_delivery_v1", f"""WITH {COPIES}, b AS (SELECT id, coalesce('provider:' || provider_key, 'message-id:' || message_id, 'fingerprint:' || coalesce(raw, parsed), 'row:' || id) AS base, coalesce(raw, parsed, 'physical:' || id) AS variant FROM c),
g AS (SELECT base, count(DISTINCT variant) > 1 AS several FROM b GROUP BY base)
SELECT id, CASE WHEN several AND base LIKE 'message-id:%' THEN base || '|' || variant ELSE base END AS delivery FROM b JOIN g USING (base)""")
def thr_delivery_v1(spark, d):
    """By provider id, Message-ID with fingerprint, fingerprint, or row."""
    return o.deliveries_v1(copies(spark, d)).select("id", "delivery")


@add("thr_delivery_v2", f"WITH {V2} SELECT id, delivery FROM v2")
def thr_delivery_v2(spark, d):
    return o.deliveries_v2(copies(spark, d)).select("id", "delivery")


@add("thr_delivery_v3", f"""WITH {COPIES}, e1 AS (SELECT DISTINCT x.id AS p, y.id AS q FROM f x JOIN f y ON x.message_id = y.message_id AND x.f = y.f AND x.a IS NOT DISTINCT FROM y.a),
r1 AS (SELECT c.*, coalesce(w.root, c.id) AS root FROM (SELECT * FROM c WHERE message_id IS NOT NULL) c LEFT JOIN (SELECT p, min(q) AS root FROM (WITH RECURSIVE w(p, q) AS (SELECT p, q FROM e1 UNION SELECT w.p, e1.q FROM w JOIN e1 ON e1.p = w.q) SELECT * FROM w) GROUP BY p) w ON w.p = c.id),
g AS (SELECT DISTINCT f.message_id, f.f, f.a, r1.root FROM f JOIN r1 ON r1.id = f.id),
n AS (SELECT x.root, min(y.a) AS lo, max(y.a) AS hi, min(y.root) AS near FROM g x JOIN g y ON x.message_id = y.message_id AND x.f = y.f AND x.a IS NULL AND y.a IS NOT NULL GROUP BY x.root),
p AS (SELECT r1.*, CASE WHEN lo = hi THEN near ELSE r1.root END AS part, coalesce(lo <> hi, false) AS open FROM r1 LEFT JOIN n ON n.root = r1.root),
s AS (SELECT part, max(a) AS pa, bool_or(open) AS conflict FROM p GROUP BY part),
m AS (SELECT DISTINCT p.message_id, p.metadata, p.part, s.pa, s.conflict FROM p JOIN s USING (part) WHERE metadata IS NOT NULL),
h AS (SELECT m.message_id, m.metadata, count(q.folder) = count(DISTINCT q.folder) AS apart FROM m JOIN (SELECT DISTINCT part, folder FROM p) q USING (part) GROUP BY ALL),
ok AS (SELECT message_id, metadata, count(DISTINCT pa) AS na FROM m GROUP BY ALL HAVING NOT bool_or(conflict)),
j AS (SELECT m.part, m.message_id || '|' || m.metadata || '|' || CASE WHEN na > 1 THEN coalesce(pa, '') ELSE '' END AS key FROM m JOIN h USING (message_id, metadata) JOIN ok USING (message_id, metadata) WHERE apart),
e3 AS (SELECT DISTINCT x.part AS p, y.part AS q FROM j x JOIN j y USING (key)),
t AS (SELECT p, min(q) AS top FROM (WITH RECURSIVE w(p, q) AS (SELECT p, q FROM e3 UNION SELECT w.p, e3.q FROM w JOIN e3 ON e3.p = w.q) SELECT * FROM w) GROUP BY p),
u AS (SELECT p.id, coalesce(t.top, p.part) AS top, s.conflict FROM p JOIN s USING (part) LEFT JOIN t ON t.p = p.part)
SELECT c.id, coalesce(min(v.id), c.id) AS delivery, coalesce(any_value(u.conflict), false) AS conflict FROM c LEFT JOIN u ON u.id = c.id LEFT JOIN u v ON v.top = u.top GROUP BY c.id""")
def thr_delivery_v3(spark, d):
    """Copies with different authored digests never become one; metadata joins only copies in different folders."""
    return o.deliveries_v3(copies(spark, d)).select("id", "delivery", "conflict")


@add("thr_delivery_merge", f"""WITH {V2}, k AS (SELECT v2.delivery, c.*, (CASE WHEN len(refs) > 0 THEN 2000 ELSE 0 END) + len(refs) * 10 + (message_id IS NOT NULL)::INT AS quality FROM c JOIN v2 USING (id)),
b AS (SELECT DISTINCT ON (delivery) delivery, id, refs FROM k ORDER BY delivery, quality DESC, id),
a AS (SELECT k.delivery, bool_and(len(k.refs) = 0 OR (len(k.refs) <= len(b.refs) AND b.refs[len(b.refs) - len(k.refs) + 1:len(b.refs)] = k.refs)) AS agree, min(k.date) AS date, count(*) AS n_copies,
  CASE WHEN min(provider_key) = max(provider_key) THEN min(provider_key) END AS provider_key, CASE WHEN min(message_id) = max(message_id) THEN min(message_id) END AS message_id FROM k JOIN b USING (delivery) GROUP BY k.delivery)
SELECT delivery, id, CASE WHEN agree THEN array_to_string(refs, ' ') ELSE '' END AS refs, date, n_copies, provider_key, message_id FROM b JOIN a USING (delivery)""")
def thr_delivery_merge(spark, d):
    c = copies(spark, d)
    m = o.merged(c.join(o.deliveries_v2(c), ["account", "id"]))
    return m.select("delivery", "id", F.array_join("refs", " ").alias("refs"), "date", "n_copies", "provider_key", "message_id")


NODES = f"""{V2}, dl AS (SELECT DISTINCT ON (delivery) delivery, c.message_id, c.refs FROM c JOIN v2 USING (id) ORDER BY delivery, id),
ow AS (SELECT message_id AS token, count(*) AS n FROM dl WHERE message_id IS NOT NULL GROUP BY 1)"""


def first_copies(spark, d):
    c = copies(spark, d)
    return c.join(o.deliveries_v2(c), ["account", "id"]).filter("id = delivery").select("account", "delivery", "message_id", "refs")


@add("thr_nodes", f"""WITH {NODES} SELECT delivery, CASE WHEN n = 1 THEN 'reference:' || message_id ELSE 'delivery:' || delivery END AS node, 'own' AS kind FROM dl LEFT JOIN ow ON token = message_id
UNION ALL SELECT delivery, CASE WHEN n = 1 THEN 'reference:' || r.token WHEN n > 1 THEN 'ambiguous:' || r.token || ':' || delivery ELSE 'missing:' || r.token END, 'reference' FROM (SELECT delivery, unnest(refs) AS token FROM dl) r LEFT JOIN ow ON ow.token = r.token""")
def thr_nodes(spark, d):
    own, refs = o.nodes(first_copies(spark, d))
    return own.select("delivery", "node", F.lit("own").alias("kind")).union(refs.select("delivery", "node", F.lit("reference")))


@add("thr_anchor", f"""WITH {COPIES}, g AS (SELECT id // 24 AS component, message_id AS key, CASE WHEN id % 24 < 8 THEN message_id END AS reference, id % 5 <> 0 AS is_root, id % 24 = 9 AND id // 24 % 2 = 0 AS ambiguous, id % 23 = 0 AS placeholder FROM c WHERE message_id IS NOT NULL),
s AS (SELECT component, min(reference) FILTER (WHERE is_root) AS lo, max(reference) FILTER (WHERE is_root) AS hi, count(*) FILTER (WHERE is_root AND ambiguous) AS n, min(key) FILTER (WHERE is_root AND ambiguous) AS open, bool_or(placeholder) AS lacking FROM g GROUP BY 1),
m AS (SELECT id // 24 AS component, min(id::VARCHAR) FILTER (WHERE id % 31 = 0) AS fb, min(provider_key) AS plo, max(provider_key) AS phi, min(id::VARCHAR) AS first FROM c GROUP BY 1)
SELECT component, coalesce('delivery:' || fb, CASE WHEN lo = hi AND n = 0 THEN 'reference:' || lo END, CASE WHEN plo = phi THEN 'provider:' || plo END, CASE WHEN n = 1 THEN 'ambiguity:' || sha256(open) END, 'delivery:' || first) AS anchor, coalesce(lacking, false) OR fb IS NOT NULL AS provisional FROM m LEFT JOIN s USING (component)""")
def thr_anchor(spark, d):
    """What names a conversation; the components here are runs of 24 rows, so that each rule occurs."""
    c = copies(spark, d).withColumn("component", F.floor(F.col("id") / 24))
    i = F.col("id") % 24
    g = c.filter("message_id IS NOT NULL").select("component", F.col("message_id").alias("key"), F.when(i < 8, F.col("message_id")).alias("reference"), (F.col("id") % 5 != 0).alias("is_root"), ((i == 9) & (F.col("component") % 2 == 0)).alias("ambiguous"), (F.col("id") % 23 == 0).alias("placeholder"))
    m = c.select("component", F.col("id").cast("string").alias("delivery"), F.col("provider_key").alias("provider_thread"), (F.col("id") % 31 == 0).alias("fallback_root"))
    return o.anchors(g, m)


@add("thr_hdr_reconcile", f"""WITH {COPIES}, h AS (SELECT id, refs AS a, CASE id % 4 WHEN 0 THEN refs[len(refs):] WHEN 1 THEN ['other'] WHEN 2 THEN NULL ELSE list_concat(['older'], refs) END AS b FROM c),
l AS (SELECT id, CASE WHEN len(a) >= len(coalesce(b, [])) THEN a ELSE b END AS long, CASE WHEN len(a) >= len(coalesce(b, [])) THEN coalesce(b, []) ELSE a END AS short FROM h),
k AS (SELECT *, len(short) = 0 OR long[len(long) - len(short) + 1:len(long)] = short AS fits FROM l)
SELECT id, CASE WHEN fits THEN array_to_string(long, ' ') ELSE '' END AS tokens, CASE WHEN NOT fits THEN 'conflict' END AS warning FROM k""")
def thr_hdr_reconcile(spark, d):
    """Two occurrences of a References header: suffixes are compatible, anything else is in conflict."""
    i, refs = F.col("id") % 4, F.col("refs")
    other = F.when(i == 0, F.when(F.size(refs) > 0, F.slice(refs, -1, 1)).otherwise(refs)).when(i == 1, F.array(F.lit("other"))).when(i == 3, F.concat(F.array(F.lit("older")), refs))
    return copies(spark, d).select("id", F.array_join(o.reconciled(refs, other), " ").alias("tokens"), o.header_warning(refs, other).alias("warning"))


@add("thr_input_hash", f"""WITH {V2} SELECT id, sha256(concat_ws('|', account, id::VARCHAR, coalesce(message_id, ''), coalesce(provider_key, ''), array_to_string(list_sort(list_distinct(list_filter([coalesce(raw, parsed), parsed, a], lambda x: x IS NOT NULL))), ','), array_to_string(refs, ','), strftime(date, '%Y-%m-%d %H:%M:%S'), delivery::VARCHAR)) AS hash FROM c JOIN v2 USING (id)""")
def thr_input_hash(spark, d):
    """A digest of all that a decision read and of the decision, so that only rows whose inputs changed are written."""
    c = copies(spark, d)
    j = c.join(o.deliveries_v2(c).select("id", "delivery"), "id")
    blank = lambda x: F.coalesce(x, F.lit(""))
    read_ = F.concat_ws("|", "account", F.col("id").cast("string"), blank("message_id"), blank("provider_key"), F.array_join(F.array_sort(o.copy_fingerprints()), ","), F.array_join("refs", ","), F.date_format("date", "yyyy-MM-dd HH:mm:ss"), F.col("delivery").cast("string"))
    return j.select("id", F.sha2(read_, 256).alias("hash"))


@add("thr_subject_work", """WITH n AS (SELECT source AS account, lang AS base_subject, count(*) AS n FROM documents GROUP BY ALL)
SELECT account, base_subject, n, CASE WHEN n > 20 THEN 'dissolve' ELSE 'work' END AS action FROM n""")
def thr_subject_work(spark, d):
    """A subject with too many rows proves nothing: its weak edges are dissolved and it is not worked on. The bound here is 20."""
    m = read(spark, d, "documents").select(F.col("source").alias("account"), F.col("lang").alias("base_subject"))
    work, common = o.bounded_subjects(m, most=20)
    done = work.groupBy("account", "base_subject").agg(F.count("*").alias("n")).withColumn("action", F.lit("work"))
    return done.union(common.withColumn("action", F.lit("dissolve")))


@add("thr_edges_table", f"""WITH {COPIES}, w AS (SELECT id, 'message_id' AS kind, message_id AS key FROM c UNION ALL SELECT id, 'provider', provider_key FROM c UNION ALL SELECT id, 'reference', unnest(refs) FROM c UNION ALL SELECT id, 'fingerprint', coalesce(raw, parsed) FROM c UNION ALL SELECT id, 'authored', a FROM c),
n AS (SELECT DISTINCT * FROM w WHERE key IS NOT NULL), s AS (SELECT id, kind, CASE WHEN id % 5 = 0 AND kind = 'message_id' THEN key || '.old' ELSE key END AS key FROM n WHERE id % 9 <> 0)
SELECT *, 'delete' AS action FROM (SELECT * FROM s EXCEPT SELECT * FROM n) UNION ALL SELECT *, 'insert' FROM (SELECT * FROM n EXCEPT SELECT * FROM s)""")
def thr_edges_table(spark, d):
    """Edge rows of five kinds, brought from what is stored to what is wanted."""
    row = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("key"))
    rows = F.array(row("message_id", F.col("message_id")), row("provider", F.col("provider_key")), row("fingerprint", o.copy_fingerprint()), row("authored", o.tagged("authored", "authored")))
    wanted = copies(spark, d).select("id", F.inline(F.concat(rows, F.transform("refs", lambda x: row("reference", x))))).filter("key IS NOT NULL").distinct()
    stale = F.when((F.col("id") % 5 == 0) & (F.col("kind") == "message_id"), F.concat("key", F.lit(".old"))).otherwise(F.col("key"))
    return o.changed_edges(wanted.filter("id % 9 <> 0").withColumn("key", stale), wanted)


RUNS = """r AS (SELECT 'u' || user_id AS account, event_id AS run, CASE event_type WHEN 'purchase' THEN 'ready' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'standby' WHEN 'view' THEN 'retired' ELSE 'active' END AS state, CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS covered, event_id % 4 AS revision, 1 AS evidence, event_id % 5 <> 0 AS certified, ts AS ended FROM events)"""


def runs(spark, d):
    """Events as runs of threading: what they are called decides the state."""
    e, i = F.col("event_type"), F.col("event_id")
    state = F.when(e == "purchase", "ready").when(e == "error", "failed").when(e == "signup", "standby").when(e == "view", "retired").otherwise("active")
    return read(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("account"), i.alias("run"), state.alias("state"), F.when(i % 3 == 0, 0.5).otherwise(1.0).alias("covered"), (i % 4).alias("revision"),
        F.lit(1).alias("evidence"), (i % 5 != 0).alias("certified"), F.col("ts").alias("ended"),
    )


@add("thr_activate", f"""WITH {RUNS}, g AS (SELECT account, max(run) FILTER (WHERE state = 'ready' AND covered >= 1 AND revision = evidence AND certified) AS nxt, max(run) FILTER (WHERE state = 'active') AS cur, count(*) FILTER (WHERE state = 'ready' AND NOT (covered >= 1 AND revision = evidence AND certified)) AS refused FROM r GROUP BY account)
SELECT account, coalesce(nxt, cur) AS active, CASE WHEN nxt IS NOT NULL THEN cur END AS standby, refused FROM g""")
def thr_activate(spark, d):
    return o.activation(runs(spark, d))


@add("rollback", f"""WITH {RUNS}, b AS (SELECT *, max(run) FILTER (WHERE state = 'standby') OVER (PARTITION BY account) AS back FROM r)
SELECT account, run, CASE WHEN back IS NULL THEN state WHEN run = back THEN 'active' WHEN state = 'active' THEN 'retired' ELSE state END AS state FROM b""")
def rollback(spark, d):
    return o.rolled_back(runs(spark, d))


@add("thr_retention", f"""WITH {RUNS} SELECT account, run, CASE WHEN state = 'standby' AND ended <= TIMESTAMP '2024-02-10' - INTERVAL 30 DAY THEN 'retire' WHEN state IN ('retired', 'failed', 'cancelled') AND ended <= TIMESTAMP '2024-02-10' - INTERVAL 30 DAY THEN 'delete' ELSE 'keep' END AS action FROM r""")
def thr_retention(spark, d):
    return o.retained(runs(spark, d), F.lit("2024-02-10 00:00:00").cast("timestamp_ntz"))


@add("thr_coverage", f"WITH {COPIES} SELECT account, count(*) AS n, count(*) FILTER (WHERE id NOT IN (SELECT doc_id FROM labels)) AS missing, count(*) FILTER (WHERE id NOT IN (SELECT doc_id FROM labels)) = 0 AS complete FROM c GROUP BY account")
def thr_coverage(spark, d):
    """Messages without an assignment, which block a run; here only the labelled ones have one."""
    return o.coverage(copies(spark, d), read(spark, d, "labels").select(F.col("doc_id").alias("id")))


@add("thr_history", f"WITH {V2} SELECT id, coalesce(message_id, 'row:' || id) AS previous, delivery::VARCHAR AS next FROM c JOIN v2 USING (id)")
def thr_history(spark, d):
    """What a run changed, before and after, as far as a rollback gives back what was there."""
    c = copies(spark, d)
    before = c.select("id", F.coalesce("message_id", F.concat(F.lit("row:"), F.col("id").cast("string"))).alias("delivery"))
    after = o.deliveries_v2(c).select("id", F.col("delivery").cast("string").alias("delivery"))
    kept = o.history(before, after)
    back = o.restored(after, kept).join(before.withColumnRenamed("delivery", "want"), "id").filter("delivery = want")
    return kept.join(back.select("id"), "id").select("id", "previous", "next")


ROW = "id long, account string, folder string, provider_key string, message_id string, raw_hash string, parsed string, authored string, metadata string, date timestamp_ntz, refs array<string>, provider_thread string"
CONVERSATIONS = f"""{V2}, k AS (SELECT v2.delivery, c.id, c.message_id, c.refs, CASE WHEN c.id % 9 = 0 THEN 't' || (c.id // 90) END AS thread, (CASE WHEN len(refs) > 0 THEN 2000 ELSE 0 END) + len(refs) * 10 + (message_id IS NOT NULL)::INT AS quality FROM c JOIN v2 USING (id)),
b AS (SELECT DISTINCT ON (delivery) delivery, refs FROM k ORDER BY delivery, quality DESC, id),
mg AS (SELECT k.delivery, CASE WHEN min(message_id) = max(message_id) THEN min(message_id) END AS message_id, CASE WHEN bool_and(len(k.refs) = 0 OR (len(k.refs) <= len(b.refs) AND b.refs[len(b.refs) - len(k.refs) + 1:len(b.refs)] = k.refs)) THEN any_value(b.refs) ELSE [] END AS refs FROM k JOIN b USING (delivery) GROUP BY k.delivery),
ow AS (SELECT message_id AS token, count(*) AS n FROM mg WHERE message_id IS NOT NULL GROUP BY 1),
own AS (SELECT delivery, CASE WHEN n = 1 THEN 'reference:' || message_id ELSE 'delivery:' || delivery END AS node FROM mg LEFT JOIN ow ON token = message_id),
ch AS (SELECT delivery, pos, CASE WHEN n = 1 THEN 'reference:' || r.token WHEN n > 1 THEN 'ambiguous:' || r.token || ':' || delivery ELSE 'missing:' || r.token END AS node FROM (SELECT delivery, unnest(refs) AS token, unnest(range(len(refs))) AS pos FROM mg) r LEFT JOIN ow ON ow.token = r.token UNION ALL SELECT delivery, 1000000, node FROM own),
st AS (SELECT DISTINCT parent, node AS child FROM (SELECT lag(node) OVER (PARTITION BY delivery ORDER BY pos) AS parent, node FROM ch) WHERE parent <> node),
th AS (SELECT DISTINCT delivery, thread FROM k WHERE thread IS NOT NULL),
ln AS (SELECT parent AS p, child AS q FROM st UNION SELECT child, parent FROM st UNION SELECT 'hub:' || thread, node FROM th JOIN own USING (delivery) UNION SELECT node, 'hub:' || thread FROM th JOIN own USING (delivery)),
nd AS (SELECT parent AS node FROM st UNION SELECT child FROM st UNION SELECT node FROM own),
cp AS (SELECT nd.node, coalesce(min(w.q), nd.node) AS part FROM nd LEFT JOIN (WITH RECURSIVE w(p, q) AS (SELECT p, q FROM ln UNION SELECT w.p, ln.q FROM w JOIN ln ON ln.p = w.q) SELECT * FROM w) w ON w.p = nd.node GROUP BY nd.node),
gr AS (SELECT part, node, CASE WHEN node LIKE 'reference:%' OR node LIKE 'missing:%' THEN substr(node, instr(node, ':') + 1) END AS reference, node NOT IN (SELECT child FROM st) AS is_root, node LIKE 'ambiguous:%' AS open, node LIKE 'missing:%' AS lacking FROM cp),
gs AS (SELECT part, min(reference) FILTER (WHERE is_root) AS lo, max(reference) FILTER (WHERE is_root) AS hi, count(*) FILTER (WHERE is_root AND open) AS n, min(node) FILTER (WHERE is_root AND open) AS first_open, bool_or(lacking) AS lacking FROM gr GROUP BY part),
ms AS (SELECT part, min(thread) AS plo, max(thread) AS phi, min(delivery::VARCHAR) AS first FROM own JOIN cp USING (node) LEFT JOIN (SELECT th.* FROM th JOIN (SELECT thread FROM th GROUP BY thread HAVING count(*) > 1) USING (thread)) USING (delivery) GROUP BY part),
an AS (SELECT part, coalesce(CASE WHEN lo = hi AND n = 0 THEN 'reference:' || lo END, CASE WHEN plo = phi THEN 'provider:' || plo END, CASE WHEN n = 1 THEN 'ambiguity:' || sha256(first_open) END, 'delivery:' || first) AS anchor, lacking FROM ms JOIN gs USING (part))"""


def stored_copies(spark, d):
    return copies(spark, d).withColumn("provider_thread", F.when(F.col("id") % 9 == 0, F.concat(F.lit("t"), F.floor(F.col("id") / 90).cast("string")))).select(*[c.split()[0] for c in ROW.split(", ")])


@add("thr_conversations", f"WITH {CONVERSATIONS} SELECT id, delivery, 'thread_' || substr(sha256('postrider-thread-v1' || chr(0) || 'acc' || chr(0) || anchor), 1, 32) AS conversation_id, lacking AS provisional FROM v2 JOIN own USING (delivery) JOIN cp USING (node) JOIN an USING (part)")
def thr_conversations(spark, d):
    """Deliveries of copies, and conversations of deliveries with their names, in one run over all rows."""
    return conversations(stored_copies(spark, d)).select("id", "delivery", "conversation_id", "provisional")


@add("thr_incremental", f"WITH {CONVERSATIONS} SELECT id, delivery, 'thread_' || substr(sha256('postrider-thread-v1' || chr(0) || 'acc' || chr(0) || anchor), 1, 32) AS conversation_id, lacking AS provisional FROM v2 JOIN own USING (delivery) JOIN cp USING (node) JOIN an USING (part)")
def thr_incremental(spark, d):
    """A first load without some rows, with others that are wrong or too many; then a batch puts that right. The result is that of a full run, though the batch only works on what its changes reach."""
    c, i = stored_copies(spark, d), F.col("id")
    change = lambda rows, gone: rows.withColumns({"gone": F.lit(gone), "seq": F.col("id")})
    wrong = c.filter("id % 25 <> 7").withColumn("message_id", F.when(i % 40 == 3, F.lit("m0")).otherwise(F.col("message_id"))).withColumn("refs", F.when(i % 20 == 3, F.array(F.lit("m1"))).otherwise(F.col("refs")))
    extra = c.filter("id % 60 = 1").withColumn("id", i + 1_000_000_000)
    index = Maintained(spark, f"{shared_dir(spark)}/threads-{uuid.uuid4().hex}", ROW, "delivery long, conversation_id string, provisional boolean", evidence, lambda rows: conversations(rows).select("id", "delivery", "conversation_id", "provisional"), buckets=8)
    index.apply(change(wrong.unionByName(extra), False), 0)
    index.apply(change(c.filter("id % 25 = 7 OR id % 20 = 3"), False).unionByName(change(extra, True)), 1)
    return index.current()


@add("thr_digest_upgrade", f"""WITH {SQL}, o AS (SELECT account, id, provider_thread FROM m_all WHERE id % 3 = 0),
e AS (SELECT message_id AS id, 'attachment|name|' || sha256(filename) AS e FROM a UNION SELECT message_id, 'attachment|type|' || sha256(mime) FROM a UNION SELECT id, 'thread|provider|' || sha256(provider_thread) FROM o WHERE provider_thread IS NOT NULL)
SELECT account, o.id, sha256(coalesce(string_agg(e, chr(10) ORDER BY e), '')) AS digest FROM o LEFT JOIN e ON e.id = o.id GROUP BY ALL""")
def thr_digest_upgrade(spark, d):
    """Digests of the first version made anew, in pages by account and id; a run that breaks off goes on behind its last page."""
    old = messages(spark, d).filter("id % 3 = 0")
    files = attachments(spark, d).select(F.col("message_id").alias("id"), F.inline(F.array(*[F.struct(F.lit("attachment").alias("kind"), F.lit(n).alias("namespace"), F.col(c).alias("key")) for n, c in (("name", "filename"), ("type", "mime"))])))
    threads = old.filter("provider_thread IS NOT NULL").select("id", F.lit("thread").alias("kind"), F.lit("provider").alias("namespace"), F.col("provider_thread").alias("key"))
    scan = ResumableScan(spark, f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}", ("account", "id"))
    scan.run(stage(o.evidence_digests(old, files.union(threads))), page=max(100, old.count() // 3))
    return scan.emitted().select("account", "id", "digest")


@add("thr_body_evidence", """WITH q AS (SELECT user_id AS id, min(ts) AS since FROM events GROUP BY 1 ORDER BY since, id LIMIT 100)
SELECT id, sha256(text) AS parsed, sha256(split_part(text, chr(10), 1) || '|' || regexp_replace(text, '\\s+', ' ', 'g')) AS authored FROM q JOIN documents ON doc_id = id""")
def thr_body_evidence(spark, d):
    """Missing digests of the hundred messages that wait longest; an id may wait for several reasons."""
    queue = read(spark, d, "events").select(F.col("user_id").cast("long").alias("id"), F.col("ts").alias("enqueued_at"))
    m = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("subject"), F.col("text").alias("body"))
    return o.repaired(queue, m)


@add("thr_read", """WITH u AS (SELECT conv_id, text, min(turn) AS turn FROM conversations GROUP BY conv_id, text), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS k FROM u)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS place, greatest(0, k - 3) AS omitted FROM n WHERE back <= 3""")
def thr_read(spark, d):
    """Of each conversation the newest three deliveries, oldest first, and how many earlier ones are left out."""
    u = read(spark, d, "conversations").groupBy("conv_id", "text").agg(F.min("turn").alias("turn"))
    w = Window.partitionBy("conv_id")
    n = u.withColumn("back", F.row_number().over(w.orderBy(F.desc("turn")))).withColumn("k", F.count("*").over(w)).filter("back <= 3")
    return n.select("conv_id", "turn", F.row_number().over(w.orderBy("turn")).alias("place"), F.greatest(F.lit(0), F.col("k") - 3).alias("omitted"))
