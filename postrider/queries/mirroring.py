"""Mirror maintenance: upserts, reconciliation, flags, counters, progress, health, schedules."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import mirror as o
from ..sources.tables import SQL, attachments, live_messages, messages, read
from . import Group

group = Group()
add = group.add


@add("snk_upsert_msg", f"""WITH {SQL}, t AS (SELECT id, account, size, deleted FROM m_all WHERE id % 3 <> 0),
b AS (SELECT id, account, size + 1 AS size FROM m_all WHERE id % 2 = 0)
SELECT coalesce(b.id, t.id) AS id, coalesce(b.account, t.account) AS account, coalesce(b.size, t.size) AS size, CASE WHEN b.id IS NULL THEN t.deleted ELSE false END AS deleted FROM t FULL JOIN b ON t.id = b.id""")
def snk_upsert_msg(spark, d):
    """Insert or replace by key; what is sent again is alive again."""
    a = messages(spark, d)
    target = a.filter("id % 3 <> 0").select("id", "account", "size", "deleted")
    batch = a.filter("id % 2 = 0").select("id", "account", (F.col("size") + 1).alias("size"), F.lit(False).alias("deleted"))
    return o.upserted(target, batch, ["id"])


@add("snk_upsert_att", f"""WITH {SQL}, b AS (SELECT message_id, part, 'new.pdf' AS filename, bytes FROM a WHERE message_id % 15 = 0)
SELECT a.message_id, a.part, coalesce(b.filename, a.filename) AS filename, a.bytes FROM a LEFT JOIN b USING (message_id, part)""")
def snk_upsert_att(spark, d):
    a = attachments(spark, d).select("message_id", "part", "filename", "bytes")
    return o.upserted(a, a.filter("message_id % 15 = 0").withColumn("filename", F.lit("new.pdf")), ["message_id", "part"])


@add("snk_upsert_folder", f"""WITH {SQL}, t AS (SELECT DISTINCT account, folder, CASE WHEN folder = 'fr' THEN 'MISSING' ELSE 'ACTIVE' END AS status FROM m_all WHERE folder <> 'es'),
b AS (SELECT DISTINCT account, folder FROM m_all WHERE account < 'src2')
SELECT coalesce(t.account, b.account) AS account, coalesce(t.folder, b.folder) AS folder, CASE WHEN b.folder IS NULL THEN status WHEN status IS NULL OR status IN ('MISSING', 'PENDING_VERIFICATION') THEN 'PENDING' ELSE status END AS status
FROM t FULL JOIN b ON t.account = b.account AND t.folder = b.folder""")
def snk_upsert_folder(spark, d):
    """Folders that come back are pending; those not listed keep their state."""
    f = messages(spark, d).select("account", "folder").distinct()
    t = f.filter("folder <> 'es'").withColumn("status", F.when(F.col("folder") == "fr", "MISSING").otherwise("ACTIVE"))
    j = t.join(f.filter("account < 'src2'").withColumn("listed", F.lit(True)), ["account", "folder"], "outer")
    again = F.col("status").isNull() | F.col("status").isin("MISSING", "PENDING_VERIFICATION")
    return j.select("account", "folder", F.when(F.col("listed").isNull(), F.col("status")).when(again, "PENDING").otherwise(F.col("status")).alias("status"))


@add("snk_assign", f"""WITH {SQL}, old AS (SELECT id, md5(account) AS h FROM m_all WHERE id % 4 <> 0), new AS (SELECT id, md5(CASE WHEN id % 10 = 0 THEN folder ELSE account END) AS h FROM m_all)
SELECT new.id, new.h FROM new LEFT JOIN old ON old.id = new.id AND old.h = new.h WHERE old.id IS NULL""")
def snk_assign(spark, d):
    """Assignments that changed since the run before; equal ones are skipped."""
    a = messages(spark, d)
    old = a.filter("id % 4 <> 0").select("id", F.md5("account").alias("h"))
    new = a.select("id", F.md5(F.when(F.col("id") % 10 == 0, F.col("folder")).otherwise(F.col("account"))).alias("h"))
    return new.join(old, ["id", "h"], "left_anti")


@add("snk_event_log", "SELECT event_id, '{\"type\":\"' || event_type || '\",\"user\":' || user_id || '}' AS payload FROM events")
def snk_event_log(spark, d):
    return read(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("payload"))


LISTED = "mirror AS (SELECT event_id AS uid, event_id % 7 = 0 AS deleted, CASE WHEN event_id % 14 = 0 THEN 'RECONCILE_MISSING' WHEN event_id % 7 = 0 THEN 'USER' END AS reason FROM events WHERE event_id % 5 <> 0), listed AS (SELECT event_id AS uid FROM events WHERE event_id % 11 <> 0)"


def sides(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("uid"))
    reason = F.when(F.col("uid") % 14 == 0, "RECONCILE_MISSING").when(F.col("uid") % 7 == 0, "USER")
    return e.filter("uid % 5 <> 0").select("uid", (F.col("uid") % 7 == 0).alias("deleted"), reason.alias("reason")), e.filter("uid % 11 <> 0")


def reconcile(name, action, where):
    @add(name, f"WITH {LISTED} SELECT coalesce(m.uid, l.uid) AS uid FROM mirror m FULL JOIN listed l ON m.uid = l.uid WHERE {where}")
    def _(spark, d):
        return o.reconciled(*sides(spark, d), 900).filter(F.col("action") == action).select("uid")


reconcile("mir_reconcile_mark", "mark", "NOT m.deleted AND l.uid IS NULL AND m.uid < 900")
reconcile("mir_reconcile_revive", "revive", "m.deleted AND l.uid IS NOT NULL AND m.reason = 'RECONCILE_MISSING'")
reconcile("mir_reconcile_missing", "missing", "m.uid IS NULL")


@add("mir_reconcile_guard", "SELECT count(DISTINCT event_id) = (SELECT count(*) FROM events) AS complete FROM events WHERE event_id % 11 <> 0")
def mir_reconcile_guard(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("uid"))
    return spark.createDataFrame([(o.is_complete(e.filter("uid % 11 <> 0"), e.count()),)], "complete boolean")


@add("mir_vanished", f"WITH {SQL} SELECT id, deleted OR id % 19 = 0 AS deleted FROM m_all")
def mir_vanished(spark, d):
    a = messages(spark, d).select("id", "deleted")
    gone = a.filter("id % 19 = 0").select("id", F.lit(True).alias("gone"))
    return a.join(gone, "id", "left").select("id", (F.col("deleted") | F.coalesce("gone", F.lit(False))).alias("deleted"))


NORMAL = "list_sort(list_distinct(list_transform(coalesce({0}, []), lambda x: lower(trim(x)))))"


@add("mir_flag_diff", f"""WITH {SQL}, s AS (SELECT id, CASE WHEN id % 8 = 0 THEN ['\\SEEN ', '\\Flagged'] ELSE flags END AS f FROM m_all)
SELECT m.id, {NORMAL.format('flags')} AS old, {NORMAL.format('f')} AS new FROM m_all m JOIN s USING (id) WHERE {NORMAL.format('flags')} <> {NORMAL.format('f')}""")
def mir_flag_diff(spark, d):
    a = messages(spark, d)
    seen = F.when(F.col("id") % 8 == 0, F.array(F.lit("\\SEEN "), F.lit("\\Flagged"))).otherwise(F.col("flags"))
    return o.flag_changes(a, a.select("id", seen.alias("flags")))


@add("mir_uidvalidity_reset", f"""WITH {SQL}, r AS (SELECT account, folder, count(*) FILTER (WHERE id % 50 = 0) AS resets FROM m_all GROUP BY ALL)
SELECT account, folder, CASE WHEN resets > 2 THEN 'BROKEN' WHEN resets > 0 THEN 'RESET' ELSE 'ACTIVE' END AS status FROM r""")
def mir_uidvalidity_reset(spark, d):
    """More than two changes of generation in the window break a folder."""
    n = F.count_if(F.col("id") % 50 == 0)
    return messages(spark, d).groupBy("account", "folder").agg(F.when(n > 2, "BROKEN").when(n > 0, "RESET").otherwise("ACTIVE").alias("status"))


@add("mir_folder_missing", f"""WITH {SQL}, f AS (SELECT account, folder, max(date) AS last FROM m_all GROUP BY ALL), listed AS (SELECT DISTINCT account, folder FROM m_all WHERE folder IN ('en', 'de'))
SELECT f.account, f.folder, CASE WHEN l.folder IS NOT NULL THEN 'ACTIVE' WHEN last < TIMESTAMP '2024-01-26' THEN 'MISSING' ELSE 'PENDING_VERIFICATION' END AS status FROM f LEFT JOIN listed l USING (account, folder)""")
def mir_folder_missing(spark, d):
    """Absent folders wait a grace period before they count as missing."""
    f = messages(spark, d).groupBy("account", "folder").agg(F.max("date").alias("last"))
    listed = messages(spark, d).filter(F.col("folder").isin("en", "de")).select("account", "folder", F.lit(True).alias("l")).distinct()
    late = F.col("last") < F.lit("2024-01-26").cast("timestamp_ntz")
    return f.join(listed, ["account", "folder"], "left").select("account", "folder", F.when(F.col("l"), "ACTIVE").when(late, "MISSING").otherwise("PENDING_VERIFICATION").alias("status"))


@add("mir_relocate", f"""WITH {SQL}, mv AS (SELECT id, 'fr' AS target FROM m_all WHERE id % 12 = 0), taken AS (SELECT account, folder, md5(body) AS h FROM m_all)
SELECT m.id, CASE WHEN mv.id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.account = m.account AND t.folder = mv.target AND t.h = md5(m.body)) THEN mv.target ELSE m.folder END AS folder FROM m_all m LEFT JOIN mv USING (id)""")
def mir_relocate(spark, d):
    """A confirmed move keeps the id if the target place is free."""
    a = messages(spark, d).select("id", "account", "folder", F.md5("body").alias("h"))
    free = a.filter("id % 12 = 0").withColumn("target", F.lit("fr"))
    taken = a.select(F.col("account").alias("ta"), F.col("folder").alias("tf"), F.col("h").alias("th"))
    free = free.join(taken, (F.col("account") == F.col("ta")) & (F.col("target") == F.col("tf")) & (F.col("h") == F.col("th")), "left_anti").select("id", "target")
    return a.join(free, "id", "left").select("id", F.coalesce("target", "folder").alias("folder"))


@add("mir_progress", f"""WITH {SQL} SELECT account, count(*) AS total, count(*) FILTER (WHERE id % 3 <> 0) AS fetched,
CASE WHEN count(*) = 0 THEN 100 ELSE least(100, (count(*) FILTER (WHERE id % 3 <> 0) * 200 + count(*)) // (count(*) * 2)) END::INT AS pct, max(date) AS newest FROM m GROUP BY account""")
def mir_progress(spark, d):
    g = live_messages(spark, d).groupBy("account").agg(F.count("*").alias("total"), F.count_if(F.col("id") % 3 != 0).alias("fetched"), F.max("date").alias("newest"))
    return g.withColumn("pct", o.percent(F.col("fetched"), F.col("total")))


@add("mir_folder_progress", f"""WITH {SQL}, t AS (SELECT account, folder, count(*) AS target FROM m_all GROUP BY ALL), h AS (SELECT account, folder, count(*) AS have FROM m GROUP BY ALL)
SELECT account, folder, least(100, (coalesce(have, 0) * 200 + target) // (target * 2))::INT AS pct FROM t LEFT JOIN h USING (account, folder)""")
def mir_folder_progress(spark, d):
    t = messages(spark, d).groupBy("account", "folder").agg(F.count("*").alias("target"))
    h = live_messages(spark, d).groupBy("account", "folder").agg(F.count("*").alias("have"))
    return t.join(h, ["account", "folder"], "left").select("account", "folder", o.percent(F.coalesce("have", F.lit(0)), F.col("target")).alias("pct"))


@add("mir_health", """WITH h AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS failures, bool_or(event_type = 'purchase' AND value > 150) AS stuck, count(*) > 40 AS complete FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN failures >= 10 THEN 'BROKEN' WHEN stuck OR failures > 0 THEN 'DEGRADED' WHEN NOT complete THEN 'INITIAL_SYNC' ELSE 'HEALTHY' END AS health FROM h""")
def mir_health(spark, d):
    e = F.col("event_type")
    g = read(spark, d, "events").groupBy("user_id").agg(F.count_if(e == "error").alias("failures"), F.bool_or((e == "purchase") & (F.col("value") > 150)).alias("stuck"), (F.count("*") > 40).alias("complete"))
    return g.select("user_id", o.health(F.col("stuck"), F.col("failures"), F.col("complete")).alias("health"))


@add("mir_due_folders", f"""WITH {SQL}, f AS (SELECT account, folder, max(date) AS last FROM m GROUP BY ALL)
SELECT account, folder, CASE WHEN folder = 'en' THEN 0 ELSE 1 END AS lane, row_number() OVER (PARTITION BY account, folder = 'en' ORDER BY last, folder)::INT AS turn FROM f WHERE last < TIMESTAMP '2024-01-27'""")
def mir_due_folders(spark, d):
    """A lane for preferred folders, and one in turns for the others."""
    f = live_messages(spark, d).groupBy("account", "folder").agg(F.max("date").alias("last")).filter(F.col("last") < F.lit("2024-01-27").cast("timestamp_ntz"))
    lane = F.when(F.col("folder") == "en", 0).otherwise(1)
    return f.withColumn("lane", lane).withColumn("turn", F.row_number().over(Window.partitionBy("account", "lane").orderBy("last", "folder"))).drop("last")


@add("mir_body_backlog", f"WITH {SQL} SELECT id, row_number() OVER (PARTITION BY account ORDER BY deleted, CASE WHEN folder = 'en' THEN 1 ELSE 100 END, id DESC)::INT AS place FROM m_all WHERE id % 3 = 0")
def mir_body_backlog(spark, d):
    """Bodies to fetch: the living first, then by folder priority, the newest first."""
    w = Window.partitionBy("account").orderBy("deleted", F.when(F.col("folder") == "en", 1).otherwise(100), F.desc("id"))
    return messages(spark, d).filter("id % 3 = 0").select("id", F.row_number().over(w).alias("place"))


@add("mir_priority", "SELECT n_name, CASE WHEN lower(n_name) = 'inbox' THEN 1 WHEN lower(n_name) LIKE 'sent%' THEN 5 ELSE 100 END AS priority FROM (SELECT n_name FROM nation UNION ALL SELECT unnest(['Inbox', 'Sent Mail', 'sent']))")
def mir_priority(spark, d):
    more = spark.createDataFrame([("Inbox",), ("Sent Mail",), ("sent",)], "n_name string")
    return read(spark, d, "nation").select("n_name").union(more).select("n_name", o.priority(F.col("n_name")).alias("priority"))


@add("mir_list_folders", f"""WITH {SQL}, c AS (SELECT account, folder, count(*) AS messages FROM m GROUP BY ALL), t AS (SELECT DISTINCT account, folder FROM m_all)
SELECT account, folder, coalesce(messages, 0)::BIGINT AS messages, sum(coalesce(messages, 0)) OVER (PARTITION BY account)::BIGINT AS total FROM t LEFT JOIN c USING (account, folder)""")
def mir_list_folders(spark, d):
    c = o.folder_counts(live_messages(spark, d)).select("account", "folder", "messages")
    t = messages(spark, d).select("account", "folder").distinct().join(c, ["account", "folder"], "left")
    t = t.withColumn("messages", F.coalesce("messages", F.lit(0)).cast("long"))
    return t.withColumn("total", F.sum("messages").over(Window.partitionBy("account")))


@add("mir_close_orphans", "SELECT event_id, CASE WHEN event_type = 'signup' AND ts < TIMESTAMP '2024-01-29 23:00' AND ts > TIMESTAMP '2024-01-20' THEN 'failed' ELSE event_type END AS status FROM events")
def mir_close_orphans(spark, d):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    old = (F.col("event_type") == "signup") & (F.col("ts") < at("2024-01-29 23:00:00")) & (F.col("ts") > at("2024-01-20"))
    return read(spark, d, "events").select("event_id", F.when(old, "failed").otherwise(F.col("event_type")).alias("status"))


@add("mir_idle_watch", f"WITH {SQL} SELECT DISTINCT account FROM m WHERE EXISTS (SELECT 1 FROM m x WHERE x.account = m.account AND x.folder = 'es' AND x.size > 3000)")
def mir_idle_watch(spark, d):
    warm = live_messages(spark, d).filter("folder = 'es' and size > 3000").select("account").distinct()
    return live_messages(spark, d).select("account").distinct().join(warm, "account", "left_semi")


@add("agg_delta_apply", f"""WITH {SQL} SELECT account, folder, count(*) AS messages, count(*) FILTER (WHERE NOT list_contains(coalesce(flags, []), '\\Seen')) AS unread FROM m_all WHERE id % 4 <> 0 OR id % 5 = 0 GROUP BY ALL""")
def agg_delta_apply(spark, d):
    """Counts kept by signed changes equal a fresh count."""
    a = messages(spark, d)
    stored = o.folder_counts(a.filter("id % 4 <> 0 or id % 3 = 0"))
    out = o.applied_deltas(stored, a.filter("id % 4 = 0 and id % 3 = 0 and id % 5 <> 0"), a.filter("id % 4 = 0 and id % 5 = 0 and id % 3 <> 0"))
    return out.filter("messages > 0")


NOW = "2024-02-10 00:00:00"


def at(t):
    return F.lit(t).cast("timestamp_ntz")


@add("mir_purge", f"""WITH {SQL}, t AS (SELECT *, ['expunged', 'folder_deleted', 'moved'][id % 3 + 1] AS reason FROM m_all WHERE deleted), p AS (SELECT * FROM t WHERE reason <> 'moved' AND date <= TIMESTAMP '{NOW}' - INTERVAL 30 DAY)
SELECT id, 'purge' AS what FROM p UNION ALL SELECT DISTINCT m.id, 'recheck' FROM m JOIN p ON p.account = m.account AND p.provider_thread = m.provider_thread""")
def mir_purge(spark, d):
    """Old tombstones of two reasons go; the living rows of their threads are looked at again."""
    a = messages(spark, d)
    reason = F.element_at(F.array(F.lit("expunged"), F.lit("folder_deleted"), F.lit("moved")), (F.col("id") % 3 + 1).cast("int"))
    gone = o.purged(a.filter("deleted").withColumn("reason", reason).withColumn("deleted_at", F.col("date")), at(NOW))
    near = live_messages(spark, d).join(gone.select("account", "provider_thread").distinct(), ["account", "provider_thread"], "left_semi")
    return gone.select("id", F.lit("purge").alias("what")).union(near.select("id", F.lit("recheck")))


@add("mir_prune_events", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-02-10' - INTERVAL 25 DAY")
def mir_prune_events(spark, d):
    """Events within the days of retention; what is older goes as whole files, in no batches."""
    return read(spark, d, "events").filter(F.col("ts") >= at(NOW) - F.make_dt_interval(days=F.lit(25))).select("event_id")


@add("mir_failure", f"""WITH f AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') % 13 AS n, min(ts) FILTER (WHERE event_type = 'error') AS since FROM events GROUP BY user_id)
SELECT user_id, n, CASE WHEN n > 0 THEN round(least(300.0::DOUBLE, pow(2.0::DOUBLE, least(n - 1, 30))) * (0.7::DOUBLE + 0.6::DOUBLE * (user_id % 1000) / 1000.0::DOUBLE), 3) END AS wait,
CASE WHEN n >= 10 THEN 'BROKEN' WHEN n > 0 AND since <= TIMESTAMP '2024-01-10' - INTERVAL 168 HOUR THEN 'STUCK_WEEK' WHEN n > 0 AND since <= TIMESTAMP '2024-01-10' - INTERVAL 24 HOUR THEN 'STUCK_DAY' WHEN n > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS state FROM f""")
def mir_failure(spark, d):
    """How long to wait after failures in a row, and what the account is then called."""
    error = F.col("event_type") == "error"
    f = read(spark, d, "events").groupBy("user_id").agg((F.count_if(error) % 13).alias("n"), F.min(F.when(error, F.col("ts"))).alias("since"))
    wait = F.when(F.col("n") > 0, o.jittered(F.col("n"), F.col("user_id")))
    return f.select("user_id", "n", wait.alias("wait"), o.failure_state(F.col("n"), F.col("since"), at("2024-01-10 00:00:00")).alias("state"))


@add("mir_runnable", """WITH g AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'purchase') AS finished, count(*) FILTER (WHERE event_type = 'error') AS n FROM events GROUP BY user_id)
SELECT user_id, finished FROM g WHERE n < 20 AND user_id % 11 <> 0 ORDER BY finished NULLS FIRST, user_id""")
def mir_runnable(spark, d):
    """Accounts that may run (not paused, not broken), those that never finished first, then the longest waiting."""
    e = F.col("event_type")
    g = read(spark, d, "events").groupBy("user_id").agg(F.max(F.when(e == "purchase", F.col("ts"))).alias("finished"), F.count_if(e == "error").alias("n"))
    return g.filter("n < 20 AND user_id % 11 <> 0").select("user_id", "finished").orderBy(F.col("finished").asc_nulls_first(), "user_id")


@add("mir_history_backlog", f"""WITH {SQL}, f AS (SELECT account, folder, count(*) AS have, max(id) AS head, min(id) AS tail FROM m_all GROUP BY ALL)
SELECT account, folder, CASE WHEN have < 3 THEN 'snapshot' ELSE 'metadata' END AS need, tail AS below FROM f WHERE have < 3 OR tail > 20""")
def mir_history_backlog(spark, d):
    """Folders that lack their snapshot, or rows below the oldest that is there."""
    f = messages(spark, d).groupBy("account", "folder").agg(F.count("*").alias("have"), F.min("id").alias("below"))
    return f.filter("have < 3 OR below > 20").select("account", "folder", F.when(F.col("have") < 3, "snapshot").otherwise("metadata").alias("need"), "below")


@add("mir_folder_alias", f"""WITH {SQL}, r AS (SELECT account, unnest([folder, folder || '/copy']) AS folder, id AS uid, md5(body) AS digest FROM m),
f AS (SELECT account, folder, 7 AS v, max(uid) + 1 AS nx, count(*) - max((folder = 'de/copy')::INT) AS n FROM r GROUP BY ALL),
s AS (SELECT account, folder, list(uid || digest ORDER BY uid) AS sample FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY account, folder ORDER BY uid DESC) <= 5) GROUP BY ALL),
j AS (SELECT *, min(folder) OVER (PARTITION BY account, v, nx, n, sample) AS alias FROM f JOIN s USING (account, folder)) SELECT account, folder, alias FROM j WHERE folder <> alias""")
def mir_folder_alias(spark, d):
    """Every folder is there under two names; one of the second names differs in its status."""
    r = live_messages(spark, d).select("account", F.explode(F.array(F.col("folder"), F.concat("folder", F.lit("/copy")))).alias("folder"), F.col("id").alias("uid"), F.md5("body").alias("digest"))
    f = r.groupBy("account", "folder").agg(F.lit(7).alias("uidvalidity"), (F.max("uid") + 1).alias("uidnext"), (F.count("*") - F.max((F.col("folder") == "de/copy").cast("int"))).alias("n"))
    return o.aliases(f, r)


@add("mir_sync_status", f"""WITH {SQL}, s AS (SELECT account, count(*) FILTER (WHERE id % 3 = 0) AS b, count(*) FILTER (WHERE deleted) AS g, count(DISTINCT folder) FILTER (WHERE id % 5 = 0) AS f, (account = 'src1')::BIGINT AS x FROM m_all GROUP BY account),
l AS (SELECT account, list_filter([CASE WHEN x > 0 THEN 'broken' END, CASE WHEN f > 0 THEN 'missing_folders' END, CASE WHEN b > 0 THEN 'missing_bodies' END, CASE WHEN g > 0 THEN 'pending_deletions' END], lambda v: v IS NOT NULL) AS r FROM s)
SELECT account, array_to_string(r, ', ') AS reasons, len(r) = 0 AS fully_synced, CASE WHEN len(r) = 0 THEN 'Everything is here.' ELSE len(r) || ' open, first: ' || r[1] || '.' END AS summary FROM l""")
def mir_sync_status(spark, d):
    """What is open, the most severe first, and a sentence on it."""
    g = messages(spark, d).groupBy("account").agg(
        F.count_if(F.col("id") % 3 == 0).alias("b"), F.count_if("deleted").alias("g"), F.countDistinct(F.when(F.col("id") % 5 == 0, F.col("folder"))).alias("f"))
    r = g.select("account", o.status_reasons(broken=(F.col("account") == "src1").cast("int"), missing_folders=F.col("f"), missing_bodies=F.col("b"), pending_deletions=F.col("g")).alias("r"))
    names = F.transform("r", lambda x: x["reason"])
    open_ = F.concat(F.size("r").cast("string"), F.lit(" open, first: "), F.get(names, F.lit(0)), F.lit("."))
    return r.select("account", F.array_join(names, ", ").alias("reasons"), (F.size("r") == 0).alias("fully_synced"), F.when(F.size("r") == 0, "Everything is here.").otherwise(open_).alias("summary"))


@add("mir_unchanged_proof", f"""WITH {SQL}, s AS (SELECT account, folder, count(*) AS n, max(id) + 1 AS nx, sum(size) AS ms FROM m GROUP BY ALL), p AS (SELECT account, folder, count(*) FILTER (WHERE NOT deleted OR folder = 'de') AS n, max(id) FILTER (WHERE NOT deleted) + 1 AS nx, sum(size) FILTER (WHERE NOT deleted) AS ms FROM m_all GROUP BY ALL),
k AS (SELECT p.account, p.folder FROM p JOIN s USING (account, folder, n, nx, ms) WHERE folder <> 'fr') SELECT *, true AS unchanged FROM k UNION ALL SELECT account, folder, false FROM p WHERE (account, folder) NOT IN (SELECT * FROM k)""")
def mir_unchanged_proof(spark, d):
    """A status equal in all cursors after a clean audit proves that nothing changed; folder fr was not clean, de counts its deleted rows."""
    a = messages(spark, d)
    there = ~F.col("deleted")
    stored = a.filter(there).groupBy("account", "folder").agg(F.lit(1).alias("uidvalidity"), (F.max("id") + 1).alias("uidnext"), F.count("*").alias("n"), F.sum("size").alias("modseq"), (F.first("folder") != "fr").alias("clean"))
    seen = a.groupBy("account", "folder").agg(F.lit(1).alias("uidvalidity"), (F.max(F.when(there, F.col("id"))) + 1).alias("uidnext"), F.count_if(there | (F.col("folder") == "de")).alias("n"), F.sum(F.when(there, F.col("size"))).alias("modseq"))
    proven, changed = o.proven_unchanged(stored, seen)
    return proven.withColumn("unchanged", F.lit(True)).union(changed.withColumn("unchanged", F.lit(False)))


@add("mir_pending_verif", f"""WITH {SQL}, f AS (SELECT account, folder, CASE WHEN folder = 'fr' THEN TIMESTAMP '2024-01-05' END AS missing_since FROM m_all GROUP BY ALL), t AS (SELECT DISTINCT account, folder FROM m_all WHERE id % 3 = 0)
SELECT f.account, f.folder, CASE WHEN t.account IS NULL THEN 'PENDING_VERIFICATION' ELSE 'ACTIVE' END AS status, CASE WHEN t.account IS NULL THEN coalesce(missing_since, TIMESTAMP '{NOW}') END AS missing_since FROM f LEFT JOIN t USING (account, folder)""")
def mir_pending_verif(spark, d):
    """A folder that is missing keeps the time when it was first missed."""
    f = messages(spark, d).groupBy("account", "folder").agg(F.first(F.when(F.col("folder") == "fr", at("2024-01-05 00:00:00"))).alias("missing_since"))
    return o.pending(f, messages(spark, d).filter("id % 3 = 0"), at(NOW))


@add("mir_flag_merge_progress", f"WITH {SQL}, h AS (SELECT account, folder, count(*) AS n FROM m_all WHERE id % 3 = 0 GROUP BY ALL), b AS (SELECT account, folder, count(*) AS new FROM m_all WHERE id % 2 = 0 AND id % 3 <> 0 GROUP BY ALL) SELECT account, folder, coalesce(n, 0) + coalesce(new, 0) AS headers FROM h FULL JOIN b USING (account, folder)")
def mir_flag_merge_progress(spark, d):
    """A folder's counter grows by the keys that were not there; a batch that repeats, here twice, adds nothing more."""
    a = messages(spark, d).select("account", "folder", "id")
    stored, batch = a.filter("id % 3 = 0"), a.filter("id % 2 = 0")
    new = batch.union(batch).distinct().join(stored, ["account", "folder", "id"], "left_anti")
    return stored.union(new).groupBy("account", "folder").agg(F.count("*").alias("headers"))


@add("mir_split_batches", f"""WITH RECURSIVE {SQL}, n AS (SELECT account, id, size AS bytes, id % 4 AS parts, row_number() OVER (PARTITION BY account ORDER BY id) AS i FROM m),
w AS (SELECT account, id, i, 0 AS batch, 1 AS rows, bytes, parts FROM n WHERE i = 1 UNION ALL
SELECT n.account, n.id, n.i, w.batch + full_::INT, CASE WHEN full_ THEN 1 ELSE w.rows + 1 END, CASE WHEN full_ THEN n.bytes ELSE w.bytes + n.bytes END, CASE WHEN full_ THEN n.parts ELSE w.parts + n.parts END
FROM w JOIN n ON n.account = w.account AND n.i = w.i + 1, LATERAL (SELECT w.rows >= 20 OR w.bytes + n.bytes > 30000 OR w.parts + n.parts > 25 AS full_)) SELECT account, id, batch FROM w""")
def mir_split_batches(spark, d):
    """Writes of at most 20 rows, 30,000 bytes and 25 attachments for each account."""
    rows = live_messages(spark, d).select("account", "id", F.col("size").cast("long").alias("bytes"), (F.col("id") % 4).alias("parts"))
    return o.packed(rows, "account", "id", most_rows=20, most_bytes=30_000, most_parts=25).select("account", "id", "batch")


@add("mir_partial", """SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS state, 0 AS failures, max(ts) AS last_success, count(*) FILTER (WHERE event_type <> 'error') AS done FROM events GROUP BY user_id""")
def mir_partial(spark, d):
    """A pass in which some folders failed degrades the account, but counts as a success: no failures in a row, and a time."""
    bad = F.count_if(F.col("event_type") == "error")
    return read(spark, d, "events").groupBy("user_id").agg(F.when(bad > 0, "DEGRADED").otherwise("HEALTHY").alias("state"), F.lit(0).alias("failures"), F.max("ts").alias("last_success"), F.count_if(F.col("event_type") != "error").alias("done"))
