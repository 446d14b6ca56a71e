"""Queries over change feeds: events as changes of folders, labels as parts that come late."""

import datetime
import uuid

from pyspark.sql import functions as F

from ..operators.conversations import conversations, evidence
from ..operators.incremental import Maintained
from ..plans.staging import shared_dir
from ..sources.tables import read
from ..streaming.expiry import by_day, expire, unexpired
from ..streaming.feeds import completed, drained, feed, latest, live, once, timed
from ..streaming.mailboxes import folder_changes, folder_state
from ..streaming.scans import ResumableScan, typed_changes
from . import Group
from .identity import ROW

group = Group()
add = group.add


@add("stm_counts", "SELECT event_type AS folder, count(*) AS messages, count(*) FILTER (value < 50) AS unread FROM events GROUP BY 1")
def stm_counts(spark, sf_dir):
    e = feed(spark, sf_dir, "events")
    return drained(e.groupBy(F.col("event_type").alias("folder")).agg(F.count("*").alias("messages"), F.count_if(F.col("value") < 50).alias("unread")), ("folder",))


@add("stm_idempotent", "SELECT DISTINCT event_id, event_type FROM events")
def stm_idempotent(spark, sf_dir):
    twice = feed(spark, sf_dir, "events").unionByName(feed(spark, sf_dir, "events"))
    return drained(once(timed(twice, "ts", "60 days"), "event_id").select("event_id", "event_type"))


@add("stm_window", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2")
def stm_window(spark, sf_dir):
    day = F.window("ts", "1 day")
    e = timed(feed(spark, sf_dir, "events"), "ts", "60 days").groupBy(day, "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    kept = drained(e.select(F.col("window.start").alias("day"), "event_type", "n", "top"), ("day", "event_type"))
    return kept.withColumn("day", F.col("day").cast("timestamp_ntz"))


@add("stm_live_window", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 14 DAY")
def stm_live_window(spark, sf_dir):
    clock = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return drained(live(feed(spark, sf_dir, "events"), "ts", clock, 14).select("event_id", "user_id"))


@add("stm_wake_priority", "SELECT user_id, max(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END) AS priority FROM events GROUP BY 1")
def stm_wake_priority(spark, sf_dir):
    p = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1)
    return drained(feed(spark, sf_dir, "events").groupBy("user_id").agg(F.max(p).alias("priority")), ("user_id",))


@add("stm_dirty_queue", "SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id, count(*) AS changes FROM events GROUP BY 1")
def stm_dirty_queue(spark, sf_dir):
    return drained(latest(feed(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type"), ("user_id",))


@add("stm_late_body", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)")
def stm_late_body(spark, sf_dir):
    rows = drained(completed(feed(spark, sf_dir, "documents"), feed(spark, sf_dir, "labels"), "doc_id", "quality"), ("doc_id",))
    return rows.filter("is_head = 1").select("doc_id", "quality")


@add("stm_emit_scan", "SELECT event_id, ts, event_type FROM events")
def stm_emit_scan(spark, sf_dir):
    """All events in pages by (time, id), each written together with the cursor that the next one starts from."""
    rows = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type")
    scan = ResumableScan(spark, f"{shared_dir(spark)}/scan-{uuid.uuid4().hex}", ("ts", "event_id"))
    scan.run(rows, page=max(1000, rows.count() // 4))
    return scan.emitted().select("event_id", "ts", "event_type")


@add("stm_hooks", """WITH a AS (SELECT user_id, count(*) AS n, max(event_type) AS last FROM events WHERE event_id < 700 GROUP BY 1), b AS (SELECT user_id, count(*) AS n, max(event_type) AS last FROM events WHERE event_id >= 300 GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'created' WHEN b.user_id IS NULL THEN 'deleted' ELSE 'updated' END AS kind,
  array_to_string(list_filter([CASE WHEN a.n IS DISTINCT FROM b.n THEN 'n' END, CASE WHEN a.last IS DISTINCT FROM b.last THEN 'last' END], lambda x: x IS NOT NULL), ',') AS changed
FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.n IS DISTINCT FROM b.n OR a.last IS DISTINCT FROM b.last""")
def stm_hooks(spark, sf_dir):
    """Typed changes between two states of a table: rows that came, went, or differ, with the columns that do."""
    state = lambda where: read(spark, sf_dir, "events").filter(where).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_type").alias("last"))
    return typed_changes(state("event_id < 700"), state("event_id >= 300"), "user_id").select("user_id", "kind", F.array_join("changed", ",").alias("changed"))


@add("stm_cursor", """WITH g AS (SELECT event_type AS folder, max(user_id % 3) AS generation FROM events GROUP BY 1)
SELECT folder, generation, max(event_id) AS last_uid, max(floor(value))::BIGINT AS highest_modseq FROM g JOIN events ON event_type = folder AND user_id % 3 = generation GROUP BY ALL""")
def stm_cursor(spark, sf_dir):
    """Cursors of the newest generation of a folder; within it they only rise, and a new generation starts them anew."""
    e = feed(spark, sf_dir, "events").select(F.col("event_type").alias("folder"), (F.col("user_id") % 3).alias("generation"), "event_id", F.floor("value").alias("modseq"))
    c = e.groupBy("folder").agg(F.max(F.struct("generation", "event_id")).alias("u"), F.max(F.struct("generation", "modseq")).alias("s"))
    return drained(c.select("folder", F.col("u.generation").alias("generation"), F.col("u.event_id").alias("last_uid"), F.col("s.modseq").alias("highest_modseq")), ("folder",))


@add("stm_cursor_safety", """SELECT user_id % 20 AS folder, max(event_id) AS seen, coalesce(max(event_id) FILTER (WHERE event_type = 'click' AND value < 50), 0) AS flag_cursor, coalesce(max(event_id) FILTER (WHERE event_type = 'error' AND value < 20), 0) AS deletion_cursor FROM events GROUP BY 1""")
def stm_cursor_safety(spark, sf_dir):
    """The cursors of flags and of deletions advance apart, and only with what was proven."""
    e, i = F.col("event_type"), F.col("event_id")
    proven = lambda kind, most: F.coalesce(F.max(F.when((e == kind) & (F.col("value") < most), i)), F.lit(0))
    return drained(feed(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("folder")).agg(F.max(i).alias("seen"), proven("click", 50).alias("flag_cursor"), proven("error", 20).alias("deletion_cursor")), ("folder",))


@add("stm_late_parent", """WITH t AS (SELECT *, CASE WHEN turn = 0 THEN 0 ELSE (turn - 2) // 4 * 4 + 1 END AS root FROM conversations WHERE turn % 4 <> 1)
SELECT conv_id, turn, 'thread_' || substr(sha256('postrider-thread-v1' || chr(0) || 'acc' || chr(0) || 'reference:c' || conv_id || '.' || root), 1, 32) AS conversation_id, turn > 0 AS provisional FROM t""")
def stm_late_parent(spark, sf_dir):
    """Answers that come before what they answer: parts of a conversation meet when the parent comes, and its name is that of any other order. A parent that never comes is a placeholder, and the name provisional."""
    turn = F.col("turn")
    name = lambda t: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), t.cast("string"))
    none = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in ROW.split(", ")}
    t = read(spark, sf_dir, "conversations").filter(turn % 4 != 1)
    rows = t.select(*[c.alias(n) for n, c in (none | {"id": (F.col("conv_id") * 100_000 + turn).cast("long"), "account": F.lit("acc"), "message_id": name(turn), "refs": F.when(turn > 0, F.array(name(turn - 1))).otherwise(F.array().cast("array<string>"))}).items()], F.lit(False).alias("gone"), turn.cast("long").alias("seq"))
    index = Maintained(spark, f"{shared_dir(spark)}/late-{uuid.uuid4().hex}", ROW, "delivery long, conversation_id string, provisional boolean", evidence, lambda r: conversations(r).select("id", "delivery", "conversation_id", "provisional"), buckets=8)
    # Of each group of turns the first comes last.
    index.apply(rows.filter("seq % 4 <> 2"), 0)
    index.apply(rows.filter("seq % 4 = 2"), 1)
    i = F.col("id")
    return index.current().select(F.floor(i / 100_000).cast("long").alias("conv_id"), (i % 100_000).cast("int").alias("turn"), "conversation_id", "provisional")


S = "STRUCT(v BIGINT, n BIGINT, m BIGINT, u BIGINT, s BIGINT)"
P = f"STRUCT(seq BIGINT, r BOOLEAN, f BOOLEAN, o {S})"
DIFFERS = lambda x, y, fields="vnmus": "(" + " OR ".join(f"coalesce({x}.{c} <> {y}.{c}, false)" for c in fields) + ")"
FOLDER_EVENTS = """e AS (SELECT user_id::VARCHAR AS folder, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id AS i, floor(value)::BIGINT AS x,
  CASE WHEN event_id < 300 THEN 'seed' ELSE CASE event_type WHEN 'purchase' THEN 'ack' WHEN 'error' THEN 'expunge' WHEN 'click' THEN 'observe' WHEN 'view' THEN 'exists' ELSE 'flags' END END AS kind,
  CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN -1 END AS of FROM events),
g AS (SELECT folder, seq, k, kind, of, CASE WHEN kind IN ('seed', 'observe') THEN i // 3000 END AS v, CASE WHEN kind IN ('seed', 'observe') THEN i // 500 END AS n, CASE WHEN kind = 'exists' OR (kind IN ('seed', 'observe') AND i % 4 = 0) THEN x // 20 END AS m,
  CASE WHEN kind IN ('seed', 'observe') AND i % 2 = 0 THEN x // 30 END AS u, CASE WHEN kind = 'flags' OR (kind IN ('seed', 'observe') AND i % 5 <> 0) THEN x // 10 END AS s FROM e)"""


@add("stm_change_feed", f"""WITH {FOLDER_EVENTS}, w AS (WITH RECURSIVE w(folder, k, b, p, c) AS (
  SELECT DISTINCT folder, 0::BIGINT, NULL::{S}, NULL::{P}, NULL::{P} FROM g
  UNION ALL SELECT folder, k, CASE WHEN kind = 'seed' THEN said WHEN kind = 'ack' AND known THEN p.o WHEN kind = 'observe' AND b IS NULL THEN said WHEN kind = 'observe' AND p IS NULL AND NOT {DIFFERS('now', 'b')} THEN now ELSE b END,
    CASE WHEN kind = 'ack' AND known THEN NULL WHEN c IS NOT NULL THEN c ELSE p END, c
  FROM (SELECT *, CASE WHEN kind IN ('seed', 'ack') THEN NULL
      WHEN kind = 'observe' AND b IS NULL THEN CASE WHEN p IS NOT NULL THEN {{'seq': seq, 'r': p.r, 'f': p.f, 'o': said}}::{P} END
      WHEN kind = 'observe' THEN CASE WHEN (p IS NOT NULL AND NOT {DIFFERS('now', 'p.o')}) OR (p IS NULL AND NOT {DIFFERS('now', 'b')}) THEN NULL
        ELSE {{'seq': seq, 'r': coalesce(p.r, false) OR {DIFFERS('now', 'b', 'vnm')} OR (b.m IS NULL AND {DIFFERS('now', 'b', 's')}), 'f': coalesce(p.f, false) OR {DIFFERS('now', 'b', 'su')}, 'o': now}}::{P} END
      ELSE {{'seq': seq, 'r': coalesce(p.r, false) OR kind = 'expunge', 'f': coalesce(p.f, false) OR kind = 'flags', 'o': {{'v': coalesce(now.v, 0), 'n': now.n, 'm': now.m, 'u': now.u, 's': now.s}}}}::{P} END AS c
    FROM (SELECT g.folder, g.k, g.seq, kind, b, p, p IS NOT NULL AND (of IS NULL OR of = p.seq) AS known, {{'v': g.v, 'n': g.n, 'm': g.m, 'u': g.u, 's': g.s}}::{S} AS said,
        {{'v': coalesce(g.v, p.o.v, b.v), 'n': coalesce(g.n, p.o.n, b.n), 'm': CASE WHEN kind = 'expunge' AND coalesce(p.o, b).m IS NOT NULL THEN greatest(0, coalesce(p.o, b).m - 1) ELSE coalesce(g.m, p.o.m, b.m) END, 'u': coalesce(g.u, p.o.u, b.u), 's': coalesce(g.s, p.o.s, b.s)}}::{S} AS now
      FROM w JOIN g ON g.folder = w.folder AND g.k = w.k + 1)))
  SELECT * FROM w)
SELECT folder, c.seq AS seq, c.r AS force_reconcile, c.f AS force_flag_scan, c.o.v AS uid_validity, c.o.n AS uid_next, c.o.m AS messages, c.o.u AS unseen, c.o.s AS modseq FROM w WHERE c IS NOT NULL""")
def stm_change_feed(spark, sf_dir):
    """What each event of a folder asks for, against what was acknowledged last: requests stay pending, merged, until then."""
    i, x, e = F.col("event_id"), F.floor("value"), F.col("event_type")
    kind = F.when(i < 300, "seed").when(e == "purchase", "ack").when(e == "error", "expunge").when(e == "click", "observe").when(e == "view", "exists").otherwise("flags")
    whole = kind.isin("seed", "observe")
    fields = {"uid_validity": F.when(whole, F.floor(i / 3000)), "uid_next": F.when(whole, F.floor(i / 500)), "messages": F.when((kind == "exists") | (whole & (i % 4 == 0)), F.floor(x / 20)), "unseen": F.when(whole & (i % 2 == 0), F.floor(x / 30)), "modseq": F.when((kind == "flags") | (whole & (i % 5 != 0)), F.floor(x / 10))}
    events = feed(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("folder"), i.alias("seq"), kind.alias("kind"), *[c.cast("long").alias(n) for n, c in fields.items()], F.when((e == "purchase") & (i % 3 == 0), F.lit(-1)).cast("long").alias("of"))
    with folder_state(spark):
        return drained(folder_changes(events))


@add("stm_expiry", "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 12 DAY")
def stm_expiry(spark, sf_dir):
    """Events by day; days that are past go as whole folders, and the day that is cut is filtered."""
    path, clock = f"{shared_dir(spark)}/days-{uuid.uuid4().hex}", datetime.datetime(2024, 1, 30, 12)
    by_day(drained(feed(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))), path, "ts")
    expire(spark, path, clock, 12)
    return unexpired(spark, path, "ts", clock, 12).select("event_id", "event_type")


@add("stm_evidence_clock", """SELECT user_id AS account, count(*) AS revision, max(event_id) AS evidence, coalesce(max(event_id) FILTER (WHERE event_type = 'purchase'), -1) AS run_evidence, coalesce(max(event_id) FILTER (WHERE event_type = 'purchase'), -1) = max(event_id) AS is_current FROM events GROUP BY 1""")
def stm_evidence_clock(spark, sf_dir):
    """A clock of an account's evidence that only rises; a run is current while it saw the last change."""
    i = F.col("event_id")
    g = feed(spark, sf_dir, "events").groupBy(F.col("user_id").alias("account")).agg(F.count("*").alias("revision"), F.max(i).alias("evidence"), F.coalesce(F.max(F.when(F.col("event_type") == "purchase", i)), F.lit(-1)).alias("run_evidence"))
    return drained(g.withColumn("is_current", F.col("run_evidence") == F.col("evidence")), ("account",))


@add("stm_three_lanes", """SELECT event_id, CASE WHEN event_id >= 800 THEN 'live' WHEN event_id >= 500 THEN 'snapshot' ELSE 'history' END AS lane, CASE WHEN event_id >= 800 THEN event_id ELSE -event_id END AS place FROM events""")
def stm_three_lanes(spark, sf_dir):
    """Rows from the watermark on are live and in order; those before are the snapshot and then history, the newest first."""
    i = F.col("event_id")
    lane = F.when(i >= 800, "live").when(i >= 500, "snapshot").otherwise("history")
    return drained(feed(spark, sf_dir, "events").select("event_id", lane.alias("lane"), F.when(i >= 800, i).otherwise(-i).alias("place")))


@add("stm_adaptive_batch", "SELECT user_id AS account, count(*) FILTER (WHERE event_type = 'error') AS failures, greatest(10, 5000 // pow(2, least(count(*) FILTER (WHERE event_type = 'error'), 20))::BIGINT)::BIGINT AS next_rows FROM events GROUP BY 1")
def stm_adaptive_batch(spark, sf_dir):
    """The rows of a batch halve with each failure at the limit, to ten at least; the state keeps it."""
    n = F.count_if(F.col("event_type") == "error")
    g = feed(spark, sf_dir, "events").groupBy(F.col("user_id").alias("account")).agg(n.alias("failures"))
    return drained(g.withColumn("next_rows", F.greatest(F.lit(10), F.floor(5000 / F.pow(F.lit(2), F.least("failures", F.lit(20))))).cast("long")), ("account",))


@add("stm_retention", "SELECT event_id, ts < TIMESTAMP '2024-02-10' - INTERVAL 30 DAY AS purge FROM events")
def stm_retention(spark, sf_dir):
    clock = F.lit("2024-02-10 00:00:00").cast("timestamp_ntz")
    return drained(feed(spark, sf_dir, "events").select("event_id", (F.col("ts") < clock - F.make_dt_interval(days=F.lit(30))).alias("purge")))
