"""Keeping a mirror of mailboxes: keyed upserts, reconciliation, counters, progress and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unread() -> Column:
    return ~F.array_contains(F.coalesce("flags", F.array().cast("array<string>")), "\\Seen")


def folder_counts(messages: DataFrame) -> DataFrame:
    """Messages and unread ones of each folder."""
    return messages.groupBy("account", "folder").agg(F.count("*").alias("messages"), F.count_if(unread()).alias("unread"))


def applied_deltas(stored: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored counts after rows changed from ``old`` to ``new``: signed rows, summed, nets of zero left out."""
    signed = new.select("account", "folder", F.lit(1).alias("s"), unread().cast("int").alias("u")).union(old.select("account", "folder", F.lit(-1), -unread().cast("int")))
    nets = signed.groupBy("account", "folder").agg(F.sum("s").alias("ds"), F.sum("u").alias("du")).filter("ds <> 0 or du <> 0")
    j = stored.join(nets, ["account", "folder"], "outer").na.fill(0, ["messages", "unread", "ds", "du"])
    return j.select("account", "folder", (F.col("messages") + F.col("ds")).alias("messages"), (F.col("unread") + F.col("du")).alias("unread"))


def upserted(target: DataFrame, batch: DataFrame, keys: list[str], keep: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """``target`` after inserting or replacing the rows of ``batch`` by key.

    Of several batch rows with a key the last by ``order`` counts. Columns in
    ``keep`` stay as they were in rows that existed; all others take the
    batch's values, nulls included. Columns are those of ``target``.
    """
    if order:
        batch = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")
    b = batch.select(*[F.col(c).alias(f"__{c}") for c in batch.columns], F.lit(True).alias("__new"))
    same = [target[k].eqNullSafe(b[f"__{k}"]) for k in keys]
    j = target.withColumn("__old", F.lit(True)).join(b, same, "outer")
    pick = lambda c: F.when(F.col("__new").isNull() | (F.col("__old") if c in keep else F.lit(False)), F.col(c)).otherwise(F.col(f"__{c}")) if f"__{c}" in b.columns else F.col(c)
    return j.select(*[pick(c).alias(c) for c in target.columns])


def reconciled(mirror: DataFrame, listed: DataFrame, uid_next: int) -> DataFrame:
    """(uid, action) from comparing a folder's mirror (uid, deleted, reason) with the provider's list (uid).

    mark: live here, gone there, and older than the list; revive: marked as
    missing by an earlier comparison, but listed; missing: listed, not here.
    """
    j = mirror.join(listed.withColumn("__l", F.lit(True)), "uid", "outer")
    here, there = F.col("deleted").isNotNull(), F.col("__l").isNotNull()
    action = (
        F.when(here & ~F.col("deleted") & ~there & (F.col("uid") < uid_next), "mark")
        .when(here & F.col("deleted") & there & (F.col("reason") == "RECONCILE_MISSING"), "revive")
        .when(~here & there, "missing")
    )
    return j.select("uid", action.alias("action")).filter(F.col("action").isNotNull())


def is_complete(listed: DataFrame, expected: int) -> bool:
    """A list that is not as long as the server said changes nothing."""
    return listed.select("uid").distinct().count() == expected


def normal_flags(c: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))))


def flag_changes(mirror: DataFrame, scanned: DataFrame) -> DataFrame:
    """(id, old, new) for rows whose flags differ as sets, letter case and spaces aside."""
    s = scanned.select("id", F.col("flags").alias("__f"))
    j = mirror.select("id", "flags").join(s, "id")
    return j.filter(normal_flags("flags") != normal_flags("__f")).select("id", normal_flags("flags").alias("old"), normal_flags("__f").alias("new"))


def backoff_seconds(failures: Column, least: int = 1, most: int = 300) -> Column:
    """Doubling from ``least``, at most ``most``."""
    return F.least(F.lit(most), F.lit(least) * F.pow(F.lit(2), F.least(failures - 1, F.lit(30)))).cast("long")


def health(stuck: Column, failures: Column, complete: Column) -> Column:
    """The first rule that fits."""
    return F.when(failures >= 10, "BROKEN").when(stuck | (failures > 0), "DEGRADED").when(~complete, "INITIAL_SYNC").otherwise("HEALTHY")


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up, at most 100; all of nothing is 100."""
    return F.when(whole == 0, 100).otherwise(F.least(F.lit(100), F.floor((part * 200 + whole) / (whole * 2)))).cast("int")


def priority(folder: Column) -> Column:
    """Inbox 1, sent 5, others 100."""
    f = F.lower(folder)
    return F.when(f == "inbox", 1).when(f.like("sent%"), 5).otherwise(100)


#: Reasons after which a tombstone may go, failures after which an account is broken, rows, bytes and attachments of a write.
PURGED_REASONS = ("expunged", "folder_deleted")
BROKEN_AFTER = 10
BATCH_ROWS, BATCH_BYTES, BATCH_PARTS = 500, 8_388_608, 5_000


def purged(tombstones: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """The tombstones that go: old enough, and for one of the two reasons that are proof of a deletion."""
    return tombstones.filter(F.col("reason").isin(*PURGED_REASONS) & (F.col("deleted_at") <= now - F.make_dt_interval(days=F.lit(days))))


def jittered(n: Column, seed: Column) -> Column:
    """Seconds to wait after n failures in a row: doubling from 1 to 300, times 0.7 to 1.3 by the seed."""
    return F.round(F.least(F.lit(300.0), F.pow(F.lit(2.0), F.least(n - 1, F.lit(30)))) * (0.7 + 0.6 * F.pmod(seed, F.lit(1000)) / 1000.0), 3)


def failure_state(n: Column, degraded_since: Column, now: Column) -> Column:
    """BROKEN after ten failures in a row; DEGRADED for a day and for a week have names of their own."""
    hours = lambda h: degraded_since <= now - F.make_dt_interval(hours=F.lit(h))
    return F.when(n >= BROKEN_AFTER, "BROKEN").when((n > 0) & hours(168), "STUCK_WEEK").when((n > 0) & hours(24), "STUCK_DAY").when(n > 0, "DEGRADED").otherwise("HEALTHY")


def aliases(folders: DataFrame, rows: DataFrame, sample: int = 5) -> DataFrame:
    """(account, folder, alias): folders of one account with equal status whose newest ``sample`` rows are the same.

    ``folders`` has account, folder, uidvalidity, uidnext, n; ``rows`` account,
    folder, uid, digest. Only the newest rows of a folder are collected. The
    alias is the smallest name among the equal ones.
    """
    w = Window.partitionBy("account", "folder").orderBy(F.desc("uid"))
    newest = rows.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= sample)
    sign = newest.groupBy("account", "folder").agg(F.array_sort(F.collect_list(F.struct("uid", "digest"))).alias("sample"))
    same = folders.join(sign, ["account", "folder"]).withColumn("sign", F.sha2(F.to_json(F.struct("uidvalidity", "uidnext", "n", "sample")), 256))
    first = same.groupBy("account", "sign").agg(F.min("folder").alias("alias"))
    return same.join(first, ["account", "sign"]).filter("folder <> alias").select("account", "folder", "alias")


def status_reasons(**counts: Column) -> Column:
    """(reason, severity) of what a mirror lacks, the most severe first, by names in rising order among equals."""
    severity = {"broken": 3, "missing_folders": 2, "missing_bodies": 1, "pending_deletions": 1}
    each = [F.when(c > 0, F.struct((-F.lit(severity[k])).alias("s"), F.lit(k).alias("reason"), c.cast("long").alias("n"))) for k, c in counts.items()]
    return F.array_sort(F.array_compact(F.array(*each)))


def proven_unchanged(stored: DataFrame, observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(folders that a provider's status proves unchanged, folders that answered with another one).

    ``stored`` has account, folder, uidvalidity, uidnext, n, modseq and clean
    (its last audit found nothing); all four must be equal, and the audit clean.
    """
    keys = ["account", "folder", "uidvalidity", "uidnext", "n", "modseq"]
    proven = observed.select(*keys).join(stored.filter("clean"), keys).select("account", "folder")
    return proven, observed.select("account", "folder").join(proven, ["account", "folder"], "left_anti")


def pending(folders: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """(account, folder, status, missing_since): a folder that is not seen is to be verified, since the first time; one that is seen is active."""
    j = folders.join(seen.select("account", "folder", F.lit(True).alias("there")).distinct(), ["account", "folder"], "left")
    there = F.col("there").isNotNull()
    return j.select("account", "folder", F.when(there, "ACTIVE").otherwise("PENDING_VERIFICATION").alias("status"), F.when(~there, F.coalesce("missing_since", now)).alias("missing_since"))


def packed(rows: DataFrame, group: str, order: str, most_rows: int = BATCH_ROWS, most_bytes: int = BATCH_BYTES, most_parts: int = BATCH_PARTS) -> DataFrame:
    """``rows`` with the number of their write in a group: filled in order until rows, bytes or attachments are full.

    Which row opens a write depends on all before it, so a group is walked in
    order, as a stream of Arrow batches of bounded size in one pass.
    """

    def walk(batches):
        now, batch, n, size, parts = None, 0, 0, 0, 0
        for frame in batches:
            found = []
            for g, b, p in zip(frame["__group"], frame["bytes"], frame["parts"], strict=True):
                if g != now:
                    now, batch, n, size, parts = g, 0, 0, 0, 0
                elif n >= most_rows or size + b > most_bytes or parts + p > most_parts:
                    batch, n, size, parts = batch + 1, 0, 0, 0
                n, size, parts = n + 1, size + b, parts + p
                found.append(batch)
            yield frame.assign(batch=found).drop(columns="__group")

    dealt = rows.withColumn("__group", F.col(group).cast("string")).repartition("__group").sortWithinPartitions("__group", order)
    return dealt.mapInPandas(walk, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", batch int")
