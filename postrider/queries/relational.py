"""Projections, joins, aggregations, windows, orders, limits and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.tables import SQL, attachments, live_messages, messages, read
from . import Group

group = Group()
add = group.add


def m(spark, d):
    return live_messages(spark, d)


# --- scans and projections


@add("src_table", f"WITH {SQL} SELECT id, account, folder, size FROM m")
def src_table(spark, d):
    return m(spark, d).select("id", "account", "folder", "size")


@add("src_json_recordset", """WITH r AS (SELECT event_id, '[' || props || ']' AS js FROM events)
SELECT event_id, (js->0->>'k')::BIGINT AS k FROM r""")
def src_json_recordset(spark, d):
    rows = F.from_json(F.concat(F.lit("["), F.col("props"), F.lit("]")), "array<struct<k: bigint>>")
    return read(spark, d, "events").select("event_id", F.inline(rows))


@add("src_unnest_param", f"WITH {SQL}, p AS (SELECT unnest([3, 5, 8, 1000000]) AS id, unnest(['x', 'y', NULL, 'z']) AS label) SELECT m.id, label FROM m JOIN p ON p.id = m.id")
def src_unnest_param(spark, d):
    bound = spark.createDataFrame([(3, "x"), (5, "y"), (8, None), (1000000, "z")], "id long, label string")
    return m(spark, d).join(bound, "id").select("id", "label")


@add("prj_result", f"WITH {SQL} SELECT id, subject, list_filter(coalesce(flags, []), lambda x: x <> '\\Answered') AS flags, NULL::DOUBLE AS score FROM m")
def prj_result(spark, d):
    none = F.array().cast("array<string>")
    return m(spark, d).select("id", "subject", F.filter(F.coalesce("flags", none), lambda x: x != "\\Answered").alias("flags"), F.lit(None).cast("double").alias("score"))


@add("prj_fields", f"WITH {SQL} SELECT id, folder FROM m")
def prj_fields(spark, d):
    """Wanted fields that exist; unknown ones are ignored."""
    df = m(spark, d)
    return df.select(*[c for c in ("id", "folder", "no_such_field") if c in df.columns])


@add("prj_headers", f"""WITH {SQL} SELECT id, CASE WHEN from_name IS NULL THEN 'from=' || from_email || ';message-id=' || rfc_id
ELSE 'from=' || from_email || ';message-id=' || rfc_id || ';x-name=' || from_name END AS headers FROM m""")
def prj_headers(spark, d):
    """Header map without empty values, as text in a fixed order."""
    h = F.create_map(F.lit("from"), F.col("from_email"), F.lit("message-id"), F.col("rfc_id"), F.lit("x-name"), F.col("from_name"))
    entries = F.array_sort(F.map_entries(F.map_filter(h, lambda k, v: v.isNotNull())))
    return m(spark, d).select("id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("headers"))


@add("prj_body_coalesce", f"WITH {SQL} SELECT id, sha256(coalesce(CASE WHEN id % 3 = 0 THEN body END, CASE WHEN id % 2 = 0 THEN 's:' || subject END, '-')) AS body FROM m")
def prj_body_coalesce(spark, d):
    i = F.col("id")
    return m(spark, d).select("id", F.sha2(F.coalesce(F.when(i % 3 == 0, F.col("body")), F.when(i % 2 == 0, F.concat(F.lit("s:"), "subject")), F.lit("-")), 256).alias("body"))


CONVERSATION = "CASE WHEN id % 9 = 0 THEN 'conv' || (id % 27) WHEN provider_thread IS NOT NULL THEN sha256('ns:' || provider_thread) ELSE id::VARCHAR END"
DELIVERY = "CASE WHEN id % 9 = 0 THEN 'd' || id WHEN provider_thread IS NOT NULL THEN sha256('p:' || provider_thread) ELSE sha256(lower(rfc_id) || ':' || sha256(body)) END"


def conversation_key():
    """The assigned conversation, else a hash of the provider's thread, else the row itself."""
    i = F.col("id")
    return F.when(i % 9 == 0, F.concat(F.lit("conv"), (i % 27).cast("string"))).when(F.col("provider_thread").isNotNull(), F.sha2(F.concat(F.lit("ns:"), "provider_thread"), 256)).otherwise(i.cast("string"))


@add("prj_conversation_key", f"WITH {SQL} SELECT id, {CONVERSATION} AS conversation FROM m")
def prj_conversation_key(spark, d):
    return m(spark, d).select("id", conversation_key().alias("conversation"))


@add("prj_delivery_key", f"WITH {SQL} SELECT id, {DELIVERY} AS delivery FROM m")
def prj_delivery_key(spark, d):
    i = F.col("id")
    own = F.sha2(F.concat(F.lower("rfc_id"), F.lit(":"), F.sha2("body", 256)), 256)
    key = F.coalesce(F.when(i % 9 == 0, F.concat(F.lit("d"), i.cast("string"))), F.when(F.col("provider_thread").isNotNull(), F.sha2(F.concat(F.lit("p:"), "provider_thread"), 256)), own)
    return m(spark, d).select("id", key.alias("delivery"))


@add("prj_generated_col", f"WITH {SQL} SELECT id, lower(subject) || ' ' || coalesce(from_name, '') AS header_text, CASE WHEN NOT deleted THEN account END AS active_account FROM m_all")
def prj_generated_col(spark, d):
    return messages(spark, d).select("id", F.concat_ws(" ", F.lower("subject"), F.coalesce("from_name", F.lit(""))).alias("header_text"), F.when(~F.col("deleted"), F.col("account")).alias("active_account"))


# --- joins


@add("join_left_body", f"WITH {SQL}, b AS (SELECT id AS message_id, length(body) AS chars FROM m_all WHERE id % 3 <> 0) SELECT m.id, b.chars FROM m LEFT JOIN b ON b.message_id = m.id")
def join_left_body(spark, d):
    """Bodies arrive late: messages without one stay."""
    bodies = messages(spark, d).filter("id % 3 <> 0").select(F.col("id").alias("message_id"), F.length("body").cast("long").alias("chars"))
    return m(spark, d).join(bodies, F.col("id") == F.col("message_id"), "left").select("id", "chars")


@add("join_left_active", f"WITH {SQL}, x AS (SELECT id AS message_id, account, 'run' || (id % 2) AS run FROM m_all WHERE id % 4 <> 1) SELECT m.id, m.account, x.run FROM m LEFT JOIN x ON x.message_id = m.id AND x.account = m.account")
def join_left_active(spark, d):
    x = messages(spark, d).filter("id % 4 <> 1").select("id", "account", F.concat(F.lit("run"), (F.col("id") % 2).cast("string")).alias("run"))
    return m(spark, d).join(x, ["id", "account"], "left").select("id", "account", "run")


FOLDERS = "f AS (SELECT account, folder, count(*) AS n, max(size) AS largest FROM m_all GROUP BY ALL)"


@add("join_inner_composite", f"WITH {SQL}, {FOLDERS} SELECT m.id, f.n, f.largest FROM m JOIN f USING (account, folder)")
def join_inner_composite(spark, d):
    folders = messages(spark, d).groupBy("account", "folder").agg(F.count("*").alias("n"), F.max("size").alias("largest"))
    return m(spark, d).join(folders, ["account", "folder"]).select("id", "n", "largest")


@add("join_active_run", f"""WITH {SQL}, run AS (SELECT account, 'r' || (length(account) % 3) AS run_id, CASE WHEN length(account) % 2 = 0 THEN 'active' ELSE 'standby' END AS status FROM m_all GROUP BY account)
SELECT m.id, run.run_id FROM m JOIN run ON run.account = m.account AND status = 'active'""")
def join_active_run(spark, d):
    n = F.length("account")
    runs = messages(spark, d).select("account").distinct().select("account", F.concat(F.lit("r"), (n % 3).cast("string")).alias("run_id"), F.when(n % 2 == 0, "active").otherwise("standby").alias("status"))
    return m(spark, d).join(runs.filter("status = 'active'"), "account").select("id", "run_id")


@add("join_semi_exists", f"WITH {SQL} SELECT id FROM m WHERE EXISTS (SELECT 1 FROM a WHERE a.message_id = m.id AND bytes > 1000)")
def join_semi_exists(spark, d):
    return m(spark, d).join(attachments(spark, d).filter("bytes > 1000"), F.col("id") == F.col("message_id"), "left_semi").select("id")


@add("join_anti", f"WITH {SQL} SELECT id FROM m WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.message_id = m.id)")
def join_anti(spark, d):
    return m(spark, d).join(attachments(spark, d), F.col("id") == F.col("message_id"), "left_anti").select("id")


@add("join_full", f"""WITH {SQL}, x AS (SELECT id, folder FROM m WHERE id % 2 = 0), y AS (SELECT id, account FROM m WHERE id % 3 = 0)
SELECT id, folder, account, CASE WHEN folder IS NULL THEN 'right' WHEN account IS NULL THEN 'left' ELSE 'both' END AS side FROM x FULL JOIN y USING (id)""")
def join_full(spark, d):
    x, y = m(spark, d).filter("id % 2 = 0").select("id", "folder"), m(spark, d).filter("id % 3 = 0").select("id", "account")
    side = F.when(F.col("folder").isNull(), "right").when(F.col("account").isNull(), "left").otherwise("both")
    return x.join(y, "id", "outer").withColumn("side", side)


@add("join_lateral_agg", "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT round(max(c_acctbal), 2) FROM customer WHERE c_nationkey = n_nationkey) AS best FROM nation")
def join_lateral_agg(spark, d):
    """A correlated aggregate, as one aggregation and a join of its few rows."""
    per = read(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.round(F.max("c_acctbal"), 2).alias("best"))
    j = read(spark, d, "nation").join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return j.select("n_name", F.coalesce("customers", F.lit(0)).cast("long").alias("customers"), "best")


@add("join_lateral_topn", f"WITH {SQL} SELECT account, id, rn::INT AS rn FROM (SELECT account, id, row_number() OVER (PARTITION BY account ORDER BY size DESC NULLS LAST, id) AS rn FROM m) WHERE rn <= 3")
def join_lateral_topn(spark, d):
    w = Window.partitionBy("account").orderBy(F.desc_nulls_last("size"), "id")
    return m(spark, d).select("account", "id", F.row_number().over(w).alias("rn")).filter("rn <= 3")


@add("join_cross_scalar", f"WITH {SQL}, s AS (SELECT count(*) AS total, max(size) AS largest FROM m) SELECT id, total, largest FROM m CROSS JOIN s WHERE size = largest")
def join_cross_scalar(spark, d):
    """One row of statistics beside each row; a one-row side is bounded by itself."""
    df = m(spark, d)
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias("total"), F.max("size").alias("largest")))).filter("size = largest").select("id", "total", "largest")


@add("join_unnest_ordinality", f"WITH {SQL} SELECT id, (unnest(range(len(to_emails))))::INT AS pos, unnest(to_emails) AS email FROM m")
def join_unnest_ordinality(spark, d):
    return m(spark, d).select("id", F.posexplode("to_emails").alias("pos", "email"))


@add("join_lateral_values", f"WITH {SQL} SELECT id, unnest(['from', 'id']) AS kind, unnest([from_email, rfc_id]) AS key FROM m")
def join_lateral_values(spark, d):
    pairs = F.array(F.struct(F.lit("from").alias("kind"), F.col("from_email").alias("key")), F.struct(F.lit("id").alias("kind"), F.col("rfc_id").alias("key")))
    return m(spark, d).select("id", F.inline(pairs))


@add("join_self_copies", f"WITH {SQL}, k AS (SELECT id, account, md5(body) AS h FROM m) SELECT x.id, list(y.id ORDER BY y.id) AS others FROM k x JOIN k y ON x.h = y.h AND x.id <> y.id GROUP BY x.id")
def join_self_copies(spark, d):
    """Other rows of the same delivery: one group's ids beside each of its rows. Pairs only where a group is small by nature."""
    w = Window.partitionBy("h").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k = m(spark, d).select("id", F.md5("body").alias("h")).withColumn("ids", F.collect_list("id").over(w))
    return k.filter(F.size("ids") > 1).select("id", F.array_sort(F.array_remove("ids", F.col("id"))).alias("others"))


@add("join_in_tuple", f"WITH {SQL} SELECT id FROM m WHERE (account, folder) IN (SELECT account, folder FROM m_all WHERE size > 8000)")
def join_in_tuple(spark, d):
    wanted = messages(spark, d).filter("size > 8000").select("account", "folder").distinct()
    return m(spark, d).join(wanted, ["account", "folder"], "left_semi").select("id")


@add("join_theta_range", """SELECT e.event_id, p.event_id AS purchase FROM events e JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase'
AND e.event_type = 'signup' AND p.ts >= e.ts AND p.ts < e.ts + INTERVAL 3 DAY""")
def join_theta_range(spark, d):
    """Equal on the user, with a range of time: a purchase within three days of a sign-up."""
    ev = read(spark, d, "events")
    e = ev.filter("event_type = 'signup'").select("event_id", "user_id", "ts")
    p = ev.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), F.col("user_id").alias("u"), F.col("ts").alias("t"))
    near = (F.col("t") >= F.col("ts")) & (F.col("t") < F.col("ts") + F.expr("INTERVAL 3 DAYS"))
    return e.join(p, (F.col("user_id") == F.col("u")) & near).select("event_id", "purchase")


@add("join_update_from", f"WITH {SQL}, u AS (SELECT id, size * 2 AS size FROM m_all WHERE id % 5 = 0) SELECT m.id, coalesce(u.size, m.size) AS size FROM m LEFT JOIN u USING (id)")
def join_update_from(spark, d):
    u = messages(spark, d).filter("id % 5 = 0").select("id", (F.col("size") * 2).alias("new"))
    return m(spark, d).join(u, "id", "left").select("id", F.coalesce("new", "size").alias("size"))


# --- aggregations


@add("agg_count_filter", f"WITH {SQL} SELECT account, count(*) FILTER (WHERE size > 2000) AS large, count(*) FILTER (WHERE list_contains(coalesce(flags, []), '\\Seen')) AS seen FROM m GROUP BY account")
def agg_count_filter(spark, d):
    none = F.array().cast("array<string>")
    return m(spark, d).groupBy("account").agg(F.count_if(F.col("size") > 2000).alias("large"), F.count_if(F.array_contains(F.coalesce("flags", none), "\\Seen")).alias("seen"))


@add("agg_sum_least_greatest", f"WITH {SQL} SELECT account, sum(least(size, coalesce(id, 0)))::BIGINT AS low, sum(greatest(size, 1000))::BIGINT AS high FROM m GROUP BY account")
def agg_sum_least_greatest(spark, d):
    return m(spark, d).groupBy("account").agg(F.sum(F.least("size", F.coalesce("id", F.lit(0)))).alias("low"), F.sum(F.greatest("size", F.lit(1000))).alias("high"))


@add("agg_max_filter", "SELECT user_id, max(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) FILTER (WHERE event_type = 'error') AS lag FROM events GROUP BY user_id")
def agg_max_filter(spark, d):
    lag = F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return read(spark, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", lag)).alias("lag"))


@add("agg_count_distinct", f"WITH {SQL} SELECT account, count(DISTINCT md5(body)) AS deliveries, count(DISTINCT folder) AS folders FROM m GROUP BY account")
def agg_count_distinct(spark, d):
    return m(spark, d).groupBy("account").agg(F.countDistinct(F.md5("body")).alias("deliveries"), F.countDistinct("folder").alias("folders"))


@add("agg_having_distinct", f"WITH {SQL} SELECT md5(body) AS delivery, count(DISTINCT folder || account) AS places FROM m GROUP BY 1 HAVING count(DISTINCT folder || account) > 1")
def agg_having_distinct(spark, d):
    return m(spark, d).groupBy(F.md5("body").alias("delivery")).agg(F.countDistinct(F.concat("folder", "account")).alias("places")).filter("places > 1")


@add("agg_json_object", f"WITH {SQL}, c AS (SELECT account, folder, count(*) AS n FROM m GROUP BY ALL) SELECT account, string_agg(folder || ':' || n, ',' ORDER BY folder) AS counts FROM c GROUP BY account")
def agg_json_object(spark, d):
    """A map of counts, written in the order of its keys."""
    c = m(spark, d).groupBy("account", "folder").agg(F.count("*").alias("n")).groupBy("account").agg(F.map_from_entries(F.collect_list(F.struct("folder", "n"))).alias("map"))
    entries = F.array_sort(F.map_entries("map"))
    return c.select("account", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("counts"))


@add("agg_json_array", f"WITH {SQL} SELECT message_id, '[' || string_agg('{{\"part\":\"' || part || '\",\"bytes\":' || bytes || '}}', ',' ORDER BY part, bytes) || ']' AS files FROM a GROUP BY message_id")
def agg_json_array(spark, d):
    return attachments(spark, d).groupBy("message_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("part", "bytes")))).alias("files"))


@add("agg_array_ordered", f"WITH {SQL} SELECT account, folder, list(id ORDER BY date DESC, id) AS ids FROM m GROUP BY account, folder")
def agg_array_ordered(spark, d):
    rows = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("date").cast("timestamp"))).alias("t"), "id")))
    return m(spark, d).groupBy("account", "folder").agg(rows.getField("id").alias("ids"))


@add("agg_pct", f"WITH {SQL}, c AS (SELECT account, count(*) FILTER (WHERE size > 1500) AS n, count(*) AS d FROM m GROUP BY account) SELECT account, CASE WHEN d = 0 THEN 100 ELSE least(100, round(n::DECIMAL(18,4) * 100 / d)) END::INT AS pct FROM c")
def agg_pct(spark, d):
    c = m(spark, d).groupBy("account").agg(F.count_if(F.col("size") > 1500).alias("n"), F.count("*").alias("d"))
    pct = F.when(F.col("d") == 0, 100).otherwise(F.least(F.lit(100), F.floor((F.col("n") * 200 + F.col("d")) / (F.col("d") * 2))))
    return c.select("account", pct.cast("int").alias("pct"))


@add("agg_folder_counts", f"WITH {SQL} SELECT account, folder, count(*) AS messages, count(*) FILTER (WHERE NOT list_contains(coalesce(flags, []), '\\Seen')) AS unread FROM m GROUP BY account, folder")
def agg_folder_counts(spark, d):
    from ..operators.mirror import folder_counts

    return folder_counts(m(spark, d))


@add("agg_array_min", f"WITH {SQL} SELECT account, min(id::VARCHAR) AS least FROM m GROUP BY account")
def agg_array_min(spark, d):
    return m(spark, d).groupBy("account").agg(F.min(F.col("id").cast("string")).alias("least"))


@add("agg_scalar_subquery", f"WITH {SQL} SELECT id, (SELECT count(*) FROM a WHERE message_id = m.id) AS files, (SELECT count(*) FROM a WHERE message_id = m.id AND disposition = 'inline') AS inline FROM m")
def agg_scalar_subquery(spark, d):
    per = attachments(spark, d).groupBy("message_id").agg(F.count("*").alias("files"), F.count_if(F.col("disposition") == "inline").alias("inline"))
    zero = F.lit(0).cast("long")
    return m(spark, d).join(per, F.col("id") == F.col("message_id"), "left").select("id", F.coalesce("files", zero).alias("files"), F.coalesce("inline", zero).alias("inline"))


@add("agg_exists", f"WITH {SQL} SELECT account, bool_or(size > 9000) AS any_large FROM m GROUP BY account")
def agg_exists(spark, d):
    return m(spark, d).groupBy("account").agg(F.bool_or(F.col("size") > 9000).alias("any_large"))


# --- windows


@add("win_row_number", f"WITH {SQL} SELECT account, id FROM (SELECT account, id, row_number() OVER (PARTITION BY account, md5(body) ORDER BY size > 0 DESC, folder, id) AS rn FROM m) WHERE rn = 1")
def win_row_number(spark, d):
    w = Window.partitionBy("account", F.md5("body")).orderBy(F.desc(F.col("size") > 0), "folder", "id")
    return m(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("account", "id")


@add("win_array_agg_full", f"WITH {SQL} SELECT id, list_sort(list(id) OVER (PARTITION BY account, md5(body) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ids FROM m")
def win_array_agg_full(spark, d):
    w = Window.partitionBy("account", F.md5("body")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return m(spark, d).select("id", F.array_sort(F.collect_list("id").over(w)).alias("ids"))


@add("win_count_partition", f"WITH {SQL} SELECT id, count(*) OVER (PARTITION BY account, {CONVERSATION}) AS n FROM m")
def win_count_partition(spark, d):
    df = m(spark, d).withColumn("c", conversation_key())
    return df.select("id", F.count("*").over(Window.partitionBy("account", "c")).alias("n"))


@add("win_distinct_on", f"WITH {SQL} SELECT DISTINCT ON (account, folder) account, folder, id, n FROM (SELECT *, count(*) OVER (PARTITION BY account) AS n FROM m) ORDER BY account, folder, size DESC NULLS LAST, date DESC, id DESC")
def win_distinct_on(spark, d):
    w = Window.partitionBy("account", "folder").orderBy(F.desc_nulls_last("size"), F.desc("date"), F.desc("id"))
    df = m(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("account")))
    return df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("account", "folder", "id", "n")


@add("win_rotate", f"WITH {SQL}, r AS (SELECT account, folder, row_number() OVER (PARTITION BY account ORDER BY folder) - 1 AS i, count(*) OVER (PARTITION BY account) AS n FROM (SELECT DISTINCT account, folder FROM m)) SELECT account, folder, ((i - 2 % n + n) % n)::INT AS turn FROM r")
def win_rotate(spark, d):
    """Round robin that starts at a stored cursor (here 2)."""
    f = m(spark, d).select("account", "folder").distinct()
    i = F.row_number().over(Window.partitionBy("account").orderBy("folder")) - 1
    f = f.withColumn("i", i).withColumn("n", F.count("*").over(Window.partitionBy("account")))
    return f.select("account", "folder", F.pmod(F.col("i") - 2, F.col("n")).cast("int").alias("turn"))


# --- orders, limits, sets


def ordered(name, order, sql_order):
    """The first page of an order, with its places; the last key is unique."""
    @add(name, f"WITH {SQL} SELECT id, row_number() OVER (ORDER BY {sql_order})::INT AS place FROM m ORDER BY {sql_order} LIMIT 25")
    def _(spark, d):
        return m(spark, d).orderBy(*order()).limit(25).withColumn("place", F.row_number().over(Window.orderBy(*order()))).select("id", "place")


ordered("ord_recent", lambda: [F.desc("date"), F.desc("id")], "date DESC, id DESC")
ordered("ord_oldest", lambda: [F.asc("date"), F.asc("id")], "date, id")
ordered("ord_size", lambda: [F.desc_nulls_last("size"), F.desc("id")], "size DESC NULLS LAST, id DESC")
ordered("ord_sender", lambda: [F.lower(F.coalesce("from_name", "from_email")), F.desc("id")], "lower(coalesce(from_name, from_email)), id DESC")
ordered("ord_null_default", lambda: [F.desc_nulls_first("from_name"), F.desc("id")], "from_name DESC NULLS FIRST, id DESC")
ordered("ord_numeric_part", lambda: [F.regexp_replace("from_email", r"\D", "").cast("long"), "from_email", "id"], r"regexp_replace(from_email, '\D', '', 'g')::BIGINT, from_email, id")
ordered("ord_array_position", lambda: [F.array_position(F.array(F.lit("fr"), F.lit("en"), F.lit("de"), F.lit("es")), F.col("folder")), "id"], "list_position(['fr', 'en', 'de', 'es'], folder), id")


@add("lim_page", f"WITH {SQL}, p AS (SELECT id, row_number() OVER (ORDER BY date DESC, id DESC) AS rn FROM m ORDER BY date DESC, id DESC LIMIT 26 OFFSET 50) SELECT id, (SELECT count(*) > 25 FROM p) AS has_more FROM p WHERE rn <= 75")
def lim_page(spark, d):
    """A page and whether more follow: one row more is fetched."""
    page = m(spark, d).orderBy(F.desc("date"), F.desc("id")).offset(50).limit(26).withColumn("rn", F.row_number().over(Window.orderBy(F.desc("date"), F.desc("id"))))
    return page.withColumn("has_more", F.count("*").over(Window.partitionBy(F.lit(0))) > 25).filter("rn <= 25").select("id", "has_more")


@add("lim_branch_cap", f"WITH {SQL} SELECT id FROM m WHERE contains(lower(body), 'the') ORDER BY date DESC, id DESC LIMIT 400")
def lim_branch_cap(spark, d):
    return m(spark, d).filter(F.contains(F.lower("body"), F.lit("the"))).orderBy(F.desc("date"), F.desc("id")).limit(400).select("id")


@add("lim_newest_then_asc", f"WITH {SQL}, n AS (SELECT id, date FROM m ORDER BY date DESC, id DESC LIMIT 20) SELECT id, row_number() OVER (ORDER BY date, id)::INT AS place FROM n")
def lim_newest_then_asc(spark, d):
    newest = m(spark, d).orderBy(F.desc("date"), F.desc("id")).limit(20)
    return newest.select("id", F.row_number().over(Window.orderBy("date", "id")).alias("place"))


@add("lim_keyset", f"WITH {SQL} SELECT id FROM m WHERE id > 100 ORDER BY id LIMIT 50")
def lim_keyset(spark, d):
    return m(spark, d).filter("id > 100").orderBy("id").limit(50).select("id")


@add("lim_offset_probe", f"WITH {SQL} SELECT account, count(DISTINCT folder) >= 2 AS several FROM m GROUP BY account")
def lim_offset_probe(spark, d):
    return m(spark, d).groupBy("account").agg((F.countDistinct("folder") >= 2).alias("several"))


@add("set_union", f"WITH {SQL} SELECT id FROM m WHERE size > 3000 UNION SELECT id FROM m WHERE folder = 'fr'")
def set_union(spark, d):
    return m(spark, d).filter("size > 3000").select("id").union(m(spark, d).filter("folder = 'fr'").select("id")).distinct()


@add("set_union_all", f"WITH {SQL} SELECT id, 1 AS sign FROM m WHERE size > 3000 UNION ALL SELECT id, -1 FROM m WHERE folder = 'fr'")
def set_union_all(spark, d):
    return m(spark, d).filter("size > 3000").select("id", F.lit(1).alias("sign")).union(m(spark, d).filter("folder = 'fr'").select("id", F.lit(-1)))


@add("set_intersect", f"WITH {SQL} SELECT account FROM m WHERE size > 9000 INTERSECT SELECT account FROM m WHERE folder = 'fr'")
def set_intersect(spark, d):
    return m(spark, d).filter("size > 9000").select("account").intersect(m(spark, d).filter("folder = 'fr'").select("account"))


@add("set_array_diff", f"WITH {SQL} SELECT id, list_filter(to_emails, lambda x: x <> 'team@host2.example') AS others FROM m")
def set_array_diff(spark, d):
    return m(spark, d).select("id", F.array_remove("to_emails", "team@host2.example").alias("others"))


@add("set_distinct", f"WITH {SQL} SELECT DISTINCT account, folder FROM m")
def set_distinct(spark, d):
    return m(spark, d).select("account", "folder").distinct()
