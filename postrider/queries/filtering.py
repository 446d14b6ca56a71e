"""Search filters."""

from pyspark.sql import functions as F

from ..operators import filters as f
from ..sources.tables import SQL, attachments, live_messages, messages
from . import Group

group = Group()


def simple(name, column, where):
    """Ids of live messages for which a filter of messages holds."""
    group.add(name, f"WITH {SQL} SELECT id FROM m WHERE {where}")(lambda spark, d: live_messages(spark, d).filter(column()).select("id"))


JOINED = "lower(array_to_string(list_concat(coalesce(to_emails, []), coalesce(cc_emails, [])), ' '))"
for _name, _column, _where in [
    ("flt_from", lambda: f.sender("USER 1"), "contains(lower(coalesce(from_email, '')), 'user 1') OR contains(lower(coalesce(from_name, '')), 'user 1')"),
    ("flt_from_domain", lambda: f.sender_domain("host3.example"), "split_part(lower(from_email), '@', 2) = 'host3.example'"),
    ("flt_recipient", lambda: f.recipient("Boss@"), f"contains({JOINED}, 'boss@')"),
    ("flt_to", lambda: f.addressed("to_emails", "user12@"), "contains(lower(array_to_string(to_emails, ' ')), 'user12@')"),
    ("flt_cc", lambda: f.addressed("cc_emails", "boss"), "contains(lower(array_to_string(coalesce(cc_emails, []), ' ')), 'boss')"),
    ("flt_any_email", lambda: f.any_address("user1@"), f"contains(concat_ws(' ', lower(from_email), {JOINED}), 'user1@')"),
    ("flt_subject", lambda: f.subject("the of"), "contains(lower(subject), 'the of')"),
    ("flt_subject_plain", lambda: f.subject("THE"), "contains(lower(subject), 'the')"),
    ("flt_msgid", lambda: f.message_id(" <12@HOST.example> "), "lower(trim(regexp_replace(rfc_id, '^<|>$', '', 'g'))) = '12@host.example'"),
    ("flt_flag", lambda: f.flagged("\\Flagged"), r"list_contains(coalesce(flags, []), '\Flagged')"),
    ("flt_unread", lambda: f.negated(f.flagged("\\Seen")), r"NOT list_contains(coalesce(flags, []), '\Seen')"),
    ("flt_date", lambda: f.dated("2024-01-05", "2024-01-20 12:00:00"), "date >= TIMESTAMP '2024-01-05' AND date < TIMESTAMP '2024-01-20 12:00:00'"),
    ("flt_size", lambda: f.larger(3000), "size > 3000"),
    ("flt_size_smaller", lambda: f.smaller(700), "size < 700"),
    ("flt_or", lambda: f.any_of(f.sender("user 7"), f.larger(9000), f.subject("zu")), "contains(lower(coalesce(from_email, '')), 'user 7') OR contains(lower(coalesce(from_name, '')), 'user 7') OR size > 9000 OR contains(lower(subject), 'zu')"),
    ("flt_not", lambda: f.negated(f.sender_domain("host1.example")), "NOT split_part(lower(from_email), '@', 2) = 'host1.example'"),
    ("flt_scope_account", lambda: F.col("account").isin("src1", "src2"), "account IN ('src1', 'src2')"),
]:
    simple(_name, _column, _where)


def by_attachment(name, column, where):
    @group.add(name, f"WITH {SQL} SELECT id FROM m WHERE EXISTS (SELECT 1 FROM a WHERE message_id = m.id AND {where})")
    def _(spark, d):
        return live_messages(spark, d).join(attachments(spark, d).filter(column()), F.col("id") == F.col("message_id"), "left_semi").select("id")


by_attachment("flt_has_attachment", lambda: F.col("disposition") == "attachment", "disposition = 'attachment'")
by_attachment("flt_filename", lambda: f.file_name("rep*-?5.PDF"), "regexp_matches(lower(filename), '^rep.*-.5\\.pdf$')")
by_attachment("flt_filename_plain", lambda: f.file_name("e_1"), "contains(lower(filename), 'e_1')")
by_attachment("flt_filetype", lambda: f.file_kind("Archive"), "lower(mime) IN ('application/zip', 'application/x-zip-compressed', 'application/gzip', 'application/x-tar', 'application/x-7z-compressed')")
by_attachment("flt_filetype_sheet", lambda: f.file_kind("excel"), "lower(mime) IN ('application/vnd.ms-excel', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet')")
by_attachment("flt_filetype_family", lambda: f.file_kind("Text"), "lower(mime) LIKE 'text/%'")
by_attachment("flt_filetype_part", lambda: f.file_kind("applic"), "contains(lower(mime), 'applic')")
by_attachment("flt_mime", lambda: F.lower("mime") == "application/pdf", "lower(mime) = 'application/pdf'")


@group.add("flt_or_exists", f"WITH {SQL} SELECT id FROM m WHERE size < 500 OR EXISTS (SELECT 1 FROM a WHERE message_id = m.id AND lower(mime) = 'application/pdf')")
def flt_or_exists(spark, d):
    flagged = f.having(live_messages(spark, d), attachments(spark, d), f.file_kind("pdf"), "has_pdf")
    return flagged.filter(f.any_of(F.col("has_pdf"), f.smaller(500))).select("id")


@group.add("flt_folder", f"WITH {SQL} SELECT id FROM m WHERE (account, folder) IN (SELECT DISTINCT account, folder FROM m_all WHERE folder IN ('fr', 'es') AND account < 'src3')")
def flt_folder(spark, d):
    every = messages(spark, d)
    resolved = every.filter(F.col("folder").isin("fr", "es") & (F.col("account") < "src3")).select("account", "folder").distinct()
    return f.in_folders(live_messages(spark, d), resolved).select("id")


@group.add("flt_thread", f"WITH {SQL}, c AS (SELECT id, 'c' || (id % 40) AS conversation FROM m_all) SELECT m.id FROM m LEFT JOIN c ON c.id = m.id WHERE provider_thread = 'p12' OR conversation = 'p12' OR conversation = 'c12'")
def flt_thread(spark, d):
    assigned = messages(spark, d).select("id", F.concat(F.lit("c"), (F.col("id") % 40).cast("string")).alias("conversation"))
    both = f.in_thread(live_messages(spark, d), assigned, "p12").select("id").union(f.in_thread(live_messages(spark, d), assigned, "c12").select("id"))
    return both.distinct()


@group.add("flt_row_is_distinct", f"WITH {SQL} SELECT count(*)::BIGINT AS changed FROM m_all x JOIN (SELECT id, CASE WHEN id % 9 = 0 THEN 'new' ELSE from_name END AS from_name, cc_emails FROM m_all) y USING (id) WHERE (x.from_name, x.cc_emails) IS DISTINCT FROM (y.from_name, y.cc_emails)")
def flt_row_is_distinct(spark, d):
    x = messages(spark, d).select("id", F.struct("from_name", "cc_emails").alias("old"))
    y = messages(spark, d).select("id", F.struct(F.when(F.col("id") % 9 == 0, "new").otherwise(F.col("from_name")).alias("from_name"), "cc_emails").alias("new"))
    return x.join(y, "id").filter(~F.col("old").eqNullSafe(F.col("new"))).agg(F.count("*").alias("changed"))
