"""Mailbox tables as views of the shared test tables, and the scans over them.

A document stands for a message: its source is the account, its language the
folder, its first line the subject. What documents lack (addresses, flags,
attachments) is computed from the id, so that SQL can say the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Types of attachments, in turn.
ARCHIVES = ("application/zip", "application/gzip", "application/x-7z-compressed")
FILES = ("application/pdf", "Application/PDF", "application/pdf", "text/csv", "application/vnd.ms-excel", "application/pdf", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    text = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    n = lambda k: (i % k).cast("string")
    flags = F.array_compact(F.array(F.when(i % 3 == 0, "\\Seen"), F.when(i % 7 == 0, "\\Flagged"), F.when(i % 11 == 0, "\\Answered")))
    none = F.array().cast("array<string>")
    return read(spark, sf_dir, "documents").select(
        i.alias("id"), F.col("source").alias("account"), F.col("lang").alias("folder"),
        F.substring_index("text", "\n", 1).alias("subject"), F.col("text").alias("body"), F.col("n_chars").alias("size"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(i * 37 % 525600).cast("int"))).alias("date"),
        F.when(i % 19 == 3, text("Newsletter@host", n(7), ".example")).otherwise(text("user", n(50), "@host", n(7), ".example")).alias("from_email"),
        F.when(i % 4 != 0, text("User ", n(50))).alias("from_name"),
        F.concat(F.array(text("user", (i * 3 % 50).cast("string"), "@host1.example")), F.when(i % 2 == 0, F.array(F.lit("team@host2.example"))).otherwise(none)).alias("to_emails"),
        F.when(i % 5 == 0, F.array(F.lit("boss@host3.example"), F.lit(None).cast("string"))).alias("cc_emails"),
        F.when(i % 13 != 0, flags).alias("flags"), (i % 17 == 0).alias("deleted"),
        text("<", i.cast("string"), "@Host.Example>").alias("rfc_id"),
        F.when(i % 6 == 0, text("p", (i % 90).cast("string"))).alias("provider_thread"),
        F.when(i % 9 == 0, F.create_map(F.lit("list-id"), F.lit("<x>"))).when(i % 14 == 0, F.create_map(F.lit("list-unsubscribe"), F.lit("<y>"))).when(i % 2 == 0, F.create_map().cast("map<string,string>")).alias("headers"),
    )


def live_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reads see: rows that are not marked as deleted."""
    return messages(spark, sf_dir).filter(~F.col("deleted"))


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    zipped = i % 10 == 0
    return read(spark, sf_dir, "documents").filter(i % 5 == 0).select(
        i.alias("message_id"), F.lit("2").alias("part"),
        F.when(zipped, "Archive_1.zip").otherwise(F.concat(F.lit("report-"), i.cast("string"), F.lit(".pdf"))).alias("filename"),
        F.when(zipped, F.element_at(F.array(*map(F.lit, ARCHIVES)), (F.floor(i / 10) % 3 + 1).cast("int"))).otherwise(F.element_at(F.array(*map(F.lit, FILES)), (F.floor(i / 5) % 7 + 1).cast("int"))).alias("mime"),
        F.when(i % 15 == 0, "inline").otherwise("attachment").alias("disposition"), (i * 100).alias("bytes"),
    )


#: The same views in SQL; put before a query's own parts.
SQL = r"""
m_all AS (SELECT doc_id AS id, source AS account, lang AS folder, split_part(text, chr(10), 1) AS subject, text AS body, n_chars AS size,
  TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (doc_id * 37 % 525600) AS date,
  CASE WHEN doc_id % 19 = 3 THEN 'Newsletter' ELSE 'user' || (doc_id % 50) END || '@host' || (doc_id % 7) || '.example' AS from_email, doc_id % 9 = 0 OR doc_id % 14 = 0 AS listed,
  CASE WHEN doc_id % 4 <> 0 THEN 'User ' || (doc_id % 50) END AS from_name,
  CASE WHEN doc_id % 2 = 0 THEN ['user' || (doc_id * 3 % 50) || '@host1.example', 'team@host2.example'] ELSE ['user' || (doc_id * 3 % 50) || '@host1.example'] END AS to_emails,
  CASE WHEN doc_id % 5 = 0 THEN ['boss@host3.example', NULL] END AS cc_emails,
  CASE WHEN doc_id % 13 <> 0 THEN list_filter([CASE WHEN doc_id % 3 = 0 THEN '\Seen' END, CASE WHEN doc_id % 7 = 0 THEN '\Flagged' END, CASE WHEN doc_id % 11 = 0 THEN '\Answered' END], lambda x: x IS NOT NULL) END AS flags,
  doc_id % 17 = 0 AS deleted, '<' || doc_id || '@Host.Example>' AS rfc_id,
  CASE WHEN doc_id % 6 = 0 THEN 'p' || (doc_id % 90) END AS provider_thread FROM documents),
m AS (SELECT * FROM m_all WHERE NOT deleted),
a AS (SELECT doc_id AS message_id, '2' AS part, CASE WHEN doc_id % 10 = 0 THEN 'Archive_1.zip' ELSE 'report-' || doc_id || '.pdf' END AS filename,
  CASE WHEN doc_id % 10 = 0 THEN ['application/zip', 'application/gzip', 'application/x-7z-compressed'][(doc_id // 10 % 3 + 1)::INT] ELSE ['application/pdf', 'Application/PDF', 'application/pdf', 'text/csv', 'application/vnd.ms-excel', 'application/pdf', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'][(doc_id // 5 % 7 + 1)::INT] END AS mime,
  CASE WHEN doc_id % 15 = 0 THEN 'inline' ELSE 'attachment' END AS disposition, doc_id * 100 AS bytes FROM documents WHERE doc_id % 5 = 0)
"""
