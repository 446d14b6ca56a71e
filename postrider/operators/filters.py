"""Structured search filters as column expressions.

Values are literals, never parts of SQL or patterns: what users type cannot act
as a wild card unless a filter says so. A filter is a boolean column; ``any_of``
and ``negated`` combine them with SQL's three-valued logic, as null sizes need.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: MIME types of the named file kinds, and their other names.
FILE_KINDS = {
    "pdf": ("application/pdf",),
    "zip": ("application/zip", "application/x-zip-compressed", "application/gzip", "application/x-tar", "application/x-7z-compressed"),
    "doc": ("application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    "sheet": ("application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
}
OTHER_NAMES = {"archive": "zip", "word": "doc", "spreadsheet": "sheet", "excel": "sheet"}
FAMILIES = ("image", "video", "audio", "text")


def _low(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def _joined(*arrays: str) -> Column:
    return F.lower(F.array_join(F.concat(*[F.coalesce(F.col(a), F.array().cast("array<string>")) for a in arrays]), " "))


def sender(value: str) -> Column:
    v = F.lit(value.lower())
    return F.contains(_low("from_email"), v) | F.contains(_low("from_name"), v)


def sender_domain(value: str) -> Column:
    return F.split_part(F.lower("from_email"), F.lit("@"), F.lit(2)) == value.lower()


def recipient(value: str) -> Column:
    return F.contains(_joined("to_emails", "cc_emails"), F.lit(value.lower()))


def addressed(column: str, value: str) -> Column:
    """Substring of one address list: to_emails, cc_emails or bcc_emails."""
    return F.contains(_joined(column), F.lit(value.lower()))


def any_address(value: str, lists: tuple[str, ...] = ("to_emails", "cc_emails")) -> Column:
    every = F.concat_ws(" ", _low("from_email"), _joined(*lists))
    return F.contains(every, F.lit(value.lower()))


def subject(value: str) -> Column:
    return F.contains(_low("subject"), F.lit(value.lower()))


def message_id(value: str) -> Column:
    return normal_id(F.col("rfc_id")) == normal_id(F.lit(value))


def normal_id(c: Column) -> Column:
    """A Message-ID without its brackets, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.trim(c), r"^<|>$", "")))


def flagged(value: str) -> Column:
    return F.array_contains(F.coalesce("flags", F.array().cast("array<string>")), value)


def dated(after: str | None = None, before: str | None = None) -> Column:
    """From ``after`` on and earlier than ``before``."""
    c = F.lit(True)
    if after:
        c = c & (F.col("date") >= F.lit(after).cast("timestamp_ntz"))
    return c & (F.col("date") < F.lit(before).cast("timestamp_ntz")) if before else c


def larger(n: int) -> Column:
    return F.col("size") > n


def smaller(n: int) -> Column:
    return F.col("size") < n


def file_kind(value: str) -> Column:
    """On attachments: a named kind, a family of types, or a part of the type."""
    v = value.lower()
    v = OTHER_NAMES.get(v, v)
    if v in FILE_KINDS:
        return F.lower("mime").isin(*FILE_KINDS[v])
    return F.startswith(F.lower("mime"), F.lit(v + "/")) if v in FAMILIES else F.contains(F.lower("mime"), F.lit(v))


def file_name(value: str) -> Column:
    """On attachments: ``*`` and ``?`` are wild cards; without them a part of the name."""
    v = value.lower()
    if "*" not in v and "?" not in v:
        return F.contains(F.lower("filename"), F.lit(v))
    pattern = "".join({"*": "%", "?": "_"}.get(c, "\\" + c if c in "%_\\" else c) for c in v)
    return F.lower("filename").like(pattern)


def any_of(*filters: Column) -> Column:
    return functools.reduce(operator.or_, filters)


def negated(f: Column) -> Column:
    return ~f


def having(messages: DataFrame, attachments: DataFrame, f: Column, name: str) -> DataFrame:
    """``messages`` with a column whether an attachment fulfils ``f``; unlike a semi join it can stand in ``any_of``."""
    ids = attachments.filter(f).select(F.col("message_id").alias("__m")).distinct()
    return messages.join(ids, messages.id == F.col("__m"), "left").withColumn(name, F.col("__m").isNotNull()).drop("__m")


def in_folders(messages: DataFrame, folders: DataFrame) -> DataFrame:
    """Rows whose (account, folder) is among the resolved ones; none resolved, none found."""
    return messages.join(folders, ["account", "folder"], "left_semi")


def in_thread(messages: DataFrame, assigned: DataFrame, value: str) -> DataFrame:
    """Rows of a thread by the provider's id or the active conversation id."""
    j = messages.join(assigned.select(F.col("id").alias("__i"), "conversation"), F.col("id") == F.col("__i"), "left")
    return j.filter((F.col("provider_thread") == value) | (F.col("conversation") == value)).drop("__i")
