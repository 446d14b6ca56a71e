"""Headers, parts, entities, inline images and calendars of messages, as column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named entities, and the longest References header.
NAMED = {"nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
MOST_REFERENCES = 900


def headers(raw: Column) -> Column:
    """Map of lower-cased names to values: folded lines are joined by a blank, of a repeated name the last counts."""
    lines = F.split(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\r?\n[ \t]+", " "), r"\r?\n")
    pairs = F.transform(F.filter(lines, lambda x: F.instr(x, ":") > 1), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def automated(head: Column, sender: Column) -> Column:
    """Mail that no person wrote: by Auto-Submitted, Precedence, a list header, or a sender that only machines use."""
    value = lambda k: F.lower(F.coalesce(F.try_element_at(head, F.lit(k)), F.lit("")))
    auto = (value("auto-submitted") != "") & (value("auto-submitted") != "no")
    bulk = value("precedence").isin("bulk", "junk", "list") | (value("list-id") != "")
    return auto | bulk | F.rlike(F.lower(F.coalesce(sender, F.lit(""))), F.lit(r"^(no-?reply|mailer-daemon|postmaster)@"))


def _letter(code: Column) -> Column:
    """The letter of a code point; null for surrogates and beyond Unicode."""
    ok = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def entities(c: Column) -> Column:
    """All entities decoded in one pass, so that nothing is decoded twice; unknown ones stay."""

    def piece(x: Column) -> Column:
        name = F.lower(F.regexp_extract(x, "^&([a-zA-Z]+);$", 1))
        known = functools.reduce(lambda w, n: w.when(name == n, NAMED[n]), NAMED, F.when(F.lit(False), ""))
        number = F.when(F.rlike(x, F.lit("^&#[0-9]{1,9};$")), F.regexp_extract(x, "([0-9]+)", 1).cast("long")).when(F.rlike(x, F.lit("^&#[xX][0-9a-fA-F]{1,8};$")), F.conv(F.regexp_extract(x, "[xX]([0-9a-fA-F]+)", 1), 16, 10).cast("long"))
        return F.coalesce(known, _letter(number), x)

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"&(?:#[xX]?[0-9a-fA-F]+|[a-zA-Z]+);|[^&]+|&"), F.lit(0)), piece), "")


#: An id as inline images have it.
CONTENT_ID = r"^[A-Za-z0-9][A-Za-z0-9._@+-]{0,254}$"
_ATTRIBUTE = r"""(?is)\s{0}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_URL = r"""(?is)url\(\s*(?:"([^"]*)"|'([^']*)'|([^)]*))\s*\)"""


def _one_of_three(c: Column, pattern: str) -> Column:
    """What the pattern's three groups take, of which one is there in each find."""
    groups = [F.regexp_extract_all(c, F.lit(pattern), F.lit(g)) for g in (1, 2, 3)]
    return F.zip_with(F.zip_with(groups[0], groups[1], lambda a, b: F.concat(a, b)), groups[2], lambda a, b: F.concat(a, b))


def _content_urls(pieces: Column) -> Column:
    """What follows cid: in the addresses of tags, style attributes and style elements; comments and texts do not count."""
    tags = F.filter(pieces, lambda x: F.rlike(x, F.lit(r"(?s)^<[a-zA-Z]")))
    head = lambda x: F.regexp_extract(x, r"(?s)^<[^>]*>?", 0)
    values = lambda name: F.flatten(F.transform(tags, lambda x: F.transform(_one_of_three(head(x), _ATTRIBUTE.format(name)), entities)))
    plain = [values(name) for name in ("src", "href", "background")]
    css = F.concat(
        values("style"),
        F.transform(F.filter(tags, lambda x: F.rlike(x, F.lit(r"(?i)^<style\b"))), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?s)^<[^>]*>?", ""), r"(?is)</style\s*>$", "")),
    )
    styled = F.flatten(F.transform(css, lambda x: _one_of_three(F.regexp_replace(x, r"(?s)/\*.*?\*/", ""), _URL)))
    urls = F.transform(F.concat(*plain, styled), lambda x: F.trim(x))  # trim alone would take the index, too
    return F.transform(F.filter(urls, lambda x: F.rlike(x, F.lit("(?i)^cid:"))), lambda x: F.substr(x, F.lit(5)))


def content_ids(html: Column) -> Column:
    """(ids, malformed): ids of inline images that HTML shows, percent signs decoded, each once; and addresses whose id cannot be one."""
    from .text import html_pieces  # text uses the entities above

    # A plus is a plus; only percent signs stand for others.
    decoded = F.transform(_content_urls(html_pieces(html)), lambda x: F.struct(x.alias("url"), F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))).alias("id")))
    fits = lambda x: F.coalesce(F.rlike(x["id"], F.lit(CONTENT_ID)), F.lit(False))
    ids = F.array_distinct(F.transform(F.filter(decoded, fits), lambda x: x["id"]))
    return F.struct(ids.alias("ids"), F.array_distinct(F.transform(F.filter(decoded, lambda x: ~fits(x)), lambda x: x["url"])).alias("malformed"))


def calendar(text: Column) -> Column:
    """(component, uid, recurrence_id, sequence, dtstart) of each event and task; a sequence that is no number is 0."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n[ \t]", "")
    blocks = F.regexp_extract_all(plain, F.lit(r"(?s)BEGIN:V(?:EVENT|TODO)\n.*?\nEND:V(?:EVENT|TODO)"), F.lit(0))

    def value(x: Column, name: str) -> Column:
        found = F.trim(F.regexp_extract(x, rf"(?im)^{name}(?:;[^:\n]*)?:(.*)$", 1))
        return F.when(found != "", found)

    def one(x: Column) -> Column:
        n = value(x, "SEQUENCE")
        return F.struct(F.regexp_extract(x, "^BEGIN:(V[A-Z]+)", 1).alias("component"), value(x, "UID").alias("uid"), value(x, "RECURRENCE-ID").alias("recurrence_id"), F.when(F.rlike(n, F.lit(r"^\d{1,9}$")), n.cast("int")).otherwise(0).alias("sequence"), value(x, "DTSTART").alias("dtstart"))

    return F.filter(F.transform(blocks, one), lambda x: x["uid"].isNotNull())


def references_chain(references: Column, in_reply_to: Column, own: Column, most: int = MOST_REFERENCES) -> Column:
    """The References header of a reply: the first id and as many of the newest as fit, each once; null without ids."""
    before = F.when(F.coalesce(references, F.lit("")) != "", references).otherwise(F.coalesce(in_reply_to, F.lit("")))
    chain = F.array_distinct(F.filter(F.split(F.concat_ws(" ", before, own), r"\s+"), lambda x: x != ""))
    start = F.struct(F.length(F.get(chain, F.lit(0))).alias("n"), F.array().cast("array<string>").alias("kept"), F.lit(True).alias("open"))

    def add(s: Column, x: Column) -> Column:
        n = s["n"] + 1 + F.length(x)
        fits = s["open"] & (n <= most)
        return F.struct(F.when(fits, n).otherwise(s["n"]).alias("n"), F.when(fits, F.concat(F.array(x), s["kept"])).otherwise(s["kept"]).alias("kept"), fits.alias("open"))

    newest = F.aggregate(F.reverse(F.slice(chain, 2, 1_000_000)), start, add)["kept"]
    return F.when(F.size(chain) > 0, F.array_join(F.concat(F.slice(chain, 1, 1), newest), " "))


def text_part(parts: Column, prefer: str = "plain") -> Column:
    """(part, format) of the body among leaves (part, type, disposition): inline text, of the preferred kind if there is one."""
    inline = F.filter(parts, lambda p: F.lower(p["type"]).isin("text/plain", "text/html", "text/x-amp-html") & (F.coalesce(p["disposition"], F.lit("inline")) == "inline"))
    form = lambda p: F.when(F.lower(p["type"]) == "text/plain", "plain").otherwise("html")
    choices = F.transform(inline, lambda p: F.struct(F.coalesce(F.nullif(F.trim(p["part"]), F.lit("")), F.lit("TEXT")).alias("part"), form(p).alias("format")))
    first = lambda kind: F.get(F.filter(choices, lambda c: c["format"] == kind), F.lit(0))
    other = "html" if prefer == "plain" else "plain"
    return F.coalesce(first(prefer), first(other))


def attachments(parts: Column) -> Column:
    """Leaves with a file name or an attachment disposition that are not the body, with the size that base64 hides."""
    files = F.filter(parts, lambda p: (F.coalesce(p["disposition"], F.lit("")) == "attachment") | (F.coalesce(p["filename"], F.lit("")) != ""))
    return F.transform(files, lambda p: F.struct(p["part"].alias("part"), p["filename"].alias("filename"), F.when(F.lower(p["encoding"]) == "base64", F.floor(p["size"] * 3 / 4)).otherwise(p["size"]).cast("long").alias("bytes")))
