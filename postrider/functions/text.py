"""Text of messages: HTML, bodies, headers, subjects, addresses and evidence, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mime import entities

#: Tags that end a line of text, and tags that leave nothing behind.
BLOCKS = "br|p|div|li|h1|h2|h3|h4|h5|h6"
INLINE = "a|abbr|b|bdi|bdo|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|u|var"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"))
#: Elements whose content is no text; characters that only pad; blanks of a line.
HIDDEN = ("script", "style", "title")
PADDING = "\\u034F\\u00AD\\u200B\\u2060\\uFEFF"
BLANKS = "\\t\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
#: HTML in pieces: hidden elements, comments, tags, declarations, each to its end or that of the text, and what lies between.
PIECES = (
    "(?is)" + "|".join(rf"<{h}\b[^>]*(?:>.*?(?:</{h}\s*>|\z)|\z)" for h in HIDDEN)
    + r"|<!--.*?(?:-->|\z)|</?[a-z][a-z0-9]*\b[^>]*(?:>|\z)|<[!?][^>]*(?:>|\z)|[^<]+|<"
)
TAG_NAME = r"(?i)^</?([a-z][a-z0-9]*)\b"
#: HTML or CSS where plain text should be; an address in angle brackets is none.
MARKUP = (
    r"(?i)</?(?:html|head|body|meta|style|title|div|p|span|table|tr|td|font)(?:>|[\s/][^<>]{0,499}>)"
    r"|<[a-z][a-z0-9]*\s[^<>]{0,500}\bstyle\s*=|\{\s*-?[a-z][a-z-]*\s*:[^{}]{1,500}\}"
)


def html_pieces(html: Column) -> Column:
    """Hidden elements, comments, tags and texts of HTML, in order; nothing is read twice, so time grows with the length alone."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(PIECES), F.lit(0))


def decoded_entities(c: Column) -> Column:
    """The named entities of every mail; the ampersand last, so that nothing is decoded twice."""
    for name, value in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(value))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def normal_body(c: Column) -> Column:
    """Without padding characters; line ends as line feeds, one blank for each run of blanks of any kind and none around line ends, at most one empty line in a row."""
    c = F.regexp_replace(c, rf"[{PADDING}]|\u200C(?![\p{{L}}\p{{M}}])", "")
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, f"[{BLANKS}]+", " ")
    c = F.regexp_replace(c, r" ?\n ?", "\n")
    return F.btrim(F.regexp_replace(c, r"\n{3,}", "\n\n"), F.lit(" \n"))


def html_text(html: Column) -> Column:
    """Visible text of HTML: block tags end lines, inline tags leave nothing, other tags, comments and hidden elements a blank; what does not close goes to the end."""

    def shown(x: Column) -> Column:
        name = F.lower(F.regexp_extract(x, TAG_NAME, 1))
        ends, none = F.rlike(name, F.lit(f"^(?:{BLOCKS})$")), F.rlike(name, F.lit(f"^(?:{INLINE})$"))
        return F.when(~F.startswith(x, F.lit("<")) | (x == "<"), x).when(ends, "\n").when(none, "").otherwise(" ")

    return normal_body(entities(F.array_join(F.transform(html_pieces(html), shown), "")))


def is_markup(c: Column) -> Column:
    return F.rlike(F.coalesce(c, F.lit("")), F.lit(MARKUP))


def readable_body(plain: Column, html: Column) -> Column:
    """The plain part unless it is empty or is itself markup; HTML without visible text keeps the plain part."""
    normal = normal_body(plain)
    text = html_text(html)
    return F.when((F.coalesce(normal, F.lit("")) != "") & ~is_markup(normal), normal).when(F.coalesce(html, F.lit("")) == "", normal).otherwise(F.when(text != "", text).otherwise(F.coalesce(normal, F.lit(""))))


#: Where a quoted tail begins: an attribution line, a forwarded header, or trailing quote lines.
QUOTED = r"(?s)\n(?:On [^\n]{1,200}(?:\n(?!On )[^\n]{0,200}){0,3} wrote:\s*\n.*|-{2,} ?Original Message ?-{2,}.*|(?:>[^\n]*\n){1,}>[^\n]*\s*)$"
SIGNATURE = r"(?s)\n-- \n.*$"


def clean_body(c: Column, quoted: bool = False) -> Column:
    """(text, cut_quoted, cut_signature): a body without its signature and, unless wanted, the quoted tail."""
    base = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"), "￼", "")
    first = base if quoted else F.regexp_replace(base, QUOTED, "")
    second = F.regexp_replace(first, SIGNATURE, "")
    return F.struct(F.rtrim(F.regexp_replace(second, r"\s+$", "")).alias("text"), (first != base).alias("cut_quoted"), (second != first).alias("cut_signature"))


def bounded_utf8(c: Column, most: int = 32768) -> Column:
    """The longest prefix of whole characters within so many bytes."""
    b = F.encode(c, "UTF-8")
    # A cut character ends in continuation bytes behind a lead byte that wants more.
    cut = F.substring(b, 1, most)
    lead = lambda n: F.conv(F.hex(F.substring(b, most + 1 - n, 1)), 16, 10).cast("int")
    nxt = F.conv(F.hex(F.substring(b, most + 1, 1)), 16, 10).cast("int")
    inside = nxt.between(128, 191)
    back = F.when(~inside, 0).when(lead(1) >= 192, 1).when(lead(2) >= 192, 2).otherwise(3)
    whole = F.substring(b, F.lit(1), F.lit(most) - back)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.decode(F.when(inside, whole).otherwise(cut), "UTF-8"))


def reply_subject(c: Column) -> Column:
    """Exactly one ``Re:`` in front."""
    return F.concat(F.lit("Re: "), F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?i)^(?:re(?:\[\d+\])?\s*:\s*)+", ""))


def base_subject(c: Column) -> Column:
    """Without stacked reply and list marks; blanks collapsed."""
    c = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.regexp_replace(c, r"(?i)^(?:(?:\[[^\]]{1,40}\] ?)?(?:re|aw|sv|antw)(?:\[\d+\])?: ?)+", "")


def is_forward(c: Column) -> Column:
    return F.rlike(F.trim(c), F.lit(r"(?i)^(?:fwd?|wg|tr|rv|enc): ?"))


def quoted_reply(c: Column) -> Column:
    """Each line behind a mark, an empty last one too; only line feeds end lines. Nothing of an empty text."""
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.concat(F.lit("> "), F.replace(c, F.lit("\n"), F.lit("\n> "))))


def normal_address(c: Column) -> Column:
    """The local part as it is, the domain in lower case."""
    return F.concat(F.substring_index(F.trim(c), "@", 1), F.lit("@"), F.lower(F.substring_index(F.trim(c), "@", -1)))


def sanitized(c: Column, most: int = 500) -> Column:
    """An error text without addresses, secrets and control characters."""
    c = F.regexp_replace(c, r"[\w.+-]+@[\w.-]+", "<address>")
    c = F.regexp_replace(c, r"(?i)(password|token|secret)=\S+", "$1=<hidden>")
    return F.substring(F.regexp_replace(c, r"[\x00-\x1F\x7F]+", " "), 1, most)


def slice_text(c: Column, offset: int, most: int) -> Column:
    """(text, next_offset): code points from an offset, and where the rest begins."""
    n = F.length(c)
    return F.struct(F.substring(c, offset + 1, most).alias("text"), F.when(n > offset + most, offset + most).alias("next_offset"))


def message_ids(header: Column) -> Column:
    """All <id> tokens of a References header, in order, without repeats."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(header, F.lit("")), F.lit(r"<([^<>\s]{1,998})>"), F.lit(1)))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""href=["']([^"']+)["']"""), F.lit(1))


def resource(url: Column) -> Column:
    """What a link points to, for hosts that name resources in their paths."""
    part = lambda p, g=1: F.regexp_extract(url, p, g)
    return (
        F.when(F.rlike(url, F.lit(r"^https?://github\.com/[^/]+/[^/]+/(issues|pull)/\d+")), F.concat(F.lit("github:"), part(r"github\.com/([^/]+/[^/]+/(?:issues|pull)/\d+)")))
        .when(F.rlike(url, F.lit(r"^https?://(docs|drive)\.google\.com/.*/d/[\w-]+")), F.concat(F.lit("google_drive:"), part(r"/d/([\w-]+)")))
        .when(F.rlike(url, F.lit(r"^https?://[^/]+\.atlassian\.net/browse/[A-Z]+-\d+")), F.concat(F.lit("jira:"), part(r"/browse/([A-Z]+-\d+)")))
        .otherwise(F.concat(F.lit("host:"), F.lower(part(r"^https?://([^/?#]+)"))))
    )


def decoded_size(n: Column) -> Column:
    """Bytes behind so many base64 letters."""
    return F.floor(n * 3 / 4).cast("long")


def stable_uuid(c: Column) -> Column:
    """A UUID that the name fixes, from its SHA-1."""
    h = F.sha1(c)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
