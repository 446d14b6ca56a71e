"""Raw messages as trees of parts: a reader of MIME bytes that takes anything, in Arrow batches."""

from __future__ import annotations

import binascii
import codecs
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.columns import only

#: Levels of parts below the message, and characters of HTML that are read.
MOST_DEPTH, MOST_HTML = 64, 1_048_576
#: Bounds of one message: parts, bytes of a header block, and bytes of a batch of messages that a task holds.
MOST_PARTS, MOST_HEADER = 10_000, 1 << 20
#: What names a charset that Python calls otherwise.
CHARSETS = {"x-unknown": "utf-8", "unknown-8bit": "utf-8", "utf8mb4": "utf-8", "x-sjis": "shift_jis", "ks_c_5601-1987": "cp949", "iso-8859-8-i": "iso-8859-8", "ansi": "cp1252"}

_END = re.compile(rb"\r?\n")
_WORD = re.compile(r"=\?([^?\s]+)\?([bBqQ])\?([^?]*)\?=")
_BETWEEN = re.compile(r"(\?=)\s+(=\?[^?\s]+\?[bBqQ]\?)")
_PARAMETER = re.compile(r';\s*([^\s=;]+)\s*=\s*("(?:[^"\\]|\\.)*"?|[^;]*)')
_ESCAPE = re.compile(rb"=([0-9A-Fa-f]{2})")
_NOT_BASE64 = re.compile(rb"[^A-Za-z0-9+/]")


def decoded_text(raw: bytes, charset: str | None) -> str:
    """Bytes in a charset; without one, or in an unknown one, UTF-8 if they are valid, else Windows-1252. What cannot be decoded is replaced."""
    name = (charset or "").strip().strip("'\"").lower()
    try:
        codec = codecs.lookup(CHARSETS.get(name, name)) if name else None
        if codec is not None and not codec._is_text_encoding:
            codec = None
    except (LookupError, ValueError):
        codec = None
    if codec is not None:
        try:
            return raw.decode(codec.name, "replace")
        except (UnicodeError, ValueError, AssertionError):
            pass
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("utf-8" if name else "cp1252", "replace")


def base64_bytes(raw: bytes) -> bytes:
    """Letters of the alphabet up to the first padding; all others are passed over, and a group of one letter at the end is lost."""
    clean = _NOT_BASE64.sub(b"", raw.partition(b"=")[0] if b"=" in raw else raw)
    if len(clean) % 4 == 1:
        clean = clean[:-1]
    return binascii.a2b_base64(clean + b"=" * (-len(clean) % 4))


def quoted_bytes(raw: bytes) -> bytes:
    """Quoted-printable: blanks at a line's end go, soft breaks join, and an escape that is none stays as it is."""
    out = re.sub(rb"[ \t]+(?=\r?\n|$)", b"", raw)
    out = re.sub(rb"=\r?\n", b"", out)
    out = out[:-1] if out.endswith(b"=") else out
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 16)]), out)


def _transferred(raw: bytes, encoding: str) -> bytes:
    return base64_bytes(raw) if encoding == "base64" else quoted_bytes(raw) if encoding == "quoted-printable" else raw


def words_decoded(value: str) -> str:
    """A header's encoded words, each in its charset; white space between two of them goes."""
    if "=?" not in value:
        return value

    def word(m: re.Match) -> str:
        raw = m[3].encode("utf-8", "surrogateescape")
        raw = base64_bytes(raw) if m[2] in "bB" else quoted_bytes(raw.replace(b"_", b" ") + b".")[:-1]
        return decoded_text(raw, m[1].split("*")[0])

    return _WORD.sub(word, _BETWEEN.sub(r"\1\2", value))


def header_fields(block: bytes) -> list[tuple[str, str]]:
    """(lower-case name, value) of each field: folded lines are joined, lines without a name are passed over."""
    fields: list[tuple[str, list[str]]] = []
    for line in _END.split(block[:MOST_HEADER]):
        text = line.decode("utf-8", "replace")
        if not text.strip():
            continue
        if text[0] in " \t" and fields:
            fields[-1][1].append(text.strip())
            continue
        name, colon, value = text.partition(":")
        if colon and name.strip() and not text[0].isspace():
            fields.append((name.strip().lower(), [value.strip()]))
    return [(name, " ".join(p for p in parts if p)) for name, parts in fields]


def _percent(value: str) -> bytes:
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), value.encode())


def parameters(value: str) -> tuple[str, dict[str, str]]:
    """(value, parameters) of a structured header: quoted or plain, in pieces (name*0, name*1) and with a charset (name*)."""
    head = value.partition(";")[0].strip().lower()
    plain: dict[str, str] = {}
    pieces: dict[str, list[tuple[int, bool, str]]] = {}
    for name, raw in _PARAMETER.findall(value):
        raw = raw.strip()
        if raw.startswith('"'):
            raw = re.sub(r"\\(.)", r"\1", raw[1:].removesuffix('"'))
        base, star, rest = name.lower().partition("*")
        if not star:
            plain.setdefault(base, words_decoded(raw))
            continue
        number = rest.rstrip("*")
        if number and not (number.isascii() and number.isdigit() and len(number) < 5):
            continue
        pieces.setdefault(base, []).append((int(number or 0), rest.endswith("*") or not rest, raw))
    for base, found in pieces.items():
        found.sort(key=lambda p: p[0])
        charset = None
        raw = b""
        for i, (_, encoded, text) in enumerate(found):
            if encoded and i == 0 and text.count("'") >= 2:
                charset, _, text = text.split("'", 2)
            raw += _percent(text) if encoded else text.encode()
        plain[base] = decoded_text(raw, charset)
    return head, plain


@dataclass
class Part:
    """A part: its number (1.2: the second part of the first; a message without parts is 1), type and content."""

    number: str
    depth: int
    fields: list[tuple[str, str]]
    content: bytes = b""
    children: list[Part] = field(default_factory=list)

    def value(self, name: str) -> str:
        return next((v for n, v in self.fields if n == name), "")

    def __post_init__(self) -> None:
        self.type, self.params = parameters(self.value("content-type"))
        if not re.fullmatch(r"[^\s/]+/[^\s/]+", self.type):
            self.type = "text/plain"
        self.disposition, named = parameters(self.value("content-disposition"))
        self.filename = named.get("filename") or self.params.get("name") or None
        self.content_id = self.value("content-id").strip().removeprefix("<").removesuffix(">") or None
        self.encoding = self.value("content-transfer-encoding").split(";")[0].strip().lower()

    def is_body(self) -> bool:
        return self.type in ("text/plain", "text/html", "text/x-amp-html") and self.disposition in ("", "inline") and not (self.filename and self.disposition)


def _split_head(raw: bytes) -> tuple[bytes, bytes]:
    """(header block, content): parted by the first empty line; content that begins with one has no header."""
    if raw[:1] == b"\n" or raw[:2] == b"\r\n":
        return b"", raw[1 if raw[:1] == b"\n" else 2 :]
    m = re.search(rb"\r?\n\r?\n", raw)
    return (raw, b"") if m is None else (raw[: m.start()], raw[m.end() :])


def _bodies(content: bytes, boundary: bytes) -> tuple[list[bytes], bool]:
    """(what lies between the boundary's lines, whether the last one closes): text before the first and after the closing line does not count."""
    line = re.compile(rb"(?:^|\r?\n)--" + re.escape(boundary) + rb"(--)?[ \t]*(?=\r?\n|$)")
    out, start = [], None
    for m in line.finditer(content):
        if start is not None:
            out.append(content[start : max(start, m.start())])
        if m[1]:
            return out, True
        end = _END.match(content, m.end())
        start = end.end() if end else m.end()
        # The next line may be a boundary at once: its line break is this one's end.
        if len(out) >= MOST_PARTS:
            return out, False
    if start is not None:
        out.append(content[start:])
    return out, False


def parsed(raw: bytes) -> tuple[Part, list[str]]:
    """The tree of a message, and what was wrong with it. Takes any bytes; parts deeper than :data:`MOST_DEPTH`, and beyond :data:`MOST_PARTS`, are not opened."""
    warnings: dict[str, None] = {}
    made = 0

    def part(raw: bytes, number: str, depth: int) -> Part:
        nonlocal made
        made += 1
        head, content = _split_head(raw)
        if len(head) > MOST_HEADER:
            warnings["header_truncated"] = None
        p = Part(number, depth, header_fields(head), content)
        if not p.type.startswith("multipart/"):
            return p
        boundary = p.params.get("boundary", "").rstrip()
        if not boundary:
            warnings["boundary_missing"] = None
            p.type = "text/plain"
            return p
        if depth >= MOST_DEPTH:
            warnings["depth_truncated"] = None
            return p
        bodies, closed = _bodies(content, boundary.encode("utf-8", "replace"))
        if not closed:
            warnings["boundary_not_closed"] = None
        for i, body in enumerate(bodies, 1):
            if made >= MOST_PARTS:
                warnings["parts_truncated"] = None
                break
            p.children.append(part(body, f"{number}.{i}" if number else str(i), depth + 1))
        p.content = b""
        return p

    root = part(raw, "", 0)
    if not root.children:
        root.number = "1"
    return root, list(warnings)


def leaves(root: Part) -> Iterator[Part]:
    """Parts without parts of their own, in order; an open multipart that has none is no leaf."""
    if root.children:
        for c in root.children:
            yield from leaves(c)
    elif not root.type.startswith("multipart/"):
        yield root


_LEAF = pa.struct([("part", pa.string()), ("depth", pa.int32()), ("type", pa.string()), ("charset", pa.string()), ("disposition", pa.string()), ("filename", pa.string()), ("content_id", pa.string()), ("encoding", pa.string()), ("encoded_size", pa.int64()), ("size", pa.int64()), ("sha256", pa.string()), ("is_body", pa.bool_()), ("related", pa.bool_())])
_DDL = "doc long, raw_bytes long, raw_sha256 string, headers map<string,array<string>>, body_plain string, body_html string, parts array<struct<part:string,depth:int,type:string,charset:string,disposition:string,filename:string,content_id:string,encoding:string,encoded_size:long,size:long,sha256:string,is_body:boolean,related:boolean>>, warnings array<string>"


def message_row(raw: bytes) -> dict:
    """What a raw message holds, as :func:`parsed_messages` returns it."""
    root, warnings = parsed(raw)
    headers: dict[str, list[str]] = {}
    for name, value in root.fields:
        headers.setdefault(name, []).append(words_decoded(value))
    related: set[str] = set()

    def mark(p: Part, inside: bool) -> None:
        if inside and not p.children:
            related.add(p.number)
        for c in p.children:
            mark(c, inside or p.type == "multipart/related")

    mark(root, False)
    parts, texts = [], {"text/plain": [], "text/html": []}
    for p in leaves(root):
        content = _transferred(p.content, p.encoding)
        body = p.is_body()
        if body:
            texts["text/plain" if p.type == "text/plain" else "text/html"].append(decoded_text(content, p.params.get("charset")))
        parts.append({"part": p.number, "depth": p.depth, "type": p.type, "charset": p.params.get("charset"), "disposition": p.disposition or None, "filename": p.filename, "content_id": p.content_id, "encoding": p.encoding or None, "encoded_size": len(p.content), "size": len(content), "sha256": hashlib.sha256(content).hexdigest(), "is_body": body, "related": p.number in related})
    html = "<br/>\n".join(texts["text/html"]) if texts["text/html"] else None
    if html is not None and len(html) > MOST_HTML:
        warnings.append("html_truncated_for_text_extraction")
        html = html[:MOST_HTML]
    clean = lambda s: None if s is None else s.encode("utf-8", "replace").decode()
    plain = "\n".join(texts["text/plain"]) if texts["text/plain"] else None
    return {"raw_bytes": len(raw), "raw_sha256": hashlib.sha256(raw).hexdigest(), "headers": list(headers.items()), "body_plain": clean(plain), "body_html": clean(html), "parts": parts, "warnings": warnings}


def parsed_messages(messages: DataFrame, id_col: str = "id", raw_col: str = "raw") -> DataFrame:
    """(id, raw_bytes, raw_sha256, headers, body_plain, body_html, parts, warnings) of each raw message.

    ``raw_col`` is binary. Headers are those of the message, each name with all
    its values, encoded words decoded. ``parts`` are the leaves of the tree in
    order: number, level, type, charset, disposition, file name, content id,
    size as sent and decoded, SHA-256 of the decoded bytes, whether it is text
    of the body, and whether it lies in a multipart/related. ``body_plain`` and
    ``body_html`` join the texts of the body, in Unicode. A message within a
    message is a leaf.

    Any bytes give a row: a boundary that is missing or never closes, an
    encoding that breaks off, and a part that is too deep are named in
    ``warnings``. A null message has null in all other columns but ``parts``
    and ``warnings``, which are empty.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["raw_bytes", "raw_sha256", "headers", "body_plain", "body_html", "parts", "warnings"]
        kinds = [pa.int64(), pa.string(), pa.map_(pa.string(), pa.list_(pa.string())), pa.string(), pa.string(), pa.list_(_LEAF), pa.list_(pa.string())]
        empty = dict.fromkeys(names) | {"parts": [], "warnings": []}
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                rows = [message_row(x.as_py()) if x.is_valid else empty for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)]], ["doc", *names])

    rows = only(messages, doc=F.col(f"`{id_col}`").cast("long"), raw=F.col(f"`{raw_col}`").cast("binary"))
    return rows.mapInArrow(parse, _DDL).withColumnRenamed("doc", "id")
