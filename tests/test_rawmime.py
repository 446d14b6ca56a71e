"""The reader of raw messages against messages that the standard library builds, and against anything else."""

import hashlib
import random
from email.message import EmailMessage, MIMEPart

import pytest

from postrider.functions.rawmime import MOST_DEPTH, base64_bytes, header_fields, leaves, message_row, parameters, parsed, parsed_messages, quoted_bytes, words_decoded


def built(r, depth=0):
    """A part, and its leaves as (type, content, file name)."""
    if depth < 4 and r.random() < (0.9 if depth == 0 else 0.4):
        p = EmailMessage() if depth == 0 else MIMEPart()
        p["Content-Type"] = f'multipart/{r.choice(["mixed", "alternative", "related"])}; boundary="b{r.randrange(10**9)}:{depth}"'
        p.set_payload([])
        found = []
        for _ in range(r.randint(1, 4)):
            child, more = built(r, depth + 1)
            p.attach(child)
            found += more
        return p, found
    p = EmailMessage() if depth == 0 else MIMEPart()
    text = "".join(r.choice(["a", "é", "=", " ", "\n", "中", "--b", ".", "\t", "From x"]) for _ in range(r.randint(0, 200))) + "\n"
    if r.random() < 0.6:
        kind = r.choice(["plain", "html"])
        p.set_content(text, subtype=kind, cte=r.choice(["base64", "quoted-printable"]), charset="utf-8")
        return p, [(f"text/{kind}", text.encode(), None)]
    data = bytes(r.randrange(256) for _ in range(r.randint(0, 300)))
    name = r.choice(["a.bin", "Übersicht 1.pdf", "x" * 90 + "é.txt"])
    p.set_content(data, maintype="application", subtype="pdf", filename=name)
    return p, [("application/pdf", data, name)]


def test_messages_of_the_standard_library():
    r = random.Random(9)
    for _ in range(150):
        message, want = built(r)
        message["Subject"] = "Ärger: " + "wort " * r.randint(0, 40)
        raw = message.as_bytes()
        if r.random() < 0.5:
            raw = raw.replace(b"\n", b"\r\n")
        row = message_row(raw)
        got = [(p["type"], p["filename"]) for p in row["parts"]]
        assert got == [(t, n) for t, _, n in want]
        for p, (_, content, _) in zip(row["parts"], want, strict=True):
            if p["type"] == "application/pdf":
                assert (p["size"], p["sha256"]) == (len(content), hashlib.sha256(content).hexdigest())
        lines = lambda s: (s or "").replace("\r\n", "\n")
        for kind, key, join in (("text/plain", "body_plain", "\n"), ("text/html", "body_html", "<br/>\n")):
            texts = [c.decode() for t, c, _ in want if t == kind]
            assert lines(row[key]).rstrip("\n") == join.join(texts).rstrip("\n") or any(t.endswith("\n\n") for t in texts)
        assert row["warnings"] == [] and " ".join(dict(row["headers"])["subject"][0].split()) == " ".join(str(message["Subject"]).split())


def test_any_bytes_give_a_row():
    r = random.Random(10)
    pieces = [b"\r\n", b"\n", b"--b", b"--b--", b"Content-Type: multipart/mixed; boundary=b", b"Content-Type: text/plain; charset=nope", b"Content-Transfer-Encoding: base64", b"=?utf-8?B?w?=", b"Subject: =?x?Q?=E9?= =?utf-8?q?=C3=A9?=", b"\xff\x00", b":", b" folded", b"name*0*=utf-16'x'%", b"Content-Disposition: attachment; filename*1=b; filename*0*=%zz"]
    for _ in range(2000):
        raw = b"".join(r.choice(pieces) for _ in range(r.randint(0, 25)))
        row = message_row(raw)
        assert row["raw_bytes"] == len(raw)
    for _ in range(300):
        message_row(bytes(r.randrange(256) for _ in range(r.randint(0, 400))))


def test_truncated_messages_keep_what_came_before():
    message, want = built(random.Random(11))
    raw = message.as_bytes()
    whole = message_row(raw)["parts"]
    for end in range(0, len(raw), 7):
        parts = message_row(raw[:end])["parts"]
        assert [p["sha256"] for p in parts[:-1]] == [p["sha256"] for p in whole[: len(parts)]][: len(parts) - 1]
        assert len(parts) <= len(whole)


def nested(depth):
    raw = b"Content-Type: text/plain\r\n\r\ndeep"
    for i in range(depth):
        raw = b"Content-Type: multipart/mixed; boundary=b%d\r\n\r\n--b%d\r\n" % (i, i) + raw + b"\r\n--b%d--\r\n" % i
    return raw


def test_bounds():
    assert [p.content for p in leaves(parsed(nested(MOST_DEPTH))[0])] == [b"deep"]
    root, warnings = parsed(nested(MOST_DEPTH + 1))
    assert list(leaves(root)) == [] and warnings == ["depth_truncated"]
    many = b"Content-Type: multipart/mixed; boundary=b\r\n\r\n" + b"--b\r\n\r\nx\r\n" * 20_000
    row = message_row(many)
    assert len(row["parts"]) < 10_001 and "parts_truncated" in row["warnings"]
    html = message_row(b"Content-Type: text/html\r\n\r\n" + b"x" * 2_000_000)
    assert len(html["body_html"]) == 1_048_576 and html["warnings"] == ["html_truncated_for_text_extraction"]


@pytest.mark.parametrize(("raw", "want"), [(b"YQ==", b"a"), (b"YW\r\nJj\tZA", b"abcd"), (b"YWJjZ", b"abc"), (b"", b""), (b"!!", b""), (b"YQ==YQ==", b"a")])
def test_base64(raw, want):
    assert base64_bytes(raw) == want


@pytest.mark.parametrize(("raw", "want"), [(b"a=3Db", b"a=b"), (b"a=\r\nb", b"ab"), (b"a =\nb  \r\nc\t", b"a b\r\nc"), (b"=zz=4", b"=zz=4"), (b"x=", b"x")])
def test_quoted_printable(raw, want):
    assert quoted_bytes(raw) == want


def test_headers():
    block = b"A: one\r\n two\r\n\tthree\r\nno colon\r\nB:\r\na: four\r\n: none\r\nC : x"
    assert header_fields(block) == [("a", "one two three"), ("b", ""), ("a", "four"), ("c", "x")]
    assert words_decoded("=?iso-8859-1?Q?a=E9_b?= =?utf-8?B?w6k=?= c =?utf-8?q?d?=") == "aé bé c d"
    assert parameters("Text/Plain; charset=\"utf-8\"; name*1*=%C3%A9; name*0*=utf-8'de'a; x=\"a\\\"b;c\"; name=other") == ("text/plain", {"charset": "utf-8", "name": "aé", "x": 'a"b;c'})
    assert parameters("") == ("", {})


def test_parts():
    raw = b"""Content-Type: multipart/related; boundary="a b"

preamble
--a b
Content-Type: multipart/alternative; boundary=c

--c

plain\xe9
--c
Content-Type: text/html; charset=iso-8859-1

<p>\xe9</p>
--c--
--a b
Content-Type: image/png
Content-ID: <i1@x>
Content-Disposition: inline
Content-Transfer-Encoding: base64

AAAA
--a b
Content-Type: text/plain; name=notes.txt
Content-Disposition: attachment

file
--a b--
epilogue"""
    row = message_row(raw)
    assert (row["body_plain"], row["body_html"]) == ("plainé", "<p>é</p>")
    assert [(p["part"], p["type"], p["filename"], p["content_id"], p["size"], p["is_body"], p["related"]) for p in row["parts"]] == [
        ("1.1", "text/plain", None, None, 6, True, True), ("1.2", "text/html", None, None, 8, True, True), ("2", "image/png", None, "i1@x", 3, False, True), ("3", "text/plain", "notes.txt", None, 4, False, True)]


def test_rows(spark):
    df = spark.createDataFrame([(1, bytearray(b"Subject: a\r\n\r\nbody"), "x"), (2, None, "x"), (3, bytearray(b""), "x")], "id long, raw binary, doc string")
    got = {x.id: x for x in parsed_messages(df).collect()}
    assert got[1].body_plain == "body" and got[1].headers == {"subject": ["a"]} and [p.part for p in got[1].parts] == ["1"]
    assert got[2].parts == [] and got[2].raw_bytes is None and got[3].raw_bytes == 0
    assert parsed_messages(df.limit(0)).count() == 0
