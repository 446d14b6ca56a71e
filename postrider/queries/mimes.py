"""Headers, parts and calendars of messages, and sinks of results and payloads."""

from pyspark.sql import functions as F

from ..functions import mime as t
from ..functions.rawmime import parsed_messages
from ..operators.parttree import attached, body_parts, described, leaf_parts
from ..plans.staging import shared_dir, stage
from ..sources.tables import SQL, live_messages, read
from . import Group

group = Group()
add = group.add


def joined(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@add("mim_headers", f"WITH {SQL} SELECT id, 'A ' || id || ' folded on' AS subject, 'two: ' || (id % 5) AS x, 3 AS n FROM m")
def mim_headers(spark, d):
    """Folded lines are joined, names are in lower case, the last of repeated ones counts, what is no header is left out."""
    i = F.col("id")
    raw = joined("Subject: A ", i, "\r\n folded\r\n\ton\r\nX-A: one\r\nno header\r\nx-a: two: ", i % 5, "\nEmpty:\n\n")
    h = live_messages(spark, d).select("id", t.headers(raw).alias("h"))
    return h.select("id", F.col("h")["subject"].alias("subject"), F.col("h")["x-a"].alias("x"), F.size("h").alias("n"))


@add("thr_automated", f"WITH {SQL} SELECT id, id % 7 IN (1, 3, 4, 5) OR id % 4 = 0 AS automated FROM m")
def thr_automated(spark, d):
    k = F.col("id") % 7
    line = F.when(k == 1, "Auto-Submitted: auto-replied").when(k == 2, "Auto-Submitted: no").when(k == 3, "Precedence: Bulk").when(k == 4, "List-Id: <a.b>").when(k == 5, "Precedence: junk").otherwise("X: y")
    sender = F.when(F.col("id") % 4 == 0, "No-Reply@host.example").otherwise(F.col("from_email"))
    return live_messages(spark, d).select("id", t.automated(t.headers(line), sender).alias("automated"))


@add("txt_entities_all", f"WITH {SQL} SELECT id, subject || ' \u00e9\u4e2d\U0001f600&lt;&#xD800;&bogus;& <' AS text FROM m")
def txt_entities_all(spark, d):
    """Named and numeric entities in one pass; surrogates, unknown names and a bare ampersand stay."""
    return live_messages(spark, d).select("id", t.entities(F.concat(F.replace("subject", F.lit("&"), F.lit("&amp;")), F.lit(" &#233;&#x4E2D;&#x1F600;&amp;lt;&#xD800;&bogus;& &LT;"))).alias("text"))


@add("txt_cid_refs", "SELECT page_id, 'a@b,e+f,c' || page_id || ',d,s1' AS refs, 'b%20d,%zz,g&h' AS malformed FROM pages")
def txt_cid_refs(spark, d):
    """Ids of inline images in attributes, styles and style elements; a plus stays, comments and text do not count, what cannot be an id is told apart."""
    more = joined('<img src="cid:a%40b"><!-- <img src="cid:no"> --><a href=cid:e+f><td background=\'cid:c', F.col("page_id"), '\'><p style="background: url( &quot;cid:d&quot; )"><img src="CID:a%40b"> src="cid:text" <style>/* url(cid:gone) */ p { background: URL(\'cid:s1\') }</style><img src="cid:b%20d"><img src="cid:%zz"><img src="cid:g&amp;h">')
    return read(spark, d, "pages").select("page_id", t.content_ids(F.concat("html", more)).alias("c")).select("page_id", F.array_join("c.ids", ",").alias("refs"), F.array_join("c.malformed", ",").alias("malformed"))


@add("mim_calendar", f"WITH {SQL} SELECT id, unnest(['VEVENT', 'VTODO']) AS component, unnest(['u' || id, 't' || id]) AS uid, unnest([NULL, '20240102']) AS recurrence_id, unnest([id % 7, 0])::INT AS sequence, unnest(['20240101T000000', NULL]) AS dtstart FROM m")
def mim_calendar(spark, d):
    """Identities of events and tasks; lines are unfolded, parameters left out, a component without an id is none."""
    i = F.col("id")
    text = joined("BEGIN:VCALENDAR\r\nMETHOD:REQUEST\r\nBEGIN:VEVENT\r\nUID:u", i, "\r\nSEQUENCE:", i % 7, "\r\nDTSTART;TZID=X:20240101\r\n T000000\r\nEND:VEVENT\r\nBEGIN:VTODO\r\nUID:t", i, "\r\nRECURRENCE-ID:20240102\r\nSEQUENCE:many\r\nEND:VTODO\r\nBEGIN:VEVENT\r\nDTSTART:1\r\nEND:VEVENT\r\nEND:VCALENDAR")
    return live_messages(spark, d).select("id", F.inline(t.calendar(text)))


@add("addr_references", f"WITH {SQL} SELECT id, CASE id % 3 WHEN 0 THEN '<first> <b' || id || '> ' || rfc_id WHEN 1 THEN '<r> ' || rfc_id ELSE rfc_id END AS refs FROM m")
def addr_references(spark, d):
    """The chain of a reply within its length: the first id, then the newest that fit."""
    i = F.col("id")
    long = joined("<first> <", F.repeat(F.lit("x"), 60), "> <b", i, "> <b", i, ">")
    refs = F.when(i % 3 == 0, long)
    return live_messages(spark, d).select("id", t.references_chain(refs, F.when(i % 3 == 1, F.lit("<r>")), F.col("rfc_id"), most=60).alias("refs"))


def parts(i):
    leaf = lambda part, kind, disposition, name, size: F.struct(F.lit(part).alias("part"), F.lit(kind).alias("type"), disposition.cast("string").alias("disposition"), F.lit(name).cast("string").alias("filename"), F.lit("base64").alias("encoding"), size.cast("long").alias("size"))
    none = F.lit(None)
    html, plain = leaf("1.2", "Text/HTML", none, None, F.lit(10)), leaf("1.1", "text/plain", F.when(i % 2 == 0, F.lit("attachment")), None, i * 4)
    file = leaf("2", "application/pdf", F.lit("attachment"), "a.pdf", i * 8)
    return F.when(i % 5 == 0, F.array(file)).otherwise(F.array(html, plain, file))


@add("mim_text_part", f"WITH {SQL} SELECT id, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 2 = 0 THEN '1.2' ELSE '1.1' END AS part, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 2 = 0 THEN 'html' ELSE 'plain' END AS format FROM m")
def mim_text_part(spark, d):
    """The leaf that is the body: inline text, plain before HTML."""
    return live_messages(spark, d).select("id", t.text_part(parts(F.col("id"))).alias("b")).select("id", "b.part", "b.format")


@add("mim_attachments", f"WITH {SQL} SELECT id, '2' AS part, 'a.pdf' AS filename, id * 6 AS bytes FROM m UNION ALL SELECT id, '1.1', NULL, id * 3 FROM m WHERE id % 5 <> 0 AND id % 2 = 0")
def mim_attachments(spark, d):
    return live_messages(spark, d).select("id", F.inline(t.attachments(parts(F.col("id")))))


def raw_messages(spark, d):
    """Live messages as bytes: text in quoted-printable and HTML in base64 as alternatives, the body as an attached file, headers folded and encoded; some break off before the end."""
    i, b64 = F.col("id"), lambda c: F.base64(c.cast("binary"))
    quoted = F.replace(F.replace(F.regexp_replace(F.replace("body", F.lit("="), F.lit("=3D")), r" (?=\n|$)", "=20"), F.lit("\r"), F.lit("=0D")), F.lit("\n"), F.lit("\r\n"))
    head = joined("From: =?utf-8?B?", b64(joined("Ünï ", i)), "?= <u@x.example>\r\nSubject: Number\r\n ", i, "\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed;\r\n boundary=\"b ", i, "\"\r\n\r\npreamble\r\n--b ", i)
    text = joined("\r\nContent-Type: multipart/alternative; boundary=alt\r\n\r\n--alt\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n", quoted, "\r\n--alt\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Transfer-Encoding: BASE64\r\n\r\n", b64(joined("<p>", i, "</p>", F.col("body"))), "\r\n--alt--\r\n--b ", i)
    file = joined("\r\nContent-Type: application/pdf; name*0*=utf-8''n%C3%A9; name*1=.pdf\r\nContent-Disposition: attachment\r\nContent-Transfer-Encoding: base64\r\n\r\n", F.regexp_replace(b64(F.col("body")), "(.{76})", "$1\r\n"))
    end = F.when(i % 10 == 0, F.lit("")).otherwise(joined("\r\n--b ", i, "--\r\nepilogue"))
    return live_messages(spark, d).select("id", F.concat(head, text, file, end).cast("binary").alias("raw"))


@add("mim_raw_parse", f"""WITH {SQL} SELECT id, 'Number ' || id AS subject, 'Ünï ' || id || ' <u@x.example>' AS sender, '1.1 1.2 2' AS parts, sha256(replace(body, chr(10), chr(13) || chr(10))) AS plain, sha256('<p>' || id || '</p>' || body) AS html,
  'né.pdf' AS filename, strlen(body)::BIGINT AS bytes, sha256(body) AS file, CASE WHEN id % 10 = 0 THEN 'boundary_not_closed' ELSE '' END AS warnings FROM m""")
def mim_raw_parse(spark, d):
    """Raw messages as trees of parts: headers, texts of the body and files come back as they went in."""
    p = parsed_messages(raw_messages(spark, d))
    header = lambda name: F.col("headers")[name][0]
    last = F.element_at("parts", -1)
    return p.select(
        "id", header("subject").alias("subject"), header("from").alias("sender"), F.array_join("parts.part", " ").alias("parts"), F.sha2("body_plain", 256).alias("plain"), F.sha2("body_html", 256).alias("html"),
        last["filename"].alias("filename"), last["size"].alias("bytes"), last["sha256"].alias("file"), F.array_join("warnings", " ").alias("warnings"),
    )


def part_trees(spark, d):
    """Trees as servers describe them: two texts below the first part, then a file; of every hundredth message one text as deep as trees go, or a level deeper."""
    i = F.col("id")
    tree = joined('{"type":"multipart/mixed","childNodes":[{"type":"multipart","subtype":"alternative","childNodes":[{"part":"1.1","type":"text","subtype":"HTML","size":10},{"part":" 1.2 ","type":"text/plain; x","size":', i, F.when(i % 3 == 0, ',"disposition":"attachment"').otherwise(""), "}]},", '{"part":"2","type":"application/pdf","encoding":"BASE64","size":', i * 8, F.when(i % 2 == 0, ',"disposition":{"type":"Attachment","params":{"filename":"a.pdf"}}').otherwise(',"disposition":"inline","id":"<c>"'), "}]}")
    deep = F.when(i % 50 == 0, F.when(i % 100 == 0, F.lit(64)).otherwise(F.lit(65)))
    chain = F.concat(F.repeat(F.lit('{"childNodes":['), deep), F.lit('{"part":"9","type":"text/plain"}'), F.repeat(F.lit("]}"), deep))
    return live_messages(spark, d).select("id", F.parse_json(F.coalesce(chain, tree)).alias("tree"))


@add("mim_tree_text", f"WITH {SQL} SELECT id, CASE WHEN id % 100 = 0 THEN '9' WHEN id % 3 = 0 THEN '1.1' ELSE '1.2' END AS part, CASE WHEN id % 100 <> 0 AND id % 3 = 0 THEN 'html' ELSE 'plain' END AS format FROM m WHERE id % 50 <> 0 OR id % 100 = 0")
def mim_tree_text(spark, d):
    """The body's part from nested trees: plain before HTML, no attached text; parts that lie too deep do not count."""
    return body_parts(described(leaf_parts(part_trees(spark, d))))


@add("mim_tree_files", f"""WITH {SQL} SELECT id, '2' AS part, CASE WHEN id % 2 = 0 THEN 'a.pdf' END AS filename, 'application/pdf' AS mime, id * 6 AS bytes, CASE WHEN id % 2 = 0 THEN 'attachment' ELSE 'inline' END AS disposition FROM m WHERE id % 50 <> 0
UNION ALL SELECT id, '1.2', NULL, 'text/plain', id, 'attachment' FROM m WHERE id % 50 <> 0 AND id % 3 = 0""")
def mim_tree_files(spark, d):
    """Attachments from nested trees, with the size that base64 hides."""
    return attached(described(leaf_parts(part_trees(spark, d)))).select("id", "part", "filename", "mime", "bytes", "disposition")


@add("snk_jsonl", f"WITH {SQL} SELECT id, account, array_to_string(to_emails, ',') AS recipients FROM m")
def snk_jsonl(spark, d):
    """Results as JSON lines in the shared folder, read back."""
    import uuid

    out = live_messages(spark, d).select("id", "account", "to_emails")
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    out.write.json(path)
    return spark.read.schema(out.schema).json(path).select("id", "account", F.array_join("to_emails", ",").alias("recipients"))


@add("snk_body_store", f"WITH {SQL} SELECT id, sha256(body) AS digest, length(body) > 0 AS readable FROM m")
def snk_body_store(spark, d):
    """Payloads are written first; a row is readable only when what was written has its digest."""
    want = live_messages(spark, d).select("id", "body", F.sha2("body", 256).alias("digest"))
    there = stage(want.select("id", "body")).filter(F.length("body") > 0).select("id", F.sha2("body", 256).alias("found"))
    return want.drop("body").join(there, "id", "left").select("id", "digest", F.coalesce(F.col("digest") == F.col("found"), F.lit(False)).alias("readable"))
