"""The walk over trees of parts against a walk in Python."""

import json
import random

from pyspark.sql import functions as F

from postrider.operators.parttree import MOST_DEPTH, attached, body_parts, described, leaf_parts


def tree(r, depth=0):
    if depth < 5 and r.random() < 0.5:
        return {"part": str(depth), "childNodes": [tree(r, depth + 1) for _ in range(r.randint(1, 3))]}
    node = {"part": r.choice(["1", "2.1", " ", None]), "size": r.randrange(1000), "encoding": r.choice(["BASE64", "7bit", None]), "id": r.choice(["<c>", None])}
    node |= r.choice([{"type": "text/plain"}, {"type": "TEXT", "subtype": "HTML"}, {"type": "text", "subtype": "x-amp-html"}, {"type": "application/pdf; x"}, {}])
    node |= r.choice([{}, {}, {"disposition": "Inline"}, {"disposition": "attachment", "dispositionParameters": {"filename": "a"}}, {"disposition": {"type": "attachment", "params": {"filename": "b"}}}, {"disposition": {"type": ""}}, {"parameters": {"name": "c"}, "childNodes": []}])
    return {k: v for k, v in node.items() if v is not None}


def walked(node, depth=0):
    if depth > MOST_DEPTH or not isinstance(node, dict):
        return
    if node.get("childNodes"):
        for c in node["childNodes"]:
            yield from walked(c, depth + 1)
    else:
        yield node


def plain(node, prefer):
    body, files = {}, []
    for x in (x for n in (node if isinstance(node, list) else [node]) for x in walked(n)):
        kind = x.get("type", "").lower().split(";")[0].strip()
        sub = x.get("subtype", "").lower()
        kind = kind if "/" in kind or not sub else f"{kind}/{sub}"
        d = x.get("disposition")
        d = (d if isinstance(d, str) else (d or {}).get("type", "")).lower() or None
        params = x["disposition"].get("params", {}) if isinstance(x.get("disposition"), dict) else {}
        name = params.get("filename") or x.get("dispositionParameters", {}).get("filename") or x.get("parameters", {}).get("name")
        part = (x.get("part") or "").strip()
        if kind in ("text/plain", "text/html", "text/x-amp-html") and d in (None, "inline"):
            body.setdefault("plain" if kind == "text/plain" else "html", part or "TEXT")
        inline = d == "inline" and bool(name or x.get("id"))
        if part and (inline or d == "attachment"):
            size = x["size"] * 3 // 4 if (x.get("encoding") or "").lower() == "base64" else x["size"]
            files.append((part, name, kind or None, size, "inline" if inline else "attachment", x.get("id")))
    other = "html" if prefer == "plain" else "plain"
    return next(((body[f], f) for f in (prefer, other) if f in body), None), files


def test_trees(spark):
    r = random.Random(12)
    trees = [tree(r) for _ in range(150)] + [[tree(r), tree(r)], {}, [], None, 5, {"childNodes": [3, None, {"type": "text/plain"}]}]
    rows = [(i, json.dumps(t)) for i, t in enumerate(trees)] + [(999, None)]
    df = spark.createDataFrame(rows, "id long, j string").select("id", F.parse_json("j").alias("tree"), F.lit(1).alias("path"), F.lit(2).alias("node"))
    parts = described(leaf_parts(df)).cache()
    for prefer in ("plain", "html"):
        got = {x.id: (x.part, x.format) for x in body_parts(parts, prefer).collect()}
        assert got == {i: b for i, t in enumerate(trees) if (b := plain(t, prefer)[0])}
    files = {}
    for x in sorted(attached(parts).collect(), key=lambda x: (x.id, x.path)):
        files.setdefault(x.id, []).append((x.part, x.filename, x.mime, x.bytes, x.disposition, x.content_id))
    assert files == {i: f for i, t in enumerate(trees) if (f := plain(t, "plain")[1])}


def test_depth(spark):
    deep = lambda n: '{"childNodes":[' * n + '{"type":"text/plain","part":"1"}' + "]}" * n
    df = spark.createDataFrame([(n, deep(n)) for n in (0, 1, MOST_DEPTH, MOST_DEPTH + 1)], "id long, j string").select("id", F.parse_json("j").alias("tree"))
    assert sorted(x.id for x in body_parts(described(leaf_parts(df))).collect()) == [0, 1, MOST_DEPTH]
