"""A replayed batch, and a stream without data."""

from pyspark.sql import functions as F

from postrider.streaming.feeds import drained, feed, latest


def table(spark, path, rows):
    spark.createDataFrame(rows, "k string, v string, n int").write.mode("append").parquet(f"{path}/t.parquet")


def test_the_last_change_of_a_key_counts_over_batches(spark, tmp_path):
    table(spark, tmp_path, [("a", "x", 1), ("b", "y", 2), (None, "u", 1)])
    table(spark, tmp_path, [("a", "z", 3), ("a", None, 2)])
    left = drained(latest(feed(spark, str(tmp_path), "t", files_per_batch=1), ["k"], "n", "v"), ("k",))
    assert sorted(map(tuple, left.collect()), key=str) == [("a", "z", 3, 3), ("b", "y", 2, 1), (None, "u", 1, 1)]


def test_a_stream_without_data_leaves_no_rows(spark, tmp_path):
    table(spark, tmp_path, [])
    assert drained(feed(spark, str(tmp_path), "t").groupBy("k").agg(F.count("*").alias("n")), ("k",)).collect() == []


def states(spark, tmp_path, rows):
    from postrider.streaming.scans import ResumableScan

    return ResumableScan(spark, str(tmp_path / "scan"), ("at", "id")), spark.createDataFrame(rows, "id long, at int, v string")


def test_a_scan_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    rows = [(i, i * 7 % 5, f"v{i}") for i in range(103)]
    scan, table_ = states(spark, tmp_path, rows)
    assert scan.cursor() is None and scan.step(table_, 30) and scan.step(table_, 30)
    # It stops after the write of a page, before the page is in place.
    monkeypatch.setattr(type(scan), "_fs", lambda self, at, of=type(scan)._fs: (_ for _ in ()).throw(OSError("killed")) if at == "open" else of(self, at))
    try:
        scan.step(table_, 30)
        raise AssertionError("it was not killed")
    except OSError:
        pass
    monkeypatch.undo()
    again, _ = states(spark, tmp_path, rows)
    assert again.pages() == [0, 1] and again.run(table_, 30) == 2 and again.run(table_, 30) == 0
    got = sorted((r.page, r.at, r.id) for r in again.emitted().collect())
    assert [x[1:] for x in got] == sorted((a, i) for i, a, _ in rows) and [sum(x[0] == p for x in got) for p in range(4)] == [30, 30, 30, 13]
    # Rows that come later are taken up; a table without rows gives no page.
    later, more = states(spark, tmp_path, [*rows, (500, 4, "new"), (501, 9, "new")])
    assert later.run(more, 30) == 1 and later.cursor() == (9, 501)
    assert not states(spark, tmp_path / "x", [])[0].step(states(spark, tmp_path, [])[1], 5)


def test_typed_changes(spark):
    from postrider.streaming.scans import typed_changes

    a = spark.createDataFrame([(1, "x", 1), (2, "x", None), (3, None, 1), (4, "y", 2)], "id long, p string, q int")
    b = spark.createDataFrame([(1, "x", 1), (2, "x", 5), (3, "z", 2), (5, None, None)], "id long, p string, q int")
    got = {r.id: (r.kind, r.changed) for r in typed_changes(a, b, "id").collect()}
    assert got == {2: ("updated", ["q"]), 3: ("updated", ["p", "q"]), 4: ("deleted", ["p", "q"]), 5: ("created", ["p", "q"])}


def test_days_expire_as_folders(spark, tmp_path):
    import datetime

    from postrider.streaming.expiry import by_day, days, expire, unexpired

    path, clock = str(tmp_path / "t"), datetime.datetime(2024, 1, 11, 12)
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=6 * i)) for i in range(40)] + [(99, None)]
    by_day(spark.createDataFrame(rows, "id long, ts timestamp_ntz"), path, "ts")
    assert days(spark, str(tmp_path / "none")) == [] and len(days(spark, path)) == 10
    want = sorted(i for i, t in rows if t is None or t >= clock - datetime.timedelta(days=5))
    before = sorted(r.id for r in unexpired(spark, path, "ts", clock, 5).collect())
    assert [d.day for d in expire(spark, path, clock, 5)] == [1, 2, 3, 4, 5] and len(days(spark, path)) == 5
    assert sorted(r.id for r in unexpired(spark, path, "ts", clock, 5).collect()) == before == want
    assert expire(spark, path, clock, 5) == []


def test_folder_changes_over_batches_and_a_restart(spark, tmp_path):
    """Micro-batches of any split, shuffled within, and a restart give the rows of a plain state machine."""
    import random

    from postrider.streaming.feeds import drained
    from postrider.streaming.mailboxes import EVENT, FIELDS, folder_changes, folder_state

    x = random.Random(5)
    kinds = ["seed", "observe", "observe", "observe", "exists", "flags", "expunge", "ack"]
    events = []
    for seq in range(240):
        k = x.choice(kinds[1:]) if seq > 12 else x.choice(kinds)
        value = lambda p, n: x.randrange(n) if x.random() < p else None
        given = k in ("seed", "observe")
        events.append((f"f{seq % 4}", seq, k, value(0.9, 2) if given else None, value(0.8, 4) if given else None, value(0.6, 5) if given or k == "exists" else None, value(0.5, 3) if given else None, value(0.6, 4) if given or k == "flags" else None, -1 if k == "ack" and x.random() < 0.3 else None))

    want = []
    base, pending = {}, {}
    for folder, seq, k, *values, of in events:
        said = dict(zip(FIELDS, values, strict=True))
        b, p = base.get(folder), pending.get(folder)
        merged = {f: said[f] if said[f] is not None else (p or {"o": {}})["o"].get(f) if p and p["o"].get(f) is not None else (b or {}).get(f) for f in FIELDS}
        differs = lambda y, fields, now=merged: any(y.get(f) is not None and now[f] is not None and y[f] != now[f] for f in fields)
        change = None
        if k == "seed":
            base[folder] = said
        elif k == "ack":
            if p and of in (None, p["seq"]):
                base[folder] = p["o"]
                del pending[folder]
        elif k == "observe" and b is None and said["uid_validity"] is not None:
            base[folder] = said
            change = p and p | {"seq": seq, "o": said}
        elif k == "observe" and b is not None:
            if p and not differs(p["o"], FIELDS):
                pass
            elif not p and not differs(b, FIELDS):
                base[folder] = merged
            else:
                r = differs(b, ("uid_validity", "uid_next", "messages")) or (b.get("messages") is None and differs(b, ("modseq",)))
                change = {"seq": seq, "r": r or bool(p and p["r"]), "f": differs(b, ("modseq", "unseen")) or bool(p and p["f"]), "o": merged}
        else:
            before = (p or {"o": None})["o"] or b or {}
            if k == "expunge" and before.get("messages") is not None:
                merged["messages"] = max(0, before["messages"] - 1)
            merged["uid_validity"] = merged["uid_validity"] or 0
            change = {"seq": seq, "r": k in ("expunge", "observe") or bool(p and p["r"]), "f": k in ("flags", "observe") or bool(p and p["f"]), "o": merged}
        if change:
            pending[folder] = change
            want.append((folder, change["seq"], change["r"], change["f"], *[change["o"][f] for f in FIELDS]))

    for sizes in ((240,), (50, 90, 100)):
        path, at = tmp_path / f"in{len(sizes)}", 0
        for n in sizes:
            part = events[at : at + n]
            x.shuffle(part)
            spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(path))
            at += n
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(path))
        with folder_state(spark):
            got = drained(folder_changes(stream)).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_a_folder_costs_one_read_and_one_write_of_state():
    """All events of a folder in a batch read its state once and write it once, or not at all if they change nothing."""
    from pyspark.sql import Row

    from postrider.streaming.mailboxes import FolderChanges

    calls = []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, name, schema, ttl=None):
            return Value()

    event = Row("folder", "seq", "kind", "uid_validity", "uid_next", "messages", "unseen", "modseq", "of")
    f = FolderChanges()
    f.init(Handle())
    rows = [event("f", 3, "flags", None, None, None, None, 9, None), event("f", 1, "seed", 1, 5, 7, 2, 8, None), event("f", 2, "expunge", None, None, None, None, None, None)]
    got = [tuple(r) for r in f.handleInputRows(("f",), iter(rows), None)]
    assert got == [("f", 2, True, False, 1, 5, 6, 2, 8), ("f", 3, True, True, 1, 5, 6, 2, 9)] and calls == ["get", "update"]
    assert list(f.handleInputRows(("f",), iter([event("f", 4, "observe", 1, 5, 6, 2, 9, None)]), None)) == [] and calls[2:] == ["get"]
    assert list(f.handleInputRows(("f",), iter([event("f", 5, "ack", None, None, None, None, None, 3)]), None)) == [] and calls[3:] == ["get", "update"]
    assert list(f.handleInputRows(("f",), iter([event("f", 6, "observe", 1, 5, 6, 2, 9, None)]), None)) == []
