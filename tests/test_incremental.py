"""Deliveries and conversations kept up to date by batches are those of a full run."""

import datetime
import random

from postrider.operators.conversations import conversations, evidence
from postrider.operators.incremental import Maintained

ROW = "id long, account string, folder string, provider_key string, message_id string, raw_hash string, parsed string, authored string, metadata string, date timestamp_ntz, refs array<string>, provider_thread string"
ANSWER = "delivery long, conversation_id string, provisional boolean"
NAMES = [c.split()[0] for c in ROW.split(", ")]


def copy(r, i):
    m = f"m{r.randrange(40)}" if r.random() < 0.9 else None
    refs = [f"m{r.randrange(40)}" for _ in range(r.choice([0, 0, 0, 1, 2]))]
    opt = lambda p, v: v if r.random() < p else None
    when = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=r.randrange(1000))
    return (i, f"a{i % 2}", r.choice("xyz"), None, m, opt(0.5, f"r{r.randrange(30)}"), opt(0.5, f"s{r.randrange(30)}"), None, None, when, [x for x in refs if x != m], opt(0.1, f"t{r.randrange(8)}"))


def kept(spark, path):
    compute = lambda rows: conversations(rows).select("id", "delivery", "conversation_id", "provisional")
    return Maintained(spark, str(path), ROW, ANSWER, evidence, compute, buckets=3)


def answers(df):
    return sorted(map(tuple, df.select("id", "delivery", "conversation_id", "provisional").collect()))


def full(spark, state):
    return answers(conversations(spark.createDataFrame(list(state.values()), ROW)))


def changes(spark, rows):
    return spark.createDataFrame(rows, f"{ROW}, gone boolean, seq long")


def test_random_changes_replays_and_compaction(spark, tmp_path):
    r = random.Random(7)
    index, state, seq = kept(spark, tmp_path / "index"), {}, 0
    for number in range(2):
        rows = []
        for _ in range([60, 10, 8][number]):
            i, seq = r.randrange(70), seq + 1
            if i in state and r.random() < 0.4:
                del state[i]
                rows.append((i, *[None] * (len(NAMES) - 1), True, seq))
            else:
                state[i] = copy(r, i)
                rows.append((*state[i], None, seq))
        batch = changes(spark, rows).cache()
        before = dict(answers_by_id(index))
        changed = {x.id for x in index.apply(batch, number).collect()}
        want = full(spark, state)
        assert answers(index.current()) == want
        # What it wrote is what differs, and a replay of the batch leaves all as it is.
        now = {x[0]: x[1:] for x in want}
        assert changed == {i for i in before.keys() | now.keys() if before.get(i) != now.get(i)}
        if number == 1:
            index.apply(batch, number)
            assert answers(index.current()) == want
        if number == 1:
            index.compact()
            assert len(index.versions()) == 1 and answers(index.current()) == want
    assert sorted(x.id for x in index.rows().collect()) == sorted(state)


def answers_by_id(index):
    return {x[0]: x[1:] for x in answers(index.current())} if index.versions() else {}


def test_a_stream_with_a_broken_batch(spark, tmp_path):
    r = random.Random(8)
    state = {i: copy(r, i) for i in range(40)}
    for n in range(2):
        rows = [(*state[i], None, i) for i in range(n, 40, 2)]
        changes(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(f"{ROW}, gone boolean, seq long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    index = kept(spark, tmp_path / "index")
    whole, calls = index.compute, []

    def breaks(rows):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("lost")
        return whole(rows)

    index.compute = breaks
    try:
        index.follow(stream(), str(tmp_path / "check"))
        raise AssertionError("the batch did not break")
    except Exception as e:
        assert "lost" in str(e)
    index.follow(stream(), str(tmp_path / "check"), every=1)
    assert answers(index.current()) == full(spark, state) and len(index.versions()) == 1


def test_only_what_is_connected_is_worked_on(spark, tmp_path):
    rows = [(i, "a", "x", None, f"m{i}", None, None, None, None, None, [f"m{i - 1}"] if i % 10 else [], None) for i in range(100)]
    index = kept(spark, tmp_path / "index")
    index.apply(changes(spark, [(*x, None, 1) for x in rows]), 0)
    worked = []
    whole = index.compute
    index.compute = lambda found: (worked.append(found.count()), whole(found))[1]
    changed = index.apply(changes(spark, [(*rows[35][:10], [], None, None, 2)]), 1)
    assert worked == [10]  # the chain of ten that falls in two
    assert {x.id for x in changed.collect()} == {35, 36, 37, 38, 39}


def test_empty_tables(spark, tmp_path):
    index = kept(spark, tmp_path / "index")
    index.apply(changes(spark, []), 0)
    assert index.current().count() == 0
    index.apply(changes(spark, [(1, *[None] * (len(NAMES) - 1), True, 1)]), 1)
    assert index.current().count() == 0


def test_a_batch_broadcasts_nothing(spark, tmp_path, monkeypatch):
    """Joins of a batch, of its connected rows and of components go by shuffles, and the setting is as before afterwards."""
    from postrider.operators import graph, incremental
    from postrider.plans import staging

    plans, before = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staging.stage(df)

    monkeypatch.setattr(graph, "stage", noted)
    monkeypatch.setattr(incremental, "stage", noted)
    rows = [(i, "a", "x", None, f"m{i}", None, None, None, None, None, [f"m{i - 1}"] if i % 4 else [], None, None, 1) for i in range(12)]
    index = kept(spark, tmp_path / "index")
    index.apply(changes(spark, rows), 0)
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
