"""State of each mailbox folder in a stream: what was acknowledged, what was seen since, and what is still to be done about it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a server says of a folder; null: it did not say.
FIELDS = ("uid_validity", "uid_next", "messages", "unseen", "modseq")
_STATUS = ", ".join(f"{f} long" for f in FIELDS)
#: Columns of the events: seed and observe give a status; exists (messages) and flags (modseq) what a server pushed; expunge one message less; ack that the change ``of`` was dealt with, or with null the pending one.
EVENT = f"folder string, seq long, kind string, {_STATUS}, of long"
_STATE = f"seeded boolean, open boolean, seq long, reconcile boolean, flag_scan boolean, {_STATUS}, {', '.join(f'seen_{f} long' for f in FIELDS)}"
CHANGE = f"folder string, seq long, force_reconcile boolean, force_flag_scan boolean, {_STATUS}"
_CHANGED = Row("folder", "seq", "force_reconcile", "force_flag_scan", *FIELDS)


class Status(NamedTuple):
    uid_validity: int | None = None
    uid_next: int | None = None
    messages: int | None = None
    unseen: int | None = None
    modseq: int | None = None

    def over(self, before: Status | None) -> Status:
        """This status, with what it does not say from the one before."""
        return self if before is None else Status(*[b if a is None else a for a, b in zip(self, before, strict=True)])

    def differs(self, before: Status, *fields: str) -> bool:
        """Whether both say another value for one of the fields."""
        pairs = [(getattr(before, f), getattr(self, f)) for f in fields] if fields else zip(before, self, strict=True)
        return any(a is not None and b is not None and a != b for a, b in pairs)


class Change(NamedTuple):
    seq: int
    reconcile: bool
    flag_scan: bool
    observed: Status


def step(baseline: Status | None, pending: Change | None, seq: int, kind: str, said: Status, of: int | None) -> tuple[Status | None, Change | None, Change | None]:
    """(baseline, pending, change to announce) after an event.

    A change asks to reconcile if validity, next id or number of messages
    differ, or if the modification sequence does and the number of messages is
    not known; to scan flags if the sequence or the unread count differs. What a
    pending change asked for stays asked until it is acknowledged; one that has
    grown since it was announced is not.
    """
    if kind == "seed":
        return said, pending, None
    if kind == "ack":
        known = pending is not None and of in (None, pending.seq)
        return (pending.observed, None, None) if known else (baseline, pending, None)
    seen = pending.observed if pending else None
    if kind == "observe":
        if baseline is None:
            if said.uid_validity is not None:
                grown = pending._replace(seq=seq, observed=said) if pending else None
                return said, grown, grown
            return _signalled(baseline, pending, seq, True, True, said)
        now = said.over(seen).over(baseline)
        if pending and not now.differs(seen):
            return baseline, pending, None
        if not pending and not now.differs(baseline):
            return now, None, None
        moved = now.differs(baseline, "modseq")
        structural = now.differs(baseline, "uid_validity", "uid_next", "messages") or (baseline.messages is None and moved)
        flags = moved or now.differs(baseline, "unseen")
        change = Change(seq, structural or bool(pending and pending.reconcile), flags or bool(pending and pending.flag_scan), now)
        return baseline, change, change
    before = seen or baseline
    if kind == "exists":
        said = Status(messages=said.messages)
    elif kind == "flags":
        said = Status(modseq=said.modseq)
    else:
        said = Status(messages=max(0, before.messages - 1)) if before and before.messages is not None else Status()
    return _signalled(baseline, pending, seq, kind == "expunge", kind == "flags", said)


def _signalled(baseline: Status | None, pending: Change | None, seq: int, reconcile: bool, flag_scan: bool, said: Status) -> tuple[Status | None, Change, Change]:
    now = said.over(pending.observed if pending else None).over(baseline)
    now = now._replace(uid_validity=now.uid_validity or 0)
    change = Change(seq, reconcile or bool(pending and pending.reconcile), flag_scan or bool(pending and pending.flag_scan), now)
    return baseline, change, change


class FolderChanges(StatefulProcessor):
    """Keeps baseline and pending change of a folder; announces each change that is new or has grown."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # One value, so that a folder costs one read and one write.
        self.state = handle.getValueState("folder", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state = self.state.get()
        before = tuple(state) if state is not None else (False, False, *[None] * (3 + 2 * len(FIELDS)))
        seeded, open_, seq, reconcile, flag_scan, *said = before
        baseline = Status(*said[: len(FIELDS)]) if seeded else None
        pending = Change(seq, reconcile, flag_scan, Status(*said[len(FIELDS) :])) if open_ else None
        out = []
        # A batch's rows of one folder, in order.
        for _, seq, kind, *status, of in sorted(rows, key=lambda r: r[1]):
            baseline, pending, change = step(baseline, pending, seq, kind, Status(*status), of)
            if change is not None:
                out.append(_CHANGED(key[0], *change[:3], *change.observed))
        after = (baseline is not None, pending is not None, *(pending[:3] if pending else [None] * 3), *(baseline or Status()), *(pending.observed if pending else Status()))
        if after != before:
            self.state.update(after)
        return iter(out)

    def close(self) -> None:
        pass


@contextmanager
def folder_state(spark: SparkSession) -> Iterator[None]:
    """Within it, streams start with the store that state of this kind needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def folder_changes(events: DataFrame) -> DataFrame:
    """The changes (see :data:`CHANGE`) that a stream of events (see :data:`EVENT`) announces.

    State is one row of a folder's baseline and one of its pending change, so it
    grows with the folders alone. Events of a folder come in rising ``seq``;
    within a batch in any order. The last change of a folder has all that is
    asked since the last acknowledgement. The stream is to be started within
    :func:`folder_state`.
    """
    rows = events.select(*[c.split()[0] for c in EVENT.split(", ")])
    return rows.groupBy("folder").transformWithState(FolderChanges(), outputStructType=CHANGE, outputMode="append", timeMode="none")
