"""H2: the licence fold as a stateful processor (state API v2).

State of a subscription: its record (a value), the events that wait for the watermark (a list of packs of
up to `PACK` events, only ever appended to between two timers), and the next timer.  An event waits until the end of its
tick has passed the watermark; then one timer reads the list once, applies what is due in
(ts, event_id) order and writes back the rest.  Ticks are as long as the lateness, so an event is read
at most a few times however many micro-batches bring it, and a key with many events costs time in
proportion to them.  A closed (expired) licence is dropped from the state a retention after
it was closed, by the same timer.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tollgate.functions import patterns as P

# The licence state machine, state -> next state
# per operation: K checkout, R renew, X cancel at period end, P suspend, D delete.
TRANSITIONS = {
    "K": {"none": "active"},
    "R": {"suspended": "active"},
    "X": {"active": "cancelled"},
    "P": {"active": "suspended", "cancelled": "suspended"},
    "D": {"active": "expired", "cancelled": "expired", "suspended": "expired", "expired": "expired"},
}

OUTPUT = "status string, expires_us long, plan string, applied long, n_applied long, as_of_ms long"
RECORD = "status string, expires_us long, plan string, n_applied long, closed_us long"
EVENT = "ts_us long, event_id long, op string, kind string, period_end_us long, plan string"  # no period end: NONE
EVENT_COLS = [c.split()[0] for c in EVENT.split(", ")]
WAITING = "events string"  # a pack: a JSON array of events, each an object of its fields that are not NULL
PACK = 1000  # events
NONE = -(1 << 63)
NEW = ("none", None, None, 0, None)


def step(state: str, op: str | None) -> str:
    """Next licence state after one operation (unchanged for no-ops)."""
    return TRANSITIONS.get(op, {}).get(state, state) if op else state


def add_year(us: int) -> int:
    """Calendar year added to epoch microseconds (Feb 29 -> Feb 28), in any year."""
    day, rest = divmod(us, 86_400_000_000)
    at = np.datetime64(day, "D")
    month = at.astype("M8[M]")
    moved = month + 12
    last = (moved + 1).astype("M8[D]") - np.timedelta64(1, "D")
    return int(min(moved.astype("M8[D]") + (at - month.astype("M8[D]")), last).astype(np.int64)) * 86_400_000_000 + rest


def apply_event(record: tuple, event: tuple, plans) -> tuple:
    """The record after one event: status by the state machine, expiry as in G5, plan as in G6."""
    status, expiry, plan, n, closed = record
    ts, _, op, kind, period_end, event_plan = event
    if op == "K" and status == "none":
        return "active", add_year(ts), event_plan, n + 1, None
    if status != "none":
        if op == "R" and kind == "payment_succeeded":
            expiry = period_end if period_end != NONE else (add_year(expiry) if expiry is not None else None)
        if kind == "subscription_updated" and event_plan in plans:
            plan = event_plan
    after = step(status, op)
    if after == P.STATUS_EXPIRED and status != after:
        closed = ts
    return after, expiry, plan, n + 1, closed


def as_json(event: Iterable) -> str:
    """As Spark's ``to_json`` of a struct of ``EVENT``."""
    return json.dumps({c: v for c, v in zip(EVENT_COLS, event) if v is not None}, separators=(",", ":"))


def packed(events: Iterable[str]) -> tuple[str]:
    return ("[" + ",".join(events) + "]",)


class LicenceProcessor(StatefulProcessor):
    """Input: frames of ``EVENT`` and an event-time column ``ts``; output: ``OUTPUT`` after the key."""

    def __init__(self, key: str, plans, tick_ms: int, closed_ms: int):
        self.key, self.plans, self.tick_ms, self.closed_ms = key, tuple(plans), max(1, tick_ms), closed_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", RECORD)
        self.waiting = handle.getListState("waiting", WAITING)
        self.timer = handle.getValueState("timer", "at_ms long")

    def _wake(self, at_ms: int, now: tuple | None) -> None:
        """One timer a key, at the earliest time asked for; ``now`` is the one it has."""
        if now is not None and now[0] <= at_ms:
            return
        if now is not None:
            self.handle.deleteTimer(now[0])
        self.handle.registerTimer(at_ms)
        self.timer.update((at_ms,))

    def _tick_end(self, ts_us: int) -> int:
        return (ts_us // 1000 // self.tick_ms + 1) * self.tick_ms

    def _events(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, str]]:
        """Time and JSON text of the events."""
        for pdf in frames:
            columns = [pdf[c].tolist() for c in EVENT_COLS]
            for row in zip(*columns):
                yield row[0], as_json(None if isinstance(v, float) and v != v else v for v in row)

    def _made(self, values: dict):
        return pd.DataFrame({c: pd.Series([v], dtype=object) for c, v in values.items()})

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        earliest = None
        events = iter(self._events(rows))
        while some := list(islice(events, PACK)):
            self.waiting.appendList([packed(text for _, text in some)])
            low = min(ts for ts, _ in some)
            earliest = low if earliest is None else min(earliest, low)
        if earliest is not None:
            self._wake(self._tick_end(earliest), self.timer.get())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        now = timerValues.getCurrentWatermarkInMs()
        events = sorted((tuple(map(e.get, EVENT_COLS)) for pack in self.waiting.get() or () for e in json.loads(pack[0])), key=lambda e: (e[0], e[1]))
        due = [e for e in events if e[0] <= now * 1000]
        rest = events[len(due):]
        before = record = tuple(self.record.get() or NEW)
        for e in due:
            record = apply_event(record, e, self.plans)
        if due:
            if rest:
                self.waiting.put([packed(map(as_json, rest[i:i + PACK])) for i in range(0, len(rest), PACK)])
            else:
                self.waiting.clear()
        closing = record[4] // 1000 + self.closed_ms if record[0] == P.STATUS_EXPIRED else None
        wake = self._tick_end(rest[0][0]) if rest else None
        if not rest and (record[0] == "none" or closing is not None and closing <= now):
            self.record.clear()  # nothing is held, or it was closed long ago
        else:
            if due:
                self.record.update(record)
            if not rest and closing is not None:
                wake = closing + 1
        if wake is None:  # the key's one timer has just gone off
            self.timer.clear()
        else:
            self._wake(wake, None)
        if due and record[:3] != before[:3]:
            yield self._made({self.key: key[0], "status": record[0], "expires_us": record[1], "plan": record[2],
                              "applied": len(due), "n_applied": record[3], "as_of_ms": now})

    def close(self) -> None:
        pass


class LicenceRowProcessor(LicenceProcessor):
    """The same over Rows of ``ts_us`` and the event as JSON: a key's few events a micro-batch cost
    less than a data frame for each key."""

    def _events(self, rows: Iterator[Row]) -> Iterator[tuple[int, str]]:
        return ((row["ts_us"], row["event"]) for row in rows)

    def _made(self, values: dict) -> Row:
        return Row(**values)
