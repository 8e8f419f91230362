"""Waiting events are kept in packs: few calls to the state store for a key, whatever the number of its events."""
import json
import random

from pyspark.sql import Row

from tests.test_stream_runs import HOUR, Clock, Handle, Value, made_events, plain
from tollgate.functions import patterns as P
from tollgate.streaming import licences as H


class Counted(Handle):
    """A key's state that counts the calls, each a round trip to the state store, and the list rows written."""

    def __init__(self):
        super().__init__()
        self.calls, self.rows = 0, 0

    def getValueState(self, name, schema):
        handle = self

        class Slot(Value):
            def __getattribute__(self, at):
                found = super().__getattribute__(at)
                if callable(found) and not at.startswith("_"):
                    handle.calls += 1
                return found

            def appendList(self, rows):
                handle.rows += len(rows)
                self.v = (self.v or []) + list(rows)
        return self.state.setdefault(name, Slot())

    getListState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        super().registerTimer(at)

    def deleteTimer(self, at):
        self.calls += 1
        super().deleteTimer(at)


def as_row(event):
    return Row(subscription_id=1, ts=None, ts_us=event[0], event=H.as_json(event))


def run(events, batches, rows, make):
    handle, out = Counted(), []
    proc = make("subscription_id", P.CHECKOUT_PLANS, 3_600_000, 1 << 60)
    proc.init(handle)
    for i in range(batches):
        list(proc.handleInputRows((1,), rows(events[i::batches]), Clock(0)))
    end = Clock(1 << 53)
    while handle.timers and len(out) < 99:
        at = min(handle.timers)
        handle.timers.discard(at)
        out += list(proc.handleExpiredTimer((1,), end, Clock(at)))
        if handle.state["waiting"].v is None:
            break
    return out, handle


def test_rows_and_packs_equal_a_plain_fold():
    for seed in range(5):
        events = made_events(2500, seed)
        random.Random(seed).shuffle(events)
        out, handle = run(events, 2, lambda part: map(as_row, part), H.LicenceRowProcessor)
        want = plain(events)
        assert handle.state["record"].v == want and (out[-1].status, out[-1].expires_us, out[-1].plan, out[-1].n_applied) == want[:4]
        assert handle.rows == 4  # 1,250 events: two packs


def test_a_key_costs_few_calls_to_the_state():
    events = sorted(made_events(30, 2))
    _, handle = run(events, 5, lambda part: map(as_row, part), H.LicenceRowProcessor)
    assert handle.rows == 5 and handle.calls <= 5 * 4 + 8


def test_json_of_spark_and_of_the_processor(spark):
    events = [(1_700_000_000_000_000, 5, "R", "payment_succeeded", H.NONE, 'a "b"\n\\'), (-1, -(1 << 62), None, "x", HOUR, None)]
    df = spark.createDataFrame(events, H.EVENT)
    from pyspark.sql import functions as F
    for (text,), event in zip(df.select(F.to_json(F.struct(*H.EVENT_COLS))).collect(), events):
        assert json.loads(text) == json.loads(H.as_json(event)) and tuple(map(json.loads(text).get, H.EVENT_COLS)) == event
