"""The stateful licence processor, compaction of device deltas, and late rows accounted for."""
import os
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tollgate.functions import patterns as P
from tollgate.operators import entitlements as E
from tollgate.sources.folders import complete
from tollgate.sources.views import Catalog
from tollgate.streaming import devices as D
from tollgate.streaming import jobs as S
from tollgate.streaming import late as L
from tollgate.streaming import licences as H
from tollgate.streaming.replay import replay, stream_session, to_files

HOUR = 3_600_000_000  # microseconds


class Value:
    def __init__(self):
        self.v, self.reads = None, 0

    def exists(self):
        return self.v is not None

    def get(self):
        if isinstance(self.v, list):
            self.reads += len(self.v)
        return self.v

    def update(self, v):
        self.v = v

    put = update

    def clear(self):
        self.v = None

    def appendList(self, rows):
        self.v = (self.v or []) + list(rows)


class Handle:
    """One key's state, kept in memory."""

    def __init__(self):
        self.state, self.timers = {}, set()

    def getValueState(self, name, schema):
        return self.state.setdefault(name, Value())

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def drive(batches, lateness_us, closed_ms=1 << 60):
    """The processor over micro-batches of events of one key, with a sentinel at the end."""
    handle, out, seen = Handle(), [], 0
    proc = H.LicenceProcessor("subscription_id", P.CHECKOUT_PLANS, lateness_us // 1000, closed_ms)
    proc.init(handle)
    for batch in [*batches, None]:
        if batch:
            pdf = pd.DataFrame(batch, columns=H.EVENT_COLS)
            out += proc.handleInputRows((1,), iter([pdf]), Clock((seen - lateness_us) // 1000))
            seen = max(seen, int(pdf["ts_us"].max()))
        mark = (seen - lateness_us) // 1000 if batch else 1 << 53
        while due := sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(due[0])
            for pdf in proc.handleExpiredTimer((1,), Clock(mark), Clock(due[0])):
                out.append(pdf.iloc[0])
            if batch is None and not handle.state["waiting"].exists():
                break
    return out, handle


def plain(events):
    record = H.NEW
    for e in sorted(events):
        record = H.apply_event(record, e, P.CHECKOUT_PLANS)
    return record


def made_events(n, seed, base=1_700_000_000_000_000):
    r = random.Random(seed)
    kinds = {"R": "payment_succeeded", "X": "subscription_updated", "P": "payment_failed", "K": "checkout_completed", "D": "subscription_deleted"}
    out = [(base, 0, "K", "checkout_completed", H.NONE, "vpn")]
    for i in range(1, n):
        op = r.choice("RRXXPPRK" + ("D" if i > n - 3 else ""))
        out.append((base + i * 60_000_000 + r.randrange(3), i, op, kinds[op], r.choice([H.NONE, base + i * HOUR]), r.choice(["vpn", "security_vpn", "legacy"])))
    return out


def test_processor_equals_a_plain_fold_under_random_splits():
    for seed in range(12):
        r, events = random.Random(seed), made_events(200, seed)
        # every event is held back by up to an hour, and the arrivals are cut anywhere
        arrival = sorted(events, key=lambda e: (e[0] + r.randrange(HOUR), e[1]))
        cuts = sorted(r.sample(range(1, 200), 9))
        batches = [arrival[a:b] for a, b in zip([0, *cuts], [*cuts, 200])]
        out, handle = drive(batches, 2 * HOUR)
        want = plain(events)
        assert (out[-1]["status"], out[-1]["expires_us"], out[-1]["plan"], out[-1]["n_applied"]) == (*want[:3], out[-1]["n_applied"])
        assert handle.state["record"].v == want and not handle.state["waiting"].exists()


def test_processor_reads_each_event_a_few_times():
    """10^5 events on one key in 500 micro-batches."""
    events = made_events(100_000, 1)
    began = time.time()
    out, handle = drive([events[i:i + 200] for i in range(0, len(events), 200)], HOUR)
    assert handle.state["waiting"].reads <= 4 * len(events) and time.time() - began < 60
    assert out[-1]["n_applied"] <= len(events) and handle.state["record"].v == plain(events)


def test_add_year():
    us = lambda t: int(pd.Timestamp(t).value // 1000)
    for a, b in (("2024-02-29 10:00:00.5", "2025-02-28 10:00:00.5"), ("2023-02-28", "2024-02-28"), ("2024-01-31", "2025-01-31"), ("1969-12-31 23:59:59", "1970-12-31 23:59:59")):
        assert H.add_year(us(a)) == us(b)
    t = us("2024-03-01")
    for _ in range(5000):
        t = H.add_year(t)
    assert str(__import__("numpy").datetime64(t, "us")).startswith("7024-03-01")


def test_closed_licence_leaves_the_state():
    base = 1_700_000_000_000_000
    events = [(base, 1, "K", "checkout_completed", H.NONE, "vpn"), (base + HOUR, 2, "D", "subscription_deleted", H.NONE, None)]
    out, handle = drive([events], HOUR, closed_ms=86_400_000)
    assert out[-1]["status"] == "expired"
    proc = H.LicenceProcessor("subscription_id", P.CHECKOUT_PLANS, 1000, 86_400_000)
    proc.init(handle)
    handle.state["record"].update(("expired", base, "vpn", 2, base + HOUR))
    assert not list(proc.handleExpiredTimer((1,), Clock(base // 1000 + 3_600_000), Clock(0))) and handle.state["record"].exists()
    assert not list(proc.handleExpiredTimer((1,), Clock(base // 1000 + 2 * 86_400_000), Clock(0))) and not handle.state["record"].exists()


def test_hot_key_stream_equals_fold_and_evicts(spark, scratch):
    """One subscription with 20,000 events among others, through Spark; closed ones leave RocksDB."""
    n = 20_000
    ev = (spark.range(n).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int))").alias("ts"),
        F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(100).alias("subscription_id"),
        F.element_at(F.array(*map(F.lit, ("payment_succeeded", "subscription_updated", "payment_failed", "checkout_completed"))),
                     (F.pmod(F.xxhash64("id"), F.lit(4)) + 1).cast("int")).alias("kind"),
        F.lit(1.0).alias("amount"), F.lit(0.5).alias("amount_refunded"), (F.col("id") % 2 == 0).alias("cancel_at_period_end"),
        F.lit("active").alias("sub_status"), F.lit("vpn").alias("plan")))
    gone = ev.limit(1).withColumns({"event_id": F.lit(n).cast("long"), "subscription_id": F.lit(3).cast("long"), "kind": F.lit("subscription_deleted"),
                                    "ts": F.expr("timestamp_ntz'2024-02-01 00:00:00'")})
    end = gone.withColumns({"event_id": F.lit(n + 1).cast("long"), "subscription_id": F.lit(-1).cast("long"), "ts": F.expr("timestamp_ntz'2030-01-01 00:00:00'")})
    rows = ev.withColumn("s", F.floor(F.col("event_id") / 7000).cast("int")).unionByName(gone.withColumn("s", F.lit(3))).unionByName(end.withColumn("s", F.lit(4)))
    replay(rows, "s", lambda s, at: to_files(S.stream_states(s, "1 day", allowed_plans=P.CHECKOUT_PLANS), f"{scratch}/out", at, "update"), scratch, [0, 1, 2, 3, 4])
    out = spark.read.parquet(f"{scratch}/out/batch=*")
    got = {r.subscription_id: r.status for r in out.groupBy("subscription_id").agg(F.max_by("status", "n_applied").alias("status")).collect()}
    want = {r.subscription_id: r.status for r in E.fold_states(rows, allowed_plans=P.CHECKOUT_PLANS).collect()}
    assert got == want and got[3] == "expired"
    held = stream_session(spark).read.format("statestore").option("stateVarName", "record").load(f"{scratch}/checkpoint")
    keys = {r[0] for r in held.select("key.subscription_id").collect()}
    assert 3 not in keys and {100, 0, 1} <= keys


def test_compaction_never_shows_half_a_merge(spark, scratch):
    seen = Catalog(spark, SF_SMALL).device_seen
    root, cols = f"{scratch}/table", D.COLS
    want = sorted(map(tuple, E.upsert_devices(seen).select(cols).collect()))
    table = lambda: sorted(map(tuple, D.read_devices(spark, root).select(cols).collect()))
    assert table() == [] and D.compact(spark, root) is None
    for i in range(6):  # two runs with the same batch numbers
        D.device_deltas(seen.where(F.col("event_id") % 6 == i)).write.parquet(D.delta_path(root, i % 3, f"run{i // 3}"))
        if i == 2:
            assert D.compact(spark, root)
    assert table() == want
    second = D.compact(spark, root)
    assert table() == want and second.startswith("v=0000000002") and D.compact(spark, root) is None
    # a merge that was cut off: covers without data, then data without its mark
    D.combine(spark.read.schema(D.SCHEMA).parquet(D.delta_path(root, 0, "run0"))).write.parquet(f"{root}/base/v=0000000003.x/data")
    spark.createDataFrame([("batch=0000000000.run0",)], "name string").write.parquet(f"{root}/base/v=0000000003.x/covers")
    os.remove(f"{root}/base/v=0000000003.x/data/_SUCCESS")
    assert table() == want
    gone = D.vacuum(spark, root)  # what the first base covers
    assert sorted(os.path.basename(g) for g in gone) == [f"batch=000000000{i}.run0" for i in range(3)] and table() == want
    D.device_deltas(seen.where(F.col("event_id") % 6 == 0)).write.parquet(D.delta_path(root, 7, "run2"))  # delivered again
    assert table() == want and len(complete(spark, root, "batch=*")) == 4


def test_account_of_late_rows_is_idempotent(spark, scratch):
    mk = lambda rows: spark.createDataFrame(rows, "request_id long, ts timestamp, route string")
    at = lambda m: (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)).to_pydatetime()
    batches = [mk([(i, at(m), "/a") for i, m in enumerate([0, 1, 6, 12, 30])]), mk([(9, at(2), "/a"), (10, at(26), "/b"), (11, at(24), "/a")]), mk([])]
    run = L.account_batch(scratch, "5 minutes", "5 minutes", ["route"])
    for n in (0, 1, 1, 0, 1, 2):  # some of them again
        run(batches[n], n)
    counts = {(r.window_start.minute, r.route): (r.requests, r.final) for r in L.window_counts(spark, scratch, "5 minutes").collect()}
    assert counts == {(0, "/a"): (2, True), (5, "/a"): (1, True), (10, "/a"): (1, True), (30, "/a"): (1, False), (25, "/b"): (1, False)}
    late = {(r.request_id, r.window_start.minute, str(r.watermark)) for r in L.late_rows(spark, scratch).collect()}
    assert late == {(9, 0, "2024-01-01 00:25:00"), (11, 20, "2024-01-01 00:25:00")}
