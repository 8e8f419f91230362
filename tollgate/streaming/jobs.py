"""Structured Streaming forms of the operators.

Event time is the ``ts`` column (timestamp_ntz in UTC); it is cast to TIMESTAMP
for watermarks (wall clock unchanged in the UTC session).  Checkpoints and
state go under the shared ``spark.checkpoint.dir`` (see ``session.checkpoint_dir``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tollgate.functions import patterns as P
from tollgate.operators import entitlements as E
from tollgate.operators import metrics as M
from tollgate.streaming.devices import (append_device_deltas, device_deltas, merge_device_deltas,  # noqa: F401
                                        read_devices, stream_devices)
from tollgate.streaming.licences import NONE, OUTPUT, TRANSITIONS, LicenceProcessor, LicenceRowProcessor, step  # noqa: F401


def event_time(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """The event-time column as TIMESTAMP, as watermarks require (wall clock unchanged in UTC)."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


# ---------------------------------------------------------------------------
# H1: event de-duplication
# ---------------------------------------------------------------------------

def dedup_events(stream: DataFrame, key: str = "event_id", ts: str = "ts",
                 retention: str = f"{P.EVENT_RETENTION_DAYS} days") -> DataFrame:
    """H1: drop repeated event ids; ids are remembered for ``retention`` of
    event time (the service keeps processed ids 7 days)."""
    return event_time(stream, ts).withWatermark(ts, retention).dropDuplicatesWithinWatermark([key])


def dedup_events_batch(events: DataFrame, key: str = "event_id") -> DataFrame:
    """H1, batch form: the earliest copy (by ts) of each event id."""
    first = events.groupBy(key).agg(F.min(F.struct("ts", *[c for c in events.columns
                                                            if c not in (key, "ts")])).alias("_r"))
    return first.select(key, "_r.*")


# ---------------------------------------------------------------------------
# H2: licence state fold, streaming
# ---------------------------------------------------------------------------
def stream_states(stream: DataFrame, lateness: str = "1 hour", key: str = "subscription_id",
                  allowed_plans=None, tick: str | None = None, closed_retention: str = "400 days") -> DataFrame:
    """H2: the licence record (status, expiry, plan) per subscription as events
    stream in: the same rules as G1, G5 and G6.

    Late events are buffered, not applied out of order: an event is applied once the
    watermark (max event time seen minus ``lateness``) passes the end of its ``tick`` (as long
    as the lateness by default), so results trail event time by both.  Emits a row when a
    key's record changes; of a key's rows the one with the largest ``n_applied`` is the last.
    A licence closed for ``closed_retention`` of event time leaves the state."""
    ops = E.billing_ops(event_time(stream), allowed_plans)
    have = ops.columns
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    none = lambda t: F.lit(None).cast(t)
    event = F.struct(
        micros("ts").alias("ts_us"), F.col("event_id").cast("long").alias("event_id"), "op", "kind",
        F.coalesce(micros("period_end") if "period_end" in have else none("long"), F.lit(NONE)).alias("period_end_us"),
        (F.col("plan") if "plan" in have else none("string")).alias("plan"))
    ops = ops.filter(F.col(key).isNotNull()).select(key, "ts", micros("ts").alias("ts_us"), F.to_json(event).alias("event"))
    made = ops.withWatermark("ts", lateness).groupBy(key).transformWithState(
        LicenceRowProcessor(key, allowed_plans or P.CHECKOUT_PLANS, _millis(tick or lateness), _millis(closed_retention)),
        f"{key} long, {OUTPUT}", "Update", "EventTime")
    return made.select(key, "status", F.timestamp_micros("expires_us").cast("timestamp_ntz").alias("expires_at"), "plan",
                       "applied", "n_applied", "as_of_ms")


def _millis(interval: str) -> int:
    return int(M._interval_seconds(interval) * 1000)


# ---------------------------------------------------------------------------
# H6: claim timeouts
# ---------------------------------------------------------------------------

def _claim_fn(ttl_us: int):
    def run(key, pdfs, state):
        """Events wait until the watermark passes them and are then taken in (ts, event_id)
        order: a completion closes the claims that are still within their time; a claim
        whose time is over by then, or by the watermark, is reset.  State: open claims and
        waiting events, both bounded by the lateness and the claim time; the timer stands at
        the earliest of them, and a licence without either keeps no state."""
        claims, ts, ids, kinds = (list(x) for x in state.get) if state.exists else ([], [], [], [])
        if not state.hasTimedOut:
            for pdf in pdfs:
                ts += [int(pd.Timestamp(t).value // 1000) for t in pdf["ts"]]
                ids += [int(i) for i in pdf["event_id"]]
                kinds += list(pdf["kind"])
        wm = state.getCurrentWatermarkMs() * 1000
        waiting, resets = [], []
        for t, i, kind in sorted(zip(ts, ids, kinds)):
            if t > wm:
                waiting.append((t, i, kind))
                continue
            if kind == "claim":
                claims.append(t)
            elif kind == "complete":
                resets += [c for c in claims if c + ttl_us < t]
                claims = []
        resets += [c for c in claims if c + ttl_us < wm]
        claims = [c for c in claims if c + ttl_us >= wm]
        if claims or waiting:
            state.update((claims, [w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting]))
            due = min([c + ttl_us for c in claims] + [w[0] for w in waiting])
            state.setTimeoutTimestamp(max(due, wm) // 1000 + 1)
        elif state.exists:
            state.remove()
        if resets:
            yield pd.DataFrame({"license_id": key[0], "claimed_at": [pd.Timestamp(c, unit="us") for c in resets], "action": "reset"})
    return run


def claim_timeouts(stream: DataFrame, lateness: str = "1 minute", ttl_minutes: int = P.CLAIM_TTL_MINUTES) -> DataFrame:
    """H6: a claim with no completion within the TTL (event time) is reset.
    Input (license_id, ts, event_id, kind in {claim, complete}); results trail event time
    by the lateness and do not depend on the micro-batches."""
    s = event_time(stream).withWatermark("ts", lateness)
    return s.groupBy("license_id").applyInPandasWithState(
        _claim_fn(ttl_minutes * 60_000_000), "license_id long, claimed_at timestamp_ntz, action string",
        "claims array<long>, ts array<long>, ids array<long>, kinds array<string>",
        "Update", GroupStateTimeout.EventTimeTimeout)


def claim_timeouts_batch(events: DataFrame, ttl_minutes: int = P.CLAIM_TTL_MINUTES) -> DataFrame:
    """H6, batch form: claims with no completion of their licence at or after them, in
    (ts, event_id) order, within the TTL; claims whose time is not over by the last event
    are still open.  An anti-join on the licence and the TTL-long time bucket, so a
    licence with very many events is spread over its buckets."""
    micros = ttl_minutes * 60_000_000
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    ev = events.withColumn("_us", t).withColumn("_b", F.floor(t / F.lit(micros)))
    end = ev.agg(F.max("_us").alias("_end"))
    done = ev.filter(F.col("kind") == "complete").select(
        F.col("license_id").alias("_l"), F.col("_us").alias("_c"), F.col("event_id").alias("_ce"),
        F.explode(F.array(F.col("_b"), F.col("_b") - 1)).alias("_cb"))
    claims = ev.filter(F.col("kind") == "claim")
    met = (F.col("license_id") == F.col("_l")) & (F.col("_b") == F.col("_cb")) & (F.col("_c") <= F.col("_us") + micros) & (
        (F.col("_c") > F.col("_us")) | ((F.col("_c") == F.col("_us")) & (F.col("_ce") > F.col("event_id"))))
    open_ = claims.join(done, met, "left_anti")
    return open_.filter(F.col("_us") + micros < end.scalar()).select(
        "license_id", F.col("ts").alias("claimed_at"), F.lit("reset").alias("action"))


# ---------------------------------------------------------------------------
# H4, H5, H9: windowed counts with a watermark
# ---------------------------------------------------------------------------

def log_windows(stream: DataFrame, size: str = "5 minutes", lateness: str = "10 minutes",
                labels=("route",), slide: str | None = None) -> DataFrame:
    """H9 (and H4/H5 on a stream): counts per event-time window; a window is
    final once the watermark passes its end (append mode), and rows later than
    the watermark are dropped."""
    s = event_time(stream).withWatermark("ts", lateness)
    return M.windowed_counts(s, list(labels), size, slide)


def counter_stream(stream: DataFrame, labels=("route", "status"), size: str = "1 minute",
                   lateness: str = "10 minutes") -> DataFrame:
    """H4: labelled request counters per event-time window (update or append mode)."""
    return log_windows(stream, size, lateness, labels)


def rate_stream(stream: DataFrame, labels=("route",), size: str = "5 minutes", slide: str = "15 seconds",
                lateness: str = "10 minutes") -> DataFrame:
    """H5: sliding 5-minute request rate stepping every 15 s (the scrape interval)."""
    return log_windows(stream, size, lateness, labels, slide)
