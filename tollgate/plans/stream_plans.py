"""The streaming operators: registered batch forms, and stream runs.

A stream run replays a view in slices of about a week as ``availableNow`` micro-batches, in a new folder
under ``spark.checkpoint.dir``, restarted from its checkpoint for each slice; some rows arrive a
slice late.  The result is read from the run's sink and held against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollgate.functions import patterns as P
from tollgate.plans.entitlement_plans import DEVICES_SQL, LICENCE_RECORDS_SQL
from tollgate.plans.registry import register
from tollgate.streaming import devices
from tollgate.streaming.jobs import (claim_timeouts_batch, dedup_events, dedup_events_batch, device_deltas, event_time, log_windows,
                                     merge_device_deltas, stream_states)
from tollgate.streaming.late import account_windows, late_rows, window_counts
from tollgate.streaming.replay import replay, run_folder, to_files

#: Slices of a week, the last one open; a sentinel after them moves the watermark past every row.
SLICES = 4
_WEEK_SQL = f"greatest(0, least({SLICES - 1}, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7))"


def _week():
    days = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return F.greatest(F.lit(0), F.least(F.lit(SLICES - 1), F.floor(days / 7).cast("int")))


def _sentinel(df, at: str = "2099-01-01 00:00:00", **values):
    """One row of NULLs but for a late event time, `values` and its slice."""
    cells = {"ts": F.lit(at).cast("timestamp_ntz"), "_slice": F.lit(SLICES + 1), **{k: F.lit(v) for k, v in values.items()}}
    return df.sparkSession.range(1).select(*[cells.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])


@register("h1_stream_dedup", views=("billing_events",), oracle="SELECT * FROM billing_events")
def h1_stream(c):
    """Every event comes again a minute later, a slice after its first copy."""
    ev = c.billing_events.withColumn("_slice", _week())
    again = ev.withColumns({"ts": F.col("ts") + F.expr("INTERVAL 1 MINUTE"), "_slice": F.col("_slice") + 1})
    folder = run_folder(c.spark, "h1")
    replay(ev.unionByName(again), "_slice", lambda s, at: to_files(dedup_events(s), f"{folder}/out", at), folder, list(range(SLICES + 1)))
    names = c.billing_events.columns
    return c.spark.read.parquet(f"{folder}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(names)


@register("h2_stream_states", views=("billing_events_ext",),
          oracle=f"SELECT subscription_id, status, expires_at, plan FROM ({LICENCE_RECORDS_SQL}) r")
def h2_stream(c):
    """A third of the events comes a slice late, within the lateness."""
    ev = c.billing_events_ext.withColumn("_slice", _week() + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0))
    ev = ev.unionByName(_sentinel(ev, event_id=-1, subscription_id=-1, kind="none"))
    folder = run_folder(c.spark, "h2")
    replay(ev, "_slice", lambda s, at: to_files(stream_states(s, "11 days", allowed_plans=P.CHECKOUT_PLANS), f"{folder}/out", at, "update"),
           folder, list(range(SLICES + 2)))
    out = c.spark.read.parquet(f"{folder}/out/batch=*")
    last = out.groupBy("subscription_id").agg(F.max_by(F.struct("status", "expires_at", "plan"), "n_applied").alias("r"))
    return last.select("subscription_id", "r.*")


@register("h7_stream_devices", views=("device_seen",), oracle=DEVICES_SQL)
def h7_stream(c):
    """Compacted and vacuumed while it runs; the second half of the slices comes under a new checkpoint."""
    seen = c.device_seen.withColumn("_slice", _week() + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0))
    folder = run_folder(c.spark, "h7")
    root = f"{folder}/table"

    def between(i):
        devices.compact(c.spark, root)
        devices.vacuum(c.spark, root)
    half = (SLICES + 1) // 2
    for part, slices in (("a", list(range(half))), ("b", list(range(half, SLICES + 1)))):
        replay(seen, "_slice", lambda s, at: devices.stream_devices(s, root, at), f"{folder}/{part}", slices, between if part == "a" else None)
    return devices.read_devices(c.spark, root)


@register("h9_stream_windows", views=("request_log",), oracle=f"""
WITH d AS (SELECT *, {_WEEK_SQL} + CASE WHEN request_id % 7 = 0 THEN 1 ELSE 0 END AS s FROM request_log),
m AS (SELECT s, max(ts) AS mx FROM d GROUP BY s),
k AS (SELECT a.s, max(b.mx) - INTERVAL 3 DAY AS mark FROM m a LEFT JOIN m b ON b.s < a.s GROUP BY a.s),
w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, route,
  coalesce(time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= mark, false) AS is_late FROM d JOIN k USING (s))
SELECT window_start, route, count_if(NOT is_late) AS on_time, count_if(NOT is_late) AS counted, count_if(is_late) AS late
FROM w GROUP BY window_start, route""")
def h9_stream(c):
    """On-time counts by Spark's own watermark and by the accounting; with the late rows they are all rows."""
    log = c.request_log.withColumn("_slice", _week() + F.when(F.col("request_id") % 7 == 0, 1).otherwise(0))
    log = log.unionByName(_sentinel(log, request_id=-1, route="sentinel"))
    folder, slices = run_folder(c.spark, "h9"), list(range(SLICES + 2))
    replay(log, "_slice", lambda s, at: to_files(log_windows(s, "6 hours", "3 days"), f"{folder}/out", at), f"{folder}/own", slices)
    replay(log, "_slice", lambda s, at: account_windows(event_time(s), f"{folder}/table", at, "6 hours", "3 days"), f"{folder}/account", slices)
    key = ["window_start", "route"]
    own = c.spark.read.parquet(f"{folder}/out").select(*key, F.col("requests").alias("on_time"))
    counted = window_counts(c.spark, f"{folder}/table", "3 days").select(*key, F.col("requests").alias("counted"))
    late = late_rows(c.spark, f"{folder}/table").groupBy(*key).agg(F.count(F.lit(1)).alias("late"))
    out = own.join(counted, key, "full").join(late, key, "full").filter("route <> 'sentinel'")
    n = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "route", n("on_time"), n("counted"), n("late"))


@register("h1_dedup_events", views=("billing_events",), oracle="""
WITH copies AS (SELECT * FROM billing_events UNION ALL
  SELECT event_id, ts + INTERVAL 1 MINUTE, subscription_id, amount, kind, cancel_at_period_end, sub_status, amount_refunded
  FROM billing_events)
SELECT event_id, r[1] AS ts, r[2] AS subscription_id, r[3] AS amount, r[4] AS kind, r[5] AS cancel_at_period_end,
 r[6] AS sub_status, r[7] AS amount_refunded
FROM (SELECT event_id, min((ts, subscription_id, amount, kind, cancel_at_period_end, sub_status, amount_refunded)) AS r
  FROM copies GROUP BY event_id) t""")
def h1(c):
    ev = c.billing_events
    redelivered = ev.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 MINUTE"))
    return dedup_events_batch(ev.unionByName(redelivered))


@register("h6_claim_timeouts", views=("claim_events",), oracle="""
SELECT license_id, ts AS claimed_at, 'reset' AS action FROM claim_events c
WHERE kind = 'claim' AND ts + INTERVAL 5 MINUTE < (SELECT max(ts) FROM claim_events)
 AND NOT EXISTS (SELECT 1 FROM claim_events d WHERE d.kind = 'complete' AND d.license_id = c.license_id
   AND (d.ts, d.event_id) > (c.ts, c.event_id) AND d.ts <= c.ts + INTERVAL 5 MINUTE)""")
def h6(c):
    return claim_timeouts_batch(c.claim_events)


@register("h7_device_deltas", views=("device_seen",), oracle="""
SELECT device_id, license_id, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(ip, (ts, event_id)) AS last_ip
FROM device_seen GROUP BY device_id, license_id""")
def h7(c):
    """Partial aggregates of three slices of the sightings, merged."""
    parts = [device_deltas(c.device_seen.filter(F.col("event_id") % 3 == i)) for i in range(3)]
    merged = merge_device_deltas(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return merged.select("device_id", "license_id", "first_seen", "last_seen", "last_ip")
