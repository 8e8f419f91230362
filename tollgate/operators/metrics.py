"""Service metrics as table jobs: labelled counters, cumulative histograms,
quantiles from histograms, failure runs, reset-aware counter rates, windowed
counts, rate-limit audit and alert series (SURVEY D9-D20, E5, E7, H3-H5, H8, A7).

The same functions run on a batch DataFrame or a streaming one where the
operation allows it (windowed counts, rate-limit audit).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.functions import patterns as P
from tollgate.functions.columns import col
from tollgate.operators.ranking import lag_by_key, pieces_by_count, running_by_key


# ---------------------------------------------------------------------------
# counters (D9-D16, D20)
# ---------------------------------------------------------------------------

def counter(df: DataFrame, labels, name: str = "value") -> DataFrame:
    """Count of rows per label combination (partial aggregation map-side)."""
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias(name))


def sum_by(counts: DataFrame, labels, value: str = "value") -> DataFrame:
    """Totals of a counter over a subset of its labels."""
    return counts.groupBy(*labels).agg(F.sum(value).alias(value))


def device_counts(devices: DataFrame, limit: int) -> DataFrame:
    """Devices per licence, flagged above ``limit``."""
    return (devices.groupBy("license_id").agg(F.count(F.lit(1)).alias("n_devices"))
            .withColumn("over_limit", F.col("n_devices") > limit))


# ---------------------------------------------------------------------------
# histograms
# ---------------------------------------------------------------------------

def le_label(b: float) -> str:
    """Bucket bound as Prometheus prints it: 1 -> '1', 0.25 -> '0.25'."""
    return "+Inf" if math.isinf(b) else format(b, "g")


def histogram(df: DataFrame, value: str, labels, buckets=P.REQUEST_BUCKETS) -> DataFrame:
    """Cumulative bucket counts with inclusive upper bounds, '+Inf',
    plus the sum and count of the observations, one row per (labels, le).

    One aggregation pass computes every bucket (``count_if(value <= le)``), so
    the cost is one partial aggregate per label group whatever the data size."""
    v = F.col(value)
    bounds = list(buckets) + [math.inf]
    aggs = [F.count_if(v <= b).alias(f"_b{i}") for i, b in enumerate(buckets)]
    aggs += [F.count(v).alias(f"_b{len(buckets)}"), F.sum(v).alias("sum_value")]
    g = df.groupBy(*labels).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(le_label(b)).alias("le"), F.lit(float(b)).alias("le_value"),
                              F.col(f"_b{i}").alias("cum_count")) for i, b in enumerate(bounds)])
    return g.select(*labels, "sum_value", F.inline(rows))


def histogram_quantile(hist: DataFrame, labels, qs=(0.5, 0.95, 0.99)) -> DataFrame:
    """Quantiles from a cumulative histogram, as PromQL does it: find the
    first bucket whose cumulative count reaches q * total, interpolate linearly
    inside it with 0 as the first lower bound; if that bucket is '+Inf', return
    the highest finite bound.  NULL when the group is empty.

    The histogram has (groups x buckets) rows, so its windows are small."""
    w = Window.partitionBy(*labels).orderBy("le_value")
    h = hist.select(*labels, "le_value", "cum_count",
                    F.lag("cum_count", 1, 0).over(w).alias("prev_cum"),
                    F.lag("le_value", 1, 0.0).over(w).alias("prev_le"),
                    F.max("cum_count").over(Window.partitionBy(*labels)).alias("total"))
    h = h.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    rank = F.col("q") * F.col("total")
    hit = h.filter(F.col("cum_count") >= rank)
    # the first bucket reaching the rank; each numeric field by its own min_by
    # (fixed-width buffers: a hash aggregate)
    fields = ("le_value", "cum_count", "prev_cum", "prev_le", "total")
    first = hit.groupBy(*labels, "q").agg(*[F.min_by(f, "le_value").alias(f"_b_{f}") for f in fields])
    b = lambda f: F.col(f"_b_{f}")
    in_bucket = b("cum_count") - b("prev_cum")
    interp = b("prev_le") + (b("le_value") - b("prev_le")) * (
        (F.col("q") * b("total") - b("prev_cum")) / F.when(in_bucket > 0, in_bucket))
    value = (F.when(b("total") == 0, F.lit(None))
             .when(F.isnan(b("le_value")) | (b("le_value") == float("inf")), b("prev_le"))
             .when(in_bucket == 0, b("le_value"))
             .otherwise(interp))
    return first.select(*labels, "q", value.cast("double").alias("value"))


# ---------------------------------------------------------------------------
# E5: failure runs (gaps and islands)
# ---------------------------------------------------------------------------

def failure_runs(calls: DataFrame, threshold: int = P.FAILURE_RUN_THRESHOLD, key="client_id",
                 order=("ts", "request_id"), failed: Column | None = None, rows_per_piece: int | None = None) -> DataFrame:
    """E5: runs of at least ``threshold`` consecutive failed calls per key.

    The island id of a failure is the number of successful calls of its key
    before it, so consecutive failures share it.  That running count is
    computed by :func:`running_by_key` (range-partitioned), because the key here
    is a service: very few keys, one of which may carry most calls.  Pieces are
    hours, or with ``rows_per_piece`` runs of about so many calls (for bursts)."""
    failed = failed if failed is not None else (F.col("status") >= 500)
    c, piece = calls.select(key, *order, failed.alias("_fail")), None
    if rows_per_piece:
        c, piece = pieces_by_count(c, [key], list(order), rows_per_piece), F.col("_part")
    c = running_by_key(c, [key], list(order),
                       {"_island": ("sum", F.when(F.col("_fail"), 0).otherwise(1))}, piece)
    runs = (c.filter("_fail").groupBy(key, "_island")
            .agg(F.min(order[0]).alias("run_start"), F.max(order[0]).alias("run_end"),
                 F.count(F.lit(1)).alias("run_length")))
    return runs.filter(F.col("run_length") >= threshold).drop("_island")


# ---------------------------------------------------------------------------
# Counter increase and rate
# ---------------------------------------------------------------------------

def counter_samples(log: DataFrame, series=("route",), scrape="15 seconds", reset_every="1 day") -> DataFrame:
    """Counter samples as a scraper sees them: requests are first counted per
    (series, scrape interval) (partial aggregation), then each sample at the end
    of an interval holds the count since the last reset (a process restart every
    ``reset_every``).  The window that accumulates them is bounded by the number
    of scrape intervals per reset period, whatever the request volume."""
    b = log.groupBy(*series, F.window("ts", scrape).start.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    period = F.window("_bucket", reset_every).start
    w = (Window.partitionBy(*series, period).orderBy("_bucket")
         .rowsBetween(Window.unboundedPreceding, 0))
    step = _interval_seconds(scrape)
    return b.select(*series, (F.col("_bucket") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(step)))
                    .alias("ts"), F.sum("_n").over(w).cast("double").alias("value"))


def counter_rate(samples: DataFrame, series=("route",), range_="5 minutes",
                 order=("ts",)) -> DataFrame:
    """Increase and per-second rate of a counter per window.

    Each sample contributes its difference to the previous sample of its series;
    a drop is a reset, so the new value counts in full.  Windows are tumbling,
    epoch-aligned; there is no extrapolation to the window edges (PromQL does)."""
    samples = lag_by_key(samples, list(series), list(order), "value", "_prev")
    prev = F.col("_prev")
    d = samples.withColumn("_delta", F.when(prev.isNull(), 0.0)
                           .when(F.col("value") >= prev, F.col("value") - prev)
                           .otherwise(F.col("value")))
    seconds = _interval_seconds(range_)
    g = d.groupBy(*series, F.window("ts", range_).alias("w")).agg(F.sum("_delta").alias("increase"))
    return g.select(*series, F.col("w.start").alias("window_start"), "increase",
                    (F.col("increase") / F.lit(float(seconds))).alias("rate"))


def _interval_seconds(s: str) -> int:
    n, unit = s.split()
    mult = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return int(n) * mult


# ---------------------------------------------------------------------------
# H3-H5: windowed counts (batch or streaming)
# ---------------------------------------------------------------------------

def windowed_counts(log: DataFrame, labels, size="1 hour", slide: str | None = None) -> DataFrame:
    """H4/H5: requests per (window, labels); sliding when ``slide`` is given.
    ``rate`` is the count divided by the window length."""
    if slide and not log.isStreaming and _interval_seconds(size) % _interval_seconds(slide) == 0:
        # count per step first: the copies of a row in its size / slide windows are of counts
        log = log.groupBy(F.window("ts", slide).start.alias("ts"), *labels).agg(F.count(F.lit(1)).alias("_n"))
        g = log.groupBy(F.window("ts", size, slide).alias("w"), *labels).agg(F.sum("_n").alias("requests"))
    else:
        win = F.window("ts", size, slide) if slide else F.window("ts", size)
        g = log.groupBy(win.alias("w"), *labels).agg(F.count(F.lit(1)).alias("requests"))
    return g.select(F.col("w.start").alias("window_start"), *labels, "requests",
                    (F.col("requests") / F.lit(float(_interval_seconds(size)))).alias("rate"))


def rate_violations(log: DataFrame, window="60 seconds", limit: int = 30, key="client_id") -> DataFrame:
    """H3: (client, window) pairs with more requests than the limit allows.
    Windows are epoch-aligned tumbling windows (the live limiter's windows start
    at each client's first request: a chosen difference)."""
    g = log.groupBy(key, F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return g.filter(F.col("requests") > limit).select(
        key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests")


# ---------------------------------------------------------------------------
# H8: alert series
# ---------------------------------------------------------------------------

def ratio_alerts(df: DataFrame, rules: dict, size="1 hour") -> DataFrame:
    """H8 (event / provisioning failures): per window, the share of rows meeting
    each rule's condition; rows where it exceeds the rule's threshold.  ``rules``
    maps an alert name to (condition column, threshold), e.g. billing events
    whose result is 'error', or upstream calls that failed."""
    win = F.window("ts", size).start.alias("window_start")
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count_if(cond).alias(f"_c{i}")
                                             for i, (cond, _) in enumerate(rules.values())]
    per = df.groupBy(win).agg(*aggs)
    parts = [per.select("window_start", F.lit(name).alias("alert"),
                        F.try_divide(F.col(f"_c{i}"), F.col("_n")).alias("value"))
             .filter(F.col("value") > F.lit(thr))
             for i, (name, (_, thr)) in enumerate(rules.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def alerts(log: DataFrame, size="1 hour", max_error_rate=0.2, max_p95=4.0,
           buckets=P.REQUEST_BUCKETS) -> DataFrame:
    """H8: per window, the alerts that fire: high error rate (5xx share), high
    latency (p95 from the request histogram, D19) and missing data (a window
    with no requests between the first and the last one).  Thresholds are
    parameters: the service names the alerts but keeps no values."""
    win = F.window("ts", size).start.alias("window_start")
    per = log.groupBy(win).agg(F.count(F.lit(1)).alias("n"),
                               F.count_if(F.col("status") >= 500).alias("errors"))
    err = per.select("window_start", F.lit("high_error_rate").alias("alert"),
                     F.try_divide(F.col("errors"), F.col("n")).alias("value")).filter(F.col("value") > max_error_rate)
    hist = histogram(log.withColumn("window_start", win), "duration_s", ["window_start"], buckets)
    p95 = histogram_quantile(hist, ["window_start"], (0.95,))
    lat = p95.select("window_start", F.lit("high_latency").alias("alert"), "value").filter(
        F.col("value") > max_p95)
    step = _interval_seconds(size)
    span = per.agg(F.min("window_start").alias("lo"), F.max("window_start").alias("hi"))
    cal = span.select(F.explode(F.sequence("lo", "hi", F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                                           F.lit(step)))).alias("window_start"))
    missing = cal.join(per, "window_start", "left_anti").select(
        "window_start", F.lit("missing_data").alias("alert"), F.lit(0.0).alias("value"))
    return err.unionByName(lat).unionByName(missing)


# ---------------------------------------------------------------------------
# Metric snapshot
# ---------------------------------------------------------------------------

def labels_text(*pairs) -> Column:
    """Canonical label text 'k1=v1,k2=v2' (sorted by key) from (key, column) pairs."""
    pairs = sorted(pairs, key=lambda p: p[0])
    parts = []
    for k, c in pairs:
        parts += [F.lit(f"{k}="), col(c).cast("string")]
        parts.append(F.lit(","))
    return F.concat(*parts[:-1]) if parts else F.lit("")


def metric_snapshot(gauges: list[DataFrame], counters: dict[str, tuple[DataFrame, list]]) -> DataFrame:
    """Every gauge and counter as long rows (metric, labels, value).  ``gauges`` are
    one-row frames with one column per gauge, so gauges of one table share a pass;
    ``counters`` are frames with label columns and ``value``."""
    parts = [g.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.lit("").alias("labels"),
                                                  F.col(c).cast("double").alias("value")) for c in g.columns])))
             for g in gauges]
    for name, (cdf, labels) in counters.items():
        parts.append(cdf.select(F.lit(name).alias("metric"), labels_text(*[(l, l) for l in labels]).alias("labels"),
                                F.col("value").cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rate_limit_audit(log: DataFrame, groups, window: str = "60 seconds", key: str = "client_id",
                     route: str = "route") -> DataFrame:
    """H3 for several limiters at once.  ``groups`` is a list of (name, route
    prefix, limit); a request counts toward the first group whose prefix its
    route starts with ('' matches everything).  One aggregation pass over
    (group, client, window) for all groups."""
    g = F.lit(None).cast("string")
    lim = F.lit(None).cast("long")
    for name, prefix, limit in reversed(list(groups)):
        hit = F.col(route).startswith(prefix)
        g = F.when(hit, F.lit(name)).otherwise(g)
        lim = F.when(hit, F.lit(limit).cast("long")).otherwise(lim)
    t = log.select(key, "ts", g.alias("limiter"), lim.alias("limit")).filter(F.col("limiter").isNotNull())
    c = t.groupBy("limiter", key, F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.max("limit").alias("limit"))
    return c.filter(F.col("requests") > F.col("limit")).select(
        "limiter", key, F.col("w.start").alias("window_start"), "requests", "limit")
