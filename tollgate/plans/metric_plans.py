"""Registered service-metric queries and their oracles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tollgate.functions import patterns as P
from tollgate.functions.columns import normalize_route
from tollgate.operators import entitlements as E
from tollgate.operators import metrics as M
from tollgate.plans.entitlement_plans import AS_OF_SQL, BAD_DEV, BAD_KEY, STALE_SQL
from tollgate.plans.registry import register
from tollgate.plans.source_plans import OUTCOMES_SQL, raw_events
from tollgate.sources.views import LICENSE_AS_OF


def hist_sql(src: str, value: str, labels: list[str], buckets) -> str:
    """DuckDB text of :func:`metrics.histogram` (same bucket constants)."""
    lab = ", ".join(labels)
    aggs = ", ".join(f"count(*) FILTER (WHERE {value} <= {b!r}) AS b{i}" for i, b in enumerate(buckets))
    g = f"(SELECT {lab}, {aggs}, count({value}) AS b{len(buckets)}, sum({value}) AS sum_value FROM {src} GROUP BY {lab})"
    bounds = list(buckets) + [math.inf]
    parts = []
    for i, b in enumerate(bounds):
        lv = "'inf'::DOUBLE" if math.isinf(b) else f"CAST({b!r} AS DOUBLE)"
        parts.append(f"SELECT {lab}, sum_value, '{M.le_label(b)}' AS le, {lv} AS le_value, b{i} AS cum_count FROM {g} g{i}")
    return "\nUNION ALL ".join(parts)


def quantile_sql(hist: str, labels: list[str], qs) -> str:
    lab = ", ".join(labels)
    qv = ", ".join(f"(CAST({q!r} AS DOUBLE))" for q in qs)
    return f"""SELECT {lab}, q, CASE WHEN total = 0 THEN NULL WHEN isinf(le_value) THEN prev_le
  WHEN cum_count - prev_cum = 0 THEN le_value
  ELSE prev_le + (le_value - prev_le) * ((q * total - prev_cum) / (cum_count - prev_cum)) END AS value
FROM (SELECT hq.*, qs.q, row_number() OVER (PARTITION BY {", ".join("hq." + x for x in labels)}, qs.q ORDER BY hq.le_value) AS rn
  FROM (SELECT {lab}, le_value, cum_count,
     coalesce(lag(cum_count) OVER (PARTITION BY {lab} ORDER BY le_value), 0) AS prev_cum,
     coalesce(lag(le_value) OVER (PARTITION BY {lab} ORDER BY le_value), 0.0) AS prev_le,
     max(cum_count) OVER (PARTITION BY {lab}) AS total FROM ({hist}) h0) hq,
  (VALUES {qv}) qs(q)
  WHERE hq.cum_count >= qs.q * hq.total) t WHERE rn = 1"""


# ---- counters -------------------------------------------------------------------------

@register("d9_device_counts", views=("device_seen",), oracle="""
SELECT license_id, count(*) AS n_devices, count(*) > 5 AS over_limit
FROM (SELECT DISTINCT device_id, license_id FROM device_seen) t GROUP BY license_id""")
def d9(c):
    return M.device_counts(E.upsert_devices(c.device_seen), 5)


@register("d10_request_counter", views=("request_log",), headline=True, oracle="""
SELECT coalesce(regexp_replace(route, '\\?.*$', ''), 'unmatched') AS route, status, count(*) AS value
FROM request_log GROUP BY 1, 2""")
def d10(c):
    return M.counter(c.request_log.withColumn("route", normalize_route("route")), ["route", "status"])


@register("d11_validation_counter", views=("device_requests", "licenses"), oracle=f"""
SELECT result, count(*) AS value FROM (
 SELECT CASE WHEN r.bad THEN 'bad_request' WHEN l.id IS NULL THEN 'not_found'
  WHEN l.status = 'expired' THEN 'expired' WHEN l.status = 'suspended' THEN 'suspended'
  WHEN l.expires_at < {AS_OF_SQL} THEN 'expired'
  WHEN l.device_id IS NOT NULL AND l.device_id <> r.device_id THEN 'device_mismatch'
  ELSE 'valid' END AS result
 FROM (SELECT *, {BAD_KEY} OR {BAD_DEV} AS bad FROM device_requests) r LEFT JOIN licenses l ON r.key = l.key) t
GROUP BY result""")
def d11(c):
    return M.counter(E.validation_outcome(c.device_requests, c.licenses, LICENSE_AS_OF), ["result"])


@register("d12_provisioned_by_plan", views=("licenses",), oracle="""
SELECT plan, count(*) AS value FROM licenses WHERE key_id IS NOT NULL AND key_id <> 'pending' GROUP BY plan""")
def d12(c):
    lic = c.licenses
    return M.counter(lic.filter(F.col("key_id").isNotNull() & (F.col("key_id") != P.PENDING)), ["plan"])


@register("d13_billing_counter", views=("billing_raw", "billing_invoices"), oracle=f"""WITH {OUTCOMES_SQL}
SELECT kind, result, count(*) AS value FROM o WHERE result IS NOT NULL GROUP BY kind, result""")
def d13(c):
    done = E.billing_outcomes(raw_events(c), P.CHECKOUT_PLANS)
    return M.counter(done.filter("result IS NOT NULL"), ["kind", "result"])


@register("d14_checkout_counter", views=("checkouts",), oracle="""
SELECT plan, count(*) AS value FROM checkouts WHERE plan IN ('vpn', 'security_vpn') GROUP BY plan""")
def d14(c):
    return M.counter(c.checkouts.filter(F.col("plan").isin(*P.CHECKOUT_PLANS)), ["plan"])


def _upstream(log):
    return log.select("*", F.expr("substring(route, 2)").alias("operation"),
                      F.when(F.col("status") >= 500, "error").otherwise("success").alias("result"))


@register("d15_upstream_counter", views=("request_log",), oracle="""
SELECT substr(route, 2) AS operation, CASE WHEN status >= 500 THEN 'error' ELSE 'success' END AS result,
 count(*) AS value FROM request_log GROUP BY 1, 2""")
def d15(c):
    return M.counter(_upstream(c.request_log), ["operation", "result"])


@register("d16_email_counter", views=("retry_queue",), oracle="""
SELECT CASE WHEN send_ok THEN 'success' ELSE 'error' END AS result, count(*) AS value FROM retry_queue GROUP BY 1""")
def d16(c):
    q = c.retry_queue
    return M.counter(q.withColumn("result", F.when(F.col("send_ok"), "success").otherwise("error")), ["result"])


# ---- histograms ---------------------------------------------------------------------

D17_SQL = hist_sql("request_log", "duration_s", ["route"], P.REQUEST_BUCKETS)


@register("d17_request_histogram", views=("request_log",), headline=True, oracle=D17_SQL)
def d17(c):
    return M.histogram(c.request_log, "duration_s", ["route"], P.REQUEST_BUCKETS)


@register("d18_upstream_histogram", views=("request_log",), oracle=hist_sql(
    "(SELECT *, substr(route, 2) AS operation, CASE WHEN status >= 500 THEN 'error' ELSE 'success' END AS result FROM request_log)",
    "duration_s", ["operation", "result"], P.UPSTREAM_BUCKETS))
def d18(c):
    return M.histogram(_upstream(c.request_log), "duration_s", ["operation", "result"], P.UPSTREAM_BUCKETS)


@register("d19_histogram_quantiles", views=("request_log",), oracle=quantile_sql(D17_SQL, ["route"], (0.5, 0.95, 0.99)))
def d19(c):
    h = M.histogram(c.request_log, "duration_s", ["route"], P.REQUEST_BUCKETS)
    return M.histogram_quantile(h, ["route"], (0.5, 0.95, 0.99))


@register("d20_sum_by_status", views=("request_log",), oracle="""
SELECT status, CAST(count(*) AS BIGINT) AS value FROM request_log GROUP BY status""")
def d20(c):
    return M.sum_by(M.counter(c.request_log, ["route", "status"]), ["status"])


# ---- runs, rates, windows -------------------------------------------------------------

FAILURE_RUNS_SQL = """
SELECT client_id, min(ts) AS run_start, max(ts) AS run_end, count(*) AS run_length FROM (
 SELECT *, sum(CASE WHEN status >= 500 THEN 0 ELSE 1 END) OVER (PARTITION BY client_id ORDER BY ts, request_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM request_log) t
WHERE status >= 500 GROUP BY client_id, island HAVING count(*) >= 3"""


@register("e5_failure_runs", views=("request_log",), oracle=FAILURE_RUNS_SQL)
def e5(c):
    return M.failure_runs(c.request_log, 3)


@register("e5_failure_runs_by_count", views=("request_log",), oracle=FAILURE_RUNS_SQL)
def e5_by_count(c):
    return M.failure_runs(c.request_log, 3, rows_per_piece=20_000)


@register("e7_counter_rate", views=("request_log",), oracle="""
WITH b AS (SELECT route, time_bucket(INTERVAL '15 seconds', ts) AS bucket, count(*) AS n FROM request_log GROUP BY 1, 2),
s AS (SELECT route, bucket + INTERVAL '15 seconds' AS ts, CAST(sum(n) OVER (PARTITION BY route, time_bucket(INTERVAL '1 day', bucket)
   ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS value FROM b),
d AS (SELECT *, lag(value) OVER (PARTITION BY route ORDER BY ts) AS prev FROM s)
SELECT route, time_bucket(INTERVAL '5 minutes', ts) AS window_start,
 sum(CASE WHEN prev IS NULL THEN 0.0 WHEN value >= prev THEN value - prev ELSE value END) AS increase,
 sum(CASE WHEN prev IS NULL THEN 0.0 WHEN value >= prev THEN value - prev ELSE value END) / 300.0 AS rate
FROM d GROUP BY 1, 2""")
def e7(c):
    return M.counter_rate(M.counter_samples(c.request_log, ["route"]), ["route"], "5 minutes")


@register("h3_rate_violations", views=("request_log",), headline=True, oracle="""
SELECT client_id, time_bucket(INTERVAL '1 day', ts) AS window_start,
 time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end, count(*) AS requests
FROM request_log GROUP BY 1, 2 HAVING count(*) > 5""")
def h3(c):
    return M.rate_violations(c.request_log, "1 day", 5)


@register("h5_sliding_rate_scrape", views=("request_log",), oracle="""
SELECT window_start, route, count(*) AS requests, count(*) / 300.0 AS rate FROM (
 SELECT route, time_bucket(INTERVAL '15 seconds', ts) - INTERVAL '15 seconds' * k AS window_start
 FROM request_log, range(0, 20) r(k)) t GROUP BY 1, 2""")
def h5_scrape(c):
    return M.windowed_counts(c.request_log, ["route"], "5 minutes", "15 seconds")


@register("h8_ratio_alerts", views=("billing_events", ), oracle="""
SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, 'payment_failures' AS alert, count(*) FILTER (WHERE kind = 'payment_failed') / count(*) AS value
FROM billing_events GROUP BY 1 HAVING count(*) FILTER (WHERE kind = 'payment_failed') / count(*) > 0.3
UNION ALL SELECT time_bucket(INTERVAL '1 hour', ts), 'refunds', count(*) FILTER (WHERE kind = 'charge_refunded') / count(*)
FROM billing_events GROUP BY 1 HAVING count(*) FILTER (WHERE kind = 'charge_refunded') / count(*) > 0.4""")
def h8_ratio(c):
    return M.ratio_alerts(c.billing_events, {"payment_failures": (F.col("kind") == "payment_failed", 0.3),
                                             "refunds": (F.col("kind") == "charge_refunded", 0.4)})


@register("h4_counter_windows", views=("request_log",), oracle="""
SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, route, status, count(*) AS requests,
 count(*) / 3600.0 AS rate FROM request_log GROUP BY 1, 2, 3""")
def h4(c):
    return M.windowed_counts(c.request_log, ["route", "status"], "1 hour")


@register("h5_sliding_rate", views=("request_log",), oracle="""
SELECT window_start, route, count(*) AS requests, count(*) / 3600.0 AS rate FROM (
 SELECT route, time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '15 minutes' * k AS window_start
 FROM request_log, range(0, 4) r(k)) t GROUP BY 1, 2""")
def h5(c):
    return M.windowed_counts(c.request_log, ["route"], "1 hour", "15 minutes")


_H8_HIST = hist_sql("(SELECT *, time_bucket(INTERVAL '1 hour', ts) AS window_start FROM request_log)",
                    "duration_s", ["window_start"], P.REQUEST_BUCKETS)


@register("h8_alerts", views=("request_log",), oracle=f"""
WITH per AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS n,
   count(*) FILTER (WHERE status >= 500) AS errors FROM request_log GROUP BY 1),
cal AS (SELECT unnest(generate_series(min(window_start), max(window_start), INTERVAL '1 hour')) AS window_start FROM per)
SELECT window_start, 'high_error_rate' AS alert, errors / n AS value FROM per WHERE errors / n > 0.25
UNION ALL SELECT window_start, 'high_latency', value FROM ({quantile_sql(_H8_HIST, ["window_start"], (0.95,))}) p WHERE value > 4.5
UNION ALL SELECT window_start, 'missing_data', 0.0 FROM cal WHERE window_start NOT IN (SELECT window_start FROM per)""")
def h8(c):
    return M.alerts(c.request_log, "1 hour", 0.25, 4.5)


# ---- A7 ---------------------------------------------------------------------------------

@register("a7_metric_snapshot", views=("licenses", "retry_queue", "request_log"), oracle=f"""
SELECT 'active_licenses' AS metric, '' AS labels, CAST(count(*) FILTER (WHERE status IN ('active', 'cancelled') AND expires_at > {AS_OF_SQL}) AS DOUBLE) AS value FROM licenses
UNION ALL SELECT 'active_keys', '', CAST(count(*) FILTER (WHERE key_id IS NOT NULL AND key_id <> 'pending') AS DOUBLE) FROM licenses
UNION ALL SELECT 'stale_claims', '', CAST(count(*) FILTER (WHERE {STALE_SQL.format(now=AS_OF_SQL)}) AS DOUBLE) FROM licenses l
UNION ALL SELECT 'retry_depth', '', CAST(count(*) FILTER (WHERE attempts < 3) AS DOUBLE) FROM retry_queue
UNION ALL SELECT 'http_requests_total', 'route=' || route || ',status=' || CAST(status AS VARCHAR), CAST(count(*) AS DOUBLE)
 FROM request_log GROUP BY route, status
UNION ALL SELECT 'keys_by_plan', 'plan=' || plan, CAST(count(*) AS DOUBLE) FROM licenses
 WHERE key_id IS NOT NULL AND key_id <> 'pending' GROUP BY plan""")
def a7(c):
    lic, q, log = c.licenses, c.retry_queue, c.request_log
    g = E.licence_gauges(lic, LICENSE_AS_OF)
    depth = E.retry_depth(q)
    gauges = [g.select("active_licenses", "active_keys", "stale_claims"), depth.select(F.col(depth.columns[0]).alias("retry_depth"))]
    keyed = lic.filter(F.col("key_id").isNotNull() & (F.col("key_id") != P.PENDING))
    counters = {"http_requests_total": (M.counter(log, ["route", "status"]), ["route", "status"]),
                "keys_by_plan": (M.counter(keyed, ["plan"]), ["plan"])}
    return M.metric_snapshot(gauges, counters)


# Own grouping of the test routes onto three limiters, with daily quotas of our
# own (the test traffic is about two requests per client per day).
LIMIT_GROUPS = (("checkout", "/purchase", 1), ("license", "/signup", 1), ("api", "/", 2))
#: The service's limits per minute, for the routes of the view.
_PER_MINUTE = {name: limit for name, limit, _ in P.RATE_LIMITS}
SERVICE_LIMITS = tuple((name, prefix, _PER_MINUTE[name]) for name, prefix, _ in LIMIT_GROUPS)


@register("h3_limiter_groups", views=("request_log",), oracle="""
SELECT limiter, client_id, time_bucket(INTERVAL '1 day', ts) AS window_start, count(*) AS requests, max(lim) AS "limit"
FROM (SELECT client_id, ts, CASE WHEN starts_with(route, '/purchase') THEN 'checkout' WHEN starts_with(route, '/signup') THEN 'license'
   WHEN starts_with(route, '/') THEN 'api' END AS limiter,
  CAST(CASE WHEN starts_with(route, '/purchase') THEN 1 WHEN starts_with(route, '/signup') THEN 1
   WHEN starts_with(route, '/') THEN 2 END AS BIGINT) AS lim FROM request_log) t
WHERE limiter IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > max(lim)""")
def h3g(c):
    return M.rate_limit_audit(c.request_log, LIMIT_GROUPS, "1 day")


@register("h3_service_limits", views=("request_burst",), oracle="""
SELECT limiter, client_id, time_bucket(INTERVAL '60 seconds', ts) AS window_start, count(*) AS requests, max(lim) AS "limit"
FROM (SELECT client_id, ts, CASE WHEN starts_with(route, '/purchase') THEN 'checkout' WHEN starts_with(route, '/signup') THEN 'license' ELSE 'api' END AS limiter,
  CAST(CASE WHEN starts_with(route, '/purchase') THEN 5 WHEN starts_with(route, '/signup') THEN 10 ELSE 30 END AS BIGINT) AS lim FROM request_burst) t
GROUP BY 1, 2, 3 HAVING count(*) > max(lim)""")
def h3_limits(c):
    """The service's own limits: 30, 10 and 5 requests per 60 seconds."""
    return M.rate_limit_audit(c.request_burst, SERVICE_LIMITS, "60 seconds")


@register("d10_log_line_counter", views=("access_log_rows",), oracle="""
SELECT method, coalesce(regexp_replace(path, '\\?.*$', ''), 'unmatched') AS route, status, count(*) AS value
FROM access_log_rows GROUP BY 1, 2, 3""")
def d10l(c):
    # access-log text -> columns (A4) -> route label (B14) -> counter by method/route/status
    from tollgate.sources import readers as R
    parsed = R.parse_access_log(R.render_access_log(c.access_log_rows))
    return M.counter(parsed.withColumn("route", normalize_route("path")), ["method", "route", "status"])
