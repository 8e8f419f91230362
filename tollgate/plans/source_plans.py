"""Registered source / sink queries (A) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollgate.functions import patterns as P
from tollgate.functions.columns import order_key, url_path
from tollgate.operators import entitlements as E
from tollgate.plans.audit_plans import URL_PATH_SQL
from tollgate.plans.entitlement_plans import STEP_SQL, _TRANSFER_SQL as TRANSFER_SQL
from tollgate.plans.registry import register
from tollgate.sources import readers as R
from tollgate.sources.tables import TABLES, table_counts
from tollgate.streaming.replay import run_folder


@register("a1_table_counts", oracle="\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def a1(c):
    return table_counts(c.spark, c.sf_dir)


@register("a2_pages_corpus", oracle=f"""
SELECT page_id, url, {URL_PATH_SQL} AS path, length(html) AS n_chars FROM pages""")
def a2(c):
    p = c.pages
    return p.select("page_id", "url", url_path("url").alias("path"), F.length("html").cast("long").alias("n_chars"))


@register("a3_flatten_json", oracle="""
SELECT event_id, k AS key, json_extract_string(props, '$."' || k || '"') AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) t""")
def a3(c):
    return R.flatten_json(c.events.select("event_id", "props"), ["event_id"], "props", depth=2).filter("not malformed").drop("malformed")


@register("a4_access_log", views=("access_log_rows",), oracle="SELECT * FROM access_log_rows")
def a4(c):
    return R.parse_access_log(R.render_access_log(c.access_log_rows))


@register("a5_billing_envelopes", views=("billing_events_ext",), oracle="""
SELECT CAST(event_id AS VARCHAR) AS event_id, kind, date_trunc('second', ts) AS ts,
 CAST(subscription_id AS VARCHAR) AS subscription_id, date_trunc('second', period_end) AS period_end,
 amount, amount_refunded, cancel_at_period_end, sub_status FROM billing_events_ext""")
def a5(c):
    parsed = R.parse_billing_events(R.render_billing_events(c.billing_events_ext))
    return parsed.select("event_id", "kind", "ts", "subscription_id", "period_end", "amount",
                         "amount_refunded", "cancel_at_period_end", "sub_status")


_RAW_OK = "NOT broken AND kind = 'checkout_completed' AND email IS NOT NULL AND plan IN ('vpn', 'security_vpn')"
#: The billing rule: what the handler makes of each raw event (result, action), as CTEs up to `o`.
OUTCOMES_SQL = f"""
ev AS (SELECT r.* EXCLUDE (subscription_id, kind), r.kind,
   CASE WHEN broken THEN NULL WHEN r.kind = 'charge_refunded' THEN i.subscription_id ELSE r.subscription_id END AS sid
  FROM billing_raw r LEFT JOIN billing_invoices i USING (invoice_id)),
f AS (SELECT sid, min((ts, event_id)) AS first_k FROM ev WHERE {_RAW_OK} AND sid IS NOT NULL GROUP BY sid),
fc AS (SELECT customer_id AS cid, min((ts, event_id)) AS first_c FROM ev WHERE {_RAW_OK} AND customer_id IS NOT NULL GROUP BY customer_id),
j AS (SELECT ev.*, first_k, {_RAW_OK} AND CASE WHEN sid IS NOT NULL THEN (ts, event_id) = first_k
     ELSE customer_id IS NULL OR (ts, event_id) = first_c END AS created,
   amount_refunded < amount AS partial FROM ev LEFT JOIN f USING (sid) LEFT JOIN fc ON customer_id = cid),
o AS (SELECT event_id, sid, customer_id, created, kind, ts, CASE WHEN broken THEN 'error' WHEN kind = 'checkout_completed' THEN CASE WHEN created THEN 'success' END
   WHEN kind = 'payment_succeeded' AND billing_reason = 'subscription_create' THEN 'skipped'
   WHEN kind = 'charge_refunded' AND partial THEN 'skipped' WHEN sid IS NOT NULL THEN 'success' END AS result,
  CASE WHEN broken THEN NULL WHEN created THEN 'license_created' WHEN kind = 'payment_failed' AND sid IS NOT NULL THEN 'license_suspended'
   WHEN kind = 'charge_refunded' AND NOT partial AND sid IS NOT NULL THEN 'license_refunded'
   WHEN kind = 'subscription_updated' AND plan IN ('vpn', 'security_vpn') AND first_k IS NOT NULL AND (ts, event_id) > first_k THEN 'plan_changed' END AS action
  FROM j)"""


def raw_events(c):
    """The raw billing events as the handler sees them: an envelope without its object names
    nothing, a refund belongs to its invoice's subscription."""
    raw = c.billing_raw
    lost = ("subscription_id", "invoice_id", "customer_id", "email", "plan")
    return E.resolve_refund_events(raw.withColumns({n: F.when(~F.col("broken"), F.col(n)) for n in lost}), c.billing_invoices)


def billing_audit(c):
    """Audit decisions of the billing events."""
    done = E.billing_outcomes(raw_events(c), P.CHECKOUT_PLANS).filter("action IS NOT NULL")
    return done.select("action", F.lit("subscription").alias("entity_type"), F.col("subscription_id").cast("string").alias("entity_id"),
                       F.col("kind").alias("details"), "ts")


_AUDIT_SQL = f"""WITH {OUTCOMES_SQL}
SELECT action, CAST(ts AS DATE) AS date, count(*) AS n FROM o WHERE action IS NOT NULL GROUP BY 1, 2"""


@register("a6_audit_actions", views=("billing_raw", "billing_invoices"), oracle=_AUDIT_SQL)
def a6(c):
    rows = R.audit_rows(billing_audit(c))
    return rows.groupBy("action", "date").agg(F.count(F.lit(1)).alias("n"))


@register("a6_audit_sink", views=("billing_raw", "billing_invoices"), oracle=_AUDIT_SQL)
def a6_sink(c):
    """Appended in batches of a week by two runs, the batches of one written twice, then read back."""
    rows, path = R.audit_rows(billing_audit(c)), run_folder(c.spark, "audit")
    week = F.date_diff("date", F.lit("2024-01-01").cast("date")) / 7
    for run, lo, hi in (("first", -1e9, 2.0), ("first", -1e9, 2.0), ("second", 2.0, 3.0), ("second", 3.0, 1e9), ("second", 2.0, 3.0)):
        R.append_audit(rows.filter((week >= lo) & (week < hi)), path, run, int(max(lo, 0)))
    return R.read_audit(c.spark, path).groupBy("action", "date").agg(F.count(F.lit(1)).alias("n"))


@register("a5_billing_pipeline", views=("billing_raw", "billing_invoices", "billing_subscriptions"), oracle=f"""
WITH {OUTCOMES_SQL},
ops AS (SELECT sid, ts, event_id, CASE WHEN broken THEN '-' WHEN {_RAW_OK} THEN 'K'
   WHEN kind = 'payment_succeeded' AND billing_reason <> 'subscription_create' THEN 'R' WHEN kind = 'payment_failed' THEN 'P'
   WHEN kind = 'subscription_deleted' THEN 'D' WHEN kind = 'charge_refunded' AND NOT partial THEN 'P'
   WHEN kind = 'subscription_updated' THEN CASE WHEN cancel_at_period_end THEN 'X' WHEN sub_status = 'active' THEN 'R'
     WHEN sub_status IN ('past_due', 'unpaid') THEN 'P' ELSE '-' END ELSE '-' END AS op FROM j WHERE sid IS NOT NULL),
st AS (SELECT sid, list_reduce(list_prepend('none', list(op ORDER BY ts, event_id)), lambda s, e: {STEP_SQL}) AS status FROM ops GROUP BY sid),
lic AS (SELECT CASE WHEN b.status IN ('active', 'trialing') THEN st.status ELSE 'expired' END AS status
   FROM st JOIN billing_subscriptions b ON b.subscription_id = CAST(sid AS VARCHAR) WHERE st.status <> 'none'
  UNION ALL SELECT 'active' FROM o WHERE created AND sid IS NULL)
SELECT 'licences' AS part, status AS name, '' AS label, count(*) AS n FROM lic GROUP BY status
UNION ALL SELECT 'audit', action, CAST(CAST(ts AS DATE) AS VARCHAR), count(*) FROM o WHERE action IS NOT NULL GROUP BY action, CAST(ts AS DATE)
UNION ALL SELECT 'events', kind, result, count(*) FROM o WHERE result IS NOT NULL GROUP BY kind, result""")
def a5p(c):
    """Envelopes to licence states, audit rows and event counters."""
    ev = R.parse_billing_events(R.render_billing_events(c.billing_raw))
    ev = ev.withColumns({"event_id": F.col("event_id").cast("long"), "subscription_id": F.col("subscription_id").cast("long")})
    ev = E.resolve_refund_events(ev, c.billing_invoices)
    parsed = run_folder(c.spark, "billing")  # parsed once; the lineage of the rendered JSON ends here
    ev.write.parquet(parsed)
    ev = c.spark.read.schema(ev.schema).parquet(parsed)
    count = F.count(F.lit(1)).alias("n")
    licences = E.billing_licences(ev, None, P.CHECKOUT_PLANS, c.billing_subscriptions).groupBy("status").agg(count)
    # actions, counters and licences without a subscription from one pass over the outcomes
    alone = F.when(F.col("created") & F.col("subscription_id").isNull(), P.STATUS_ACTIVE)
    row = lambda part, name, label: F.struct(F.lit(part).alias("part"), name.alias("name"), label.alias("label"))
    done = E.billing_outcomes(ev, P.CHECKOUT_PLANS).select(F.explode(F.array(
        row("audit", F.col("action"), F.to_date("ts").cast("string")), row("licences", alone, F.lit("")),
        row("events", F.when(F.col("result").isNotNull(), F.col("kind")), F.col("result")))).alias("r")).select("r.*")
    counts = done.filter("name IS NOT NULL").groupBy("part", "name", "label").agg(count)
    both = counts.unionByName(licences.select(F.lit("licences").alias("part"), F.col("status").alias("name"), F.lit("").alias("label"), "n"))
    return both.groupBy("part", "name", "label").agg(F.sum("n").alias("n"))


ALIGNED_SQL = """
SELECT id, status, CAST(NULL AS BIGINT) AS node_id, CAST(NULL AS TIMESTAMP) AS last_check FROM licenses
UNION ALL SELECT id, status, node_id, last_check FROM licenses"""


@register("a8_align_schema", views=("licenses",), oracle=ALIGNED_SQL)
def a8(c):
    lic = c.licenses.select("id", "status", "node_id", "last_check")
    old = lic.select("id", "status")  # a file written before the columns were added
    return R.align_schema(old, lic.schema).unionByName(lic)


@register("a8_two_versions", views=("licenses",), oracle=ALIGNED_SQL)
def a8_two_versions(c):
    """Parquet files of an older and the current version, in one folder, read together."""
    lic, path = c.licenses.select("id", "status", "node_id", "last_check"), run_folder(c.spark, "versions")
    lic.select("id", "status").write.parquet(f"{path}/v1")
    lic.withColumn("note", F.lit("dropped later")).write.parquet(f"{path}/v2")
    return R.read_versions(c.spark, path, lic.schema)


def _transfer_audit(c):
    d = E.transfer_decision(c.transfer_requests, c.transfer_licenses, as_of="ts")
    first = (d.filter(F.col("decision") == "allowed").groupBy("license_id")
             .agg(F.min_by("ts", order_key("ts", "request_id")).alias("ts")))
    return first.select(F.lit("device_transfer").alias("action"), F.lit("license").alias("entity_type"),
                        F.col("license_id").alias("entity_id"), F.lit("transfer").alias("details"), "ts")


def _cleanup_audit(c):
    from tollgate.sources.views import LICENSE_AS_OF
    return E.expired_with_keys(c.licenses, LICENSE_AS_OF).select(
        F.lit("expired_key_cleanup").alias("action"), F.lit("license").alias("entity_type"),
        F.col("id").alias("entity_id"), F.concat(F.lit("key="), F.col("key_id")).alias("details"),
        F.lit(LICENSE_AS_OF).cast("timestamp_ntz").alias("ts"))


def _retry_audit(c):
    q = c.retry_queue
    r = E.retry_step(q, q.select("id", "send_ok"), "2024-01-15 00:00:00").filter(
        F.col("action").isin("sent", "exhausted"))
    return r.select(F.when(F.col("action") == "sent", "email_retry_success").otherwise("email_retry_exhausted")
                    .alias("action"), F.lit("email_retry").alias("entity_type"), F.col("id").alias("entity_id"),
                    F.concat(F.lit("attempts="), F.col("attempts").cast("string")).alias("details"),
                    F.lit("2024-01-15 00:00:00").cast("timestamp_ntz").alias("ts"))


@register("a6_audit_all", views=("billing_raw", "billing_invoices", "transfer_requests", "transfer_licenses", "licenses",
                                 "retry_queue"), oracle=f"""
WITH {OUTCOMES_SQL},
bill AS (SELECT action, ts FROM o),
d AS ({TRANSFER_SQL}),
tr AS (SELECT 'device_transfer' AS action, min(ts) AS ts FROM d WHERE decision = 'allowed' GROUP BY license_id),
cl AS (SELECT 'expired_key_cleanup' AS action, TIMESTAMP '2000-01-01 00:00:00' AS ts FROM licenses
  WHERE expires_at < TIMESTAMP '2000-01-01 00:00:00' AND key_id IS NOT NULL AND key_id <> 'pending'
  AND status IN ('expired', 'cancelled', 'suspended')),
rt AS (SELECT CASE WHEN coalesce(send_ok, false) THEN 'email_retry_success' ELSE 'email_retry_exhausted' END AS action,
  TIMESTAMP '2024-01-15 00:00:00' AS ts FROM retry_queue
  WHERE attempts < 3 AND next_retry <= TIMESTAMP '2024-01-15 00:00:00' AND (coalesce(send_ok, false) OR attempts + 1 >= 3)),
a AS (SELECT action, ts FROM bill WHERE action IS NOT NULL UNION ALL SELECT action, ts FROM tr
  UNION ALL SELECT action, ts FROM cl UNION ALL SELECT action, ts FROM rt)
SELECT action, CAST(ts AS DATE) AS date, count(*) AS n FROM a GROUP BY 1, 2""")
def a6all(c):
    parts = [billing_audit(c),
             _transfer_audit(c), _cleanup_audit(c), _retry_audit(c)]
    rows = None
    for p in parts:
        p = R.audit_rows(p)
        rows = p if rows is None else rows.unionByName(p)
    return rows.groupBy("action", "date").agg(F.count(F.lit(1)).alias("n"))
