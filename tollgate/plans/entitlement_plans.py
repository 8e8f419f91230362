"""Registered entitlement queries (B, C1/C5-C7, D1-D4, E1, G) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollgate.functions.patterns import DEVICE_ID_RE, FIXTURE_KEY_RE
from tollgate.operators import entitlements as E
from tollgate.operators import folds as FOLDS
from tollgate.operators.ranking import pieces_by_count
from tollgate.plans.registry import register
from tollgate.sources.views import LICENSE_AS_OF

AS_OF_SQL = "TIMESTAMP '2000-01-01 00:00:00'"
KEY_RE, DEV_RE = FIXTURE_KEY_RE, DEVICE_ID_RE
BAD_KEY = f"(key IS NULL OR coalesce(length(key) > 64, false) OR NOT coalesce(regexp_matches(key, '{KEY_RE}'), false))"
BAD_DEV = (f"(device_id IS NULL OR coalesce(length(device_id) > 64, false) "
           f"OR NOT coalesce(regexp_matches(device_id, '{DEV_RE}'), false))")
STALE_SQL = ("(l.key_id = 'pending' AND (l.last_check < {now} - INTERVAL 5 MINUTE OR "
             "(l.last_check IS NULL AND l.created_at < {now} - INTERVAL 5 MINUTE)))")
PLANS = ("vpn", "security_vpn")


# ---- B1-B3 -------------------------------------------------------------------------

@register("b1_format_violations", views=("device_requests",), oracle=f"""
SELECT request_id, key, device_id, ts, is_null, too_long, bad_key, bad_device FROM (
 SELECT *, (key IS NULL OR device_id IS NULL) AS is_null,
  coalesce(length(key) > 64 OR length(device_id) > 64, false) AS too_long,
  NOT coalesce(regexp_matches(key, '{KEY_RE}'), false) AS bad_key,
  NOT coalesce(regexp_matches(device_id, '{DEV_RE}'), false) AS bad_device
 FROM device_requests) t
WHERE is_null OR too_long OR bad_key OR bad_device""")
def b1(c):
    return E.format_violations(c.device_requests)


@register("b2_mask_pii", views=("licenses",), oracle="""
SELECT id, substr(key, 1, 5) || '****-****-****-' || right(key, 4) AS key,
 regexp_replace(email, '^(.).+@', '\\1***@') AS email FROM licenses""")
def b2(c):
    return E.mask_pii(c.licenses.select("id", "key", "email"))


@register("b3_platform", views=("device_seen",), oracle="""
SELECT event_id, user_agent, CASE WHEN contains(user_agent, 'Electron') THEN 'desktop'
 WHEN contains(user_agent, 'Android') THEN 'android' ELSE 'unknown' END AS platform FROM device_seen""")
def b3(c):
    from tollgate.functions.columns import classify_platform
    d = c.device_seen
    return d.select("event_id", "user_agent", classify_platform("user_agent").alias("platform"))


# ---- B4-B7 -------------------------------------------------------------------------

@register("b4_validation", views=("device_requests", "licenses"), headline=True, oracle=f"""
SELECT r.request_id, r.key, r.device_id, r.ts, CASE WHEN r.bad THEN NULL ELSE l.id END AS license_id,
 CASE WHEN r.bad THEN 'bad_request' WHEN l.id IS NULL THEN 'not_found'
  WHEN l.status = 'expired' THEN 'expired' WHEN l.status = 'suspended' THEN 'suspended'
  WHEN l.expires_at < {AS_OF_SQL} THEN 'expired'
  WHEN l.device_id IS NOT NULL AND l.device_id <> r.device_id THEN 'device_mismatch'
  ELSE 'valid' END AS result
FROM (SELECT *, {BAD_KEY} OR {BAD_DEV} AS bad FROM device_requests) r
LEFT JOIN licenses l ON r.key = l.key""")
def b4(c):
    return E.validation_outcome(c.device_requests, c.licenses, LICENSE_AS_OF)


_VPN_GATE = f"""CASE WHEN r.bad THEN 'bad_request' WHEN l.id IS NULL THEN 'not_found'
  WHEN l.status NOT IN ('active', 'cancelled') THEN 'inactive'
  WHEN l.expires_at < {AS_OF_SQL} THEN 'expired'
  WHEN NOT coalesce(l.plan IN ('pro'), false) THEN 'plan_not_allowed'
  WHEN l.device_id IS NULL THEN 'device_unbound'"""


@register("b5_vpn_access", views=("device_requests", "licenses"), oracle=f"""
SELECT r.request_id, r.key, r.device_id, r.ts, CASE WHEN r.bad THEN NULL ELSE l.id END AS license_id,
 {_VPN_GATE}
  WHEN r.device_id IS NULL OR r.device_id <> l.device_id THEN 'device_mismatch'
  WHEN l.key_id IS NOT NULL AND l.key_id <> 'pending' THEN 'already_provisioned'
  WHEN l.key_id = 'pending' AND NOT {STALE_SQL.format(now=AS_OF_SQL)} THEN 'in_progress'
  ELSE 'may_create' END AS result
FROM (SELECT *, {BAD_KEY} AS bad FROM device_requests) r LEFT JOIN licenses l ON r.key = l.key""")
def b5(c):
    return E.vpn_access_outcome(c.device_requests, c.licenses, LICENSE_AS_OF)


@register("b6_key_delete", views=("device_requests", "licenses"), oracle=f"""
SELECT r.request_id, r.key, r.device_id, r.ts, CASE WHEN r.bad THEN NULL ELSE l.id END AS license_id,
 {_VPN_GATE}
  WHEN l.status <> 'active' THEN 'not_active' WHEN l.key_id IS NULL THEN 'no_key'
  ELSE 'delete' END AS result
FROM (SELECT *, {BAD_KEY} AS bad FROM device_requests) r LEFT JOIN licenses l ON r.key = l.key""")
def b6(c):
    return E.key_delete_outcome(c.device_requests, c.licenses, LICENSE_AS_OF)


_TRANSFER_SQL = f"""
SELECT r.request_id, r.key, r.device_id, r.current_device_id, r.ts,
 CASE WHEN r.bad THEN NULL ELSE l.id END AS license_id,
 CASE WHEN r.bad THEN 'bad_request' WHEN l.id IS NULL THEN 'not_found'
  WHEN l.status <> 'active' THEN 'not_active'
  WHEN l.device_id IS NULL OR l.device_id <> r.current_device_id THEN 'device_mismatch'
  WHEN l.last_transfer_at IS NOT NULL AND epoch(r.ts) - epoch(l.last_transfer_at) < 259200.0 THEN 'cooldown'
  ELSE 'allowed' END AS decision,
 CASE WHEN NOT r.bad AND l.id IS NOT NULL AND l.status = 'active' AND l.device_id = r.current_device_id
   AND l.last_transfer_at IS NOT NULL AND epoch(r.ts) - epoch(l.last_transfer_at) < 259200.0
  THEN CAST(ceil((259200.0 - (epoch(r.ts) - epoch(l.last_transfer_at))) / 3600.0) AS BIGINT) END AS hours_left
FROM (SELECT *, (key IS NULL OR NOT coalesce(regexp_matches(key, '{KEY_RE}'), false)
   OR device_id IS NULL OR NOT coalesce(regexp_matches(device_id, '{DEV_RE}'), false)
   OR current_device_id IS NULL OR NOT coalesce(regexp_matches(current_device_id, '{DEV_RE}'), false)) AS bad
  FROM transfer_requests) r
LEFT JOIN transfer_licenses l ON r.key = l.key"""


@register("b7_transfer", views=("transfer_requests", "transfer_licenses"), oracle=_TRANSFER_SQL)
def b7(c):
    return E.transfer_decision(c.transfer_requests, c.transfer_licenses, as_of="ts")


# ---- B8-B13 -----------------------------------------------------------------------
# Parameter: (plan, promo price, regular price, promo end).  Own example values.
PRICES = (("vpn", 4.0, 7.0, "1997-06-01 00:00:00"),
          ("security_vpn", 9.0, 13.0, "1998-01-01 00:00:00"),
          ("trial", 1.0, None, "1996-01-01 00:00:00"))


@register("b8_price_as_of", views=("price_facts",), oracle="""
WITH dim AS (SELECT * FROM (VALUES
  ('vpn', NULL, TIMESTAMP '1997-06-01 00:00:00', 4.0), ('vpn', TIMESTAMP '1997-06-01 00:00:00', NULL, 7.0),
  ('security_vpn', NULL, TIMESTAMP '1998-01-01 00:00:00', 9.0), ('security_vpn', TIMESTAMP '1998-01-01 00:00:00', NULL, 13.0),
  ('trial', NULL, TIMESTAMP '1996-01-01 00:00:00', 1.0), ('trial', TIMESTAMP '1996-01-01 00:00:00', NULL, 1.0))
  AS t(plan, valid_from, valid_to, price))
SELECT f.o_orderkey, f.ts, f.plan, CAST(d.price AS DOUBLE) AS price FROM price_facts f LEFT JOIN dim d
 ON f.plan = d.plan AND (d.valid_from IS NULL OR f.ts >= d.valid_from) AND (d.valid_to IS NULL OR f.ts < d.valid_to)""")
def b8(c):
    return E.price_as_of(c.price_facts, E.price_dimension(c.spark, PRICES))


_PRICE_HISTORY_SQL = """
WITH changes AS (SELECT l_suppkey % 10 AS product, l_shipdate AS ts, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey, o_custkey % 10 AS product, o_orderdate AS ts, price FROM orders o ASOF LEFT JOIN changes c
 ON o.o_custkey % 10 = c.product AND o.o_orderdate >= c.ts"""


def _price_history(c, **kw):
    changes = c.lineitem.select((F.col("l_suppkey") % 10).alias("product"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("price"))
    facts = c.orders.select("o_orderkey", (F.col("o_custkey") % 10).alias("product"), F.col("o_orderdate").alias("ts"))
    return E.price_as_of_history(facts, changes, key=["product"], **kw)


@register("b8_price_history", oracle=_PRICE_HISTORY_SQL)
def b8_history(c):
    """Four times as many price changes as facts, few products."""
    return _price_history(c)


@register("b8_price_history_by_count", oracle=_PRICE_HISTORY_SQL)
def b8_history_by_count(c):
    return _price_history(c, rows_per_piece=50_000)


@register("b9_expired_with_keys", views=("licenses",), oracle=f"""
SELECT id, key_id, node_id FROM licenses WHERE expires_at < {AS_OF_SQL} AND key_id IS NOT NULL
 AND key_id <> 'pending' AND status IN ('expired', 'cancelled', 'suspended')""")
def b9(c):
    return E.expired_with_keys(c.licenses, LICENSE_AS_OF)


@register("b10_stale_claims", views=("licenses",), oracle=f"""
SELECT id, key_id, last_check, created_at FROM licenses l WHERE {STALE_SQL.format(now=AS_OF_SQL)}""")
def b10(c):
    return E.stale_claims(c.licenses, LICENSE_AS_OF).select("id", "key_id", "last_check", "created_at")


@register("b11_reset_stale", views=("licenses",), oracle=f"""
SELECT id, CASE WHEN {STALE_SQL.format(now=AS_OF_SQL)} THEN NULL ELSE key_id END AS key_id FROM licenses l""")
def b11(c):
    return E.reset_stale(c.licenses, LICENSE_AS_OF).select("id", "key_id")


@register("b12_prune_events", views=("billing_events",), oracle="""
SELECT event_id, ts, kind FROM billing_events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY""")
def b12(c):
    return E.prune(c.billing_events, "ts", "2024-01-31 00:00:00").select("event_id", "ts", "kind")


@register("b13_due_retries", views=("retry_queue",), oracle="""
SELECT id, license_id, attempts, next_retry FROM retry_queue
WHERE attempts < 3 AND next_retry <= TIMESTAMP '2024-01-15 00:00:00'""")
def b13(c):
    return E.due_retries(c.retry_queue, "2024-01-15 00:00:00").select(
        "id", "license_id", "attempts", "next_retry")


# ---- E1, C1, C5-C7 -----------------------------------------------------------------

@register("e1_latest_per_customer", views=("licenses",), oracle="""
SELECT customer_id, id, created_at FROM (SELECT *, row_number() OVER (
 PARTITION BY customer_id ORDER BY created_at DESC, id DESC) AS rn FROM licenses) t WHERE rn = 1""")
def e1(c):
    return E.latest_per(c.licenses, "customer_id").select("customer_id", "id", "created_at")


@register("c1_lookup_license", views=("sessions", "licenses"), oracle="""
WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (
   PARTITION BY customer_id ORDER BY created_at DESC, id DESC) AS rn FROM licenses) t WHERE rn = 1),
j AS (SELECT s.session_id, ls.id AS s_id, lc.id AS c_id,
   coalesce(ls.key, lc.key) AS k, coalesce(ls.email, lc.email) AS e,
   coalesce(ls.plan, lc.plan) AS plan, coalesce(ls.expires_at, lc.expires_at) AS expires_at
  FROM sessions s
  LEFT JOIN licenses ls ON coalesce(s.paid, false) AND s.subscription_id = ls.subscription_id
  LEFT JOIN latest lc ON coalesce(s.paid, false) AND ls.id IS NULL AND s.customer_id = lc.customer_id)
SELECT session_id, coalesce(s_id, c_id) AS license_id,
 CASE WHEN s_id IS NOT NULL THEN 'subscription' WHEN c_id IS NOT NULL THEN 'customer' END AS resolved_by,
 CASE WHEN s_id IS NULL AND c_id IS NULL THEN 'pending' ELSE 'resolved' END AS state,
 substr(k, 1, 5) || '****-****-****-' || right(k, 4) AS masked_key,
 regexp_replace(e, '^(.).+@', '\\1***@') AS masked_email, plan, expires_at FROM j""")
def c1(c):
    return E.lookup_license(c.sessions, c.licenses)


@register("c5_resolve_refunds", views=("refunds", "invoices", "licenses"), oracle="""
SELECT r.charge_id, r.invoice_id,
 CASE WHEN r.amount_refunded < r.amount THEN NULL ELSE i.subscription_id END AS subscription_id,
 CASE WHEN r.amount_refunded < r.amount THEN NULL ELSE l.id END AS license_id,
 CASE WHEN r.amount_refunded < r.amount THEN 'partial' WHEN i.invoice_id IS NULL THEN 'no_invoice'
  WHEN i.subscription_id IS NULL THEN 'no_subscription' WHEN l.id IS NULL THEN 'no_license'
  ELSE 'resolved' END AS reason
FROM refunds r LEFT JOIN invoices i ON r.invoice_id = i.invoice_id
LEFT JOIN licenses l ON i.subscription_id = l.subscription_id""")
def c5(c):
    return E.resolve_refunds(c.refunds, c.invoices, c.licenses)


@register("c6_late_inactive", views=("licenses", "subscriptions"), oracle="""
SELECT l.id AS license_id, l.subscription_id, s.status AS subscription_status, 'expired' AS new_status
FROM licenses l JOIN subscriptions s ON l.subscription_id = s.subscription_id
WHERE s.status NOT IN ('active', 'trialing')""")
def c6(c):
    return E.late_inactive(c.licenses, c.subscriptions)


@register("c7_new_checkouts", views=("checkouts", "licenses"), oracle="""
WITH c AS (SELECT * FROM checkouts WHERE plan IN ('vpn', 'security_vpn')),
ws AS (SELECT * FROM c WHERE subscription_id IS NOT NULL
   AND subscription_id NOT IN (SELECT subscription_id FROM licenses WHERE subscription_id IS NOT NULL)),
ws1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subscription_id ORDER BY session_id) AS rn FROM ws) t WHERE rn = 1),
cf AS (SELECT customer_id, min(session_id) AS first_sid FROM c WHERE customer_id IS NOT NULL GROUP BY customer_id),
ns AS (SELECT c.* FROM c LEFT JOIN cf ON c.customer_id = cf.customer_id
   WHERE c.subscription_id IS NULL
   AND (c.customer_id IS NULL OR c.customer_id NOT IN (SELECT customer_id FROM licenses WHERE customer_id IS NOT NULL))
   AND (cf.first_sid IS NULL OR c.session_id = cf.first_sid))
SELECT session_id, subscription_id, customer_id, plan FROM ws1
UNION ALL SELECT session_id, subscription_id, customer_id, plan FROM ns""")
def c7(c):
    return E.new_checkouts(c.checkouts, c.licenses, order=("session_id",))


# ---- G1: the state fold --------------------------------------------------------------
# The oracle folds the ordered operation list with a lambda (list_reduce): an
# independent check of the closed form used on the Spark side.
OPS_SQL = """CASE WHEN kind = 'checkout_completed' THEN 'K' WHEN kind = 'payment_succeeded' THEN 'R'
 WHEN kind = 'payment_failed' THEN 'P' WHEN kind = 'subscription_deleted' THEN 'D'
 WHEN kind = 'charge_refunded' THEN CASE WHEN amount_refunded >= amount THEN 'P' ELSE '-' END
 WHEN kind = 'subscription_updated' THEN CASE WHEN cancel_at_period_end THEN 'X' WHEN sub_status = 'active' THEN 'R'
   WHEN sub_status IN ('past_due', 'unpaid') THEN 'P' ELSE '-' END ELSE '-' END"""
STEP_SQL = """CASE
  WHEN e = 'K' THEN CASE WHEN s = 'none' THEN 'active' ELSE s END
  WHEN e = 'R' THEN CASE WHEN s = 'suspended' THEN 'active' ELSE s END
  WHEN e = 'X' THEN CASE WHEN s = 'active' THEN 'cancelled' ELSE s END
  WHEN e = 'P' THEN CASE WHEN s IN ('active', 'cancelled') THEN 'suspended' ELSE s END
  WHEN e = 'D' THEN CASE WHEN s = 'none' THEN 'none' ELSE 'expired' END
  ELSE s END"""
G1_SQL = f"""
SELECT subscription_id, status FROM (
 SELECT subscription_id, list_reduce(list_prepend('none', list(op ORDER BY ts, event_id)),
   lambda s, e: {STEP_SQL}) AS status
 FROM (SELECT *, {OPS_SQL} AS op FROM billing_events) t GROUP BY subscription_id) u
WHERE status <> 'none'"""


@register("g1_fold_states", views=("billing_events",), headline=True, oracle=G1_SQL)
def g1(c):
    return E.fold_states(c.billing_events).select("subscription_id", "status")


@register("g1_state_history", views=("billing_events",), oracle=f"""
SELECT subscription_id, event_id, status FROM (
 SELECT subscription_id, event_id, list_reduce(list_prepend('none',
   list(op) OVER (PARTITION BY subscription_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
   lambda s, e: {STEP_SQL}) AS status
 FROM (SELECT *, {OPS_SQL} AS op FROM billing_events) t) u""")
def g1h(c):
    return E.state_history(c.billing_events).select("subscription_id", "event_id", "status")


# ---- G1 for any transition table -------------------------------------------------------
_SLOT_OP_SQL = """CASE kind WHEN 'checkout_completed' THEN 'claim' WHEN 'payment_succeeded' THEN 'create'
 WHEN 'subscription_updated' THEN 'reset' ELSE 'revoke' END"""
_SLOT_STEP_SQL = """CASE WHEN e = 'claim' AND s = 'empty' THEN 'pending' WHEN e = 'create' AND s = 'pending' THEN 'held'
  WHEN e = 'reset' AND s = 'pending' THEN 'empty' WHEN e = 'revoke' THEN 'empty' ELSE s END"""


def _reduce_sql(initial: str, op: str, step: str, prefix: bool) -> str:
    """Final state, or state after every event, by list_reduce over the ordered operations."""
    over = "OVER (PARTITION BY subscription_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ops = f"list(op) {over}" if prefix else "list(op ORDER BY ts, event_id)"
    return f"""SELECT subscription_id, {'event_id, ' if prefix else ''}list_reduce(list_prepend('{initial}', {ops}), lambda s, e: {step}) AS status
 FROM (SELECT *, {op} AS op FROM billing_events) t {'' if prefix else 'GROUP BY subscription_id'}"""


@register("g1_table_licence", views=("billing_events",), oracle=_reduce_sql("none", OPS_SQL, STEP_SQL, False))
def g1_table_licence(c):
    return FOLDS.fold(E.billing_ops(c.billing_events), FOLDS.LICENCE, "subscription_id", F.col("op"))


@register("g1_table_licence_history", views=("billing_events",), oracle=_reduce_sql("none", OPS_SQL, STEP_SQL, True))
def g1_table_licence_history(c):
    """Pieces of about 20,000 events each."""
    ev = pieces_by_count(E.billing_ops(c.billing_events).select("subscription_id", "ts", "event_id", "op"), ["subscription_id"], ["ts", "event_id"], 20_000)
    return FOLDS.history(ev, FOLDS.LICENCE, "subscription_id", F.col("op"), piece=F.col("_part")).drop("ts")


@register("g1_table_slot", views=("billing_events",), oracle=_reduce_sql("empty", _SLOT_OP_SQL, _SLOT_STEP_SQL, False))
def g1_table_slot(c):
    return FOLDS.fold(c.billing_events, FOLDS.KEY_SLOT, "subscription_id", FOLDS.slot_op(F.col("kind")))


@register("g1_table_slot_history", views=("billing_events",), oracle=_reduce_sql("empty", _SLOT_OP_SQL, _SLOT_STEP_SQL, True))
def g1_table_slot_history(c):
    return FOLDS.history(c.billing_events, FOLDS.KEY_SLOT, "subscription_id", FOLDS.slot_op(F.col("kind"))).drop("ts")


# ---- G2, G3 ---------------------------------------------------------------------------
_PLATFORM_SQL = ("CASE WHEN contains(user_agent, 'Electron') THEN 'desktop' "
                 "WHEN contains(user_agent, 'Android') THEN 'android' ELSE 'unknown' END")


DEVICES_SQL = f"""
SELECT device_id, license_id, first({_PLATFORM_SQL} ORDER BY ts, event_id) AS platform,
 min(ts) AS first_seen, max(ts) AS last_seen, last(ip ORDER BY ts, event_id) AS last_ip
FROM device_seen GROUP BY device_id, license_id"""


@register("g2_upsert_devices", views=("device_seen",), oracle=DEVICES_SQL)
def g2(c):
    seen = c.device_seen
    cutoff = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    existing = E.upsert_devices(seen.filter(F.col("ts") < cutoff))
    return E.upsert_devices(seen.filter(F.col("ts") >= cutoff), existing)


@register("g3_first_claim", views=("device_seen", "licenses"), oracle="""
WITH f AS (SELECT license_id, arg_min(device_id, (ts, event_id)) AS who, min((ts, event_id)) AS k
  FROM device_seen GROUP BY license_id)
SELECT d.event_id, d.license_id, d.device_id, coalesce(l.device_id, f.who) AS holder,
 CASE WHEN l.id IS NULL THEN 'not_found'
  WHEN d.device_id = coalesce(l.device_id, f.who) THEN
    CASE WHEN l.device_id IS NULL AND (d.ts, d.event_id) = f.k THEN 'won' ELSE 'already' END
  ELSE 'conflict' END AS claim
FROM device_seen d LEFT JOIN licenses l ON d.license_id = l.id LEFT JOIN f ON d.license_id = f.license_id""")
def g3(c):
    return E.first_claim(c.device_seen, c.licenses).select(
        "event_id", "license_id", "device_id", "holder", "claim")


# ---- G4-G10 -------------------------------------------------------------------------------

@register("g4_apply_transfers", views=("transfer_requests", "transfer_licenses"), oracle=f"""
WITH d AS ({_TRANSFER_SQL}),
w AS (SELECT license_id, arg_min(device_id, (ts, request_id)) AS new_dev, min(ts) AS t
  FROM d WHERE decision = 'allowed' GROUP BY license_id)
SELECT l.id, CASE WHEN w.license_id IS NOT NULL THEN w.new_dev ELSE l.device_id END AS device_id,
 CASE WHEN w.license_id IS NOT NULL THEN NULL ELSE l.key_id END AS key_id,
 CASE WHEN w.license_id IS NOT NULL THEN NULL ELSE l.node_id END AS node_id,
 CASE WHEN w.license_id IS NOT NULL THEN w.t ELSE l.last_transfer_at END AS last_transfer_at
FROM transfer_licenses l LEFT JOIN w ON l.id = w.license_id""")
def g4(c):
    d = E.transfer_decision(c.transfer_requests, c.transfer_licenses, as_of="ts")
    return E.apply_transfers(d, c.transfer_licenses)


@register("g5_renew_expiry", views=("billing_events_ext",), oracle="""
WITH ev AS (SELECT * FROM billing_events_ext),
k AS (SELECT subscription_id, min((ts, event_id)) AS k0
  FROM ev WHERE kind = 'checkout_completed' GROUP BY subscription_id),
ren AS (SELECT ev.subscription_id, ev.ts, ev.event_id, ev.period_end FROM ev JOIN k USING (subscription_id)
  WHERE ev.kind = 'payment_succeeded' AND (ev.ts, ev.event_id) > k.k0),
lastpe AS (SELECT subscription_id, arg_max(period_end, (ts, event_id)) AS pe, max((ts, event_id)) AS pk
  FROM ren WHERE period_end IS NOT NULL GROUP BY subscription_id),
cnt AS (SELECT k.subscription_id, count(r.event_id) AS n FROM k LEFT JOIN lastpe p USING (subscription_id)
  LEFT JOIN ren r ON r.subscription_id = k.subscription_id AND r.period_end IS NULL
   AND (r.ts, r.event_id) > coalesce(p.pk, k.k0)
  GROUP BY k.subscription_id)
SELECT k.subscription_id,
 CASE WHEN cnt.n = 0 THEN coalesce(p.pe, k.k0[1] + INTERVAL 1 YEAR)
  ELSE coalesce(p.pe, k.k0[1] + INTERVAL 1 YEAR) + INTERVAL 1 YEAR + to_years(CAST(cnt.n - 1 AS INTEGER)) END AS expires_at,
 CAST(cnt.n AS INTEGER) AS plain_renewals
FROM k LEFT JOIN lastpe p USING (subscription_id) JOIN cnt USING (subscription_id)""")
def g5(c):
    return E.renew_expiry(c.billing_events_ext)


@register("g6_latest_plan", views=("billing_events_ext",), oracle="""
WITH a AS (SELECT subscription_id,
  min((ts, event_id, plan)) FILTER (WHERE kind = 'checkout_completed' AND plan IN ('vpn', 'security_vpn')) AS k0,
  max((ts, event_id, plan)) FILTER (WHERE kind = 'subscription_updated' AND plan IN ('vpn', 'security_vpn')) AS u
 FROM billing_events_ext GROUP BY subscription_id)
SELECT subscription_id,
 CASE WHEN u IS NOT NULL AND (u[1], u[2]) > (k0[1], k0[2]) THEN u[3] ELSE k0[3] END AS plan,
 coalesce(u IS NOT NULL AND (u[1], u[2]) > (k0[1], k0[2]), false) AS changed
FROM a WHERE k0 IS NOT NULL""")
def g6(c):
    return E.latest_plan(c.billing_events_ext)


_STATES_CTE = f"""st AS (SELECT 'sub_' || CAST(subscription_id AS VARCHAR) AS subscription_id, status FROM ({G1_SQL}) g)"""


def _states(c):
    s = E.fold_states(c.billing_events)
    return s.select(F.concat(F.lit("sub_"), F.col("subscription_id").cast("string"))
                    .alias("subscription_id"), "status")


@register("g7_keys_to_revoke", views=("billing_events", "licenses"), oracle=f"""
WITH {_STATES_CTE}
SELECT l.id AS license_id, l.key_id, l.node_id, st.status AS reason FROM licenses l
JOIN st ON l.subscription_id = st.subscription_id
WHERE l.key_id IS NOT NULL AND st.status IN ('suspended', 'expired')""")
def g7(c):
    return E.keys_to_revoke(_states(c), c.licenses)


@register("g8_keys_to_provision", views=("billing_events", "licenses"), oracle=f"""
WITH {_STATES_CTE}
SELECT l.id AS license_id, l.subscription_id, l.plan FROM licenses l
WHERE l.key_id IS NULL AND l.subscription_id IN (SELECT subscription_id FROM st WHERE status = 'active')""")
def g8(c):
    return E.keys_to_provision(_states(c), c.licenses)


@register("g9_clear_keys", views=("licenses",), oracle=f"""
WITH ids AS (SELECT id FROM licenses WHERE expires_at < {AS_OF_SQL} AND key_id IS NOT NULL
  AND key_id <> 'pending' AND status IN ('expired', 'cancelled', 'suspended'))
SELECT id, CASE WHEN id IN (SELECT id FROM ids) THEN NULL ELSE key_id END AS key_id,
 CASE WHEN id IN (SELECT id FROM ids) THEN NULL ELSE node_id END AS node_id FROM licenses""")
def g9(c):
    lic = c.licenses
    return E.clear_keys(lic, E.expired_with_keys(lic, LICENSE_AS_OF)).select("id", "key_id", "node_id")


@register("g10_retry_step", views=("retry_queue",), oracle="""
SELECT id, CASE WHEN coalesce(send_ok, false) THEN 'sent' WHEN attempts + 1 >= 3 THEN 'exhausted' ELSE 'retry' END AS action,
 CASE WHEN coalesce(send_ok, false) THEN attempts ELSE attempts + 1 END AS attempts,
 CASE WHEN coalesce(send_ok, false) THEN NULL ELSE TIMESTAMP '2024-01-15 00:00:00' +
   to_minutes(CAST(CASE WHEN attempts = 0 THEN 15 WHEN attempts = 1 THEN 60 ELSE 60 END AS BIGINT)) END AS next_retry
FROM retry_queue WHERE attempts < 3 AND next_retry <= TIMESTAMP '2024-01-15 00:00:00'""")
def g10(c):
    q = c.retry_queue
    return E.retry_step(q, q.select("id", "send_ok"), "2024-01-15 00:00:00")


# ---- D1-D4 -------------------------------------------------------------------------------

@register("d1_active_licenses", views=("licenses",), oracle=f"""
SELECT count(*) FILTER (WHERE status IN ('active', 'cancelled') AND expires_at > {AS_OF_SQL}) AS active_licenses FROM licenses""")
def d1(c):
    return E.licence_gauges(c.licenses, LICENSE_AS_OF).select("active_licenses")


@register("d2_active_keys", views=("licenses",), oracle="""
SELECT count(*) FILTER (WHERE key_id IS NOT NULL AND key_id <> 'pending') AS active_keys FROM licenses""")
def d2(c):
    return E.licence_gauges(c.licenses, LICENSE_AS_OF).select("active_keys")


@register("d3_stale_claim_count", views=("licenses",), oracle=f"""
SELECT count(*) FILTER (WHERE {STALE_SQL.format(now=AS_OF_SQL)}) AS stale_claims FROM licenses l""")
def d3(c):
    return E.licence_gauges(c.licenses, LICENSE_AS_OF).select("stale_claims")


@register("d4_retry_depth", views=("retry_queue",), oracle="""
SELECT count(*) FILTER (WHERE attempts < 3) AS retry_depth FROM retry_queue""")
def d4(c):
    return E.retry_depth(c.retry_queue)


# ---- E2, E6 ---------------------------------------------------------------------------------

@register("e2_devices_ranked", views=("device_seen",), oracle="""
SELECT device_id, license_id, last_seen, row_number() OVER (PARTITION BY license_id ORDER BY last_seen DESC, device_id) AS recency_rank
FROM (SELECT device_id, license_id, max(ts) AS last_seen FROM device_seen GROUP BY 1, 2) t""")
def e2(c):
    return E.devices_ranked(E.upsert_devices(c.device_seen)).select(
        "device_id", "license_id", "last_seen", "recency_rank")


TRANSFER_GAPS_SQL = """
SELECT license_id, event_id, ts, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY license_id ORDER BY ts, event_id)) AS gap_seconds,
 coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY license_id ORDER BY ts, event_id)) < 259200.0, false) AS too_soon
FROM device_seen"""


@register("e6_transfer_gaps", views=("device_seen",), oracle=TRANSFER_GAPS_SQL)
def e6(c):
    return E.transfer_gaps(c.device_seen.select("license_id", "event_id", "ts"))


@register("e6_transfer_gaps_by_count", views=("device_seen",), oracle=TRANSFER_GAPS_SQL)
def e6_by_count(c):
    return E.transfer_gaps(c.device_seen.select("license_id", "event_id", "ts"), rows_per_piece=20_000)


_VALID_PLANS = "('vpn', 'security_vpn')"
_OPS_PLAN_SQL = OPS_SQL.replace("WHEN kind = 'checkout_completed' THEN 'K'",
                                f"WHEN kind = 'checkout_completed' THEN CASE WHEN plan IN {_VALID_PLANS} THEN 'K' ELSE '-' END")


LICENCE_RECORDS_SQL = f"""
WITH st AS (SELECT subscription_id, status FROM (
   SELECT subscription_id, list_reduce(list_prepend('none', list(op ORDER BY ts, event_id)), lambda s, e: {STEP_SQL}) AS status
   FROM (SELECT *, {_OPS_PLAN_SQL} AS op FROM billing_events_ext) t GROUP BY subscription_id) u WHERE status <> 'none'),
k AS (SELECT subscription_id, min((ts, event_id)) AS k0, min(ts) AS created_at FROM billing_events_ext
  WHERE kind = 'checkout_completed' AND plan IN {_VALID_PLANS} GROUP BY subscription_id),
ren AS (SELECT ev.subscription_id, ev.ts, ev.event_id, ev.period_end FROM billing_events_ext ev JOIN k USING (subscription_id)
  WHERE ev.kind = 'payment_succeeded' AND (ev.ts, ev.event_id) > k.k0),
lastpe AS (SELECT subscription_id, arg_max(period_end, (ts, event_id)) AS pe, max((ts, event_id)) AS pk
  FROM ren WHERE period_end IS NOT NULL GROUP BY subscription_id),
cnt AS (SELECT k.subscription_id, count(r.event_id) AS n FROM k LEFT JOIN lastpe p USING (subscription_id)
  LEFT JOIN ren r ON r.subscription_id = k.subscription_id AND r.period_end IS NULL AND (r.ts, r.event_id) > coalesce(p.pk, k.k0)
  GROUP BY k.subscription_id),
ex AS (SELECT k.subscription_id, k.created_at,
  CASE WHEN cnt.n = 0 THEN coalesce(p.pe, k.k0[1] + INTERVAL 1 YEAR)
   ELSE coalesce(p.pe, k.k0[1] + INTERVAL 1 YEAR) + INTERVAL 1 YEAR + to_years(CAST(cnt.n - 1 AS INTEGER)) END AS expires_at
  FROM k LEFT JOIN lastpe p USING (subscription_id) JOIN cnt USING (subscription_id)),
pa AS (SELECT subscription_id,
  min((ts, event_id, plan)) FILTER (WHERE kind = 'checkout_completed' AND plan IN {_VALID_PLANS}) AS k0,
  max((ts, event_id, plan)) FILTER (WHERE kind = 'subscription_updated' AND plan IN {_VALID_PLANS}) AS u
  FROM billing_events_ext GROUP BY subscription_id),
pl AS (SELECT subscription_id, CASE WHEN u IS NOT NULL AND (u[1], u[2]) > (k0[1], k0[2]) THEN u[3] ELSE k0[3] END AS plan
  FROM pa WHERE k0 IS NOT NULL)
SELECT st.subscription_id, st.status, ex.created_at, ex.expires_at, pl.plan FROM st
LEFT JOIN ex USING (subscription_id) LEFT JOIN pl USING (subscription_id)"""


@register("g1_licence_records", views=("billing_events_ext",), oracle=LICENCE_RECORDS_SQL)
def g1r(c):
    return E.licence_records(c.billing_events_ext)
