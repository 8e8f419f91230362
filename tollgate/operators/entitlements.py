"""Entitlements: licence validation, access decisions, lookups and the licence
state fold over billing events (SURVEY families B, C1/C5-C7, E1, G).

All operators are DataFrame -> DataFrame.  "now" is always a parameter
(``as_of``: a 'YYYY-MM-DD HH:MM:SS' string or a timestamp column).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollgate.functions import patterns as P
from tollgate.functions.columns import (classify_platform, col, days, literal_rows, mask_email,
                                        mask_key, minutes, order_key, seconds_between, ts_lit)

# ---------------------------------------------------------------------------
# B1, B2: format quality and masking
# ---------------------------------------------------------------------------


def format_violations(df: DataFrame, key_col="key", device_col="device_id",
                      key_re=P.FIXTURE_KEY_RE, device_re=P.DEVICE_ID_RE) -> DataFrame:
    """B1: rows whose key or device id is missing, too long or badly formed."""
    k, d = col(key_col), col(device_col)
    too_long = F.coalesce((F.length(k) > P.MAX_ID_LENGTH) | (F.length(d) > P.MAX_ID_LENGTH),
                          F.lit(False))
    flagged = df.select(
        "*",
        (k.isNull() | d.isNull()).alias("is_null"),
        too_long.alias("too_long"),
        (~F.coalesce(k.rlike(key_re), F.lit(False))).alias("bad_key"),
        (~F.coalesce(d.rlike(device_re), F.lit(False))).alias("bad_device"),
    )
    return flagged.filter("is_null OR too_long OR bad_key OR bad_device")


def mask_pii(df: DataFrame, key_cols=("key",), email_cols=("email",), redact_cols=(),
             url_cols=()) -> DataFrame:
    """B2: replace keys and e-mails by their masked forms (``redact_cols``: whole
    local part starred; ``url_cols``: secret path segment starred), other
    columns unchanged."""
    from tollgate.functions.columns import mask_url_secret, redact_email
    out = df
    for c in key_cols:
        out = out.withColumn(c, mask_key(c))
    for c in email_cols:
        out = out.withColumn(c, mask_email(c))
    for c in redact_cols:
        out = out.withColumn(c, redact_email(c))
    for c in url_cols:
        out = out.withColumn(c, mask_url_secret(c))
    return out


# ---------------------------------------------------------------------------
# Request outcomes against a licence snapshot
# ---------------------------------------------------------------------------

def _licence_side(licenses: DataFrame, *cols) -> DataFrame:
    return licenses.select(F.col("key").alias("_lkey"), F.col("id").alias("license_id"),
                           *[F.col(c).alias(f"_l_{c}") for c in cols])


def _bad_id(c, pattern, check_len=True):
    c = col(c)
    bad = c.isNull() | ~F.coalesce(c.rlike(pattern), F.lit(False))
    if check_len:
        bad = bad | F.coalesce(F.length(c) > P.MAX_ID_LENGTH, F.lit(False))
    return bad


def validation_outcome(requests: DataFrame, licenses: DataFrame, as_of,
                       key_re=P.FIXTURE_KEY_RE, device_re=P.DEVICE_ID_RE) -> DataFrame:
    """Outcome of each licence-validation request.

    Order: bad_request, not_found, expired (status), suspended, expired (date),
    device_mismatch, valid.  An unbound licence is valid (it binds, G3).
    """
    now = ts_lit(as_of)
    lic = _licence_side(licenses, "status", "expires_at", "device_id")
    j = requests.join(lic, F.col("key") == F.col("_lkey"), "left")
    bad = _bad_id("key", key_re) | _bad_id("device_id", device_re)
    st = F.col("_l_status")
    result = (F.when(bad, "bad_request")
              .when(F.col("license_id").isNull(), "not_found")
              .when(st == P.STATUS_EXPIRED, "expired")
              .when(st == P.STATUS_SUSPENDED, "suspended")
              .when(F.col("_l_expires_at") < now, "expired")
              .when(F.col("_l_device_id").isNotNull() & (F.col("_l_device_id") != F.col("device_id")),
                    "device_mismatch")
              .otherwise("valid"))
    keep = [c for c in requests.columns]
    return j.select(*keep, F.when(~bad, F.col("license_id")).alias("license_id"),
                    result.alias("result"))


def _stale_claim(key_id, last_check, created_at, now, ttl_minutes=P.CLAIM_TTL_MINUTES):
    limit = now - minutes(ttl_minutes)
    return ((col(key_id) == P.PENDING)
            & ((col(last_check) < limit) | (col(last_check).isNull() & (col(created_at) < limit))))


def _vpn_gate(requests, licenses, as_of, key_re, allowed_plans):
    """Shared first steps of the VPN endpoints."""
    now = ts_lit(as_of)
    lic = _licence_side(licenses, "status", "expires_at", "plan", "device_id", "key_id",
                        "last_check", "created_at")
    j = requests.join(lic, F.col("key") == F.col("_lkey"), "left")
    bad = _bad_id("key", key_re)
    st = F.col("_l_status")
    gate = (F.when(bad, "bad_request")
            .when(F.col("license_id").isNull(), "not_found")
            .when(~st.isin(*P.SEAT_STATUSES), "inactive")
            .when(F.col("_l_expires_at") < now, "expired")
            .when(~F.coalesce(F.col("_l_plan").isin(*allowed_plans), F.lit(False)), "plan_not_allowed")
            .when(F.col("_l_device_id").isNull(), "device_unbound"))
    return j, gate, now, bad


def vpn_access_outcome(requests: DataFrame, licenses: DataFrame, as_of,
                       key_re=P.FIXTURE_KEY_RE, allowed_plans=("pro",)) -> DataFrame:
    """Outcome of a request to create/get a VPN key.

    After the licence gate: device_mismatch, then already_provisioned, in_progress
    (a live pending claim), may_create (no key, or a stale claim that is reset first).
    """
    j, gate, now, bad = _vpn_gate(requests, licenses, as_of, key_re, allowed_plans)
    kid = F.col("_l_key_id")
    stale = _stale_claim("_l_key_id", "_l_last_check", "_l_created_at", now)
    result = (gate
              .when(F.col("device_id").isNull() | (F.col("device_id") != F.col("_l_device_id")),
                    "device_mismatch")
              .when(kid.isNotNull() & (kid != P.PENDING), "already_provisioned")
              .when((kid == P.PENDING) & ~stale, "in_progress")
              .otherwise("may_create"))
    return j.select(*requests.columns, F.when(~bad, F.col("license_id")).alias("license_id"),
                    result.alias("result"))


def key_delete_outcome(requests: DataFrame, licenses: DataFrame, as_of,
                       key_re=P.FIXTURE_KEY_RE, allowed_plans=("pro",)) -> DataFrame:
    """Outcome of a key-deletion request: the VPN gate, then only active
    licences may delete, and there must be a key."""
    j, gate, _, bad = _vpn_gate(requests, licenses, as_of, key_re, allowed_plans)
    result = (gate.when(F.col("_l_status") != P.STATUS_ACTIVE, "not_active")
              .when(F.col("_l_key_id").isNull(), "no_key").otherwise("delete"))
    return j.select(*requests.columns, F.when(~bad, F.col("license_id")).alias("license_id"),
                    result.alias("result"))


def transfer_decision(requests: DataFrame, licenses: DataFrame, as_of="ts",
                      cooldown_hours=P.TRANSFER_COOLDOWN_HOURS, key_re=P.FIXTURE_KEY_RE,
                      device_re=P.DEVICE_ID_RE) -> DataFrame:
    """Device-transfer decision.  ``as_of`` may name a request column.

    Order: bad_request, not_found, not_active, device_mismatch (current device must
    equal the bound one), cooldown (strictly less than the cooldown since the last
    transfer; exactly the cooldown is allowed) with hours_left rounded up, allowed.
    """
    now = col(as_of) if as_of in requests.columns else ts_lit(as_of)
    lic = _licence_side(licenses, "status", "device_id", "last_transfer_at")
    j = requests.join(lic, F.col("key") == F.col("_lkey"), "left")
    bad = (_bad_id("key", key_re, False) | _bad_id("device_id", device_re, False)
           | _bad_id("current_device_id", device_re, False))
    cooldown_s = cooldown_hours * 3600.0
    elapsed = seconds_between(now, F.col("_l_last_transfer_at"))
    in_cooldown = F.col("_l_last_transfer_at").isNotNull() & (elapsed < F.lit(cooldown_s))
    decision = (F.when(bad, "bad_request")
                .when(F.col("license_id").isNull(), "not_found")
                .when(F.col("_l_status") != P.STATUS_ACTIVE, "not_active")
                .when(F.col("_l_device_id").isNull()
                      | (F.col("_l_device_id") != F.col("current_device_id")), "device_mismatch")
                .when(in_cooldown, "cooldown").otherwise("allowed"))
    return j.select(*requests.columns, F.when(~bad, F.col("license_id")).alias("license_id"),
                    decision.alias("decision"),
                    F.when(decision == "cooldown",
                           F.ceil((F.lit(cooldown_s) - elapsed) / 3600.0)).alias("hours_left"))


# ---------------------------------------------------------------------------
# Price as of a time (range join on a bounded dimension)
# ---------------------------------------------------------------------------

def price_dimension(spark, prices) -> DataFrame:
    """Expand (plan, promo_price, regular_price, promo_end) tuples into validity
    ranges: promo strictly before promo_end, regular from then on (or promo when
    no regular price is set).  The input is a parameter list: 2 rows per plan."""
    rows = []
    for plan, promo, regular, promo_end in prices:
        if promo_end is not None:
            rows.append((plan, None, promo_end, float(promo)))
        rows.append((plan, promo_end, None, float(regular if regular is not None else promo)))
    return literal_rows(spark, rows, "plan string, valid_from string, valid_to string, price double").select(
        "plan", F.col("valid_from").cast("timestamp_ntz").alias("valid_from"),
        F.col("valid_to").cast("timestamp_ntz").alias("valid_to"), "price")


def price_as_of(facts: DataFrame, prices: DataFrame, ts_col="ts", plan_col="plan") -> DataFrame:
    """Attach the price valid at each fact's time: an equi-join on plan with the
    range test as its condition.  Spark broadcasts ``prices`` while it stays under
    its size threshold."""
    d = prices.withColumnRenamed("plan", "_plan")
    t = F.col(ts_col)
    cond = ((F.col(plan_col) == F.col("_plan"))
            & (F.col("valid_from").isNull() | (t >= F.col("valid_from")))
            & (F.col("valid_to").isNull() | (t < F.col("valid_to"))))
    return facts.join(d, cond, "left").drop("_plan", "valid_from", "valid_to")


def price_as_of_history(facts: DataFrame, changes: DataFrame, ts_col="ts", key=("plan",), price_col="price",
                        rows_per_piece: int | None = None) -> DataFrame:
    """B8 for a price history of any length: ``changes`` (key, ts, price), a price holds from its time
    on; facts before the first change get NULL.  A merge of facts and changes
    (:func:`ranking.last_before`) in pieces of a month, or of about ``rows_per_piece`` rows."""
    from tollgate.operators.ranking import last_before, time_piece
    return last_before(facts, changes, list(key), ts_col, [price_col], time_piece(ts_col, 30 * 86400), rows_per_piece)


# ---------------------------------------------------------------------------
# filters
# ---------------------------------------------------------------------------

def expired_with_keys(licenses: DataFrame, as_of) -> DataFrame:
    """Licences past expiry that still hold a key and are not active."""
    now = ts_lit(as_of)
    return (licenses.filter((F.col("expires_at") < now) & F.col("key_id").isNotNull()
                            & (F.col("key_id") != P.PENDING)
                            & F.col("status").isin(P.STATUS_EXPIRED, P.STATUS_CANCELLED,
                                                   P.STATUS_SUSPENDED))
            .select("id", "key_id", "node_id"))


def stale_claims(licenses: DataFrame, as_of, ttl_minutes=P.CLAIM_TTL_MINUTES) -> DataFrame:
    """Pending claims whose last check (or creation) is older than the TTL."""
    now = ts_lit(as_of)
    return licenses.filter(_stale_claim("key_id", "last_check", "created_at", now, ttl_minutes))


def reset_stale(licenses: DataFrame, as_of, ttl_minutes=P.CLAIM_TTL_MINUTES) -> DataFrame:
    """The licence table with stale pending claims set back to NULL."""
    now = ts_lit(as_of)
    stale = _stale_claim("key_id", "last_check", "created_at", now, ttl_minutes)
    return licenses.withColumn("key_id", F.when(stale, F.lit(None).cast("string"))
                               .otherwise(F.col("key_id")))


def prune(df: DataFrame, ts_col: str, as_of, keep_days=P.EVENT_RETENTION_DAYS) -> DataFrame:
    """Keep rows newer than ``keep_days`` before ``as_of``.  On a table
    partitioned by date this is a partition filter."""
    return df.filter(F.col(ts_col) >= ts_lit(as_of) - days(keep_days))


def due_retries(queue: DataFrame, as_of) -> DataFrame:
    """Queue rows with attempts left whose next retry time has come."""
    return queue.filter((F.col("attempts") < P.RETRY_MAX_ATTEMPTS)
                        & (F.col("next_retry") <= ts_lit(as_of)))


# ---------------------------------------------------------------------------
# Latest licence per customer, two-step lookup
# ---------------------------------------------------------------------------

def latest_per(df: DataFrame, key: str, order=("created_at", "id")) -> DataFrame:
    """The last row per key by ``order`` (descending; ties by the next column).

    ``max_by`` is an ordinary aggregate, so it combines map-side: a customer with
    a third of all rows costs one partial aggregate per task, not one huge group."""
    agg = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return agg.select("_r.*")


def lookup_license(sessions: DataFrame, licenses: DataFrame, check_session_id: bool = False) -> DataFrame:
    """Resolve each paid checkout session to a licence: by subscription first,
    then the customer's latest licence; otherwise pending.  Key and e-mail masked.
    With ``check_session_id``, malformed session ids (prefix, length) are
    ``bad_request`` before any lookup."""
    lic_cols = ["id", "key", "email", "plan", "expires_at"]
    by_sub = licenses.select(F.col("subscription_id").alias("_s_sub"),
                             *[F.col(c).alias(f"_s_{c}") for c in lic_cols])
    latest = latest_per(licenses.select("customer_id", "created_at", *lic_cols), "customer_id")
    by_cust = latest.select(F.col("customer_id").alias("_c_cust"),
                            *[F.col(c).alias(f"_c_{c}") for c in lic_cols])
    paid = F.coalesce(F.col("paid"), F.lit(False))
    j = (sessions
         .join(by_sub, paid & (F.col("subscription_id") == F.col("_s_sub")), "left")
         .join(by_cust, paid & F.col("_s_id").isNull() & (F.col("customer_id") == F.col("_c_cust")),
               "left"))
    via = F.when(F.col("_s_id").isNotNull(), "subscription").when(F.col("_c_id").isNotNull(), "customer")
    pick = {c: F.coalesce(F.col(f"_s_{c}"), F.col(f"_c_{c}")) for c in lic_cols}
    state = F.when(via.isNull(), "pending").otherwise("resolved")
    if check_session_id:
        sid = F.col("session_id").cast("string")
        ok = (sid.startswith(P.SESSION_ID_PREFIX) & (F.length(sid) >= P.SESSION_ID_MIN)
              & (F.length(sid) <= P.SESSION_ID_MAX))
        state = F.when(~F.coalesce(ok, F.lit(False)), "bad_request").otherwise(state)
    return j.select(
        "session_id", pick["id"].alias("license_id"), via.alias("resolved_by"), state.alias("state"),
        mask_key(pick["key"]).alias("masked_key"), mask_email(pick["email"]).alias("masked_email"),
        pick["plan"].alias("plan"), pick["expires_at"].alias("expires_at"))


# ---------------------------------------------------------------------------
# Refunds, late subscription state, checkout guard
# ---------------------------------------------------------------------------

def resolve_refunds(refunds: DataFrame, invoices: DataFrame, licenses: DataFrame) -> DataFrame:
    """Refund -> invoice -> subscription -> licence.  Only full refunds act;
    every refund is kept with the reason it stopped (or 'resolved')."""
    inv = invoices.select(F.col("invoice_id").alias("_inv"), F.col("subscription_id"))
    lic = licenses.select(F.col("subscription_id").alias("_lsub"), F.col("id").alias("license_id"))
    j = (refunds.join(inv, F.col("invoice_id") == F.col("_inv"), "left")
         .join(lic, F.col("subscription_id") == F.col("_lsub"), "left"))
    reason = (F.when(F.col("amount_refunded") < F.col("amount"), "partial")
              .when(F.col("_inv").isNull(), "no_invoice")
              .when(F.col("subscription_id").isNull(), "no_subscription")
              .when(F.col("license_id").isNull(), "no_license").otherwise("resolved"))
    full = reason != "partial"
    return j.select("charge_id", "invoice_id",
                    F.when(full, F.col("subscription_id")).alias("subscription_id"),
                    F.when(full, F.col("license_id")).alias("license_id"), reason.alias("reason"))


def late_inactive(licenses: DataFrame, subscriptions: DataFrame,
                  live=("active", "trialing")) -> DataFrame:
    """Licences whose subscription is already neither active nor trialing are
    marked expired."""
    s = subscriptions.select(F.col("subscription_id").alias("_sub"),
                             F.col("status").alias("subscription_status"))
    return (licenses.join(s, F.col("subscription_id") == F.col("_sub"))
            .filter(~F.col("subscription_status").isin(*live))
            .select(F.col("id").alias("license_id"), "subscription_id", "subscription_status",
                    F.lit(P.STATUS_EXPIRED).alias("new_status")))


def new_checkouts(checkouts: DataFrame, licenses: DataFrame, allowed_plans=P.CHECKOUT_PLANS,
                  order=("ts", "session_id")) -> DataFrame:
    """Checkouts that create a licence.

    Checkouts with a plan outside ``allowed_plans`` create nothing, so they are
    dropped first.  With a subscription: skipped if a licence has it, or an earlier
    checkout of the batch does.  Without one: skipped if a licence has the customer,
    or an earlier checkout of the batch has the same customer.  Per-key minima are
    aggregates, so no pairs are formed inside a hot customer or subscription."""
    okey = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    c = checkouts.filter(F.col("plan").isin(*allowed_plans)).withColumn("_k", okey)
    subs = licenses.select(F.col("subscription_id").alias("_known")).filter("_known IS NOT NULL")
    custs = licenses.select(F.col("customer_id").alias("_known")).filter("_known IS NOT NULL")
    with_sub = (c.filter(F.col("subscription_id").isNotNull())
                .join(subs, F.col("subscription_id") == F.col("_known"), "left_anti"))
    first_sub = with_sub.groupBy(F.col("subscription_id").alias("_fs")).agg(F.min("_k").alias("_fk"))
    created_sub = with_sub.join(first_sub, (F.col("subscription_id") == F.col("_fs"))
                                & (F.col("_k") == F.col("_fk")), "left_semi")
    cust_first = (c.filter(F.col("customer_id").isNotNull())
                  .groupBy(F.col("customer_id").alias("_fc")).agg(F.min("_k").alias("_first")))
    created_no_sub = (c.filter(F.col("subscription_id").isNull())
                      .join(custs, F.col("customer_id") == F.col("_known"), "left_anti")
                      .join(cust_first, F.col("customer_id") == F.col("_fc"), "left")
                      .filter(F.col("_first").isNull() | (F.col("_k") == F.col("_first")))
                      .drop("_fc", "_first"))
    return created_sub.unionByName(created_no_sub).drop("_k")


# ---------------------------------------------------------------------------
# G1: licence state fold over billing events
# ---------------------------------------------------------------------------
# Each billing event is reduced to one of five operations on the licence state:
#   K checkout (creates an active licence where none exists),
#   R renew / reactivate, X cancel at period end, P suspend, D delete.
# States: none, active, cancelled, suspended, expired (see SURVEY 2.7.1).
OPS = ("K", "R", "X", "P", "D")


def _event_order(events: DataFrame, ts="ts", eid="event_id"):
    """Order key of an event: packed DECIMAL for integral ids (hash-aggregatable),
    a (ts, id) struct otherwise (e.g. the text ids of raw webhook envelopes)."""
    integral = dict(events.dtypes).get(eid) in ("bigint", "int", "smallint", "tinyint")
    return order_key(ts, eid) if integral else F.struct(ts, eid)


def billing_ops(events: DataFrame, allowed_plans=None) -> DataFrame:
    """Classify billing events into state operations (column ``op``; NULL = no-op)."""
    kind = F.col("kind")
    first_invoice = (F.col("billing_reason") == "subscription_create"
                     if "billing_reason" in events.columns else F.lit(False))
    plan_ok = (F.coalesce(F.col("plan").isin(*allowed_plans), F.lit(False))
               if (allowed_plans and "plan" in events.columns) else F.lit(True))
    if "email" in events.columns:  # a checkout without an e-mail creates nothing
        plan_ok = plan_ok & F.col("email").isNotNull()
    full_refund = F.col("amount_refunded") >= F.col("amount")
    op = (F.when((kind == "checkout_completed") & plan_ok, "K")
          .when((kind == "payment_succeeded") & ~F.coalesce(first_invoice, F.lit(False)), "R")
          .when(kind == "payment_failed", "P")
          .when(kind == "subscription_deleted", "D")
          .when(kind == "charge_refunded", F.when(full_refund, "P"))
          .when(kind == "subscription_updated",
                F.when(F.col("cancel_at_period_end"), "X")
                .when(F.col("sub_status") == "active", "R")
                .when(F.col("sub_status").isin("past_due", "unpaid"), "P")))
    return events.withColumn("op", op)


def resolve_refund_events(events: DataFrame, invoices: DataFrame, key: str = "subscription_id") -> DataFrame:
    """Refund events name an invoice: give them the invoice's subscription (NULL when the
    invoice is missing or has none).  Other events, and refunds without an invoice, pass by."""
    names = events.columns
    linked = F.coalesce((F.col("kind") == "charge_refunded") & F.col("invoice_id").isNotNull(), F.lit(False))
    inv = invoices.groupBy(F.col("invoice_id").alias("_inv")).agg(F.max(key).alias("_sub"))
    found = (events.filter(linked).join(inv, F.col("invoice_id") == F.col("_inv"), "left")
             .withColumn(key, F.coalesce(F.col(key), F.col("_sub"))).select(names))
    return events.filter(~linked).unionByName(found)


def billing_outcomes(events: DataFrame, allowed_plans, key: str = "subscription_id") -> DataFrame:
    """What the billing handler makes of each event (one row per event id): ``result`` for the
    event counter (NULL where it counts nothing) and the audit ``action`` (NULL for none).

    An event without its object fails.  A valid checkout creates a licence (``created``) if it is the
    first of its subscription; one without a subscription creates one unless the customer
    has a licence, that is an earlier valid checkout (C7; a checkout that names neither
    always does).  Other events without a subscription are not counted; first invoices and
    partial refunds are skipped; a plan change needs an existing licence."""
    ev = billing_ops(events, allowed_plans).dropDuplicates(["event_id"]).withColumn("_k", _event_order(events))
    if "customer_id" not in ev.columns:
        ev = ev.withColumn("customer_id", F.lit(None).cast("string"))
    broken = F.coalesce(F.col("broken"), F.lit(False)) if "broken" in ev.columns else F.lit(False)
    kind, known = F.col("kind"), F.col(key).isNotNull()
    valid = F.coalesce((F.col("op") == "K") & ~broken, F.lit(False))
    changes = F.coalesce((kind == "subscription_updated") & F.col("plan").isin(*allowed_plans) & ~broken, F.lit(False))
    of_key, of_customer = F.concat(F.lit("s:"), F.col(key).cast("string")), F.concat(F.lit("c:"), F.col("customer_id").cast("string"))
    first = (ev.filter(valid).select("_k", F.explode(F.array(of_key, of_customer)).alias("_s")).filter("_s IS NOT NULL")
             .groupBy("_s").agg(F.min("_k").alias("_first")))
    # a checkout looks up its subscription or, without one, its customer; a plan change its subscription; the
    # other events, most of them, find nothing under keys of their own, which deal them evenly
    asks = F.when(known & (valid | changes), of_key).when(valid & F.col("customer_id").isNotNull(), of_customer)
    partial = F.col("amount_refunded") < F.col("amount")
    first_invoice = (F.col("billing_reason") == "subscription_create") if "billing_reason" in ev.columns else F.lit(False)
    result = (F.when(broken, "error").when(kind == "checkout_completed", F.lit(None))
              .when((kind == "payment_succeeded") & first_invoice, "skipped")
              .when((kind == "charge_refunded") & partial, "skipped").when(known, "success"))
    action = F.when(~broken, F.when((kind == "payment_failed") & known, "license_suspended")
                    .when((kind == "charge_refunded") & ~partial & known, "license_refunded"))
    ev = ev.select("event_id", "ts", "kind", key, "customer_id", "_k", valid.alias("_valid"), changes.alias("_changes"), result.alias("_result"),
                   action.alias("_action"), F.coalesce(asks, F.concat(F.lit("e:"), F.col("event_id").cast("string"))).alias("_asks"))
    ev = ev.join(first, F.col("_asks") == F.col("_s"), "left")
    created = F.col("_valid") & F.when(known, F.col("_k") == F.col("_first")).otherwise(F.col("_first").isNull() | (F.col("_k") == F.col("_first")))
    later = F.col("_changes") & F.col("_first").isNotNull() & (F.col("_k") > F.col("_first"))
    return ev.select("event_id", "ts", "kind", F.col(key), "customer_id", created.alias("created"),
                     F.when(created, "success").otherwise(F.col("_result")).alias("result"),
                     F.when(created, "license_created").when(later, "plan_changed").otherwise(F.col("_action")).alias("action"))


def billing_licences(events: DataFrame, outcomes: DataFrame | None, allowed_plans, subscriptions: DataFrame | None = None,
                     key: str = "subscription_id") -> DataFrame:
    """(entity, subscription_id, status) of every licence the events make: the fold per subscription,
    plus (given the ``outcomes``) those of checkouts without one, which no later event reaches
    (``entity`` names the customer, or the event).  A subscription that was neither active nor trialing when its
    checkout was handled gives an expired licence (C6)."""
    ev = events.filter(~F.coalesce(F.col("broken"), F.lit(False))) if "broken" in events.columns else events
    states = fold_states(ev, key, allowed_plans).select(F.concat(F.lit("subscription:"), F.col(key)).alias("entity"), key, F.col("status"))
    if subscriptions is not None:
        made = states.select(F.col("entity").alias("id"), F.col(key).cast("string").alias("subscription_id"))
        late = late_inactive(made, subscriptions).select(F.col("license_id").alias("entity"), "new_status")
        states = states.join(late, "entity", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")
    if outcomes is None:
        return states
    alone = outcomes.filter(F.col("created") & F.col(key).isNull()).select(
        F.coalesce(F.concat(F.lit("customer:"), F.col("customer_id")), F.concat(F.lit("event:"), F.col("event_id"))).alias("entity"), key,
        F.lit(P.STATUS_ACTIVE).alias("status"))
    return states.unionByName(alone)


def _state_expr(k0, d, p, x, r_after_p, x_after_r):
    """Closed form of the fold (all keys are (ts, event_id) structs):
    no checkout -> none; any delete after it -> expired; after the last suspend:
    suspended until a renewal, then active, then cancelled by a later cancel;
    with no suspend after checkout: cancelled iff a cancel came after it."""
    return (F.when(k0.isNull(), "none")
            .when(d.isNotNull() & (d > k0), P.STATUS_EXPIRED)
            .when(p.isNotNull() & (p > k0),
                  F.when(r_after_p, F.when(x_after_r, P.STATUS_CANCELLED).otherwise(P.STATUS_ACTIVE))
                  .otherwise(P.STATUS_SUSPENDED))
            .when(x.isNotNull() & (x > k0), P.STATUS_CANCELLED)
            .otherwise(P.STATUS_ACTIVE))


def fold_states(events: DataFrame, key="subscription_id", allowed_plans=None,
                keep_none=False) -> DataFrame:
    """G1: final licence state per subscription after its billing events, applied
    in (ts, event_id) order.

    Two aggregation passes instead of collecting a subscription's events: pass 1
    takes per-key first checkout / last delete / last suspend / last cancel; pass 2
    finds the first renewal after the last suspend.  Both are min/max aggregates
    over a packed order key (hash aggregation, combined map-side), so one
    subscription with a third of all events costs no more memory than any other.
    """
    ev = billing_ops(events, allowed_plans).filter(F.col("op").isNotNull() & F.col(key).isNotNull())
    ek = ev.select(key, "op", "ts", _event_order(ev).alias("_k"))

    def when_op(o, c="_k"):
        return F.when(F.col("op") == o, F.col(c))

    agg = ek.groupBy(key).agg(
        F.min(when_op("K")).alias("k0"), F.max(when_op("D")).alias("d"),
        F.max(when_op("P")).alias("p"), F.max(when_op("X")).alias("x"),
        F.min(when_op("K", "ts")).alias("created_at"), F.count(F.lit(1)).alias("n_ops"))
    # pass 2: first renewal after the last suspend (only keys with a suspend)
    renew = (ek.filter(F.col("op") == "R").select(F.col(key).alias("_rk"), "_k")
             .join(agg.filter(F.col("p").isNotNull()).select(F.col(key).alias("_pk"), "p"),
                   F.col("_rk") == F.col("_pk"))
             .filter(F.col("_k") > F.col("p"))
             .groupBy("_rk").agg(F.min("_k").alias("r1")))
    j = agg.join(renew, F.col(key) == F.col("_rk"), "left")
    r1 = F.col("r1")
    state = _state_expr(F.col("k0"), F.col("d"), F.col("p"), F.col("x"),
                        r1.isNotNull(), F.col("x").isNotNull() & (F.col("x") > r1))
    out = j.select(key, state.alias("status"), "created_at", "n_ops")
    return out if keep_none else out.filter(F.col("status") != "none")


def state_history(events: DataFrame, key="subscription_id", allowed_plans=None, piece=None) -> DataFrame:
    """G1 (history): the state after every event.

    Running extrema over the key's events in (ts, event_id) order give the same
    closed form as :func:`fold_states` at every prefix.  "Cancelled after a
    renewal that follows the last suspend" becomes: the largest "last renewal
    before this cancel" (``lrx``) over the cancels so far exceeds the last
    suspend.

    One pieced pass (see ``ranking.running_by_key``): each key is cut into time
    pieces; inside a piece the running values come from one window, and the
    combined values of the key's earlier pieces (one row per piece) are added.
    ``lrx`` needs the renewal offset of its piece, which is constant inside the
    piece, so it is combined on the small per-piece table as well."""
    from tollgate.operators.ranking import time_piece
    ev = billing_ops(events, allowed_plans).filter(F.col(key).isNotNull())
    ev = ev.withColumn("_k", _event_order(ev)).withColumn("_piece", piece if piece is not None else time_piece("ts"))
    order = ["ts", "event_id"]

    def when_op(o, c="_k"):
        return F.when(F.col("op") == o, F.col(c))
    w = Window.partitionBy(key, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    loc = ev.select("*", F.min(when_op("K")).over(w).alias("_l_k0"), F.max(when_op("D")).over(w).alias("_l_d"),
                    F.max(when_op("P")).over(w).alias("_l_p"), F.max(when_op("X")).over(w).alias("_l_x"),
                    F.max(when_op("R")).over(w).alias("_l_r"))
    # within the piece: the largest local "last renewal" seen at a cancel
    loc = loc.withColumn("_l_xr", F.max(when_op("X", "_l_r")).over(w))
    tot = ev.groupBy(key, "_piece").agg(
        F.min(when_op("K")).alias("_t_k0"), F.max(when_op("D")).alias("_t_d"), F.max(when_op("P")).alias("_t_p"),
        F.max(when_op("X")).alias("_t_x"), F.max(when_op("R")).alias("_t_r"))
    # the largest "last renewal before a cancel" of a piece, in local terms,
    # comes from the rows (a second, per-piece aggregate of the window output)
    xr = loc.groupBy(key, "_piece").agg(F.max("_l_xr").alias("_t_xr"))
    prev = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.join(xr, [key, "_piece"]).select(
        key, "_piece", "_t_x", "_t_xr", F.min("_t_k0").over(prev).alias("_o_k0"),
        F.max("_t_d").over(prev).alias("_o_d"), F.max("_t_p").over(prev).alias("_o_p"),
        F.max("_t_x").over(prev).alias("_o_x"), F.max("_t_r").over(prev).alias("_o_r"))
    # a piece's lrx in global terms: its local value raised to the renewal offset
    off = off.withColumn("_t_lrx", F.when(F.col("_t_x").isNotNull(), F.greatest("_o_r", "_t_xr")))
    off = off.withColumn("_o_lrx", F.max("_t_lrx").over(prev))
    j = loc.join(off.drop("_t_x", "_t_xr", "_t_lrx"), [key, "_piece"], "left")
    k0 = F.least("_o_k0", "_l_k0")
    d, p, x, r = (F.greatest(f"_o_{n}", f"_l_{n}") for n in ("d", "p", "x", "r"))
    lrx = F.greatest("_o_lrx", F.when(F.col("_l_x").isNotNull(), F.greatest("_o_r", "_l_xr")))
    state = _state_expr(k0, d, p, x, r.isNotNull() & (r > p), lrx.isNotNull() & (lrx > p))
    return j.select(key, "event_id", "ts", "kind", "op", state.alias("status"))


# ---------------------------------------------------------------------------
# Device upsert, first claim wins
# ---------------------------------------------------------------------------

DEVICE_COLS = ("device_id", "license_id", "platform", "first_seen", "last_seen", "last_ip")


def device_sightings(seen: DataFrame, order=("ts", "event_id")) -> DataFrame:
    """Aggregate raw sightings per (device, licence): the platform of the first
    sighting, the ip of the last one."""
    k = F.struct(*order)
    return seen.groupBy("device_id", "license_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.min_by(classify_platform("user_agent"), k).alias("platform"),
        F.max_by(F.col("ip"), k).alias("last_ip"))


def upsert_devices(seen: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Insert new (device, licence) pairs; on conflict move last_seen/last_ip
    forward and keep the first platform and first_seen."""
    new = device_sightings(seen)
    if existing is None:
        return new.select(*DEVICE_COLS)
    e = existing.select(*[F.col(c).alias(f"_e_{c}") for c in DEVICE_COLS])
    j = new.join(e, (F.col("device_id") == F.col("_e_device_id"))
                 & (F.col("license_id") == F.col("_e_license_id")), "full_outer")
    newer = F.col("last_seen").isNotNull() & (F.col("_e_last_seen").isNull()
                                              | (F.col("last_seen") >= F.col("_e_last_seen")))
    return j.select(
        F.coalesce("_e_device_id", "device_id").alias("device_id"),
        F.coalesce("_e_license_id", "license_id").alias("license_id"),
        F.coalesce("_e_platform", "platform").alias("platform"),
        F.least("_e_first_seen", "first_seen").alias("first_seen"),
        F.greatest("_e_last_seen", "last_seen").alias("last_seen"),
        F.when(newer, F.col("last_ip")).otherwise(F.col("_e_last_ip")).alias("last_ip"))


def first_claim(claims: DataFrame, current: DataFrame, target="license_id", claimant="device_id",
                current_target="id", current_holder="device_id", order=("ts", "event_id")) -> DataFrame:
    """Compare-and-set as a batch rule.  Where the slot is empty the earliest
    claim wins; every claim is labelled won / already (same holder) / conflict,
    or not_found when the target does not exist."""
    k = F.struct(*order, F.col(claimant).alias("_who"))
    first = claims.groupBy(F.col(target).alias("_t")).agg(F.min(k).alias("_first"))
    cur = current.select(F.col(current_target).alias("_ct"), F.col(current_holder).alias("_holder"))
    # one row per target, joined on an expression: both sides are exchanged, so AQE can split a hot target
    slot = first.join(cur, F.col("_t") == F.col("_ct"), "left").withColumn("_s", F.col("_t").cast("string"))
    j = claims.join(slot, F.col(target).cast("string") == F.col("_s"), "left")
    holder = F.coalesce(F.col("_holder"), F.col("_first._who"))
    is_first = F.struct(*order, F.col(claimant).alias("_who")) == F.col("_first")
    label = (F.when(F.col("_ct").isNull(), "not_found")
             .when(F.col(claimant) == holder,
                   F.when(F.col("_holder").isNull() & is_first, "won").otherwise("already"))
             .otherwise("conflict"))
    return j.select(*claims.columns, holder.alias("holder"), label.alias("claim"))


# ---------------------------------------------------------------------------
# effects
# ---------------------------------------------------------------------------

def apply_transfers(decisions: DataFrame, licenses: DataFrame, order=("ts", "request_id")) -> DataFrame:
    """For licences with an allowed transfer, the first one (by time) moves the
    licence to the new device, clears key and node, and stamps the transfer time."""
    first = (decisions.filter(F.col("decision") == "allowed")
             .groupBy(F.col("license_id").alias("_lid"))
             .agg(F.min(F.struct(*order, F.col("device_id").alias("_new"))).alias("_t")))
    j = licenses.join(first, F.col("id") == F.col("_lid"), "left")
    moved = F.col("_lid").isNotNull()
    return j.select(
        "id", F.when(moved, F.col("_t._new")).otherwise(F.col("device_id")).alias("device_id"),
        F.when(moved, F.lit(None)).otherwise(F.col("key_id")).cast("string").alias("key_id"),
        F.when(moved, F.lit(None)).otherwise(F.col("node_id")).cast("long").alias("node_id"),
        F.when(moved, F.col("_t.ts")).otherwise(F.col("last_transfer_at")).alias("last_transfer_at"))


def renew_expiry(events: DataFrame, key="subscription_id", period_end_col="period_end",
                 allowed_plans=None) -> DataFrame:
    """Expiry after renewals.  The licence starts at checkout + 1 year; a
    renewal with a period end sets it; one without adds a year to the current
    expiry (calendar year: Feb 29 + 1 year = Feb 28).

    Two aggregate passes over the packed event order: the first checkout and the
    last renewal carrying a period end, then the count of plain renewals after
    whichever of the two is later."""
    ev = billing_ops(events, allowed_plans).filter(F.col("op").isin("K", "R"))
    ev = ev.withColumn("_k", _event_order(ev))
    is_k = F.col("op") == "K"
    is_pay = (F.col("op") == "R") & (F.col("kind") == "payment_succeeded")
    with_pe = is_pay & F.col(period_end_col).isNotNull()
    a = ev.groupBy(key).agg(
        F.min(F.when(is_k, F.col("_k"))).alias("k0"), F.min(F.when(is_k, F.col("ts"))).alias("k0_ts"),
        F.max(F.when(with_pe, F.col("_k"))).alias("pl"),
        F.max_by(F.when(with_pe, F.col(period_end_col)), F.when(with_pe, F.col("_k"))).alias("pe"))
    a = a.filter(F.col("k0").isNotNull())
    after = F.col("pl").isNotNull() & (F.col("pl") > F.col("k0"))
    a = a.select(key, "k0", "k0_ts", F.when(after, F.col("pe")).alias("pe"),
                 F.when(after, F.col("pl")).otherwise(F.col("k0")).alias("_anchor"))
    plain = ev.filter(is_pay & F.col(period_end_col).isNull()).select(F.col(key).alias("_rk"), "_k")
    n = (plain.join(a.select(F.col(key).alias("_ak"), "_anchor"), F.col("_rk") == F.col("_ak"))
         .filter(F.col("_k") > F.col("_anchor")).groupBy("_rk").agg(F.count(F.lit(1)).alias("n")))
    j = a.join(n, F.col(key) == F.col("_rk"), "left")
    years = F.coalesce(F.col("n"), F.lit(0)).cast("int")
    base = F.coalesce(F.col("pe"), F.col("k0_ts") + F.make_ym_interval(F.lit(1)))
    # the first added year clamps Feb 29 once; the rest add whole years
    expiry = F.when(years == 0, base).otherwise(
        base + F.make_ym_interval(F.lit(1)) + F.make_ym_interval(years - 1))
    return j.select(key, expiry.alias("expires_at"), years.alias("plain_renewals"))


def latest_plan(events: DataFrame, key="subscription_id", allowed_plans=P.CHECKOUT_PLANS) -> DataFrame:
    """The plan in force: the checkout's plan, replaced by the latest valid
    plan of a subscription update after the checkout.  One aggregate pass; the
    plan travels as its position in ``allowed_plans`` so the buffers stay
    fixed-width (hash aggregation)."""
    plans = F.array(*[F.lit(x) for x in allowed_plans])
    idx = F.array_position(plans, F.col("plan"))
    ok = F.coalesce(idx > 0, F.lit(False))
    ev = events.withColumn("_k", _event_order(events))
    kc = (F.col("kind") == "checkout_completed") & ok
    ku = (F.col("kind") == "subscription_updated") & ok
    a = ev.groupBy(key).agg(
        F.min(F.when(kc, F.col("_k"))).alias("k0"), F.min_by(F.when(kc, idx), F.when(kc, F.col("_k"))).alias("k0_i"),
        F.max(F.when(ku, F.col("_k"))).alias("u"), F.max_by(F.when(ku, idx), F.when(ku, F.col("_k"))).alias("u_i"))
    a = a.filter(F.col("k0").isNotNull())
    later = F.coalesce(F.col("u") > F.col("k0"), F.lit(False))
    return a.select(key, F.element_at(plans, F.when(later, F.col("u_i")).otherwise(F.col("k0_i")).cast("int"))
                    .alias("plan"), later.alias("changed"))


def keys_to_revoke(states: DataFrame, licenses: DataFrame, key="subscription_id") -> DataFrame:
    """Licences still holding a key whose state is suspended or expired."""
    s = states.filter(F.col("status").isin(P.STATUS_SUSPENDED, P.STATUS_EXPIRED)).select(
        F.col(key).alias("_sub"), F.col("status").alias("reason"))
    return (licenses.filter(F.col("key_id").isNotNull())
            .join(s, F.col("subscription_id") == F.col("_sub"))
            .select(F.col("id").alias("license_id"), "key_id", "node_id", "reason"))


def keys_to_provision(states: DataFrame, licenses: DataFrame, key="subscription_id") -> DataFrame:
    """Active licences without a key (they go to node assignment, E4)."""
    s = states.filter(F.col("status") == P.STATUS_ACTIVE).select(F.col(key).alias("_sub"))
    return (licenses.filter(F.col("key_id").isNull())
            .join(s, F.col("subscription_id") == F.col("_sub"), "left_semi")
            .select(F.col("id").alias("license_id"), "subscription_id", "plan"))


def clear_keys(licenses: DataFrame, ids: DataFrame, id_col="id") -> DataFrame:
    """Key id and node set to NULL for the listed licences."""
    flag = ids.select(F.col(id_col).alias("_cid")).distinct().withColumn("_hit", F.lit(True))
    j = licenses.join(flag, F.col("id") == F.col("_cid"), "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = j.withColumn("key_id", F.when(hit, F.lit(None).cast("string")).otherwise(F.col("key_id")))
    out = out.withColumn("node_id", F.when(hit, F.lit(None).cast("long")).otherwise(F.col("node_id")))
    return out.drop("_cid", "_hit")


def retry_step(queue: DataFrame, results: DataFrame, as_of, result_col="send_ok") -> DataFrame:
    """One run of the e-mail retry job over the due rows.

    Success removes the row; failure counts an attempt and waits 15 min after
    attempt 0, 60 after attempt 1 and 60 after any later one; the row is
    exhausted when attempts reach the maximum."""
    now = ts_lit(as_of)
    due = due_retries(queue, as_of)
    r = results.select(F.col("id").alias("_rid"), F.col(result_col).alias("_ok"))
    j = due.join(r, F.col("id") == F.col("_rid"), "left")
    a = F.col("attempts")
    wait = F.when(a == 0, P.RETRY_BACKOFF_MINUTES[0]).when(a == 1, P.RETRY_BACKOFF_MINUTES[1]) \
        .otherwise(P.RETRY_BACKOFF_DEFAULT_MINUTES)
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    action = F.when(ok, "sent").when(a + 1 >= P.RETRY_MAX_ATTEMPTS, "exhausted").otherwise("retry")
    return j.select("id", action.alias("action"),
                    F.when(ok, a).otherwise(a + 1).alias("attempts"),
                    F.when(ok, F.lit(None)).otherwise(now + minutes(wait)).cast("timestamp_ntz")
                    .alias("next_retry"))


# ---------------------------------------------------------------------------
# gauges
# ---------------------------------------------------------------------------

def licence_gauges(licenses: DataFrame, as_of) -> DataFrame:
    """D1-D3 in one pass: active licences, keys in use, stale claims."""
    now = ts_lit(as_of)
    return licenses.agg(
        F.count_if(F.col("status").isin(*P.SEAT_STATUSES) & (F.col("expires_at") > now))
        .alias("active_licenses"),
        F.count_if(F.col("key_id").isNotNull() & (F.col("key_id") != P.PENDING)).alias("active_keys"),
        F.count_if(_stale_claim("key_id", "last_check", "created_at", now)).alias("stale_claims"))


def retry_depth(queue: DataFrame) -> DataFrame:
    """Rows with attempts left."""
    return queue.agg(F.count_if(F.col("attempts") < P.RETRY_MAX_ATTEMPTS).alias("retry_depth"))


# ---------------------------------------------------------------------------
# Per-licence orderings
# ---------------------------------------------------------------------------

def devices_ranked(devices: DataFrame) -> DataFrame:
    """A licence's devices, most recently seen first (rank 1), ties by device id."""
    w = Window.partitionBy("license_id").orderBy(F.col("last_seen").desc(), F.col("device_id"))
    return devices.withColumn("recency_rank", F.row_number().over(w).cast("long"))


def transfer_gaps(transfers: DataFrame, key="license_id", order=("ts", "event_id"),
                  cooldown_hours=P.TRANSFER_COOLDOWN_HOURS, rows_per_piece: int | None = None) -> DataFrame:
    """Time since the previous transfer of the same licence, flagged when it
    is under the cooldown (the first transfer has no gap).  The previous time
    comes from :func:`lag_by_key`, so one very busy licence is still spread over
    many tasks: in pieces of an hour, or of about ``rows_per_piece`` transfers."""
    from tollgate.operators.ranking import lag_by_key, pieces_by_count
    cut, piece = transfers, None
    if rows_per_piece:
        cut, piece = pieces_by_count(transfers, [key], list(order), rows_per_piece), F.col("_part")
    t = lag_by_key(cut, [key], list(order), order[0], "_prev_ts", piece)
    gap = seconds_between(F.col(order[0]), F.col("_prev_ts"))
    return t.select(*transfers.columns, gap.alias("gap_seconds"),
                    F.coalesce(gap < F.lit(cooldown_hours * 3600.0), F.lit(False)).alias("too_soon"))


def active_licenses(licenses: DataFrame, as_of) -> DataFrame:
    """Licences in force (active or cancelled, not past expiry)."""
    return licence_gauges(licenses, as_of).select("active_licenses")


def active_keys(licenses: DataFrame) -> DataFrame:
    """Keys in use (not NULL, not the pending sentinel)."""
    return licenses.agg(F.count_if(F.col("key_id").isNotNull() & (F.col("key_id") != P.PENDING))
                        .alias("active_keys"))


def stale_claim_count(licenses: DataFrame, as_of) -> DataFrame:
    """D3: pending claims past the TTL."""
    return licence_gauges(licenses, as_of).select("stale_claims")



def licence_records(events: DataFrame, key="subscription_id", allowed_plans=P.CHECKOUT_PLANS) -> DataFrame:
    """G1 + G5 + G6: the licence each subscription ends up with: status, expiry
    and plan.  A checkout creates a licence only with an allowed plan.  The three
    parts are aggregates keyed by subscription, so the joins between them reuse
    that hash partitioning instead of shuffling again."""
    st = fold_states(events, key, allowed_plans).select(key, "status", "created_at")
    ex = renew_expiry(events, key, allowed_plans=allowed_plans).select(key, "expires_at")
    pl = latest_plan(events, key, allowed_plans).select(key, "plan")
    return st.join(ex, key, "left").join(pl, key, "left")
