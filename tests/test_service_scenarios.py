"""Scenarios the service's own route tests describe, run end to end through our
operators (webhook envelope -> parse -> fold / expiry; request tables -> outcomes)."""
import json

from pyspark.sql import functions as F

from tollgate.operators import entitlements as E
from tollgate.sources import readers as R


def _envelopes(spark, events):
    return spark.createDataFrame([(json.dumps(e),) for e in events], "value string")


def _checkout(eid, sub, t):
    return {"id": eid, "type": "checkout.session.completed", "created": t,
            "data": {"object": {"id": f"cs_{eid}", "subscription": sub, "customer": "cus_1",
                                "customer_details": {"email": "a@b.test"}, "metadata": {"plan": "vpn"}}}}


def _updated(eid, sub, t, cancel, status):
    return {"id": eid, "type": "customer.subscription.updated", "created": t,
            "data": {"object": {"id": sub, "cancel_at_period_end": cancel, "status": status}}}


def test_subscription_updated_mapping(spark):
    # after a checkout, each update case on its own subscription
    cases = {"s1": (True, "active", "cancelled"), "s2": (False, "active", "active"),
             "s3": (False, "past_due", "suspended"), "s4": (False, "unpaid", "suspended"),
             "s5": (False, "trialing", "active")}          # unhandled status changes nothing
    evs = []
    for i, (sub, (cancel, st, _)) in enumerate(cases.items()):
        evs += [_checkout(f"c{i}", sub, 1700000000), _updated(f"u{i}", sub, 1700000100, cancel, st)]
    parsed = R.parse_billing_events(_envelopes(spark, evs))
    got = {r.subscription_id: r.status for r in E.fold_states(parsed, allowed_plans=("vpn",)).collect()}
    assert got == {k: v[2] for k, v in cases.items()}


def test_renewal_sets_expiry_from_period_end_and_reactivates(spark):
    evs = [_checkout("c", "sub_renew", 1700000000),
           {"id": "f", "type": "invoice.payment_failed", "created": 1700000050,
            "data": {"object": {"id": "in_0", "subscription": "sub_renew"}}},
           {"id": "p", "type": "invoice.payment_succeeded", "created": 1700000100,
            "data": {"object": {"id": "in_1", "subscription": "sub_renew", "billing_reason": "subscription_cycle",
                                "lines": {"data": [{"period": {"end": 1800000000}}]}}}}]
    parsed = R.parse_billing_events(_envelopes(spark, evs))
    assert E.fold_states(parsed).first().status == "active"
    exp = E.renew_expiry(parsed).first().expires_at
    assert str(exp).startswith("2027")


def test_refund_and_deletion(spark):
    evs = [_checkout("c1", "sub_r", 1700000000),
           {"id": "r1", "type": "charge.refunded", "created": 1700000100,
            "data": {"object": {"id": "ch_1", "subscription": "sub_r", "amount": 10.0, "amount_refunded": 10.0}}},
           _checkout("c2", "sub_p", 1700000000),
           {"id": "r2", "type": "charge.refunded", "created": 1700000100,
            "data": {"object": {"id": "ch_2", "subscription": "sub_p", "amount": 10.0, "amount_refunded": 2.0}}},
           _checkout("c3", "sub_d", 1700000000),
           {"id": "d3", "type": "customer.subscription.deleted", "created": 1700000100,
            "data": {"object": {"id": "sub_d"}}}]
    parsed = R.parse_billing_events(_envelopes(spark, evs))
    got = {r.subscription_id: r.status for r in E.fold_states(parsed).collect()}
    assert got == {"sub_r": "suspended", "sub_p": "active", "sub_d": "expired"}


LIC = ("id long, key string, status string, plan string, device_id string, expires_at string, "
       "key_id string, last_check string, created_at string")


def _lic(spark, rows):
    df = spark.createDataFrame(rows, LIC)
    for c in ("expires_at", "last_check", "created_at"):
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def test_vpn_create_cases(spark):
    dev, other = "device-000000000001", "device-000000000002"
    lic = _lic(spark, [
        (1, "KEY-00000001", "active", "pro", dev, "2030-01-01 00:00:00", None, None, "2020-01-01 00:00:00"),
        (2, "KEY-00000002", "active", "pro", dev, "2030-01-01 00:00:00", "42", None, "2020-01-01 00:00:00"),
        (3, "KEY-00000003", "active", "pro", dev, "2030-01-01 00:00:00", "pending", "2024-01-01 00:00:00",
         "2020-01-01 00:00:00"),
        (4, "KEY-00000004", "active", "pro", dev, "2030-01-01 00:00:00", "pending", "2023-12-31 23:00:00",
         "2020-01-01 00:00:00"),
        (5, "KEY-00000005", "expired", "pro", dev, "2030-01-01 00:00:00", None, None, "2020-01-01 00:00:00"),
        (6, "KEY-00000006", "active", "pro", None, "2030-01-01 00:00:00", None, None, "2020-01-01 00:00:00"),
        (7, "KEY-00000007", "active", "basic", dev, "2030-01-01 00:00:00", None, None, "2020-01-01 00:00:00"),
        (8, "KEY-00000008", "cancelled", "pro", dev, "2023-01-01 00:00:00", None, None, "2020-01-01 00:00:00")])
    req = spark.createDataFrame([(i, f"KEY-{i:08d}", dev) for i in range(1, 9)] + [(9, "KEY-00000001", other)],
                                "request_id long, key string, device_id string")
    got = {r.request_id: r.result for r in E.vpn_access_outcome(req, lic, "2024-01-01 00:01:00").collect()}
    assert got == {1: "may_create", 2: "already_provisioned", 3: "in_progress", 4: "may_create",
                   5: "inactive", 6: "device_unbound", 7: "plan_not_allowed", 8: "expired",
                   9: "device_mismatch"}
    deleted = {r.request_id: r.result for r in E.key_delete_outcome(req, lic, "2024-01-01 00:01:00").collect()}
    assert deleted[2] == "delete" and deleted[1] == "no_key" and deleted[5] == "inactive"
