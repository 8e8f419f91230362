"""The billing rule's look-ups: events that ask for nothing are dealt evenly, and the outcomes follow the rule."""
import random
from collections import Counter

from pyspark.sql import functions as F

from tests.test_billing_rule import K, events
from tollgate.operators import entitlements as E

PLANS = ("vpn",)


def plain(rows):
    """The rule by a loop over distinct rows: event id to (created, result, action)."""
    first_s, first_c, out = {}, {}, {}
    rows = sorted(set(rows), key=lambda r: (r[1], r[0]))
    valid = lambda r: r[2] == K and r[5] in PLANS and r[6] is not None and not r[7]
    for r in filter(valid, rows):
        for at, k in ((first_s, r[3]), (first_c, r[4])):
            if k is not None:
                at.setdefault(k, r[:2])
    for r in rows:
        i, d, kind, sub, cust, plan, _, broken = r
        made = valid(r) and (first_s[sub] == (i, d) if sub is not None else cust is None or first_c[cust] == (i, d))
        if broken:
            out[i] = (False, "error", None)
        elif kind == K:
            out[i] = (made, "success" if made else None, "license_created" if made else None)
        else:
            known = sub is not None
            later = kind == "subscription_updated" and plan in PLANS and sub in first_s and (d, i) > first_s[sub][::-1]
            action = {"payment_failed": "license_suspended", "charge_refunded": "license_refunded"}.get(kind) if known else None
            out[i] = (False, "success" if known else None, "plan_changed" if later else action)
    return out


def made_rows(n, seed):
    r = random.Random(seed)
    kinds = (K, K, "payment_failed", "subscription_updated", "charge_refunded", "payment_succeeded")
    rows = [(i, r.randrange(1, 29), r.choice(kinds), r.choice([None, *range(12)]), r.choice([None, *"0123456789"]),
             r.choice(["vpn", "vpn", "legacy", None]), r.choice(["x", "x", None]), r.random() < 0.1) for i in range(n)]
    return rows + rows[::7]  # some come twice


def test_outcomes_equal_a_loop(spark):
    """Subscriptions and customers have like names here; both are looked up in one join."""
    rows = made_rows(600, 5)
    got = {r.event_id: (r.created, r.result, r.action) for r in E.billing_outcomes(events(spark, rows), PLANS).collect()}
    assert got == plain(rows)


def test_events_that_look_nothing_up_are_dealt_evenly(spark):
    """Most events name no customer to look up and many no subscription: no partition may hold them all."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(keep, ("false", "-1", "8")):
            spark.conf.set(k, v)
        done = E.billing_outcomes(events(spark, made_rows(4000, 6)), PLANS)
        parts = Counter(r.part for r in done.select("result", "action", F.spark_partition_id().alias("part")).collect())
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert sum(parts.values()) == 4000 and max(parts.values()) < 1500
