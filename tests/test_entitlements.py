"""Micro fixtures for the entitlement operators (hand-written rows)."""
import random

from pyspark.sql import functions as F

from tollgate.operators import entitlements as E

BILLING = ("event_id long, ts string, subscription_id long, amount double, kind string, "
           "cancel_at_period_end boolean, sub_status string, amount_refunded double")

# Expected transitions, written out from the state table (state, op) -> state.
EXPECTED = {
    ("none", "K"): "active", ("active", "K"): "active", ("cancelled", "K"): "cancelled",
    ("suspended", "K"): "suspended", ("expired", "K"): "expired",
    ("none", "R"): "none", ("active", "R"): "active", ("cancelled", "R"): "cancelled",
    ("suspended", "R"): "active", ("expired", "R"): "expired",
    ("none", "X"): "none", ("active", "X"): "cancelled", ("cancelled", "X"): "cancelled",
    ("suspended", "X"): "suspended", ("expired", "X"): "expired",
    ("none", "P"): "none", ("active", "P"): "suspended", ("cancelled", "P"): "suspended",
    ("suspended", "P"): "suspended", ("expired", "P"): "expired",
    ("none", "D"): "none", ("active", "D"): "expired", ("cancelled", "D"): "expired",
    ("suspended", "D"): "expired", ("expired", "D"): "expired",
}
# How to build an event for each operation (several event shapes per operation).
OP_EVENTS = {
    "K": [("checkout_completed", False, "active", 10.0, 0.0)],
    "R": [("payment_succeeded", False, "active", 10.0, 0.0), ("subscription_updated", False, "active", 0.0, 0.0)],
    "X": [("subscription_updated", True, "active", 0.0, 0.0), ("subscription_updated", True, "past_due", 0.0, 0.0)],
    "P": [("payment_failed", False, "active", 10.0, 0.0), ("subscription_updated", False, "past_due", 0.0, 0.0),
          ("subscription_updated", False, "unpaid", 0.0, 0.0), ("charge_refunded", False, "active", 10.0, 10.0)],
    "D": [("subscription_deleted", False, "active", 0.0, 0.0)],
    "-": [("charge_refunded", False, "active", 10.0, 4.0), ("subscription_updated", False, "incomplete", 0.0, 0.0)],
}
REACH = {"none": [], "active": ["K"], "cancelled": ["K", "X"], "suspended": ["K", "P"], "expired": ["K", "D"]}


def _grid_rows():
    rows, expected, sub, eid = [], {}, 0, 0
    for state, path in REACH.items():
        for op, shapes in OP_EVENTS.items():
            for shape in shapes:
                sub += 1
                for i, o in enumerate(path + [op]):
                    k, cancel, st, amt, ref = (OP_EVENTS[o][0] if i < len(path) else shape)
                    eid += 1
                    rows.append((eid, f"2024-01-01 00:{i:02d}:00", sub, amt, k, cancel, st, ref))
                want = state if op == "-" else EXPECTED[(state, op)]
                expected[sub] = want
    return rows, expected


def _events(spark, rows):
    return spark.createDataFrame(rows, BILLING).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_state_grid_every_cell(spark):
    rows, expected = _grid_rows()
    ev = _events(spark, rows)
    got = {r.subscription_id: r.status for r in E.fold_states(ev, keep_none=True).collect()}
    # subscriptions with only no-op events have no licence and no row
    assert {k: got.get(k, "none") for k in expected} == expected
    hist = E.state_history(ev)
    last = hist.groupBy("subscription_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("s"))
    assert {r.subscription_id: r.s for r in last.collect()} == expected


def test_first_invoice_is_skipped(spark):
    rows = [(1, "2024-01-01 00:00:00", 1, 10.0, "checkout_completed", False, "active", 0.0),
            (2, "2024-01-01 00:01:00", 1, 10.0, "payment_failed", False, "active", 0.0),
            (3, "2024-01-01 00:02:00", 1, 10.0, "payment_succeeded", False, "active", 0.0)]
    ev = _events(spark, rows).withColumn(
        "billing_reason", F.when(F.col("event_id") == 3, "subscription_create").otherwise("subscription_cycle"))
    assert E.fold_states(ev).first().status == "suspended"


def test_fold_ignores_order_partitioning_and_duplicates(spark):
    rows, expected = _grid_rows()
    rnd = random.Random(7)
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    ev = _events(spark, shuffled).repartition(5)
    doubled = ev.unionByName(ev)
    for df in (ev, doubled):
        got = {r.subscription_id: r.status for r in E.fold_states(df, keep_none=True).collect()}
        assert {k: got.get(k, "none") for k in expected} == expected


def test_long_random_sequences_match_a_plain_loop(spark):
    rnd = random.Random(11)
    rows, expected, eid = [], {}, 0
    for sub in range(1, 60):
        state, n = "none", rnd.randint(1, 25)
        for i in range(n):
            op = rnd.choice(list(OP_EVENTS))
            shape = rnd.choice(OP_EVENTS[op])
            eid += 1
            rows.append((eid, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00", sub, shape[3], shape[0],
                         shape[1], shape[2], shape[4]))
            state = state if op == "-" else EXPECTED[(state, op)]
        expected[sub] = state
    got = {r.subscription_id: r.status for r in E.fold_states(_events(spark, rows), keep_none=True).collect()}
    assert {k: got.get(k, "none") for k in expected} == expected
    # events are an hour apart, so with hour pieces every event is its own piece
    hist = E.state_history(_events(spark, rows))
    last = hist.groupBy("subscription_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("s"))
    assert {r.subscription_id: r.s for r in last.collect()} == expected


def test_history_matches_a_plain_loop_at_every_event(spark):
    rnd = random.Random(5)
    rows, want, eid = [], {}, 0
    for sub in range(1, 40):
        state = "none"
        for i in range(rnd.randint(1, 30)):
            op = rnd.choice(list(OP_EVENTS))
            shape = rnd.choice(OP_EVENTS[op])
            eid += 1
            rows.append((eid, f"2024-01-{1 + i // 12:02d} {(i % 12) * 2:02d}:{rnd.randint(0, 59):02d}:00", sub,
                         shape[3], shape[0], shape[1], shape[2], shape[4]))
            state = state if op == "-" else EXPECTED[(state, op)]
            want[eid] = state
    got = {r.event_id: r.status for r in E.state_history(_events(spark, rows)).collect()}
    assert got == want


LIC = ("id long, key string, status string, device_id string, last_transfer_at string, expires_at string, "
       "plan string, key_id string, last_check string, created_at string")


def _lic(spark, rows):
    df = spark.createDataFrame(rows, LIC)
    for c in ("last_transfer_at", "expires_at", "last_check", "created_at"):
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def test_transfer_72h_boundary(spark):
    dev_a, dev_b = "device-aaaaaaaaaaaa", "device-bbbbbbbbbbbb"
    lic = _lic(spark, [
        (1, "KEY-00000001", "active", dev_a, "2024-01-01 00:00:00", None, "pro", None, None, None),
        (2, "KEY-00000002", "active", dev_a, "2024-01-01 00:01:00", None, "pro", None, None, None),
        (3, "KEY-00000003", "active", dev_a, None, None, "pro", None, None, None),
        (4, "KEY-00000004", "suspended", dev_a, None, None, "pro", None, None, None)])
    req = spark.createDataFrame([
        (1, "KEY-00000001", dev_b, dev_a, "2024-01-04 00:00:00"),   # exactly 72 h: allowed
        (2, "KEY-00000002", dev_b, dev_a, "2024-01-04 00:00:00"),   # 71 h 59 m: cooldown, 1 h left
        (3, "KEY-00000003", dev_b, dev_a, "2024-01-04 00:00:00"),   # never transferred
        (4, "KEY-00000003", dev_b, dev_b, "2024-01-04 00:00:00"),   # wrong current device
        (5, "KEY-00000004", dev_b, dev_a, "2024-01-04 00:00:00"),   # not active
        (6, "KEY-00000009", dev_b, dev_a, "2024-01-04 00:00:00"),   # unknown
        (7, "bad", dev_b, dev_a, "2024-01-04 00:00:00")],
        "request_id long, key string, device_id string, current_device_id string, ts string") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.request_id: (r.decision, r.hours_left) for r in E.transfer_decision(req, lic).collect()}
    assert got == {1: ("allowed", None), 2: ("cooldown", 1), 3: ("allowed", None), 4: ("device_mismatch", None),
                   5: ("not_active", None), 6: ("not_found", None), 7: ("bad_request", None)}
    lic = lic.withColumn("node_id", F.lit(3).cast("long"))
    moved = {r.id: r for r in E.apply_transfers(E.transfer_decision(req, lic), lic).collect()}
    assert moved[1].device_id == dev_b and moved[1].key_id is None and moved[1].node_id is None
    assert moved[2].device_id == dev_a


def test_validation_outcomes_and_order(spark):
    d1, d2 = "device-111111111111", "device-222222222222"
    lic = _lic(spark, [
        (1, "KEY-00000001", "active", d1, None, "2001-01-01 00:00:00", "pro", None, None, None),
        (2, "KEY-00000002", "expired", d2, None, "2001-01-01 00:00:00", "pro", None, None, None),
        (3, "KEY-00000003", "suspended", d2, None, "2001-01-01 00:00:00", "pro", None, None, None),
        (4, "KEY-00000004", "active", d1, None, "1999-01-01 00:00:00", "pro", None, None, None),
        (5, "KEY-00000005", "active", None, None, "2001-01-01 00:00:00", "pro", None, None, None)])
    req = spark.createDataFrame([
        (1, "KEY-00000001", d1), (2, "KEY-00000001", d2), (3, "KEY-00000002", d1), (4, "KEY-00000003", d1),
        (5, "KEY-00000004", d2), (6, "KEY-00000005", d2), (7, "KEY-00000009", d1), (8, "KEY-00000001", "short"),
        (9, None, d1), (10, "KEY-00000001", "x" * 65)], "request_id long, key string, device_id string")
    got = {r.request_id: r.result for r in E.validation_outcome(req, lic, "2000-01-01 00:00:00").collect()}
    assert got == {1: "valid", 2: "device_mismatch", 3: "expired", 4: "suspended", 5: "expired",
                   6: "valid", 7: "not_found", 8: "bad_request", 9: "bad_request", 10: "bad_request"}


def test_stale_claims(spark):
    now = "2024-01-01 01:00:00"
    lic = _lic(spark, [
        (1, "K1", "active", None, None, None, "pro", "pending", None, "2024-01-01 00:00:00"),   # never checked, old
        (2, "K2", "active", None, None, None, "pro", "pending", None, "2024-01-01 00:58:00"),   # never checked, new
        (3, "K3", "active", None, None, None, "pro", "pending", "2024-01-01 00:50:00", "2024-01-01 00:00:00"),
        (4, "K4", "active", None, None, None, "pro", "pending", "2024-01-01 00:56:00", "2024-01-01 00:00:00"),
        (5, "K5", "active", None, None, None, "pro", "77", "2024-01-01 00:00:00", "2024-01-01 00:00:00")])
    assert sorted(r.id for r in E.stale_claims(lic, now).collect()) == [1, 3]
    reset = {r.id: r.key_id for r in E.reset_stale(lic, now).collect()}
    assert reset == {1: None, 2: "pending", 3: None, 4: "pending", 5: "77"}


def test_device_upsert_keeps_first_platform(spark):
    seen = spark.createDataFrame([
        ("dev-1", 1, "2024-01-01 00:00:00", 1, "Electron/1", "10.0.0.1"),
        ("dev-1", 1, "2024-01-02 00:00:00", 2, "okhttp Android", "10.0.0.2"),
        ("dev-1", 1, "2024-01-02 00:00:00", 3, "curl", "10.0.0.3")],
        "device_id string, license_id long, ts string, event_id long, user_agent string, ip string") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    r = E.upsert_devices(seen).first()
    assert (r.platform, r.last_ip) == ("desktop", "10.0.0.3")
    early, late = seen.filter("event_id = 1"), seen.filter("event_id > 1")
    r2 = E.upsert_devices(late, E.upsert_devices(early)).first()
    assert (r2.platform, r2.last_ip, str(r2.first_seen)) == ("desktop", "10.0.0.3", "2024-01-01 00:00:00")


def test_first_claim_labels(spark):
    cur = spark.createDataFrame([(1, None), (2, "dev-x")], "id long, device_id string")
    claims = spark.createDataFrame([
        (1, "dev-a", "2024-01-01 00:00:00", 1), (1, "dev-b", "2024-01-01 00:00:00", 2),
        (1, "dev-a", "2024-01-02 00:00:00", 3), (2, "dev-x", "2024-01-01 00:00:00", 4),
        (2, "dev-y", "2024-01-01 00:00:00", 5), (3, "dev-z", "2024-01-01 00:00:00", 6)],
        "license_id long, device_id string, ts string, event_id long").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.event_id: r.claim for r in E.first_claim(claims, cur).collect()}
    assert got == {1: "won", 2: "conflict", 3: "already", 4: "already", 5: "conflict", 6: "not_found"}


def test_masked_output_holds_no_full_secret(spark):
    lic = spark.createDataFrame([(1, "LICS-ABCD-EF01-2345-6789", "someone@example.org")],
                                "id long, key string, email string")
    r = E.mask_pii(lic).first()
    assert r.key == "LICS-****-****-****-6789" and r.email == "s***@example.org"
    assert "ABCD" not in r.key and "someone" not in r.email


def test_expiry_renewal(spark):
    rows = [(1, "2024-02-29 10:00:00", 1, 1.0, "checkout_completed", False, "active", 0.0, None),
            (2, "2024-03-01 10:00:00", 1, 1.0, "payment_succeeded", False, "active", 0.0, None),
            (3, "2024-03-02 10:00:00", 2, 1.0, "checkout_completed", False, "active", 0.0, None),
            (4, "2024-03-03 10:00:00", 2, 1.0, "payment_succeeded", False, "active", 0.0, "2024-04-03 10:00:00"),
            (5, "2024-03-04 10:00:00", 2, 1.0, "payment_succeeded", False, "active", 0.0, None)]
    ev = spark.createDataFrame(rows, BILLING + ", period_end string")
    ev = ev.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn(
        "period_end", F.col("period_end").cast("timestamp_ntz"))
    got = {r.subscription_id: str(r.expires_at) for r in E.renew_expiry(ev).collect()}
    # Feb 29 + 1 year = Feb 28 (calendar clamp), then + 1 year
    assert got == {1: "2026-02-28 10:00:00", 2: "2025-04-03 10:00:00"}


def test_checkout_needs_email_and_allowed_plan(spark):
    rows = [(1, "2024-01-01 00:00:00", 1, 1.0, "checkout_completed", False, "active", 0.0, None, "vpn"),
            (2, "2024-01-01 00:00:00", 2, 1.0, "checkout_completed", False, "active", 0.0, "a@b.c", "gold"),
            (3, "2024-01-01 00:00:00", 3, 1.0, "checkout_completed", False, "active", 0.0, "a@b.c", "vpn")]
    ev = spark.createDataFrame(rows, BILLING + ", email string, plan string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.subscription_id: r.status for r in E.fold_states(ev, allowed_plans=("vpn", "security_vpn")).collect()}
    assert got == {3: "active"}


def test_lookup_rejects_malformed_session_ids(spark):
    lic = spark.createDataFrame([(1, "KEY-00000001", "a@b.test", "pro", 7, "sub_1", "2024-01-01 00:00:00",
                                  "2025-01-01 00:00:00")],
                                "id long, key string, email string, plan string, customer_id long, subscription_id string, "
                                "created_at string, expires_at string")
    lic = lic.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).withColumn(
        "expires_at", F.col("expires_at").cast("timestamp_ntz"))
    ses = spark.createDataFrame([("cs_" + "a" * 20, "sub_1", 7, True), ("cs_short", "sub_1", 7, True),
                                 ("xx_" + "a" * 20, "sub_1", 7, True)],
                                "session_id string, subscription_id string, customer_id long, paid boolean")
    got = {r.session_id: r.state for r in E.lookup_license(ses, lic, check_session_id=True).collect()}
    assert got == {"cs_" + "a" * 20: "resolved", "cs_short": "bad_request", "xx_" + "a" * 20: "bad_request"}
