"""Edge cases of operators whose table-scale checks are the oracle queries."""
from pyspark.sql import functions as F

from tollgate.operators import capacity as C
from tollgate.operators import entitlements as E


def _ts(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def test_retention_and_retry_boundaries(spark):
    ev = _ts(spark.createDataFrame([(1, "2024-01-24 00:00:00"), (2, "2024-01-23 23:59:59")], "id long, ts string"), "ts")
    assert [r.id for r in E.prune(ev, "ts", "2024-01-31 00:00:00").collect()] == [1]   # exactly 7 days kept
    q = _ts(spark.createDataFrame([(1, 0, "2024-01-15 00:00:00"), (2, 2, "2024-01-15 00:00:01"),
                                   (3, 3, "2024-01-01 00:00:00"), (4, 1, "2024-01-14 00:00:00")],
                                  "id long, attempts int, next_retry string"), "next_retry")
    assert sorted(r.id for r in E.due_retries(q, "2024-01-15 00:00:00").collect()) == [1, 4]


def test_retry_backoff_schedule(spark):
    q = _ts(spark.createDataFrame([(1, 0, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 00:00:00"),
                                   (3, 2, "2024-01-01 00:00:00"), (4, 0, "2024-01-01 00:00:00")],
                                  "id long, attempts int, next_retry string"), "next_retry")
    res = spark.createDataFrame([(1, False), (2, False), (3, False), (4, True)], "id long, send_ok boolean")
    got = {r.id: (r.action, r.attempts, str(r.next_retry)) for r in
           E.retry_step(q, res, "2024-01-02 00:00:00").collect()}
    assert got == {1: ("retry", 1, "2024-01-02 00:15:00"), 2: ("retry", 2, "2024-01-02 01:00:00"),
                   3: ("exhausted", 3, "2024-01-02 01:00:00"), 4: ("sent", 0, "None")}


def test_endpoints_nodes_and_health(spark):
    nodes = spark.createDataFrame([(1, 1, "edge-a", "active", 10), (2, 1, "default-url", "active", 10),
                                   (3, 2, "", "active", 10), (4, 2, "edge-d", "inactive", 10)],
                                  "id long, region int, name string, status string, max_keys long")
    eps = {r.endpoint: r.source for r in C.endpoint_set(nodes, "default-url").collect()}
    assert eps == {"default-url": "default", "edge-a": "1"}
    lic = spark.createDataFrame([(10, 1), (11, 4), (12, 9), (13, None)], "id long, node_id long")
    strict = {r.id: r.endpoint for r in C.resolve_node(lic, nodes, True, "fallback").collect()}
    loose = {r.id: r.endpoint for r in C.resolve_node(lic, nodes, False, "fallback").collect()}
    assert strict == {10: "edge-a", 11: "fallback", 12: "fallback", 13: "fallback"}
    assert loose[11] == "edge-d"
    probes = spark.createDataFrame([("r1", True, 95.0), ("r1", False, 10.0), ("r2", False, 1.0), ("r3", True, 50.0)],
                                   "region string, answered boolean, disk_pct double")
    h = {r.region: (r.online, r.disk_ok, r.status) for r in C.health_rollup(probes).collect()}
    assert h == {"r1": (True, False, "degraded"), "r2": (False, True, "degraded"), "r3": (True, True, "ok")}


def test_refund_reasons_and_key_clearing(spark):
    refunds = spark.createDataFrame([(1, 100, 10.0, 10.0), (2, 100, 10.0, 4.0), (3, None, 5.0, 5.0),
                                     (4, 200, 5.0, 5.0), (5, 300, 5.0, 6.0), (6, 400, 1.0, 1.0)],
                                    "charge_id long, invoice_id long, amount double, amount_refunded double")
    invoices = spark.createDataFrame([(100, "sub_a"), (200, None), (300, "sub_x"), (400, "sub_b")],
                                     "invoice_id long, subscription_id string")
    lic = spark.createDataFrame([(7, "sub_a"), (8, "sub_b")], "id long, subscription_id string")
    got = {r.charge_id: (r.reason, r.license_id) for r in E.resolve_refunds(refunds, invoices, lic).collect()}
    assert got == {1: ("resolved", 7), 2: ("partial", None), 3: ("no_invoice", None),
                   4: ("no_subscription", None), 5: ("no_license", None), 6: ("resolved", 8)}
    lic2 = spark.createDataFrame([(1, "k1", 3), (2, "k2", 4)], "id long, key_id string, node_id long")
    ids = spark.createDataFrame([(2,), (2,), (9,)], "id long")
    cleared = {r.id: (r.key_id, r.node_id) for r in E.clear_keys(lic2, ids).collect()}
    assert cleared == {1: ("k1", 3), 2: (None, None)}
