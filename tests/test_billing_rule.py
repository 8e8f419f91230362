"""Checkouts without a subscription, late inactive subscriptions, the idempotent audit sink, file
versions, seats without lists, and prices as of a long history."""
import random

from pyspark.sql import functions as F

from tollgate.operators import capacity as C
from tollgate.operators import entitlements as E
from tollgate.operators.ranking import last_before
from tollgate.sources import readers as R

RAW = ("event_id long, ts string, kind string, subscription_id long, customer_id string, plan string, email string, billing_reason string, "
       "amount double, amount_refunded double, cancel_at_period_end boolean, sub_status string, broken boolean")


def events(spark, rows):
    full = [(i, f"2024-01-{d:02d} 00:00:00", kind, sub, cust, plan, mail, None, 1.0, 1.0, False, "active", broken)
            for i, d, kind, sub, cust, plan, mail, broken in rows]
    return spark.createDataFrame(full, RAW).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


K = "checkout_completed"
ROWS = [
    (1, 1, K, None, "a", "vpn", "x", False),    # no subscription, new customer
    (2, 2, K, None, "a", "vpn", "x", False),    # the customer has a licence
    (3, 3, K, 7, "a", "vpn", "x", False),       # another one, by its subscription
    (4, 4, K, 7, "b", "vpn", "x", False),       # known subscription
    (5, 5, K, None, "b", "vpn", "x", False),    # b's checkout before was valid: b is looked up, its first is 4
    (6, 6, K, None, None, "vpn", "x", False),   # names neither
    (7, 7, K, None, None, "vpn", "x", False),
    (8, 8, K, None, "c", "legacy", "x", False),  # not a plan
    (9, 9, K, None, "c", "vpn", None, False),   # no e-mail
    (10, 10, K, None, "c", "vpn", "x", True),   # broken
    (11, 11, K, None, "c", "vpn", "x", False),  # so this is c's first
    (12, 12, "payment_failed", None, "a", None, "x", False),
    (13, 13, "payment_failed", 7, "a", None, "x", False),
    (14, 14, K, 8, "d", "vpn", "x", False),
]


def test_checkouts_without_subscription(spark):
    ev = events(spark, ROWS)
    done = E.billing_outcomes(ev, ("vpn",))
    got = {r.event_id: (r.created, r.result, r.action) for r in done.collect()}
    assert {i for i, r in got.items() if r[0]} == {1, 3, 6, 7, 11, 14}
    assert got[10] == (False, "error", None) and got[12][1:] == (None, None) and got[13][1:] == ("success", "license_suspended")
    assert got[2][1:] == (None, None) and got[1][1:] == ("success", "license_created")
    subs = spark.createDataFrame([("7", "active"), ("8", "past_due")], "subscription_id string, status string")
    licences = {r.entity: r.status for r in E.billing_licences(ev, done, ("vpn",), subs).collect()}
    assert licences == {"subscription:7": "suspended", "subscription:8": "expired", "customer:a": "active", "customer:c": "active",
                        "event:6": "active", "event:7": "active"}


def test_audit_batches_replace_themselves(spark, scratch):
    day = lambda d, n: R.audit_rows(spark.range(n).select(
        F.lit("license_created").alias("action"), F.lit("license").alias("entity_type"), F.col("id").alias("entity_id"), F.lit("").alias("details"),
        F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp_ntz").alias("ts")))
    sink = R.stream_audit(scratch, "q1")
    for batch, rows in ((0, day(1, 3)), (1, day(2, 4).unionByName(day(3, 1))), (1, day(2, 4)), (0, day(1, 3))):
        sink(rows, batch)
    R.append_audit(day(1, 2), scratch, "q2", 0)
    got = {(str(r.date), r.run): r["count"] for r in R.read_audit(spark, scratch).groupBy("date", "run").count().collect()}
    assert got == {("2024-01-01", "q1"): 3, ("2024-01-02", "q1"): 4, ("2024-01-01", "q2"): 2}


def test_versions_with_types_and_columns_apart(spark, scratch):
    spark.range(3).select("id").write.parquet(f"{scratch}/a")
    spark.range(3, 5).select("id", F.lit("x").alias("status"), F.lit(1).alias("other")).write.parquet(f"{scratch}/b/c")
    schema = spark.range(1).select("id", F.lit("").alias("status"), F.lit(0.0).alias("score")).schema
    got = sorted(map(tuple, R.read_versions(spark, scratch, schema).collect()))
    assert got == [(0, None, None), (1, None, None), (2, None, None), (3, "x", None), (4, "x", None)]


def test_seats_are_not_listed(spark):
    """10^15 free seats; the same choice as a greedy loop."""
    nodes = spark.createDataFrame([(1, "active", 10 ** 15), (2, "active", 5), (3, "active", 3), (4, "inactive", 99), (5, "active", 0)], "id long, status string, max_keys long")
    held = [(100 + k, n, "active") for k, n in enumerate([1] * 4 + [2] * 2 + [3] * 3)]
    licences = spark.createDataFrame(held, "id long, node_id long, status string")
    pending = spark.createDataFrame([(i,) for i in range(40)], "id long")
    got = {r.license_id: (r.node_id, r.node_load) for r in C.assign_nodes(pending, nodes, licences).collect()}
    load, want = {1: 4, 2: 2, 3: 3}, {}
    for i in range(40):
        free = [(n, k) for k, n in load.items() if n < {1: 10 ** 15, 2: 5, 3: 3}[k]]
        n, k = min(free)
        want[i] = (k, n)
        load[k] += 1
    assert got == want
    small = nodes.where("id in (2, 3)")
    got = [r.node_id for r in C.assign_nodes(pending, small, licences).orderBy("license_id").collect()]
    assert got == [2, 2, 2] + [None] * 37


def test_last_change_before_each_fact(spark):
    r = random.Random(2)
    facts = [(i, None if i % 50 == 0 else (1 if i % 4 else i % 30), r.randrange(1000)) for i in range(3000)]
    changes = [(1 if i % 3 else i % 30, r.randrange(1000), float(r.randrange(9))) for i in range(2000)]
    f = spark.createDataFrame(facts, "i long, k long, at long")
    c = spark.createDataFrame(changes, "k long, at long, price double")
    want = {}
    for i, k, at in facts:
        best = max(((a, p) for kk, a, p in changes if kk == k and a <= at), default=(None, None))
        want[i] = best[1]
    for kw in ({"piece": F.floor(F.col("at") / 64)}, {"rows_per_piece": 400}):
        got = last_before(f, c, ["k"], "at", ["price"], **kw)
        assert got.columns == ["i", "k", "at", "price"] and {x.i: x.price for x in got.where("k is not null").collect()} == {i: p for i, p in want.items() if facts[i][1] is not None}


def test_faq_structured_data_is_read_as_json(spark):
    from tollgate.operators import siteaudit as K
    q = lambda name, text="t": '{"@type": ["Question"], "name": "' + name + '", "acceptedAnswer": [{"@type": "Answer", "text": "' + text + '"}]}'
    blocks = ['{"@type": "FAQPage", "mainEntity": ' + q("A\\u00e9 \\\"x\\\"", "l1\\nl2") + "}",
              '[{"@type": ["WebPage", "FAQPage"], "mainEntity": [' + q("B") + ', {"@type": "Thing", "name": "no"}]}, {"@type": "Article", "mainEntity": ' + q("no") + "}]",
              '{"@graph": [{"@graph": [{"@type": "FAQPage", "mainEntity": [' + q(" C ") + "]}]}]}", "{broken", "7", ""]
    df = spark.createDataFrame([(blocks,)], "b array<string>").select(K.faq_structured(F.col("b")).alias("q"))
    assert [(x.name, x.text) for x in df.first().q] == [('Aé "x"', "l1\nl2"), ("B", "t"), ("C", "t")]
