"""Property tests (hypothesis): each example is one Spark job over many generated cases."""
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.test_entitlements import BILLING, EXPECTED, OP_EVENTS
from tollgate.operators import capacity as C
from tollgate.operators import entitlements as E
from tollgate.operators import metrics as M

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

op_seq = st.lists(st.tuples(st.sampled_from(sorted(OP_EVENTS)), st.integers(0, 3), st.integers(0, 5)),
                  min_size=0, max_size=30)


@SETTINGS
@given(st.lists(op_seq, min_size=1, max_size=25))
def test_fold_and_history_equal_a_plain_loop(spark, seqs):
    rows, expected, eid = [], {}, 0
    for sub, seq in enumerate(seqs, 1):
        state = "none"
        for i, (op, shape_i, minute_jitter) in enumerate(seq):
            shape = OP_EVENTS[op][shape_i % len(OP_EVENTS[op])]
            eid += 1
            # equal timestamps are common: ties are broken by event id
            ts = f"2024-01-01 {i // 60:02d}:{(i % 60) // 6 * 6 + minute_jitter % 6:02d}:00"
            rows.append((eid, ts, sub, shape[3], shape[0], shape[1], shape[2], shape[4]))
        ordered = sorted((r for r in rows if r[2] == sub), key=lambda r: (r[1], r[0]))
        for r in ordered:
            op = next(o for o, shapes in OP_EVENTS.items() for s in shapes
                      if (s[0], s[1], s[2], s[3], s[4]) == (r[4], r[5], r[6], r[3], r[7]))
            state = state if op == "-" else EXPECTED[(state, op)]
        expected[sub] = state
    if not rows:
        return
    ev = spark.createDataFrame(rows, BILLING).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.subscription_id: r.status for r in E.fold_states(ev, keep_none=True).collect()}
    assert {k: got.get(k, "none") for k in expected if any(r[2] == k for r in rows)} == \
        {k: v for k, v in expected.items() if any(r[2] == k for r in rows)}
    hist = E.state_history(ev)
    last = hist.groupBy("subscription_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("s"))
    assert all(expected[r.subscription_id] == r.s for r in last.collect())


@SETTINGS
@given(st.lists(st.floats(min_value=0, max_value=20, allow_nan=False), min_size=1, max_size=200))
def test_histogram_is_cumulative(spark, vals):
    df = spark.createDataFrame([("/r", float(v)) for v in vals], "route string, d double")
    h = sorted(M.histogram(df, "d", ["route"]).collect(), key=lambda r: r.le_value)
    counts = [r.cum_count for r in h]
    assert counts == sorted(counts) and counts[-1] == len(vals)
    for r in h:
        if not math.isinf(r.le_value):
            assert r.cum_count == sum(1 for v in vals if v <= r.le_value)


@SETTINGS
@given(st.lists(st.tuples(st.text("abcdefghijklmnop.", min_size=2, max_size=12),
                          st.text("ABCDEF0123456789", min_size=16, max_size=16)), min_size=1, max_size=30))
def test_masking_never_leaks(spark, items):
    rows = [(i, "LICS-" + "-".join(k[j:j + 4] for j in range(0, 16, 4)), f"{local}@mail.test")
            for i, (local, k) in enumerate(items)]
    df = spark.createDataFrame(rows, "id long, key string, email string")
    for (i, key, email), r in zip(rows, E.mask_pii(df).orderBy("id").collect()):
        assert r.key != key and key[5:-4] not in r.key
        assert r.email != email and r.email.endswith("@mail.test") and r.email[1:4] == "***"


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 8)), min_size=1, max_size=8),
       st.integers(1, 40))
def test_assignment_is_repeated_least_loaded(spark, node_specs, n_pending):
    nodes = [(i + 1, "active", cap, f"n{i}") for i, (load, cap) in enumerate(node_specs)]
    nd = spark.createDataFrame(nodes, "id long, status string, max_keys long, name string")
    lic_rows = [(1000 + j, i + 1, "active") for i, (load, _) in enumerate(node_specs) for j in range(load * 10, load * 10 + load)]
    lic = spark.createDataFrame(lic_rows or [(999999, None, "expired")], "id long, node_id long, status string")
    pending = spark.range(1, n_pending + 1).select(F.col("id"))
    got = {r.license_id: r.node_id for r in C.assign_nodes(pending, nd, lic).collect()}
    cur = {i + 1: load for i, (load, _) in enumerate(node_specs)}
    cap = {i + 1: c for i, (_, c) in enumerate(node_specs)}
    want = {}
    for lid in range(1, n_pending + 1):
        free = sorted((cur[i], i) for i in cur if cap[i] > 0 and cur[i] < cap[i])
        want[lid] = free[0][1] if free else None
        if free:
            cur[free[0][1]] += 1
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 5000), st.integers(-5, 5)), min_size=1, max_size=150,
                unique_by=lambda t: (t[0], t[1])))
def test_piecewise_running_values_equal_plain_windows(spark, rows):
    from pyspark.sql import Window

    from tollgate.operators.ranking import lag_by_key, running_by_key, time_piece
    df = spark.createDataFrame([(k, t, t, v) for k, t, v in rows], "k long, sec long, id long, v long") \
        .withColumn("ts", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, sec)"))
    piece = time_piece("ts", 600)     # ten-minute pieces: keys span many of them
    got = running_by_key(df, ["k"], ["ts", "id"], {"s": ("sum", F.col("v")), "mx": ("max", F.col("v")),
                                                   "mn": ("min", F.col("v"))}, piece=piece)
    got = lag_by_key(got, ["k"], ["ts", "id"], "v", "prev_v", piece=piece)
    w = Window.partitionBy("k").orderBy("ts", "id")
    wr = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "id", F.sum("v").over(wr).alias("s"), F.max("v").over(wr).alias("mx"),
                     F.min("v").over(wr).alias("mn"), F.lag("v").over(w).alias("prev_v"))
    cols = ["k", "id", "s", "mx", "mn", "prev_v"]
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert want.select(cols).exceptAll(got.select(cols)).count() == 0
