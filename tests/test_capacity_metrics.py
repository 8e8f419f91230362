"""Micro fixtures and properties for capacity and metric operators."""
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tollgate.operators import capacity as C
from tollgate.operators import metrics as M
from tollgate.operators.ranking import exact_percentile
from tollgate.sources.views import Catalog


def test_assignment_equals_repeated_least_loaded(spark):
    c = Catalog(spark, SF_MID)
    lic = c.licenses
    pending = lic.filter(F.col("node_id").isNull() & F.col("status").isin("active", "cancelled")).select("id")
    got = {r.license_id: r.node_id for r in C.assign_nodes(pending, c.nodes, lic).collect()}
    # plain greedy loop: each licence takes the least-loaded eligible node (ties: lower id)
    load = {r.node_id: r.active_keys for r in C.node_load(lic).collect()}
    nodes = [(r.id, r.max_keys) for r in c.nodes.filter("status = 'active' AND max_keys > 0").collect()]
    cur = {i: load.get(i, 0) for i, _ in nodes}
    cap = dict(nodes)
    want = {}
    for lid in sorted(r.id for r in pending.collect()):
        free = [(cur[i], i) for i in cur if cur[i] < cap[i]]
        if not free:
            want[lid] = None
            continue
        _, best = min(free)
        want[lid] = best
        cur[best] += 1
    assert got == want


def test_exact_percentile(spark):
    df = spark.range(0, 1009).select((F.col("id") * 7 % 1009).alias("v"))  # a permutation of 0..1008
    med = exact_percentile(df.select(F.col("v").cast("double").alias("v")), "v", 0.5).first()[0]
    p90 = exact_percentile(df.select(F.col("v").cast("double").alias("v")), "v", 0.9).first()[0]
    assert med == 504.0 and math.isclose(p90, 907.2)


def _obs(spark, vals, route="/a"):
    return spark.createDataFrame([(route, float(v)) for v in vals], "route string, d double")


def test_histogram_edges_are_inclusive_and_cumulative(spark):
    h = M.histogram(_obs(spark, [0.01, 0.05, 0.051, 5.0, 7.0]), "d", ["route"])
    rows = {r.le: r.cum_count for r in h.collect()}
    assert rows["0.01"] == 1 and rows["0.05"] == 2 and rows["0.1"] == 3 and rows["5"] == 4
    assert rows["+Inf"] == 5
    ordered = [r.cum_count for r in h.orderBy("le_value").collect()]
    assert ordered == sorted(ordered)


def test_histogram_quantile_like_promql(spark):
    vals = [0.02] * 10 + [0.3] * 10
    h = M.histogram(_obs(spark, vals), "d", ["route"])
    q = {r.q: r.value for r in M.histogram_quantile(h, ["route"], (0.25, 0.5, 0.75)).collect()}
    # rank 5 of 10 in (0.01, 0.05]; rank 10 closes that bucket; rank 15: half of (0.25, 0.5]
    assert math.isclose(q[0.25], 0.03) and math.isclose(q[0.5], 0.05) and math.isclose(q[0.75], 0.375)
    h2 = M.histogram(_obs(spark, [9.0, 9.0]), "d", ["route"])
    top = M.histogram_quantile(h2, ["route"], (0.99,)).first().value
    assert top == 5.0   # '+Inf' bucket: highest finite bound


def test_failure_runs_threshold(spark):
    st = [200, 500, 500, 500, 500, 500, 200, 500, 500, 200]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(st)], "client_id long, request_id long, status int") \
        .withColumn("ts", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, request_id)"))
    runs = M.failure_runs(df, 5).collect()
    assert len(runs) == 1 and runs[0].run_length == 5


def test_counter_rate_counts_a_reset_in_full(spark):
    rows = [("/a", f"2024-01-01 00:00:{s:02d}", v) for s, v in [(0, 10.0), (10, 15.0), (20, 3.0), (30, 5.0)]]
    df = spark.createDataFrame(rows, "route string, ts string, value double") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    r = M.counter_rate(df, ["route"], "5 minutes").first()
    assert r.increase == 5.0 + 3.0 + 2.0


def test_rate_violations_counts_per_window(spark):
    rows = [(1, f"2024-01-01 00:00:{s:02d}") for s in range(0, 40)] + [(2, "2024-01-01 00:00:01")]
    df = spark.createDataFrame(rows, "client_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    v = M.rate_violations(df, "60 seconds", 30).collect()
    assert [(r.client_id, r.requests) for r in v] == [(1, 40)]


def test_ratio_alerts(spark):
    rows = [(f"2024-01-01 00:{m:02d}:00", r) for m, r in
            [(1, "error"), (2, "success"), (3, "success"), (61 - 60, "error")]] + \
           [(f"2024-01-01 01:{m:02d}:00", "success") for m in range(4)]
    df = spark.createDataFrame(rows, "ts string, result string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = M.ratio_alerts(df, {"event_failures": (F.col("result") == "error", 0.25)}, "1 hour").collect()
    assert [(str(r.window_start), r.alert, r.value) for r in got] == [("2024-01-01 00:00:00", "event_failures", 0.5)]


def test_scale_conf_sizes_partitions():
    from tollgate.session import scale_conf
    c = scale_conf(100 * 1024 ** 4, 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 409600
    assert int(scale_conf(10, 8)["spark.sql.shuffle.partitions"]) == 16


def test_exact_percentile_with_duplicates_and_signs(spark):
    import statistics
    vals = [-5.5, -5.5, -0.001, 0.0, 0.0, 0.0, 1e-300, 3.0, 3.0, 3.0, 3.0, 7.25, 1e12]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for q in (0.0, 0.1, 0.5, 0.77, 1.0):
        got = exact_percentile(df, "x", q).first()[0]
        s = sorted(vals)
        pos = q * (len(s) - 1)
        lo, hi = math.floor(pos), math.ceil(pos)
        want = s[lo] + (s[hi] - s[lo]) * (pos - lo)
        assert math.isclose(got, want, rel_tol=1e-12, abs_tol=1e-300), (q, got, want)
    assert statistics.median(vals) == exact_percentile(df, "x", 0.5).first()[0]


def test_rank_by_id_dense_and_sparse(spark):
    from tollgate.operators.ranking import rank_by_id
    dense = spark.range(0, 5000).select((F.col("id") * 3 + 7).alias("k"))
    sparse = spark.range(0, 3000).select((F.col("id") * 3074457345618258 - 4611686018427387904).alias("k"))
    far = dense.union(spark.sql("SELECT 1000000000000000L AS k"))
    for df, bits in ((dense, 20), (sparse, 20), (far, 20), (dense, 4), (sparse, 9)):
        r = rank_by_id(df, "k", "rk", bits)
        want = df.select("k", F.row_number().over(Window.orderBy("k")).alias("rk"))  # reference only
        assert r.exceptAll(want).count() == 0 and want.exceptAll(r).count() == 0


def test_counter_samples_per_scrape_interval_with_daily_reset(spark):
    rows = [(i, ts, "/a") for i, ts in enumerate(["2024-01-01 23:59:40", "2024-01-01 23:59:44",
                                                   "2024-01-01 23:59:50", "2024-01-02 00:00:03"])]
    log = spark.createDataFrame(rows, "request_id long, ts string, route string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    got = [(str(r.ts), r.value) for r in M.counter_samples(log, ["route"]).orderBy("ts").collect()]
    # two requests in [23:59:30, 23:59:45), one more in [23:59:45, 00:00:00); the counter restarts at midnight
    assert got == [("2024-01-01 23:59:45", 2.0), ("2024-01-02 00:00:00", 3.0), ("2024-01-02 00:00:15", 1.0)]
    rate = {str(r.window_start): r.increase for r in M.counter_rate(M.counter_samples(log, ["route"]), ["route"],
                                                                     "5 minutes").collect()}
    # first sample has no predecessor; +1 before midnight; the reset counts its new value in full
    assert rate == {"2024-01-01 23:55:00": 0.0, "2024-01-02 00:00:00": 2.0}
