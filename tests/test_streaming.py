"""Stream = batch: the streaming operators against their batch forms."""
import os

import pandas as pd
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tollgate.operators import entitlements as E
from tollgate.sources.views import Catalog
from tollgate.streaming import jobs as S


def _run(df_stream, name, mode="append", ckpt=None):
    q = (df_stream.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert q.exception() is None
    return q


def _write_parts(df, root, parts_col, n):
    """Write ``df`` as ``n`` parquet folders split on a time column, in time order."""
    lo, hi = df.agg(F.min(parts_col), F.max(parts_col)).first()
    edges = pd.date_range(lo, hi, periods=n + 1)
    for i in range(n):
        a, b = edges[i], edges[i + 1]
        cond = (F.col(parts_col) >= F.lit(a)) & ((F.col(parts_col) < F.lit(b)) if i < n - 1 else F.lit(True))
        df.filter(cond).coalesce(1).write.parquet(os.path.join(root, f"part{i:03d}"))
    return [os.path.join(root, f"part{i:03d}") for i in range(n)]


def test_h1_dedup_stream_equals_batch(spark, scratch):
    ev = Catalog(spark, SF_SMALL).billing_events
    src = os.path.join(scratch, "in")
    ev.coalesce(1).write.parquet(os.path.join(src, "a"))
    ev.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 MINUTE")).coalesce(1).write.parquet(os.path.join(src, "b"))
    stream = spark.readStream.schema(ev.schema).option("recursiveFileLookup", "true").parquet(src)
    _run(S.dedup_events(stream), "h1_out", ckpt=os.path.join(scratch, "ck"))
    got = spark.table("h1_out")
    assert got.count() == ev.select("event_id").distinct().count()
    assert got.groupBy("event_id").count().filter("count > 1").count() == 0


def test_h2_stream_states_equal_fold(spark, scratch):
    ev = Catalog(spark, SF_SMALL).billing_events
    src = os.path.join(scratch, "in")
    dirs = _write_parts(ev, src, "ts", 4)
    # a sentinel far in event time moves the watermark past every real event
    sentinel = ev.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("2030-01-01 00:00:00")
                                  .cast("timestamp_ntz").alias("ts"), *[c for c in ev.columns if c not in ("event_id", "ts")])
    sentinel = sentinel.withColumn("subscription_id", F.lit(-1).cast("long"))
    sentinel.select(*ev.columns).coalesce(1).write.parquet(os.path.join(src, "part999"))
    stream = (spark.readStream.schema(ev.schema).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", 1).parquet(src))
    _run(S.stream_states(stream, "1 hour"), "h2_out", mode="update", ckpt=os.path.join(scratch, "ck"))
    out = spark.table("h2_out").filter("subscription_id >= 0")
    final = out.groupBy("subscription_id").agg(F.max_by("status", "as_of_ms").alias("status"))
    batch = E.fold_states(ev).select("subscription_id", "status")
    diff = final.exceptAll(batch).count() + batch.exceptAll(final).count()
    assert len(dirs) == 4 and diff == 0


def _claims(spark, rows):
    return spark.createDataFrame(rows, "license_id long, ts string, event_id long, kind string") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_h6_claim_timeouts_equal_batch_under_any_split(spark, scratch):
    """A late completion resets, every expired claim resets, order of arrival does not matter."""
    import random
    rows = [(1, "2024-01-01 00:00:00", 1, "claim"), (1, "2024-01-01 00:02:00", 2, "complete"),
            (2, "2024-01-01 00:00:00", 3, "claim"), (3, "2024-01-01 00:20:00", 4, "claim"),
            (4, "2024-01-01 00:00:00", 5, "claim"), (4, "2024-01-01 00:10:00", 6, "complete"),
            (5, "2024-01-01 00:00:00", 7, "claim"), (5, "2024-01-01 00:09:00", 8, "claim"),
            (6, "2024-01-01 00:00:00", 9, "claim"), (6, "2024-01-01 00:05:00", 10, "complete")]
    r = random.Random(3)
    rows += [(10 + r.randrange(4), f"2024-01-01 00:{r.randrange(25):02d}:{r.randrange(60):02d}", 100 + i,
              r.choice(["claim", "claim", "complete"])) for i in range(150)]
    end = (99, "2024-01-01 02:00:00", 9999, "complete")
    want = sorted((x.license_id, str(x.claimed_at)) for x in S.claim_timeouts_batch(_claims(spark, rows + [end])).collect())
    assert {(2, "2024-01-01 00:00:00"), (4, "2024-01-01 00:00:00"), (5, "2024-01-01 00:00:00"), (5, "2024-01-01 00:09:00")} <= set(want)
    assert not {x for x in want if x[0] in (1, 6)}
    for seed in (1, 2):
        src = os.path.join(scratch, f"in{seed}")
        shuffled = rows[:]
        random.Random(seed).shuffle(shuffled)
        for i in range(4):
            _claims(spark, shuffled[i::4]).coalesce(1).write.parquet(os.path.join(src, f"p{i}"))
        _claims(spark, [end]).coalesce(1).write.parquet(os.path.join(src, "p9"))
        stream = (spark.readStream.schema(_claims(spark, [end]).schema).option("recursiveFileLookup", "true")
                  .option("maxFilesPerTrigger", 1).parquet(src))
        _run(S.claim_timeouts(stream, "30 minutes"), f"h6_out{seed}", mode="update", ckpt=os.path.join(scratch, f"ck{seed}"))
        got = sorted((x.license_id, str(x.claimed_at)) for x in spark.table(f"h6_out{seed}").collect())
        assert got == want


def test_h7_stream_devices_equal_batch(spark, scratch):
    seen = Catalog(spark, SF_SMALL).device_seen
    src = os.path.join(scratch, "in")
    _write_parts(seen, src, "ts", 3)
    stream = (spark.readStream.schema(seen.schema).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", 1).parquet(src))
    root = os.path.join(scratch, "devices")
    q = S.stream_devices(stream, root, os.path.join(scratch, "ck"))
    q.awaitTermination(300)
    assert len([d for d in os.listdir(root) if d.startswith("batch=")]) >= 3   # one delta per batch
    got = S.read_devices(spark, root)
    want = E.upsert_devices(seen)
    cols = list(E.DEVICE_COLS)
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert want.select(cols).exceptAll(got.select(cols)).count() == 0


def _run_to_files(df_stream, out, ckpt):
    q = (df_stream.writeStream.format("parquet").option("path", out).outputMode("append")
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert q.exception() is None


def test_h9_late_rows_are_dropped(spark, scratch):
    on_time = [(i, f"2024-01-01 00:{m:02d}:00", "/a") for i, m in enumerate([0, 1, 6, 12, 30])]
    late = [(100, "2024-01-01 00:02:00", "/a")]
    schema = "request_id long, ts string, route string"
    mk = lambda r: spark.createDataFrame(r, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    src, ck, out = (os.path.join(scratch, x) for x in ("in", "ck", "out"))
    mk(on_time).coalesce(1).write.parquet(os.path.join(src, "a"))
    read = lambda: spark.readStream.schema(mk(late).schema).option("recursiveFileLookup", "true").parquet(src)
    _run_to_files(S.log_windows(read(), "5 minutes", "5 minutes"), out, ck)
    # the late row arrives after the watermark (00:25) has closed 00:00-00:05
    mk(late).coalesce(1).write.parquet(os.path.join(src, "b"))
    _run_to_files(S.log_windows(read(), "5 minutes", "5 minutes"), out, ck)
    got = {str(r.window_start): r.requests for r in spark.read.parquet(out).collect()}
    assert got.get("2024-01-01 00:00:00") == 2
    assert got.get("2024-01-01 00:05:00") == 1


def test_h2_out_of_order_batches_within_lateness(spark, scratch):
    """Each file holds a time slice, but every third event of a slice is held
    back and delivered with the next slice (late, within the lateness bound):
    buffering until the watermark still applies events in event-time order."""
    ev = Catalog(spark, SF_SMALL).billing_events
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    edges = pd.date_range(lo, hi, periods=5)
    src = os.path.join(scratch, "in")
    held = None
    for i in range(4):
        a, b = edges[i], edges[i + 1]
        part = ev.filter((F.col("ts") >= F.lit(a)) & ((F.col("ts") < F.lit(b)) if i < 3 else F.lit(True)))
        late_now = part.filter(F.col("event_id") % 3 == 0)
        on_time = part.filter(F.col("event_id") % 3 != 0)
        out = on_time if held is None else on_time.unionByName(held)
        out.coalesce(1).write.parquet(os.path.join(src, f"part{i:03d}"))
        held = late_now
    sentinel = ev.limit(1).withColumn("event_id", F.lit(-1).cast("long")).withColumn(
        "ts", F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")).withColumn("subscription_id", F.lit(-1).cast("long"))
    held.unionByName(sentinel.select(*ev.columns)).coalesce(1).write.parquet(os.path.join(src, "part004"))
    stream = (spark.readStream.schema(ev.schema).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", 1).parquet(src))
    # a slice is ~7.5 days long: lateness must cover one slice
    q = _run(S.stream_states(stream, "10 days"), "h2_late_out", mode="update", ckpt=os.path.join(scratch, "ck"))
    data_batches = [p for p in q.recentProgress if p["numInputRows"] > 0]
    assert len(data_batches) >= 5      # one file per micro-batch
    out = spark.table("h2_late_out").filter("subscription_id >= 0")
    final = out.groupBy("subscription_id").agg(F.max_by("status", "as_of_ms").alias("status"))
    batch = E.fold_states(ev).select("subscription_id", "status")
    assert final.exceptAll(batch).count() + batch.exceptAll(final).count() == 0


def test_h2_stream_records_equal_licence_records(spark, scratch):
    ev = Catalog(spark, SF_SMALL).billing_events_ext
    src = os.path.join(scratch, "in")
    _write_parts(ev, src, "ts", 3)
    sentinel = ev.limit(1).withColumn("event_id", F.lit(-1).cast("long")).withColumn(
        "ts", F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")).withColumn("subscription_id", F.lit(-1).cast("long"))
    sentinel.select(*ev.columns).coalesce(1).write.parquet(os.path.join(src, "part999"))
    stream = (spark.readStream.schema(ev.schema).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", 1).parquet(src))
    _run(S.stream_states(stream, "1 hour", allowed_plans=("vpn", "security_vpn")), "h2_rec_out", mode="update",
         ckpt=os.path.join(scratch, "ck"))
    out = spark.table("h2_rec_out").filter("subscription_id >= 0")
    last = out.groupBy("subscription_id").agg(F.max_by(F.struct("status", "expires_at", "plan"), "as_of_ms").alias("r"))
    got = last.select("subscription_id", "r.*")
    want = E.licence_records(ev).select("subscription_id", "status", "expires_at", "plan")
    assert got.exceptAll(want).count() + want.exceptAll(got).count() == 0
