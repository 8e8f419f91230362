"""Folds by any transition table, and pieces of equal counts, on a hot key and at random."""
import random

import pytest
from pyspark.sql import functions as F

from tollgate.operators import entitlements as E
from tollgate.operators import folds as G
from tollgate.operators import metrics as M
from tollgate.operators.ranking import lag_by_key, pieces_by_count, running_by_key


def hot(spark, n=30_000):
    """90 % of the rows on one key, within one hour."""
    return (spark.range(n).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 10 == 0, F.col("id") % 50).otherwise(-1).alias("k"),
        F.expr("timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(0, 0, 0, cast(pmod(xxhash64(id), 3000000) as decimal(18,6)) / 1000)").alias("ts"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(7)).alias("v")))


def test_pieces_hold_about_equal_counts(spark):
    cut = pieces_by_count(hot(spark), ["k"], ["ts", "event_id"], 1000)
    sizes = [r["count"] for r in cut.groupBy("_part").count().collect()]
    assert len(sizes) >= 25 and max(sizes) <= 3000 and sum(sizes) == 30_000
    ends = cut.groupBy("_part").agg(F.min(F.struct("k", "ts", "event_id")).alias("a"), F.max(F.struct("k", "ts", "event_id")).alias("b")).orderBy("_part").collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:]))
    assert cut.where("k = -1").select("_part").distinct().count() >= 20


def test_running_values_and_lag_over_count_pieces(spark):
    df = hot(spark, 6000)
    cut = pieces_by_count(df, ["k"], ["ts", "event_id"], 200)
    values = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "lo": ("min", F.col("event_id"))}
    got = lag_by_key(running_by_key(cut, ["k"], ["ts", "event_id"], values, F.col("_part")), ["k"], ["ts", "event_id"], "v", "p", F.col("_part"))
    rows, want, state = sorted(map(tuple, df.select("k", "ts", "event_id", "v").collect())), [], {}
    for k, ts, i, v in rows:
        s, m, lo, p = state.get(k, (0, -1, 1 << 60, None))
        state[k] = (s + v, max(m, v), min(lo, i), v)
        want.append((k, ts, i, *state[k][:3], p))
    assert sorted(map(tuple, got.select("k", "ts", "event_id", "s", "m", "lo", "p").collect())) == want


def test_failure_runs_and_gaps_by_count(spark):
    calls = hot(spark, 6000).select(F.col("k").alias("client_id"), "ts", F.col("event_id").alias("request_id"), F.when(F.col("v") < 5, 500).otherwise(200).alias("status"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(M.failure_runs(calls, 5, rows_per_piece=300)) == rows(M.failure_runs(calls, 5)) != []
    moves = hot(spark, 6000).select(F.col("k").alias("license_id"), "ts", "event_id")
    assert rows(E.transfer_gaps(moves, rows_per_piece=300)) == rows(E.transfer_gaps(moves))


def plain(machine, events):
    """events: (key, ts, id, op) -> final states, and the state after each."""
    state, after = {}, {}
    for k, ts, i, op in sorted(events):
        s = state.get(k, machine.initial)
        state[k] = after[i] = machine.table.get(op, {}).get(s, s)
    return state, after


RING = G.Machine("a", {"n": {"a": "b", "b": "c", "c": "a"}, "r": {"b": "a", "c": "b"}, "x": {"a": "z", "b": "z", "c": "z"}, "o": {"z": "a"}})


@pytest.mark.parametrize("machine,ops", [(G.LICENCE, "KRXPD-"), (RING, "nnrnox-"), (G.KEY_SLOT, ["claim", "create", "reset", "revoke", None])])
def test_fold_and_history_equal_a_plain_loop(spark, machine, ops):
    r = random.Random(len(ops))
    events = [(None if i % 97 == 0 else (1 if i % 5 else i % 40 + 2), f"2024-01-{r.randrange(1, 4):02d} {r.randrange(2):02d}:00:{r.randrange(60):02d}", i, r.choice(list(ops))) for i in range(4000)]
    df = spark.createDataFrame(events, "k long, ts string, event_id long, op string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    final, after = plain(machine, [e for e in events if e[0] is not None])
    cut = pieces_by_count(df, ["k"], ["ts", "event_id"], 300)
    for src, piece in ((df, None), (cut, F.col("_part"))):
        assert {x.k: x.status for x in G.fold(src, machine, "k", F.col("op"), piece=piece).collect()} == final
        got = G.history(src, machine, "k", F.col("op"), keep=["op"], piece=piece).collect()
        assert {x.event_id: x.status for x in got} == after and len(got) == len(after)


def test_hot_key_history_has_no_large_group(spark):
    """Every group of a level is bounded, though one key has 90 % of the events."""
    ev = hot(spark, 20_000).withColumn("op", F.element_at(F.array(*map(F.lit, "KRXPRXP")), (F.col("v") + 1).cast("int")))
    cut = pieces_by_count(ev, ["k"], ["ts", "event_id"], 500)
    levels = G._levels(G._events(cut, "k", ["ts", "event_id"], F.col("op"), G.LICENCE, F.col("_part"), []), "k", G.LICENCE)
    assert levels[0].agg(F.max(F.size("_items"))).first()[0] <= 64
    assert all(x.agg(F.max(F.size("_items"))).first()[0] <= 1024 for x in levels[1:])
    final, after = plain(G.LICENCE, [(x.k, x.ts, x.event_id, x.op) for x in ev.collect()])
    assert {x.k: x.status for x in G.fold(cut, G.LICENCE, "k", F.col("op"), piece=F.col("_part")).collect()} == final
