"""L4 against a plain loop: users without B, B before A, repeated gaps, no rows."""
import datetime as dt
import random
import statistics

import pytest

from tollgate.operators import events as L

SCHEMA = "event_id long, user_id long, event_type string, ts timestamp_ntz, value double"
DAY = dt.datetime(2024, 1, 1)


def plain(rows, target):
    first = lambda user, name, since=dt.datetime.min: min(
        (r[3] for r in rows if r[1] == user and r[2] == name and r[3] >= since), default=None)
    gaps = []
    for user in {r[1] for r in rows}:
        a = first(user, "a")
        if a is not None:
            b = first(user, "b", a)
            gaps.append(None if b is None else (b - a).total_seconds())
    met = [g for g in gaps if g is not None]
    return {"users_a": len(gaps), "users_b": len(met), "share_within": sum(g <= target for g in met) / len(met) if met else None,
            "median_seconds": statistics.median(met) if met else None}


def summary(spark, rows, target):
    return {r.metric: r.value for r in L.time_between(spark.createDataFrame(rows, SCHEMA), "a", "b", target).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_time_between_equals_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(12), rng.choice("abc"), DAY + dt.timedelta(seconds=rng.randrange(40)), 1.0) for i in range(60)]
    assert summary(spark, rows, 10) == plain(rows, 10)


def test_time_between_without_b_and_without_rows(spark):
    only_a = [(1, 1, "a", DAY, 1.0), (2, 1, "b", DAY - dt.timedelta(seconds=1), 1.0), (3, 2, "a", DAY, 1.0)]
    assert summary(spark, only_a, 10) == plain(only_a, 10)
    assert summary(spark, [], 10) == {"users_a": 0, "users_b": 0, "share_within": None, "median_seconds": None}


def test_same_instant_is_a_gap_of_zero(spark):
    rows = [(1, 1, "a", DAY, 1.0), (2, 1, "b", DAY, 1.0), (3, 2, "a", DAY, 1.0), (4, 2, "b", DAY + dt.timedelta(seconds=4), 1.0)]
    assert summary(spark, rows, 1) == {"users_a": 2, "users_b": 2, "share_within": 0.5, "median_seconds": 2.0}
