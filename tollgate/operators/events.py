"""Product-event analytics over the page events.

Per-user "first time" figures are min/min_by aggregates (partial aggregation
map-side); each funnel step is one more join of that step's events with the
per-user rows of the steps before, never a collection of a user's events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.columns import order_key, seconds_between
from tollgate.operators.ranking import exact_percentile


def click_counts(events: DataFrame, labels: dict[str, Column], event_name="click") -> DataFrame:
    """L1: click events counted by labels given as named column expressions."""
    e = events.filter(F.col("event_type") == event_name)
    return e.groupBy(*[c.alias(n) for n, c in labels.items()]).agg(F.count(F.lit(1)).alias("clicks"))


def _first_after(step_events: DataFrame, prev: DataFrame | None, user="user_id") -> DataFrame:
    """Per user, the first event of this step at or after the user's previous
    step time (the value of that first event kept as well)."""
    e = step_events.select(user, "ts", "event_id", "value", order_key("ts", "event_id").alias("_k"))
    if prev is not None:
        e = (e.join(prev.select(user, F.col("t").alias("_prev")), user)
             .filter(F.col("ts") >= F.col("_prev")))
    # packed (ts, event_id) order: fixed-width buffers, hash aggregation
    return e.groupBy(user).agg(F.min_by("ts", "_k").alias("t"), F.min_by("value", "_k").alias("v"))


def funnel(events: DataFrame, steps=("click", "purchase"), user="user_id") -> DataFrame:
    """L2: ordered funnel.  A user reaches step k at the first step-k event at
    or after reaching step k-1.  One row per step with users, conversion from
    the previous and the first step, and the value of the reaching events.

    One row per user is carried through the steps (a NULL time where a step was not
    reached), so each step's events are read once, and all steps are summed up in one
    aggregate."""
    chain = _first_after(events.filter(F.col("event_type") == steps[0]), None, user).select(user, F.col("t").alias("t1"), F.col("v").alias("v1"))
    for i, s in enumerate(steps[1:], 2):
        e = events.filter(F.col("event_type") == s).select(F.col(user).alias("_u"), "ts", "value", order_key("ts", "event_id").alias("_k"))
        met = chain.join(e, (F.col(user) == F.col("_u")) & (F.col("ts") >= F.col(f"t{i - 1}")), "left")
        chain = met.groupBy(*chain.columns).agg(F.min_by("ts", "_k").alias(f"t{i}"), F.min_by("value", "_k").alias(f"v{i}"))
    sums = chain.agg(*[F.count(f"t{i}").alias(f"n{i}") for i in range(1, len(steps) + 1)],
                     *[F.sum(f"v{i}").alias(f"s{i}") for i in range(1, len(steps) + 1)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(s).alias("step"), F.col(f"n{i}").alias("users"), F.col(f"s{i}").alias("value"))
                                          for i, s in enumerate(steps, 1)])))


def funnel_rates(funnel_df: DataFrame) -> DataFrame:
    """Conversion rates for a funnel table (a handful of rows, one per step)."""
    from pyspark.sql import Window
    w = Window.partitionBy(F.lit(0)).orderBy("step_no")
    return funnel_df.select(
        "*", F.try_divide(F.col("users"), F.lag("users").over(w)).alias("from_prev"),
        F.try_divide(F.col("users"), F.first("users").over(w)).alias("from_first"))


def dedup_purchases(events: DataFrame, txn: Column, name="purchase") -> DataFrame:
    """L3: one purchase per transaction id, the earliest (by ts, event_id)."""
    p = events.filter(F.col("event_type") == name).withColumn("transaction_id", txn)
    first = p.groupBy("transaction_id").agg(F.min(F.struct("ts", "event_id", *[
        c for c in p.columns if c not in ("ts", "event_id", "transaction_id")])).alias("_r"))
    return first.select("transaction_id", "_r.*")


def time_between(events: DataFrame, a: str, b: str, target_seconds: float, user="user_id") -> DataFrame:
    """L4: per user, seconds from the first A to the first B at or after it.
    Long-form summary rows (metric, value): users with A, users reaching B,
    share of those within the target, and the exact median (distributed
    ranking, no single-task percentile buffer)."""
    ta = events.filter(F.col("event_type") == a).groupBy(user).agg(F.min("ts").alias("t"))
    eb = events.filter(F.col("event_type") == b).select(F.col(user).alias("_u"), F.col("ts").alias("_ts"))
    tb = (ta.join(eb, (F.col(user) == F.col("_u")) & (F.col("_ts") >= F.col("t")), "left")
          .groupBy(user, "t").agg(F.min("_ts").alias("tb")))
    # counted once per distinct gap (-1: no B), which both the summary and the median start from
    gap = F.coalesce(seconds_between("tb", "t").cast("double"), F.lit(-1.0))
    d = tb.groupBy(gap.alias("seconds")).agg(F.count(F.lit(1)).alias("n"))
    met = F.when(F.col("seconds") >= 0, F.col("n")).otherwise(0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    s = d.agg(total(F.col("n")).alias("users_a"), total(met).alias("users_b"),
              total(F.when(F.col("seconds") <= target_seconds, met)).alias("_within"))
    s = s.withColumn("share_within", F.try_divide("_within", "users_b"))
    s = s.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                                    for m in ("users_a", "users_b", "share_within")])))
    med = exact_percentile(d.select("seconds", met.alias("n")), "seconds", 0.5, count="n").select(
        F.lit("median_seconds").alias("metric"), F.col("seconds").alias("value"))
    return s.unionByName(med)
