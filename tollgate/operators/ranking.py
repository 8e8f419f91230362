"""Ordered computations without a single-partition or single-key window.

``Window.orderBy`` with no ``partitionBy`` moves every row into one task, and a
window partitioned by a hot key moves a third of the data into one task.  The
helpers here cut the order into pieces, work inside each piece, and add the
totals of earlier pieces from a small table (one row per piece):

* ``rank_by_id``: global rank by a unique integer id, pieces = id >> 20, in levels;
* ``exact_percentile``: counts per distinct value, pieces = rounded log2 of the
  value (order-preserving);
* ``running_by_key`` / ``lag_by_key``: running sum/max/min and lag per key,
  pieces = time buckets of the key's events, or runs of about equally many
  events (``pieces_by_count``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_percentile(df: DataFrame, value: str, q: float, piece_bits: int = 8, count: str | None = None) -> DataFrame:
    """One-row frame with the exact ``q`` percentile of ``value`` (linear
    interpolation between closest ranks, as SQL percentile_cont).  NULLs are
    ignored; an empty input gives NULL.

    Rows are first counted per distinct value (partial aggregation collapses a
    hot value to one row per task); distinct values are then cut into
    deterministic pieces by their rounded magnitude, cumulative counts run per
    piece, and the counts of earlier pieces (one row per piece) are added.  No
    task ever holds more than one piece of distinct values.

    With ``count``, ``df`` has one row per distinct value, none of them NULL, and ``count``
    says how often it occurs; a value that occurs 0 times is passed over.  No filter is then
    put on ``df``, so that the caller's other uses of it can share its exchange."""
    if count is None:
        v = df.select(F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
        counts = v.groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    else:
        counts = df.select(F.col(value).cast("double").alias("_v"), F.col(count).alias("_n"))
    # order-preserving piece id: sign, then log2 of the magnitude in steps of
    # 2^-piece_bits (a piece spans a factor 2^(2^-piece_bits) of values); the
    # offset keeps every non-zero magnitude of a double on its sign's side of 0
    steps = 1 << piece_bits
    offset = float(steps * 1100)          # > steps * 1074 (smallest double's exponent)
    piece = F.when(F.col("_v") == 0, F.lit(0.0)).otherwise(
        F.signum("_v") * (F.floor(F.log2(F.abs("_v")) * steps) + F.lit(offset)))
    counts = counts.withColumn("_p", F.coalesce(piece, F.lit(0.0)))
    w = Window.partitionBy("_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    local = counts.withColumn("_cum", F.sum("_n").over(w))
    per = counts.groupBy("_p").agg(F.sum("_n").alias("_pn"))
    off = per.select("_p", F.coalesce(F.sum("_pn").over(
        Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_pn").over(Window.partitionBy(F.lit(0))).alias("_total"))
    ranked = local.join(off, "_p").select("_v", (F.col("_off") + F.col("_cum")).alias("_hi_rank"),
                                          (F.col("_off") + F.col("_cum") - F.col("_n") + 1).alias("_lo_rank"),
                                          "_total")
    pos = F.lit(q) * (F.col("_total") - 1)
    lo, hi = F.floor(pos) + 1, F.ceil(pos) + 1
    hit_lo = (F.col("_lo_rank") <= lo) & (lo <= F.col("_hi_rank"))
    hit_hi = (F.col("_lo_rank") <= hi) & (hi <= F.col("_hi_rank"))
    g = ranked.filter(hit_lo | hit_hi).agg(
        F.max(F.when(hit_lo, F.col("_v"))).alias("_vlo"), F.max(F.when(hit_hi, F.col("_v"))).alias("_vhi"),
        F.first(pos).alias("_pos"))
    frac = F.col("_pos") - F.floor("_pos")
    return g.select((F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * frac).alias(value))


def pieces_by_count(df: DataFrame, key: list[str], order: list[str], rows: int, name: str = "_part") -> DataFrame:
    """``df`` with a piece number per row: about ``rows`` rows a piece, never decreasing along
    (key, order), whatever the keys and times are.

    Sampled splitters: the table is cut into ranges of (key, order) by Spark's range
    partitioner, which samples its bounds, and a row's piece is its range.  The ranges are
    written once to the shared checkpoint folder, so that every later read, also after the loss
    of an executor, sees the same pieces.  A key with 90 % of the rows in one hour is as many
    pieces as any others with as many rows.  Runs a count and a write when called."""
    import uuid

    from tollgate.session import checkpoint_dir
    spark = df.sparkSession
    parts = max(1, -(-df.count() // rows))
    path = f"{checkpoint_dir(spark).rstrip('/')}/pieces-{uuid.uuid4().hex}"
    df.repartitionByRange(parts, *key, *order).withColumn(name, F.spark_partition_id()).write.parquet(path)
    return spark.read.schema(df.withColumn(name, F.spark_partition_id()).schema).parquet(path)


_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def time_piece(ts: str, seconds: int = 3600):
    """Deterministic piece id: the ``seconds``-long time bucket of ``ts``."""
    from tollgate.functions.columns import epoch_micros
    return F.floor(epoch_micros(ts) / F.lit(seconds * 1_000_000))


def running_by_key(df: DataFrame, key: list[str], order: list[str], values: dict,
                   piece=None) -> DataFrame:
    """Running (inclusive) sum / max / min per key in ``order``, without a window
    partitioned by the key alone.

    ``values`` maps an output name to (kind, column expression).  Each key is cut
    into pieces by ``piece`` (default: the hour of the first order column), a
    deterministic function of the row that must not decrease along ``order``.
    Windows run per (key, piece), so a key holding a third of all rows is spread
    over as many tasks as it has pieces; the totals of the key's earlier pieces
    (one row per piece) are then combined in."""
    pc = piece if piece is not None else time_piece(order[0])
    src = df.select("*", pc.alias("_piece"),
                    *[expr.alias(f"_v_{name}") for name, (_, expr) in values.items()])
    w_local = Window.partitionBy(*key, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = src.select("*", *[_COMBINE[kind](f"_v_{name}").over(w_local).alias(f"_l_{name}")
                              for name, (kind, _) in values.items()])
    tot = src.groupBy(*key, "_piece").agg(*[_COMBINE[kind](f"_v_{name}").alias(f"_t_{name}")
                                            for name, (kind, _) in values.items()])
    w_prev = Window.partitionBy(*key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*key, "_piece", *[_COMBINE[kind](f"_t_{name}").over(w_prev).alias(f"_o_{name}")
                                       for name, (kind, _) in values.items()])
    j = local.join(off, [*key, "_piece"], "left")
    outs = []
    for name, (kind, _) in values.items():
        lo, of = F.col(f"_l_{name}"), F.col(f"_o_{name}")
        if kind == "sum":
            outs.append((F.coalesce(of, F.lit(0)) + F.coalesce(lo, F.lit(0))).alias(name))
        elif kind == "max":
            outs.append(F.greatest(of, lo).alias(name))
        else:
            outs.append(F.least(of, lo).alias(name))
    drop = ["_piece"] + [f"_{p}_{name}" for name in values for p in ("v", "l", "o")]
    return j.select("*", *outs).drop(*drop)


def lag_by_key(df: DataFrame, key: list[str], order: list[str], value: str, name: str,
               piece=None) -> DataFrame:
    """``lag(value)`` per key in ``order`` with the key cut into time pieces (see
    :func:`running_by_key`): inside a piece the previous row's value, for a
    piece's first row the last value of the key's previous non-empty piece."""
    from tollgate.functions.columns import order_key
    pc = piece if piece is not None else time_piece(order[0])
    src = df.withColumn("_piece", pc)
    w = Window.partitionBy(*key, "_piece").orderBy(*order)
    local = src.select("*", F.lag(value).over(w).alias("_lag"), F.row_number().over(w).alias("_rn"))
    okey = order_key(order[0], order[1]) if len(order) > 1 else F.col(order[0])
    last = src.groupBy(*key, "_piece").agg(F.max_by(value, okey).alias("_last"))
    prev = last.select(*key, "_piece", F.lag("_last").over(
        Window.partitionBy(*key).orderBy("_piece")).alias("_prev_piece"))
    j = local.join(prev, [*key, "_piece"], "left")
    return j.withColumn(name, F.when(F.col("_rn") == 1, F.col("_prev_piece")).otherwise(F.col("_lag"))) \
        .drop("_piece", "_lag", "_rn", "_prev_piece")


def last_before(facts: DataFrame, changes: DataFrame, key: list[str], at: str, carry: list[str],
                piece=None, rows_per_piece: int | None = None) -> DataFrame:
    """As-of merge: each fact with the ``carry`` columns of its key's last change at or before its
    ``at`` (NULLs where there is none).  Of changes at one time the largest values count.

    Facts and changes are merged in order and the last change is carried forward in pieces
    (:func:`running_by_key`), so neither side is broadcast, no fact meets more than one change, and a
    key with most of the rows is spread over its pieces: ``piece`` of ``at``, or about
    ``rows_per_piece`` rows each."""
    names = facts.columns
    change = F.struct(F.col(at).alias("_at"), *[F.col(c) for c in carry])
    rows = facts.select(*key, at, F.lit(1).alias("_kind"), F.struct(*names).alias("_row"), F.lit(None).alias("_change"))
    new = changes.filter(F.col(at).isNotNull()).select(*key, at, F.lit(0).alias("_kind"), F.lit(None).alias("_row"), change.alias("_change"))
    both = rows.withColumn("_change", F.col("_change").cast(new.schema["_change"].dataType)).unionByName(
        new.withColumn("_row", F.col("_row").cast(rows.schema["_row"].dataType)))
    if rows_per_piece:
        both, piece = pieces_by_count(both, key, [at, "_kind"], rows_per_piece), F.col("_part")
    both = running_by_key(both, key, [at, "_kind"], {"_last": ("max", F.col("_change"))}, piece)
    return both.filter("_kind = 1").select("_row.*", *[F.col(f"_last.{c}").alias(c) for c in carry])


def rank_by_id(df: DataFrame, id_col: str, name: str = "rank", bits: int = 20) -> DataFrame:
    """1-based position by a unique integer column, from deterministic pieces.

    Rows are numbered inside their piece (id >> ``bits``: at most 2^bits rows,
    however the ids lie).  The pieces' counts are summed up the same way, level by
    level: pieces inside id >> 2*bits, those inside id >> 3*bits, and so on, so no
    window ever holds more than 2^bits rows.  Nothing runs while the plan is built."""
    shifts = list(range(bits, 64, bits))
    d = df.withColumn("_piece", F.shiftright(F.col(id_col).cast("long"), bits))
    local = d.withColumn("_local", F.row_number().over(Window.partitionBy("_piece").orderBy(id_col)))
    counts = d.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_piece", F.lit(0).cast("long").alias("_off"))
    for s in shifts:
        level = counts.groupBy(F.shiftright("_piece", s - bits).alias("_p")).agg(F.sum("_n").alias("_n"))
        above = F.shiftright("_p", bits) if s + bits < 64 else F.lit(0)
        before = F.sum("_n").over(Window.partitionBy(above).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
        level = level.select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
        offsets = (offsets.withColumn("_p", F.shiftright("_piece", s - bits)).join(level, "_p")
                   .select("_piece", (F.col("_off") + F.col("_before")).alias("_off")))
    return (local.join(offsets, "_piece").withColumn(name, F.col("_off") + F.col("_local"))
            .drop("_piece", "_local", "_off"))
