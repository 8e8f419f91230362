"""Exact selection and ranking by a key of several whole numbers, without sorting all rows.

`cutoff` is a weighted median-of-medians selection.  A round is one job: every partition splits
what is left of its rows at the round's pivot and reports, for either side, how many rows it has and
their median key.  The side that holds the wanted key stays; its medians' median, weighted by the
remaining rows, is the next pivot, so each round discards a guaranteed fraction of the rows (an
eighth at least, about half as a rule).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import staged

#: So few keys are sorted on the driver.
FEW = 4096
#: Most partitions that report medians, and rows of a partition of winners.
PARTS, WINNERS = 4096, 1 << 18


def key(*columns: Column) -> list[Column]:
    """The columns k0, k1, ... of a key; smaller comes first, and no two rows may agree in all."""
    return [c.cast("long").alias(f"k{i}") for i, c in enumerate(columns)]


def _names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c[0] == "k" and c[1:].isdigit()]


def _struct(bound: tuple) -> tuple[Column, Column]:
    return (F.struct(*[F.col(f"k{i}") for i in range(len(bound))]),
            F.struct(*[F.lit(int(v)).cast("long").alias(f"k{i}") for i, v in enumerate(bound)]))


def up_to(bound: tuple) -> Column:
    """Whether a row's key is `bound` or comes before it; the first part alone can be pushed down."""
    mine, other = _struct(bound)
    return (F.col("k0") <= int(bound[0])) & (mine <= other)


def after(bound: tuple) -> Column:
    mine, other = _struct(bound)
    return (F.col("k0") >= int(bound[0])) & (mine > other)


def weighted_median(keys: np.ndarray, weights: np.ndarray) -> tuple:
    """Of rows of keys, the smallest at which half of the weight is reached."""
    order = np.lexsort(keys.T[::-1])
    reached = np.cumsum(weights[order])
    return tuple(int(v) for v in keys[order[np.searchsorted(reached, (reached[-1] + 1) // 2)]])


def _until(keys: np.ndarray, pivot: tuple) -> int:
    """How many of the sorted keys come no later than the pivot."""
    lo, hi = 0, len(keys)
    for i, p in enumerate(pivot):
        part = keys[lo:hi, i]
        lo, hi = lo + int(np.searchsorted(part, p, "left")), lo + int(np.searchsorted(part, p, "right"))
    return hi


def _medians(names: list[str], pivot: tuple | None):
    def run(batches):
        sides = ([], [])  # (median, rows) by batch
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
            keys = keys[np.lexsort(keys.T[::-1])]
            cut = len(keys) if pivot is None else _until(keys, pivot)
            for side, part in zip(sides, (keys[:cut], keys[cut:])):
                if len(part):
                    side.append((part[(len(part) - 1) // 2], len(part)))
        for i, side in enumerate(sides):
            if side:
                weights = np.array([n for _, n in side])
                median = weighted_median(np.array([k for k, _ in side]), weights)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([int(weights.sum())], pa.int64()),
                                                  *[pa.array([v], pa.int64()) for v in median]], names=["side", "n", *names])
    return run


def cutoff(rows: DataFrame, m: int, total: int) -> tuple:
    """The m-th key of `total` rows with key columns (1 <= m <= total)."""
    names = _names(rows)
    base = left = rows.select(*names)
    base_n, pivot, need = total, None, m
    while total > FEW:
        schema = ", ".join(f"{c} long" for c in ["side", "n", *names])
        found = left.coalesce(PARTS).mapInArrow(_medians(names, pivot), schema).collect()  # two rows a partition
        sides = [[r for r in found if r.side == i] for i in (0, 1)]
        until = sum(r.n for r in sides[0])
        if pivot is not None:
            below = need <= until
            left = left.where(up_to(pivot) if below else after(pivot))
            total, need = (until, need) if below else (total - until, need - until)
            if total <= base_n // 8:  # later rounds read only what is left
                base = left = staged(left)
                base_n = total
        chosen = sides[0 if pivot is None or below else 1]
        pivot = weighted_median(np.array([[r[c] for c in names] for r in chosen], np.int64), np.array([r.n for r in chosen]))
    return tuple(sorted(tuple(r) for r in left.collect())[need - 1])


def ranked(rows: DataFrame, n: int) -> DataFrame:
    """`rows` (n of them) with `rank`, 1 and up in the key's order: sorted by ranges, numbered
    inside a range, plus the rows of the ranges before."""
    names = _names(rows)
    parts = -(-n // WINNERS)
    placed = rows.repartitionByRange(max(parts, 2), *names).sortWithinPartitions(*names)
    placed = staged(placed.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    sizes = sorted((r.part, r["count"]) for r in placed.groupBy("part").count().collect())  # one row a range
    before = np.cumsum([0, *[c for _, c in sizes]]).tolist()
    offsets = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "part int, before long")
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + inside + 1).drop("part", "at", "before")
