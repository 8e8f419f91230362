"""Keyed state machines over ordered events, for any transition table (G1 in general form).

An event is a map from state to state, and maps compose associatively.  A key's events are cut into
pieces; the maps of 64 events are composed into one, those of 1,024 such into the next, and so on, level
by level, until one map per key is left.  The final state is that map at the initial state.  For
the history the levels are gone down again: a group's incoming state is carried through its
members' maps, and at the bottom through its events.  A group holds 1,024 small maps at most, so a key
with nearly all events is as many tasks as it has groups.  Pieces are hours by default; bursts need
pieces of about equal counts (`ranking.pieces_by_count`).  Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.operators.ranking import time_piece

#: Bits of a position by which events, then maps, are grouped.
FIRST, NEXT, LEVELS = 6, 10, 4
PIECE_BITS = 26  # of the rows of a piece


@dataclass(frozen=True)
class Machine:
    """A transition table: operation -> {state: next state}; what is not named changes nothing."""

    initial: str
    table: dict

    @property
    def states(self) -> list[str]:
        found = [self.initial]
        for moves in self.table.values():
            found += [s for pair in moves.items() for s in pair]
        return list(dict.fromkeys(found))

    def identity(self) -> Column:
        return F.array(*[F.lit(i) for i in range(len(self.states))])

    def moves(self, op: Column) -> Column:
        """The operation's map, as the next state's number by the state's number."""
        at = {s: i for i, s in enumerate(self.states)}
        out = self.identity()
        for name, moves in self.table.items():
            out = F.when(op == name, F.array(*[F.lit(at[moves.get(s, s)]) for s in self.states])).otherwise(out)
        return out

    def name(self, state: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, self.states)), state + 1)


def _then(first: Column, second: Column) -> Column:
    """First map, then the second."""
    return F.transform(first, lambda s: F.element_at(second, s + 1))


def _events(events: DataFrame, key: str, order, op: Column, machine: Machine, piece: Column | None, keep) -> DataFrame:
    """(key, g, at, m, kept columns): a row's position in its key, and its map."""
    ev = events.filter(F.col(key).isNotNull()).select(key, *order, *keep, op.alias("_op"), (piece if piece is not None else time_piece(order[0])).alias("_piece"))
    rn = F.row_number().over(Window.partitionBy(key, "_piece").orderBy(*order))
    at = F.shiftleft(F.col("_piece").cast("long"), PIECE_BITS).bitwiseOR(rn.cast("long") - 1)
    return ev.withColumn("_at", at).withColumn("_m", machine.moves(F.col("_op")))


def _up(rows: DataFrame, key: str, machine: Machine, bits: int, extra=()) -> DataFrame:
    """Rows grouped by `_at` >> bits: the members in order, and their composed map."""
    g = rows.groupBy(key, F.shiftright("_at", bits).alias("_g")).agg(
        F.array_sort(F.collect_list(F.struct("_at", "_m", *extra))).alias("_items"))
    m = F.aggregate("_items", machine.identity(), lambda acc, x: _then(acc, x["_m"]))
    return g.select(key, F.col("_g").alias("_at"), m.alias("_m"), "_items")


def _levels(rows: DataFrame, key: str, machine: Machine, extra=()) -> list[DataFrame]:
    out = [_up(rows, key, machine, FIRST, extra)]
    for _ in range(LEVELS - 1):
        out.append(_up(out[-1], key, machine, NEXT))
    return out


def fold(events: DataFrame, machine: Machine, key: str, op: Column, order=("ts", "event_id"), piece: Column | None = None) -> DataFrame:
    """(key, status): the state after all of the key's events, in ``order``."""
    top = _levels(_events(events, key, list(order), op, machine, piece, []), key, machine)[-1]
    top = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "_m"))).alias("_items"))
    at = F.aggregate("_items", F.lit(0), lambda s, x: F.element_at(x["_m"], s + 1))
    return top.select(key, machine.name(at).alias("status"))


def _carried(state: Column) -> Column:
    """The members of a group with the state before each."""
    start = F.struct(state.alias("s"), F.expr("cast(array() as array<int>)").alias("seen"))
    seen = F.aggregate("_items", start, lambda acc, x: F.struct(F.element_at(x["_m"], acc["s"] + 1).alias("s"),
                                                                F.concat(acc["seen"], F.array(acc["s"])).alias("seen")))["seen"]
    return F.explode(F.arrays_zip(F.col("_items").alias("x"), seen.alias("s")))


def history(events: DataFrame, machine: Machine, key: str, op: Column, order=("ts", "event_id"), keep=(), piece: Column | None = None) -> DataFrame:
    """One row per event: key, ``order`` and ``keep`` columns, and the state after it."""
    extra = [*order, *keep]
    levels = _levels(_events(events, key, list(order), op, machine, piece, list(keep)), key, machine, extra)
    top = levels[-1].groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "_m"))).alias("_items"))
    into = top.select(key, _carried(F.lit(0)).alias("z")).select(key, F.col("z.x._at").alias("_at"), F.col("z.s").alias("_s"))
    for level in reversed(levels[1:]):
        into = (level.join(into, [key, "_at"]).select(key, _carried(F.col("_s")).alias("z"))
                .select(key, F.col("z.x._at").alias("_at"), F.col("z.s").alias("_s")))
    rows = levels[0].join(into, [key, "_at"]).select(key, _carried(F.col("_s")).alias("z"))
    return rows.select(key, *[F.col(f"z.x.{c}").alias(c) for c in extra],
                       machine.name(F.element_at(F.col("z.x._m"), F.col("z.s") + 1)).alias("status"))


# The licence state machine, by operation of ``billing_ops``.
LICENCE = Machine("none", {
    "K": {"none": "active"},
    "R": {"suspended": "active"},
    "X": {"active": "cancelled"},
    "P": {"active": "suspended", "cancelled": "suspended"},
    "D": {"active": "expired", "cancelled": "expired", "suspended": "expired"},
})
# The key slot of a licence (claim, key created, claim reset, key removed).
KEY_SLOT = Machine("empty", {
    "claim": {"empty": "pending"},
    "create": {"pending": "held"},
    "reset": {"pending": "empty"},
    "revoke": {"pending": "empty", "held": "empty"},
})


def slot_op(kind: Column) -> Column:
    """What a billing event does to the key slot: a checkout claims it, a payment creates the key,
    an update resets an open claim, failure, deletion and refund remove the key."""
    return (F.when(kind == "checkout_completed", "claim").when(kind == "payment_succeeded", "create")
            .when(kind == "subscription_updated", "reset").otherwise("revoke"))
