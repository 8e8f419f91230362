"""Chat formatting: the cheapest repair of each conversation's roles, then its rendering.

Legal conversations follow an automaton: an optional system turn first, then user and
assistant turns in alternation, ending with the assistant.  Each turn may be kept, relabelled
to another role, or merged into the turn before it; empty turns may be inserted where the
automaton needs one.  Dynamic programming over the automaton's states finds the cheapest
sequence of edits; ties take the first edit in the order keep, merge, relabel, insert.

A conversation's turns are dealt in blocks.  A block's effect on the automaton is a small
matrix of costs between states, found without knowing where it starts.  The matrices of a
conversation, one row per block, are chained to give each block its entry and exit, and each
block then finds its own edits.  So a very long conversation is spread over many tasks.

Defined results: turns are ordered by turn (null first), role, text; roles are trimmed and
lower-cased, unknown and null roles must be relabelled; null texts are empty; turns of null
conv_ids form one conversation; repeated rows are turns of their own; an empty table gives
an empty result; other columns of the table are not read.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollgate.llm.common import staged

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: States that may follow a state in one turn.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, UNKNOWN, INSERT = 1.0, 3.0, 2.0, 4.0
BLOCK = 1024
SHARD = 16_384  # turns handled together, about
FAR = 1e18


def _edits(state: int, role: int) -> list[tuple[float, str, int | None, int]]:
    """(cost, action, inserted state or None, state after) of one turn; role 0 is unknown."""
    out = []
    if state == role and role:
        out.append((MERGE, "merge", None, state))
    for inserted in (None, *NEXT[state]):
        at = state if inserted is None else inserted
        for to in NEXT[at]:
            cost = 0.0 if to == role else UNKNOWN if not role else RELABEL
            out.append((cost + (INSERT if inserted is not None else 0.0), "keep" if to == role else "relabel", inserted, to))
    if state and not role:
        out.append((MERGE + UNKNOWN, "merge", None, state))
    return sorted(out, key=lambda e: e[0])  # stable: the order above breaks ties


_TABLE = {(s, r): _edits(s, r) for s in range(4) for r in range(4)}


def repair(roles: list[int], entry: int, leave: int | None = None) -> tuple[list[float], list[tuple]]:
    """Costs from `entry` to each state over the turns; with `leave`, the edits of the cheapest way there."""
    cost, came = [0.0 if s == entry else FAR for s in range(4)], []
    for role in roles:
        after, back = [FAR] * 4, [None] * 4
        for s in range(4):
            if cost[s] < FAR:
                for edit in _TABLE[s, role]:
                    if cost[s] + edit[0] < after[edit[3]]:
                        after[edit[3]], back[edit[3]] = cost[s] + edit[0], (s, edit)
        cost = after
        came.append(back)
    edits = []
    if leave is not None:
        state = leave
        for back in reversed(came):
            state, edit = back[state]
            edits.append(edit)
        edits.reverse()
    return cost, edits


def _groups(table: pa.Table, keys: list[str], order: str | None = None):
    """Rows as dicts, by equal keys, each group in order."""
    rows = table.sort_by([(k, "ascending") for k in keys + [order] * bool(order)]).to_pylist()
    return groupby(rows, key=lambda r: tuple(r[k] for k in keys))


def _matrices(table: pa.Table) -> pa.Table:
    """One row per block: the costs between states over it."""
    out = []
    for (conv, block), rows in _groups(table, ["conv", "block"], "place"):
        states = [r["state"] for r in rows]
        out.append({"conv": conv, "block": block, "cost": [c for s in range(4) for c in repair(states, s)[0]]})
    return pa.Table.from_pylist(out, pa.schema([("conv", pa.string()), ("block", pa.int64()), ("cost", pa.list_(pa.float64()))]))


def _chains(table: pa.Table) -> pa.Table:
    """Entry and exit of each block: the cheapest way through all blocks of its conversation."""
    out = []
    for (conv,), rows in _groups(table, ["conv"], "block"):
        rows = list(rows)
        cost, came = np.array([0.0, FAR, FAR, FAR]), []
        for r in rows:
            total = cost[:, None] + np.array(r["cost"]).reshape(4, 4)
            came.append(total.argmin(axis=0))
            cost = np.minimum(total.min(axis=0), FAR)
        # a conversation ends with the assistant; after a user's or a system turn empty ones are added
        state = int((cost + np.array([FAR, 2 * INSERT, INSERT, 0.0])).argmin())
        for k in range(len(rows) - 1, -1, -1):
            before = int(came[k][state])
            out.append({"conv": conv, "block": rows[k]["block"], "entry": before, "leave": state, "last": k == len(rows) - 1})
            state = before
    return pa.Table.from_pylist(out, pa.schema([("conv", pa.string()), ("block", pa.int64()), ("entry", pa.int64()),
                                                ("leave", pa.int64()), ("last", pa.bool_())]))


_HEAD, _TAIL = (lambda s: f"<|{ROLES[s - 1]}|>\n"), "<|end|>\n"
_OUT = "conv string, place long, turn long, action string, role string, inserted string, cost double, rendered string"


def _renders(table: pa.Table) -> pa.Table:
    out = []
    for (conv, _), rows in _groups(table, ["conv", "block"], "place"):
        rows = list(rows)
        state = rows[0]["entry"]
        _, edits = repair([r["state"] for r in rows], state, rows[0]["leave"])
        for r, (cost, action, inserted, to) in zip(rows, edits):
            if action == "merge":
                shown = "\n\n" + r["text"]
            else:
                shown = _TAIL if state else ""  # closes the turn before
                if inserted is not None:
                    shown += _HEAD(inserted) + _TAIL
                shown += _HEAD(to) + r["text"]
            state = to
            out.append({"conv": conv, "place": r["place"], "turn": r["turn"], "action": action, "role": ROLES[to - 1],
                        "inserted": ROLES[inserted - 1] if inserted else None, "cost": cost, "rendered": shown})
        if rows[0]["last"]:
            missing = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}[state]
            out[-1]["cost"] += INSERT * len(missing)
            out[-1]["rendered"] += _TAIL + "".join(_HEAD(s) + _TAIL for s in missing)
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    return pa.Table.from_pylist(out, pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _OUT.split(", ")]))


def format_chats(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per turn: conv_id, place (order in the conversation), turn, action, role (as
    repaired), inserted (role of an empty turn put before it), cost, rendered.

    A conversation's `rendered` values, joined in order of `place`, are its rendering."""
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    state = F.coalesce(*[F.when(role == r, F.lit(i + 1)) for i, r in enumerate(ROLES)], F.lit(0))
    rows = turns.select(F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), "turn", "role",
                        F.coalesce("text", F.lit("")).alias("text"), state.alias("state"))
    # places: ranks within ranges of turn numbers, and the rows of the ranges before
    part = F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))).cast("long")
    rows = rows.withColumn("part", part)
    sums = rows.groupBy("conv", "part").agg(F.count("*").alias("n"))
    w = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0)))
    w = Window.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "text")
    rows = rows.withColumn("rank", F.row_number().over(w)).join(sums.drop("n"), ["conv", "part"])
    rows = rows.withColumn("place", F.col("first") + F.col("rank") - 1)
    rows = staged(rows.select("conv", "turn", "text", "state", "place", F.floor(F.col("place") / block).cast("long").alias("block")))
    shards = max(1, -(-rows.count() // SHARD))
    dealt = lambda *by: F.pmod(F.xxhash64(*by), F.lit(shards)).alias("shard")
    costs = rows.select("conv", "block", "place", "state").groupBy(dealt("conv", "block")).applyInArrow(
        lambda t: _matrices(t), "conv string, block long, cost array<double>")
    ways = costs.groupBy(dealt("conv")).applyInArrow(lambda t: _chains(t), "conv string, block long, entry long, leave long, last boolean")
    out = rows.join(ways, ["conv", "block"]).groupBy(dealt("conv", "block")).applyInArrow(lambda t: _renders(t), _OUT)
    named = F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(turns.schema["conv_id"].dataType).alias("conv_id")
    return out.select(named, "place", "turn", "action", "role", "inserted", "cost", "rendered")
