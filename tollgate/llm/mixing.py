"""Mixing sources to target weights by a min-cost flow over membership patterns.

A document belongs to one or more sources; documents with the same set form a pattern.  The
flow network has an edge into each pattern for its 1st, 2nd and 3rd pass, each with the
pattern's words as capacity and costs 0, 1 and 2 (repetition gets dearer), edges from a
pattern to each of its sources, and each source's target as its demand.  A pattern that must
give F words out of S gives every document floor(F / S) times, and once more the documents
that come first in a seeded order until the rest is used, then the largest ones that still
fit into what is left (`FILLS` rounds).

Sources, patterns and cuts are tables, of any number of rows.  Where no document shares its
source with another one, what a pattern gives follows from the source's target alone; only
patterns that do overlap meet the flow, which the driver solves on one row per pattern (over
`max_patterns` such rows it raises an error, and no mix is made).  Which document is taken how
often depends on its own hash and on one small row of its pattern.

Defined results: null text has size 0; a null source is a source of its own; targets of all
sources share the words of all documents by weight, stop at `most` times the source's words,
and the excess is shared anew; sizes of repeated rows count each; empty documents are taken
like others and add no words; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict, deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.llm.common import small, staged, text_of, words

WEIGHTS = (1, 2, 3)
MOST = 3
FILLS = 4


def _order(doc_id: Column, text: Column, seed: int) -> Column:
    """Seeded place of a document: 63 bits."""
    return F.xxhash64(F.lit(seed), doc_id, text).bitwiseAND(F.lit((1 << 63) - 1))


def targets(sizes: dict, weights=WEIGHTS, most: int = MOST, total: int | None = None) -> dict:
    """Target words by source; sources in code-point order, null last, take the weights in turn."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = Fraction(sum(sizes.values()) if total is None else total), {}, set(names)
    while open_:
        shares = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / shares > most * sizes[s]}
        if not full:
            out |= {s: left * weight[s] / shares for s in open_}
            break
        out |= {s: Fraction(most * sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def flow(capacity: dict, members: dict, demand: dict, most: int = MOST) -> dict:
    """Words each pattern gives, at least cost: passes are opened in order of their cost, and
    augmenting paths (breadth first) reroute what is already sent."""
    sent = defaultdict(int)  # (pattern, source) -> words
    need, by_source = dict(demand), defaultdict(list)
    for p, sources in members.items():
        for s in sources:
            by_source[s].append(p)
    for _ in range(most):
        spare = dict(capacity)
        while True:
            # shortest path from a pattern with words to spare to a source in need
            came, queue, end = {("p", p): None for p, c in spare.items() if c > 0}, deque(), None
            queue.extend(came)
            while queue and end is None:
                kind, x = at = queue.popleft()
                if kind == "s" and need[x] > 0:
                    end = at
                elif kind == "p":
                    steps = [("s", s) for s in members[x]]
                else:
                    steps = [("p", p) for p in by_source[x] if sent[p, x] > 0]
                for y in steps if end is None else ():
                    if y not in came:
                        came[y] = at
                        queue.append(y)
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            amount = min([spare[path[0][1]], need[end[1]]]
                         + [sent[b[1], a[1]] for a, b in zip(path, path[1:]) if a[0] == "s"])
            for a, b in zip(path, path[1:]):
                if a[0] == "p":
                    sent[a[1], b[1]] += amount
                else:
                    sent[b[1], a[1]] -= amount
            spare[path[0][1]] -= amount
            need[end[1]] -= amount
    return {p: sum(sent[p, s] for s in members[p]) for p in capacity}


def goals(per: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """`targets` for any number of sources: adds target (exact to a double) and demand, its whole
    words, to `per` (source, source_size, one row each).

    Sources are numbered by a range partitioning of their names.  A source is full when the
    open sources' share per weight exceeds `most` times its size; every round's new share comes
    from three sums over the sources, and only those go to the driver.  Weights are whole numbers."""
    name = F.col("source").asc_nulls_last()
    per = staged(per.repartitionByRange(name).sortWithinPartitions(name).withColumn("at", F.monotonically_increasing_id()))
    parts = per.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.get(F.array(*[F.lit(x).cast("long") for x in weights]), (place % len(weights)).cast("int"))
    per = per.withColumn("part", F.shiftright("at", 33)).join(parts, "part").withColumn("weight", weight).drop("part", "before", "at")
    whole = lambda x: F.lit(x).cast("decimal(38,0)") if isinstance(x, int) else F.col(x).cast("decimal(19,0)")
    full, count = F.lit(False), 0
    left = None
    while True:
        r = per.agg(F.sum("source_size").alias("size"), F.sum(F.when(full, F.col("source_size"))).alias("gone"),
                    F.sum(F.when(~full, F.col("weight"))).alias("shares"), F.count(F.when(full, 1)).alias("n")).first()
        total = r["size"] or 0
        if left is not None and r["n"] == count or not r["shares"]:
            break
        left, shares, count = total - most * (r["gone"] or 0), r["shares"], r["n"]
        full = whole("weight") * whole(left) > whole("source_size") * whole(most * shares)
    if left is None:  # no sources
        left, shares = 0, 1
    share = whole("weight") * whole(left)
    return per.select(
        "source", "source_size",
        F.when(full, (F.col("source_size") * most).cast("double")).otherwise(share.cast("double") / F.lit(float(shares))).alias("target"),
        F.when(full, F.col("source_size") * most).otherwise(F.floor(share / whole(shares)).cast("long")).alias("demand"))


def gives(pats: DataFrame, per: DataFrame, most: int, max_patterns: int) -> DataFrame:
    """Adds `give`, the words a pattern sends.  A pattern alone with its source sends the
    source's demand; only patterns of sources that some document shares with another source
    need the flow, which is solved on the driver."""
    alone = per.select(F.to_json(F.array("source")).alias("pattern"), "demand")
    shared = pats.where(F.size("sources") > 1)
    if shared.isEmpty():
        return pats.join(alone, "pattern", "left").select("pattern", "size", F.coalesce("demand", F.lit(0)).alias("give"))
    shared = staged(shared.select(F.explode("sources").alias("source")).distinct().select(F.to_json(F.array("source")).alias("name"), "source"))
    n = shared.count()
    names = small(shared.select("name"), n, 200)
    # a pattern with one shared source has no other kind: its first source tells
    marked = pats.withColumn("name", F.to_json(F.slice("sources", 1, 1)))
    rows = marked.join(names, "name", "left_semi").select("pattern", "sources", "size").limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"over {max_patterns} sets of sources that overlap")
    need = {r["source"]: r["demand"] for r in small(shared.withColumnRenamed("name", "pattern"), n, 200)
            .join(alone, "pattern").collect()}  # sources of at most `max_patterns` sets
    sent = flow({r["pattern"]: r["size"] for r in rows}, {r["pattern"]: r["sources"] for r in rows}, need, most)
    sent = pats.sparkSession.createDataFrame(list(sent.items()), "pattern string, sent long")
    free = alone.join(names.withColumnRenamed("name", "pattern"), "pattern", "left_anti")
    return (pats.join(small(sent, len(rows), 200), "pattern", "left").join(free, "pattern", "left")
            .select("pattern", "size", F.coalesce("sent", "demand", F.lit(0)).alias("give")))


def plan(rows: DataFrame, weights=WEIGHTS, most: int = MOST, max_patterns: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """`rows`: sources array, size, u.  Returns the sources (source, source_size, target) and the
    cuts, one row per pattern: whole (copies of every document), last (u of the last one taken
    once more), more (such u besides)."""
    rows = rows.withColumn("pattern", F.to_json("sources"))
    pats = staged(rows.groupBy("pattern").agg(F.any_value("sources").alias("sources"), F.sum("size").alias("size")))
    per = pats.select(F.explode("sources").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    per = goals(per, weights, most)
    size, give = F.col("size"), F.col("give")
    pats = staged(gives(pats, per, most, max_patterns).select(
        "pattern", F.when(size > 0, F.expr("give div size")).otherwise(0).alias("whole"),
        F.when(size > 0, give % size).otherwise(0).alias("rest")))
    n = pats.count()
    sent = lambda df: small(df, n, 200)

    # the seeded order is cut in the 65,536 ranges of u: sums by range first, rows of one range after
    ranges = rows.groupBy("pattern", F.shiftright("u", 47).alias("part")).agg(F.sum("size").alias("size"))
    w = Window.partitionBy("pattern").orderBy("part")
    ranges = (ranges.withColumn("upto", F.sum("size").over(w)).join(sent(pats), "pattern").where("upto > rest").groupBy("pattern")
              .agg(F.min("part").alias("part"), F.min_by(F.col("rest") - F.col("upto") + F.col("size"), "part").alias("rest")))
    edge = rows.join(sent(ranges), "pattern").where(F.shiftright("u", 47) == F.col("part"))
    w = Window.partitionBy("pattern").orderBy("u").rangeBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.sum("size").over(w)).where("upto <= rest").groupBy("pattern").agg(F.max("u").alias("edge"))
    last = F.when(F.col("rest") == 0, F.lit(-1)).otherwise(
        F.coalesce("edge", F.shiftleft("part", 47) - 1, F.lit((1 << 63) - 1)))
    cuts = staged(pats.join(ranges.select("pattern", "part"), "pattern", "left").join(edge, "pattern", "left")
                  .select("pattern", "whole", "rest", last.alias("last")))
    taken = rows.join(sent(cuts), "pattern").where("u <= last").groupBy("pattern").agg(F.sum("size").alias("taken"))
    cuts = staged(cuts.join(taken, "pattern", "left").select(
        "pattern", "whole", "last", F.array().cast("array<long>").alias("more"),
        (F.col("rest") - F.coalesce("taken", F.lit(0))).alias("gap")))
    for _ in range(FILLS):
        if cuts.where("gap > 0").isEmpty():
            break
        free = rows.join(sent(cuts.where("gap > 0")), "pattern").where("u > last and size > 0 and size <= gap").where(~F.array_contains("more", F.col("u")))
        got = free.groupBy("pattern").agg(F.max(F.struct("size", "u")).alias("b"))
        cuts = staged(cuts.join(got, "pattern", "left").select(
            "pattern", "whole", "last", F.when(F.col("b").isNull(), F.col("more")).otherwise(F.array_append("more", F.col("b.u"))).alias("more"),
            (F.col("gap") - F.coalesce("b.size", F.lit(0))).alias("gap")))
    return per.drop("demand"), sent(cuts.drop("gap"))


def copies(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds `copies`; needs sources and u.  Map-side while the cuts, one row per pattern, are small."""
    once = (F.col("u") <= F.col("last")) | F.array_contains("more", F.col("u"))
    return (rows.withColumn("pattern", F.to_json("sources")).join(cuts, "pattern")
            .withColumn("copies", F.col("whole") + once.cast("long")).drop("pattern", "whole", "last", "more"))


def _sources(sources: Column | None = None) -> Column:
    """A document's distinct sources in order; a null list counts as one null source."""
    one = F.array("source") if sources is None else F.coalesce(sources, F.array(F.lit(None).cast("string")))
    return F.array_sort(F.array_distinct(one))


def _narrow(docs: DataFrame, sources: Column | None, seed: int) -> DataFrame:
    return docs.select("doc_id", _sources(sources).alias("sources"),
                       F.size(words(text_of())).cast("long").alias("size"), _order(F.col("doc_id"), text_of(), seed).alias("u"))


def report(docs: DataFrame, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies (one source each)."""
    rows = staged(_narrow(docs, None, seed))
    per, cuts = plan(rows)
    per = staged(cuts.join(per.withColumn("pattern", F.to_json(F.array("source"))).drop("source"), "pattern"))
    out = copies(rows, small(per, per.count(), 250)).withColumn("source", F.get("sources", 0))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, sources: Column | None = None, seed: int = 0) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with its own columns."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", "text", _sources(sources).alias("sources"))
    _, cuts = plan(staged(_narrow(rows, F.col("sources"), seed)))
    rows = rows.select("row", "sources", _order(F.col("doc_id"), text_of(), seed).alias("u"))
    rows = copies(rows, cuts).where("copies > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
