"""Capacity and reconciliation: node load, least-loaded choice, batch assignment,
key drift and orphan keys (SURVEY B15, C2-C4, D5-D8, D21, E3, E4, F1, F2).

Nodes are a small dimension; licences and server key lists are the facts.  Every
per-node figure is aggregated on the fact side first (partial aggregation), so
joins to the node table only ever see one row per node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollgate.functions import patterns as P
from tollgate.functions.columns import literal_rows, ts_lit
from tollgate.operators.ranking import rank_by_id


def active_nodes(nodes: DataFrame) -> DataFrame:
    """B15."""
    return nodes.filter(F.col("status") == "active")


def known_keys(licenses: DataFrame, with_node: bool = False) -> DataFrame:
    """key ids held by licences (NULL and the pending sentinel dropped), as text."""
    cols = [F.col("key_id").cast("string").alias("key_id")]
    if with_node:
        cols = [F.col("node_id")] + cols
    return (licenses.filter(F.col("key_id").isNotNull() & (F.col("key_id") != P.PENDING))
            .select(*cols).distinct())


def node_load(licenses: DataFrame) -> DataFrame:
    """Seats (active or cancelled licences) per node."""
    return (licenses.filter(F.col("status").isin(*P.SEAT_STATUSES) & F.col("node_id").isNotNull())
            .groupBy("node_id").agg(F.count(F.lit(1)).alias("active_keys")))


def least_loaded(nodes: DataFrame, licenses: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` active nodes with free capacity and the lowest load.

    Same result as a left join with the status test in ON, grouped, HAVING load <
    max_keys; nodes with max_keys <= 0 never qualify.  Ties go to the lower id.
    The limit is the feature (a top-n report)."""
    load = node_load(licenses)
    cand = (nodes.filter((F.col("status") == "active") & (F.col("max_keys") > 0))
            .join(load, F.col("id") == F.col("node_id"), "left")
            .select("id", "name", "max_keys",
                    F.coalesce(F.col("active_keys"), F.lit(0)).cast("long").alias("active_keys")))
    return (cand.filter(F.col("active_keys") < F.col("max_keys"))
            .orderBy("active_keys", "id").limit(n))


def key_drift(licenses: DataFrame, as_of) -> DataFrame:
    """Per node, licences in force, keys in use, and the difference."""
    now = ts_lit(as_of)
    g = licenses.groupBy("node_id").agg(
        F.count_if(F.col("status").isin(*P.SEAT_STATUSES) & (F.col("expires_at") > now))
        .alias("active_licenses"),
        F.count_if(F.col("key_id").isNotNull() & (F.col("key_id") != P.PENDING)).alias("active_keys"))
    return g.withColumn("drift", F.col("active_keys") - F.col("active_licenses"))


def orphan_keys(node_keys: DataFrame, licenses: DataFrame, by=("key_id",)) -> DataFrame:
    """Keys a server lists that no licence holds.  ``by=("key_id",)`` ignores
    the node, as the service's reconciler does; add "node_id" for the strict form."""
    known = known_keys(licenses, with_node="node_id" in by)
    nk = node_keys.withColumn("key_id", F.col("key_id").cast("string"))
    return nk.join(known, list(by), "left_anti")


def missing_keys(licenses: DataFrame, node_keys: DataFrame, by=("key_id",)) -> DataFrame:
    """Licences holding a key that no server lists."""
    held = (licenses.filter(F.col("key_id").isNotNull() & (F.col("key_id") != P.PENDING))
            .withColumn("key_id", F.col("key_id").cast("string")))
    listed = node_keys.select(*by).withColumn("key_id", F.col("key_id").cast("string")).distinct()
    return held.join(listed, list(by), "left_anti")


def resolve_node(licenses: DataFrame, nodes: DataFrame, require_active: bool = True,
                 default: str = "default") -> DataFrame:
    """C4: endpoint for each licence's node; the default when the node is unknown
    (or, with ``require_active``, not active)."""
    nd = nodes
    if require_active:
        nd = nd.filter(F.col("status") == "active")
    nd = nd.select(F.col("id").alias("_nid"), F.col("name").alias("_endpoint"))
    j = licenses.join(nd, F.col("node_id") == F.col("_nid"), "left")
    return j.select("id", "node_id", F.coalesce(F.col("_endpoint"), F.lit(default)).alias("endpoint"))


def reconcile_summary(node_keys: DataFrame, licenses: DataFrame) -> DataFrame:
    """Per node, keys the server lists, how many a licence knows, orphans; plus
    a total row (node_id NULL) from ROLLUP."""
    known = known_keys(licenses).withColumn("_known", F.lit(1))
    j = node_keys.withColumn("key_id", F.col("key_id").cast("string")).join(known, "key_id", "left")
    g = j.rollup("node_id").agg(F.count(F.lit(1)).alias("server_keys"),
                                F.count("_known").alias("known_keys"))
    return g.withColumn("orphans", F.col("server_keys") - F.col("known_keys"))


def endpoint_set(nodes: DataFrame, default: str) -> DataFrame:
    """the default endpoint plus active nodes' endpoints that differ from it
    and are not empty; one row per distinct endpoint."""
    spark = nodes.sparkSession
    d = literal_rows(spark, [("default", default)], "source string, endpoint string")
    n = (nodes.filter(F.col("status") == "active")
         .select(F.col("id").cast("string").alias("source"), F.col("name").alias("endpoint"))
         .filter(F.col("endpoint").isNotNull() & (F.col("endpoint") != "")
                 & (F.col("endpoint") != default)))
    u = d.unionByName(n)
    return u.groupBy("endpoint").agg(F.min("source").alias("source"))


def health_rollup(probes: DataFrame, by=("region",), disk_limit=90.0) -> DataFrame:
    """Per group, online if any node answered; ok only if online and every
    answering node's disk use is at most the limit."""
    ans = F.col("answered")
    return probes.groupBy(*by).agg(
        F.bool_or(ans).alias("online"),
        F.coalesce(F.bool_and(F.when(ans, F.col("disk_pct") <= disk_limit)), F.lit(True)).alias("disk_ok"),
    ).withColumn("status", F.when(F.col("online") & F.col("disk_ok"), "ok").otherwise("degraded"))


# ---------------------------------------------------------------------------
# Batch assignment equal to repeated least-loaded choice
# ---------------------------------------------------------------------------

def free_nodes(nodes: DataFrame, licenses: DataFrame) -> DataFrame:
    """(node_id, load, max_keys) of the active nodes with free seats."""
    return (nodes.filter((F.col("status") == "active") & (F.col("max_keys") > 0))
            .join(node_load(licenses), F.col("id") == F.col("node_id"), "left")
            .select(F.col("id").alias("node_id"), F.coalesce(F.col("active_keys"), F.lit(0)).cast("long").alias("load"),
                    F.col("max_keys").cast("long").alias("max_keys"))
            .filter(F.col("load") < F.col("max_keys")))


def capacity_bands(free: DataFrame) -> DataFrame:
    """Bands of levels in which the same nodes are open: (first level, open nodes, seats in the
    bands before).  A node offers the levels load..max_keys-1; seats are taken in (level, node
    id) order, which is what repeated least-loaded choices do.  At most two bands a node."""
    edges = free.select("load", "max_keys").select(F.explode(F.array(
        F.struct(F.col("load").alias("band"), F.lit(1).alias("d")), F.struct(F.col("max_keys").alias("band"), F.lit(-1).alias("d")))).alias("e"))
    edges = edges.groupBy("e.band").agg(F.sum("e.d").alias("d"))  # one row per distinct load or capacity of a node
    up_to = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    bands = edges.select("band", F.sum("d").over(up_to).alias("open"), F.lead("band").over(Window.orderBy("band")).alias("_next"))
    seats = F.coalesce(F.col("open") * (F.col("_next") - F.col("band")), F.lit(0))
    before = F.coalesce(F.sum(seats).over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return bands.select("band", "open", before.alias("before"))


def capacity_slots(free: DataFrame) -> DataFrame:
    """Free seats as (node_id, level, slot_rank): slots are ranked by (level, node id),
    which is the order repeated least-loaded choices would take them in."""
    slots = free.select("node_id", F.explode(F.sequence(F.col("load"), F.col("max_keys") - 1)).alias("level"))
    # prefix count per level: one row per capacity level
    per_level = slots.groupBy("level").agg(F.count(F.lit(1)).alias("_c"))
    starts = per_level.select("level", F.coalesce(F.sum("_c").over(
        Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("level").orderBy("node_id"))
    return (slots.withColumn("_w", within).join(starts, "level")
            .select("node_id", "level", (F.col("_start") + F.col("_w")).alias("slot_rank")))


def water_level(bands: DataFrame, seats: DataFrame) -> DataFrame:
    """One row, ``level``: the first level that stays empty when the one number in ``seats`` is taken
    (NULL where nothing is).  Inside a band the level rises by one for each open node."""
    n = seats.scalar()
    reached = bands.filter((F.col("open") > 0) & (F.col("before") < n))
    rise = F.ceil((n - F.col("before")) / F.col("open"))
    return reached.agg((F.max("band") + F.max_by(rise, "band")).cast("long").alias("level"))


def assign_nodes(pending: DataFrame, nodes: DataFrame, licenses: DataFrame,
                 order: str = "id") -> DataFrame:
    """Give each pending licence (in ``order``, a unique integer) the next least-loaded node,
    exactly as one least-loaded query per licence would; licences beyond the free
    capacity get NULL.

    Water-filling: the bands of levels, at most two a node, tell up to which level the pending licences
    fill the nodes.  Only seats below it are listed: one a licence, and less than one more a node,
    however much capacity is free."""
    ranked = rank_by_id(pending, order, name="slot_rank")
    free = free_nodes(nodes, licenses)
    level = water_level(capacity_bands(free), pending.agg(F.count(F.lit(1)).alias("n"))).scalar()
    slots = capacity_slots(free.withColumn("max_keys", F.least("max_keys", level)).filter(F.col("load") < F.col("max_keys")))
    return ranked.join(slots, "slot_rank", "left").select(
        F.col("id").alias("license_id"), "slot_rank", "node_id", F.col("level").alias("node_load"))


def node_key_count(licenses: DataFrame) -> DataFrame:
    """D6 under its service name: seats per node."""
    return node_load(licenses)
