"""Registered capacity / reconciliation queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollgate.operators import capacity as C
from tollgate.plans.registry import register
from tollgate.sources.views import LICENSE_AS_OF

AS_OF_SQL = "TIMESTAMP '2000-01-01 00:00:00'"
LOAD_SQL = """load AS (SELECT node_id, count(*) AS active_keys FROM licenses
  WHERE status IN ('active', 'cancelled') AND node_id IS NOT NULL GROUP BY node_id)"""


@register("b15_active_nodes", views=("nodes",), oracle="SELECT * FROM nodes WHERE status = 'active'")
def b15(c):
    return C.active_nodes(c.nodes)


@register("f2_known_keys", views=("licenses",), oracle="""
SELECT DISTINCT CAST(key_id AS VARCHAR) AS key_id FROM licenses WHERE key_id IS NOT NULL AND key_id <> 'pending'""")
def f2(c):
    return C.known_keys(c.licenses)


@register("d6_node_key_count", views=("licenses",), oracle=f"WITH {LOAD_SQL} SELECT * FROM load")
def d6(c):
    return C.node_load(c.licenses)


_LEAST_SQL = f"""WITH {LOAD_SQL}
SELECT n.id, n.name, n.max_keys, CAST(coalesce(l.active_keys, 0) AS BIGINT) AS active_keys
FROM nodes n LEFT JOIN load l ON l.node_id = n.id
WHERE n.status = 'active' AND n.max_keys > 0 AND coalesce(l.active_keys, 0) < n.max_keys
ORDER BY active_keys, n.id LIMIT {{n}}"""


@register("d7_least_loaded", views=("nodes", "licenses"), headline=True,
          oracle=_LEAST_SQL.format(n=1))
def d7(c):
    return C.least_loaded(c.nodes, c.licenses, 1)


@register("e3_top_nodes", views=("nodes", "licenses"), oracle=_LEAST_SQL.format(n=3))
def e3(c):
    return C.least_loaded(c.nodes, c.licenses, 3)


@register("d5_key_drift", views=("licenses",), headline=True, oracle=f"""
SELECT node_id,
 count(*) FILTER (WHERE status IN ('active', 'cancelled') AND expires_at > {AS_OF_SQL}) AS active_licenses,
 count(*) FILTER (WHERE key_id IS NOT NULL AND key_id <> 'pending') AS active_keys,
 count(*) FILTER (WHERE key_id IS NOT NULL AND key_id <> 'pending')
  - count(*) FILTER (WHERE status IN ('active', 'cancelled') AND expires_at > {AS_OF_SQL}) AS drift
FROM licenses GROUP BY node_id""")
def d5(c):
    return C.key_drift(c.licenses, LICENSE_AS_OF)


_KNOWN_SQL = "SELECT DISTINCT CAST(key_id AS VARCHAR) AS key_id FROM licenses WHERE key_id IS NOT NULL AND key_id <> 'pending'"


@register("c2_orphan_keys", views=("node_keys", "licenses"), oracle=f"""
SELECT node_id, key_id FROM node_keys WHERE key_id NOT IN ({_KNOWN_SQL})""")
def c2(c):
    return C.orphan_keys(c.node_keys, c.licenses)


@register("c2_orphan_keys_by_node", views=("node_keys", "licenses"), oracle="""
SELECT k.node_id, k.key_id FROM node_keys k ANTI JOIN (SELECT DISTINCT node_id, CAST(key_id AS VARCHAR) AS key_id
 FROM licenses WHERE key_id IS NOT NULL AND key_id <> 'pending') l ON k.node_id = l.node_id AND k.key_id = l.key_id""")
def c2n(c):
    return C.orphan_keys(c.node_keys, c.licenses, by=("node_id", "key_id"))


@register("c3_missing_keys", views=("node_keys", "licenses"), oracle="""
SELECT id, key_id, node_id FROM licenses WHERE key_id IS NOT NULL AND key_id <> 'pending'
 AND key_id NOT IN (SELECT key_id FROM node_keys)""")
def c3(c):
    return C.missing_keys(c.licenses, c.node_keys).select("id", "key_id", "node_id")


@register("c4_resolve_node", views=("nodes", "licenses"), oracle="""
SELECT l.id, l.node_id, coalesce(n.name, 'default') AS endpoint FROM licenses l
LEFT JOIN (SELECT * FROM nodes WHERE status = 'active') n ON l.node_id = n.id""")
def c4(c):
    return C.resolve_node(c.licenses, c.nodes, True)


@register("c4_resolve_node_any_status", views=("nodes", "licenses"), oracle="""
SELECT l.id, l.node_id, coalesce(n.name, 'default') AS endpoint FROM licenses l LEFT JOIN nodes n ON l.node_id = n.id""")
def c4a(c):
    return C.resolve_node(c.licenses, c.nodes, False)


@register("d8_reconcile_summary", views=("node_keys", "licenses"), oracle=f"""
SELECT k.node_id, count(*) AS server_keys, count(kn.key_id) AS known_keys,
 count(*) - count(kn.key_id) AS orphans
FROM node_keys k LEFT JOIN ({_KNOWN_SQL}) kn ON k.key_id = kn.key_id GROUP BY ROLLUP (k.node_id)""")
def d8(c):
    return C.reconcile_summary(c.node_keys, c.licenses)


@register("f1_endpoint_set", views=("nodes",), oracle="""
SELECT endpoint, min(source) AS source FROM (
 SELECT 'default' AS source, 'Supplier#000000001' AS endpoint
 UNION ALL SELECT CAST(id AS VARCHAR), name FROM nodes
  WHERE status = 'active' AND name IS NOT NULL AND name <> '' AND name <> 'Supplier#000000001') t
GROUP BY endpoint""")
def f1(c):
    return C.endpoint_set(c.nodes, "Supplier#000000001")


@register("d21_health_rollup", views=("nodes",), oracle="""
SELECT region, bool_or(status = 'active') AS online,
 coalesce(bool_and(CASE WHEN status = 'active' THEN CAST((id * 37) % 100 AS DOUBLE) <= 90.0 END), true) AS disk_ok,
 CASE WHEN bool_or(status = 'active') AND coalesce(bool_and(CASE WHEN status = 'active'
   THEN CAST((id * 37) % 100 AS DOUBLE) <= 90.0 END), true) THEN 'ok' ELSE 'degraded' END AS status
FROM nodes GROUP BY region""")
def d21(c):
    probes = c.nodes.select("id", "region", (F.col("status") == "active").alias("answered"),
                            ((F.col("id") * 37) % 100).cast("double").alias("disk_pct"))
    return C.health_rollup(probes)


@register("e4_assign_nodes", views=("nodes", "licenses"), oracle=f"""
WITH {LOAD_SQL},
elig AS (SELECT n.id AS node_id, n.max_keys, coalesce(l.active_keys, 0) AS load FROM nodes n
  LEFT JOIN load l ON l.node_id = n.id WHERE n.status = 'active' AND n.max_keys > 0
  AND coalesce(l.active_keys, 0) < n.max_keys),
slots AS (SELECT node_id, lvl AS level, row_number() OVER (ORDER BY lvl, node_id) AS slot_rank
  FROM (SELECT node_id, unnest(range(load, max_keys)) AS lvl FROM elig) s),
pend AS (SELECT id, row_number() OVER (ORDER BY id) AS slot_rank FROM licenses
  WHERE node_id IS NULL AND status IN ('active', 'cancelled'))
SELECT p.id AS license_id, p.slot_rank, s.node_id, s.level AS node_load
FROM pend p LEFT JOIN slots s ON p.slot_rank = s.slot_rank""")
def e4(c):
    lic = c.licenses
    pending = lic.filter(F.col("node_id").isNull() & F.col("status").isin("active", "cancelled")).select("id")
    return C.assign_nodes(pending, c.nodes, lic)
