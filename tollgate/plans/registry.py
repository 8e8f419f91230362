"""Registered queries: one Spark plan and (where SQL can say it) one DuckDB oracle.

A plan is a function ``Catalog -> DataFrame``.  Its oracle is DuckDB SQL over the
driver's base tables; the fixture views it names are prepended as CTEs, so the
view text is shared with the Spark side and written only once.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from tollgate.sources.views import Catalog, duckdb_view_sql, view_closure


@dataclass
class Plan:
    name: str
    build: Callable[[Catalog], DataFrame]
    oracle: str | None
    views: tuple[str, ...]
    headline: bool = False


REGISTRY: dict[str, Plan] = {}


def register(name: str, oracle: str | None = None, views: tuple[str, ...] = (),
             headline: bool = False):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate plan {name}")
        REGISTRY[name] = Plan(name, fn, oracle, tuple(views), headline)
        return fn
    return deco


def with_views(sql: str, views) -> str:
    """Prefix the oracle text with the fixture views it reads, as CTEs."""
    names = view_closure(views)
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({duckdb_view_sql(n)}\n)" for n in names)
    body = sql.lstrip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


def _load_all():
    # importing the plan modules fills REGISTRY
    from tollgate.plans import (audit_plans, capacity_plans, entitlement_plans,  # noqa: F401
                                event_plans, metric_plans, site_plans, source_plans, stream_plans)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {n: (lambda spark, sf_dir, _p=p: _p.build(Catalog(spark, sf_dir)))
            for n, p in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {n: with_views(p.oracle, p.views) for n, p in REGISTRY.items() if p.oracle}
