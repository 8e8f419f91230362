"""Structural checks on physical plans: the scale properties the design relies on."""
import io
import re
from contextlib import redirect_stdout

import pytest

from tests.conftest import SF_SMALL
from tollgate.plans.registry import queries

QS = queries()


def plan(spark, name, mode="formatted"):
    buf = io.StringIO()
    with redirect_stdout(buf):
        QS[name](spark, SF_SMALL).explain(mode)
    return buf.getvalue()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(spark, "b4_validation")
    assert "l_linenumber," not in p.split("PushedFilters")[1].split("]")[0]  # every line is read
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int," in p


def test_state_fold_uses_hash_aggregation_only(spark):
    p = plan(spark, "g1_fold_states")
    assert "HashAggregate" in p and "SortAggregate" not in p
    assert "collect_list" not in p


@pytest.mark.parametrize("name", ["e5_failure_runs", "e6_transfer_gaps", "g1_state_history"])
def test_per_key_windows_are_pieced(spark, name):
    p = plan(spark, name, "extended")
    specs = re.findall(r"windowspecdefinition\(([^)]*)\)", p)
    assert specs and all("_piece" in s or "_pid" in s for s in specs if "ORDER BY" not in s.split(",")[0]), specs


def test_no_cross_products_in_any_plan(spark):
    for name in QS:
        p = plan(spark, name, "simple")
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


@pytest.mark.parametrize("name", ["k10_broken_links", "k18_inbound_links", "k12_link_classes"])
def test_link_resolution_never_reads_page_text(spark, name):
    p = plan(spark, name)
    scans = re.findall(r"ReadSchema: (struct<[^\n]*>)", p)
    assert scans and all("html" not in s for s in scans), scans
