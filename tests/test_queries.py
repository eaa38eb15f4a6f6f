"""Registered queries against their SQL, and the plans they give.

A sample runs by default; ALL_QUERIES=1 runs every query.
"""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as entry
from tallyframe.plans.catalog import QUERIES
from tests.oracle import compare, connect

SAMPLE = [n for i, n in enumerate(sorted(QUERIES)) if i % 5 == 0]
NAMES = sorted(QUERIES) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    ok, why = compare(df, con, sql)
    assert ok, why


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_only_one_query_lacks_sql():
    assert {n for n, q in QUERIES.items() if not q.sql} == {"count_classifier"}


def plan(spark, sf, name):
    return entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name,columns",
    [
        ("point_metrics_by_leaf", {"l_suppkey", "l_discount", "l_returnflag", "l_linestatus"}),
        ("duplicate_line_keys", {"l_orderkey", "l_linenumber"}),
        ("latency_profile_big", {"l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"}),
    ],
)
def test_scans_read_only_what_they_need(spark, sf, name, columns):
    for schema in re.findall(r"ReadSchema: struct<(.*?)>", plan(spark, sf, name)):
        assert {c.split(":")[0] for c in schema.split(",")} <= columns


def test_filters_reach_the_scan(spark, sf):
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderstatus,F\)", plan(spark, sf, "suffixed_outer_join"))


@pytest.mark.parametrize("name", ["point_metrics_by_leaf", "run_matrix", "completeness", "frame_plan", "count_repetitions", "unexpected_settings"])
def test_no_nested_loops(spark, sf, name):
    assert not re.search("CartesianProduct|NestedLoop", plan(spark, sf, name))


def test_views_per_slice_need_two_shuffles(spark, sf):
    assert plan(spark, sf, "point_metrics_by_leaf").count("Exchange hashpartitioning") == 2


def test_top_k_is_cut_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(spark, sf, "common_wrong_predictions")
