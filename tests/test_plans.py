"""Physical plans: base tables are scanned once and nothing multiplies rows."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from bandwright.plans import frames
from bandwright.plans.catalogue import REGISTRY

ONE_SCAN = [
    "panel_assembly", "cohort_share", "class_bands", "woe_table", "woe_table_null_level", "chi_square",
    "iv_categorical", "auc_gini", "roc_points", "ks_two_sample", "ks_curve", "gains_table",
    "gains_by_sample", "gains_zero_first", "segment_gains", "sparse_profile", "exclusion_waterfall",
    "latest_attributes", "dedup_lookup_join",
]


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ONE_SCAN)
def test_base_tables_are_scanned_once(spark, folder, name):
    plan = final_plan(REGISTRY[name](spark, folder))
    scans = Counter(re.findall(r"sf0\.001/(\w+)\.parquet", plan))
    assert scans and set(scans.values()) == {1}, scans


@pytest.mark.parametrize("name", sorted(set(ONE_SCAN) | {"psi", "boxplot_stats", "gains_fractional", "woe_encode_join"}))
def test_no_nested_loops(spark, folder, name):
    plan = REGISTRY[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_and_columns_reach_the_scan(spark, folder):
    plan = REGISTRY["split_samples"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "o_orderpriority" not in plan
    looked = REGISTRY["lookup_check"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(c_mktsegment,BUILDING\)", looked)


def test_lines_are_dealt_before_they_are_summed(spark, folder):
    plan = frames.book(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("HashAggregate") < plan.index("Exchange")
