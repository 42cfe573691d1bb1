"""What must not be in a physical plan, and what must."""

import re

import pytest

from propensity.oracles import ORACLES
from propensity.queries import QUERIES

# Training runs at once and leaves a plan like any other; these are the ones without a learner.
TRAINED = {"model_roundtrip", "lr_closed_form", "tree_stump", "gbt_first_tree", "cv_one_feature"}
RELATIONAL = sorted(set(ORACLES) - TRAINED)
FORBIDDEN = ["Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"]


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RELATIONAL)
def test_plans_stay_in_the_jvm_and_have_no_cross_join(spark, tables, name):
    plan = physical(QUERIES[name](spark, tables))
    assert not [word for word in FORBIDDEN if word in plan]


def read_columns(plan, table):
    scans = [line for line in plan.splitlines() if "FileScan" in line and f"{table}.parquet" in line]
    assert scans
    return [set(re.search(r"ReadSchema: struct<(.*?)>", line).group(1).replace(":", ",").split(",")[::2]) for line in scans]


def test_scans_read_the_needed_columns_only(spark, tables):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        plan = physical(QUERIES["hash_split"](spark, tables))
        assert read_columns(plan, "orders") == [{"o_orderkey", "o_custkey"}]
        assert read_columns(plan, "customer") == [{"c_custkey"}]
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_one_exchange_per_grouping(spark, tables):
    for name in ("class_balance", "split_sizes", "confusion_matrix"):
        plan = physical(QUERIES[name](spark, tables))
        assert plan.count("Exchange hashpartitioning") == 1, name
