"""Plan shapes that matter at scale."""

import pytest

import __spark_entry__ as entry
from vistrata.operators import association, clean, encode, profile
from vistrata.plans.inspect import count_nodes, plan_text

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def messy(spark):
    return entry.messy(spark, SF_DIR)


def test_column_statistics_share_one_scan(messy):
    for run in (profile.describe_numeric, profile.missing_by_column, profile.skewness):
        assert count_nodes(run(messy), "Scan") == 1


def test_only_needed_columns_are_read(messy):
    text = plan_text(profile.histogram(messy, "tax"))
    assert "ReadSchema: struct<l_tax:double>" in text


def test_filters_reach_the_scan(messy):
    page = profile.grid_page(messy, "status = 'F'", ["price"], ["l_orderkey"])
    text = plan_text(page)
    assert "EqualTo(l_linestatus,F)" in text and "TakeOrderedAndProject" in text


def test_top_values_are_limited_before_the_shuffle(messy):
    assert count_nodes(profile.top_keys(messy, ["flag", "status"], 5), "WindowGroupLimit") == 2


def test_imputation_and_caps_are_projections(messy):
    for df in (clean.impute_missing(messy, strategy="median")[0],
               clean.treat_outliers(messy, "price")[0]):
        assert count_nodes(df, "Exchange") == 0


def test_small_dictionaries_are_broadcast(messy):
    out, _ = encode.encode_categorical(messy, "flag", "frequency")
    assert count_nodes(out, "BroadcastHashJoin") == 1
    assert count_nodes(out, "SortMergeJoin") == 0


def test_large_dictionaries_are_not_broadcast_whole(messy, spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out, _ = encode.encode_categorical(messy, "flag", "frequency", broadcast_bytes=0)
        assert count_nodes(out, "SortMergeJoin") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_rank_plans_grow_linearly(messy, spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    names = ["price", "quantity", "discount", "tax", "l_partkey", "l_suppkey"]
    try:
        scans = [count_nodes(association.average_ranks(messy, names[:k], 0), "Scan")
                 for k in (1, 3, 6)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert scans[2] <= 6 * scans[0] and scans[2] - scans[1] <= 3 * scans[0]


def test_no_cross_join_in_any_profile(messy):
    for run in (profile.overview, profile.correlation_matrix, profile.quality_summary):
        text = plan_text(run(messy))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
