"""Plans keep what they are meant to: pruned columns, pushed filters, no pair joins, few exchanges."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import analytics, catalog
from tessera.plans import analytics_queries, catalog_queries
from tessera.sources import views

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_used(spark):
    text = plan(catalog_queries.QUERIES["j5_semi"](spark, SF))
    assert "l_shipdate" not in text and "l_tax" not in text and "p_retailprice" not in text


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,signup)" in plan(catalog_queries.QUERIES["p5_json_key"](spark, SF))


def test_breakdowns_take_one_scan(spark):
    assert plan(analytics_queries.QUERIES["a9_breakdowns"](spark, SF)).count("orders.parquet") == 1


def test_latest_version_needs_no_window(spark):
    text = plan(catalog.latest_version(views.versions(spark, SF), 3000))
    assert "Window" not in text and "SortMergeJoin" not in text


def test_interval_existence_has_no_join(spark):
    flags = analytics.conversion_flags(views.impressions(spark, SF), views.conversions(spark, SF), 24)
    text = plan(flags)
    assert "Join" not in text and "CartesianProduct" not in text
    # every window is over a resource and a span or a slot of time, so a hot resource is dealt out
    windows = [line for line in text.splitlines() if "- Window [" in line]
    assert windows and all("[resource_id#" in w and ("slot#" in w.split("], [")[-2] or "span#" in w.split("], [")[-2]) for w in windows), windows


def test_no_query_multiplies_tables_out(spark):
    for module in (analytics_queries, catalog_queries):
        for name, query in module.QUERIES.items():
            assert "CartesianProduct" not in plan(query(spark, SF)), name


def test_leaderboard_page_is_a_top_n(spark):
    board = analytics.page_of(analytics.participants(views.payments(spark, SF), "buyer", 0, views.AS_OF), 20, 0)
    assert "TakeOrderedAndProject" in plan(board)
    assert board.filter(F.col("tx_count") < 0).count() == 0
