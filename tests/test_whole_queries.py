"""Registered queries read whole tables: no id subset, and as many rows as there are keys."""

import os
import re

import pytest

import __spark_entry__ as entry
from tessera.sources import views as V

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_no_sql_form_cuts_ids():
    for name, sql in entry.oracle_sql().items():
        assert not re.search(r"(item_id|p_partkey|l_partkey|event_id|resource_id|o_orderkey) < \d", sql), name


@pytest.mark.parametrize(("name", "table", "key"), [("u6_array_append", "lineitem", "l_partkey"), ("d5_flattened", "events", "event_id"), ("o8_seeded_order", "customer", "c_custkey"), ("j16_detail_versions", "lineitem", "l_partkey")])
def test_whole_queries_read_every_row(spark, name, table, key):
    assert entry.queries()[name](spark, SF).count() == V.read(spark, SF, table).select(key).distinct().count()
