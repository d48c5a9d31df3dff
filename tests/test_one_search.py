"""Reports search the corpus once, however often they look at the run."""

import os

import pytest

from tessera.plans import report_queries, retrieval_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", ["e2_lift", "e18_by_class", "e9_release_intervals"])
def test_reports_search_once(spark, monkeypatch, name):
    made, search = [], retrieval_queries.lexical
    monkeypatch.setattr(retrieval_queries, "lexical", lambda *a: made.append(1) or search(*a))
    report_queries.QUERIES[name](spark, SF)
    assert len(made) == 1
