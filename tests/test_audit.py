"""The distribution audit on records built by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import audit

SIDECARS = "id long, provider string, is_distractor boolean, resource_type string, family string, slot string, price_tier int, input_method string, network string, scheme_set string, adversarial boolean, sparse boolean"


def records(n=500):
    out = []
    for i in range(n):
        far = i >= 100
        kind = "mcp" if i < 15 else "http"
        scheme = "upto_only" if i % 100 < 8 else "exact_and_upto" if i % 100 < 30 else "exact_only"
        out.append((i, f"p{i % 120}", far, "http" if far else kind, f"f{i % 20}", f"s{i % 5}", i % 10, "not_applicable" if kind == "mcp" and not far else ("GET", "POST")[i % 2], audit.NETWORKS[i % 3], scheme, 20 <= i < 35, 40 <= i < 50))
    return out


def audited(spark, rows, catalog, policy=None):
    df = audit.distribution_audit(spark.createDataFrame(rows, SIDECARS), spark.createDataFrame(catalog, "id long, upto boolean, agrees boolean"), policy)
    return {r.id: (r.observed, r.passed) for r in df.collect()}


def test_a_release_as_planned(spark):
    got = audited(spark, records(), [(i, i in (200, 201), True) for i in range(500)])
    assert len(got) == 38 and list(audit.ASSOCIATIONS) == [i for i in got if i in audit.ASSOCIATIONS]
    assert got["corpus-counts"] == ("catalog=500, sidecars=500, labeled=100, distractors=400", True) and got["provider-count"] == ("120/120", True) and got["catalog-sidecar-wire"] == ("0 error(s)", True)
    assert got["distractor-scheme-budget"] == ("2/400", True) and got["scheme-target"] == ("exact_only=70, exact_and_upto=22, upto_only=8", True) and got["resource-type-target"] == ("http=85, mcp=15", True)
    assert got["upto-http-method-spread"] == ("GET,POST", True) and got["upto-resource-type-spread"] == ("http,mcp", True) and got["upto-family-spread"] == ("20/20", True)
    # all of mcp bear upto here, as against 30 of 100
    assert got["mcp-upto-share"] == ("overall=0.300000, mcp=1.000000, drift=0.700000", False)
    assert got["mcp-price-concentration"] == ("2", True) and got["upto-price-concentration"] == ("0.100000", True) and got["sparse-slot-concentration"] == ("0.200000", True)
    assert got["mcp-network-drift"] == (f"{max(abs(5 / 15 - 34 / 100), abs(5 / 15 - 33 / 100)):.6f}", True)
    assert got["upto-price-tier"] == ("0.000000", True) and got["network-family"][1]
    # types and methods of mcp follow each other
    assert got["mcp-family"][1] is (float(got["mcp-family"][0]) <= 0.3)


def test_errors_of_the_wire(spark):
    rows = records()
    catalog = [(i, False, True) for i in range(500)]
    catalog[3] = (3, False, False)  # disagrees
    catalog[4] = (None, True, True)  # a null id, and 4 is missing
    catalog += [(5, True, True), (900, True, True)]  # twice, and unknown
    got = audited(spark, rows, catalog)
    assert got["catalog-sidecar-wire"] == ("5 error(s)", False) and got["corpus-counts"][0].startswith("catalog=502,")
    got = audited(spark, [*rows, rows[0], (None, *rows[1][1:])], [(i, i >= 100, True) for i in range(500)])
    assert got["catalog-sidecar-wire"] == ("2 error(s)", False) and got["distractor-scheme-budget"] == ("400/400", False)


def test_nothing(spark):
    got = audited(spark, [], [])
    assert len(got) == 38 and got["corpus-counts"] == ("catalog=0, sidecars=0, labeled=0, distractors=0", False)
    assert all(got[i] == ("none", False) for i in audit.ASSOCIATIONS) and got["mcp-network-drift"] == ("1.000000", False) and got["upto-http-method-spread"] == ("none", False)


def test_one_scan_and_one_shuffle_for_all_axes(spark, tmp_path):
    spark.createDataFrame(records(), SIDECARS).write.parquet(str(tmp_path / "s"))
    rows = spark.read.parquet(str(tmp_path / "s"))
    counts = audit.cells(rows, rows.select("id", F.lit(False).alias("upto"), F.lit(True).alias("agrees")))
    text = counts._jdf.queryExecution().executedPlan().toString()
    assert sum("family" in line for line in text.splitlines() if "ReadSchema" in line) == 1 and text.count("Exchange hashpartitioning(id") == 1 and "Join" not in text


@pytest.mark.parametrize("value", [0.3, 0.29])
def test_policies_can_be_set(spark, value):
    got = audited(spark, records(), [(i, False, True) for i in range(500)], {"mcp_upto_drift": 0.7 if value == 0.3 else 0.69})
    assert got["mcp-upto-share"][1] is (value == 0.3)
