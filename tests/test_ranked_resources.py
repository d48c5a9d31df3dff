"""Eligible resources first, then score, then id; every reason by hand, and blocks of queries."""

import pytest

from tessera.operators import records

RESOURCES = "resource_id string, service_name string, description string, resource string, tags array<string>, categories array<string>, accepts array<struct<scheme:string,network:string,asset:string,pay_to:string>>, status string, safety string, liveness string, transport string"
OPTION = [("exact", "pubnet", "USDC", "G1")]
ROWS = [
    ("r1", "Weather API", "forecasts", "https://w.example", ["sun"], ["weather"], OPTION, "active", "pass", "pass", "http"), ("r2", "weather twin", None, None, None, ["Weather"], OPTION, "active", "pass", "pass", "http"),
    ("r3", "Weather best forecasts sun", None, None, [], ["weather"], OPTION, "unsafe", "pass", "pass", "http"), ("r4", "weather", None, None, [], [], OPTION, "active", "fail", "fail", "http"), ("r5", "weather", None, None, [], [], OPTION, "active", "pass", "fail", "http"),
    ("r6", "weather", None, None, [], [], OPTION, "stale", None, None, "http"), ("r7", "weather", None, None, [], ["weather"], OPTION, "active", None, None, "mcp"), ("r8", None, None, None, None, None, None, None, None, None, None),
]
QUERIES = [("all", "Weather weather sun", None), ("typed", "weather", {"type": "http"}), ("categorised", "weather", {"category": "WEATHER"}), ("paid", "nothing", {"network": "pubnet", "payTo": "G1"}), ("poor", "nothing", {"network": "pubnet", "asset": "EUR"}), ("null", None, {"type": ""})]


@pytest.mark.parametrize("block", [1_000, 2])
def test_order_and_reasons(spark, monkeypatch, block):
    monkeypatch.setattr(records, "RANKED_QUERIES", block)
    resources, queries = spark.createDataFrame(ROWS, RESOURCES), spark.createDataFrame(QUERIES, "query_id string, text string, filters map<string,string>")
    got = {}
    for r in records.ranked_resources(resources, queries).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.resource_id, r.eligibility, r.score))
    got = {q: [x[1:] for x in sorted(rows)] for q, rows in got.items()}
    # two tokens, the category and the name; the unsafe one has more and comes later
    assert got["all"][:4] == [("r1", "eligible", 6), ("r2", "eligible", 5), ("r7", "eligible", 5), ("r8", "eligible", 0)]
    assert [x[:2] for x in got["all"][4:]] == [("r3", "unsafe"), ("r4", "unsafe"), ("r5", "unreachable"), ("r6", "stale")]
    reasons = lambda q: {r: e for r, e, _ in got[q]}
    assert reasons("typed")["r7"] == reasons("typed")["r8"] == "incompatible" and reasons("typed")["r1"] == "eligible"
    assert {r for r, e in reasons("categorised").items() if e == "eligible"} == {"r1", "r2", "r7"}
    assert {r for r, e in reasons("paid").items() if e == "eligible"} == {"r1", "r2", "r7"} and "eligible" not in reasons("poor").values()
    assert reasons("null")["r7"] == "eligible" and all(s == 0 for *_, s in got["null"])
    assert records.ranked_resources(resources, queries, 2).count() == 2 * len(QUERIES)
    assert records.ranked_resources(resources.limit(0), queries).count() == 0 and records.ranked_resources(resources, queries.limit(0)).count() == 0


def test_tasks_follow_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(records, "RANKED_PAIRS", 60, raising=False)
    many = [(f"x{i:03}", f"weather {i % 3}", None, None, [], [], OPTION, "active", None, None, "http") for i in range(120)]
    resources, queries = spark.createDataFrame(many, RESOURCES).coalesce(1), spark.createDataFrame(QUERIES, "query_id string, text string, filters map<string,string>")
    spark.sparkContext.setJobGroup("ranked", "ranked")
    got = records.ranked_resources(resources, queries, 3)
    assert sorted(r.resource_id for r in got.filter("query_id = 'all'").collect()) == ["x000", "x001", "x002"]
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("ranked") for s in status.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # 720 pairs are sorted by 12 tasks
    assert max(s.numTasks for s in stages if s) == 12
