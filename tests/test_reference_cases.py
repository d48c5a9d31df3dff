"""Hand-computed cases of operators whose SQL form leaves a part out, or that have none."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog, evaluation, lifecycle, records, reports, lexical, neighbours, retrieval
from tessera.streaming import folds


def test_hash_vector_has_two_places_a_token():
    want = [0.0] * 8
    for text, size in (("sun", 1.0), ("sun#2", 0.5)):
        h = hashlib.sha256(text.encode()).digest()
        want[int.from_bytes(h[:4], "big") % 8] += size if h[4] % 2 == 0 else -size
    length = math.sqrt(sum(x * x for x in want))
    assert records.hash_embedding("Sun!", 8) == pytest.approx([x / length for x in want])


def test_overlap_score(spark):
    rows = [("weather api", "Weathernow", "weather data api", ["Weather"], 2 + 2 + 1), ("stock", "Acme", "weather", ["finance"], 0), ("now now", "Weathernow", "x", None, 1), ("a weather", "", "weather weather", [], 1)]
    df = spark.createDataFrame(rows, "q string, n string, t string, c array<string>, want int")
    assert [(r.s, r.want) for r in df.select(records.overlap_score(F.col("q"), F.col("n"), F.col("t"), F.col("c")).alias("s"), "want").collect()] == [(w, w) for *_, w in rows]


def test_results_without_an_origin_are_not_demoted_together(spark):
    df = spark.createDataFrame([(1, 10, None, 1), (1, 11, None, 2), (1, 12, "o", 3), (1, 13, "o", 4), (1, 14, None, 5)], "q int, d int, origin string, rank int")
    got = {r.d: r["rank"] for r in retrieval.diversify(df, "q", "origin", 1).collect()}
    assert got == {10: 1, 11: 2, 12: 3, 14: 4, 13: 5}


def test_permutation_is_exact_for_few_and_drawn_for_many(spark):
    d = np.array([0.3, -0.1, 0.2, 0.4])
    signs = [sum(x if m >> i & 1 == 0 else -x for i, x in enumerate(d)) for m in range(16)]
    want = sum(abs(s) >= abs(d.sum()) - 4e-12 for s in signs) / 16
    assert evaluation.permutation_p(d) == want == evaluation.exact_permutation(spark.createDataFrame([(float(x),) for x in d], "d double")).first().p
    assert evaluation.permutation_p(np.full(20, 0.1)) == 2 / 2**20
    many = np.full(21, 0.1)
    assert evaluation.permutation_p(many, 999) == 1 / 1000
    assert evaluation.exact_permutation(spark.createDataFrame([(0.1,)] * 21, "d double")).first().p is None
    assert evaluation.exact_permutation(spark.createDataFrame([], "d double")).first().p == 1.0
    assert evaluation.permutation_p(np.zeros(0)) == evaluation.permutation_p(np.zeros(3)) == 1.0


def test_comparison_uses_one_seed_for_both_parts(spark):
    rows = [("c", i, 0.1 * (i % 4), 0.1 * (i % 3)) for i in range(25)]
    got = evaluation.compare_runs(spark.createDataFrame(rows, "comparison string, query_id long, base double, cand double"), "m", iterations=500).first()
    d = np.array([c - b for *_, b, c in rows])
    assert got.p == evaluation.monte_carlo_permutation(d, 500, 0xB007)
    u = evaluation.mulberry32(0xB007, 500 * 25)
    means = sorted(float(np.mean([d[int(u[k * 25 + j] * 25)] for j in range(25)])) for k in range(500))
    assert (got.low, got.high) == (pytest.approx(means[12], abs=1e-12), pytest.approx(means[487], abs=1e-12))


def test_release_interval_by_steps(spark):
    values = [0.0, 0.25, 1.0, 0.5]
    state, means = 0x5EED1234, []
    for _ in range(1000):
        total = 0.0
        for _ in values:
            state = (state * 1664525 + 1013904223) % 2**32
            total += values[int(state / 2**32 * 4)]
        means.append(total / 4)
    means.sort()
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)] + [("g", 9, None)], "g string, q int, v double")
    got = reports.release_intervals(df, "g", "v", "q").first()
    assert (got.n, got["mean"], got.low, got.high) == (4, sum(values) / 4, means[25], means[975])


def test_staged_sample_fills_one_quota(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "q int, d int, priority int")
    first, second = pairs([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 1)]), pairs([(1, 3, 1), (1, 4, 2), (1, 2, 3), (2, 1, 1)])
    rest = spark.createDataFrame([(1, d) for d in range(1, 9)] + [(2, 1), (2, 2)], "q int, d int")
    got = evaluation.staged_sample([(first, 2), (second, None)], rest, spark.createDataFrame([(1, 1)], "q int, d int"), "q", "d", 5, "s").collect()
    one = {r.d: r.stage for r in got if r.q == 1}
    assert {d: s for d, s in one.items() if s < 2} == {2: 0, 3: 0, 4: 1} and len(one) == 5 and not any(r.exhausted for r in got if r.q == 1)
    assert {(r.d, r.stage, r.exhausted) for r in got if r.q == 2} == {(1, 0, True), (2, 2, True)}


def test_folds_keep_events_of_a_null_key_together(spark):
    rows = [(None, 1, 60), (None, 2, 60), ("a", 3, 60), (None, 4, 40), ("a", 5, 2**53 + 1)]
    got = folds.fold_batch(spark.createDataFrame(rows, "k string, id long, amount long"), "k", ["id"], folds.budget(100), "id long, admitted boolean, spent long").collect()
    assert {r.id: (r.admitted, r.spent) for r in got} == {1: (True, 60), 2: (False, 60), 4: (True, 100), 3: (True, 60), 5: (False, 60)}


def test_both_scopes_must_admit(spark):
    rows = [("d", 1, "a", 60), ("d", 2, "b", 60), ("d", 3, "b", 30), ("d", 4, "a", 50), ("e", 5, "a", 60)]
    got = folds.fold_batch(spark.createDataFrame(rows, "day string, id long, scope string, amount long"), "day", ["id"], folds.two_scope_budget(100, 110), "id long, admitted boolean, spent long").collect()
    assert {r.id: (r.admitted, r.spent) for r in got} == {1: (True, 60), 2: (False, 60), 3: (True, 90), 4: (False, 90), 5: (True, 60)}


def test_dead_jobs_start_again(spark):
    jobs = spark.createDataFrame([(1, "dead", 5, 9), (2, "pending", 2, 9)], "id int, state string, attempts int, due int")
    assert sorted((r.id, r.state, r.attempts, r.due) for r in folds.revive(jobs, F.lit(3)).collect()) == [(1, "pending", 0, 3), (2, "pending", 2, 9)]


def test_observations(spark):
    rows = [(1, 1, "a", "x", True, False), (1, 2, "b", "y", True, False), (1, 3, "a", "x", True, True), (1, 4, "a", "z", True, True), (1, 5, "a", "y", True, True), (1, 6, "a", "x", False, False), (1, 7, "a", "w", False, False), (2, 8, "c", "x", False, False), (None, 9, None, None, True, False)]
    got = {r.id: (r.outcome, r.active_hash) for r in lifecycle.observe(spark.createDataFrame(rows, "key int, id int, owner string, hash string, activate boolean, reject_changes boolean")).collect()}
    assert got == {1: ("indexed", "x"), 2: ("quarantined", "x"), 3: ("refreshed", "x"), 4: ("rejected", "x"), 5: ("versioned", "y"), 6: ("pending", "y"), 7: ("pending", "y"), 8: ("pending", None), 9: ("indexed", None)}


def test_a_changed_option_retires_the_live_one_and_may_come_back(spark):
    rows = [("g", 1, "x"), ("g", 2, "x"), ("g", 3, "y"), ("g", 4, "x"), ("h", 5, None)]
    got = {(r.g, r.option_hash): (r.created_version, r.retired_version) for r in lifecycle.option_history(spark.createDataFrame(rows, "g string, id int, option_hash string"), ["g"]).collect()}
    assert got == {("g", "x"): (1, None), ("g", "y"): (3, 4), ("h", None): (5, None)}


def test_malformed_json_has_no_forbidden_keys(spark):
    df = spark.createDataFrame([('{"a":[{"secret":1}]}',), ("{",), (None,)], "t string")
    assert [r[0] for r in df.select(records.forbidden_keys(F.col("t"), {"secret"})).collect()] == [["secret"], [], []]


def test_fields_by_priority(spark):
    df = spark.createDataFrame([('{"b":" ","c":"x"}',), ('{"a":"y","c":"x"}',), ("{}",)], "body string")
    assert [r[0] for r in df.select(records.by_priority("body", ["a", "b", "c"])).collect()] == ["x", "y", None]


def test_detail_of_one_resource(spark):
    resources = spark.createDataFrame([(1, "n"), (2, "m")], "id int, name string")
    versions = spark.createDataFrame([(1, 1, "superseded"), (1, 2, "active"), (2, 1, "active")], "resource_id int, version int, status string")
    options = spark.createDataFrame([(1, "net", "s", "a", 5), (2, "net", "s", "a", 6)], "resource_id int, network string, scheme string, asset string, amount int")
    seen = spark.createDataFrame([(1, k) for k in range(60)] + [(2, 5)], "resource_id int, observed_at int")
    r = catalog.detail(resources, versions, options, seen, 1).first()
    assert r.name == "n" and [tuple(x) for x in r.versions] == [(2, "active"), (1, "superseded")] and len(r.options) == 1 and list(r.observations) == list(range(59, 9, -1))


def test_gates_name_what_blocks():
    assert evaluation.gates({"a": True, "b": False}) == {"passed": False, "blocked_by": ["b"]}


def test_a_missing_profile_fails_its_gates(spark):
    p = spark.createDataFrame([("lexical", 0.0, 0.0, 0, 0.5, 0.5, 1.0, 0.0, 5.0, 0.0)], "name string, hard_rate double, soft_rate double, fallbacks int, ndcg double, recall double, no_result_accuracy double, top1_rate double, p95_ms double, rerank_rate double")
    got = {r.gate: r.passed for r in reports.gate_table(p, {"curated": True}, 10, 10).collect()}
    assert got["hard_violations_zero"] and got["curated"] and not got["reranker_executed"] and not got["hybrid_p95_within_limit"] and len(got) == 15


def test_rates_must_agree(spark):
    df = spark.createDataFrame([(10, 3, 0.3), (10, 3, 0.31), (0, 0, 0.0)], "n int, k int, r double")
    assert [x[0] for x in df.select(reports.rates_agree(F.col("n"), F.col("k"), F.col("r"))).collect()] == [True, False, True]


def test_nearest_vectors_in_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(300)] + [(300, None), (301, [0.0] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    want = {(r.query_id, r.vec_id, r.distance, r["rank"]) for r in neighbours.knn(vectors, asked, 7).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and any(v)}
    for q in (0, 100, 200):
        best = sorted(unit, key=lambda i: (round(1 - float(unit[q] @ unit[i]), 6), -i))[:7]
        assert [v for _, v, _, r in sorted((x for x in want if x[0] == q), key=lambda x: x[3])] == best
    monkeypatch.setattr(neighbours, "HELD_QUERIES", 1)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 5)
    assert {(r.query_id, r.vec_id, r.distance, r["rank"]) for r in neighbours.knn(vectors, asked, 7).collect()} == want


def test_bm25_in_blocks_of_query_terms(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 12))) for i in range(200)] + [(7, "w1 w1 again"), (200, None), (None, "w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w3"), (3, "unheard"), (4, None), (5, "w1 w1 w4 w5")], "item_id long, text string")
    want = sorted(map(tuple, lexical.bm25(docs, asked, 9).collect()), key=str)
    assert {r[0] for r in want} == {1, 2, 5}
    monkeypatch.setattr(lexical, "QUERY_TERMS", 1)
    assert sorted(map(tuple, lexical.bm25(docs, asked, 9).collect()), key=str) == want
    assert lexical.bm25(docs, asked.filter("item_id = 4"), 9).collect() == []


def test_providers_are_asked_in_batches(spark):
    df = spark.createDataFrame([(1, "ab", "x"), (2, None, "abc"), (3, "bad", "bad")], "id int, q string, d string")
    vectors = retrieval.embed_with(df, "q", lambda texts: [[float(len(t)), 1.0] if t != "bad" else [1.0] for t in texts], 2)
    assert {r.id: r.embedding for r in vectors.collect()} == {1: [2.0, 1.0], 2: [0.0, 1.0], 3: None}
    scored = retrieval.rerank_with(df, "q", "d", lambda pairs: [float(len(a) - len(b)) for a, b in pairs])
    assert {r.id: r.score for r in scored.collect()} == {1: 1.0, 2: -3.0, 3: 0.0}


def test_json_walks(spark):
    deep = "[" * 70 + "1" + "]" * 70
    texts = ['{"b":[{"c":1},[2.0,"x"]],"a":{"z":1.5,"y":null,"ä":1e3,"e":{}},"n":-0.25}', '"top"', "7", "[]", "null", "", None, '{"a":1,"a":2}', '{"":{"":5}}', deep, "[" + ",".join(["1"] * 60) + "]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.f for r in df.select("i", records.flattened(F.col("t")).alias("f")).collect()}
    assert got[0] == ["a.z: 1.5", "a.ä: 1000", "b[0].c: 1", "b[1][0]: 2", "b[1][1]: x", "n: -0.25"]
    assert [got[i] for i in range(1, 9)] == [[": top"], [": 7"], [], [], [], [], [], [": 5"]] and got[9] == [] and got[10] == [f"[{i}]: 1" for i in range(50)]
    found = {r.i: r.f for r in df.select("i", records.forbidden_keys(F.col("t"), {"c", "ä", "", "x", "top"}).alias("f")).collect()}
    assert found[0] == ["c", "ä"] and found[8] == [""] and found[9] == ["(deeper)"] and [found[i] for i in (1, 2, 3, 4, 5, 6, 7, 10)] == [[]] * 8


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_artifact_hash_is_that_of_its_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(evaluation, "HASHED_ROWS", {1: 10**6, 2: 100, 3: 0}[levels])
    rows = [(i % 150, f"x{i}") for i in range(200)] + [(1, "x1")]
    df = spark.createDataFrame(rows, "b int, a string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    nodes = {}
    for b, a in rows:
        h = sha(f'{{"a":"{a}","b":{b}}}')
        nodes.setdefault(h[: 3 * levels], []).append(h)
    nodes = {p: sha("".join(sorted(hs))) for p, hs in nodes.items()}
    for level in range(levels - 1, -1, -1):
        up = {}
        for p, h in nodes.items():
            up.setdefault(p[: 3 * level], []).append(p + h)
        nodes = {p: sha("".join(sorted(hs))) for p, hs in up.items()}
    if levels == 3:
        monkeypatch.setattr(evaluation, "HASHED_ROWS", 0.02)
    assert evaluation.artifact_hash(df, ["a"]).first()[0] == evaluation.artifact_hash(df.orderBy("a").repartition(3), ["a"]).first()[0] == nodes[""]


def test_external_details(spark):
    import json

    full = {
        "tags": [" a ", "b", "a", "", 4, None, *map(str, range(200))], "metadata": {"tags": ["no"], "category": "m", "input": {}, "accepts": [{"scheme": "s"}]}, "categories": None, "paymentOptions": [{"amount": "1", "scheme": "exact", "network": "n", "asset": "x", "payTo": " p ", "maxTimeoutSeconds": 60}, "junk", {"amount": 1, "scheme": "exact", "network": "n", "asset": "x"}],
        "payment": False, "responseValid": 1, "response_valid": True, "health": {"latencyMs": 2.5, "error": " down "}, "quality": {"l30DaysTotalCalls": -1, "totalCalls30d": 7, "l30DaysUniquePayers": 2.0, "lastCalledAt": "2024-01-02T03:04:05Z", "score": 3, "trustScore": None, "grade": " "}, "description": "d", "trust_score": "1",
    }
    bodies = [json.dumps(full), "{}", "[1]", "{bad", None, '{"tags":"one","category":["x","x"],"score":0,"payment":"pass","accepts":[{"amount":"1","scheme":"s","network":"n","asset":"a","maxTimeoutSeconds":"1.5"}]}']
    got = [r[0] for r in spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").orderBy("i").select(reports.external_details(F.col("b"))).collect()]
    a = got[0]
    assert a.tags[:3] == ["a", "b", "0"] and len(a.tags) == 100 and a.categories == ["m"] and [tuple(o) for o in a.accepts] == [("exact", "n", "x", "1", "p", 60)]
    assert (a.payment, a.response_valid, a.latency_ms, a.failure_reason, a.calls, a.buyers, a.last_called, a.completeness, a.provider_score, a.trust_score, a.grade) == ("fail", True, 2.5, "down", None, 2, "2024-01-02T03:04:05.000Z", 1.0, 3.0, None, None)
    for x in got[1:5]:
        assert (x.tags, x.categories, x.accepts, x.payment, x.completeness, x.grade) == ([], [], [], "unknown", 0.0, None)
    b = got[5]
    assert (b.tags, b.categories, b.provider_score, b.payment) == (["one"], ["x"], 0.0, "pass") and b.accepts[0].max_timeout_seconds is None


def test_generators_start_anywhere():
    state, steps = 0x5EED1234, []
    for _ in range(500):
        state = (1664525 * state + 1013904223) % 2**32
        steps.append(state / 2**32)
    assert evaluation.lcg(0x5EED1234, 500).tolist() == steps
    for skip, n in ((0, 0), (1, 7), (123, 377), (499, 1)):
        assert evaluation.lcg(0x5EED1234, n, skip).tolist() == steps[skip : skip + n]
        assert evaluation.mulberry32(7, n, skip).tolist() == evaluation.mulberry32(7, 500)[skip : skip + n].tolist()
    a, c = evaluation.lcg_steps(10**15)
    b, e = evaluation.lcg_steps(10**15 - 1)
    assert (a, c) == (b * 1664525 % 2**32, (e * 1664525 + 1013904223) % 2**32)


@pytest.mark.parametrize("drawn", [2_000_000, 100])
def test_resampling_does_not_depend_on_its_blocks(spark, monkeypatch, drawn):
    monkeypatch.setattr(evaluation, "DRAWN", drawn)
    rng = np.random.default_rng(4)
    long, short, flat = rng.standard_normal(30) + 0.3, rng.standard_normal(6), np.zeros(25)
    rows = [(c, i, 0.0, float(x)) for c, xs in (("long", long), ("short", short), ("flat", flat), (None, long[:22])) for i, x in enumerate(xs)] + [("long", 99, None, 1.0)]
    got = {r.comparison: r for r in evaluation.compare_runs(spark.createDataFrame(rows, "comparison string, query_id long, base double, cand double"), "m", iterations=400).collect()}
    for name, xs in (("long", long), ("short", short), ("flat", flat), (None, long[:22])):
        ci = evaluation.bootstrap_interval(xs, 400)
        r = got[name]
        assert (r.n, r.diff, r.p, r.low, r.high) == (len(xs), xs.mean(), evaluation.permutation_p(xs, 400, evaluation.COMPARISON_SEED), ci["low"], ci["high"])
    values = spark.createDataFrame([("g", i, float(x)) for i, x in enumerate(long)], "g string, q int, v double")
    picks = (evaluation.lcg(reports.RELEASE_SEED, 1000 * 30) * 30).astype(int).reshape(1000, 30)
    means = np.sort(long[picks].sum(axis=1) / 30)
    r = reports.release_intervals(values, "g", "v", "q").first()
    assert (r.low, r.high) == (means[25], means[975])
    assert evaluation.compare_runs(spark.createDataFrame([], "comparison string, query_id long, base double, cand double"), "m").count() == 0


def test_recommendation_report_by_class_and_operation(spark):
    schema = "query int, key string, seq int, attempted boolean, selected boolean, payment_verification string, settlement string, invocation string, response_valid boolean, task_success boolean, latency_ms double, total_cost_usd double, failure_reason string"
    rows = [
        (1, "a", 1, True, True, "pass", "pass", "pass", True, True, 10.0, 0.5, None), (1, "a", 2, True, False, "pass", "fail", None, None, False, 30.0, None, "late"), (2, "b", 1, True, False, "fail", None, "fail", False, None, None, 0.1, "late"),
        (3, "c", 1, False, True, "pass", "pass", "pass", True, True, 99.0, 9.0, "unseen"), (4, "d", 1, True, False, "pass", "pass", "pass", True, False, 20.0, 0.0, ""),
    ]
    o = spark.createDataFrame(rows, schema)
    got = reports.operational_metrics(o).first()
    assert (got.attempted, got.selected, got.payment_verification_rate, got.settlement_rate, got.invocation_rate) == (4, 2, 0.75, 0.5, 0.5)
    assert (got.response_valid_rate, got.task_success_rate, got.mean_latency_ms, got.p95_latency_ms, got.mean_cost_usd) == (pytest.approx(2 / 3), pytest.approx(1 / 3), 20.0, 30.0, pytest.approx(0.2))
    assert [tuple(r) for r in reports.failure_reasons(o).collect()] == [("late", 2)]
    nothing = reports.operational_metrics(o.limit(0)).first()
    assert list(nothing) == [0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0]
    queries = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y"), (5, "z")], "query int, class string")
    metrics = spark.createDataFrame([(1, 2, 0.5), (2, 1, None), (3, 0, None), (4, 1, 1.0)], "query int, relevant int, ndcg double")
    runs = spark.createDataFrame([(1, "a", 1, None), (2, "q", 1, None), (2, "b", 2, True), (3, "c", 1, False), (4, "d", 1, None), (4, "e", 2, None)], "query int, key string, rank int, selected boolean")
    by = {r["class"]: tuple(r)[1:] for r in reports.class_metrics(queries, metrics, runs, o).collect()}
    assert by == {"x": (2, 2, 0.25, 1.0), "y": (2, 1, 1.0, 0.5), "z": (1, 0, 0.0, 0.0)}


def test_last_write_of_equal_orders(spark):
    rows = [(1, 5, "b", 2), (1, 5, "c", 1), (1, 4, "z", 9), (2, None, "n", 1), (None, 1, "k", 3)]
    df = spark.createDataFrame(rows, "id int, at int, name string, v int")
    want = {(1, 5, "c", 1), (2, None, "n", 1), (None, 1, "k", 3)}
    for parts in (1, 4):
        got = folds.last_write(df.repartition(parts), ["id"], "at")
        assert got.columns == df.columns and {tuple(r) for r in got.collect()} == want
