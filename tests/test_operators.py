"""Hand-computed cases of the operators."""

import datetime
import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text, urls
from tessera.operators import analytics, catalog, evaluation, records, retrieval
from tessera.sources import files
from tessera.streaming import folds

NOW = "2024-01-31 00:00:00"


def facts(spark, rows):
    return spark.createDataFrame(rows, "id long, stage string, status string, network string, payer string, pay_to string, amount decimal(38,0), fee decimal(38,0), facilitator_id string, resource_id long, occurred_at timestamp_ntz")


def fact(i, payer, amount, status="success", stage="settled", pay_to="s"):
    return (i, stage, status, "n", payer, pay_to, Decimal(amount), Decimal(1), "f", 1, datetime.datetime(2024, 1, 30, i % 24))


def test_overview_and_concentration(spark):
    df = facts(spark, [fact(1, "a", 10000), fact(2, "a", 10000), fact(3, "b", 10000)])
    row = analytics.overview(df, 30, NOW).first()
    assert (row.total_transactions, int(row.total_amount), row.unique_buyers) == (3, 30000, 2)
    share = analytics.concentration(df, "buyer", 30, NOW).first()
    assert (int(share.total_amount), int(share.top1_amount), share.participants) == (30000, 20000, 2)


def test_many_small_payments(spark):
    df = facts(spark, [fact(i, f"p{i % 25}", 1, "failed" if i % 20 == 0 else "success") for i in range(200)])
    row = analytics.overview(df, 0, NOW).first()
    assert (row.total_transactions, row.failed_transactions, row.unique_buyers, int(row.total_amount)) == (200, 10, 25, 190)


def test_empty_facts(spark):
    row = analytics.overview(facts(spark, []), 0, NOW).first()
    assert row.total_transactions == 0 and int(row.total_amount) == 0 and row.latest_activity is None
    assert analytics.concentration(facts(spark, []), "seller", 0, NOW).first().participants == 0


def test_clamps():
    assert [analytics.clamp_days(x) for x in (0, 7, 8, None)] == [0, 7, 30, 30]
    assert analytics.clamp_page(1000, -5) == (100, 0)


def test_retraction_leaves_a_zero_row(spark):
    df = spark.createDataFrame([(1, 1, "unknown", 5), (1, 2, "success", 5)], "record int, seq int, status string, amount long")
    got = {r.status: (r.transactions, r.amount) for r in folds.retractions(df, ["record"], "seq", ["status"], "amount").collect()}
    assert got == {"unknown": (0, 0), "success": (1, 5)}


def test_budget_denies_without_spending(spark):
    df = spark.createDataFrame([(1, "k", 1, 60), (2, "k", 2, 50), (3, "k", 3, 40), (4, "z", 1, 101)], "id long, key string, at int, amount long")
    got = {r.id: (r.admitted, r.spent) for r in folds.fold_batch(df, "key", ["at"], folds.budget(100), "id long, admitted boolean, spent long").collect()}
    assert got == {1: (True, 60), 2: (False, 60), 3: (True, 100), 4: (False, 0)}


def test_period_budget_resets():
    step, state, seen = folds.period_budget(10, 5), None, []
    for n, (ledger, amount) in enumerate([(1, 8), (3, 5), (6, 5), (10, 5), (11, 9)]):
        state, row = step(state, {"id": n, "ledger": ledger, "amount": amount})
        seen.append((row["admitted"], row["spent"]))
    assert seen == [(True, 8), (False, 8), (True, 5), (True, 10), (True, 9)]


def test_reservations_are_idempotent():
    step, state, row = folds.reservations(), None, None
    for n, (kind, p, a) in enumerate([("reserve", "x", 5), ("reserve", "x", 5), ("reserve", "y", 7), ("settle", "x", 4), ("settle", "x", 4), ("unknown", "y", 0), ("reserve", "x", 5)]):
        state, row = step(state, {"id": n, "payment": p, "kind": kind, "amount": a})
    assert row == {"id": 6, "reserved": 7, "settled": 4}


def test_observation_fold():
    step, state, actions = folds.catalog_observation(), None, []
    for n, (owner, h) in enumerate([("a", "1"), ("a", "1"), ("b", "2"), ("a", "3")]):
        state, row = step(state, {"id": n, "owner": owner, "hash": h})
        actions.append((row["action"], row["version"]))
    assert actions == [("create", 1), ("refresh", 1), ("quarantine", 1), ("version", 2)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"k{i % 3}", i, 30) for i in range(20)]
    schema = "id long, key string, at int, amount long"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = "id long, admitted boolean, spent long"
    stream = folds.fold_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "key", ["at"], folds.budget(100), out)
    q = stream.writeStream.format("memory").queryName("budget_stream").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("budget_stream").collect())) == sorted(map(tuple, folds.fold_batch(df, "key", ["at"], folds.budget(100), out).collect()))


def test_queue(spark):
    jobs = spark.createDataFrame([(1, "pending", 1, 0, 0, 0), (2, "leased", 1, 2, 3, 1), (3, "leased", 1, 9, 4, 2), (4, "pending", 9, 0, 0, 4)], "id int, state string, due int, lease_until int, fence int, attempts int")
    assert [(r.id, r.fence) for r in folds.claimable(jobs, F.lit(5), 10).collect()] == [(1, 1), (2, 4)]
    after = {r.id: (r.state, r.wait) for r in folds.settle_attempt(jobs, 2.0, 5.0, 5).collect()}
    assert after == {1: ("pending", 2.0), 2: ("pending", 4.0), 3: ("pending", 5.0), 4: ("dead", None)}
    assert [folds.backoff(n, 1, 60) for n in (1, 2, 7)] == [1, 2, 60]


def test_fusion_arithmetic(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 10, 3)], "q int, d int, rank int")
    b = spark.createDataFrame([(1, 20, 1)], "q int, d int, rank int")
    got = {r.d: (r.score, r.rank) for r in retrieval.fuse([(a, 0.35), (b, 0.65), (a, 0.0)], "q", "d", 60).collect()}
    assert got[20] == (pytest.approx(0.35 / 62 + 0.65 / 61, abs=1e-8), 1) and got[10] == (pytest.approx(0.35 / 61, abs=1e-8), 2)


def test_diversity_demotes(spark):
    df = spark.createDataFrame([(1, i, "o" if i < 4 else "p", i) for i in range(1, 6)], "q int, d int, origin string, rank int")
    got = [r.d for r in retrieval.diversify(df, "q", "origin", 2).orderBy("rank").collect()]
    assert got == [1, 2, 4, 5, 3]


def cover(positions, weights):
    """Cover density by looking for each minimal span anew."""
    places = sorted((p, t, w) for t, (ps, ws) in enumerate(zip(positions, weights)) for p, w in zip(ps, ws))
    total, start = 0.0, 0
    while True:
        end = next((e for e in range(start, len(places)) if {t for _, t, _ in places[start : e + 1]} == set(range(len(positions)))), None)
        if end is None:
            return total / (total + 1)
        first = max(f for f in range(start, end + 1) if {t for _, t, _ in places[f : end + 1]} == set(range(len(positions))))
        span = places[first : end + 1]
        noise = max(0, span[-1][0] - span[0][0] - (len(span) - 1))
        total += len(span) / sum(1 / w if w > 0 else 10.0 for _, _, w in span) / (1 + noise)
        start = first + 1


def test_cover_density_prefers_close_terms(spark):
    rng = random.Random(31)
    cases = [([[1], [2]], [[1.0], [1.0]]), ([[1], [9]], [[1.0], [1.0]]), ([[1], []], [[1.0], []]), ([[3, 1]], [[0.0, 0.5]]), ([[1, 5, 6], [2, 9], [4]], [[0.1, 1.0, 0.45], [0.18, 1.0], [0.0]])]
    for _ in range(150):
        places, n = rng.sample(range(60), rng.randint(1, 30)), rng.randint(1, 4)
        positions = [[] for _ in range(n)]
        for p in places:
            positions[rng.randrange(n)].append(p)
        cases.append((positions, [[rng.choice([0.0, 0.18, 0.45, 1.0]) for _ in ps] for ps in positions]))
    rows = [(i, [[(p, w) for p, w in zip(ps, ws)] for ps, ws in zip(*c)]) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, l array<array<struct<pos:int,w:double>>>")
    got = {r.i: r.s for r in df.select("i", retrieval.cover_density(F.col("l")).alias("s")).collect()}
    assert got[0] == pytest.approx(0.5) and got[1] < got[0] and got[2] == 0
    assert [got[i] for i in range(len(cases))] == pytest.approx([cover(*c) for c in cases])


def test_modes():
    assert [retrieval.effective_mode("hybrid", *x) for x in ((True, True), (True, False), (False, True), (False, False))] == ["hybrid", "lexical", "semantic", "none"]


def test_metrics_conventions(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "b", 3), ("q", "c", 0), ("e", "z", 0)], "query_id string, doc_id string, grade int")
    queries = spark.createDataFrame([("q",), ("e",)], "query_id string")
    rows = {r.query_id: r for r in evaluation.query_metrics(run, qrels, queries, (3,)).collect()}
    q, e = rows["q"], rows["e"]
    assert q.recall == 1 and q.precision == pytest.approx(1 / 3) and q.mrr == 0.5 and q.ndcg == pytest.approx(1 / math.log2(3))
    assert (q.unjudged, q.explicit_zero, q.judged, q.bpref) == (1, 1, pytest.approx(2 / 3), 1.0)
    assert e.recall is None and e.ndcg is None and e.mrr is None and e.judged is None
    one = {r.query_id: r for r in evaluation.query_metrics(run, qrels, queries, (3,), True).collect()}["e"]
    assert (one.recall, one.ndcg, one.mrr) == (1, 1, 0)


def test_kappa_is_null_when_degenerate(spark):
    same = spark.createDataFrame([(2, 2)] * 3, "a int, b int")
    assert evaluation.weighted_kappa(same).first().kappa is None
    assert evaluation.weighted_kappa(same, degenerate=1.0).first().kappa == 1.0
    mixed = spark.createDataFrame([(0, 0), (3, 3), (0, 3), (3, 0)], "a int, b int")
    assert evaluation.weighted_kappa(mixed).first().kappa == pytest.approx(0)


def test_permutation_and_bootstrap(spark):
    four = spark.createDataFrame([(0.5,)] * 4, "d double")
    assert evaluation.exact_permutation(four).first().p == pytest.approx(2 / 16)
    d = np.array([0.1, 0.2, 0.3, -0.1, 0.4, 0.2])
    assert 0 < evaluation.monte_carlo_permutation(d, 2000) < 0.2 and evaluation.monte_carlo_permutation(np.zeros(5)) == 1.0
    ci = evaluation.bootstrap_interval(d, 2000)
    assert ci["low"] < d.mean() < ci["high"]


def test_generator_steps_in_32_bits():
    state, want = 7, []
    for _ in range(5):
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ state >> 15) * (state | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ t >> 7) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        want.append((t ^ t >> 14) / 2**32)
    assert evaluation.mulberry32(7, 5).tolist() == want


def test_artifact_hash_ignores_order(spark):
    rows = [(i, f"v{i}") for i in range(30)]
    a, b = (evaluation.artifact_hash(spark.createDataFrame(r, "k int, v string"), ["k"]).first()[0] for r in (rows, rows[::-1]))
    assert a == b
    assert evaluation.gates({"x": True, "y": False}) == {"passed": False, "blocked_by": ["y"]}


def test_query_text(spark):
    df = spark.createDataFrame([("ﬁne\u0007  Query‎ the get_user-id",), ("the of",), (None,)], "t string").withColumn("n", text.normalize_query(F.col("t")))
    a, b, c = df.select("n", text.compile_query(F.col("n")).alias("q"), text.query_shape(F.col("n")).alias("s")).collect()
    assert a.n == "fine Query the get_user-id" and a.q.phrase == ["fine", "query", "get", "user", "id"]
    assert a.q.any_of == ["fine", "query", "get_user-id", "get", "user", "id"] and a.s.has_http_method and a.s.has_identifier
    assert b.q.phrase == [] and b.q.any_of == [] and b.s.stopword_only and c.n is None


def test_decimal_text(spark):
    df = spark.createDataFrame([(12345000,), (5,), (-70,), (0,), (1000000,)], "a long")
    assert [r[0] for r in df.select(text.atomic_to_decimal(F.col("a"), 6)).collect()] == ["12.345", "0.000005", "-0.00007", "0", "1"]
    assert [r[0] for r in spark.createDataFrame([(5,), (61,), (7300,), (200000,)], "a long").select(text.compact_age(F.col("a"))).collect()] == ["5s", "1m", "2h", "2d"]


def test_urls(spark):
    df = spark.createDataFrame([("HTTPS://Ex.com:443/a/?b=2&a=1#x",), ("http://127.0.0.1/a",), ("ftp://x/y",), ("http://u:p@x.com/",), ("nope",), (None,)], "u string")
    got = df.select(urls.normalize(F.col("u")).alias("n"), urls.normalize_keep_query(F.col("u")).alias("k"), urls.rejection(F.col("u")).alias("r")).collect()
    assert (got[0].n, got[0].k, got[0].r) == ("https://ex.com/a", "https://ex.com/a?a=1&b=2", None)
    assert [g.r for g in got[1:]] == ["private_host", "scheme", "credentials", "malformed", "malformed"]


def test_joint_filter_needs_one_option(spark):
    res = spark.createDataFrame([(1,), (2,)], "id int")
    opt = spark.createDataFrame([(1, "n1", "s1", 5), (1, "n2", "s2", 5), (2, "n1", "s2", 5)], "resource_id int, network string, scheme string, amount int")
    assert [r.id for r in catalog.with_option(res, opt, network="n1", scheme="s2").collect()] == [2]
    assert catalog.with_option(res, opt).count() == 2


def test_records(spark):
    df = spark.createDataFrame([('{"b":{"c":[1,true]},"a":"x"}',), ("not json",), (None,)], "j string")
    assert [r[0] for r in df.select(records.flattened(F.col("j"))).collect()] == [["a: x", "b.c[0]: 1", "b.c[1]: true"], [], []]
    assert df.limit(1).select(records.forbidden_keys(F.col("j"), {"c", "z"})).first()[0] == ["c"]
    doc = records.compile_document(spark.createDataFrame([("Get Weather", None, "sun sun rain")], "n string, d string, t string"), {"name": F.col("n"), "about": F.col("d"), "tags": F.col("t")}).first()
    assert doc.document == "name: Get Weather\ntags: sun sun rain" and doc.high == "get weather" and doc.low == "sun rain"
    v = records.hash_embedding("weather now")
    assert math.isclose(sum(x * x for x in v), 1) and records.hash_embedding("") == [0.0] * 64


def test_probes_and_overlay(spark):
    recs = spark.createDataFrame([(1, "active"), (2, "unsafe"), (3, "active")], "id int, status string")
    probes = spark.createDataFrame([(1, "unreachable"), (2, "active")], "id int, status string")
    assert {r.id: r.status for r in records.apply_probes(recs, probes, "id").collect()} == {1: "unreachable", 2: "unsafe", 3: "active"}
    assert {r.id: r.status for r in records.overlay(recs, probes, ["id"], ["status"]).collect()} == {1: "unreachable", 2: "active", 3: "active"}


def test_pools_and_selection(spark):
    c = spark.createDataFrame([(1, "a", "s1", 9), (1, "b", "s1", 8), (1, "c", "s2", 1), (1, "d", "s1", 7)], "q int, k string, source string, score int")
    assert {r.k for r in records.judgment_pool(c, "q", "k", 3, "seed").collect()} == {"a", "c", "b"}
    s = spark.createDataFrame([(1, f"k{i}", i == 0, 0 < i < 5) for i in range(12)], "q int, k string, is_anchor boolean, same_family boolean")
    got = records.seeded_selection(s, "q", "k", 7, 2, "s").collect()
    assert len(got) == 7 and sum(r.is_anchor for r in got) == 1 and sum(r.same_family for r in got) == 2


def test_envelope_and_fees(spark):
    good = {"scheme": "exact", "network": "n", "asset": "a", "pay_to": "p", "timeout": 10, "amount": "5", "sponsored": True}
    both = lambda **x: ({**good, **x}, {**good, **x})
    cases = [
        (2, both(), None), (1, both(), "version"), (2, both(scheme="upto"), "scheme"), (2, both(network="m"), "network"), (2, ({**good, "asset": "b"}, good), "requirements"), (2, ({**good, "pay_to": "q"}, good), "requirements"),
        (2, ({**good, "timeout": 9}, good), "requirements"), (2, ({**good, "amount": "6"}, good), "requirements"), (2, both(timeout=999, asset="z"), "timeout"), (2, both(timeout=0), "timeout"), (2, both(asset="z", amount="500"), "asset"),
        (2, both(amount="500"), "amount"), (2, both(amount="0"), "amount"), (2, both(amount="1.5"), "amount"), (2, ({**good, "sponsored": False}, good), "sponsorship"), (2, both(sponsored=None), "sponsorship"),
    ]
    shape = "scheme string, network string, asset string, pay_to string, timeout int, amount string, sponsored boolean".replace(" ", ":").replace(",:", ",")
    rows = spark.createDataFrame([(i, v, 2, a, r) for i, (v, (a, r), _) in enumerate(cases)], f"i int, request_version int, payload_version int, accepted struct<{shape}>, required struct<{shape}>")
    assets = spark.createDataFrame([("a", 100)], "asset string, max_payment int")
    got = {r.i: r.reason for r in records.envelope(rows, assets, "exact", "n", 300).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]
    broken = spark.createDataFrame([(10, 4, 5, 9, 6), (0, -1, 10, 9, 1)], "m int, a int, t int, d int, r int").select(records.settlement_broken(*map(F.col, "matdr"))).collect()
    assert [r[0] for r in broken] == [[], ["max", "actual", "deadline"]]


def test_fetch_positions(spark):
    f = spark.createDataFrame([("s", 5), ("s", 9), ("t", 5)], "session_id string, resource_id long")
    s = spark.createDataFrame([("s", [4, 5])], "session_id string, shown array<long>")
    assert sorted((r.session_id, r.resource_id, r.position) for r in records.attribute_fetches(f, s).collect() if r.position) == [("s", 5, 2)]


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id":1,"g":2}\n{"id":2,"g":9}\nnot json\n{"g":1}\n\n')
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("g", T.LongType())])
    rows, errors = files.read_jsonl(spark, str(tmp_path / "x.jsonl"), schema, {"grade": F.col("g") > 3})
    assert [tuple(r) for r in rows.collect()] == [(1, 2)]
    assert sorted((r.line_number, r.issues[0]) for r in errors.collect()) == [(2, "grade"), (3, "malformed"), (4, "missing id")]
    assert files.is_partial(errors) and not files.is_partial(errors.limit(0))
    files.write_jsonl(spark.createDataFrame([(1, None, "b")], "z int, y int, a string").coalesce(1), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":"b","z":1}']
    files.append(rows, str(tmp_path / "t"))
    files.append(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_manifest_drift(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a").write_text("1")
    (tmp_path / "m" / "b").write_text("2")
    pinned = spark.createDataFrame(files.file_hashes(spark, str(tmp_path / "m")).collect(), "path string, sha256 string")
    assert files.drift(pinned, files.file_hashes(spark, str(tmp_path / "m"))).count() == 0
    (tmp_path / "m" / "b").write_text("3")
    assert [r.state for r in files.drift(pinned, files.file_hashes(spark, str(tmp_path / "m"))).collect()] == ["changed"]


def test_payload_containers(spark):
    df = spark.createDataFrame([("a", '{"items":[{"x":1},{"x":2}]}'), ("b", '[{"x":3}]'), ("c", '{"name":"alone"}'), ("d", "no json"), ("e", None)], "source string, body string")
    items, failures = files.payload_items(df)
    assert sorted((r.source, r.item) for r in items.collect()) == [("a", '{"x":1}'), ("a", '{"x":2}'), ("b", '{"x":3}'), ("c", '{"name":"alone"}')]
    assert sorted(r.source for r in failures.collect()) == ["d", "e"]


def test_cursor():
    f = files.fingerprint({"type": "http"})
    c = files.sign_cursor({"version": 3, "offset": 20, "fingerprint": f, "expires": 100}, b"k")
    assert files.open_cursor(c, b"k", 50, f)["offset"] == 20
    for bad in ((c, b"z", 50, f), (c, b"k", 100, f), (c, b"k", 50, "x"), ("x", b"k", 50, f)):
        with pytest.raises(ValueError):
            files.open_cursor(*bad)
