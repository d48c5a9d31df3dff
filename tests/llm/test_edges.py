"""Edge cases of the corpus operators: null and repeated keys, very long texts, clashing columns; brute force where there is no SQL."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import chunk_dedup, decontaminate, fm_quality, licenses, ngram_join, packing, quality_rules, quotes, url_cascade

public_tokenizers = pytest.importorskip("public_tokenizers")
from tests_prose import prose  # noqa: E402

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_join_with_repeated_keys(spark):
    rng = random.Random(1)
    a, b = prose(rng, 50), prose(rng, 60)
    rows = [(1, a), (1, a), (1, b), (2, a), (3, b), (None, a), (None, None)]
    got = sorted(map(tuple, ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert len(got) == len(rows)
    assert [(k, n, c) for k, n, c, _ in got if k == 2] == [(2, 47, 1)] and [(k, n, c) for k, n, c, _ in got if k == 3] == [(3, 57, 1)]
    assert (None, 0, None, 0) in got


def test_urls_repeated_and_very_long(spark):
    long = "http://a.net/" + "x" * 100_000
    rows = [(1, long), (1, long), (2, None), (2, None), (3, "HTTP://A.NET"), (None, "http://b.org/fr/x")]
    got = url_cascade.judge(spark.createDataFrame(rows, "page_id long, url string"), url_cascade.PRODUCTION_RULES).collect()
    assert collections.Counter((r.page_id, r.verdict) for r in got) == {(1, "block"): 2, (2, "allow"): 2, (3, "allow"): 1, (None, "allow"): 1}


def test_quality_of_null_and_repeated_keys(spark):
    rng = random.Random(2)
    docs = [(i, prose(rng, 40)) for i in range(40)] + [(i, " ".join(["###"] * 40)) for i in range(40, 80)] + [(1, ""), (1, ""), (None, "x"), (None, None)]
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    got = fm_quality.held_out_quality(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    again = [r.score for r in got if r.doc_id == 1]
    assert len(again) == 3 and len(set(again)) == 2


@pytest.mark.parametrize("limits", [packing.Limits(128, 8, 40), packing.Limits(64, 3, 64), packing.Limits(256, 64, 25)])
def test_packing_of_prompts_and_answers(spark, limits):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(0, 60)), prose(rng, rng.randint(0, 30))) for i in range(150)] + [(7, "again", "again"), (None, None, None), (None, "p", None)]
    t = Tokenizer.from_file(TOKENIZER)
    size = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, p string, text string").coalesce(1), TOKENIZER, limits, prompt="p").collect()
    per = collections.defaultdict(list)
    for p in got:
        per[p.sequence_id].append(p)
    bound = collections.Counter()
    for ps in per.values():
        used = (sum(p.length for p in ps), len(ps), sum(p.loss_tokens for p in ps))
        assert used[0] <= limits.tokens and used[1] <= limits.segments and used[2] <= limits.loss_tokens
        assert [p.offset for p in sorted(ps, key=lambda p: p.offset)] == [sum(q.length for q in ps if q.offset < p.offset) for p in sorted(ps, key=lambda p: p.offset)]
        bound[used[2] == limits.loss_tokens and used[0] < limits.tokens] += 1
    assert sum(p.loss_tokens for p in got) == sum(size(x) for *_, x in rows)
    assert sum(p.length for p in got) == sum(size(p) + size(x) + 1 for _, p, x in rows)
    if limits.loss_tokens < limits.tokens:
        assert bound[True] > 0  # this limit alone has closed a sequence


def test_packing_of_null_and_repeated_keys(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a"), (None, None), (2, "")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER).collect()
    assert collections.Counter(p.doc_id for p in got if p.start == 0) == {1: 2, None: 2, 2: 1}


def test_dedup_of_repeated_keys_and_unrepeated_text(spark):
    rng = random.Random(4)
    words = [f"w{n}" for n in range(400)]
    # short phrases recur everywhere, long passages only where they are planted
    clean = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(50, 300)))) for i in range(120)]
    passage = " ".join(f"p{n}" for n in range(60))
    rows = [*clean, (500, passage), (501, f"{clean[3][1]} {passage}"), (500, passage), (None, passage)]
    got = chunk_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    gone = {r.doc_id: r.removed_words for r in got if r.removed_words}
    assert gone[501] > 200 and not any(i in gone for i, _ in clean) and None not in gone


def test_contamination_judges_rows_by_their_own_text(spark):
    item = "a b c d e f"
    rows = [(7, "a b c x x x"), (7, "y y y d e f"), (7, f"z {item}"), (None, item), (None, "nothing here"), (None, None), (8, item), (8, item)]
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(((r.doc_id or 0, r.n_words, r.n_hit) for r in got)) == sorted([(7, 6, 0), (7, 6, 0), (7, 7, 6), (0, 6, 6), (0, 2, 0), (0, 0, 0), (8, 6, 6), (8, 6, 6)])


def test_licenses_of_repeated_rows(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "Released under the MIT License."), (2, "no such thing")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), classifier=licenses.train()).collect()
    assert collections.Counter((r.doc_id, tuple(r.families)) for r in got) == {(1, ("MIT",)): 2, (None, ("MIT",)): 1, (2, ()): 1}


def test_rules_of_repeated_rows_and_their_sample(spark):
    rng = random.Random(6)
    texts = [prose(rng, 80), prose(rng, 80), prose(rng, 80) + " ###" * 60, None, "", "a b " * 4000]
    rows = [(i % 4 if i % 5 else None, texts[i % 6], "clash") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = quality_rules.judge(df).collect()
    assert len(got) == 600
    verdicts = {t: {r.kept for r in got if r.text == t} for t in texts}
    assert all(len(v) == 1 for v in verdicts.values()) and verdicts[texts[0]] == {True} and verdicts[texts[2]] == {False} and verdicts[None] == {False}
    plan = quality_rules.plan(df, quality_rules.production_rules(), 50, shape=lambda d: quality_rules.measures(d))
    assert sorted(plan.order) == sorted(r.name for r in quality_rules.production_rules()) and all(s > 0 for s in plan.seconds.values())


def test_a_dear_rule_goes_last(spark):
    df = spark.createDataFrame([(i, " ".join(str(n) for n in range(i % 50, i % 50 + 200))) for i in range(400)], "doc_id long, text string")
    dear = F.size(F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.sha2(F.concat(F.col("text"), i.cast("string")), 256)))) < 0
    rules = [quality_rules.Rule("dear", dear | (F.col("doc_id") % 2 == 0)), quality_rules.Rule("cheap", F.col("doc_id") % 2 == 0)]
    assert quality_rules.plan(df, rules, 400, repeats=3).order == ["cheap", "dear"]


def brute_links(rows):
    """reply_to by (conv, turn): the earlier turn that most of the shallowest linked units (passages and lines) come from."""
    fold = lambda s: re.sub(r"\s+", " ", s.lower()).strip()

    def units(text, quoted):
        lines = [(len(m.group().replace(" ", "").replace("\t", "")) if (m := re.match(r"(?:[ \t]*>)+", x)) else 0, re.sub(r"^(?:[ \t]*>)+[ \t]?", "", x)) for x in (text or "").split("\n")]
        runs, last = [], None
        for level, x in lines:
            if not x.strip():
                last = None
                continue
            if level != last:
                runs.append([level, []])
            runs[-1][1].append(x)
            last = level
        out = [(lv, fold(" ".join(xs))) for lv, xs in runs] + [(lv, fold(x)) for lv, x in lines if len(fold(x)) >= 2]
        return [(lv, p) for lv, p in out if p and (lv > 0) == quoted]

    own = collections.defaultdict(dict)
    for c, t, text in rows:
        for _, p in units(text, False):
            own[c][p] = min(own[c].get(p, t), t)
    out = {}
    for c, t, text in rows:
        votes = collections.Counter((lv, own[c][p]) for lv, p in units(text, True) if own[c].get(p, t) < t)
        if votes:
            out[c, t] = max(votes, key=lambda v: (-v[0], votes[v], v[1]))[1]
    return out


def test_quotes_planted_in_the_conversations(spark):
    rng = random.Random(7)
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "text").orderBy("conv_id", "turn").collect()
    by_conv, rows = collections.defaultdict(list), []
    for c, t, text in table:
        if by_conv[c] and rng.random() < 0.7:
            _, _, source = rng.choice(by_conv[c])
            part = [x for x in (source or "").split("\n") if x.strip()]
            part = [rng.choice(part)] if part and rng.random() < 0.5 else part
            text = "\n".join("> " + x.upper() if rng.random() < 0.3 else "> " + x for x in part) + "\n" + (text or "")
        by_conv[c].append((c, t, text))
        rows.append((c, t, text))
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(5)).collect()
    want = brute_links(rows)
    assert len(want) > 20
    assert {(r.conv_id, r.turn): r.reply_to for r in got if r.reply_to is not None} == want
    assert not any(line.startswith(">") for r in got for line in (r.text or "").split("\n"))


def test_fenced_code_is_no_quote(spark):
    code = "```\n> prompt line\n>>> 1 + 1\n```"
    rows = [(1, 0, "hello there"), (1, 1, f"{code}\nno quote"), (1, 2, f"> hello there\n{code}\nan answer"), (1, 3, "> ```\n> quoted code\n> ```\nyes"), (1, 4, "```\n> never closed")]
    got = {r.turn: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert got[1].text == f"{code}\nno quote" and got[1].n_quotes == 0
    assert got[2].text == f"{code}\nan answer" and (got[2].reply_to, got[2].n_quotes) == (0, 1)
    assert got[3].text == "yes" and got[3].n_quotes == 1
    assert got[4].text == "```" and got[4].unlinked == ["never closed"]


def test_very_long_message_and_reply_order(spark):
    long = "\n".join(f"line number {n}" for n in range(20_000))
    rows = [(1, 0, "user", "first"), (1, 1, "user", long), (1, 2, None, "> first\nto the first"), (1, 3, "assistant", "> line number 19999\nto the long one"), (1, 3, "assistant", "> line number 19999\nto the long one"), (0, 5, "user", None)]
    linked = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = quotes.conversations(linked).collect()
    assert [(r.conv_id, r.turn, r.opens) for r in got] == [(0, 5, True), (1, 0, True), (1, 2, False), (1, 1, True), (1, 3, False), (1, 3, False)]
    assert got[2].chat == "<|user|>\nto the first\n" and got[0].chat == "<|user|>\n\n"


def test_pipeline_of_nothing_and_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    shape = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id string, text_id string"
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "a/benchmark.parquet"))
    spark.createDataFrame([], shape).write.parquet(str(tmp_path / "a/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).collect() == []
    text = prose(rng, 90)
    rows = [(1, text), (1, text), (2, text), (None, prose(rng, 90)), (3, None), (4, "")]
    spark.createDataFrame([(i, t, None, None, None, "x", "x", "x") for i, t in rows], shape).write.parquet(str(tmp_path / "b/documents.parquet"))
    spark.createDataFrame([(1, "a b"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "b/benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "b")).select("doc_id").distinct().collect()
    assert {r.doc_id for r in got} == {1, None}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tessera.llm import common

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.scratch_root(session)


def test_swept_removes_what_was_written_meanwhile(spark):
    import glob

    from tessera.llm import common

    kept = common.materialize(spark.range(3), "kept")
    before = set(glob.glob(common.scratch_root(spark).removeprefix("file://") + "/*"))
    with common.swept(spark):
        n = common.materialize(spark.range(5), "gone").count()
    assert n == 5 and set(glob.glob(common.scratch_root(spark).removeprefix("file://") + "/*")) == before and kept.count() == 3
