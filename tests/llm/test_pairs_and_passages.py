"""Join, packing, substring deduplication, decontamination and quality rules against brute force, with edge cases."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import chunk_dedup, decontaminate, ngram_join, packing, quality_rules

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = [a + b for a in "bcdfghlmnprst" for b in ("an", "et", "ix", "ol", "um", "ara", "eno")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def corpus(seed=1):
    """Documents with exact and near copies, shared passages, edge texts and a clashing extra column."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(5, 260)) for _ in range(60)]
    for i in range(0, 40, 2):
        w = texts[i].split()
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = "EDITED"
        texts.append(" ".join(w))
    base = prose(rng, 300).split()
    for k in range(90):  # a group that is larger than what is paired within a bucket
        w = list(base)
        w[rng.randrange(300)] = f"edit{k}"
        texts.append(" ".join(w))
    passage = prose(rng, 70)
    texts += [f"{prose(rng, 60)}\n{passage}\n{prose(rng, 60)}" for _ in range(5)]
    texts += [texts[0]] * 3 + [None, "", "  \n\t ", "one", "one", "One two", "É é É", "x" * 4000, "word " * 3000, prose(rng, 6000)]
    return [(i, t, "clash", 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, n_words int").repartition(3)


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_join_matches_all_pairs(docs, rows, k, percent):
    sets = {i: shingles(t, k) for i, t, *_ in rows}
    up, links = {i: i for i in sets}, collections.Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
                links[i] += 1
                links[j] += 1
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_components(docs, k, percent).collect()}
    assert got == {i: (len(s), root(i), links[i]) for i, s in sets.items()}


def test_join_of_blocks(docs, rows, monkeypatch):
    """Whole sets that meet in many small blocks give the same result."""
    want = sorted(map(tuple, ngram_join.jaccard_components(docs).collect()))
    monkeypatch.setattr(ngram_join, "BLOCK", 3000)
    assert sorted(map(tuple, ngram_join.jaccard_components(docs).collect())) == want


def test_join_of_nothing(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.jaccard_components(none).collect())) == [(1, 0, 1, 0), (2, 0, 2, 0)]


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = {i: [*e.ids, 1] for (i, *_), e in zip(rows, Tokenizer.from_file(path).encode_batch([t or "" for _, t, *_ in rows], add_special_tokens=False), strict=True)}
    got = packing.pack(docs, path).collect()
    for i, ids in whole.items():
        at = 0
        for p in sorted((p for p in got if p.doc_id == i), key=lambda p: p.start):
            raw = b"".join(x.to_bytes(4, "little") for x in ids[at : at + p.length])
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(raw))
            at += p.length
        assert at == len(ids)
    for pieces in collections.defaultdict(list, {s: [p for p in got if p.sequence_id == s] for s in {p.sequence_id for p in got}}).values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0 and len(pieces) <= 64


def test_packing_limits(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, prose(rng, 9)) for i in range(120)], "doc_id long, text string").coalesce(1)
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), packing.Limits(256, 4, 200)).collect()
    per = collections.defaultdict(list)
    for p in got:
        per[p.sequence_id].append(p)
    assert all(len(ps) <= 4 and sum(p.length for p in ps) <= 256 and sum(p.loss_tokens for p in ps) <= 200 for ps in per.values())
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).collect() == []


@pytest.mark.parametrize("text", ["It's a test... isn't it?! (yes)", "Ünï çødé, ΣΑΣ İstanbul ﬁ H̱ ẖ", "<|endoftext|> a<|startoftext|>b", "10,000 #hash @x", "日本語 テスト。", "a b c", "x" * 3000])
def test_word_ids_equal_whole_text(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    raw = packing.WordIds(path).texts([text])[0]
    assert [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)] == [*want, 1]


def test_dedup_removes_later_passages(docs, rows):
    got = {r.doc_id: r for r in chunk_dedup.dedup(docs).collect()}
    assert set(got) == {i for i, *_ in rows}
    text = {i: t for i, t, *_ in rows}
    seen = set()
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        windows = [tuple(w[k : k + 51]) for k in range(len(w) - 50)]
        if any(x in seen for x in windows):
            assert got[i].removed_words > 0, i
        seen.update(windows)
        if got[i].removed_words == 0:
            assert got[i].text == t
        kept, at = "", 0
        for s in got[i].spans:
            kept += t[at : s.start]
            at = s.stop
        assert got[i].text == (None if t is None else kept + t[at:])
        assert got[i].n_words == len(w)
    first = next(i for i, t in text.items() if t and t.count("\n") == 2)
    assert got[first].removed_words == 0


def test_dedup_cases(spark):
    rng = random.Random(5)
    p, extra = prose(rng, 60), prose(rng, 10)
    df = spark.createDataFrame([(1, f"{p}\n{extra}\n{p}"), (None, p), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in chunk_dedup.dedup(df).collect()}
    assert got[1].removed_words >= 30 and got[None].removed_words == 0 and got[2].text is None and got[3].text == ""
    assert chunk_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_chunks_resist_insertions():
    rng = random.Random(6)
    raw = prose(rng, 2000).encode()
    moved = b"inserted words here " + raw
    a, b = (set(chunk_dedup.digests(x, chunk_dedup.cuts(x)).tolist()) for x in (raw, moved))
    assert len(a & b) >= len(a) - 3


def windows_of(t, n=13):
    w = re.findall("[^\x00-/:-`{-\x7f]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return w, [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


@pytest.mark.parametrize("broadcast", [True, False])
def test_contamination(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "broadcast_if_small", lambda df, *_: F.broadcast(df) if broadcast else df)
    rng = random.Random(8)
    items = [(1, prose(rng, 40)), (2, prose(rng, 13)), (10, "Short Item-text"), (3, None), (4, "?!"), (5, "never seen wordsxyz")]
    docs = [(0, f"{prose(rng, 30)} {items[0][1].upper()} end"), (1, f"a {items[1][1]}, b {items[1][1]}"), (2, "so SHORT item text it is"), (3, None), (4, ""), (5, prose(rng, 500)), (6, f"{prose(rng, 900)} {items[1][1]}"), (7, " ".join(items[0][1].split()[5:18]))]
    i = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, n_hit string")
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, words string")
    got = {r.doc_id: r for r in decontaminate.contamination(d, i).collect()}
    wins = {k: windows_of(t)[1] for k, t in items}
    for k, t in docs:
        w, _ = windows_of(t)
        hit, found = set(), set()
        for item, ws in wins.items():
            for win in ws:
                for s in range(len(w) - len(win) + 1):
                    if tuple(w[s : s + len(win)]) == win:
                        hit.update(range(s, s + len(win)))
                        found.add(str(item))
        r = got[k]
        assert (r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) == (len(w), len(hit), len(found), sorted(found), bool(hit) and 20 * len(hit) >= len(w)), k


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), none).collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got] == [(1, 3, 0, False)]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y z gamma"), (2, "beta alpha gamma"), (3, "alpha x x x beta gamma")], "doc_id long, text string")
    phrases = spark.createDataFrame([(1, ["alpha", "beta", "gamma"])], "phrase_id int, words array<string>")
    assert [tuple(r) for r in decontaminate.proximity_matches(docs, phrases, 2).collect()] == [(1, 1, 0, 5)]


def test_rules(spark, docs, rows):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i, t, *_ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        rep = {j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep)), i
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_rule_order_does_not_change_verdicts(spark, docs):
    rules = quality_rules.production_rules()
    a = {r.doc_id: r.kept for r in quality_rules.judge(docs, rules=rules).collect()}
    b = {r.doc_id: r.kept for r in quality_rules.judge(docs, rules=rules[::-1], sample_rows=3).collect()}
    assert a == b
    plan = quality_rules.plan(quality_rules.measures(docs), rules, 50)
    assert sorted(plan.order) == sorted(r.name for r in rules)
    assert quality_rules.judge(docs.limit(0)).collect() == []


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
