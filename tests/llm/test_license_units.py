"""SPDX identifiers and headers inside long blocks."""

import random

import numpy as np
import pytest

from tessera.llm import licenses

WORDS = [a + b for a in "bcdfghlmnprst" for b in ("an", "et", "ix", "ol", "um", "ara", "eno")]
HEADER = ["Permission is hereby granted, free of charge, to any person obtaining", "a copy of this software and associated documentation files, to deal", "in the Software without restriction"]


def lines(rng, n):
    return [" ".join(rng.choice(WORDS) for _ in range(9)) for _ in range(n)]


def test_spdx_identifiers_and_long_blocks(spark):
    rng = random.Random(6)
    want = {
        "GPL-3.0-or-later": ["GPL-3.0"], "BSD-2-Clause": ["BSD"], "GPL-2.0-or-later": ["GPL-2.0"], "LGPL-2.1-only": ["LGPL"], "AGPL-3.0-or-later": ["AGPL"], "CC-BY-3.0": ["CC-BY"], "CC-BY-SA-4.0": ["CC-BY-SA"],
        "(MIT OR Apache-2.0)": ["Apache-2.0", "MIT"], "GPL-2.0-only WITH Classpath-exception-2.0": ["GPL-2.0"], "MITRE": [], "LicenseRef-own": [],
    }
    cases = [(f"// SPDX-License-Identifier: {i}\n\n{lines(rng, 1)[0]}", f) for i, f in want.items()]
    for before, after in ((0, 60), (30, 30), (60, 0), (17, 90)):
        cases.append(("\n".join([*lines(rng, before), *HEADER, *lines(rng, after)]), ["MIT"]))
    cases.append(("\n".join(lines(rng, 300)), []))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [got[i].families for i in range(len(cases))] == [f for _, f in cases]


@pytest.mark.parametrize("n", [1, 5, 6, 40, 300])
def test_windows_cover_a_block(n):
    for start, stop in licenses._windows(10, 10 + n):
        assert start[0] == 10 and stop[-1] == 10 + n and (np.diff(start) <= np.maximum(1, (stop - start)[1:] // 6)).all() and len(set((stop - start).tolist())) == 1


def planted(rng, n, wrap):
    """Every template of ten words or more in n words before and after, wrapped at so many words a line, or not at all."""
    for family, ts in sorted(licenses.TEMPLATES.items()):
        for t in ts:
            if len(t.split()) >= 10:
                words = [*lines(rng, 1 + n // 9)[0].split()[: n % 9], *" ".join(lines(rng, n // 9)).split(), *t.split(), *" ".join(lines(rng, n // 9)).split()]
                yield family, "\n".join(" ".join(words[i : i + wrap]) for i in range(0, len(words), wrap)) if wrap else " ".join(words)


def test_recall_inside_lines_and_paragraphs(spark):
    rng = random.Random(16)
    cases = [(n, wrap, f, t) for n in (0, 20, 50, 100, 200, 1000) for wrap in (0, 4, 8, 12) for f, t in planted(rng, n, wrap)]
    clean = [" ".join(lines(rng, n)) for n in (1, 5, 20, 100) for _ in range(100)] + ["\n".join(lines(rng, 30)) for _ in range(100)]
    rows = [(i, c[-1]) for i, c in enumerate(cases)] + [(10_000 + i, t) for i, t in enumerate(clean)]
    got = {r.doc_id: r.families for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    by = {}
    for i, (n, wrap, f, _) in enumerate(cases):
        by.setdefault((n, wrap), []).append(f in got[i])
    recall = {k: sum(v) / len(v) for k, v in by.items()}
    assert min(recall.values()) >= 0.95, recall
    assert sum(not got[10_000 + i] for i in range(len(clean))) >= 0.99 * len(clean)


def test_windows_against_brute_force():
    """Of a short text, every span of words is classified and confirmed: what is found is among these, and where any is, one is."""
    rng = random.Random(17)
    c, memo = licenses.train(), licenses._Memo()
    templates = {f: [licenses._pairs(licenses._hashes(memo, t.encode().lower().split())) for t in ts] for f, ts in licenses.TEMPLATES.items()}
    known = np.array(sorted(set().union(*(t for ts in templates.values() for t in ts))), np.uint64)
    agree = total = 0
    for _ in range(40):
        notice = rng.choice(rng.choice(list(licenses.TEMPLATES.values()))) if rng.random() < 0.7 else ""
        text = " ".join([*lines(rng, 1)[0].split(), *notice.split(), *lines(rng, 2)[1].split()])
        if "spdx" in text.lower():
            continue
        h = licenses._hashes(memo, text.lower().encode().split())
        spans = np.array([(i, j) for i in range(len(h)) for j in range(i + 2, len(h) + 1)])
        p = c.probabilities(h, spans)
        best = p[:, :-1].argmax(axis=1)
        passed = [(p[k, best[k]], c.families[best[k]]) for k in np.flatnonzero((p[:, :-1].max(axis=1) >= c.bound) & (p.argmax(axis=1) < p.shape[1] - 1)) if licenses.confirmation(h[slice(*spans[k])], templates[c.families[best[k]]])[0] >= licenses.CONFIRM]
        found = licenses._scan_one(text.encode(), c, c.lead(), memo, templates, known)
        assert {s["family"] for s in found} <= {f for _, f in passed}
        total += 1
        agree += bool(found) == bool(passed)
    assert agree >= 0.95 * total
