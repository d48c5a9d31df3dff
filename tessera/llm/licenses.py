"""License scans: a trained paragraph classifier over sparse word n-grams, confirmed by comparison with templates.

Units are lines, blocks of lines, and windows of words of several sizes over every block, so that a notice is found wherever it
stands in a line or paragraph. A multinomial logistic regression over hashed words and word pairs names a family or `unknown`;
its probabilities are calibrated by a temperature and a bound fitted on examples it was not trained on. A named family counts
only if the unit also shares enough word pairs with one of the family's templates; of units that overlap, the one nearest to
its template counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: How public licences are commonly announced, by family.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "CC0": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
}
UNKNOWN = "unknown"
#: Buckets of hashed words and pairs.
BUCKETS = 1 << 16
#: Words of the windows: each size is about a quarter over the one before, from the shortest sentence of a template to beyond the longest.
WINDOWS = (5, 6, 7, 9, 11, 14, 18, 23, 29, 36, 45, 56)
#: Least share of a template's pairs in the unit, or of the unit's pairs in a template.
CONFIRM = 0.6
_MUL = np.uint64(0x9E3779B97F4A7C15)


class _Memo(dict):
    """Hash of a word without marks at its ends; 0 for marks alone."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        bare = word.strip(b".,;:!?\"'()[]{}<>*#/-=_")
        h = self[word] = xxhash.xxh3_64_intdigest(bare) | 1 if bare else 0
        return h


def _hashes(memo: _Memo, words: list[bytes]) -> np.ndarray:
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    return h[h != 0]


def _features(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of each word with the next one; the last pair is meaningless and never used."""
    shift = np.uint64(48)
    return (h * _MUL >> shift).astype(np.int64), ((h * _MUL + np.roll(h, -1)) * _MUL >> shift).astype(np.int64)


def _pairs(h: np.ndarray) -> set[int]:
    return set((h[:-1] * _MUL + h[1:]).tolist()) if len(h) > 1 else set(h.tolist())


@dataclass
class Classifier:
    families: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bound: float

    def logits(self, words: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """For spans (from, to) of an array of word hashes, by running sums: the cost does not depend on the spans."""
        one, two = _features(words)
        sums1 = np.vstack([np.zeros(len(self.bias)), np.cumsum(self.weights[one], axis=0, dtype=float)])
        sums2 = np.vstack([np.zeros(len(self.bias)), np.cumsum(self.weights[two], axis=0, dtype=float)])
        a, z = spans[:, 0], spans[:, 1]
        total = sums1[z] - sums1[a] + sums2[np.maximum(z - 1, a)] - sums2[a]
        return total / np.sqrt(np.maximum(1, 2 * (z - a) - 1))[:, None] + self.bias

    def lead(self) -> tuple[np.ndarray, float]:
        """By bucket, and for the bias, the most by which any family can gain on `unknown`."""
        return (self.weights[:, :-1].max(axis=1) - self.weights[:, -1]).astype(float), float(self.bias[:-1].max() - self.bias[-1])

    def probabilities(self, words: np.ndarray, spans: np.ndarray) -> np.ndarray:
        x = self.logits(words, spans) / self.temperature
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)


def _examples(rng: np.random.Generator, per_template: int, unknown: int) -> tuple[list[list[bytes]], list[int]]:
    """Templates with words lost, cut ends, holders and filler; unknown: shuffled licence words, filler, near misses."""
    families = sorted(TEMPLATES)
    letters = list("abcdefghilmnoprstuw")
    filler = lambda n: [("".join(rng.choice(letters, rng.integers(2, 9)))).encode() for _ in range(n)]
    texts, labels = [], []
    vocabulary = sorted({w for ts in TEMPLATES.values() for t in ts for w in t.encode().lower().split()})
    for k, family in enumerate(families):
        for t in TEMPLATES[family]:
            words = t.encode().lower().split()
            for n in range(per_template):
                w = list(words)
                if n and len(w) > 8:
                    w = [x for x in w if rng.random() > 0.06]
                    lo = rng.integers(0, len(w) // 4 + 1)
                    w = w[lo : len(w) - rng.integers(0, len(w) // 4 + 1)]
                if n % 3 == 1:
                    w = [b"copyright", b"(c)", str(rng.integers(1990, 2030)).encode(), *filler(2), *w]
                if n % 3 == 2:
                    w = [*filler(int(rng.integers(0, 4))), *w, *filler(int(rng.integers(0, 4)))]
                texts.append(w)
                labels.append(k)
    misses = ["the driver's license expired last year", "permission to enter the building was granted", "free of charge for any person under the age of ten", "he published a work on the public domain of the city", "all conditions of the contract are subject to change", "version 2.0 of the software was released in may", "version 3 of the program adds a general search", "the apache helicopter landed near the village", "she studied at mit for three years", "licensed electricians work under the general rules of the state"]
    for n in range(unknown):
        kind = n % 4
        if kind == 0:
            w = list(rng.choice(vocabulary, rng.integers(1, 14)))
        elif kind == 1:
            w = filler(int(rng.integers(1, 25)))
        elif kind == 2:
            w = [*filler(int(rng.integers(1, 10))), *list(rng.choice(vocabulary, rng.integers(1, 4))), *filler(int(rng.integers(1, 10)))]
        else:
            w = [*misses[n // 4 % len(misses)].encode().split(), *filler(int(rng.integers(0, 6)))]
        texts.append([bytes(x) for x in w])
        labels.append(len(families))
    return texts, labels


def train(seed: int = 3, per_template: int = 36, unknown: int = 2400, epochs: int = 14, rate: float = 0.5) -> Classifier:
    """Logistic regression by Adagrad, then temperature and bound on examples drawn anew. The same seed gives the same classifier."""
    memo, rng = _Memo(), np.random.default_rng(seed)
    families = [*sorted(TEMPLATES), UNKNOWN]

    def drawn(*sizes: int) -> tuple[list[np.ndarray], np.ndarray]:
        texts, labels = _examples(rng, *sizes)
        found = [(_hashes(memo, w), y) for w, y in zip(texts, labels, strict=True)]
        return [h for h, _ in found if len(h)], np.array([y for h, y in found if len(h)])

    sets, labels = drawn(per_template, unknown)
    c = Classifier(families, np.zeros((BUCKETS, len(families)), np.float32), np.zeros(len(families)), 1.0, 0.5)
    gw, gb = np.full_like(c.weights, 1e-2), np.full(len(families), 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(sets))
        for lo in range(0, len(order), 64):
            own = order[lo : lo + 64]
            words = np.concatenate([sets[i] for i in own])
            ends = np.cumsum([len(sets[i]) for i in own])
            spans = np.c_[np.r_[0, ends[:-1]], ends]
            g = c.probabilities(words, spans)
            g[np.arange(len(own)), labels[own]] -= 1
            g /= len(own)
            size = np.diff(spans, axis=1)[:, 0]
            each = np.repeat(g / np.sqrt(2 * size - 1)[:, None], size, axis=0).astype(np.float32)
            one, two = _features(words)
            pair = np.ones(len(words), bool)
            pair[ends - 1] = False
            at = np.r_[one, two[pair]]
            used, inverse = np.unique(at, return_inverse=True)
            dw = np.zeros((len(used), len(families)), np.float32)
            np.add.at(dw, inverse, np.concatenate([each, each[pair]]))
            gw[used] += dw * dw
            gb += g.sum(axis=0) ** 2
            c.weights[used] -= rate * dw / np.sqrt(gw[used])
            c.bias -= rate * g.sum(axis=0) / np.sqrt(gb)
    sets, labels = drawn(6, 800)
    ends = np.cumsum([len(s) for s in sets])
    words, spans = np.concatenate(sets), np.c_[np.r_[0, ends[:-1]], ends]
    fit = []
    for temperature in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0):
        c.temperature = temperature
        fit.append((-np.log(c.probabilities(words, spans)[np.arange(len(labels)), labels] + 1e-12).mean(), temperature))
    c.temperature = min(fit)[1]
    p = c.probabilities(words, spans)
    others = p[labels == len(families) - 1][:, :-1].max(axis=1)
    # of units without a licence at most one in a hundred passes the bound
    c.bound = float(min(0.9, max(0.3, np.quantile(others, 0.99))))
    return c


def confirmation(unit: np.ndarray, templates: list[set[int]]) -> tuple[float, float]:
    """Largest share of a template's word pairs in the unit or, for units of five words or more, of the unit's in a template; and
    the largest share of common pairs in those of both."""
    own = _pairs(unit)
    best = near = 0.0
    for t in templates:
        both = len(own & t)
        best = max(best, both / len(t), both / len(own) if len(own) >= 4 else 0.0)
        near = max(near, both / (len(own) + len(t) - both))
    return best, near


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", classifier: Classifier | None = None) -> DataFrame:
    """(key, families, n_units, spans) per row of docs: the sorted families found, the number of units that name one, and
    (family, start, stop, probability, confirmation, source) of each, in characters of the whole text.

    source is paragraph for what the classifier names and the templates confirm, and identifier for SPDX lines, which are read by
    how their identifiers start and are listed apart with a confirmation of 1. Lines and blocks may be of any length. Null, empty
    and blank texts have none. Repeated rows give equal results. Only key and text are read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(classifier or train())
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, memo = shared.value, _Memo()
        lead = c.lead()
        templates = {f: [_pairs(_hashes(memo, t.encode().lower().split())) for t in ts] for f, ts in TEMPLATES.items()}
        known = np.array(sorted(set().union(*(t for ts in templates.values() for t in ts))), np.uint64)
        for b in batches:
            rows = []
            for t in b["t"]:
                raw = (t or "").encode("utf-8", "replace")
                rows.append(_scan_one(raw, c, lead, memo, templates, known))
            out = pd.DataFrame({"k": b["k"], "families": [sorted({s["family"] for s in r}) for r in rows], "n": [len(r) for r in rows], "spans": rows})
            yield out.astype({"families": object, "spans": object})

    schema = f"k {kind}, families array<string>, n long, spans array<struct<family: string, start: long, stop: long, probability: double, confirmation: double, source: string>>"
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, schema)
    return found.select(F.col("k").alias(key), "families", F.col("n").alias("n_units"), "spans")


_SPDX = re.compile(rb"spdx-license-identifier\s*:\s*([^\r\n]*)", re.I)
#: Families by the start of an SPDX identifier; the longest start counts.
_STARTS = {
    "apache-2.0": "Apache-2.0", "mit": "MIT", "bsd": "BSD", "0bsd": "BSD", "gpl-3.0": "GPL-3.0", "gpl-2.0": "GPL-2.0", "lgpl": "LGPL", "agpl": "AGPL", "mpl-2.0": "MPL-2.0", "isc": "ISC", "unlicense": "Unlicense",
    "cc0": "CC0", "cc-by": "CC-BY", "cc-by-sa": "CC-BY-SA", "cc-by-nc": "CC-BY-NC",
}


def spdx_families(line: bytes) -> list[str]:
    """Families of the identifiers of an SPDX line; what follows WITH is an exception and none of them."""
    m = _SPDX.search(line)
    ids = re.findall(r"(?:\bwith\s+)?[a-z0-9.+-]+", m[1].decode("utf-8", "replace").lower()) if m else []
    # an identifier ends its start: mit, mit-0, but not mitre
    fits = [[s for s in _STARTS if re.match(re.escape(s) + r"(?:[-+]|$)", i)] for i in ids]
    return sorted({_STARTS[max(f, key=len)] for f in fits if f})


def _windows(a: int, z: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows (from, to) of a block of words: of every size that is less than the block, a sixth of it apart, the last at its end."""
    for size in WINDOWS:
        if size >= z - a:
            break
        start = np.r_[np.arange(a, z - size, max(1, size // 6)), z - size]
        yield start, start + size


def _scan_one(raw: bytes, c: Classifier, lead: tuple[np.ndarray, float], memo: _Memo, templates: dict[str, list[set[int]]], known: np.ndarray) -> list[dict]:
    lines = raw.split(b"\n")
    hashed = [_hashes(memo, x.lower().split()) if x else np.zeros(0, np.uint64) for x in lines]
    size = np.array([len(h) for h in hashed])
    if not size.sum():
        return []
    words = np.concatenate(hashed)
    at = np.r_[0, np.cumsum(size)]
    # a unit that is confirmed has a word pair of some template
    pairs = words[:-1] * _MUL + words[1:]
    near = known[np.minimum(np.searchsorted(known, pairs), len(known) - 1)] == pairs
    named = {i: f for i, x in enumerate(lines) if b":" in x and (f := spdx_families(x))}
    if not near.any() and not named:
        return []
    full = np.flatnonzero(np.diff(np.r_[0, [bool(x.strip()) for x in lines], 0]))
    blocks = [(at[i], at[j]) for i, j in zip(full[::2].tolist(), full[1::2].tolist(), strict=True) if at[j] > at[i]]
    found = [(at[:-1][size > 0], at[1:][size > 0]), tuple(np.array(blocks).T), *(w for b in blocks for w in _windows(*b))]
    a, z = (np.concatenate([f[n] for f in found]) for n in (0, 1))
    hits = np.r_[0, np.cumsum(near), near.sum()]
    some = hits[z - 1] > hits[a]
    a, z = a[some], z[some]
    # units that cannot be anything but unknown go by a bound, which needs one running sum instead of one for each family
    one, two = _features(words)
    gain, pair = np.r_[0, np.cumsum(lead[0][one])], np.r_[0, np.cumsum(lead[0][two])]
    most = (gain[z] - gain[a] + pair[z - 1] - pair[a]) / np.sqrt(2 * (z - a) - 1) + lead[1]
    spans = np.unique(np.c_[a, z][most > -1e-6], axis=0)
    lines_named = np.array([(at[i], at[i + 1]) for i in named]).reshape(-1, 2)
    if not len(spans) and not len(lines_named):
        return []
    p = c.probabilities(words, np.concatenate([lines_named, spans]).astype(int))
    bounds = [m.span() for m in re.finditer(rb"\S+", raw) if memo[m[0].lower()]]
    taken = np.zeros(len(words), bool)
    out: list[dict] = []

    def add(family: str, i: int, j: int, probability: float, confirmed: float, source: str) -> None:
        taken[i:j] = True
        start, stop = bounds[i][0], bounds[j - 1][1]
        first = len(raw[:start].decode("utf-8", "replace"))
        out.append({"family": family, "start": first, "stop": first + len(raw[start:stop].decode("utf-8", "replace")), "probability": float(probability), "confirmation": float(confirmed), "source": source})

    for k, (i, fs) in enumerate(named.items()):
        for f in fs:
            add(f, int(at[i]), int(at[i + 1]), p[k, c.families.index(f)], 1.0, "identifier")
    p = p[len(lines_named) :]
    best = p[:, :-1].argmax(axis=1)
    sure = p[np.arange(len(p)), best]
    likely = []
    for k in np.flatnonzero((sure >= c.bound) & (p.argmax(axis=1) != p.shape[1] - 1)).tolist():
        i, j = spans[k].tolist()
        confirmed, close = confirmation(words[i:j], templates[c.families[best[k]]])
        if confirmed >= CONFIRM:
            likely.append((-close, -confirmed, i, j, k))
    for _, confirmed, i, j, k in sorted(likely):
        if not taken[i:j].any():
            add(c.families[best[k]], i, j, sure[k], -confirmed, "paragraph")
    return sorted(out, key=lambda s: (s["start"], s["family"]))
