"""URL filters by a Bloom filter cascade: exact membership in a list for every key of a corpus, without a join.

A URL's keys are its host and each parent domain, each followed by a start of the path. Level 1 encodes the listed keys,
level 2 those unlisted keys of the corpus that level 1 lets through, level 3 the listed keys that level 2 lets through,
and so on until a level has no false positive. Whoever looks a corpus key up needs the levels only: it is listed if and
only if the first level that does not know it is an even one. Level 1 is sized so that about as many false positives are
left as keys are listed; so all levels together are bounded by the list and the logarithm of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, ascii_lower

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty for null or where there is no ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


@dataclass(frozen=True)
class UrlRule:
    """action for the host, all its subdomains and the paths that start with path; path starts with a slash or is empty."""

    action: str
    host: str
    path: str = "/"

    @property
    def key(self) -> str:
        return self.host + self.path


def keys_of(host: Column, path: Column, rules: Iterable[UrlRule]) -> Column:
    """All keys of a URL that a rule of this shape could name: domains of at most as many labels, path starts of the rules' lengths."""
    rules = list(rules)
    most = max(r.host.count(".") + 1 for r in rules)
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted({len(r.path) for r in rules})]), lambda p: p.isNotNull())
    domains = F.array_distinct(F.array(*[F.substring_index(host, ".", -n) for n in range(1, most + 1)]))
    return F.flatten(F.transform(domains, lambda d: F.transform(starts, lambda p: F.concat(d, p))))


@dataclass
class Bloom:
    """A bit array; each level hashes with a seed of its own."""

    seed: int
    hashes: int
    size: int
    bits: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, keys: list[str], rate: float, seed: int) -> Bloom:
        rate = min(max(rate, 1e-12), 0.5)
        size = max(64, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2))
        out = cls(seed, max(1, round(-math.log2(rate))), size, np.zeros((size + 7) // 8, np.uint8))
        if keys:
            at = out._places(keys).ravel()
            np.bitwise_or.at(out.bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        return out

    def _places(self, keys: list[str]) -> np.ndarray:
        raw = b"".join(xxhash.xxh3_128_digest(k.encode(), self.seed) for k in keys)
        h = np.frombuffer(raw, np.uint64).reshape(-1, 2)
        step = np.arange(self.hashes, dtype=np.uint64)
        return ((h[:, :1] + step * (h[:, 1:] | np.uint64(1))) % np.uint64(self.size)).astype(np.int64)

    def has(self, keys: list[str]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        at = self._places(keys)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


@dataclass
class Cascade:
    levels: list[Bloom]

    def listed(self, keys: list[str]) -> np.ndarray:
        """Exact for the keys of the corpus that the cascade was built over and for the listed keys."""
        out = np.zeros(len(keys), bool)
        open_ = np.arange(len(keys))
        for n, level in enumerate(self.levels):
            known = level.has([keys[i] for i in open_])
            out[open_[~known]] = n % 2 == 1
            open_ = open_[known]
        out[open_] = len(self.levels) % 2 == 1
        return out

    @property
    def size_bytes(self) -> int:
        return sum(len(x.bits) for x in self.levels)


def build(universe: DataFrame, listed: Iterable[str]) -> Cascade:
    """universe: one string column, every key of the corpus (repeats and nulls allowed). listed: held by the driver.

    What comes back to the driver are level 1's false positives, about as many as keys are listed; with more than eight
    times as many, level 1 is built anew with more bits. An empty list makes a cascade without levels: nothing is listed.
    """
    mine = sorted(set(listed))
    if not mine:
        return Cascade([])
    column = universe.columns[0]
    keys = universe.filter(F.col(column).isNotNull()).distinct()
    total = keys.count()
    rate = math.sqrt(0.5) * len(mine) / max(total, 1)
    most = 8 * len(mine) + 1000
    while True:
        first = Bloom.of(mine, rate, 1)
        known = set(mine)

        def passing(batches: Iterator[pd.DataFrame], first: Bloom = first, known: set[str] = known) -> Iterator[pd.DataFrame]:
            for b in batches:
                k = b.iloc[:, 0].tolist()
                yield pd.DataFrame({"key": [x for x, y in zip(k, first.has(k), strict=True) if y and x not in known]}, dtype=object)

        false = [r[0] for r in keys.mapInPandas(passing, "key string").take(most + 1)]
        if len(false) <= most:
            break
        rate /= 64
    levels, inside, outside = [first], mine, sorted(false)
    while outside:
        level = Bloom.of(outside, 0.5, len(levels) + 1)
        left = [k for k, y in zip(inside, level.has(inside), strict=True) if y]
        levels.append(level)
        inside, outside = outside, left
    return Cascade(levels)


def judge(df: DataFrame, rules: list[UrlRule], url: str = "url", unlisted: str = "allow") -> DataFrame:
    """df with host, path, rule (key of the longest rule that fits, null: none) and verdict (its action, else `unlisted`).

    Of two rules of the same length the one with the longer host wins. Null urls and urls without :// have empty host and
    path and fit no rule. Repeated rows are judged alike; columns of the added names are replaced.
    """
    parts = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not rules:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(unlisted)})
    by_key = {r.key: r for r in rules}
    if len(by_key) != len({(r.key, r.action) for r in rules}):
        raise ValueError("two rules give one key different actions")
    keyed = parts.withColumn("__keys", keys_of(F.col("host"), F.col("path"), rules))
    universe = keyed.select(F.explode("__keys").alias("key"))
    cascades = [(a, build(universe, [r.key for r in rules if r.action == a])) for a in sorted({r.action for r in rules})]
    shared = df.sparkSession.sparkContext.broadcast(cascades)

    rest = [f for f in keyed.schema.fields if f.name not in ("__keys", "rule", "verdict")]
    schema = T.StructType([*rest, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("__keys").to_pylist()
            flat = list({k for row in rows for k in row})
            action = {}
            for name, cascade in shared.value:
                action.update({k: name for k, y in zip(flat, cascade.listed(flat), strict=True) if y})
            best = [max((k for k in row if k in action), key=lambda k: (len(k), k.find("/")), default=None) for row in rows]
            added = [pa.array(best, pa.string()), pa.array([unlisted if k is None else action[k] for k in best], pa.string())]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in rest], *added], schema.names)

    return keyed.mapInArrow(decide, schema)


#: The rules of the registered query, by (action, host, path).
PRODUCTION_RULES = [UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/")]

ORACLE = f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_PARTS}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{_PARTS}', 2) AS path FROM pages),
r(action, h, s) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT page_id, max_by(h || s, length(h || s) * 1000 + length(h)) AS rule, max_by(action, length(h || s) * 1000 + length(h)) AS action
      FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
