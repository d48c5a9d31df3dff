"""Spelling variants: words of a corpus that are one edit from a much more frequent one.

Near words are found with positional q-gram inverted indexes. A word is put where its variants are: two words one edit apart
share all before the place of the edit and all behind it, so either their first or their last half is the same. Words that
share a half (of the shorter one's length) form a block; a block that holds too many words is cut again, at the middle of the
part that is not yet known to be shared, and so on. Within a block, the parts that may differ are indexed by their q-grams and
the grams' places. Each word merges the postings of its own grams with a heap, only those of its length and the next and at
the places that one edit allows, keeps the words that share enough of them for one edit, and verifies these.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heapreplace, heappop

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, small_batches
from .streams import by_key, rows

#: Words that a block may hold before it is cut again: bounds a task's memory, changes no result.
BLOCK = 50_000
#: Different runs that a task counts before it passes them on.
HELD = 400_000
#: In the contract's words, a run's crc32 divided by this loses a character.
DIVISOR = 199


def _count_runs(least: int):
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for key, text in rows(batches):
            seed = zlib.crc32(f"{'' if key is None else key}:".encode())
            # bytes.lower() knows A-Z only
            for w, n in Counter(runs.findall((text or "").encode().lower().decode())).items():
                h = zlib.crc32(w.encode(), seed)
                if h % DIVISOR == 0:
                    at = h % len(w)
                    w = w[:at] + w[at + 1 :]
                    if len(w) < least:
                        continue
                counts[w] += n
            if len(counts) > HELD:
                yield batch()
        if counts:
            yield batch()

    return run


def vocabulary(docs: DataFrame, letters: int = 6, least: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of at least `letters` code points and `least` occurrences over all documents.

    Runs of letters are maximal and lower-cased in A-Z; shorter ones cannot become a word. Null texts have none; a null key
    counts as an empty one; repeated rows count again.
    """
    small_batches(docs.sparkSession)
    runs = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(_count_runs(letters), "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _block(size: Column, a: Column, z: Column) -> Column:
    """A block's row: what the word shares with the others of the block; `size` is the shorter words' length and [a, z) the part
    of theirs that may differ."""
    shared = F.concat(F.substring("word", F.lit(1), a), F.lit(" "), F.right("word", size - z))
    return F.struct(size.cast("int").alias("size"), a.cast("int").alias("a"), z.cast("int").alias("z"), shared.alias("shared"))


def _halves(size: Column, a: Column, z: Column) -> Column:
    middle = F.floor((a + z) / 2)
    return F.array(_block(size, middle, z), _block(size, a, middle))


def blocks(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """(size, a, z, shared, word, n): each word in its two blocks of its own length and in the two of the length below. Blocks of
    more than `most` words are cut again while more than a character of theirs is open; no pair is lost by it."""
    zero, length = F.lit(0), F.length("word")
    first = F.concat(_halves(length, zero, length), _halves(length - 1, zero, length - 1))
    now = materialize(words.select("word", "n", F.explode(first).alias("b")).select("b.*", "word", "n"), "blocks")
    key = ["size", "a", "z", "shared"]
    done = []
    while True:
        large = materialize(now.groupBy(*key).count().filter((F.col("count") > most) & (F.col("z") - F.col("a") > 1)).select(*key), "large")
        if large.isEmpty():
            break
        done.append(now.join(large, key, "left_anti"))
        again = now.join(large, key, "left_semi").select("word", "n", F.explode(_halves(F.col("size"), F.col("a"), F.col("z"))).alias("b"))
        now = materialize(again.select("b.*", "word", "n"), "blocks")
    for d in done:
        now = now.unionByName(d)
    return now


def one_edit(s: str, t: str) -> int:
    """Place of the only difference of s and t, where t is as long as s or longer by one; -1 if there is none or more than one."""
    e = 0
    while e < len(s) and s[e] == t[e]:
        e += 1
    if len(s) == len(t):
        return e if e < len(s) and s[e + 1 :] == t[e + 1 :] else -1
    return e if s[e:] == t[e + 1 :] else -1


def _merged(lists: list[list[int]], least: int) -> Iterator[int]:
    """Numbers that stand in at least `least` of the ascending lists: a merge with a heap of their heads."""
    if len(lists) < least:
        return
    heads = [(x[0], k, 0) for k, x in enumerate(lists)]
    heapify(heads)
    now, got = -1, 0
    while heads:
        x, k, at = heads[0]
        if x != now:
            if got >= least:
                yield now
            now, got = x, 0
        got += 1
        if at + 1 < len(lists[k]):
            heapreplace(heads, (lists[k][at + 1], k, at + 1))
        else:
            heappop(heads)
    if got >= least:
        yield now


def near_pairs(members: list[str], size: int, a: int, z: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of a block's members whose only difference lies in the part [a, z) of the shorter; i is the shorter, or the
    earlier of two of one length. A pair that several blocks hold is given by one of them."""
    tail = size - z
    index: dict[tuple[int, int, str], list[int]] = defaultdict(list)
    grams: list[list[str]] = []
    # the open part between two marks, in pairs of characters: a part of m characters has m + 1 of them
    for j, w in enumerate(members):
        part = f"\x01{w[a : len(w) - tail]}\x02"
        own = [part[p : p + 2] for p in range(len(part) - 1)]
        grams.append(own)
        for p, g in enumerate(own):
            index[len(w) - size, p, g].append(j)
    none: list[int] = []
    open_ = z - a
    for i, w in enumerate(members):
        if len(w) != size:
            continue
        # an exchanged character costs two grams at most and moves none
        if open_ > 1:
            close = _merged([x for p, g in enumerate(grams[i]) if (x := index.get((0, p, g), none))], open_ - 1)
        else:
            close = (j for j in range(len(members)) if len(members[j]) == size)
        for j in close:
            if j > i and a <= (e := one_edit(w, members[j])) < z:
                yield i, j
        # an inserted one costs one, and moves those behind it by one place
        longer = [x for p, g in enumerate(grams[i]) for q in (p, p + 1) if (x := index.get((1, q, g), none))]
        for j in _merged(longer, open_):
            e = one_edit(w, members[j])
            # between a and z; the place a itself belongs to the block before, if there is one
            if a + (a > 0) <= e <= z:
                yield i, j


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[str, int, int, str]] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "form_n", "form"])

    for (size, a, z, _), mine in by_key(batches, 4):
        members, counts = [], []
        for w, n in mine:
            members.append(w)
            counts.append(n)
        if len(members) < 2:
            continue
        near: Counter[int] = Counter()
        best: dict[int, tuple[int, str]] = {}
        for pair in near_pairs(members, size, a, z):
            for x, y in (pair, pair[::-1]):
                near[x] += 1
                this = (-counts[y], members[y])
                if x not in best or this < best[x]:
                    best[x] = this
        out += ((members[x], k, -best[x][0], best[x][1]) for x, k in near.items())
        if len(out) >= 10_000:
            yield batch()
    if out:
        yield batch()


def near_words(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """(word, n_near, form_n, form): for each word with near words their number and the most frequent one (ties: the smallest)."""
    key = ["size", "a", "z", "shared"]
    held = blocks(words, most).select(*key, "word", "n").repartition(*key).sortWithinPartitions(*key)
    found = held.mapInArrow(_near, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms; forms has (word, form), without words that have none.

    Chains are halved in each round: a form is replaced by the form of that form. Forms grow in frequency, so chains are short
    and end.
    """
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        now = materialize(now, "roots")
        step = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        if step.filter("next is not null").isEmpty():
            return now
        now = step.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(docs: DataFrame, letters: int = 6, least: int = 5, times: int = 5, key: str = "doc_id", text: str = "text", most: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary.

    Two words are near if one inserted, deleted or replaced code point makes them equal. A word's form is its most frequent near
    word (ties: the smallest in code-point order) if that occurs at least `times` as often; root follows forms to the last. An
    empty table, and one without words, gives no row; extra columns are not read. See vocabulary() for nulls.
    """
    words = materialize(vocabulary(docs, letters, least, key, text), "vocabulary")
    found = materialize(words.join(near_words(words, most), "word", "left"), "near")
    has = F.col("form_n") >= times * F.col("n")
    formed = found.filter(has).select("word", "form")
    out = found.join(roots(formed), "word", "left")
    return out.select("word", F.when(has, F.col("form")).alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("form_n")).alias("form_n"))


#: DuckDB form of spelling_variants() with its defaults: crc32 from its table of 256, near words by what is left without one character.
ORACLE = rf"""
WITH RECURSIVE bits AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) v(i)),
r AS (SELECT d, w, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) GROUP BY ALL),
h AS (SELECT w, n, xor(list_reduce(list_transform(range(1, strlen(d) + strlen(w) + 2), lambda i: CAST(('0x' || substr(hex(encode(d || ':' || w)), 2 * i - 1, 2)) AS BIGINT)), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) AS h FROM r, bits WHERE length(w) >= 6),
c AS (SELECT w AS word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM h) WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5),
g AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM c)),
p AS (SELECT a.word, b.word AS near, b.n FROM g a JOIN g b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, g.word, g.n FROM c JOIN g ON c.word = g.rest UNION SELECT g.word, c.word, c.n FROM c JOIN g ON c.word = g.rest),
b AS (SELECT word, count(*) AS n_near, max(n) AS form_n, min_by(near, (-n, near)) AS form FROM p GROUP BY word),
f AS (SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * c.n THEN form_n END AS form_n, CASE WHEN form_n >= 5 * c.n THEN form END AS form FROM c LEFT JOIN b USING (word)),
w AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT w.word, f.form, k + 1 FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL),
z AS (SELECT word, max_by(root, k) AS root FROM w GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN z USING (word)
"""
