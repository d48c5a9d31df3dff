"""Phrase collocation mining: frequent phrases of a language whose parts occur together more often than apart.

Counting is suffix-sigma: every word occurrence gives one suffix, cut to max_n words; suffixes are shuffled by language and
first word and sorted in reverse order, and one pass with one stack of open prefixes counts every prefix of theirs. A task
sums up equal suffixes before it sends them, all those of one first word in a row. A first word of more than its share of the
occurrences is dealt to several places by its second word; the counts of the word itself are summed up afterwards. Counts of
the parts of a phrase are joined to it when all counting is done.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, small_batches
from .streams import by_key

#: Tokens that a task sums up before it sends its suffixes: bounds its memory, changes no result.
SLICE = 1_500_000
#: Occurrences of a first word that go to one place.
SHARE = 200_000
#: First words that are dealt to several places are at most so many, whatever the input: what is broadcast is bounded by it.
MOST_HOT = 1_000_000
#: Control characters 10 to 13 and the marks of a sentence end a piece; a tab separates words as a blank does.
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\x0d\x09", b"\n" * 9 + b" ")
_END = b"\n"


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, with b"\\n" between its pieces; a null text has none."""
    if not text:
        return []
    return [t for t in text.encode().lower().translate(_ENDS).replace(b"\n", b" \n ").split(b" ") if t]


def _slices(batches: Iterable[pa.RecordBatch], ahead: int, most: int) -> Iterator[tuple[str, dict[bytes, int], np.ndarray, int]]:
    """(lang, number of each word, numbers, own) for parts of at most `most` tokens and the `ahead` tokens after them; the first
    `own` tokens belong to the part. Number 0 is the end of a piece; texts end with one."""
    held: dict[str, list[bytes]] = {}

    def part(lang: str, words: list[bytes], own: int) -> tuple[str, dict[bytes, int], np.ndarray, int]:
        number: dict[bytes, int] = {_END: 0}
        put = number.setdefault
        return lang, number, np.fromiter((put(w, len(number)) for w in words), np.int64, len(words)), own

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = held.setdefault(lang, [])
            words += tokens(text)
            words.append(_END)
            if len(words) > most:
                at = 0
                while len(words) - at > most:
                    yield part(lang, words[at : at + most + ahead], most)
                    at += most
                held[lang] = words[at:]
    for lang, words in held.items():
        yield part(lang, words, len(words))


def _count_words(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, number, ids, own in _slices(batches, 0, most):
            n = np.bincount(ids[:own], minlength=len(number))[1:]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(list(number)[1:], pa.binary()), pa.array(n, pa.int64())], ["lang", "first", "n"])

    return run


def _suffixes(hot: dict[tuple[str, bytes], int], max_n: int, most: int):
    """Function of a task: (lang, first, place, rest, n) with all different suffixes of one first word; place is 0 for a word that is
    not dealt out. rest has the suffixes without it in reverse order, a line each, and n their counts. Each word of a suffix is
    followed by a blank, so that a prefix in words is a prefix in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, number, ids, own in _slices(batches, max_n - 1, most):
            # numbers in reverse order of the words; 0 stays the end of a piece
            known = sorted((w + b" " for w in number if w != _END), reverse=True)
            size = len(known) + 1
            place_of = dict(zip(known, range(1, size), strict=True))
            ids = np.fromiter((place_of.get(w + b" ", 0) for w in number), np.int64, size)[ids]
            names = np.array([b"", *known], dtype=object)
            starts = np.flatnonzero(ids[:own])
            padded = np.concatenate([ids, np.full(max_n, 0)])
            # a word after an end is none, and comes last in reverse order; equal suffixes get one number, word by word
            alive, digits = np.ones(len(starts), bool), [ids[starts]]
            for k in range(1, max_n):
                alive = alive & (padded[starts + k] > 0)
                digits.append(np.where(alive, padded[starts + k], size))
            key = digits[0]
            for k in range(1, max_n):
                if k > 1 and (size + 1) ** (k + 1) >= 2**63:
                    _, key = np.unique(key, return_inverse=True)
                key = key * (size + 1) + digits[k]
            _, at, n = np.unique(key, return_index=True, return_counts=True)
            digits = [np.where(d[at] == size, 0, d[at]) for d in digits]
            rest = np.full(len(n), b"", dtype=object)
            for d in digits[1:]:
                rest = rest + names[d]
            first, place = digits[0], np.zeros(len(n), np.int64)
            for (of, w), places in hot.items():
                if of == lang and (f := place_of.get(w + b" ")):
                    i, j = np.searchsorted(first, [f, f + 1])
                    place[i:j] = [1 + zlib.crc32(names[d]) % places for d in digits[1][i:j]] if max_n > 1 else 1
            if place.any():
                order = np.lexsort((place, first))
                first, place, rest, n = first[order], place[order], rest[order], n[order]
            cut = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (place[1:] != place[:-1])])) if len(n) else np.zeros(0, np.int64)
            ends, n = [*cut[1:].tolist(), len(n)], n.astype("<i8")
            for i in range(0, len(cut), 20_000):
                spans = list(zip(cut[i : i + 20_000].tolist(), ends[i : i + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(spans), pa.string()),
                    pa.array([names[f][:-1] for f in first[cut[i : i + 20_000]]], pa.binary()),
                    pa.array(place[cut[i : i + 20_000]], pa.int32()),
                    pa.array([b"\n".join(rest[x:y]) for x, y in spans], pa.binary()),
                    pa.array([n[x:y].tobytes() for x, y in spans], pa.binary()),
                ], ["lang", "first", "place", "rest", "n"])

    return run


def prefix_counts(suffixes: Iterable[tuple[bytes, int]], longest: int, least: int) -> Iterator[tuple[bytes, int]]:
    """(prefix, count) of the prefixes, with at least `least` occurrences, of different suffixes in reverse order, and of the empty
    prefix, which has all; each word is followed by a blank.

    The stack holds the open prefixes, the shorter below the longer; what no longer fits is popped, and its count goes to the
    one below it. A suffix of `longest` words has nothing above it and is counted without being pushed.
    """
    open_, counts = [b""], [0]
    for suffix, n in suffixes:
        while not suffix.startswith(open_[-1]):
            prefix, count = open_.pop(), counts.pop()
            counts[-1] += count
            if count >= least:
                yield prefix, count
        at, words = len(open_[-1]), len(open_) - 1
        while at < len(suffix):
            at, words = suffix.index(b" ", at) + 1, words + 1
            if words == longest:
                if n >= least:
                    yield suffix, n
            else:
                open_.append(suffix[:at])
                counts.append(0)
        counts[-1] += n
    while len(open_) > 1:
        prefix, count = open_.pop(), counts.pop()
        counts[-1] += count
        if count >= least:
            yield prefix, count
    yield b"", counts[0]


def _count_prefixes(max_n: int, least: int):
    """Function of a task over rows sorted by (lang, first, place): phrases of at least `least` occurrences; those of a lone word in
    one of its places are passed on whatever they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int64()), strict=True)], ["lang", "phrase", "f"])

        for (lang, first, place), mine in by_key(batches, 3):
            total, sums = 0, {}
            for rest, packed in mine:
                n = np.frombuffer(packed, "<i8").tolist()
                total += sum(n)
                if sums:
                    had = sums.get
                    for r, k in zip(rest.split(b"\n"), n, strict=True):
                        sums[r] = had(r, 0) + k
                else:
                    sums = dict(zip(rest.split(b"\n"), n, strict=True))
            if total < least and place == 0:
                continue
            # each row came sorted, so that this merges them
            order = sorted(sums, reverse=True)
            for prefix, f in prefix_counts(zip(order, map(sums.__getitem__, order), strict=True), max_n - 1, least):
                out.append((lang, (first + b" " + prefix)[:-1], f))
            if len(out) >= 10_000:
                yield batch()
        if out:
            yield batch()

    return run


def phrase_counts(docs: DataFrame, max_n: int = 3, least: int = 10, lang: str = "lang", text: str = "text", held: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f), (lang, n)): all phrases of 1 to max_n words that occur at least `least` times within pieces, and
    the word occurrences of each language. Both are written tables.

    Null languages are `und`; null and empty texts have no words; repeated rows count again; other columns are not read. Which
    words are dealt to several places follows from exact counts and only says where suffixes meet.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counted = texts.mapInArrow(_count_words(held), "lang string, first binary, n long").groupBy("lang", "first").agg(F.sum("n").alias("n"))
    words = materialize(counted, "words")
    totals = materialize(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    every = totals.agg(F.sum("n")).first()[0] or 0
    share = max(SHARE, every // MOST_HOT + 1)
    hot = {(r.lang, bytes(r.first)): -(-r.n // share) for r in words.filter(F.col("n") > share).toLocalIterator()}
    sent = texts.mapInArrow(_suffixes(hot, max_n, held), "lang string, first binary, place int, rest binary, n binary")
    key = ["lang", "first", "place"]
    met = sent.repartition(*key).sortWithinPartitions(*(F.col(c).desc() for c in key))
    parts = met.mapInArrow(_count_prefixes(max_n, least), "lang string, phrase binary, f long")
    summed = parts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    phrase = F.col("phrase").cast("string")
    return materialize(summed.select("lang", phrase.alias("phrase"), F.size(F.split(phrase, " ")).alias("words"), "f"), "phrases"), totals


def cohesion(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact: a decimal of 38 digits holds all counts below 10^15."""
    wide = [c.cast("decimal(15,0)") for c in (a, left, right)]
    return F.call_function("div", wide[0] * wide[0] * F.lit(1_000_000).cast("decimal(7,0)"), wide[1] * wide[2])


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, inside_percent: int = 50, top: int = 2000, lang: str = "lang", text: str = "text", held: int = SLICE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to max_n words by score.

    a counts the phrase, l and r the two parts of its worst cut, n all words of the language. A phrase goes if it lies inside a
    longer one that occurs at least inside_percent of 100 times as often. Languages without a phrase have no row; an empty
    table gives none. See phrase_counts() for nulls. held: tokens that a task sums up before it sends them.
    """
    counts, totals = phrase_counts(docs, max_n, least, lang, text, held)
    found = counts.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    # every place inside a longer phrase, by its most frequent one
    sizes = F.sequence(F.lit(2), F.col("words") - 1)
    inside = F.flatten(F.transform(sizes, lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda start: part(start, size))))
    longer = found.filter("words > 2").select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = found.join(longer, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < inside_percent * F.col("a")))
    cuts = kept.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    of = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    scored = cuts.join(of("head", "l"), ["lang", "head"]).join(of("tail", "r"), ["lang", "tail"])
    scored = scored.select("lang", "phrase", "a", F.struct(cohesion(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r").alias("cut"))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = worst.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB form of collocations() with its defaults.
ORACLE = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM w, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
x AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
u AS (SELECT c.lang, c.phrase, a, w, len(w) AS size, unnest(range(1, len(w))) AS i FROM c LEFT JOIN x ON c.lang = x.lang AND c.phrase = x.phrase WHERE most IS NULL OR 100 * most < 50 * a),
s AS (SELECT u.lang, u.phrase, a, i, l.f AS l, r.f AS r, CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score FROM u
  JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(w[1:i], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(w[i + 1:size], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000
"""
