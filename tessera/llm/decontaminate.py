"""Benchmark decontamination over a distributed positional inverted index, in built-in functions only.

The index holds (term, doc_id, position) for the terms that test items ask for. A phrase is looked up from its rarest
terms: their lists, each shifted by the term's place in the phrase, are intersected; what is left is compared word by word
with the document. Proximity looks the same lists up with a tolerance instead of one shift.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, broadcast_if_small, materialize

#: Words of both sides; bytes of other alphabets belong to words. Capitals are folded word by word afterwards.
_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of a term table that is broadcast: some 30 MB at most.
BROADCAST_ROWS = 300_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


Key = str | list[str]


def _names(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def raw_words(text: Column) -> Column:
    """Words of a text before A-Z is lower-cased; folding a word later gives the same words."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_ANY_CASE), F.lit(0))


def folded_words(text: Column) -> Column:
    return F.transform(raw_words(text), ascii_lower)


def postings(docs: DataFrame, terms: DataFrame, key: Key = "doc_id", text: str = "text") -> DataFrame:
    """The index of docs for terms: (key, position, term), with the other columns of terms along.

    terms is a written table with one or more rows per `term`; it is broadcast where its counted rows are few.
    """
    each = docs.select(*_names(key), F.posexplode(raw_words(F.col(text))).alias("position", "w"))
    return each.select(*_names(key), "position", ascii_lower(F.col("w")).alias("term")).join(broadcast_if_small(terms, BROADCAST_ROWS), "term")


def windows(items: DataFrame, length: int = 13, item: str = "item_id", text: str = "text") -> DataFrame:
    """(window_id, words, items): each different window of `length` words once, with the ids of its items; shorter items are
    one window, items without a word have none."""
    w = folded_words(F.col(text))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - length + 1))
    one = items.select(F.col(item).cast("string").alias("item"), w.alias("w")).filter(F.size("w") > 0)
    each = one.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, length))).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("window_id", F.xxhash64("words"))


def term_counts(docs: DataFrame, vocabulary: DataFrame, key: Key = "doc_id", text: str = "text") -> DataFrame:
    """(term, n): occurrences in docs of each term of vocabulary that occurs at all."""
    return postings(docs, vocabulary, key, text).groupBy("term").agg(F.count("*").alias("n"))


def anchors(wins: DataFrame, counts: DataFrame, per_window: int = 2) -> DataFrame:
    """(term, window_id, size, shift, r, needed): the rarest places of each window, r from 0; needed has a bit for each.

    Windows with a term that never occurs in the corpus are gone.
    """
    placed = wins.select("window_id", F.size("words").alias("size"), F.posexplode("words").alias("shift", "term")).join(counts, "term", "left")
    by_window = Window.partitionBy("window_id")
    ranked = placed.withColumn("absent", F.max(F.col("n").isNull()).over(by_window)).withColumn("r", F.row_number().over(by_window.orderBy("n", "shift")) - 1)
    kept = ranked.filter(~F.col("absent") & (F.col("r") < per_window))
    needed = F.expr(f"shiftleft(1, least(size, {per_window})) - 1")
    return kept.select("term", "window_id", "size", "shift", "r", needed.alias("needed"))


def phrase_matches(docs: DataFrame, wins: DataFrame, key: Key = "doc_id", text: str = "text", per_window: int = 2) -> DataFrame:
    """(key, window_id, start, size): every occurrence of a window in docs, by word number from 0.

    key, one column or several, must identify a text and must not be null. The words of the few documents that are left by
    the intersection are read again and compared; texts are not shuffled unless those documents are many.
    """
    k = _names(key)
    vocabulary = materialize(wins.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    rare = materialize(anchors(wins, materialize(term_counts(docs, vocabulary, k, text), "counts"), per_window), "anchors")
    found = postings(docs, rare, k, text).withColumn("start", F.col("position") - F.col("shift")).filter("start >= 0")
    both = found.groupBy(*k, "window_id", "start", "size", "needed").agg(F.bit_or(F.expr("shiftleft(1, r)")).alias("got"))
    likely = materialize(both.filter("got = needed").select(*k, "window_id", "start", "size"), "likely")
    keys = broadcast_if_small(materialize(likely.select(*k).distinct(), "keys"))
    texts = docs.select(*k, text).join(keys, k, "left_semi").select(*k, F.posexplode(raw_words(F.col(text))).alias("position", "w"))
    expected = likely.join(wins.select("window_id", "words"), "window_id").select(*k, "window_id", "start", "size", F.posexplode("words").alias("i", "word"))
    expected = expected.withColumn("position", F.col("start") + F.col("i"))
    actual = texts.select(*k, "position", ascii_lower(F.col("w")).alias("word"))
    same = expected.join(actual, [*k, "position", "word"], "left_semi")
    return same.groupBy(*k, "window_id", "start", "size").agg(F.count("*").alias("got")).filter("got = size").drop("got")


def proximity_matches(docs: DataFrame, phrases: DataFrame, slop: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, phrase_id, start, end): places where all words of a phrase stand in order with at most slop words between neighbours.

    phrases: (phrase_id, words). The search starts from each phrase's rarest word; each further word is looked up next to
    the span found so far, outward from the rarest. Every place within reach is kept, as a farther one may be the only one
    that the next word is in reach of. Rows of a null key and phrases with a word that occurs nowhere give no match; empty phrases
    and empty texts neither. Rows with one key are taken as one text.
    """
    vocabulary = materialize(phrases.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    placed = phrases.select("phrase_id", F.size("words").alias("size"), F.posexplode("words").alias("i", "term"))
    counts = term_counts(docs, vocabulary, key, text)
    w = Window.partitionBy("phrase_id")
    ranked = placed.join(counts, "term", "left").withColumn("absent", F.max(F.col("n").isNull()).over(w)).filter("not absent")
    first = ranked.withColumn("r", F.row_number().over(w.orderBy("n", "i"))).filter("r = 1").select("term", "phrase_id", "size", F.col("i").alias("from_i"))
    spans = postings(docs, materialize(first, "first"), key, text).select(key, "phrase_id", "size", "from_i", F.col("position").alias("start"), F.col("position").alias("end"))
    spans = materialize(spans, "spans")
    lists = materialize(postings(docs.join(spans.select(key).distinct(), key, "left_semi"), vocabulary, key, text), "lists")
    longest = phrases.agg(F.max(F.size("words"))).first()[0] or 0
    for side in (1, -1):
        for step in range(1, longest):
            i = F.col("from_i") + side * step
            here = spans.withColumn("i", i)
            done = here.filter((F.col("i") < 0) | (F.col("i") >= F.col("size"))).drop("i")
            want = here.filter((F.col("i") >= 0) & (F.col("i") < F.col("size"))).join(placed.select("phrase_id", "i", "term"), ["phrase_id", "i"])
            edge = F.col("end") if side > 0 else F.col("start")
            near = want.join(lists.select(key, "term", "position"), [key, "term"]).filter(((F.col("position") - edge) * side).between(1, slop + 1))
            grown = near.withColumn("end" if side > 0 else "start", F.col("position")).select(key, "phrase_id", "size", "from_i", "start", "end").distinct()
            spans = done.unionByName(grown)
    return spans.select(key, "phrase_id", "start", "end").distinct()


def hits(matches: DataFrame, wins: DataFrame, key: Key = "doc_id") -> DataFrame:
    """(key, n_hit, items): words inside any match, spans [from, to) of such words, and the sorted ids of the items that occur."""
    k = _names(key)
    spans = matches.groupBy(*k).agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("stop")))).alias("s"))
    # a span counts from where the spans before it end
    walk = F.aggregate(
        "s",
        F.struct(F.lit(0).alias("stop"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["stop"], x["stop"]).alias("stop"), (a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(a["stop"], x["start"]))).alias("n")),
    )
    items = matches.select(*k, "window_id").distinct().join(wins.select("window_id", "items"), "window_id")
    listed = items.select(*k, F.explode("items").alias("item")).groupBy(*k).agg(F.array_sort(F.collect_set("item")).alias("items"))
    return spans.select(*k, walk["n"].alias("n_hit"), F.col("s").alias("spans")).join(listed, k)


def contamination(docs: DataFrame, items: DataFrame, length: int = 13, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_words, n_hit, n_items, items (sorted), spans, contaminated (n_hit > 0 and 20 n_hit >= n_words).

    Null and empty texts have no words and are clean; null or empty items have no window. Each row is judged by its own
    text, whatever its key: repeated and null keys are allowed. Without documents or without items nothing is hit. Other
    columns of docs are not read.
    """
    wins = materialize(windows(items, length, item, item_text), "windows")
    # what a row gives depends on its text alone; two digests of key and text stand for it, and spread copies by their keys
    t = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(key).alias("key"), t.alias("text"), F.xxhash64(F.col(key), t).alias("a"), F.xxhash64(t).alias("b"))
    found = materialize(hits(phrase_matches(own, wins, ["a", "b"], "text"), wins, ["a", "b"]), "hits")
    sized = own.select("key", "a", "b", F.size(raw_words(F.col("text"))).cast("long").alias("n_words"))
    out = sized.join(found, ["a", "b"], "left")
    n_hit, items_ = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"), "spans", ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


_FOLD = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
#: DuckDB form of contamination(): windows compared as joined words.
ORACLE = rf"""
WITH i AS (SELECT item_id, regexp_extract_all({_FOLD}, '{WORD}') AS w FROM benchmark),
iw AS (SELECT item_id, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s, w FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 12], ' ') AS g, len(w[s:s + 12]) AS k FROM iw),
d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{WORD}') AS w FROM documents),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, s, dw.k FROM dw JOIN win ON dw.g = win.g AND dw.k = win.k),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
