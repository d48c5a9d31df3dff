"""Quality rules as a short-circuit cascade, in built-in functions only.

Every rule is a boolean Column that is true where a document is rejected. On a bounded sample the planner measures how
long each rule takes and how the rules' rejections overlap; it then orders them greedily by rejections per second among
the documents that the rules before have left. The plan is one CASE: a document leaves at its first rejecting rule and
the later, dearer rules are not evaluated for it. The verdict does not depend on the order, only the cost does. What the
cascade saves are the rules; measures() are results of their own and are computed for every document.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, let, materialize

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """reject: true where the rule rejects; null counts as false."""

    name: str
    reject: Column


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window which occurs twice or more in the array w, the first occurrence included.

    Windows are compared by 64-bit hashes. Sorting (hash, place) pairs brings equal windows together, so the cost is
    n log n for any text; texts without a repeated window stop after a hash-set test.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            again = lambda e, k: (e["h"] == F.get(p, k - 1)["h"]) | (e["h"] == F.get(p, k + 1)["h"])
            return F.sort_array(F.transform(F.filter(p, lambda e, k: F.coalesce(again(e, k), F.lit(False))), lambda e: e["i"]))

        def total(at: Column) -> Column:
            gap = F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3))))
            return F.aggregate(gap, F.lit(0), lambda a, x: a + x)

        return let(let(pairs, places), total)

    def counted(v: Column) -> Column:
        n = F.size(v)
        hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(v, i), F.get(v, i + 1), F.get(v, i + 2)))
        some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
        return F.when(n < 4, F.lit(0)).otherwise(some)

    return let(w, counted)


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long); null text counts as empty.

    Columns of these names that df has already are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(without(x, " \t\n\x0b\x0c\r")) > 0)
    shape = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    counts = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).cast("long").alias("r")))
    return (
        df.withColumns({"__w": counts, "__l": shape})
        .withColumns({
            "n_words": F.col("__w.n"),
            "word_chars": F.length(without(t, " \t\n\x0b\x0c\r")).cast("long"),
            "n_symbols": (F.length(t) - F.length(without(t, SYMBOLS))).cast("long"),
            "n_lines": F.col("__l.n"),
            "n_dup_lines": F.col("__l.d"),
            "n_repeat_words": F.col("__w.r"),
        })
        .drop("__w", "__l")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def production_rules(text: str = "text") -> list[Rule]:
    """Rules on top of base_failed(); they need the columns of measures(). Bounds leave ordinary prose of any length alone."""
    t = F.coalesce(F.col(text), F.lit(""))
    upper = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]", ""))
    shouts = F.length(t) - F.length(F.replace(t, F.lit("!!"), F.lit("!")))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > 3 * F.col("n_words")),
        Rule("duplicate_lines", 10 * F.col("n_dup_lines") > 5 * F.col("n_lines")),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
        Rule("capitals", 10 * upper > 5 * F.col("word_chars")),
        Rule("shouting", 10 * shouts > 3 * F.col("n_words")),
        Rule("no_letters", ~F.coalesce(F.regexp_like(t, F.lit(r"\p{L}")), F.lit(False))),
    ]


@dataclass(frozen=True)
class Plan:
    order: list[str]
    seconds: dict[str, float]
    rejected: dict[str, float]


def plan(df: DataFrame, rules: list[Rule], sample_rows: int = 1000, repeats: int = 20, shape: Callable[[DataFrame], DataFrame] = lambda d: d) -> Plan:
    """Order rules by rejections per second on about sample_rows random rows of df (the only bound; it affects speed, never a
    verdict). shape gives the sample the columns that the rules need. Every rule is evaluated `repeats` times on each row of the written sample, twice, and the quicker run less that of a
    rule that does nothing is its cost."""
    rows = df.count()
    sample = materialize(shape(df.sample(min(1.0, sample_rows / max(1, rows)), 7)), "rule-sample")
    flag = lambda r: F.coalesce(r.reject, F.lit(False))
    seen = sample.groupBy(*[flag(r).alias(r.name) for r in rules]).count().collect()
    again = sample.withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def timed(reject: Column) -> float:
        began = time.perf_counter()
        again.agg(F.count_if(reject)).collect()
        return time.perf_counter() - began

    idle = F.col("__again") < 0
    timed(idle)
    nothing = min(timed(idle), timed(idle))
    seconds = {r.name: max(1e-6, (min(timed(flag(r)), timed(flag(r))) - nothing) / repeats) for r in rules}
    total = max(1, sum(x["count"] for x in seen))
    left, order, open_rules = seen, [], [r.name for r in rules]
    rejected = {r.name: sum(x["count"] for x in seen if x[r.name]) / total for r in rules}
    while open_rules:
        gain = {n: sum(x["count"] for x in left if x[n]) / seconds[n] for n in open_rules}
        best = max(open_rules, key=lambda n: (gain[n], -seconds[n]))
        order.append(best)
        open_rules.remove(best)
        left = [x for x in left if not x[best]]
    return Plan(order, seconds, rejected)


def cascade(rules: list[Rule], order: list[str]) -> Column:
    """Name of the first rejecting rule in this order, null where none rejects; later rules are not evaluated."""
    by_name = {r.name: r for r in rules}
    chain = F.when(by_name[order[0]].reject, F.lit(order[0]))
    for n in order[1:]:
        chain = chain.when(by_name[n].reject, F.lit(n))
    return chain


def judge(df: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = 1000) -> DataFrame:
    """df with the columns of measures(), base_failed, rejected_by (first rule of the cascade, null: none) and kept.

    Null and empty texts have no words and fail the base. Rows are judged each on its own: ties and repeated rows give
    equal verdicts, an empty table an empty result. Other columns pass through; columns with the names added here are
    replaced.
    """
    measured = measures(df, text).withColumn("base_failed", base_failed())
    used = rules if rules is not None else production_rules(text)
    if not used:
        return measured.withColumn("rejected_by", F.lit(None).cast("string")).withColumn("kept", ~F.col("base_failed"))
    # only what passes the base comes to the rules
    order = plan(df, used, sample_rows, shape=lambda d: measures(d, text).withColumn("base_failed", base_failed()).filter("not base_failed")).order
    verdict = F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(used, order))
    return measured.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull())


#: DuckDB form of judge() for table `documents`; one CTE per measure.
ORACLE_CTE = rf"""
w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, row_number() OVER () AS rn FROM documents),
g AS (SELECT rn, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri FROM (SELECT rn, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, tri) AS c FROM g) WHERE c > 1),
c AS (SELECT rn, count(DISTINCT j) AS n FROM (SELECT rn, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY rn),
m AS (SELECT w.doc_id, w.t, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c USING (rn)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 5 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
             OR 10 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * word_chars
             OR 10 * (length(t) - length(replace(t, '!!', '!'))) > 3 * n_words OR NOT regexp_matches(t, '\pL') AS rule_failed FROM m)
"""
ORACLE = f"WITH {ORACLE_CTE} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rule_failed AS kept FROM v"
