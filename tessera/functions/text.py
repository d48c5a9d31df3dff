"""Text functions: tokenizers, query normalization and shape, stuffing bound, redaction, decimal texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token patterns of the different indexes.
ATOMIC_TOKEN = r"[\p{L}\p{N}]+"
IDENTIFIER_TOKEN = r"[\p{L}\p{N}]+(?:[_-][\p{L}\p{N}]+)*"
BM25_TOKEN = r"[\p{L}\p{N}_]+"
ASCII_TOKEN = r"[a-z0-9]+"
LONG_TOKEN = r"[a-z0-9]{2,}"
WORD_TOKEN = r"[\p{L}\p{N}]{2,}"
#: Words that alone never match, in natural order.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "with")
METHODS = ("CONNECT", "DELETE", "GET", "HEAD", "OPTIONS", "PATCH", "POST", "PUT", "TRACE")


def tokens(text: Column, pattern: str = BM25_TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def identifier_tokens(text: Column) -> Column:
    """Joined identifiers and their parts."""
    whole = tokens(text, IDENTIFIER_TOKEN)
    return F.flatten(F.transform(whole, lambda x: F.concat(F.array(x), F.split(x, "[_-]+"))))


def nfkc(text: Column) -> Column:
    """Unicode normal form NFKC, for which Spark has no function; in Arrow batches."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else unicodedata.normalize("NFKC", t) for t in s], dtype=object)

    return normal(text)


def normalize_query(text: Column) -> Column:
    """NFKC, controls to blanks, direction marks out, white space folded, at most 512 characters. Null stays null."""
    t = F.regexp_replace(nfkc(text), r"[\x00-\x1f\x7f-\x9f]", " ")
    t = F.regexp_replace(t, "[‎‏‪-‮⁦-⁩]", "")
    return F.substring(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")), 1, 512)


def _searchable(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS))


def compile_query(normalized: Column) -> Column:
    """struct(phrase, any_of): tokens that must follow each other, or of which one must occur; both empty: nothing matches."""
    phrase, any_of = _searchable(tokens(normalized, ATOMIC_TOKEN)), F.array_distinct(_searchable(identifier_tokens(normalized)))
    empty = F.array().cast("array<string>")
    ok = (F.size(phrase) > 0) & (F.size(any_of) > 0)
    return F.struct(F.when(ok, phrase).otherwise(empty).alias("phrase"), F.when(ok, any_of).otherwise(empty).alias("any_of"))


def query_shape(n: Column) -> Column:
    """Features of a normalized query."""
    words = _searchable(tokens(n, ATOMIC_TOKEN))
    return F.struct(
        F.length(n).alias("normalized_length"),
        F.size(words).alias("token_count"),
        F.size(F.array_distinct(words)).alias("unique_token_count"),
        F.size(words).alias("phrase_token_count"),
        ((F.size(words) > 1) & F.regexp_like(n, F.lit(r"\s"))).alias("has_phrase"),
        F.regexp_like(n, F.lit(r"[_:/\\.@#%~-]")).alias("has_identifier"),
        F.regexp_like(n, F.lit(r"(?i)\b(?:https?|mcp)://")).alias("has_url"),
        F.exists(words, lambda w: F.upper(w).isin(*METHODS)).alias("has_http_method"),
        F.exists(words, lambda w: F.regexp_like(w, F.lit(r"[0-9]"))).alias("has_numeric_token"),
        F.regexp_like(n, F.lit(r"[^\p{L}\p{N}\s]")).alias("has_punctuation"),
        ((F.length(n) > 0) & (F.size(words) == 0)).alias("stopword_only"),
    )


def unique_lexemes(text: Column, pattern: str = ATOMIC_TOKEN) -> Column:
    """Each token once, at its first place: repeating a keyword adds nothing."""
    return F.array_join(F.array_distinct(tokens(text, pattern)), " ")


def phrase_token_text(text: Column) -> Column:
    """Tokens with a blank around each, so that a contiguous token sequence is a plain substring."""
    return F.concat(F.lit(" "), F.array_join(tokens(text, ATOMIC_TOKEN), " "), F.lit(" "))


def redact(address: Column, head: int = 6, tail: int = 4, longer_than: int = 12) -> Column:
    return F.when(F.length(address) > longer_than, F.concat(F.substring(address, 1, head), F.lit("…"), F.right(address, F.lit(tail)))).otherwise(address)


def atomic_to_decimal(amount: Column, decimals: int) -> Column:
    """An integer count of smallest units as a plain decimal text without trailing zeros."""
    digits = F.lpad(F.abs(amount).cast("string"), F.greatest(F.lit(decimals + 1), F.length(F.abs(amount).cast("string"))), "0")
    if decimals == 0:
        return amount.cast("string")
    whole = F.substring(digits, F.lit(1), F.length(digits) - decimals)
    part = F.rtrim(F.right(digits, F.lit(decimals)), F.lit("0"))
    sign = F.when(amount < 0, "-").otherwise("")
    return F.concat(sign, whole, F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))


def compact_age(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0)).cast("long")
    of = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s < 60, of(1, "s")).when(s < 3600, of(60, "m")).when(s < 86400, of(3600, "h")).otherwise(of(86400, "d"))


def seeded(seed: str, key: Column) -> Column:
    """A sort key that puts rows into an order that depends on the seed only, on any engine."""
    return F.sha2(F.concat(F.lit(seed), F.lit("\x00"), key.cast("string")), 256)
