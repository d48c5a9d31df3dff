"""The registered queries of the corpus operators; each one applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_dedup, collocations, decontaminate, fm_quality, language_model, licenses, ngram_join, packing, quality_rules, quotes, secret_ledger, url_cascade, variants
from .common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op2_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_cascade.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_cascade.PRODUCTION_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.held_out_scores(table(spark, sf_dir, "documents"))


def op4_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_quality.held_out_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = quotes.conversations(quotes.link_quotes(table(spark, sf_dir, "conversations")))
    return chats.select("conv_id", "turn", "role", "text", "reply_to", "thread", "depth", "n_quotes", "n_linked", "unlinked", "opens", "chat")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repeats: the document lost a passage that another one has first; text is what is left of it."""
    left = chunk_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", (F.col("removed_words") > 0).alias("repeats"), "n_words", "removed_words", "spans", "text")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.scan_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_url_cascade, op3_gru_lm, op4_fm_quality, op5_quote_links, op6_packing, op7_chunk_dedup, op8_decontamination, op9_license_scan, op10_quality_rules, op11_collocations, op12_spelling_variants, op13_secret_ledger)}
#: All pairs that share a shingle, then what is reachable by links.
NGRAM_JOIN_ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 85 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.b AS component_id, coalesce(k.k, 0) AS n_links FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a, min(b) AS b FROM r GROUP BY 1) c ON c.a = d.doc_id LEFT JOIN (SELECT a, count(*) AS k FROM l GROUP BY 1) k ON k.a = d.doc_id
"""

ORACLE_SQL = {"op1_ngram_join": NGRAM_JOIN_ORACLE, "op2_url_cascade": url_cascade.ORACLE, "op8_decontamination": decontaminate.ORACLE, "op10_quality_rules": quality_rules.ORACLE, "op11_collocations": collocations.ORACLE, "op12_spelling_variants": variants.ORACLE, "op13_secret_ledger": secret_ledger.ORACLE}
