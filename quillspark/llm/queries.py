"""The queries opN_<name> over the driver's tables: each applies its operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fixity, html_text, language, lm_scoring, near_dedup, packing, secrets, topk, toxicity
from .common import fold, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.secret_spans(table(spark, sf_dir, "documents"), BYTE_BPE))


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against a replica with planted faults: some pages changed, some missing."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    spoilt = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit(" "), F.coalesce("html", F.lit("")))).otherwise(F.col("html"))
    replica = pages.where(F.col("page_id") % 101 != 7).withColumn("html", spoilt)
    return fixity.audit(pages, replica, "page_id", ["url", "html"])


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language.train(docs, F.coalesce(fold("doc_id", 3) != 1, F.lit(False)), PIECES)
    found = language.predicted(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80).drop("links")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), WORD_BPE, 4096)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.best_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held_out = fold("doc_id", 4) == 2
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), ~held_out)
    found = toxicity.scored(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 5) == 1
    return lm_scoring.scored(table(spark, sf_dir, "documents", "doc_id", "text"), ~held_out, held_out)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """The other queries have no faithful SQL form; tests/llm compares each with brute force, round trips or held-out accuracy."""
    spoilt = "CASE WHEN page_id % 97 = 5 THEN ' ' || coalesce(html, '') ELSE html END"
    hashed = lambda html: f"sha256(coalesce('=' || url, 'null') || chr(0) || coalesce('=' || {html}, 'null'))"
    return {
        "op3_warc_fixity": f"""WITH a AS (SELECT page_id, {hashed('html')} AS h FROM pages), b AS (SELECT page_id, {hashed(spoilt)} AS h FROM pages WHERE page_id % 101 <> 7)
SELECT coalesce(a.page_id, b.page_id) AS record_id, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'added' ELSE 'changed' END AS fault FROM a FULL JOIN b ON a.page_id = b.page_id WHERE a.h IS DISTINCT FROM b.h""",
        "op5_minhash_near_dedup": near_dedup.oracle_sql(4, 80),
        "op6_exact_topk": topk.oracle_sql("vec_id % 50 = 0", 5),
        "op7_benchmark_decontamination": decontaminate.oracle_sql(),
    }
