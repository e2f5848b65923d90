"""A corpus from documents to packed sequences: five stages, each one operator of quillspark.llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. Rejected documents go, secrets are masked in the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, language, near_dedup, packing, secrets
from quillspark.llm.common import stored

SURE = 0.5  # a language is rejected below this posterior


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known: not `und` (null, or no letter), and likelier than not. Each row is judged by its own
    text, so repeated rows and ids, or ids of null, make no difference. Where no row has a language, nothing can be learnt
    and every row is rejected."""
    model = language.train(docs, F.lit(True), public_tokenizers.path("piece_bpe_32k.model"))
    held = {c: f"_held_{c}" for c in ("lang_pred", "score") if c in docs.columns}  # a document's own columns of these names stay
    found = language.predicted(docs.withColumnsRenamed(held), model).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE))
    return found.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in held.items()}).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8): that of the smallest doc_id. It is rows
    that stay or go, so an id with different texts loses none of them but copies; rows without words or an id stay unless
    they are copies of a row that stays. An empty table stays empty."""
    return near_dedup.deduplicated(docs, k=5, percent=80).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item. Rows with the same id and different texts are judged apart, rows of equal
    text alike; texts of null stay. Without items all rows stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.cleaned(docs, items).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their secrets masked; n_chars follows. Texts of null stay null."""
    clean = secrets.redacted(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences of 4096 tokens. A text of null is its end alone; repeated rows
    and ids of null are packed like others."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), 4096)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Language models, sketches and tokenizers have no SQL form; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
