"""The corpus pipeline: quality rules, near copies, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet to the shared
folder and reads them again as the next stage's documents.  All stages but the last return the columns they were given.

There is no SQL for the whole, as the last stage's ids come from a byte-pair encoder; the tests compare each stage with a
brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout.llm import jaccard, packing, quality, recompression, secrets
from turnout.llm.files import run_folder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _as_given(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with n_chars following the text."""
    chars = F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return changed.select(*(chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    judged = quality.quality_rules(docs.select(F.struct(*docs.columns).alias("row"), "text", "lang", "source"))
    return judged.where("kept").select("row.*")


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, similarity of 0.8 or more."""
    return jaccard.without_near_copies(docs, words=5, percent=80)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a document with a smaller id has too."""
    return _as_given(recompression.without_repeats(docs, length=50), docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets redacted."""
    found = secrets.secret_scan(docs.select(F.struct(*docs.columns).alias("row"), "text"))
    text = secrets.redact(F.col("text"), F.col("all_spans"))
    return _as_given(found.select(*(text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns)), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as sequences of token ids, one row a piece."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_stage),
    ("near copies", near_copy_stage),
    ("repeated passages", passage_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage but the last is run while this is called."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = run_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
