"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout.llm import collocations, jaccard, lexicon, nbsvm, negatives, packing, quality, recompression, secrets, sql, tokenfiles, topk, urls, warc, wordbpe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(text: str | None = None):
    """Registers a function of (session, table folder) under its name, with its SQL."""
    def add(function):
        QUERIES[function.__name__] = function
        if text:
            ORACLE[function.__name__] = text
        return function
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
URL_RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")


@query()
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Rule, host, path and verdict of every page; see ``urls.url_filter``."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    judged = urls.url_filter(pages, [urls.Rule.parse(r) for r in URL_RULES])
    return judged.select("page_id", "host", "path", "rule", "verdict", "url_score")


@query(sql.QUALITY)
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdict of every document; see ``quality``."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    judged = quality.judge_measures(docs)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "group_docs")


@query(sql.SECRETS)
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and spans of every document; see ``secrets``."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.scan_only(docs)
    of = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(secrets.listed(F.col("base_spans")), 256).alias("base_sha256"),
                        secrets.listed(F.col("all_spans")).alias("spans"))


@query()
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, counted from flat files by their separators; see ``tokenfiles``."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    end_id = wordbpe.load(TOKENIZER).special["<|endoftext|>"]
    return tokenfiles.document_token_counts(docs, TOKENIZER, end_id).select("doc_id", "n_tokens")


@query()
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document; see ``packing``."""
    return packing.pack(table(spark, folder, "documents").select("doc_id", "text"), TOKENIZER)


def _digests(bpe: wordbpe.WordBpe, ids: np.ndarray) -> dict:
    return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(ids.astype("<u4").data).hexdigest(),
            "decoded_sha256": hashlib.sha256(bpe.decode(ids)).hexdigest()}


@query()
def op9_word_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids and the decoded text of every document; see ``lexicon``."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    name = lexicon.compile_lexicon(docs, TOKENIZER)
    columns = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return lexicon.encode(docs, _digests, columns, TOKENIZER, name)


@query(sql.WARC)
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    """What is read back of a record for every page; see ``warc``."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    read = warc.read_archives(warc.write_archives(pages))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


@query(sql.TOP_K)
def op8_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best candidates of every vector whose id is divisible by 20; see ``topk``."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors.where("vec_id % 20 = 0"), vectors)


@query(sql.JACCARD)
def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Set size and component of every document at three words and nine tenths; see ``jaccard``."""
    return jaccard.jaccard_join(table(spark, folder, "documents").select("doc_id", "text"), words=3, percent=90)


@query(sql.SUBSTRINGS)
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without repeated windows of 50 words; see ``recompression``."""
    return recompression.word_digests(table(spark, folder, "documents").select("doc_id", "text"), length=50)


@query(sql.HARD_NEGATIVES)
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Ten hard negatives for each of five positives of every vector whose id is divisible by 100; see ``negatives``."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, label=label)


@query(sql.COLLOCATIONS)
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 best phrases of two and three words of every language; see ``collocations``."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return collocations.collocations(docs, threshold=10, longest=3, top=2000)


@query()
def op13_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document by a model of the labels outside the held-out fold; see ``nbsvm``."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return nbsvm.quality_scores(docs, table(spark, folder, "labels").select("doc_id", "quality"))
