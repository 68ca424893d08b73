"""Each operator applied to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm import (
    codes,
    decontaminate,
    lines,
    mixing,
    neardup,
    partcodes,
    pii,
    quality,
    resample,
    sentencepiece,
    shards,
    twins,
    urls,
    warc,
)
from rowmill.llm.registry import QUERIES, SQL, query
from rowmill.llm.table import read

__all__ = ["QUERIES", "SQL"]

# Verdict, host, path.
URL_RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)


@query(twins.PII)
def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data found in every document."""
    return pii.document_spans(read(spark, folder, "documents", "doc_id", "text"))


@query(twins.URLS)
def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's url."""
    found = urls.judge(read(spark, folder, "pages", "page_id", "url"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


@query()
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    return shards.document_shards(read(spark, folder, "documents", "doc_id", "text"))


@query(twins.LINES)
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the passages that occurred before."""
    return lines.drop_repeats(read(spark, folder, "documents", "doc_id", "text"))


@query(twins.LEAKS)
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    docs = read(spark, folder, "documents", "doc_id", "text")
    return decontaminate.document_leaks(docs, read(spark, folder, "benchmark", "item_id", "text"))


@query()
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    docs = read(spark, folder, "documents", "doc_id", "text")
    return quality.document_quality(docs, read(spark, folder, "labels", "doc_id", "quality"))


@query()
def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as pieces, and whether decoding restores it."""
    docs = read(spark, folder, "documents", "doc_id", "text")
    return sentencepiece.document_pieces(docs, sentencepiece.Vocabulary.load())


@query(twins.CODES)
def op10_code_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest sign codes of every embedding whose id is divisible by 20."""
    vectors = read(spark, folder, "embeddings", "vec_id", "embedding")
    return codes.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=10, bits=64)


@query()
def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return neardup.document_groups(read(spark, folder, "documents", "doc_id", "text"))


@query()
def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document by a model of the documents that are not held out."""
    return mixing.document_scores(read(spark, folder, "documents", "doc_id", "text"))


@query(twins.ARCHIVES)
def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written into web archives and read back."""
    return warc.page_records(read(spark, folder, "pages", "page_id", "url", "html"))


@query(twins.PART_CODES)
def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding as a code of eight parts."""
    return partcodes.compress(read(spark, folder, "embeddings", "vec_id", "embedding", "label"))


@query(twins.RESAMPLED)
def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter of the longer documents, drawn by their likeness to the benchmark."""
    docs = read(spark, folder, "documents", "doc_id", "text")
    return resample.resample(docs, read(spark, folder, "benchmark", "text"))
