"""Score arithmetic shared by the retrieval and reranking plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
RRF_K = 60
CONFIDENCE_HIGH = 0.6
BUCKET_HIGH = 0.75
BUCKET_MEDIUM = 0.45
# -----------------------------------------------------------------------------


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def safe_norm(raw: Column, top: Column) -> Column:
    """``raw / top`` held to 0..1, and 0 where ``top`` is not positive."""
    return F.when(top > 0, clamp01(raw / F.when(top > 0, top))).otherwise(F.lit(0.0))


def idf(corpus_size: Column, doc_freq: Column) -> Column:
    return F.log(corpus_size - doc_freq + F.lit(0.5)) - F.log(doc_freq + F.lit(0.5))


def floored_idf(raw_idf: Column, mean_idf: Column) -> Column:
    """Negative idf is replaced by a quarter of the mean idf (itself possibly negative)."""
    return F.when(raw_idf < 0, F.lit(BM25_EPSILON) * mean_idf).otherwise(raw_idf)


def bm25_weight(idf_value: Column, tf: Column, doc_len: Column, avg_len: Column) -> Column:
    length_part = F.lit(1.0 - BM25_B) + F.lit(BM25_B) * doc_len / avg_len
    return idf_value * tf * F.lit(BM25_K1 + 1.0) / (tf + F.lit(BM25_K1) * length_part)


def rrf(rank: Column) -> Column:
    return F.lit(1.0) / (F.lit(float(RRF_K)) + rank)


def confidence_level(confidence: Column) -> Column:
    return F.when(confidence >= CONFIDENCE_HIGH, F.lit("high")).otherwise(F.lit("low"))


def confidence_bucket(score: Column) -> Column:
    return (F.when(score >= BUCKET_HIGH, F.lit("high"))
            .when(score >= BUCKET_MEDIUM, F.lit("medium"))
            .otherwise(F.lit("low")))
