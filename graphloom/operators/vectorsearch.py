"""Exact cosine search over node vectors and code snippets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import vectors
from graphloom.operators.textindex import SCORE_DIGITS


def prepared(table: DataFrame) -> DataFrame:
    """Vectors with their norm; rows without a usable vector are dropped. Prepared input is kept."""
    if "norm" in table.columns:
        return table
    return (table.filter(F.col("embedding").isNotNull())
            .withColumn("norm", vectors.norm(F.col("embedding"))).filter(F.col("norm") > 0))


def cosine_scores(table: DataFrame, query: Sequence[float]) -> DataFrame:
    """Prepared vectors with ``score``: cosine against the query vector."""
    cosine = vectors.dot(F.col("embedding"), vectors.literal_vector(vectors.unit_values(query)))
    return table.withColumn("score", F.round(cosine / F.col("norm"), SCORE_DIGITS))


def file_scores(snippets: DataFrame, query: Sequence[float], top_k: int | None = None) -> DataFrame:
    """Best snippet score per code file; the ``top_k`` best files when given."""
    best = (cosine_scores(prepared(snippets), query)
            .groupBy(F.col("codefile_node_id").alias("id")).agg(F.max("score").alias("score")))
    return best if top_k is None else best.orderBy(F.desc("score"), "id").limit(top_k)


def top_snippets(snippets: DataFrame, query: Sequence[float], per_file: int = 3,
                 file_id: str | None = None) -> DataFrame:
    """The best snippets inside each file (or one file) with their place."""
    if file_id is not None:
        snippets = snippets.filter(F.col("codefile_node_id") == file_id)
    order = Window.partitionBy("codefile_node_id").orderBy(F.desc("score"), "id")
    return (cosine_scores(prepared(snippets), query)
            .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_file))


def snippet_counts(snippets: DataFrame) -> DataFrame:
    return snippets.agg(F.count(F.lit(1)).alias("snippets"),
                        F.count("embedding").alias("with_embedding"))
