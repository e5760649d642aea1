"""Index-only retrieval: scored pointers to assets instead of contents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.links import RECORD_ROOT, asset_link, is_index_code_file
from graphloom.functions.scoring import clamp01, confidence_level
from graphloom.plans.retrieve import Retriever
from graphloom.schema import CODE_LABEL

# --- fixed values ------------------------------------------------------------
FETCH_FACTOR = 5
REASON = "hybrid_index"
# -----------------------------------------------------------------------------


def index_only(retriever: Retriever, query: str, top_k: int = 10, high_confidence_only: bool = False,
               node_types: Sequence[str] = (), vector: Sequence[float] | None = None,
               root: str = RECORD_ROOT) -> DataFrame:
    """``(rank, name, node_type, asset_link, confidence, confidence_level, raw_score)``.

    Scores are relative to the best candidate; code files need a code suffix.
    """
    label = node_types[0] if len(node_types) == 1 else ""
    hits = retriever.hits(query, top_k * FETCH_FACTOR, label_filter=label, vector=vector)
    top = hits.agg(F.max("score").alias("top"), F.lit(1).alias("one"))
    rows = hits.withColumn("one", F.lit(1)).join(F.broadcast(top), "one")
    if node_types:
        rows = rows.filter(F.col("label").isin(*node_types))
    rows = rows.filter((F.col("label") != CODE_LABEL) | is_index_code_file(F.col("name")))
    top_or_one = F.when(F.col("top") == 0, F.lit(1.0)).otherwise(F.col("top"))
    rows = rows.withColumn("confidence", clamp01(F.col("score") / top_or_one))
    if high_confidence_only:
        rows = rows.filter(confidence_level(F.col("confidence")) == "high")

    def column(name: str) -> Column:
        return F.col(name) if name in hits.columns else F.lit(None).cast("string")

    kept = rows.orderBy(F.desc("score"), "id").limit(top_k)
    order = Window.orderBy(F.desc("confidence"), F.desc("score"), "name", "id")  # over top-k rows only
    return kept.select(
        F.row_number().over(order).alias("rank"), "name", F.col("label").alias("node_type"),
        asset_link(F.col("id"), F.col("label"), *[column(c) for c in (
            "path", "wiki_url", "wiki_link", "story_url", "sheet_url")], root=root).alias("asset_link"),
        "confidence", confidence_level(F.col("confidence")).alias("confidence_level"),
        F.col("score").alias("raw_score"))


def format_lines(matches: DataFrame) -> DataFrame:
    """One display line per match, in rank order."""
    return matches.orderBy("rank").select("rank", F.format_string(
        "- [rank=%d | score_norm=%.3f | score_raw=%.6f | source=%s] %s (%s): %s",
        "rank", "confidence", "raw_score", F.lit(REASON), "name", "node_type", "asset_link").alias("line"))
