"""Guard rules for ids, labels, relationships, node payloads and edge endpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.schema import (ID_PATTERN, MAX_NAME, MAX_TEXT, MIN_QUESTION, NODE_LABELS, QUESTION_LABEL,
                              RELATIONSHIPS)

# --- fixed values ------------------------------------------------------------
STATUSES = ["pending", "answered", "dismissed", "approved", "rejected", "resolved"]
CATEGORIES = ["ambiguous", "untraceable", "contradictory", "game_trivia", "weak_association",
              "wrong_association", "unknown", "proposal", "general", "ArchNode", "BusinessTerm",
              "CodeFile", "WikiStory", "Folder", "InBusinessEntity", "Prefab", "Question"]
# -----------------------------------------------------------------------------


def id_error(node_id: Column) -> Column:
    """INVALID_NODE_ID for an empty, too long or ill-formed id, else null."""
    trimmed = F.trim(F.coalesce(node_id, F.lit("")))
    return F.when(~trimmed.rlike(ID_PATTERN), F.lit("INVALID_NODE_ID"))


def label_error(label: Column, allowed: Sequence[str] = NODE_LABELS) -> Column:
    return F.when(~F.trim(F.coalesce(label, F.lit(""))).isin(*allowed), F.lit("INVALID_LABEL"))


def relationship_error(relationship: Column, allowed: Sequence[str] = RELATIONSHIPS) -> Column:
    return F.when(~F.trim(F.coalesce(relationship, F.lit(""))).isin(*allowed), F.lit("INVALID_RELATIONSHIP"))


def first_problem(label: Column, name: Column, description: Column, question: Column, status: Column,
                  category: Column, creating: bool = True) -> Column:
    """The first payload rule a node breaks, as text; null when it breaks none."""
    name, description, question, status, category = (
        F.trim(F.coalesce(v, F.lit(""))) for v in (name, description, question, status, category))
    rules: list[tuple[Column, str]] = []
    if creating:
        is_question = label == QUESTION_LABEL
        rules += [(is_question & (F.length(question) < MIN_QUESTION), "question too short"),
                  (~is_question & (name == "") & (description == ""), "name or description required")]
    rules += [(F.length(name) > MAX_NAME, "name too long"),
              (F.length(description) > MAX_TEXT, "description too long"),
              (F.length(question) > MAX_TEXT, "question too long"),
              ((status != "") & ~status.isin(*STATUSES), "invalid status"),
              ((category != "") & ~category.isin(*CATEGORIES), "invalid category")]
    return F.coalesce(*[F.when(broken, F.lit(text)) for broken, text in rules])


def endpoint_errors(edges: DataFrame, nodes: DataFrame, allowed_labels: Sequence[str] = NODE_LABELS,
                    rules: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """Edges with ``error``: a missing end, a label outside the list, or a pair no rule allows.

    ``rules`` are (relationship, source label, target label); a relationship
    without a rule accepts every pair.
    """
    ids = nodes.select("id", "label")
    joined = (edges.join(ids.select(F.col("id").alias("source"), F.col("label").alias("source_label")),
                         "source", "left")
              .join(ids.select(F.col("id").alias("target"), F.col("label").alias("target_label")),
                    "target", "left"))
    missing = F.col("source_label").isNull() | F.col("target_label").isNull()
    bad_label = ~F.col("source_label").isin(*allowed_labels) | ~F.col("target_label").isin(*allowed_labels)
    error = F.when(missing, F.lit("ENDPOINT_NOT_FOUND")).when(bad_label, F.lit("INVALID_LABEL"))
    if rules:
        triple = F.concat_ws("\u0000", "relationship", "source_label", "target_label")
        governed = F.col("relationship").isin(*{r for r, _, _ in rules})
        error = error.when(governed & ~triple.isin(*["\u0000".join(r) for r in rules]),
                           F.lit("INVALID_RELATIONSHIP_ENDPOINT"))
    return joined.withColumn("error", error)
