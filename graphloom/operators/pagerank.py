"""Personalised PageRank over the undirected multigraph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.session import materialize, pin_top

# --- fixed values ------------------------------------------------------------
ROUNDS = 10
ALPHA = 0.85
SCORE_DIGITS = 9
# -----------------------------------------------------------------------------


def personalized_pagerank(graph: PropertyGraph, seeds: Sequence[str], alpha: float = ALPHA) -> DataFrame:
    """``(id, score)`` after ten rounds from the seeds; every id that carries mass.

    Each round spreads a node's mass evenly over its incident edges and returns
    ``1 - alpha`` to the seeds. Mass of nodes without edges is lost. Only nodes
    that hold mass in the last round are listed. Links stay in their blocks:
    a round shuffles one value for each node that two blocks share.
    """
    spark, share, blocks = graph.spark, 1.0 / len(seeds), graph.blocks
    known = {r["id"]: r["key"] for r in blocks.names.filter(F.col("id").isin(*seeds)).select("id", blocks.key("id").alias("key")).collect()}  # the seeds' own keys
    scores = materialize(blocks.scores({k: share for k in known.values()}, {k: (1 - alpha) * share for k in known.values()}, alpha, ROUNDS), "ranks")
    named = scores.join(blocks.names.withColumn("key", blocks.key("id")), "key").select("id", "score")
    # a seed without edges keeps just its teleport share
    alone = [(s, (1 - alpha) * share) for s in dict.fromkeys(seeds) if s not in known]
    return named.unionAll(spark.createDataFrame(alone, "id string, score double")) if alone else named


def top_ranked(scores: DataFrame, top_k: int = 50) -> DataFrame:
    """Best scores; rounded to :data:`SCORE_DIGITS` they tie whatever the summation order."""
    return scores.orderBy(F.desc(F.round("score", SCORE_DIGITS)), "id").limit(top_k)


def expand_by_rank(graph: PropertyGraph, seeds: Sequence[str], alpha: float = ALPHA,
                   top_k: int = 20) -> DataFrame:
    """Best ranked existing nodes around the seeds: seeds and infrastructure left out.

    Candidates are the ``4 * top_k`` best scores, so fewer than ``top_k`` may remain.
    """
    best = pin_top(top_ranked(personalized_pagerank(graph, seeds, alpha), top_k * 4), top_k * 4)
    return (best.filter(~F.col("id").isin(*seeds))
            .join(graph.nodes_of(best).select("id", "label", "name", "description", "infra_layer"), "id")
            .filter(F.coalesce("infra_layer", F.lit("")) != "L1").drop("infra_layer")
            .orderBy(F.desc(F.round("score", SCORE_DIGITS)), "id").limit(top_k))
