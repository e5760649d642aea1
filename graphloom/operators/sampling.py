"""Random nodes and connected random subgraphs, reproducible under a seed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators.relations import induced_edges
from graphloom.session import materialize


def _order(seed: int, *columns: str) -> Column:
    """A random order that depends on row keys only, so reruns of a task agree."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *columns).cast("binary"))


def random_nodes(graph: PropertyGraph, limit: int = 50, labels: Sequence[str] = (), seed: int = 0) -> DataFrame:
    nodes = graph.nodes.filter(F.col("label").isin(*labels)) if labels else graph.nodes
    return nodes.orderBy(_order(seed, "id"), "id").limit(limit)


def random_sample(graph: PropertyGraph, limit: int = 50, labels: Sequence[str] = (),
                  seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Random nodes and the edges among them."""
    nodes = materialize(random_nodes(graph, limit, labels, seed).select("id", "label", "name"), "sample")
    return nodes, induced_edges(graph.edges, nodes.select("id"))


def random_subgraph(graph: PropertyGraph, limit: int = 50, labels: Sequence[str] = (),
                    seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A sample grown from a random node: nodes ``(id, label, name)`` and induced edges.

    Every round each sampled node offers one random neighbour not sampled yet;
    offers are taken in random order until ``limit``. A round without offers
    adds another random node instead.
    """
    allowed = graph.nodes.select("id", "label", "name")
    if labels:
        allowed = allowed.filter(F.col("label").isin(*labels))
    ids = allowed.select("id")
    picked = [materialize(ids.orderBy(_order(seed, "id"), "id").limit(1), "pick")]
    size, step = picked[0].count(), 0
    while 0 < size < limit:
        step += 1
        chosen = reduce(DataFrame.unionAll, picked)
        offers = (graph.follow(chosen.select(F.col("id").alias("a")))
                  .select("a", F.col("b").alias("id"))
                  .join(chosen, "id", "left_anti").join(ids, "id", "left_semi")
                  .groupBy("a").agg(F.min_by("id", _order(seed + step, "a", "id")).alias("id"))
                  .select("id").distinct())
        layer = materialize(offers.orderBy(_order(seed + step, "id"), "id").limit(limit - size), "pick")
        grown = layer.count()
        if not grown:
            restart = ids.join(chosen, "id", "left_anti").orderBy(_order(seed + step, "id"), "id").limit(1)
            layer = materialize(restart, "pick")
            grown = layer.count()
            if not grown:
                break
        picked.append(layer)
        size += grown
    sample = reduce(DataFrame.unionAll, picked)
    return allowed.join(sample, "id", "left_semi"), induced_edges(graph.edges, sample)
