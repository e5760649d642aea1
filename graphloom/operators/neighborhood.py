"""Breadth-first operators: k-hop neighbourhoods, subgraphs and layered traversal.

Each hop is one join of the frontier with the edges (a small frontier is sent to
them) or with the bucketed link table, followed by a distinct; levels are small tables in the work folder, so Catalyst broadcasts a
frontier by its true size and shuffles it when it has grown large.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.session import materialize


def seed_frame(graph: PropertyGraph, ids: Sequence[str]) -> DataFrame:
    unique = list(dict.fromkeys(ids))
    return graph.spark.createDataFrame([(i, i, 0) for i in unique], "seed string, id string, hop int")


def neighborhood_levels(graph: PropertyGraph, seeds: Sequence[str], max_hops: int = 2,
                        relationship: str | None = None, skip_infra: bool = True,
                        max_size: int | None = 200) -> DataFrame:
    """``(seed, id, hop)``: undirected distance of every node within ``max_hops`` of each seed.

    Infrastructure nodes are neither listed nor crossed (seeds themselves are
    exempt) and ``relationship`` applies to every hop. ``max_size`` keeps the
    first nodes per seed in ``(hop, id)`` order and stops growing once reached;
    None returns the neighbourhood whole.
    """
    levels = [materialize(seed_frame(graph, seeds), "level")]
    sizes: DataFrame | None = None
    for hop in range(1, max_hops + 1):
        current = levels[-1]
        links = graph.follow(current.select("seed", F.col("id").alias("a")))
        if skip_infra:
            links = links.filter(~F.col("b_infra"))
        if relationship:
            links = links.filter(F.col("relationship") == relationship)
        reached = links.select("seed", F.col("b").alias("id")).distinct()
        # neighbours of level h lie on levels h-1, h or h+1, so two levels are enough to subtract
        for earlier in levels[-2:]:
            reached = reached.join(earlier.select("seed", "id"), ["seed", "id"], "left_anti")
        if max_size is not None:
            sizes = _union([lv.select("seed") for lv in levels]).groupBy("seed").agg(
                F.count(F.lit(1)).alias("taken"))
            order = Window.partitionBy("seed").orderBy("id")
            reached = (reached.withColumn("place", F.row_number().over(order))
                       .filter(F.col("place") <= max_size)
                       .join(F.broadcast(sizes), "seed")  # one row per seed
                       .filter(F.col("taken") + F.col("place") <= max_size)
                       .select("seed", "id"))
        level = materialize(reached.withColumn("hop", F.lit(hop)), "level")
        if level.isEmpty():
            break
        levels.append(level)
    return _union(levels)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def level_edges(graph: PropertyGraph, levels: DataFrame, relationship: str | None = None) -> DataFrame:
    """Edges that join two successive levels of the same seed: ``(seed, source, target, relationship)``.

    Edges inside one level, self-loops and edges to nodes outside are left out;
    parallel edges are kept. Only the levels move.
    """
    links = graph.follow(levels.select("seed", F.col("id").alias("a"), F.col("hop").alias("sh"))).filter("forward")
    if relationship:
        links = links.filter(F.col("relationship") == relationship)
    dst = levels.select("seed", F.col("id").alias("b"), F.col("hop").alias("th"))
    return (links.join(dst, ["seed", "b"]).filter(F.abs(F.col("sh") - F.col("th")) == 1)
            .select("seed", F.col("a").alias("source"), F.col("b").alias("target"), "relationship"))


def neighbors(graph: PropertyGraph, node_id: str, max_hops: int = 2, relationship: str | None = None,
              skip_infra: bool = True, max_size: int | None = 200) -> tuple[DataFrame, DataFrame]:
    """Nodes (with ``hop``) and edges of one node's neighbourhood."""
    levels = neighborhood_levels(graph, [node_id], max_hops, relationship, skip_infra, max_size)
    nodes = levels.drop("seed").join(graph.nodes, "id")
    edges = level_edges(graph, levels, relationship)
    return nodes, edges.drop("seed")


def subgraph(graph: PropertyGraph, seeds: Sequence[str], max_hops: int = 2,
             max_nodes: int = 50) -> tuple[DataFrame, DataFrame]:
    """Joint neighbourhood of the existing seeds, seeds first, cut to ``max_nodes`` nodes.

    Each seed may contribute ``max(10, max_nodes // seeds)`` nodes. Edges found
    on the way are kept once when both ends survive the cut.
    """
    wanted = seed_frame(graph, seeds).select("id")
    known = {r["id"] for r in graph.nodes_of(wanted).select("id").collect()}
    valid = [s for s in dict.fromkeys(seeds) if s in known]
    if not valid:
        empty = graph.nodes.limit(0)
        return empty, graph.edges.select("source", "target", "relationship").limit(0)
    share = max(10, max_nodes // len(valid))
    levels = materialize(neighborhood_levels(graph, valid, max_hops, max_size=share), "levels")
    place = {s: i for i, s in enumerate(valid)}
    rank = F.coalesce(F.try_element_at(
        F.create_map(*[F.lit(x) for pair in place.items() for x in pair]), F.col("id")),
        F.lit(len(valid)))
    kept = (levels.groupBy("id").agg(F.min("hop").alias("hop"))
            .orderBy(rank, "hop", "id").limit(max_nodes))
    kept = materialize(kept, "kept")
    edges = level_edges(graph, levels)
    ids = kept.select("id")
    edges = (edges.select("source", "target", "relationship").distinct()
             .join(ids.select(F.col("id").alias("source")), "source", "left_semi")
             .join(ids.select(F.col("id").alias("target")), "target", "left_semi"))
    nodes = (kept.join(graph.nodes_of(kept), "id")
             .withColumn("description", F.substring(F.coalesce("description", F.lit("")), 1, 200)))
    return nodes, edges.select("source", "target", "relationship")


def traverse(graph: PropertyGraph, start: str, edge_types: Sequence[str], direction: str = "OUT",
             max_hops: int = 3, max_results: int | None = 30) -> tuple[DataFrame, DataFrame]:
    """Layers reached over the given edge types: ``(hop, id)`` and ``(hop, source, target, relationship)``.

    Every listed type may be used on every hop. Nodes are listed once, with all
    edges that lead into their layer; ``max_results`` counts the start node and
    keeps the first nodes in ``(hop, id)`` order.
    """
    if direction not in ("OUT", "IN", "BOTH"):
        raise ValueError(f"direction must be OUT, IN or BOTH, not {direction!r}")
    ahead = {"OUT": F.col("forward"), "IN": ~F.col("forward"), "BOTH": F.lit(True)}[direction]
    followed = F.col("relationship").isin(*edge_types) & ahead
    source, target = F.when(F.col("forward"), F.col("a")).otherwise(F.col("b")), F.when(F.col("forward"), F.col("b")).otherwise(F.col("a"))

    visited = materialize(graph.spark.createDataFrame([(start, 0)], "id string, hop int"), "layer")
    layers, layer_edges, taken = [visited], [], 1
    for hop in range(1, max_hops + 1):
        frontier = layers[-1].select(F.col("id").alias("a"))
        seen = _union([layer.select(F.col("id").alias("b")) for layer in layers])
        # written, so that the edges are read once a hop
        into = materialize(graph.follow(frontier, unique=True).filter(followed).join(seen, "b", "left_anti")
                           .select(source.alias("source"), target.alias("target"), "relationship", "b"), "steps")
        reached = into.select(F.col("b").alias("id")).distinct()
        if max_results is not None:
            reached = reached.orderBy("id").limit(max(0, max_results - taken))
        layer = materialize(reached.withColumn("hop", F.lit(hop)), "layer")
        size = layer.count()
        if not size:
            break
        taken += size
        layer_edges.append(into.join(layer.select(F.col("id").alias("b")), "b", "left_semi")
                           .select(F.lit(hop).alias("hop"), "source", "target", "relationship").distinct())
        layers.append(layer)
    nodes = _union(layers[1:]) if len(layers) > 1 else visited.limit(0)
    no_edges = visited.limit(0).select("hop", *[F.col("id").alias(c) for c in ("source", "target", "relationship")])
    return nodes.select("hop", "id"), _union(layer_edges) if layer_edges else no_edges
