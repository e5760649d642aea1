"""Undirected shortest paths by alternating search from both ends."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.session import materialize


_VIA = "struct<a: string, relationship: string, source: string, target: string>"


class _Ends:
    """Levels ``(id, via)`` around the ends of paths; ``via`` is the smallest neighbour ``a`` one level nearer to the end, with its smallest edge.

    A level is made once, whatever number of searches use it, and all levels that
    are asked for together are made in one pass over the links.
    """

    def __init__(self, graph: PropertyGraph, ends: Iterable[str]):
        self.graph = graph
        unique = list(dict.fromkeys(ends))
        start = materialize(graph.spark.createDataFrame([(e, e, None) for e in unique], f"end string, id string, via {_VIA}"), "side")
        self.levels = {e: [start.filter(F.col("end") == e)] for e in unique}
        self.sizes = {e: [1] for e in unique}

    def grow(self, ends: Sequence[str]) -> None:
        frontier = _union([self.levels[e][-1] for e in ends]).select("end", F.col("id").alias("a"))
        known = _union([level for e in ends for level in self.levels[e][-2:]]).select("end", "id")
        source, target = F.when(F.col("forward"), F.col("a")).otherwise(F.col("b")), F.when(F.col("forward"), F.col("b")).otherwise(F.col("a"))
        via = F.struct("a", "relationship", source.alias("source"), target.alias("target"))
        reached = (self.graph.follow(frontier).groupBy("end", F.col("b").alias("id")).agg(F.min(via).alias("via"))
                   .join(known, ["end", "id"], "left_anti"))
        level = materialize(reached, "side")
        sizes = {r["end"]: r["count"] for r in level.groupBy("end").count().collect()}  # one row an end
        for e in ends:
            self.levels[e].append(level.filter(F.col("end") == e))
            self.sizes[e].append(sizes.get(e, 0))

    def back(self, end: str, node: str, depth: int) -> list[Row]:
        """The steps by smallest-id predecessors from a node of that level down to the end."""
        steps = []
        for level in reversed(self.levels[end][1:depth + 1]):
            steps.append(level.filter(F.col("id") == node).first()["via"])
            node = steps[-1]["a"]
        return steps


@dataclass
class _Path:
    """Ids in order and the edge between each two of them; both empty when there is no path."""

    ids: list[str]
    edges: list[Row]


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def shortest_paths(graph: PropertyGraph, pairs: Sequence[tuple[str, str]], max_depth: int = 10) -> list[_Path]:
    """For each pair a shortest path over edges taken in either direction, an empty one when none within depth.

    The two ends of a pair grow towards each other and the smaller frontier is
    expanded, so a search visits two balls of half the radius instead of one. Ties are
    broken by the smallest id. Equal ends give a one-node path even when the
    node does not exist. All pairs go forward together and share the levels of a common end.
    """
    found = {k: _Path([s], []) for k, (s, t) in enumerate(pairs) if s == t}
    depths = {k: [0, 0] for k in range(len(pairs)) if k not in found}
    if not depths:
        return [found[k] for k in range(len(pairs))]
    ends = _Ends(graph, [e for k in depths for e in pairs[k]])
    if max_depth > 0:
        ends.grow(list(ends.levels))  # the first step of either end, in one pass
    for _ in range(max_depth):
        grown = {}
        for k, at in depths.items():
            source, target = (ends.sizes[e][d] for e, d in zip(pairs[k], at))
            grown[k] = 0 if source <= target else 1
            at[grown[k]] += 1
        missing = [e for e, d in dict.fromkeys((pairs[k][side], depths[k][side]) for k, side in grown.items()) if d == len(ends.levels[e])]
        if missing:
            ends.grow(missing)
        for k, side in grown.items():
            if not ends.sizes[pairs[k][side]][depths[k][side]]:
                del depths[k]
        if not depths:
            break
        frontiers = {k: [ends.levels[e][d].select("id") for e, d in zip(pairs[k], at)] for k, at in depths.items()}
        met = _union([a.join(b, "id", "left_semi").agg(F.min("id").alias("id")).select(F.lit(k).alias("k"), "id") for k, (a, b) in frontiers.items()])
        for k, meeting in ((r["k"], r["id"]) for r in met.collect()):  # one row a pair
            if meeting is not None:
                head, tail = (ends.back(e, meeting, d) for e, d in zip(pairs[k], depths[k]))
                head.reverse()
                found[k] = _Path([*[r["a"] for r in head], meeting, *[r["a"] for r in tail]], head + tail)
                del depths[k]
        if not depths:
            break
    return [found.get(k, _Path([], [])) for k in range(len(pairs))]


def shortest_path(graph: PropertyGraph, source: str, target: str, max_depth: int = 10) -> list[str]:
    """Ids of :func:`shortest_paths` of one pair, ``[]`` when there is none."""
    return shortest_paths(graph, [(source, target)], max_depth)[0].ids


def _described(graph: PropertyGraph, found: Sequence[_Path]) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(path, step, id, label, name)`` and one edge per step ``(path, step, source, target, relationship)`` of few paths."""
    steps = graph.spark.createDataFrame([(k, i, x) for k, path in enumerate(found) for i, x in enumerate(path.ids)], "path int, step int, id string")
    nodes = (steps.join(graph.nodes_of(steps).select("id", "label", "name"), "id")
             .select("path", "step", "id", "label", F.coalesce("name", "id").alias("name")))
    edges = graph.spark.createDataFrame(
        [(k, i, e["source"], e["target"], e["relationship"]) for k, path in enumerate(found) for i, e in enumerate(path.edges)],
        "path int, step int, source string, target string, relationship string")
    return nodes, edges


def path_detail(graph: PropertyGraph, source: str, target: str,
                max_depth: int = 6) -> tuple[DataFrame, DataFrame]:
    """Path nodes ``(step, id, label, name)`` and one edge per step ``(step, source, target, relationship)``.

    Both are empty when there is no path; path ids without a node row are left out.
    """
    nodes, edges = _described(graph, shortest_paths(graph, [(source, target)], max_depth))
    return nodes.drop("path"), edges.drop("path")


def path_details(graph: PropertyGraph, pairs: Sequence[tuple[str, str]],
                 max_depth: int = 6) -> list[tuple[list[Row], list[Row]]]:
    """:func:`path_detail` of several pairs as rows in order, searched together."""
    found = shortest_paths(graph, pairs, max_depth)
    if not any(path.ids for path in found):
        return [([], []) for _ in pairs]
    parts = [part.orderBy("step").collect() for part in _described(graph, found)]  # a row a step of few paths
    return [tuple([r for r in rows if r["path"] == k] for rows in parts) for k in range(len(pairs))]
