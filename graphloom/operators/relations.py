"""Lookups, relational joins and counts over nodes and edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.jsonprops import property_keys
from graphloom.graph import PropertyGraph
from graphloom.schema import INFRA_LAYER

DIRECTIONS = ("OUT", "IN", "BOTH")


def _check_direction(direction: str) -> None:
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}, not {direction!r}")


def _with_relationship(edges: DataFrame, relationship: str | None) -> DataFrame:
    return edges.filter(F.col("relationship") == relationship) if relationship else edges


# --- point lookups -----------------------------------------------------------

def nodes_by_label(graph: PropertyGraph, label: str) -> DataFrame:
    """Label scan; prunes to one partition on a node table partitioned by label."""
    return graph.nodes.filter(F.col("label") == label)


def node(graph: PropertyGraph, node_id: str) -> DataFrame:
    return graph.nodes.filter(F.col("id") == node_id)


def edge(graph: PropertyGraph, source: str, target: str, relationship: str | None = None) -> DataFrame:
    """The edge between two nodes; the first relationship by name when none is given."""
    found = graph.edges.filter((F.col("source") == source) & (F.col("target") == target))
    return _with_relationship(found, relationship).orderBy("relationship").limit(1)


def has_node(graph: PropertyGraph, node_id: str) -> bool:
    return not node(graph, node_id).select("id").isEmpty()


def has_edge(graph: PropertyGraph, source: str, target: str, relationship: str | None = None) -> bool:
    return not edge(graph, source, target, relationship).isEmpty()


def find_edges(graph: PropertyGraph, node_id: str, direction: str = "BOTH",
               relationship: str | None = None) -> DataFrame:
    """Incident edges. With BOTH, out- and in-edges are concatenated: a self-loop shows twice."""
    _check_direction(direction)
    edges = _with_relationship(graph.edges, relationship).select("source", "target", "relationship")
    outgoing = edges.filter(F.col("source") == node_id)
    incoming = edges.filter(F.col("target") == node_id)
    if direction == "OUT":
        return outgoing
    return incoming if direction == "IN" else outgoing.unionAll(incoming)


def related_nodes(graph: PropertyGraph, node_id: str, relationship: str | None = None,
                  direction: str = "OUT") -> DataFrame:
    """One row per incident edge whose other end exists (parallel edges repeat the node)."""
    ends = find_edges(graph, node_id, direction, relationship)
    if direction == "BOTH":
        # the in-half of a self-loop and its out-half both lead back to the node
        other = F.when(F.col("source") == node_id, F.col("target")).otherwise(F.col("source"))
    else:
        other = F.col("target" if direction == "OUT" else "source")
    return ends.select(other.alias("id"), "relationship").join(graph.nodes, "id")


# --- search and paging -------------------------------------------------------

def search_nodes(graph: PropertyGraph, keyword: str, limit: int = 20) -> DataFrame:
    """Nodes whose id, label or name matches ``%keyword%`` ignoring case; % and _ stay wildcards."""
    pattern = f"%{keyword}%"
    hit = (F.col("id").ilike(pattern) | F.col("label").ilike(pattern)
           | F.coalesce(F.col("name"), F.lit("")).ilike(pattern))
    return graph.nodes.filter(hit).orderBy("id").limit(limit)


def label_page(graph: PropertyGraph, label: str, value_column: Column | None = None,
               contains: str = "", limit: int = 50, offset: int = 0,
               after: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One page of a label in id order, and the one-row total of matching nodes.

    ``after``, the last id of the page before, reaches any page without
    counting through the earlier ones.
    """
    limit, offset = max(1, min(200, limit)), max(0, offset)
    rows = nodes_by_label(graph, label)
    if value_column is not None and contains:
        rows = rows.filter(F.contains(F.lower(value_column), F.lit(contains.lower())))
    page = rows if after is None else rows.filter(F.col("id") > after)
    return (page.orderBy("id").offset(offset).limit(limit),
            rows.agg(F.count(F.lit(1)).alias("total")))


def not_infra(layer: Column) -> Column:
    return F.coalesce(layer, F.lit("")) != INFRA_LAYER


def without_labels(nodes: DataFrame, labels: Sequence[str]) -> DataFrame:
    return nodes.filter(~F.coalesce(F.col("label"), F.lit("")).isin(*labels))


# --- edge sets ---------------------------------------------------------------

def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids`` (column ``id``, distinct)."""
    return (edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi")
            .join(ids.select(F.col("id").alias("target")), "target", "left_semi")
            .select("source", "target", "relationship"))


def dangling_edges(graph: PropertyGraph) -> DataFrame:
    """Edges that name a missing node on either end."""
    ids = graph.nodes.select("id")
    edges = graph.edges.select("source", "target", "relationship")
    no_source = edges.join(ids, edges["source"] == ids["id"], "left_anti")
    no_target = (edges.join(ids, edges["source"] == ids["id"], "left_semi")
                 .join(ids, F.col("target") == ids["id"], "left_anti"))
    return no_source.unionAll(no_target)


def visible_subgraph(nodes: DataFrame, edges: DataFrame, labels: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes with a chosen or empty label, and the edges between them."""
    kept = nodes.filter(F.coalesce(F.col("label"), F.lit("")).isin("", *labels))
    return kept, induced_edges(edges, kept.select("id"))


def merge_views(nodes: DataFrame, more_nodes: DataFrame, edges: DataFrame,
                more_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union of two result graphs, one row per node id and per (source, target, relationship)."""
    return (nodes.unionByName(more_nodes).dropDuplicates(["id"]),
            edges.unionByName(more_edges).dropDuplicates(["source", "target", "relationship"]))


# --- counts and schema -------------------------------------------------------

def graph_counts(graph: PropertyGraph) -> DataFrame:
    nodes = graph.nodes.agg(F.count(F.lit(1)).alias("node_count"))
    edges = graph.edges.agg(F.count(F.lit(1)).alias("edge_count"))
    return nodes.withColumn("k", F.lit(1)).join(edges.withColumn("k", F.lit(1)), "k").drop("k")


def labels(graph: PropertyGraph) -> DataFrame:
    return (graph.nodes.select("label").filter(F.coalesce(F.col("label"), F.lit("")) != "")
            .distinct().orderBy("label"))


def label_counts(graph: PropertyGraph, keep_missing: bool = False) -> DataFrame:
    rows = graph.nodes.select("label")
    if not keep_missing:
        rows = rows.filter(F.coalesce(F.col("label"), F.lit("")) != "")
    return (rows.groupBy("label").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "label"))


def schema_overview(graph: PropertyGraph) -> DataFrame:
    """Counts per node label and per relationship, as one long table."""
    by_label = label_counts(graph, keep_missing=True).select(
        F.lit("node_label").alias("kind"), F.col("label").alias("name"), "count")
    by_rel = (graph.edges.groupBy("relationship").agg(F.count(F.lit(1)).alias("count"))
              .select(F.lit("edge_type").alias("kind"), F.col("relationship").alias("name"), "count"))
    return by_label.unionAll(by_rel)


def relationship_patterns(graph: PropertyGraph) -> DataFrame:
    """Edge counts by (source label, relationship, target label); dangling edges are left out.

    Edges are first counted per (target, relationship, source label), so a hub
    on either end costs one row per label after the map-side combine.
    """
    names = graph.nodes.select("id", "label")
    by_source = (graph.edges.join(names.select(F.col("id").alias("source"),
                                               F.col("label").alias("src_label")), "source")
                 .groupBy("target", "relationship", "src_label").agg(F.count(F.lit(1)).alias("n")))
    return (by_source.join(names.select(F.col("id").alias("target"),
                                        F.col("label").alias("tgt_label")), "target")
            .groupBy("relationship", "src_label", "tgt_label").agg(F.sum("n").alias("count"))
            .withColumn("pattern", F.format_string("%s -[%s]-> %s", "src_label", "relationship", "tgt_label"))
            .select("pattern", "count"))


def label_detail(graph: PropertyGraph) -> DataFrame:
    """Per label: node count and the public property keys of its first node by id."""
    return (graph.nodes.groupBy("label")
            .agg(F.count(F.lit(1)).alias("count"), F.min_by("properties", "id").alias("sample"))
            .select("label", "count", F.array_sort(property_keys("sample")).alias("fields")))


def degrees(graph: PropertyGraph) -> DataFrame:
    """Incident edge ends per node, both directions (a self-loop counts twice)."""
    return (graph.symmetric_edges().groupBy(F.col("a").alias("id"))
            .agg(F.count(F.lit(1)).alias("degree")))


def names_by_label(nodes: DataFrame, shown: int = 5) -> DataFrame:
    """Per label the first names in id order and how many nodes it has in all."""
    order = Window.partitionBy("label").orderBy("id")
    first = (nodes.select("label", "id", "name")
             .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= shown)
             .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("n"))
             .select("label", F.array_join(F.col("n")["name"], ", ").alias("names")))
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("total")).join(first, "label")


# --- support scores ----------------------------------------------------------

def neighbor_score_sum(graph: PropertyGraph, ids: DataFrame, scores: DataFrame) -> DataFrame:
    """``(id, support)``: scores ``(id, score)`` of the distinct direct neighbours of ``ids``, summed."""
    near = (graph.follow(ids.select(F.col("id").alias("a")))
            .select(F.col("a").alias("id"), F.col("b").alias("neighbor")).distinct())
    return (near.join(scores.select(F.col("id").alias("neighbor"), "score"), "neighbor")
            .groupBy("id").agg(F.sum("score").alias("support")))


def community_support(graph: PropertyGraph, importance: dict[str, float], hops: int,
                      label: str = "CodeFile", max_size: int | None = 260) -> DataFrame:
    """``(id, support)``: per node of ``label``, the importance of all terms within ``hops``."""
    from graphloom.operators.neighborhood import neighborhood_levels

    levels = neighborhood_levels(graph, list(importance), hops, max_size=max_size)
    weight = F.create_map(*[F.lit(x) for pair in importance.items() for x in pair])
    targets = graph.nodes.filter(F.col("label") == label).select("id")
    return (levels.join(targets, "id", "left_semi")
            .groupBy("id").agg(F.sum(F.element_at(weight, F.col("seed"))).alias("support")))
