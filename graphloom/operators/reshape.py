"""Whole-graph rewrites: merging nodes and editing trees, as table-to-table plans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.graph_tables import EDGE_KEY, by_first, upsert


@dataclass(frozen=True)
class Merged:
    nodes: DataFrame
    edges: DataFrame
    redirected: DataFrame  # one row: attempts, inserted


def merge_nodes(nodes: DataFrame, edges: DataFrame, sources: Sequence[str], target: str,
                delete_sources: bool = False) -> Merged:
    """Redirect all edges of the ``sources`` to ``target``.

    An edge that exists on the target already wins over a redirected one; of
    several redirected edges with one key the earliest source wins. Edges
    between a source and the target, or between two sources, disappear.
    """
    order = {s: i for i, s in enumerate(dict.fromkeys(sources)) if s != target}
    if not order:
        return Merged(nodes, edges, _counts(edges.limit(0), edges.limit(0)))
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    from_source, from_target = F.col("source").isin(*order), F.col("target").isin(*order)
    touched = edges.filter(from_source | from_target)
    kept = edges.filter(~(from_source | from_target))
    moved = (touched.filter(~(from_source & from_target))
             .withColumn("_place", F.coalesce(F.try_element_at(place, F.col("source")),
                                              F.try_element_at(place, F.col("target"))))
             .withColumn("_side", from_source.cast("int"))
             .withColumn("source", F.when(from_source, F.lit(target)).otherwise(F.col("source")))
             .withColumn("target", F.when(from_target, F.lit(target)).otherwise(F.col("target")))
             .filter(F.col("source") != F.col("target")))
    unique = by_first(moved, EDGE_KEY, [F.col("_place"), F.desc("_side")]).select(*edges.columns)
    added = unique.join(kept.select(*EDGE_KEY), EDGE_KEY, "left_anti").select(*edges.columns)
    left = nodes.filter(~F.col("id").isin(*order)) if delete_sources else nodes
    return Merged(left, kept.unionByName(added), _counts(moved, added))


def _counts(moved: DataFrame, added: DataFrame) -> DataFrame:
    both = moved.select(F.lit(1).alias("moved"), F.lit(0).alias("added")).unionAll(
        added.select(F.lit(0).alias("moved"), F.lit(1).alias("added")))
    return both.agg(F.coalesce(F.sum("moved"), F.lit(0)).alias("attempts"),
                    F.coalesce(F.sum("added"), F.lit(0)).alias("inserted"))


def merge_impact(nodes: DataFrame, edges: DataFrame, sources: Sequence[str], target: str) -> DataFrame:
    """Per source: label, name, out- and in-edge counts, and whether it will be skipped."""
    spark = nodes.sparkSession
    wanted = spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "place int, source_id string")
    counts = (edges.filter(F.col("source").isin(*sources) | F.col("target").isin(*sources))
              .select(F.inline(F.array(
                  F.struct(F.col("source").alias("source_id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                  F.struct(F.col("target").alias("source_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
              .groupBy("source_id").agg(F.sum("o").alias("out_edges"), F.sum("i").alias("in_edges")))
    known = nodes.filter(F.col("id").isin(*sources)).select(
        F.col("id").alias("source_id"), F.col("label").alias("source_label"), F.col("name").alias("source_name"))
    skip = F.col("source_label").isNull() | (F.col("source_id") == target)
    zero = F.lit(0).cast("long")
    return (wanted.join(known, "source_id", "left").join(counts, "source_id", "left")
            .select("place", "source_id", "source_label", "source_name",
                    F.when(skip, F.lit("skip")).otherwise(F.lit("merge")).alias("status"),
                    F.when(skip, zero).otherwise(F.coalesce("out_edges", zero)).alias("out_edges"),
                    F.when(skip, zero).otherwise(F.coalesce("in_edges", zero)).alias("in_edges"))
            .orderBy("place").drop("place"))


def reparented_edges(edges: DataFrame, node_id: str, relationship: str) -> DataFrame:
    """New edges when a tree node is taken out: each of its parents to each of its children.

    This is the join of its in-edges with its out-edges on the node itself, the
    operator's own result; it grows with parents x children of one node.
    """
    rel = edges.filter(F.col("relationship") == relationship)
    parents = rel.filter(F.col("target") == node_id).select("source", F.col("target").alias("via"))
    children = rel.filter(F.col("source") == node_id).select(F.col("source").alias("via"), "target")
    return (parents.join(children, "via")
            .select("source", "target", F.lit(relationship).alias("relationship"),
                    F.lit("{}").alias("properties")).dropDuplicates(EDGE_KEY))


def remove_and_reparent(nodes: DataFrame, edges: DataFrame, node_id: str,
                        relationship: str) -> tuple[DataFrame, DataFrame]:
    """Without the node and every edge of it; its parents take over its children."""
    new = reparented_edges(edges, node_id, relationship)
    grown = upsert(edges, new, EDGE_KEY)
    touches = (F.col("source") == node_id) | (F.col("target") == node_id)
    return nodes.filter(F.col("id") != node_id), grown.filter(~touches)


def insert_between(nodes: DataFrame, edges: DataFrame, parent: str, child: str, relationship: str,
                   new_node: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Put ``new_node`` (one row of the node table) on the edge from parent to child."""
    new_id = new_node.first()["id"]
    gone = ((F.col("source") == parent) & (F.col("target") == child)
            & (F.col("relationship") == relationship))
    fresh = nodes.sparkSession.createDataFrame(
        [(parent, new_id, relationship, "{}"), (new_id, child, relationship, "{}")],
        "source string, target string, relationship string, properties string")
    grown = nodes.filter(F.col("id") != new_id).unionByName(new_node, allowMissingColumns=True)
    return grown, upsert(edges.filter(~gone), fresh, EDGE_KEY)
