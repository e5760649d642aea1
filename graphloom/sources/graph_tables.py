"""Stored node and edge tables: reading, upserting, deleting, clearing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.jsonprops import promote
from graphloom.graph import PropertyGraph
from graphloom.schema import EDGE_TABLE, NODE_TABLE

NODE_KEY = ["id"]
EDGE_KEY = ["source", "target", "relationship"]


def load_graph(spark: SparkSession, nodes_path: str, edges_path: str, fmt: str = "parquet") -> PropertyGraph:
    """Graph over raw tables; hot properties become typed columns."""
    nodes = spark.read.format(fmt).schema(NODE_TABLE).load(nodes_path)
    edges = spark.read.format(fmt).schema(EDGE_TABLE).load(edges_path)
    return PropertyGraph(promote(nodes), edges)


def save_tables(nodes: DataFrame, edges: DataFrame, nodes_path: str, edges_path: str) -> None:
    """Nodes partitioned by label, edges sorted by source inside their files."""
    nodes.select("id", "label", "properties").write.mode("overwrite").partitionBy("label").parquet(nodes_path)
    (edges.select("source", "target", "relationship", "properties")
     .sortWithinPartitions("source").write.mode("overwrite").parquet(edges_path))


def last_write_wins(rows: DataFrame, key: list[str], sequence: Column) -> DataFrame:
    """One row per key: the one with the highest ``sequence``; map-side combined."""
    others = [c for c in rows.columns if c not in key]
    packed = rows.withColumn("_seq", sequence)
    return (packed.groupBy(*key).agg(F.max_by(F.struct(*others), "_seq").alias("_row"))
            .select(*key, *[F.col(f"_row.{c}").alias(c) for c in others])
            .select(*rows.columns))


def upsert(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """``delta`` rows replace base rows with the same key; ``delta`` keys must be unique."""
    return base.join(delta.select(*key), key, "left_anti").select(*base.columns).unionByName(
        delta.select(*base.columns))


def insert_or_ignore(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """Base rows win over ``delta`` rows with the same key."""
    return base.unionByName(delta.join(base.select(*key), key, "left_anti").select(*base.columns))


@dataclass(frozen=True)
class Ingested:
    nodes: DataFrame
    edges: DataFrame
    nodes_added: int
    edges_added: int


def batch_ingest(graph_nodes: DataFrame, graph_edges: DataFrame, new_nodes: DataFrame,
                 new_edges: DataFrame) -> Ingested:
    """Insert-or-replace both tables. Rows carry ``seq``; counts are of input rows, not keys."""
    nodes = last_write_wins(new_nodes, NODE_KEY, F.col("seq")).drop("seq")
    edges = last_write_wins(new_edges, EDGE_KEY, F.col("seq")).drop("seq")
    return Ingested(upsert(graph_nodes, nodes, NODE_KEY), upsert(graph_edges, edges, EDGE_KEY),
                    new_nodes.count(), new_edges.count())


def delete_node(nodes: DataFrame, edges: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame]:
    """Without the node and all its edges."""
    return (nodes.filter(F.col("id") != node_id),
            edges.filter((F.col("source") != node_id) & (F.col("target") != node_id)))


def delete_edge(edges: DataFrame, source: str, target: str, relationship: str | None = None) -> DataFrame:
    hit = (F.col("source") == source) & (F.col("target") == target)
    if relationship:
        hit = hit & (F.col("relationship") == relationship)
    return edges.filter(~hit)


def clear(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return nodes.limit(0), edges.limit(0)


def by_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in the given order."""
    window = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") == 1).drop("_n")
