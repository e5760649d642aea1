"""The property graph: node and edge tables plus a bucketed link layout for iteration."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.linkblocks import LinkBlocks
from graphloom.schema import INFRA_LAYER
from graphloom.session import Once, bucketed, materialize, work_path

# A node whose incident links exceed total / HOT_FRACTION is split over several
# buckets; at most HOT_FRACTION nodes can be that large, which bounds the list.
HOT_FRACTION = 4096
HOT_MINIMUM = 100_000
# Buckets are sized by the links they hold, with at least one per core.
BUCKET_ROWS = 5_000_000
MAX_BUCKETS = 100_000
# Up to so many frontier rows are sent to the edges; the links are laid out for larger frontiers only.
SMALL_FRONTIER = 500_000


@dataclass(frozen=True)
class Links:
    """Symmetric link table ``(a, salt, b, relationship, forward, degree, b_infra)``, bucketed by node.

    Both directions of every edge are present (``forward`` where a is the source), parallel edges are kept and a
    self-loop appears twice. ``hot`` lists the nodes split over several buckets
    (``a, splits``), at most ``HOT_FRACTION`` rows; the table is then bucketed
    by ``(a, salt)``. It is None when no node is that large, and the buckets
    are by ``a`` alone.
    """

    table: DataFrame
    hot: DataFrame | None
    buckets: int

    def follow(self, frontier: DataFrame, unique: bool = False) -> DataFrame:
        """Frontier rows (column ``a``) joined to their links; the links are not shuffled.

        A frontier with one row per node (``unique``) is hashed per bucket, which
        spares sorting the links; its share of a bucket is bounded by the nodes in it.
        """
        if self.hot is None:
            return (frontier.hint("shuffle_hash") if unique else frontier).join(self.table, "a")
        salted = (frontier.join(F.broadcast(self.hot), "a", "left")
                  .withColumn("salt", F.explode(F.sequence(
                      F.lit(0), F.coalesce(F.col("splits"), F.lit(1)) - 1)))
                  .drop("splits"))
        salted = salted.hint("shuffle_hash") if unique else salted
        return salted.join(self.table, ["a", "salt"])


@dataclass(frozen=True)
class Walk:
    """``keys (id, key)`` of all linked nodes, and the links with ``a`` and ``b`` as those numbers."""

    keys: DataFrame
    links: Links


class PropertyGraph:
    """Nodes ``(id, label, name, description, ..., properties)`` and edges ``(source, target, relationship)``."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes = nodes
        self.edges = edges
        self.spark: SparkSession = nodes.sparkSession

    def symmetric_edges(self) -> DataFrame:
        """Every edge seen from both ends: ``(a, b, relationship, forward)`` from one scan."""
        return self.edges.select(F.inline(F.array(
            F.struct(F.col("source").alias("a"), F.col("target").alias("b"), "relationship", F.lit(True).alias("forward")),
            F.struct(F.col("target").alias("a"), F.col("source").alias("b"), "relationship", F.lit(False).alias("forward")))))

    def near(self, ids: DataFrame) -> DataFrame:
        """:meth:`symmetric_edges` of few nodes (column ``a``).

        The ids are sent to the edges as an existence join: of edges that are worked out from
        tables with repeated rows, only theirs are made distinct.
        """
        few = F.broadcast(ids.select("a"))
        sides = [self.edges.join(few, F.col(a) == F.col("a"), "left_semi")
                 .select(F.col(a).alias("a"), F.col(b).alias("b"), "relationship", F.lit(a == "source").alias("forward"))
                 for a, b in (("source", "target"), ("target", "source"))]
        return sides[0].unionAll(sides[1])

    def nodes_of(self, ids: DataFrame) -> DataFrame:
        """The nodes of few ids (column ``id``)."""
        return self.nodes.join(F.broadcast(ids.select("id")), "id", "left_semi")

    @cached_property
    def infra(self) -> DataFrame:
        """Infrastructure nodes ``(b, b_infra)``, written so that Catalyst knows how few they are."""
        return materialize(self.nodes.filter(F.col("infra_layer") == INFRA_LAYER)
                           .select(F.col("id").alias("b"), F.lit(True).alias("b_infra")), "infra")

    def follow(self, frontier: DataFrame, unique: bool = False) -> DataFrame:
        """Frontier rows (column ``a``) joined to their links: ``b, relationship, forward, b_infra``.

        A small frontier meets the edges as they lie, in one scan for each of their ends
        without a shuffle; for a larger one, and where they are there, the laid out links are read.
        """
        if "links" in self.__dict__ or frontier.limit(SMALL_FRONTIER + 1).count() > SMALL_FRONTIER:
            return self.links.follow(frontier, unique)
        met = self.near(frontier).join(F.broadcast(frontier), "a")  # at most SMALL_FRONTIER rows
        return met.join(self.infra, "b", "left").withColumn("b_infra", F.coalesce("b_infra", F.lit(False)))

    @cached_property
    def _layout(self) -> tuple[DataFrame, DataFrame | None, int]:
        """All linked nodes ``(a, degree, key)``, those split over several buckets, and the number of buckets."""
        degrees = materialize(self.symmetric_edges().groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
                              .withColumn("key", F.monotonically_increasing_id()), "degrees")
        total = degrees.agg(F.sum("degree")).first()[0] or 0
        limit = max(HOT_MINIMUM, -(-total // HOT_FRACTION))
        hot = materialize(
            degrees.filter(F.col("degree") > limit)
            .select("a", "key", F.ceil(F.col("degree") / F.lit(limit)).cast("int").alias("splits")), "hot")
        # many links: as many buckets as a shuffle has partitions, so that sums by node lie where their links are
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        floor = min(partitions, self.spark.sparkContext.defaultParallelism) if total <= BUCKET_ROWS else partitions
        return degrees, None if hot.isEmpty() else hot, min(MAX_BUCKETS, max(floor, -(-total // BUCKET_ROWS)))

    @staticmethod
    def _salted(linked: DataFrame, hot: DataFrame | None, *spread: str) -> DataFrame:
        if hot is None:
            return linked.withColumn("salt", F.lit(0))
        return (linked.join(F.broadcast(hot), "a", "left")  # at most HOT_FRACTION rows
                .withColumn("salt", F.pmod(F.xxhash64(*spread), F.coalesce(F.col("splits"), F.lit(1))).cast("int")))

    @cached_property
    def links(self) -> Links:
        """Built once per graph object; every later hop then reads it unshuffled."""
        degrees, hot, buckets = self._layout
        hot = None if hot is None else hot.select("a", "splits")
        linked = self.symmetric_edges().join(degrees.select("a", "degree"), "a").join(self.infra, "b", "left")
        rows = self._salted(linked, hot, "b", "relationship").select(
            "a", "salt", "b", "relationship", "forward", "degree", F.coalesce("b_infra", F.lit(False)).alias("b_infra"))
        return Links(self._bucketed(rows, "links", buckets, hot is not None), hot, buckets)

    @cached_property
    def walk(self) -> Walk:
        """The links under numeric node keys, for operators that iterate over scores.

        Every edge meets the keys of its two ends once; only numbers are then
        turned into both directions and dealt to the buckets.
        """
        degrees, hot, buckets = self._layout
        ends = [degrees.select(F.col("a").alias(side), F.struct("key", "degree").alias(f"{side}_end")) for side in ("source", "target")]
        both = (self.edges.select("source", "target").join(ends[0], "source").join(ends[1], "target")
                .select(F.explode(F.array(F.struct(F.col("source_end").alias("x"), F.col("target_end").alias("y")),
                                          F.struct(F.col("target_end").alias("x"), F.col("source_end").alias("y")))).alias("l")))
        hot = None if hot is None else hot.select(F.col("key").alias("a"), "splits")
        rows = self._salted(both.select(F.col("l.x.key").alias("a"), F.col("l.y.key").alias("b"), F.col("l.x.degree").alias("degree")), hot, "b")
        keys = degrees.filter(F.col("a").isNotNull()).select(F.col("a").alias("id"), "key")
        return Walk(keys, Links(self._bucketed(rows.select("a", "salt", "b", "degree"), "walk", buckets, hot is not None), hot, buckets))

    def _bucketed(self, rows: DataFrame, name: str, buckets: int, salted: bool) -> DataFrame:
        columns = ["a", "salt"] if salted else ["a"]
        return bucketed(rows.repartition(buckets, *columns), name, buckets, *columns)

    @cached_property
    def blocks(self) -> LinkBlocks:
        """All links as blocks of arrays, for sums along every link."""
        return LinkBlocks.build(self.edges)


class StoredGraph(PropertyGraph):
    """The same graph over tables in the work folder: nodes partitioned by label, edges as they come.

    Either table is written when it is first read whole. Small frontiers meet
    the edges of the given graph until then, infrastructure nodes are read there always.
    """

    def __init__(self, graph: PropertyGraph):
        self.plain, self.spark = graph, graph.spark
        self._nodes = Once(self._write_nodes)
        self._edges = Once(lambda: materialize(graph.edges, "edges"))

    def _write_nodes(self) -> DataFrame:
        nodes, path = self.plain.nodes, work_path(self.spark, "nodes")
        nodes.write.partitionBy("label").parquet(path)
        return self.spark.read.schema(nodes.schema).parquet(path).select(*nodes.columns)

    @property
    def nodes(self) -> DataFrame:
        return self._nodes.get()

    @property
    def edges(self) -> DataFrame:
        return self._edges.get()

    @property
    def infra(self) -> DataFrame:
        return self.plain.infra

    def nodes_of(self, ids: DataFrame) -> DataFrame:
        return (self.plain if self._nodes.made is None else super()).nodes_of(ids)

    def near(self, ids: DataFrame) -> DataFrame:
        return (self.plain if self._edges.made is None else super()).near(ids)
