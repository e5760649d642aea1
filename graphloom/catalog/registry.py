"""Registration of queries and the per-session objects they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.graph import PropertyGraph, StoredGraph
from graphloom.plans.retrieve import Retriever
from graphloom.sources.star_graph import snippets, star_graph, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_shared: dict[tuple, object] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(context)`` under ``name``, with the SQL that yields the same rows."""

    def add(fn: Callable[["Context"], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Context(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


class Context:
    """One data folder in one session; graph and indexes are built on first use and kept."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def _once(self, what: str, build: Callable[[], object]):
        key = (self.spark.sparkContext.applicationId, self.sf_dir.rstrip("/"), what)
        if key not in _shared:
            _shared[key] = build()
        return _shared[key]

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def graph(self) -> PropertyGraph:
        return self._once("graph", lambda: StoredGraph(star_graph(self.spark, self.sf_dir)))

    @property
    def retriever(self) -> Retriever:
        return self._once("retriever", lambda: Retriever.build(
            self.graph, snippets(self.spark, self.sf_dir)))

    @property
    def snippets(self) -> DataFrame:
        return snippets(self.spark, self.sf_dir)

    def vector(self, vec_id: int) -> list[float]:
        """A stored vector as the query vector (one row)."""
        return list(self.table("embeddings").filter(f"vec_id = {int(vec_id)}").first()["embedding"])
