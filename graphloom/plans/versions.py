"""Named snapshots of a graph as versions of an edit log: history, search, time travel, rollback, archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.jsonprops import promote
from graphloom.graph import PropertyGraph
from graphloom.sources.edit_log import GRAPH, EditLog, changes


def history(manifest: DataFrame, limit: int = 30) -> DataFrame:
    """Saved and archived snapshots, newest first."""
    return (manifest.filter(F.col("action").isin("save", "archive"))
            .orderBy(F.desc("created_at"), F.desc("snapshot_id")).limit(max(1, min(200, limit))))


def search(manifest: DataFrame, keyword: str, limit: int = 50) -> DataFrame:
    """History entries whose message holds the keyword, ignoring case."""
    return history(manifest.filter(F.contains(F.lower("message"), F.lit(keyword.lower()))), limit)


class VersionStore:
    """Snapshots of nodes and edges under one folder.

    The first save writes whole tables, later ones the edits since the version
    they start from. A rollback makes a new version of an older one's files.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.log = EditLog(spark, folder)

    @property
    def manifest(self) -> DataFrame:
        """``(snapshot_id, action, message, created_at)``; an archive entry has the id of what it archives."""
        target = F.when(F.col("action") == "archive", F.col("target")).otherwise(F.col("version"))
        return self.log.manifest.select(target.alias("snapshot_id"), "action", "message", "created_at")

    def save(self, nodes: DataFrame, edges: DataFrame, message: str) -> dict:
        """Make whole tables the next snapshot; only rows that differ from the newest one are written."""
        if not message.strip():
            raise ValueError("save needs a message")
        tables, parent = {"nodes": nodes, "edges": edges}, self.log.head()
        if not parent:
            return self._saved(self.log.create(message, **tables).version, message)
        edits = {name: changes(self.log.read(name, parent), rows.select(*GRAPH[name].schema.names), GRAPH[name]) for name, rows in tables.items()}
        return self._saved(self.log.commit(edits, message, parent).version, message)

    def save_edits(self, edits: dict[str, DataFrame], message: str, parent: int) -> dict:
        """Edits on top of snapshot ``parent`` as the next one; fails if another writer was faster."""
        if not message.strip():
            raise ValueError("save needs a message")
        return self._saved(self.log.commit(edits, message, parent).version, message)

    def _saved(self, number: int, message: str) -> dict:
        return {"snapshot_id": number, "message": message,
                "node_count": self.log.read("nodes", number).count(), "edge_count": self.log.read("edges", number).count()}

    def graph(self, snapshot_id: int | None = None) -> PropertyGraph:
        """The graph of a snapshot, the current one by default."""
        return PropertyGraph(promote(self.log.read("nodes", snapshot_id)), self.log.read("edges", snapshot_id))

    def rollback(self, snapshot_id: int) -> int:
        """Make an older snapshot current; the number of the version that does so."""
        if self.log.version(snapshot_id).action != "save":
            raise LookupError(f"no snapshot {snapshot_id}")
        return self.log.rollback(snapshot_id).version

    def archive(self, snapshot_id: int) -> None:
        """Mark a snapshot as archived; its tables stay."""
        self.log.archive(snapshot_id)
