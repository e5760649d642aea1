"""Versions of keyed tables as base files plus sorted deltas of edits.

A version is one small manifest: for each table its base folder and the delta
folders on top of it. A commit writes the edits only, a rollback or an archive
only a manifest. Reading folds the edits of all deltas to at most one row a key
and lays them over the base in one join, so a plan has the same depth after one
edit or ten thousand, and Catalyst broadcasts the folded edits while they are
small. Folding is closed: folded edits are edits again, which is how deltas are
merged; ``compact`` writes a new base.

An edit row is a row of the table with ``op`` and ``seq``: ``put`` replaces the
row, ``set`` merges the top-level keys of its ``properties`` into those of an
existing row, ``drop`` is a tombstone. Edits of one key count in order of
(version, seq); a ``set`` without a row does nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.schema import EDGE_TABLE, NODE_TABLE
from graphloom.sources.manifest import CommitClash, Manifests

#: Deltas of a table after which a commit merges them into one.
MOST_DELTAS = 8
_ORDER = ("version", "seq")
_MANIFEST = "version int, parent int, action string, target int, message string, created_at timestamp, files map<string,struct<base:string,deltas:array<string>>>"


@dataclass(frozen=True)
class Files:
    base: str
    deltas: tuple[str, ...] = ()


@dataclass(frozen=True)
class Version:
    version: int
    parent: int
    action: str
    target: int
    message: str
    created_at: str
    files: dict[str, Files]


@dataclass(frozen=True)
class Table:
    """A keyed table with a JSON column ``properties``."""

    schema: T.StructType
    key: tuple[str, ...]

    @property
    def values(self) -> list[str]:
        return [f.name for f in self.schema.fields if f.name not in self.key]

    @property
    def edits(self) -> T.StructType:
        """Schema of stored edits."""
        loose = [T.StructField(f.name, f.dataType, True) for f in self.schema.fields]
        return T.StructType([*loose, T.StructField("op", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("version", T.IntegerType())])


GRAPH = {"nodes": Table(NODE_TABLE, ("id",)), "edges": Table(EDGE_TABLE, ("source", "target", "relationship"))}


def _fields(properties: Column) -> Column:
    return F.coalesce(F.from_json(properties, "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))


def merged(properties: Column, changes: Column) -> Column:
    """JSON ``properties`` with the top-level keys of JSON ``changes`` replaced in place or added; other keys keep their value."""
    current, new = _fields(properties), _fields(changes)
    kept = F.transform_values(current, lambda k, v: F.when(F.map_contains_key(new, k), F.try_element_at(new, k)).otherwise(v))
    return F.when(changes.isNull(), properties).otherwise(F.to_json(F.map_concat(kept, F.map_filter(new, lambda k, _: ~F.map_contains_key(current, k)))))


def fold(edits: DataFrame, table: Table) -> DataFrame:
    """At most one edit a key with the effect of all its edits.

    Everything is aggregated by key, or by key and JSON field, with partial
    aggregation before the shuffle; a key with very many edits is not gathered.
    """
    key, order = list(table.key), F.struct(*_ORDER)
    last = edits.where("op <> 'set'").groupBy(*key).agg(F.max_by(F.struct("op", *table.values, *_ORDER), order).alias("last"))
    later = edits.where("op = 'set'").join(last.select(*key, F.struct(*[F.col(f"last.{c}") for c in _ORDER]).alias("after")), key, "left")
    later = later.where(F.col("after").isNull() | (order > F.col("after")))
    values = later.select(*key, *_ORDER, F.explode(_fields(F.col("properties"))).alias("field", "value"))
    values = values.withColumn("value", F.to_json("value")).groupBy(*key, "field").agg(F.max_by("value", order).alias("value"), F.max(order).alias("at"))
    changed = values.groupBy(*key).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("field", F.parse_json("value").alias("value"))))).alias("changes"), F.max("at").alias("at"))
    both = last.join(changed, key, "full")
    whole = {c: F.col(f"last.{c}") for c in table.values}
    whole["properties"] = F.when(F.col("last.op") == "put", merged(F.col("last.properties"), F.col("changes"))).when(F.col("last").isNull(), F.col("changes"))
    at = F.greatest(F.struct(*[F.col(f"last.{c}") for c in _ORDER]), F.col("at"))
    at = F.when(F.col("last").isNull(), F.col("at")).when(F.col("at").isNull(), F.struct(*[F.col(f"last.{c}") for c in _ORDER])).otherwise(at)
    return both.select(*key, *[v.alias(c) for c, v in whole.items()], F.coalesce(F.col("last.op"), F.lit("set")).alias("op"), at.alias("at")).select(
        *table.schema.names, "op", *[F.col(f"at.{c}").alias(c) for c in reversed(_ORDER)])


def overlay(base: DataFrame, edits: DataFrame, table: Table) -> DataFrame:
    """``base`` with ``edits`` applied: one join with the folded edits, by which a small side is broadcast."""
    folded = fold(edits, table)
    sides = folded.select(*table.key, F.col("op").alias("_op"), F.col("properties").alias("_changes"))
    kept = base.join(sides, list(table.key), "left").where("_op is null or _op = 'set'")
    kept = kept.withColumn("properties", merged(F.col("properties"), F.col("_changes"))).select(*table.schema.names)
    return kept.unionByName(folded.where("op = 'put'").select(*table.schema.names))


def changes(before: DataFrame, after: DataFrame, table: Table) -> DataFrame:
    """Edits that turn ``before`` into ``after``: puts of new and changed rows, drops of missing ones."""
    old, new = F.struct(*[F.col(f"b.{c}") for c in table.values]), F.struct(*[F.col(f"a.{c}") for c in table.values])
    condition = [F.col(f"b.{c}") == F.col(f"a.{c}") for c in table.key]
    both = before.select("*", F.lit(True).alias("_is")).alias("b").join(after.select("*", F.lit(True).alias("_is")).alias("a"), condition, "full")
    gone, fresh = F.col("a._is").isNull(), F.col("b._is").isNull()
    different = both.where(gone | fresh | ~old.eqNullSafe(new))
    return different.select(*[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in table.key], *[F.col(f"a.{c}").alias(c) for c in table.values],
                            F.when(gone, "drop").otherwise("put").alias("op"), F.lit(0).cast("long").alias("seq"))


class EditLog:
    """Versioned tables under one folder: ``versions/<number>.json`` and folders of base and delta files."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Table] = GRAPH, most_deltas: int = MOST_DELTAS):
        self.spark, self.folder, self.tables, self.most_deltas = spark, folder.rstrip("/"), tables, most_deltas
        self.manifests = Manifests(spark, folder)

    # --- manifests ---------------------------------------------------------------

    @property
    def manifest(self) -> DataFrame:
        """All versions, one row each."""
        return self.spark.read.schema(_MANIFEST).json(self.manifests.folder) if self.head() else self.spark.createDataFrame([], _MANIFEST)

    def head(self) -> int:
        """Number of the newest version, 0 where there is none."""
        return self.manifests.head()

    def version(self, number: int | None = None) -> Version:
        row = self.manifests.read(self.head() if number is None else number)
        return Version(**{**row, "files": {k: Files(f["base"], tuple(f["deltas"])) for k, f in row["files"].items()}})

    def _publish(self, parent: int, action: str, message: str, files: dict[str, Files], target: int = 0) -> Version:
        made = Version(parent + 1, parent, action, target, message, datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ"), files)
        self.manifests.create(made.version, asdict(made))
        return made

    # --- writing -----------------------------------------------------------------

    def _base(self, rows: DataFrame, name: str) -> Files:
        path = f"{self.folder}/{name}/base-{uuid.uuid4().hex}"
        rows.select(*self.tables[name].schema.names).sortWithinPartitions(*self.tables[name].key).write.parquet(path)
        return Files(path)

    def _delta(self, edits: DataFrame, name: str, number: int | None) -> str:
        table, path = self.tables[name], f"{self.folder}/{name}/delta-{uuid.uuid4().hex}"
        rows = edits if number is None else edits.withColumn("version", F.lit(number))
        for c in table.edits.names:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(table.edits[c].dataType))
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in table.edits.fields])
        rows.repartitionByRange(*table.key).sortWithinPartitions(*table.key).write.parquet(path)
        return path

    def create(self, message: str = "", **tables: DataFrame) -> Version:
        """The first version."""
        return self._publish(0, "save", message, {name: self._base(rows, name) for name, rows in tables.items()})

    def commit(self, edits: dict[str, DataFrame], message: str = "", parent: int | None = None) -> Version:
        """Edits on top of version ``parent`` (the newest by default); ``CommitClash`` if that is no longer the newest.

        Only the edits are written. Beyond ``most_deltas`` deltas those of a table
        are folded into one, which reads and writes edits, not the base.
        """
        parent = self.head() if parent is None else parent
        if parent != self.head():
            raise CommitClash(f"version {parent} is no longer the newest")
        files = dict(self.version(parent).files)
        for name, rows in edits.items():
            at = files[name]
            deltas = (*at.deltas, self._delta(rows, name, parent + 1))
            if len(deltas) > self.most_deltas:
                deltas = (self._delta(fold(self._edits(name, deltas), self.tables[name]), name, None),)
            files[name] = Files(at.base, deltas)
        return self._publish(parent, "save", message, files)

    def compact(self) -> Version:
        """The newest version with a new base of every table and no deltas."""
        at = self.version()
        return self._publish(at.version, "compact", f"compact {at.version}", {name: self._base(self.read(name, at.version), name) for name in at.files})

    def rollback(self, number: int, message: str = "") -> Version:
        """A version with the files of an older one."""
        return self._publish(self.head(), "rollback", message or f"rollback to {number}", self.version(number).files, number)

    def archive(self, number: int) -> Version:
        """Mark a version as archived; its files stay."""
        self.version(number)
        return self._publish(self.head(), "archive", f"archive: {number}", self.version().files, number)

    # --- reading -----------------------------------------------------------------

    def _edits(self, name: str, deltas: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(self.tables[name].edits).parquet(*deltas)

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """A table as of a version, the newest by default."""
        files, table = self.version(number).files[name], self.tables[name]
        base = self.spark.read.schema(table.schema).parquet(files.base)
        return overlay(base, self._edits(name, files.deltas), table) if files.deltas else base

    def diff(self, name: str, old: int, new: int) -> DataFrame:
        """Keys that differ between two versions: (key.., change, before, after); change is added, removed or changed.

        Versions over the same base are compared at the keys of the deltas that
        only one of them has; otherwise whole tables are.
        """
        table, key = self.tables[name], list(self.tables[name].key)
        a, b = self.version(old).files[name], self.version(new).files[name]
        before, after = self.read(name, old), self.read(name, new)
        if a.base == b.base:
            apart = sorted(set(a.deltas) ^ set(b.deltas))
            if not apart:
                after = before.limit(0)
                before = after
            else:
                touched = self._edits(name, apart).select(*key).distinct()
                before, after = before.join(touched, key, "left_semi"), after.join(touched, key, "left_semi")
        packed = lambda rows, side: rows.select(*key, F.struct(*table.values).alias(side))
        both = packed(before, "before").join(packed(after, "after"), key, "full").where(~F.col("before").eqNullSafe(F.col("after")))
        change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
        return both.select(*key, change.alias("change"), "before", "after")


def cascade(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tombstones of all edges at ``nodes`` (id); each side joined by itself, no condition with an or."""
    ids = nodes.select("id").distinct()
    key = GRAPH["edges"].key
    touching = [edges.join(ids.withColumnRenamed("id", side), side, "left_semi").select(*key) for side in ("source", "target")]
    return touching[0].unionAll(touching[1]).distinct().select("*", F.lit("drop").alias("op"), F.lit(0).cast("long").alias("seq"))
