"""All links between numbered nodes as blocks of arrays, for sums that run along every link round after round.

A node's number is a hash of its id and its block that number modulo the count of blocks. A link lies once, in the
block of that end which has fewer links between the two blocks (its low end); the other end is its hub. What two blocks
exchange in a round is one value for each hub, so a common node never costs more than one value a block.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import bucketed, materialize

# A block holds about so many link ends at most, and a small graph is one block; a few bytes each, in one task's memory.
BLOCK_ENDS = 48_000_000
LEAST_ENDS = 250_000

OWN = -1  # in place of the other block: what a block holds for itself, or links to nowhere
_BETWEEN = pa.schema([("block", pa.int32()), ("other", pa.int32()), ("counts", pa.binary()), ("low", pa.binary()),
                      ("hubs", pa.binary()), ("hub_counts", pa.binary())])
_HELD = pa.schema([("block", pa.int32()), ("other", pa.int32()), ("counts", pa.binary()), ("low", pa.binary()),
                   ("hubs", pa.binary()), ("keys", pa.binary()), ("degrees", pa.binary())])
_SENT = pa.schema([("block", pa.int32()), ("other", pa.int32()), ("hub_values", pa.binary()), ("sums", pa.binary())])
_SCORED = pa.schema([("key", pa.int64()), ("score", pa.float64())])
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    """One batch a row: rows are large."""
    cells = [[v.tobytes() if isinstance(v, np.ndarray) else v for v in row] for row in rows]
    return pa.Table.from_batches([pa.record_batch([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema) for row in cells], schema)


def _array(table: pa.Table, column: str, row: int, kind: type) -> np.ndarray:
    return np.frombuffer(table.column(column)[row].as_buffer(), kind)


def _between(links: pa.Table) -> pa.Table:
    """The links ``(pair, u, v)`` between two blocks as one row for either block."""
    block, other = divmod(links.column("pair")[0].as_py(), 1 << 32)
    other += OWN
    u = links.column("u").to_numpy()
    none = np.empty(0, np.int64)
    if other == OWN:  # they only add to a degree
        return _table(_BETWEEN, [(block, OWN, none, u, none, none)])
    v = links.column("v").to_numpy()
    _, number, degrees = np.unique(np.concatenate([u, v]), return_inverse=True, return_counts=True)
    degrees = degrees[number]
    to_v = degrees[len(u):] >= degrees[:len(u)]

    def grouped(low: np.ndarray, hub: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hubs, counts = np.unique(hub, return_counts=True)
        return hubs, counts.astype(np.int32), low[np.argsort(hub, kind="stable")]

    if block == other:
        hubs, counts, low = grouped(np.where(to_v, u, v), np.where(to_v, v, u))
        return _table(_BETWEEN, [(block, block, counts, low, hubs, counts)])
    there, here = grouped(u[to_v], v[to_v]), grouped(v[~to_v], u[~to_v])
    return _table(_BETWEEN, [(block, other, there[1], there[2], here[0], here[1]), (other, block, here[1], here[2], there[0], there[1])])


def _held(rows: pa.Table) -> pa.Table:
    """A block: its keys in order with their degrees, and its links to each other block by place among the keys."""
    block, others = rows.column("block")[0].as_py(), rows.column("other").to_pylist()
    ends = [(_array(rows, "low", i, np.int64), _array(rows, "hubs", i, np.int64)) for i in range(len(others))]
    keys = np.unique(np.concatenate([part for pair in ends for part in pair]))
    degrees, out = np.zeros(len(keys), np.int64), []
    for i, (other, (low, hubs)) in enumerate(zip(others, ends)):
        low, hubs = np.searchsorted(keys, low).astype(np.int32), np.searchsorted(keys, hubs).astype(np.int32)
        degrees += np.bincount(low, minlength=len(keys))
        degrees[hubs] += _array(rows, "hub_counts", i, np.int32)
        if other != OWN:
            out.append((block, other, _array(rows, "counts", i, np.int32), low, hubs, None, None))
    return _table(_HELD, [*out, (block, OWN, None, None, None, keys, degrees)])


def _gathered(held: pa.Table, sent: pa.Table | None, start: Mapping[int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and degrees of a block, and what has come along their links, added to ``start``."""
    at = {other: i for i, other in enumerate(held.column("other").to_pylist())}
    keys, degrees = _array(held, "keys", at[OWN], np.int64), _array(held, "degrees", at[OWN], np.int64)
    total = np.zeros(len(keys))
    for j, other in enumerate(sent.column("other").to_pylist() if sent is not None else ()):
        i = at[other]
        low, hubs = _array(held, "low", i, np.int32), _array(held, "hubs", i, np.int32)
        if len(low):
            values = np.repeat(_array(sent, "hub_values", j, np.float64), _array(held, "counts", i, np.int32))
            total += np.bincount(low, weights=values, minlength=len(keys))
        total[hubs] += _array(sent, "sums", j, np.float64)  # a hub stands there once
    for key, value in start.items():
        place = np.searchsorted(keys, key)
        if place < len(keys) and keys[place] == key:
            total[place] += value
    return keys, degrees, total


def _spread(held: pa.Table, sent: pa.Table | None, start: Mapping[int, float], alpha: float) -> pa.Table:
    """What a block sends to the others: its hubs' values, and sums of its low ends' values for their hubs."""
    _, degrees, scores = _gathered(held, sent, start)
    values, rows = alpha * scores / degrees, []
    block = held.column("block")[0].as_py()
    for i, other in enumerate(held.column("other").to_pylist()):
        if other == OWN:
            continue
        own, counts = values[_array(held, "hubs", i, np.int32)], _array(held, "counts", i, np.int32)
        low = values[_array(held, "low", i, np.int32)]
        sums = np.add.reduceat(low, np.cumsum(counts, dtype=np.int64) - counts) if len(counts) else low
        if own.any() or sums.any():
            rows.append((other, block, own, sums))
    return _table(_SENT, rows)


def _number(seed: int, node_id: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), node_id)


@dataclass(frozen=True)
class LinkBlocks:
    """``names (id)`` of all linked nodes, and the blocks ``(block, other, counts, low, hubs, keys, degrees)``, bucketed by block."""

    names: DataFrame
    blocks: DataFrame
    key: Callable[[Column | str], Column]

    @classmethod
    def build(cls, edges: DataFrame) -> "LinkBlocks":
        spark = edges.sparkSession
        names = materialize(edges.select(F.explode(F.array("source", "target")).alias("id")).filter(F.col("id").isNotNull()).distinct(), "names")
        ends, parallel = 2 * edges.count(), spark.sparkContext.defaultParallelism
        size = max(1, min(parallel, -(-ends // LEAST_ENDS)) if ends <= BLOCK_ENDS * parallel else parallel * -(-ends // (BLOCK_ENDS * parallel)))
        labels = _labels(spark, size)
        for seed in count():
            key = partial(_number, seed)
            made = cls(names, bucketed(cls._blocks(edges, key, labels), "blocks", size, "block"), key)
            numbered = made.blocks.filter(F.col("other") == OWN).agg(F.sum(F.length("keys") / 8)).first()[0] or 0
            if numbered == names.count():  # else two ids share a number: other numbers are tried
                return made

    @staticmethod
    def _blocks(edges: DataFrame, key: Callable[[Column | str], Column], labels: list[int]) -> DataFrame:
        size, label = F.lit(len(labels)), F.array(*[F.lit(x) for x in labels])
        keys = edges.select(*[F.when(F.col(c).isNotNull(), key(c)).alias(k) for c, k in (("source", "x"), ("target", "y"))])
        keys = keys.filter("x IS NOT NULL OR y IS NOT NULL").withColumn("bx", F.pmod("x", size)).withColumn("by", F.pmod("y", size))
        turned = F.col("x").isNull() | F.coalesce(F.col("by") < F.col("bx"), F.lit(False))
        name = lambda c: F.get(label, c.cast("int"))
        # a pair of blocks in one number sorts fast
        pair = F.shiftleft(name(F.when(turned, F.col("by")).otherwise(F.col("bx"))).cast("long"), 32) + F.coalesce(
            name(F.when(turned, F.col("bx")).otherwise(F.col("by"))) + 1, F.lit(0))
        dealt = keys.select(pair.alias("pair"), F.when(turned, F.col("y")).otherwise(F.col("x")).alias("u"),
                            F.coalesce(F.when(turned, F.col("x")).otherwise(F.col("y")), F.lit(0)).alias("v"))
        between = dealt.groupBy("pair").applyInArrow(_between, _ddl(_BETWEEN))
        return between.repartition(len(labels), "block").groupBy("block").applyInArrow(_held, _ddl(_HELD))

    def scores(self, start: Mapping[int, float], back: Mapping[int, float], alpha: float, rounds: int) -> DataFrame:
        """``(key, score)`` above 0 after so many rounds from ``start``.

        A round spreads ``alpha`` of every score evenly over the node's links and adds ``back``. Blocks stay
        where they are, only what they exchange is shuffled.
        """
        held = self.blocks.groupBy("block")

        def first(block: pa.Table) -> pa.Table:
            return _spread(block, None, start, alpha)

        def further(block: pa.Table, sent: pa.Table) -> pa.Table:
            return _spread(block, sent, back, alpha)

        def last(block: pa.Table, sent: pa.Table) -> pa.Table:
            keys, _, scores = _gathered(block, sent, back)
            some = scores > 0
            return pa.table([keys[some], scores[some]], schema=_SCORED)

        sent = held.applyInArrow(first, _ddl(_SENT))
        for _ in range(rounds - 1):
            sent = held.cogroup(sent.groupBy("block")).applyInArrow(further, _ddl(_SENT))
        return held.cogroup(sent.groupBy("block")).applyInArrow(last, _ddl(_SCORED))


def _labels(spark, size: int) -> list[int]:
    """For each of ``size`` hash partitions the smallest number that falls there: as names of blocks they give every task one block."""
    tried = spark.range(64 * size).select(F.col("id").cast("int").alias("n")).groupBy(F.pmod(F.hash("n"), F.lit(size)).alias("at"))
    return sorted(r["n"] for r in tried.agg(F.min("n").alias("n")).collect())  # one number a block
