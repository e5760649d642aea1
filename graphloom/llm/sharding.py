"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition gives each place 0..k-1 a sum. Differencing takes the two
partial partitions with the largest spread and joins the largest place of one to
the smallest of the other, until one is left. Groups are dealt into blocks; each
block differences its own groups in one task, and the blocks' partial partitions,
k sums each, are differenced in turn (in levels of ``FAN_IN``), which is the
same step on larger items. Assignments then flow back as small joins.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.session import materialize

#: Groups that one task differences, partial partitions that one task joins.
BLOCK_GROUPS, FAN_IN = 20_000, 512
#: Pieces of a group that is larger than a fair share of the bytes.
PIECES = 256
#: Rows that one window numbers within a shard.
NUMBERED = 10_000


def difference(partials: Iterable[list[tuple[int, object]]], places: int) -> list[tuple[int, list]]:
    """Place sums, each with what landed there; a partial lists (sum, item) of its non-empty places.

    Ties are broken by the order of ``partials``, so the outcome is a function of the input.
    """
    heap = []
    for order, partial in enumerate(partials):
        slots = sorted(partial, key=lambda s: -s[0])
        heap.append((-(slots[0][0] - (slots[-1][0] if len(slots) == places else 0)), order, slots))
    if not heap:
        return [(0, []) for _ in range(places)]
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        shared = len(a) + len(b) - places
        if shared <= 0:
            slots = a + b
        else:  # a's smallest places meet b's largest in opposite order
            kept = len(a) - shared
            slots = a[:kept] + b[shared:]
            slots += [(a[kept + k][0] + b[shared - 1 - k][0], (a[kept + k][1], b[shared - 1 - k][1])) for k in range(shared)]
        slots.sort(key=lambda s: -s[0])
        heapq.heappush(heap, (-(slots[0][0] - (slots[-1][0] if len(slots) == places else 0)), order, slots))
        order += 1
    slots = heap[0][2] + [(0, None)] * (places - len(heap[0][2]))
    return [(total, _items(rope)) for total, rope in slots]


def _items(rope: object) -> list:
    found, stack = [], [rope]
    while stack:
        item = stack.pop()
        if isinstance(item, tuple):
            stack.extend(item)
        elif item is not None:
            found.append(item)
    return found


def _difference_groups(places: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["weight", "grp", "piece"], ascending=[False, True, True], ignore_index=True)
        place = [0] * len(block)
        for at, (_, members) in enumerate(difference(([(int(w), k)] for k, w in enumerate(block["weight"])), places)):
            for k in members:
                place[k] = at
        return block.assign(place=place)[["grp", "piece", "node", "weight", "place"]]

    return run


def _difference_nodes(places: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["node", "place"], ignore_index=True)
        partials = [[(int(w), int(k)) for k, w in zip(part.index, part["weight"])] for _, part in block.groupby("node", sort=True)]
        target = [0] * len(block)
        for at, (_, members) in enumerate(difference(partials, places)):
            for k in members:
                target[k] = at
        return block.assign(target=target)[["node", "place", "parent", "weight", "target"]]

    return run


def shard(docs: DataFrame, shards: int = 16, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of ``docs`` (doc_id, text, any others).

    size is the text's UTF-8 bytes (a null text: none) plus 1; slots count from 0
    in each shard, by a hash bucket, then doc_id. Rows of equal text form a group
    that stays together, null texts being a group of their own, unless a group
    is larger than the fair share of one shard: then it is cut into ``PIECES``
    by row, since no balance exists otherwise. Repeated rows count as rows; an
    empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    base = materialize(docs.select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null")).alias("grp"), F.monotonically_increasing_id().alias("row")), "sizes")
    groups = base.groupBy("grp").agg(F.sum("size").alias("weight"))
    total, n_rows, n_groups = base.agg(F.sum("size"), F.count("*"), F.approx_count_distinct("grp")).first()
    if not n_rows:
        return base.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    large = [r.grp for r in groups.where(F.col("weight") * shards > total).collect()]  # fewer than the shards
    base = base.withColumn("piece", F.when(F.col("grp").isin(large), F.pmod(F.xxhash64("row"), F.lit(PIECES)).cast("int")).otherwise(0))

    nodes = max(1, -(-(n_groups + PIECES * len(large)) // block_groups))
    units = base.groupBy("grp", "piece").agg(F.sum("size").alias("weight")).withColumn("node", F.pmod(F.xxhash64("grp", "piece"), F.lit(nodes)))
    placed = materialize(units.groupBy("node").applyInPandas(_difference_groups(shards), "grp string, piece int, node long, weight long, place int"), "placed")

    level = placed.groupBy("node", "place").agg(F.sum("weight").alias("weight"))
    target = placed.select("grp", "piece", "node", "place")
    while True:
        parents = -(-nodes // FAN_IN)
        joined = level.withColumn("parent", F.col("node") % parents).groupBy("parent").applyInPandas(
            _difference_nodes(shards), "node long, place int, parent long, weight long, target int")
        joined = materialize(joined, "level")
        target = target.join(joined.select("node", "place", "parent", "target"), ["node", "place"]).select(
            "grp", "piece", F.col("parent").alias("node"), F.col("target").alias("place"))
        if parents == 1:
            break
        nodes = parents
        level = joined.groupBy(F.col("parent").alias("node"), F.col("target").alias("place")).agg(F.sum("weight").alias("weight"))

    buckets = max(1, n_rows // (shards * NUMBERED))
    sharded = materialize(base.join(target, ["grp", "piece"]).select(
        "doc_id", "size", "text_crc32", F.col("place").alias("shard"), "row", F.pmod(F.xxhash64("row"), F.lit(buckets)).alias("bucket")), "sharded")
    counts = sharded.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "row"))
    return sharded.withColumn("within", within).join(before, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("within") - 1).alias("slot"))
