"""Numbering runs of equal adjacent rows without putting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = 10_000


def number_runs(rows: DataFrame, group: str, order: str, key: Column, joins: Column | None = None,
                width: int = SLICE) -> DataFrame:
    """Adds ``run``: 1 for the first rows of a group, one more whenever ``key`` changes in ``order``.

    ``joins`` limits which equal rows continue a run. The numeric ``order`` is cut
    into slices of ``width``; rows are numbered inside a slice and the slices,
    ``width`` times fewer, are chained by their first and last keys.
    """
    sliced = (rows.withColumn("_s", F.floor(F.col(order) / F.lit(width))).withColumn("_k", key)
              .withColumn("_j", F.lit(True) if joins is None else F.coalesce(joins, F.lit(False))))
    inside = Window.partitionBy(group, "_s").orderBy(order)
    same = F.lag("_k").over(inside).eqNullSafe(F.col("_k")) & F.col("_j")
    first = F.row_number().over(inside) == 1
    local = (sliced.withColumn("_new", (first | ~same).cast("int"))
             .withColumn("_n", F.sum("_new").over(inside)))
    edges = local.groupBy(group, "_s").agg(
        F.min_by(F.struct("_k", "_j"), order).alias("_f"), F.max_by("_k", order).alias("_l"), F.max("_n").alias("_c"))
    chain = Window.partitionBy(group).orderBy("_s")
    tied = (edges.withColumn("_tie", F.coalesce(
        (F.lag("_l").over(chain).eqNullSafe(F.col("_f._k")) & F.col("_f._j")
         & (F.row_number().over(chain) > 1)).cast("int"), F.lit(0)))
        .withColumn("_base", F.coalesce(F.sum(F.col("_c") - F.col("_tie")).over(
            chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_tie"))
        .select(group, "_s", "_base"))
    return (local.join(tied, [group, "_s"]).withColumn("run", F.col("_n") + F.col("_base"))
            .drop("_s", "_k", "_j", "_new", "_n", "_base"))
