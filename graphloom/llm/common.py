"""Pieces that several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import materialize


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: UTF-8 bytes of texts whose words are found together; a longer text is handled by itself.
STEP_BYTES = 8_000_000


def text_steps(batch: pa.RecordBatch, column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``most`` bytes together."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words between ASCII white space (0x20, 0x09-0x0D), the number of each word of the texts in turn, and each text's bounds among these.

    A null text has no words. Nothing is kept between calls, so memory follows the step and not the vocabulary.
    """
    cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    found = cut.flatten().dictionary_encode()
    numbers = found.indices.to_numpy()
    ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False), dtype=np.int64)
    real = pc.not_equal(found.dictionary, "").to_numpy(zero_copy_only=False)
    if not real.all():  # white space at either end of a text
        kept = real[numbers]
        ends = np.r_[0, np.cumsum(kept)][ends]
        numbers = numbers[kept]
    return found.dictionary, numbers, np.r_[0, ends]


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word's UTF-8."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def tidy(run: Callable) -> Callable:
    """Let a task over Arrow batches give its free memory back to the machine when it ends: its worker lives on."""

    def leaving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform.startswith("linux"):
                with contextlib.suppress(OSError, AttributeError):  # another C library
                    ctypes.CDLL(None).malloc_trim(0)

    return leaving


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all of them."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut batches that come sorted by ``keys`` into one table a key; only one group is held at a time."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        codes = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(table.num_rows, bool)
        for code in codes:
            change[1:] |= code[1:] != code[:-1]
        cuts = [*np.flatnonzero(change).tolist(), table.num_rows]
        start = 0
        if held and all(held[-1].column(k)[0].as_py() == table.column(k)[0].as_py() for k in keys):
            held.append(table.slice(0, cuts[0]))
            start = cuts.pop(0)
            if not cuts:
                continue
        elif not held:
            held, start = [table.slice(0, cuts[0])], cuts.pop(0)
            if not cuts:
                continue
        yield pa.concat_tables(held).combine_chunks()
        for end in cuts[:-1]:
            yield table.slice(start, end - start).combine_chunks()
            start = end
        held = [table.slice(start, cuts[-1] - start)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def block_cells(rows: DataFrame, group: str, member: str, blocks: str) -> DataFrame:
    """Deal each group out to cells in which every pair of its members meets at least once.

    ``blocks`` names a column with the number of blocks of the row's group: a
    group of one block is one cell, a larger one is cut into that many blocks by
    a hash of ``member`` and every two blocks form a cell. Adds ``cell_low`` and
    ``cell_high``; a cell is (group, cell_low, cell_high).
    """
    own = F.pmod(F.xxhash64(member), F.col(blocks)).cast("int")
    dealt = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return dealt.withColumns({"cell_low": F.least("_own", "_other"), "cell_high": F.greatest("_own", "_other")}).drop("_own", "_other")


def arrow_cells(rows: DataFrame, keys: list[str], step: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Run ``step`` on each cell of ``rows``, cells streaming through sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, keys):
            out = step(table)
            if out is not None and out.num_rows:
                yield out

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), schema)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is the component's smallest node.

    Alternates hanging larger neighbours and smaller neighbours on the smallest
    one, which needs a logarithmic number of rounds. Every round is a written
    table; minima are combined before the shuffle, so a hub costs its row count
    in the mapping tasks and no task gathers its neighbours.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, before = materialize(links, "links"), None
    for _ in range(most_rounds):
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        links = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        after = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less its columns called as one of ``names`` in any letter case."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def field_names(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields]
