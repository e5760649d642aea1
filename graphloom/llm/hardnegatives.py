"""Hard negatives: rows of another label whose score with an anchor lies in a window below that of a positive.

Vectors travel as packed blocks. A cell is a group of anchors against a slice of
rows; one matrix product scores it. A first round keeps each anchor's best
positives of a cell, a second one the best negatives of a cell in every window
that these open, so only a few rows an anchor and cell are shuffled. Both end in
a secondary sort: rows are dealt by anchor and sorted by a packed key of anchor,
descending score, kind and id, and one iterator passes over the sorted rows,
opens a window at each positive and emits negatives while they come; no anchor's
rows are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import tidy
from graphloom.session import materialize

#: Rows of a packed block, anchors of a group, rows of a slice.
BLOCK, GROUP, SLICE = 4096, 2048, 16_384
#: Within a cell a score and a place share 64 bits.
_PLACES = 1 << 13
_NO_ID, _NONE = np.iinfo(np.int64).max, np.iinfo(np.int64).min
_SIGN = np.uint64(1 << 63)

_PACKED = "block long, n int, dim int, ids binary, labels binary, places binary, vectors binary"
_FOUND = "key binary, anchor long, anchor_id long, kind int, id long, score long"


def scaled(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * component) of each row's vector, rows shorter than the longest filled with zeros, and which rows take part."""
    vectors = batch.column("embedding")
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(vectors).cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null reads as not a number
    out = np.zeros((batch.num_rows, int(sizes.max(initial=0))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    real = np.isfinite(out).all(1) & pc.is_valid(vectors).to_numpy(zero_copy_only=False)
    real &= pc.is_valid(batch.column("label")).to_numpy(zero_copy_only=False)
    return np.floor(scale * np.where(real[:, None], out, 0)), real


def _pack(block: int, ids: np.ndarray, labels: np.ndarray, places: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    small = np.abs(vectors).max(initial=0) < 1 << 24
    values = ([block], [len(ids)], [vectors.shape[1]], [ids.tobytes()], [labels.tobytes()], [places.tobytes()], [vectors.astype(np.float32 if small else np.float64).tobytes()])
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["block", "n", "dim", "ids", "labels", "places", "vectors"])


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels, places (of a row in the whole table) and vectors of a packed block."""
    kind = np.float32 if len(row["vectors"]) == 4 * row["n"] * row["dim"] else np.float64
    return (*(np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "places")), np.frombuffer(row["vectors"], kind).reshape(row["n"], row["dim"]))


def _blocks(scale: float):
    """Rows to packed blocks in which they are ordered by id, rows without an id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                vectors, real = scaled(batch, scale)
                ids = pc.fill_null(batch.column("vec_id"), _NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
                labels = pc.fill_null(batch.column("label"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                kept = np.flatnonzero(real)
                kept = kept[np.argsort(ids[kept], kind="stable")]
                if len(kept):
                    yield _pack(block, ids[kept], labels[kept], (block * BLOCK) + np.arange(len(kept)), vectors[kept])
                    block += 1

    return run


def _anchors(every: int):
    """The anchors of packed blocks as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, places, vectors = _unpack(row)
                at = np.flatnonzero((ids % every == 0) & (ids != _NO_ID))
                if len(at):
                    listed = pa.array([v.tobytes() for v in vectors[at].astype(np.float64)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(labels[at]), pa.array(places[at]), listed], ["id", "label", "place", "vector"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of anchors as one packed block, called by the partition's number."""
    from pyspark import TaskContext

    tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if tables:
        table = pa.concat_tables(tables).combine_chunks()
        listed = [np.frombuffer(v, np.float64) for v in table.column("vector").to_pylist()]
        vectors = np.zeros((len(listed), max(map(len, listed))))
        for k, v in enumerate(listed):
            vectors[k, : len(v)] = v
        yield _pack(TaskContext.get().partitionId(), *(table.column(c).to_numpy() for c in ("id", "label", "place")), vectors)


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products (anchors down, rows across); 64-bit integers, or Python's where these might not hold them with a place."""
    dim = min(anchors.shape[1], rows.shape[1])
    a, b = anchors[:, :dim], rows[:, :dim]
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(dim, 1)
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 49:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return whole(a).dot(whole(b).T) if dim else np.zeros((len(a), len(b)), object)


def ranked(scores: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line of ``scores`` with its places in ascending order of score, then descending place; entries not ``taken`` first, as the lowest.

    Returns sorted scores (``None``-like lowest value where not taken) and places.
    """
    if scores.dtype != object:
        n = scores.shape[1]
        keys = np.where(taken, scores * _PLACES + (_PLACES - 1 - np.arange(n)), _NONE)
        keys.sort(axis=1)
        return np.where(keys == _NONE, _NONE, keys >> 13), _PLACES - 1 - (keys & (_PLACES - 1))
    lowest = min((int(x) for x in scores.flat), default=0) - 1
    marked = np.where(taken, scores, lowest)
    places = np.array([sorted(range(len(line)), key=lambda k: (line[k], -k)) for line in marked], np.int64).reshape(scores.shape)
    values = np.take_along_axis(marked, places, axis=1)
    return np.where(values == lowest, np.array(-(10**400), object), values), places


def _emit(found: list[tuple]) -> pa.RecordBatch:
    """Rows (anchor, anchor_id, kind, id, score) with their packed keys: anchor, descending score, kind, id, in bytes that sort as they should."""
    anchor, anchor_id, kind, ids, score = (np.concatenate(c) for c in zip(*found))
    key = np.empty(len(ids), [("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
    key["anchor"], key["kind"] = anchor.astype(np.uint64), kind
    key["score"], key["id"] = ~(score.astype(np.uint64) ^ _SIGN), ids.astype(np.uint64) ^ _SIGN
    keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(key.dtype.itemsize), len(key), [None, pa.py_buffer(key.tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays(
        [keys, pa.array(anchor), pa.array(anchor_id), pa.array(kind.astype(np.int32)), pa.array(ids, mask=ids == _NO_ID), pa.array(score)],
        ["key", "anchor", "anchor_id", "kind", "id", "score"])


def _cells(positives: int, negatives: int, low: int, high: int):
    """Score joined cells: the best positives of each anchor, or, where the windows are known, the best negatives in each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids, labels, places, vectors = _unpack(row["rows"])
                own_ids, own_labels, own_places, own = _unpack(row["anchors"])
                scores, alike, found = products(own, vectors), own_labels[:, None] == labels, []
                numbers = (np.int64(row["group"]) << 32) + np.arange(len(own_ids), dtype=np.int64)

                def keep(lines: np.ndarray, values: np.ndarray, columns: np.ndarray, kind: int) -> None:
                    found.append((numbers[lines], own_ids[lines], np.full(len(lines), kind), ids[columns], np.array(values, np.int64)))

                if row["windows"] is None:
                    values, order = ranked(scores, alike & (own_places[:, None] != places))
                    best = values[:, -positives:]
                    lines, columns = np.nonzero(best > _NONE)
                    keep(lines, best[lines, columns], order[:, -positives:][lines, columns], 0)
                else:
                    values, order = ranked(scores, ~alike)
                    lines, columns = [], []
                    for window in row["windows"]:
                        line, score = window["anchor"] - int(numbers[0]), window["score"]
                        least, most = -(-low * score // 100), high * score // 100
                        end = int(np.searchsorted(values[line], most, side="right"))
                        taken = [k for k in range(max(0, end - negatives), end) if values[line][k] >= least and values[line][k] > _NONE]
                        lines += [line] * len(taken)
                        columns += taken
                    lines, columns = np.array(lines, np.int64), np.array(columns, np.int64)
                    _, first = np.unique(lines * values.shape[1] + columns, return_index=True)  # windows overlap
                    lines, columns = lines[first], columns[first]
                    keep(lines, values[lines, columns], order[lines, columns], 1)
                if found and len(found[0][0]):
                    yield _emit(found)

    return run


def secondary_sort(found: DataFrame, step, schema: str) -> DataFrame:
    """Deal rows out by anchor, sort each partition by the packed key, and pass one iterator over it."""
    return found.repartition("anchor").sortWithinPartitions("key").mapInArrow(tidy(step), schema)


def _first(positives: int):
    """The first ``positives`` rows of every anchor in a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, seen = None, 0
        for batch in batches:
            kept = []
            for k, number in enumerate(batch.column("anchor").to_pylist()):
                seen = seen + 1 if number == anchor else 1
                anchor = number
                if seen <= positives:
                    kept.append(k)
            yield batch.take(pa.array(kept, pa.int64()))

    return run


_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _mine(negatives: int, low: int, high: int):
    """Stream a sorted partition: a positive opens its window, a negative goes to every open window it lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, anchor, windows = None, None, []
        for batch in batches:
            out = []
            for number, name, kind, other, score in zip(*(batch.column(c).to_pylist() for c in ("anchor", "anchor_id", "kind", "id", "score"))):
                if number != anchor:
                    anchor, windows = number, []
                if kind == 0:
                    windows.append([other, score, 0])
                    continue
                for window in windows:
                    if window[2] < negatives and low * window[1] <= 100 * score <= high * window[1]:
                        window[2] += 1
                        out.append((name, window[0], window[2], other, window[1], score))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                schema = schema or ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], schema)

    return run


def hard_negatives(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0,
                   group: int = GROUP, piece: int = SLICE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors of ``rows`` (vec_id, embedding, label, any others).

    Anchors are the rows whose vec_id ``every`` divides. Components become
    floor(scale * x); a score is the integer inner product. An anchor's positives
    are its first ``positives`` other rows of its label, by score, then smaller
    vec_id; for each the first ``negatives`` rows of other labels are returned
    for which low * positive_score <= 100 * score <= high * positive_score.

    Rows with a null label, a null vector or a null or non-finite component take
    no part. A row without vec_id is no anchor and comes last among ties. Rows
    that repeat a vec_id are rows of their own, anchors too. A shorter vector
    counts as filled with zeros; a score beyond 64 bits is an error. A positive
    without a fitting negative has no row; an empty table gives an empty result.
    Columns beyond the three are not read.
    """
    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    blocks = materialize(named.mapInArrow(tidy(_blocks(scale)), _PACKED), "vector-blocks")
    anchors = blocks.mapInArrow(tidy(_anchors(every)), "id long, label long, place long, vector binary")
    anchors = materialize(anchors, "anchors")
    groups = max(1, -(-anchors.count() // group))
    slices = max(1, -(-(blocks.agg(F.sum("n")).first()[0] or 0) // piece))
    packed = materialize(anchors.repartition(groups, "place").mapInArrow(tidy(_groups), _PACKED), "anchor-groups").withColumnRenamed("block", "group")

    as_struct = F.struct("n", "dim", "ids", "labels", "places", "vectors")
    dealt = blocks.select(F.pmod(F.xxhash64("block"), F.lit(slices)).alias("slice"), as_struct.alias("rows"))
    dealt = dealt.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def scored(windows: DataFrame) -> DataFrame:
        side = windows.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
        cells = dealt.join(side, ["group", "slice"]).select("group", "rows", "anchors", "windows")
        return cells.mapInArrow(tidy(_cells(positives, negatives, low, high)), _FOUND)

    grouped = packed.select("group", as_struct.alias("anchors"))
    none = F.lit(None).cast("array<struct<anchor:long,score:long>>").alias("windows")
    best = materialize(secondary_sort(scored(grouped.select("*", none)), _first(positives), _FOUND), "positives")
    # a window without any integer in it opens nothing
    opened = best.where("score >= 0").groupBy(F.shiftright("anchor", 32).alias("group")).agg(F.collect_list(F.struct("anchor", "score")).alias("windows"))
    close = scored(grouped.join(opened, "group"))
    return secondary_sort(best.unionByName(close), _mine(negatives, low, high), _MINED)
