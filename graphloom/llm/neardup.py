"""Near duplicates: multi-index Hamming join of b-bit MinHash signatures, links confirmed on full shingle sets.

A document's set holds its distinct five-word shingles. ``SLOTS`` minima, cut to
16 bits each, form the signature; its distance is the number of slots that
differ. The signature is split into ``CHUNKS`` chunks. Two signatures at a
distance of at most ``GUARANTEED = CHUNKS * (ERRORS + 1) - 1`` have, by the
pigeonhole principle, a chunk with at most ``ERRORS`` differing slots, so with
every choice of the allowed errors left out as a key they share a key. Sets at
85 % similarity are further apart with a probability of 2e-5, and even then
nearly always share a key (all chunks fail in 1 of 6e7 cases); pairs that meet
are let through up to ``LOOSE`` differing slots.

Nothing emits the pairs of a group. Cells (the documents of one key) emit a
spanning forest of what passes the signature test; its components are regions,
and all links lie within regions. Regions compare full sets and again emit a
spanning forest of true links. Large keys and regions are cut into blocks, every
two of which form a cell. Equal sets are one class from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_cells, block_cells, connected_components, distinct_words, mixed, text_steps, tidy, word_hashes
from graphloom.session import materialize

SHINGLE, PERCENT = 5, 85
CHUNKS, SLOTS_A_CHUNK, ERRORS = 10, 5, 1
SLOTS = CHUNKS * SLOTS_A_CHUNK
GUARANTEED = CHUNKS * (ERRORS + 1) - 1
LOOSE = GUARANTEED + 3
#: Rows of a key and shingles of a region that one block of a cell may hold.
KEY_BLOCK, REGION_BLOCK = 20_000, 2_000_000

_RANDOM = np.random.default_rng(20_240_501)
_FACTORS = _RANDOM.integers(1, 2**63, SLOTS, dtype=np.uint64) | np.uint64(1)
_PLACES = _RANDOM.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_KEPT = [list(kept) for kept in combinations(range(SLOTS_A_CHUNK), SLOTS_A_CHUNK - ERRORS)]


def shingle_set(values: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, given its words' hashes; fewer words are one shingle, none are none."""
    if not len(values):
        return np.empty(0, np.uint64)
    if len(values) < SHINGLE:
        return mixed(np.array([np.sum(values * _PLACES[: len(values)], dtype=np.uint64) + np.uint64(len(values))], np.uint64))
    n = len(values) - SHINGLE + 1
    total = values[:n] * _PLACES[0]
    for k in range(1, SHINGLE):
        total += values[k : k + n] * _PLACES[k]
    return np.unique(mixed(total))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text; only A-Z are lower-cased."""
    words, numbers, bounds = distinct_words(pc.ascii_lower(texts))
    values = word_hashes(words)[numbers]
    return (shingle_set(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))


def signature(shingles: np.ndarray) -> np.ndarray:
    """For each slot the low 16 bits of the smallest of the shingles' hashes under that slot's function."""
    out = np.empty(SLOTS, np.uint64)
    for k in range(SLOTS):
        out[k] = (shingles * _FACTORS[k]).min()
    return (mixed(out) & np.uint64(0xFFFF)).astype(np.uint16)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_steps(whole):
            counts, ids, signatures = [], [], []
            for shingles in shingle_sets(batch.column("text")):
                counts.append(len(shingles))
                ids.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                signatures.append(signature(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(signatures, pa.binary())],
                ["doc_id", "n_shingles", "set_id", "signature"])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SLOTS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 2_000):
            batch = whole.slice(at, 2_000)
            slots = _matrix(batch.column("signature")).astype(np.uint64)
            keys = np.empty((len(slots), CHUNKS * len(_KEPT)), np.uint64)
            for chunk in range(CHUNKS):
                for j, kept in enumerate(_KEPT):
                    key = np.full(len(slots), chunk * len(_KEPT) + j + 1, np.uint64)
                    for slot in kept:
                        key = mixed(key) * np.uint64(65_599) + slots[:, chunk * SLOTS_A_CHUNK + slot]
                    keys[:, chunk * len(_KEPT) + j] = mixed(key)
            nodes = np.repeat(batch.column("node").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(nodes)], ["key", "node"])


def _forest(count: int, sizes: np.ndarray, passes) -> list[tuple[int, int]]:
    """Spanning forest of the graph whose edges ``passes(x, others)`` tells, searched breadth first among the unvisited."""
    left, edges, order = np.arange(count), [], []
    while len(left):
        order, left = [int(left[0])], left[1:]
        while order and len(left):
            x = order.pop()
            near = (100 * sizes[left] >= PERCENT * sizes[x]) & (PERCENT * sizes[left] <= 100 * sizes[x])
            if not near.any():
                continue
            at = np.flatnonzero(near)
            at = at[passes(x, left[at])]
            if len(at):
                found = left[at].tolist()
                edges.extend((x, y) for y in found)
                order.extend(found)
                left = np.delete(left, at)
    return edges


def _edge_batch(nodes: np.ndarray, edges: list[tuple[int, int]]) -> pa.RecordBatch | None:
    if not edges:
        return None
    pairs = nodes[np.array(edges)]
    return pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], ["a", "b"])


def _similar_signatures(cell: pa.Table) -> pa.RecordBatch | None:
    if cell.num_rows < 2:
        return None
    slots = _matrix(cell.column("signature"))
    edges = _forest(cell.num_rows, cell.column("n_shingles").to_numpy(), lambda x, others: (slots[others] != slots[x]).sum(1) <= LOOSE)
    return _edge_batch(cell.column("node").to_numpy(), edges)


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full set of each document that stands for its class; other rows of the same id are left out by their set's id."""
    for whole in batches:
        for batch in text_steps(whole, most=2_000_000):
            rows = []
            for shingles, wanted in zip(shingle_sets(batch.column("text")), batch.column("set_id").to_pylist()):
                data = shingles.tobytes()
                rows.append(data if hashlib.blake2b(data, digest_size=16).digest() == wanted else None)
            table = batch.drop_columns(["text", "set_id"]).append_column("shingles", pa.array(rows, pa.binary()))
            yield table.filter(table.column("shingles").is_valid())


def _true_links(cell: pa.Table) -> pa.RecordBatch | None:
    nodes, first = np.unique(cell.column("node").to_numpy(), return_index=True)  # repeated rows of a document
    if len(nodes) < 2:
        return None
    cell = cell.take(first)
    slots = _matrix(cell.column("signature"))
    sets = [np.frombuffer(x, np.uint64) for x in cell.column("shingles").to_pylist()]
    sizes = np.array([len(x) for x in sets])

    def linked(x: int, others: np.ndarray) -> np.ndarray:
        near = (slots[others] != slots[x]).sum(1) <= LOOSE
        for at in np.array_split(np.flatnonzero(near), 1 + near.sum() // 2_000):
            if len(at):
                some = others[at]
                flat = np.concatenate([sets[y] for y in some])
                place = np.minimum(sets[x].searchsorted(flat), len(sets[x]) - 1)
                starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                shared = np.add.reduceat((sets[x][place] == flat).astype(np.int64), starts)
                near[at] = 100 * shared >= PERCENT * (sizes[some] + sizes[x] - shared)
        return near

    return _edge_batch(nodes, _forest(len(nodes), sizes, linked))


def near_duplicates(docs: DataFrame, key_block: int = KEY_BLOCK, region_block: int = REGION_BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, any others).

    Documents are linked where 100 * intersection >= 85 * union of their sets;
    component_id is the smallest doc_id that can be reached, kept says whether it
    is the row's own. Null and wordless texts have an empty set and stay alone.
    Equal texts are one class; rows that repeat a doc_id keep a row each. A null
    doc_id takes part but is never the smallest. Columns beyond doc_id and text
    are not read, so their names do not matter.
    """
    described = docs.select("doc_id", "text").mapInArrow(tidy(_describe), "doc_id long, n_shingles long, set_id binary, signature binary")
    rows = materialize(described.withColumn("uid", F.monotonically_increasing_id()), "shingle-sets")
    classes = materialize(rows.where("n_shingles > 0").groupBy("set_id").agg(
        F.min("uid").alias("node"), F.min("doc_id").alias("first_doc"),
        F.any_value("n_shingles").alias("n_shingles"), F.any_value("signature").alias("signature")), "set-classes")

    keys = classes.select("node", "signature").mapInArrow(tidy(_keys), "key long, node long")
    shared = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = shared.withColumn("blocks", F.ceil(F.col("members") / key_block))
    cells = block_cells(keys.join(shared, "key"), "key", "node", "blocks").select("key", "cell_low", "cell_high", "node")
    cells = cells.join(classes.select("node", "n_shingles", "signature"), "node")
    passed = arrow_cells(cells, ["key", "cell_low", "cell_high"], _similar_signatures, "a long, b long")
    regions = materialize(connected_components(passed), "regions")

    sized = regions.join(classes, "node")
    blocks = sized.groupBy("root").agg(F.ceil(F.sum("n_shingles") / region_block).alias("blocks"))
    wanted = sized.join(blocks, "root").select("root", "node", "blocks", "signature", "set_id", F.col("first_doc").alias("wanted"))
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")))
    full = texts.select("root", "node", "blocks", "signature", "set_id", "text").mapInArrow(
        tidy(_shingles), "root long, node long, blocks long, signature binary, shingles binary")
    links = arrow_cells(block_cells(full, "root", "node", "blocks"), ["root", "cell_low", "cell_high"], _true_links, "a long, b long")
    linked = connected_components(links)

    smallest = linked.join(classes, "node").groupBy("root").agg(F.min("first_doc").alias("smallest"))
    labels = classes.select("set_id", "node", "first_doc").join(linked.join(smallest, "root"), "node", "left")
    labels = labels.select("set_id", F.coalesce("smallest", "first_doc").alias("component"))
    out = rows.select("doc_id", "n_shingles", "set_id").join(labels, "set_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
