"""Token files: canonical length-limited Huffman codes in independent blocks.

Code lengths come from the counts of all ids (package-merge, at most ``LIMIT``
bits) and alone define the codes. A document's ids are coded to whole bytes,
with the bit offset of every ``STRIDE``-th id as a checkpoint. Blocks hold whole
documents in ascending doc_id order and can be decoded by themselves: all
checkpoints of a block are decoded side by side, one table lookup an id.

A file is a folder of two Parquet tables: ``lengths`` (id, bits) and ``blocks``
(part, start, doc_ids, counts, bits, checkpoints); parts follow one another in
doc_id order and ``start`` counts the ids of the part before the block.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import text_steps, tidy
from graphloom.llm.tokens import STEP_BYTES, spaced_encoder
from graphloom.session import materialize

LIMIT, STRIDE = 20, 256
#: Ids after which a block is closed, ids of a part.
BLOCK_IDS, PART_IDS = 1 << 16, 8_000_000
#: Documents whose bits are formed together, and blocks that are decoded together.
STEP, DECODED = 500, 48


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal prefix-code lengths of at most ``limit`` bits, 0 for ids that do not occur (package-merge)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes longer than {limit} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    merged, levels = weights, []  # by level: which of the sorted entries are single ids
    for _ in range(limit - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(weights))
        merged = both[order]
    take, depth = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for single in reversed(levels):
        n = int(single[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    depth[:take] += 1
    lengths[used] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each the follower of the one before."""
    codes, code, before = np.zeros(len(lengths), np.uint32), 0, 0
    for k in np.lexsort((np.arange(len(lengths)), lengths)):
        bits = int(lengths[k])
        if bits:
            code <<= bits - before
            codes[k] = code
            code, before = code + 1, bits
    return codes


def encode_bits(ids: np.ndarray, counts: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Code bits of documents of ``counts`` ids, each in whole bytes; the documents' sizes in bytes, and the bit offset of every id in its document."""
    bits = lengths[ids].astype(np.int64)
    ends, last = np.cumsum(bits), np.cumsum(counts)
    before = np.r_[0, ends[last - 1]]  # every document has an id
    sizes = (np.diff(before) + 7) // 8
    begins = 8 * (np.cumsum(sizes) - sizes)
    within = ends - bits - np.repeat(before[:-1], counts)
    starts = within + np.repeat(begins, counts)
    room = np.uint64(64) - (starts & 31).astype(np.uint64) - bits.astype(np.uint64)
    placed = codes[ids].astype(np.uint64) << room  # within the 64 bits from the 32-bit word of its start
    word = starts >> 5
    out = np.zeros(int(sizes.sum()) // 4 + 3, np.uint64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    for half, shift in ((placed >> np.uint64(32), 0), (placed & np.uint64(0xFFFFFFFF), 1)):
        out[word[first] + shift] += np.add.reduceat(half, first)  # disjoint bits: a sum is an or
    return out.astype(">u4").tobytes(), sizes, within


def decode_bits(data: bytes, starts: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Ids of all lanes, lane by lane; a lane begins at a bit offset and has up to ``STRIDE`` ids."""
    joint = table[0] << np.uint32(5) | table[1].astype(np.uint32)  # one look-up gives both; a length takes five bits
    words = np.frombuffer(data + bytes(12 - len(data) % 4), ">u4").astype(np.uint64)
    order = np.argsort(-counts, kind="stable")
    at, alive = starts[order].astype(np.uint64), counts[order]
    base = (np.cumsum(counts) - counts)[order]
    out = np.empty(int(counts.sum()), np.uint32)
    half, five, low, top = np.uint64(32), np.uint64(5), np.uint64(31), np.uint64(64 - LIMIT)
    peeked = np.uint64((1 << LIMIT) - 1)
    for step in range(int(counts.max(initial=0))):
        lanes = int(np.searchsorted(-alive, -step, side="left"))
        at = at[:lanes]
        word = (at >> five).astype(np.int64)
        pair = words[word] << half | words[word + 1]
        found = joint[((pair >> (top - (at & low))) & peeked).astype(np.int64)]
        out[base[:lanes] + step] = found >> np.uint32(5)
        at = at + (found & np.uint32(31))
    return out


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every ``LIMIT`` bits: the id whose code they begin with, and that code's length."""
    codes, symbol, bits = canonical_codes(lengths), np.zeros(1 << LIMIT, np.uint32), np.ones(1 << LIMIT, np.int64)
    for k in np.flatnonzero(lengths):
        spare = LIMIT - int(lengths[k])
        low = int(codes[k]) << spare
        symbol[low : low + (1 << spare)], bits[low : low + (1 << spare)] = k, lengths[k]
    return symbol, bits


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """(doc_id, ids, counted): ids of every whole text (null: empty) and ``end_id``, as little-endian unsigned 16-bit integers.

    ``counted`` is null but for one row a step, where it holds the step's
    distinct ids and their counts, as 64-bit integers one after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = spaced_encoder(tokenizer, blank_belongs=True), array("I", [end_id]).tobytes()
        for batch in batches:
            for some in text_steps(batch, most=STEP_BYTES):
                ids = [_narrow(np.frombuffer(x + end, np.uint32)).tobytes() for x in encoder.encode(some.column("text").to_pylist())]
                counts = np.zeros(1 << 16, np.int64)
                for at in range(0, len(ids), STEP):
                    counts += np.bincount(np.frombuffer(b"".join(ids[at : at + STEP]), np.uint16), minlength=1 << 16)
                used = np.flatnonzero(counts)
                counted = [np.r_[used, counts[used]].tobytes(), *[None] * (len(ids) - 1)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(ids, pa.binary()), pa.array(counted, pa.binary())], ["doc_id", "ids", "counted"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, ids binary, counted binary")


def _narrow(ids: np.ndarray) -> np.ndarray:
    if len(ids) and ids.max() >= 1 << 16:
        raise ValueError(f"id {ids.max()} does not fit the file's 16 bits")
    return ids.astype(np.uint16)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for counted in batch.column("counted").to_pylist():
            used, n = np.frombuffer(counted, np.int64).reshape(2, -1)
            counts[used] += n
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["id", "n"])


def _encoder(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                listed = batch.column("ids").to_pylist()
                counts = np.fromiter(map(len, listed), np.int64, len(listed)) // 2
                data, sizes, within = encode_bits(np.frombuffer(b"".join(listed), np.uint16), counts, codes, lengths)
                ends, places = np.cumsum(sizes).tolist(), np.cumsum(counts).tolist()
                bits = [data[e - n : e] for e, n in zip(ends, sizes.tolist())]
                checkpoints = [within[e - n : e : STRIDE].tobytes() for e, n in zip(places, counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("part"), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(bits, pa.binary()), pa.array(checkpoints, pa.binary())],
                    ["part", "doc_id", "n_tokens", "bits", "checkpoints"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted documents to blocks: bytes and checkpoints follow one another, offsets now count from the block."""
    part, start, ids = None, 0, 0
    docs: list[tuple] = []

    def leave() -> pa.RecordBatch:
        offset, checkpoints = 0, []
        for _, _, bits, marks in docs:
            checkpoints.append(np.frombuffer(marks, np.int64) + 8 * offset)
            offset += len(bits)
        values = ([part], [start], [[d[0] for d in docs]], [[d[1] for d in docs]], [b"".join(d[2] for d in docs)], [np.concatenate(checkpoints)])
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["part", "start", "doc_ids", "counts", "bits", "checkpoints"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "bits", "checkpoints"))):
            if docs and (row[0] != part or ids + row[2] > BLOCK_IDS):
                yield leave()
                start, ids, docs = start + ids, 0, []
            if row[0] != part:
                part, start = row[0], 0
            docs.append(row[1:])
            ids += row[2]
    if docs:
        yield leave()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, part_ids: int = PART_IDS) -> None:
    """Write the ids of all ``docs`` (doc_id, text, any others) to ``path`` in ascending doc_id order.

    Null doc_ids come first; rows of equal doc_id are ordered by length, then by
    code bits. Null texts count as empty ones and hold ``end_id`` alone. An empty
    table gives empty tables. Columns beyond the two are not read.
    """
    spark = docs.sparkSession
    tokens = materialize(tokenize(docs, tokenizer, end_id), "token-ids")
    counted = tokens.select("counted").where("counted is not null").mapInArrow(tidy(_count), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
    counts = np.zeros(1 << 16, np.int64)
    counts[counted["id"].to_numpy(int)] = counted["n"].to_numpy(np.int64)
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(k), int(lengths[k])) for k in used], "id int, bits int").coalesce(1).write.parquet(f"{path}/lengths")

    parts = max(1, -(-int(counts.sum()) // part_ids))
    cuts = tokens.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts[: parts - 1]]).cast("array<long>")
    part = F.coalesce(F.size(F.filter(bounds, lambda b: b < F.col("doc_id"))), F.lit(0)).cast("int")
    coded = tokens.select("doc_id", "ids").withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(part)).mapInArrow(
        tidy(_encoder(lengths)), "part int, doc_id long, n_tokens long, bits binary, checkpoints binary")
    ordered = coded.repartition(parts, "part").sortWithinPartitions("part", "doc_id", "n_tokens", "bits")
    ordered.mapInArrow(tidy(_blocks), "part int, start long, doc_ids array<long>, counts array<long>, bits binary, checkpoints array<long>").write.option(
        "compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the file; ids as little-endian unsigned 32-bit integers."""
    table = spark.read.parquet(f"{path}/lengths").toPandas()  # at most the vocabulary
    lengths = np.zeros(1 << 16, np.uint8)
    lengths[table["id"].to_numpy(int)] = table["bits"].to_numpy(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoding = decode_table(lengths)
        for whole in batches:
            for at in range(0, whole.num_rows, DECODED):
                batch = whole.slice(at, DECODED)
                data, shift, starts, lanes = [], 0, [], []
                for bits, marks, counts in zip(*(batch.column(c).to_pylist() for c in ("bits", "checkpoints", "counts"))):
                    starts.append(np.array(marks) + 8 * shift)
                    counts = np.array(counts)
                    full = -(-counts // STRIDE)
                    lane = np.full(int(full.sum()), STRIDE)
                    lane[np.cumsum(full) - 1] = counts - STRIDE * (full - 1)
                    lanes.append(lane)
                    data.append(bits)
                    shift += len(bits)
                ids = decode_bits(b"".join(data), np.concatenate(starts), np.concatenate(lanes), decoding).astype("<u4").tobytes()
                rows, taken = [], 0
                for part, start, docs, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "doc_ids", "counts"))):
                    for doc, n in zip(docs, counts):
                        rows.append((part, start, doc, n, ids[4 * taken : 4 * (taken + n)]))
                        start, taken = start + n, taken + n
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["part", "start", "doc_id", "n_tokens", "ids"])

    blocks = spark.read.parquet(f"{path}/blocks")
    sums = blocks.groupBy("part").agg(F.max(F.col("start") + F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n"))
    before = sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    out = blocks.mapInArrow(tidy(run), "part int, start long, doc_id long, n_tokens long, ids binary")
    return out.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids")


