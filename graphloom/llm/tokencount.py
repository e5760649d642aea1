"""Token counts of whole texts; huge ones in overlapping chunks that are spliced where both neighbours agree for certain.

A text beyond one chunk is cut at fixed places into chunks that overlap, which
many tasks encode with offsets. Of every chunk a thin list of *marks* is kept:
boundaries between tokens at places where the text alone proves that every
encoding is parted there (``STABLE``), with the tokens before each. Two
neighbours are spliced at their first common mark: from there on both read the
same text from a certain boundary, so their tokens are the same. A seam without
a common mark is widened until the overlap is the whole following chunk, seams
in a row at once; at the latest one chunk then spans the text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import text_steps, tidy
from graphloom.llm.tokens import spaced_encoder
from graphloom.session import materialize

#: Characters of a chunk, characters it shares with the next one, characters of a cell with at most one mark.
CHUNK, OVERLAP, CELL = 1 << 15, 1 << 10, 256
#: UTF-8 bytes of chunks that are encoded together, and of whole texts whose distinct stretches are.
STEP, STRETCHES = 1_000_000, 16_000_000

#: The last character before a place where the byte-level pattern always parts. No alternative of the pattern runs on from
#: another character into white space, from a letter into an ASCII mark, from a digit into an ASCII mark or letter, or from an
#: ASCII mark other than the apostrophe into a letter or digit; and what lies before the place is parted as if the text ended there.
STABLE = re.compile(r"\S(?=[ \t-\r])|[A-Za-z](?=[!-@\[-`{-~])|[0-9](?=[!-/:-~])|[!-&(-/:-@\[-`{-~](?=[A-Za-z0-9])")

_CHUNKS = "row long, doc_id long, n_bytes long, first int, last int, text string"
_MARKS = "row long, doc_id long, n_bytes long, first int, last int, n_tokens int, places array<int>, before array<int>"


@lru_cache(maxsize=2)
def _library(path: str):
    """The tokenizer of a file, for whose pattern ``STABLE`` is proven."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    added = tokenizer.get_added_tokens_decoder().values()
    cutter = tokenizer.pre_tokenizer
    if not (isinstance(cutter, pre_tokenizers.ByteLevel) and cutter.use_regex and not cutter.add_prefix_space and tokenizer.normalizer is None):
        raise ValueError("boundaries are proven for byte-level vocabularies without a normaliser only")
    if any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added):
        raise ValueError("a special string that reaches over white space leaves no certain boundary")
    return tokenizer, max((len(t.content) for t in added), default=0)


def marks(text: str, first: int, ends: np.ndarray, cell: int) -> tuple[list[int], list[int]]:
    """Places of the whole text (a chunk's first character stands at ``first``) that part for certain, one a cell, and the tokens before each.

    ``ends`` are the tokens' ends in the chunk; a place inside a token, as within
    a special string, is no mark.
    """
    found, at = [], -(-first // cell) * cell - first
    while at < len(text) and (match := STABLE.search(text, at)):
        found.append(match.end())
        at = -(-(first + match.end()) // cell) * cell - first
    places = np.array(found, np.int64)
    before = np.searchsorted(ends, places, side="right")
    real = (before > 0) & (ends[np.maximum(before, 1) - 1] == places) if len(ends) else np.zeros(len(places), bool)
    return (first + places[real]).tolist(), before[real].tolist()


def _whole(tokenizer: str):
    """(doc_id, n_bytes, n_tokens) of texts that are encoded in one piece, equal stretches of many texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, encoder = _library(tokenizer)[0], spaced_encoder(tokenizer, blank_belongs=True)
        special = [t.content for t in library.get_added_tokens_decoder().values()]
        for batch in batches:
            for some in text_steps(batch, most=STRETCHES):
                texts = some.column("text").to_pylist()
                counts = encoder.counts(texts)  # takes special strings for ordinary text
                for k in [k for k, t in enumerate(texts) if t and any(s in t for s in special)]:
                    counts[k] = len(library.encode(texts[k], add_special_tokens=False))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def _cut(chunk: int, overlap: int):
    """Chunks of each text: those named in ``spans``, or all of them where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                text = row["text"]
                spans = [(s["first"], s["last"]) for s in row["spans"]] if row["spans"] else [
                    (at, min(len(text), at + chunk + overlap)) for at in range(0, max(1, len(text) - overlap), chunk)]
                for at in range(0, len(spans), 64):  # a part of a huge text at a time
                    some = spans[at : at + 64]
                    values = ([row["row"]] * len(some), [row["doc_id"]] * len(some), [row["n_bytes"]] * len(some),
                              [s[0] for s in some], [s[1] for s in some], [text[a:b] for a, b in some])
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], ["row", "doc_id", "n_bytes", "first", "last", "text"])

    return run


def _encode(tokenizer: str, overlap: int, cell: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, longest = _library(tokenizer)
        if overlap < 2 * longest + cell:
            raise ValueError(f"an overlap of {overlap} characters may not show a special string of {longest} whole")
        for batch in batches:
            for some in text_steps(batch, most=STEP):
                counts, places, before = [], [], []
                texts = some.column("text").to_pylist()
                for text, first, encoded in zip(texts, some.column("first").to_pylist(), library.encode_batch(texts, add_special_tokens=False)):
                    ends = np.fromiter((e for _, e in encoded.offsets), np.int64, len(encoded))
                    found = marks(text, first, ends, cell)
                    counts.append(len(encoded))
                    places.append(found[0])
                    before.append(found[1])
                made = [pa.array(counts, pa.int32()), pa.array(places, pa.list_(pa.int32())), pa.array(before, pa.list_(pa.int32()))]
                names = ["row", "doc_id", "n_bytes", "first", "last"]
                yield pa.RecordBatch.from_arrays([*[some.column(n) for n in names], *made], [*names, "n_tokens", "places", "before"])

    return run


def _seams(chunks: DataFrame) -> DataFrame:
    """Each chunk with its share of the document's tokens, or ``open`` where it finds no common mark with the next one.

    The share is the tokens before the seam in this chunk, less those before it
    in the next one; a last chunk's share are all its tokens.
    """
    order = W.partitionBy("row").orderBy("first")
    ahead = chunks.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("first", "places", "before")})
    seam = F.get(F.array_intersect("places", "next_places"), F.lit(0))
    tokens = lambda kind: F.element_at(F.col(f"{kind}before"), F.array_position(F.col(f"{kind}places"), F.col("seam")).cast("int"))
    met = ahead.withColumn("seam", F.when(F.size("places") * F.size("next_places") > 0, seam))
    last = F.col("next_first").isNull()
    return met.select(
        *chunks.columns, (~last & F.col("seam").isNull()).alias("open"),
        F.when(last, F.col("n_tokens")).when(F.col("seam").isNotNull(), tokens("") - tokens("next_")).cast("long").alias("share"))


def _huge(texts: DataFrame, tokenizer: str, chunk: int, overlap: int, cell: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of texts in chunks."""

    def encoded(rows: DataFrame) -> DataFrame:
        cut = rows.mapInArrow(tidy(_cut(chunk, overlap)), _CHUNKS)
        return cut.repartition("row", "first").mapInArrow(tidy(_encode(tokenizer, overlap, cell)), _MARKS)

    chunks = materialize(encoded(texts.withColumn("spans", F.lit(None).cast("array<struct<first:int,last:int>>"))), "chunks")
    while True:
        met = materialize(_seams(chunks), "seams")
        if met.where("open").isEmpty():
            return met.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sum("share").alias("n_tokens")).drop("row")
        # chunks that hang together by open seams become one; every round has fewer chunks
        order = W.partitionBy("row").orderBy("first")
        hung = met.withColumn("opens", (~F.coalesce(F.lag("open").over(order), F.lit(False))).cast("int"))
        hung = hung.withColumn("chain", F.sum("opens").over(order)).drop("opens", "share", "open")
        spans = hung.groupBy("row", "chain").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("n"))
        wide = spans.where("n > 1")
        kept = hung.join(wide.select("row", "chain"), ["row", "chain"], "left_anti").select(*chunks.columns)
        again = texts.join(wide.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "row")
        chunks = materialize(kept.unionByName(encoded(again.select("row", "doc_id", "n_bytes", "text", "spans"))), "chunks")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP, cell: int = CELL) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text, any others).

    ``n_tokens`` is what the tokenizers library gives for the whole text without
    added tokens; special strings in a text are found as by its default. Null
    and empty texts have no bytes and no tokens; rows that repeat a doc_id and
    rows without one are counted row by row; an empty table gives an empty one.
    Texts of more than ``chunk + overlap`` characters are encoded in chunks over
    many tasks. A run without any certain boundary, such as one endless word, is
    one piece to the tokenizer and stays in one chunk. Columns beyond the two are
    not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    fits = F.coalesce(F.char_length("text"), F.lit(0)) <= chunk + overlap
    counted = rows.where(fits).mapInArrow(tidy(_whole(tokenizer)), "doc_id long, n_bytes long, n_tokens long")
    texts = materialize(rows.where(~fits).select(F.monotonically_increasing_id().alias("row"), "*"), "huge-texts")
    if not texts.isEmpty():
        counted = counted.unionByName(_huge(texts, tokenizer, chunk, overlap, cell))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
