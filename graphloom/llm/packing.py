"""Fixed windows of tokens by sum-of-squares online packing.

A document's full windows leave at once. Its rest is placed whole into the fill
level that makes the sum of squared counts of partially filled windows least:
with N[h] open windows of fill h, placing s tokens at level h changes that sum
by 2 (N[h + s] - N[h] + 1), by 1 - 2 N[h] if the window fills up, and by
2 N[s] + 1 for a new window. Windows still open at the end of a task, or when
they hold ``OPEN_TOKENS``, are joined by cutting the emptiest ones into the gaps
of the fullest, so what is padded does not depend on the number of documents. A
task's last tokens leave in windows of powers of two, which need no padding.

Everything happens inside the task that reads the texts: no row is shuffled.
"""

from __future__ import annotations

import sys
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from graphloom.llm.common import text_steps, tidy
from graphloom.llm.tokens import STEP_BYTES, spaced_encoder

WINDOW = 4096
#: Tokens in open windows beyond which they are joined, so that memory is bounded.
OPEN_TOKENS = 4_000_000

Piece = tuple[object, int, bytes, int]  # doc_id, start, ids, tokens of the document


class SumOfSquares:
    """Packs documents one by one; finished windows are lists of pieces in ``done``."""

    def __init__(self, window: int, open_tokens: int = OPEN_TOKENS):
        self.window, self.open_tokens = window, open_tokens
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = defaultdict(list)
        self.held = 0
        self.done: list[list[Piece]] = []

    def level(self, size: int) -> int:
        """The fill level for ``size`` tokens; 0 opens a window. Ties go to the fullest window."""
        lower, upper = self.counts[1 : self.window - size + 1], self.counts[size + 1 : self.window + 1]
        change = 2 * (upper - lower) + 2
        if len(change):
            change[-1] = 1 - 2 * lower[-1]  # the level that fills a window
            change = np.where(lower > 0, change, sys.maxsize)
            best = len(change) - 1 - int(change[::-1].argmin())
            if change[best] <= 2 * self.counts[size] + 1:
                return best + 1
        return 0

    def add(self, doc: object, ids: bytes) -> None:
        total, full = len(ids) // 4, len(ids) // 4 // self.window * self.window
        for start in range(0, full, self.window):
            self.done.append([(doc, start, ids[4 * start : 4 * (start + self.window)], total)])
        if (size := total - full) == 0:
            return
        level = self.level(size)
        pieces = self.open[level].pop() if level else []
        self.counts[level] -= level > 0
        pieces.append((doc, full, ids[4 * full :], total))
        self.held += size
        self._keep(pieces, level + size)
        if self.held > self.open_tokens:
            self.join()

    def _keep(self, pieces: list[Piece], fill: int) -> None:
        if fill == self.window:
            self.done.append(pieces)
            self.held -= fill
        elif fill:
            self.open[fill].append(pieces)
            self.counts[fill] += 1

    def join(self) -> None:
        """Fill the fullest open windows with cuts of the emptiest; at most one stays open."""
        windows = [(fill, pieces) for fill in sorted(self.open, reverse=True) for pieces in self.open[fill]]
        self.open.clear()
        self.counts[:] = 0
        low, high = 0, len(windows) - 1
        while low <= high:
            fill, pieces = windows[low]
            while fill < self.window and low < high:
                other, given = windows[high]
                doc, start, ids, total = given.pop()
                taken = min(len(ids) // 4, self.window - fill)
                pieces.append((doc, start, ids[: 4 * taken], total))
                if 4 * taken < len(ids):
                    given.append((doc, start + taken, ids[4 * taken :], total))
                fill += taken
                windows[high] = (other - taken, given)
                high -= not given
            self._keep(pieces, fill)
            low += 1

    def finish(self) -> None:
        self.join()
        for fill, windows in list(self.open.items()):
            rest = windows[0]
            for bit in reversed(range(fill.bit_length())):
                if not fill >> bit & 1:
                    continue
                need, pieces = 1 << bit, []
                while need:
                    doc, start, ids, total = rest.pop(0)
                    taken = min(len(ids) // 4, need)
                    pieces.append((doc, start, ids[: 4 * taken], total))
                    if 4 * taken < len(ids):
                        rest.insert(0, (doc, start + taken, ids[4 * taken :], total))
                    need -= taken
                self.done.append(pieces)
        self.open.clear()
        self.counts[:], self.held = 0, 0


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW, open_tokens: int = OPEN_TOKENS) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text, any others) in windows of at most ``window`` tokens.

    (doc_id, start, length, ids, doc_tokens, sequence_id, offset): ``ids`` holds
    the piece's tokens as little-endian unsigned 32-bit integers, ``start`` its
    place in the document, ``offset`` its place in the sequence. A document is the
    ids of its whole text (null: empty) and ``end_id``. Sequences shorter than
    ``window`` occur only with a power of two of tokens, a few for each task.
    Repeated rows are packed as often as they occur; an empty table gives no
    rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = spaced_encoder(tokenizer, blank_belongs=False), SumOfSquares(window, open_tokens)
        end, sequence = array("I", [end_id]).tobytes(), TaskContext.get().partitionId() << 36

        def leave() -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for pieces in packer.done:
                offset = 0
                for doc, start, ids, total in pieces:
                    rows.append((doc, start, len(ids) // 4, ids, total, sequence, offset))
                    offset += len(ids) // 4
                sequence += 1
            packer.done = []
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for some in text_steps(batch, most=STEP_BYTES // 2):  # its windows take room as well
                for doc, ids in zip(some.column("doc_id").to_pylist(), encoder.encode(some.column("text").to_pylist())):
                    packer.add(doc, ids + end)
                yield leave()
        packer.finish()
        yield leave()

    return docs.select("doc_id", "text").mapInArrow(
        tidy(run), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
