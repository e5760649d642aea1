"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents form a TF-IDF matrix over hashed words. Its latent
space comes from a randomised SVD: every passage adds its term counts, with a
random sign, to one of ``SKETCH`` columns, so partial sketches simply add up and
one pass over the documents gives document frequencies and sketch. The SVD of
the weighted sketch (words x ``SKETCH``) yields the leading right singular
vectors; a word's place in that space is taken with unit length, times its
inverse document frequency, less the average word.

Windows of every document, in lengths that fit the items, are summed from their
words and compared with the items by cosine, in blocks of items. Of what comes
close, windows with too few of the item's words go; the rest is checked word by
word: the longest common subsequence with the item must cover
``VERBATIM`` of it, or ``PARAPHRASE`` of it if the answer, the item's last
sentence, is there as well. Nothing is shuffled but the partial sketches.

The cosine alone would miss copies that it does not bring close. So an exact way
in stands beside it: a copy lacks at most ``1 - PARAPHRASE`` of an item's words,
hence holds all but so many of its rarest. Every place with that many of them
within ``SPAN`` times the item's length is checked, and no stretch of that length
that the checks accept is passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_cells, distinct_words, mixed, text_steps, tidy
from graphloom.session import materialize

#: Hash buckets for words, columns of the sketch, latent dimensions: together they bound what the driver holds.
FEATURES, SKETCH, LATENT = 1 << 13, 96, 64
#: Words of a passage of the matrix.
PASSAGE = 64
#: Windows are whole blocks of words; their lengths are powers of this ratio from the shortest, and they overlap by half.
BLOCK, SHORTEST, RATIO = 4, 8, 1.5
#: Least cosine of a candidate and least share of its words that the item has.
CLOSE, HELD = 0.5, 0.4
#: Least shares of an item's words in order, without and with its answer; least share of the answer.
VERBATIM, PARAPHRASE, ANSWERED = 0.7, 0.6, 0.8
#: Words of a stretch that may hold an item, as a multiple of the item's; share of an item's words, the rarest, that are looked up.
SPAN, RAREST = 3, 0.6
#: Items searched for in one pass over the documents.
ITEM_BLOCK = 4_000
#: Rows of the feature table that one row of a partial sketch holds.
ROWS = 256
#: Documents searched together.
_STEP = 200
_EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_=+/\\`~^"


def word_ids(texts: pa.Array) -> list[np.ndarray]:
    """For each text the 64-bit ids of its lower-cased words, punctuation around them left out; a null text has none."""
    words, numbers, bounds = distinct_words(pc.utf8_lower(texts))
    bare = [w.strip(_EDGES) for w in words.to_pylist()]
    ids = np.fromiter(((xxhash.xxh3_64_intdigest(w.encode()) | 1) if w else 0 for w in bare), np.uint64, len(bare))[numbers]
    return [found[found != 0] for found in np.split(ids, bounds[1:-1])] if len(texts) else []


def _features(ids: np.ndarray) -> np.ndarray:
    return (ids >> np.uint64(40)).astype(np.int64) & (FEATURES - 1)


def _partial_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block of ``ROWS`` features: the sums' positions and values, document frequencies in one more column."""
    width = SKETCH + 1
    sums, passages = np.zeros(FEATURES * width, np.float32), 0
    for whole in batches:
        for batch in text_steps(whole):
            ids, owner, base = [], [], 0
            for found in word_ids(batch.column("text")):
                if len(found):
                    ids.append(found)
                    owner.append(base + np.arange(len(found)) // PASSAGE)
                    base = int(owner[-1][-1]) + 1
            if not ids:
                continue
            ids, owner = np.concatenate(ids), np.concatenate(owner)
            passages += base
            features = _features(ids)
            # a passage's sign and column follow from its words, so they do not depend on where it is read
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            drawn = mixed(np.add.reduceat(ids, starts))
            column = (drawn % np.uint64(SKETCH)).astype(np.int64)[owner]
            sign = 1.0 - 2.0 * ((drawn >> np.uint64(32)) & np.uint64(1)).astype(np.float64)[owner]
            sums += np.bincount(features * width + column, sign, FEATURES * width).astype(np.float32)
            pairs = np.sort(owner * FEATURES + features)
            seen = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] & (FEATURES - 1)
            sums.reshape(FEATURES, width)[:, SKETCH] += np.bincount(seen, minlength=FEATURES)
    rows = []
    for block, part in enumerate(sums.reshape(-1, ROWS * width)):
        used = np.flatnonzero(part).astype(np.int32)
        if len(used):
            rows.append((block, used.tobytes(), part[used].tobytes()))
    rows.append((-1, b"", np.array([passages], np.float32).tobytes()))
    blocks, at, values = zip(*rows)
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(at, pa.binary()), pa.array(values, pa.binary())], ["block", "at", "values"])


def _add_sketches(cell: pa.Table) -> pa.RecordBatch:
    block, total = cell.column("block")[0].as_py(), np.zeros(ROWS * (SKETCH + 1))
    for at, values in zip(cell.column("at").to_pylist(), cell.column("values").to_pylist()):
        if block < 0:
            total[0] += np.frombuffer(values, np.float32)[0]
        else:
            total[np.frombuffer(at, np.int32)] += np.frombuffer(values, np.float32)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["block", "total"])


def fit_latent(docs: DataFrame) -> np.ndarray:
    """(FEATURES, LATENT): what a word of each feature adds to the latent coordinates of its passage."""
    partial = docs.select("text").mapInArrow(tidy(_partial_sketch), "block int, at binary, values binary")
    sketch, passages = np.zeros((FEATURES // ROWS, ROWS * (SKETCH + 1)), np.float32), 1.0
    for row in arrow_cells(partial, ["block"], _add_sketches, "block int, total binary").collect():  # FEATURES / ROWS rows of fixed size
        total = np.frombuffer(bytes(row["total"]), np.float32)
        if row["block"] < 0:
            passages = max(1.0, float(total[0]))
        else:
            sketch[row["block"]] = total
    sketch = sketch.reshape(FEATURES, SKETCH + 1)
    idf = np.log((1 + passages) / (1 + sketch[:, SKETCH])).astype(np.float32)
    left, values, _ = np.linalg.svd(sketch[:, :SKETCH] * idf[:, None], full_matrices=False)
    places = left[:, :LATENT] * values[:LATENT]
    places *= (idf / np.maximum(np.linalg.norm(places, axis=1), 1e-9))[:, None]
    places -= np.average(places, axis=0, weights=sketch[:, SKETCH] + 1e-9)
    return places.astype(np.float32)


def common_words(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item, given as bit masks of its words' places, and ``words``."""
    full = (1 << size) - 1
    row = full
    for word in words:
        mask = masks.get(word)
        if mask:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for k, word in enumerate(words):
        masks[word] = masks.get(word, 0) | 1 << k
    return masks


class Items:
    """Benchmark items ready to be searched for: words, answers, latent vectors and window lengths."""

    def __init__(self, rows: list[tuple[int, str]], latent: np.ndarray):
        self.ids, self.sizes, self.masks, self.answers, vectors, held, self.scales = [], [], [], [], [], [], {}
        for item, text in rows:
            sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n", text) if s.strip()]
            found, answer = word_ids(pa.array([text, sentences[-1] if sentences else text]))
            if not len(found):
                continue
            answer = answer.tolist()
            scale = max(0, round(np.log(len(found) / SHORTEST) / np.log(RATIO)))
            self.scales.setdefault(max(1, round(SHORTEST * RATIO**scale / BLOCK)), []).append(len(self.ids))
            self.ids.append(item)
            self.sizes.append(len(found))
            self.masks.append(_masks(found.tolist()))
            self.answers.append((_masks(answer), len(answer)))
            vector = latent[_features(found)].sum(0)
            vectors.append(vector / max(float(np.linalg.norm(vector)), 1e-9))
            held.append(np.bincount(_features(found), minlength=FEATURES + 1) > 0)
        self.vectors = np.array(vectors, np.float32).reshape(len(vectors), latent.shape[1])
        self.held = np.array(held, bool).reshape(len(held), FEATURES + 1)
        self.latent = np.r_[latent, np.zeros((1, latent.shape[1]), np.float32)]  # the last row is no word
        self.gap = BLOCK * max(self.scales, default=1)
        self._index_rare_words()

    def _index_rare_words(self) -> None:
        """Which items have a word among their rarest, and how many of those every accepted stretch holds."""
        weight = np.linalg.norm(self.latent, axis=1)  # any order of the words gives the same results, a rare one first is fastest
        words, members, self.needed = [], [], []
        for item, (masks, size) in enumerate(zip(self.masks, self.sizes)):
            order = np.fromiter(masks, np.uint64, len(masks))
            order = order[np.argsort(-weight[_features(order)], kind="stable")]
            least = next(c for c in range(size + 1) if c / size >= PARAPHRASE)
            places = np.cumsum([masks[w].bit_count() for w in order.tolist()])
            last = int(np.searchsorted(places, max(size - least + 1, RAREST * size)))
            words.append(order[: last + 1])
            members.append(np.full(last + 1, item))
            self.needed.append(int(places[last]) - (size - least))
        words, members = np.concatenate([np.empty(0, np.uint64), *words]), np.concatenate([np.empty(0, np.int64), *members])
        order = np.argsort(words, kind="stable")
        self.rare, starts = np.unique(words[order], return_index=True)
        self.rare_items, self.rare_starts = members[order], np.r_[starts, len(words)]
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[self._slot(self.rare)] = True
        self.needed, self.spans = np.array(self.needed, np.int64), SPAN * np.array(self.sizes, np.int64)

    @staticmethod
    def _slot(ids: np.ndarray) -> np.ndarray:
        return (ids >> np.uint64(8)).astype(np.int64) & 0xFFFF

    def dense(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first, last word) of every place with enough of an item's rarest words; places that overlap are one."""
        gap = 2 * int(self.spans.max(initial=0)) + 1
        lengths = np.array([len(d) for d in docs], np.int64)
        begins = np.cumsum(lengths + gap) - (lengths + gap)
        words = np.concatenate([np.empty(0, np.uint64), *docs])
        at = np.flatnonzero(self.sieve[self._slot(words)])
        number = np.minimum(np.searchsorted(self.rare, words[at]), max(0, len(self.rare) - 1))
        known = self.rare[number] == words[at] if len(self.rare) else np.zeros(len(at), bool)
        at, number = at[known], number[known]
        owner = np.repeat(np.arange(len(docs)), lengths)[at]
        place, total = at + gap * owner, int((lengths + gap).sum()) + 1
        many = self.rare_starts[number + 1] - self.rare_starts[number]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        keys = np.sort(self.rare_items[np.repeat(self.rare_starts[number], many) + within] * total + np.repeat(place, many))
        item = keys // total
        # the key that completes the needed number, if it lies within the span
        end = np.arange(len(keys)) + self.needed[item] - 1
        enough = (end < len(keys)) & (keys[np.minimum(end, len(keys) - 1)] - keys < self.spans[item])
        keys, item = keys[enough], item[enough]
        if not len(keys):
            return
        new = np.r_[True, (np.diff(keys) > 2 * self.spans[item[1:]]) | (np.diff(item) > 0)]
        heads = np.flatnonzero(new)
        tails = np.r_[heads[1:], len(keys)] - 1
        item, low, high = item[heads], keys[heads] % total, keys[tails] % total
        doc = np.searchsorted(begins, low, side="right") - 1
        low, high = low - begins[doc] - self.spans[item] + 1, high - begins[doc] + self.spans[item] - 1
        yield from zip(doc.tolist(), item.tolist(), np.maximum(low, 0).tolist(), np.minimum(high, lengths[doc] - 1).tolist())

    def held_whole(self, item: int, words: list[int], first: int, last: int) -> Iterator[tuple[float, float, int, int]]:
        """(share, answer's share, first, last word) of stretches of ``SPAN`` times the item's words that the checks accept."""
        masks, size, (answer, n) = self.masks[item], self.sizes[item], self.answers[item]
        least = PARAPHRASE * size
        if common_words(masks, size, words[first : last + 1]) / size < PARAPHRASE:
            return
        at = first
        while at <= last:
            if words[at] not in masks:  # a stretch that begins at the item's next word holds no less
                at += 1
                continue
            end = min(last + 1, at + int(self.spans[item]))
            found = common_words(masks, size, words[at:end])
            if found / size >= PARAPHRASE:
                answered = common_words(answer, n, words[at:end]) / n if n else 0.0
                if found / size >= VERBATIM or answered >= ANSWERED:
                    yield found / size, answered, at, end - 1
            at += max(1, int(least - found))  # a step adds one word to a stretch at most

    def cosine(self, item: int, words: np.ndarray) -> float:
        vector = self.latent[_features(words)].sum(0)
        return float(vector @ self.vectors[item] / max(float(np.linalg.norm(vector)), 1e-3))

    def candidates(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, float]]:
        """(document, item, first, last word, cosine) of windows close to an item; documents lie apart by an empty window."""
        lengths = np.array([len(d) for d in docs])
        room = -(-lengths // BLOCK) * BLOCK + self.gap
        begins = np.cumsum(room) - room
        features = np.full(int(room.sum()), FEATURES)
        for begin, doc in zip(begins.tolist(), docs):
            features[begin : begin + len(doc)] = _features(doc)
        blocks = features.reshape(-1, BLOCK)
        sums = np.zeros((len(blocks) + 1, self.latent.shape[1]), np.float32)
        for k in range(BLOCK):
            sums[1:] += self.latent[blocks[:, k]]
        np.cumsum(sums, axis=0, out=sums)
        for length, members in self.scales.items():
            starts = np.arange(0, len(blocks) - length + 1, max(1, length // 2))
            windows = sums[starts + length] - sums[starts]
            norms = np.sqrt(np.einsum("ij,ij->i", windows, windows))
            cosines = windows @ self.vectors[members].T
            window, column = np.nonzero(cosines >= CLOSE * np.maximum(norms, 1e-3)[:, None])
            item, first = np.array(members)[column], starts[window] * BLOCK
            inside = features[first[:, None] + np.arange(length * BLOCK)]
            shared = self.held[item[:, None], inside].sum(1) >= HELD * (inside < FEATURES).sum(1)
            owner = np.minimum(np.searchsorted(begins, first + length * BLOCK // 2, side="right") - 1, len(docs) - 1)
            for d, i, at, w, c in zip(owner[shared].tolist(), item[shared].tolist(), first[shared].tolist(), window[shared].tolist(), column[shared].tolist()):
                margin = self.sizes[i] // 2 + length * BLOCK // 2
                low = at - int(begins[d])
                yield d, i, max(0, low - margin), min(int(lengths[d]), low + length * BLOCK + margin) - 1, float(cosines[w, c] / max(norms[w], 1e-3))

    def matches(self, docs: list[np.ndarray]) -> list[tuple[int, int, float, float, float, int, int]]:
        """(document, item, cosine, share in order, answer's share, first, last word) of every item that a document's words hold."""
        found, listed = {}, {}
        for doc, item, first, last, cosine in self.candidates(docs):
            if doc not in listed:
                listed[doc] = docs[doc].tolist()
            region = listed[doc][first : last + 1]
            share = common_words(self.masks[item], self.sizes[item], region) / self.sizes[item]
            if share < PARAPHRASE:
                continue
            masks, n = self.answers[item]
            answered = common_words(masks, n, region) / n if n else 0.0
            if share >= VERBATIM or answered >= ANSWERED:
                row = (share, cosine, answered, first, last)
                found[doc, item] = max(found.get((doc, item), row), row)
        for doc, item, first, last in self.dense(docs):
            if doc not in listed:
                listed[doc] = docs[doc].tolist()
            best = max(self.held_whole(item, listed[doc], first, last), default=None)
            if best:
                share, answered, first, last = best
                row = (share, self.cosine(item, docs[doc][first : last + 1]), answered, first, last)
                found[doc, item] = max(found.get((doc, item), row), row)
        return [(doc, self.ids[i], cosine, share, answered, first, last) for (doc, i), (share, cosine, answered, first, last) in found.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, item_block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, item_id, cosine, share, answer_share, first_word, last_word): every document and item that it holds.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns
    are not read. Null and wordless texts and items match nothing. Repeated rows
    of a document give repeated results, repeated items are searched for once a
    row. An empty table on either side gives no rows. Items are searched for in
    blocks of about ``item_block``, so what a task holds does not grow with the
    benchmark; every block meets all documents.
    """
    schema = "doc_id long, item_id long, cosine double, share double, answer_share double, first_word long, last_word long"
    latent = fit_latent(docs)
    blocks = -(-benchmark.where("text is not null").count() // item_block)
    out = None
    for block in range(blocks):
        rows = benchmark.where("text is not null").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", "text").collect()
        items = Items([(r["item_id"], r["text"]) for r in rows], latent)

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for step in text_steps(whole):
                    ids = word_ids(step.column("text"))
                    for at in range(0, step.num_rows, _STEP):
                        found = items.matches(ids[at : at + _STEP])
                        docs = step.column("doc_id").take(pa.array([at + m[0] for m in found], pa.int64()))
                        columns = list(zip(*found))[1:] or [()] * 6
                        kinds = [pa.int64(), *[pa.float64()] * 3, pa.int64(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([docs, *[pa.array(c, k) for c, k in zip(columns, kinds)]], [f.split()[0] for f in schema.split(", ")])

        part = docs.select("doc_id", "text").mapInArrow(tidy(run), schema)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else materialize(out, "contaminated")
