"""Phrase collocations: frequent phrases by language, counted with double-array tries, scored by their weakest cut.

Texts are spelled once: every step of a task becomes a row with the 64-bit codes
of its distinct words and, for each place, which of them stands there. All later
passes read these rows. No two words share a code, which is checked.

Candidates come level by level and are safe in the sense of Apriori: a phrase is
looked at only where both its parts without the last and without the first word
are frequent. What is frequent at a level reaches the tasks as a bitmap of fixed
size under the phrases' hashes, so its size does not grow with the corpus and a
full bitmap costs time only. A task sends its counts by 64-bit hash, sorted and
packed into one row for each range of hashes; one of the steps that hold a
frequent hash then spells it out. Candidates are dealt into shards of bounded
size, each a double-array trie over words; every task moves the states of all
positions of its texts through it at once, word by word, and counts accepting
states. Sums over the tasks are the exact frequencies.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import mixed, sorted_groups, text_steps, tidy, word_hashes
from graphloom.session import materialize

#: Words of the longest phrase, bits of a level's bitmap (a power of two), phrases of a trie, UTF-8 bytes of texts handled together.
LONGEST, BITS, SHARD, STEP = 5, 1 << 26, 200_000, 4_000_000

#: Distinct hashes that a task holds before it sends them, words of the corpus for each range of hashes, states of a trie in a packed row.
_HELD, _RANGE, _STATES = 1_500_000, 1 << 21, 1 << 14
#: Places that a node of a trie is tried at before later nodes start further on.
_TRIED = 64
_LINE, _BLANK = 10, 32
#: A-Z lower-cased; the marks that end a piece become line feeds, blanks and tabs become blanks.
_BYTES = bytes(_LINE if chr(b) in ".,;:!?\n\x0b\x0c\r" else _BLANK if chr(b) in " \t" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some texts in turn, by language.

    A pair is a language and a word: ``langs`` and ``spelled`` list the distinct
    ones, ``counts`` their occurrences, ``order`` the pair of each word in turn,
    and ``places`` where it stands when an empty place is left between pieces.
    """

    def __init__(self, batch: pa.RecordBatch):
        texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
        langs = pc.fill_null(batch.column("lang"), "und").dictionary_encode()
        data = np.frombuffer(b"\n".join(texts).translate(_BYTES) + b"\n", np.uint8)
        inside = (data != _LINE) & (data != _BLANK)
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edges = np.r_[0, edges] if inside[0] else edges
        starts, ends = edges[::2], edges[1::2]
        offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside])).dictionary_encode()
        self.words, self.n_words = words.dictionary, max(1, len(words.dictionary))
        self.named = langs.dictionary
        begins = np.cumsum([len(t) + 1 for t in texts[:-1]], dtype=np.int64)
        upto = np.r_[0, np.searchsorted(starts, begins), len(starts)]
        pairs = np.repeat(langs.indices.to_numpy().astype(np.int64) * self.n_words, np.diff(upto)) + words.indices.to_numpy()
        counts = np.bincount(pairs, minlength=1)
        self.seen = np.flatnonzero(counts)
        self.counts = counts[self.seen]
        number = np.zeros(len(counts), np.uint32)
        number[self.seen] = np.arange(len(self.seen))
        self.order = number[pairs]
        lines = np.flatnonzero(data == _LINE)
        after = np.searchsorted(starts, lines)  # the first word after each line feed
        opens = np.zeros(len(starts) + 1, bool)
        opens[after] = True
        opens[0] = False
        self.places = np.arange(len(starts)) + np.cumsum(opens[: len(starts)])

    @property
    def langs(self) -> pa.Array:
        return self.named.take(pa.array(self.seen // self.n_words))

    @property
    def spelled(self) -> pa.Array:
        return self.words.take(pa.array(self.seen % self.n_words))

    def codes(self, salt: int) -> np.ndarray:
        """64-bit hash of each pair, never 0."""
        own = np.fromiter((xxhash.xxh3_64_intdigest(n.encode(), salt) for n in self.named.to_pylist()), np.uint64, len(self.named))
        return np.maximum(mixed(word_hashes(self.words)[self.seen % self.n_words] * _FACTOR + own[self.seen // self.n_words]), np.uint64(1))

    def laid_out(self) -> np.ndarray:
        """For each place one more than the number of its pair, 0 between pieces."""
        out = np.zeros(int(self.places[-1]) + 2 if len(self.places) else 0, np.uint32)
        out[self.places] = self.order + np.uint32(1)
        return out


def joined(prefix: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of its first words and of its last one."""
    return mixed(prefix * _FACTOR + last)


def _held(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


_SPELLED = "lang string, word string, code long, n long, step long, places binary, codes binary"


def _spell(salt: int):
    """Texts to rows of their words with counts, and a row for each step: the codes of its words, and which stands at each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        names, step = ["lang", "word", "code", "n", "step", "places", "codes"], TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in text_steps(batch, most=STEP):
                words = Words(some)
                codes = words.codes(salt)
                columns = (words.langs.cast(pa.string()), words.spelled.cast(pa.string()), pa.array(codes.view(np.int64)), pa.array(words.counts, pa.int64()))
                yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(codes), k) for k in kinds[4:]]], names)
                binaries = [pa.array([x.tobytes()], pa.binary()) for x in (words.laid_out(), codes)]
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, k) for k in kinds[:4]], pa.array([step], pa.int64()), *binaries], names)
                step += 1

    return run


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of a step, which word stands at each place (0: none, else from 1 on), and the words' codes."""
    for batch in batches:
        for k in range(batch.num_rows):
            binaries = (np.frombuffer(batch.column(c)[k].as_py(), kind) for c, kind in (("places", np.uint32), ("codes", np.uint64)))
            yield (batch.column("step")[k].as_py(), *binaries)


def _phrases_of(level: int, places: np.ndarray, own: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the phrases of ``level`` words whose two parts of one word less are frequent, and all places' codes."""
    codes = np.r_[np.zeros(1, np.uint64), own][places]
    part, good = codes, codes != 0  # phrases of one word less, from every place
    for k in range(1, level - 1):
        part, good = joined(part[:-1], codes[k:]), good[:-1] & (codes[k:] != 0)
    at = np.flatnonzero(good)
    good[at] = _held(frequent, part[at])
    at = np.flatnonzero(good[:-1] & good[1:])
    return at, joined(part[at], codes[at + level - 1]), codes


def _summed(hashes: np.ndarray, counts: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct hashes in order, the sums of their counts, and for each the first of the other values."""
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)])
    sums = np.add.reduceat(counts[order], first) if len(first) else counts[:0]
    return hashes[first], sums, *[x[order][first] for x in others]


_PACKED = "range int, hashes binary, counts binary, places binary, steps binary"


def _hash_counts(level: int, bitmap, ranges: int):
    """A task's counts of extended phrases by hash, a packed row for each range; each hash with one of its steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, held, steps = bitmap.value, [], []
        bounds = np.arange(1, ranges, dtype=np.uint64) << np.uint64(64 - int(np.log2(ranges)))

        def leave() -> pa.RecordBatch:
            hashes, counts, where = _summed(*(np.concatenate(x) for x in zip(*held)))
            cuts = np.r_[0, np.searchsorted(hashes, bounds), len(hashes)]
            used = [k for k in range(ranges) if cuts[k] < cuts[k + 1]]
            packed = [[x[cuts[k] : cuts[k + 1]].tobytes() for k in used] for x in (hashes, counts.astype(np.uint32), where)]
            listed = np.array(steps, np.int64).tobytes()
            held.clear()
            steps.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), *[pa.array(x, pa.binary()) for x in packed], pa.array([listed] * len(used), pa.binary())],
                ["range", "hashes", "counts", "places", "steps"])

        for number, places, own in _steps(batches):
            _, hashes, _ = _phrases_of(level, places, own, frequent)
            hashes, counts = _summed(hashes, np.ones(len(hashes), np.int64))
            held.append((hashes, counts, np.full(len(hashes), len(steps), np.uint8)))
            steps.append(number)
            if sum(len(h[0]) for h in held) > _HELD or len(steps) == 256:
                yield leave()
        if held:
            yield leave()

    return run


def _frequent_hashes(least: int):
    """(h, owner): hashes of a sorted partition that come to ``least``, and the mark of a step that holds each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, ["range"]):
            rows = [[np.frombuffer(b, kind) for b in table.column(c).to_pylist()]
                    for c, kind in (("hashes", np.uint64), ("counts", np.uint32), ("places", np.uint8), ("steps", np.int64))]
            steps = np.concatenate([listed[at] for at, listed in zip(rows[2], rows[3])])
            hashes, counts, steps = _summed(np.concatenate(rows[0]), np.concatenate(rows[1]).astype(np.int64), steps)
            kept = counts >= least
            owners = mixed(hashes[kept] ^ mixed(steps[kept].view(np.uint64) + _FACTOR))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[kept].view(np.int64)), pa.array(owners.view(np.int64))], ["h", "owner"])

    return run


def _spelled_out(level: int, bitmap, owners):
    """(h, codes) of the phrases whose step is their owner; where the bitmap is full, others come along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, places, own in _steps(batches):
            at, hashes, codes = _phrases_of(level, places, own, bitmap.value)
            mine = np.flatnonzero(_held(owners.value, mixed(hashes ^ mixed(np.array([number], np.int64).view(np.uint64) + _FACTOR))))
            _, first = np.unique(hashes[mine], return_index=True)
            at = at[mine[first]]
            spelled = [codes[at + k].view(np.int64) for k in range(level)]
            rows = pa.array(list(np.stack(spelled, 1)) if len(at) else [], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[mine[first]].view(np.int64)), rows], ["h", "codes"])

    return run


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit for each of the ``hashes`` (one column), put together by Spark; at most bits / 64 rows reach the driver."""
    hashes = hashes.toDF("h")
    bit = F.col("h").bitwiseAND(F.lit(bits - 1))
    filled = hashes.select(F.shiftrightunsigned(bit, 6).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast((h & {bits - 1}) & 63 as int))").alias("one"))
    rows = filled.groupBy("at").agg(F.bit_or("one").alias("held")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["at"].to_numpy(np.int64)] = rows["held"].to_numpy(np.int64).view(np.uint64)
    return out


def double_array(phrases: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base`` and ``check`` of a trie over lists of codes from 1 on, and the state in which each list ends.

    The state behind code c of state s is base[s] + c if check there is s. State
    0 is dead, state 1 the root. Nodes with several children are placed first,
    those with most of them foremost, each where all its children fit; where that
    takes long, the search starts further on for the nodes after it, so the time
    stays in proportion. Nodes with one child then fill the places left over.
    """
    children: list[dict[int, int]] = [{}]
    nodes = []
    for phrase in phrases:
        node = 0
        for code in phrase:
            if code not in children[node]:
                children[node][code] = len(children)
                children.append({})
            node = children[node][code]
        nodes.append(node)
    wide = sorted((k for k in range(len(children)) if len(children[k]) > 1), key=lambda k: -len(children[k]))
    single = sorted((k for k in range(len(children)) if len(children[k]) == 1), key=lambda k: next(iter(children[k])))
    widest = max((c for row in children for c in row), default=0)
    used, bases, states, start = bytearray(8 * len(children) + 2 * widest + 64), [0] * len(children), [1] * len(children), 2
    used[:2] = b"\1\1"
    for node in wide:
        codes = sorted(children[node])
        apart, at, tried = [c - codes[0] for c in codes], max(start, codes[0] + 1), 0
        while True:
            at = used.find(0, at)
            if at < 0 or at + apart[-1] >= len(used):
                used.extend(bytes(len(used)))
                at = max(at, start, codes[0] + 1)
                continue
            if not any(used[at + d] for d in apart):
                break
            at, tried = at + 1, tried + 1
        if tried > _TRIED and codes[0] < start:
            start = at
        bases[node] = at - codes[0]
        for code in codes:
            used[bases[node] + code] = 1
            states[children[node][code]] = bases[node] + code
    at = 2
    for node in single:  # codes ascend, and so do the places: one pass over both
        code, child = next(iter(children[node].items()))
        at = used.find(0, max(at, code + 1))
        if at < 0:
            at = len(used)
            used.extend(bytes(len(used)))
        used[at] = 1
        bases[node], states[child] = at - code, at
    size = max(states) + widest + 2
    base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
    for node, row in enumerate(children):
        base[states[node]] = bases[node]
        for code in row:
            check[bases[node] + code] = states[node]
    return base, check, np.array(states, np.int64)[nodes]


def count_states(codes: np.ndarray, base: np.ndarray, check: np.ndarray, longest: int) -> np.ndarray:
    """How often each state is reached when every position of ``codes`` (0: no word of the trie) starts at the root."""
    counts = np.zeros(len(base), np.int64)
    at, states = np.arange(len(codes)), np.ones(len(codes), np.int64)
    for level in range(longest):
        inside = at + level < len(codes)
        at, states = at[inside], states[inside]
        ahead = base[states].astype(np.int64) + codes[at + level]
        alive = check[ahead] == states
        at, states = at[alive], ahead[alive]
        counts += np.bincount(states, minlength=len(base))
    return counts


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of candidates as one trie: a row for each phrase with its state, and one with the arrays."""
    from pyspark import TaskContext

    rows = [codes for b in batches for codes in b.column("codes").to_pylist()]
    if not rows:
        return
    shard, listed = TaskContext.get().partitionId(), {}
    coded = [[listed.setdefault(code, len(listed) + 1) for code in codes] for codes in rows]
    base, check, states = double_array(coded)
    buffer = io.BytesIO()
    np.savez(buffer, base=base, check=check, codes=np.fromiter(listed, np.int64, len(listed)).view(np.uint64))
    n = len(rows)
    values = ([shard] * (n + 1), [*states.tolist(), 0], [*rows, None], [*[None] * n, buffer.getvalue()])
    kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["shard", "state", "codes", "trie"])


def _trie_counts(trie, longest: int):
    """(range, counts): how often a task's texts reach the states of a trie, packed by ranges of states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = np.load(io.BytesIO(trie.value))
        base, check, known = loaded["base"], loaded["check"], loaded["codes"]
        order = np.argsort(known)
        known, number = known[order], order + 1
        counts = np.zeros(len(base), np.int64)
        for _, places, own in _steps(batches):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            counts += count_states(np.r_[0, np.where(known[at] == own, number[at], 0)][places], base, check, longest)
        used = [k for k in range(-(-len(counts) // _STATES)) if counts[k * _STATES : (k + 1) * _STATES].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([counts[k * _STATES : (k + 1) * _STATES].tobytes() for k in used], pa.binary())], ["range", "counts"])

    return run


def _state_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the packed counts of each range as rows (state, a); one range is held at a time, and one row of it."""
    at, sums = None, None

    def leave() -> pa.RecordBatch:
        used = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array((at * _STATES + used).astype(np.int32)), pa.array(sums[used])], ["state", "a"])

    for batch in batches:
        for number, packed in zip(batch.column("range").to_pylist(), batch.column("counts").to_pylist()):
            if number != at:
                if at is not None:
                    yield leave()
                at, sums = number, 0
            sums = sums + np.frombuffer(packed, np.int64)
    if at is not None:
        yield leave()


def _spelled(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, word, code, n) of frequent words, (lang, n), and the coded steps; codes are drawn anew in the case that two words share one."""
    for salt in count():
        rows = materialize(texts.mapInArrow(tidy(_spell(salt)), _SPELLED), "spelled")
        words = materialize(rows.where("word is not null").groupBy("lang", "word", "code").agg(F.sum("n").alias("n")), "words")
        if words.count() == words.select("code").distinct().count():
            return words.where(F.col("n") >= least), words.groupBy("lang").agg(F.sum("n").alias("n")), rows.where("places is not null").select("step", "places", "codes")


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = LONGEST, bits: int = BITS, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(lang, words, a) of all phrases of 1 to ``longest`` words that occur ``least`` times, and (lang, n) with the words of each language."""
    spark = docs.sparkSession
    often, sizes, steps = _spelled(docs.select("text", "lang"), least)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    ranges = 1 << max(3, int(np.ceil(np.log2(max(1, total / _RANGE)))))
    share = lambda frame: spark.sparkContext.broadcast(_bitmap(frame, bits))
    singles = often.select("lang", F.array("word").alias("words"), F.col("n").alias("a"))
    frequent, candidates = share(often.select("code")), None
    for length in range(2, longest + 1):
        packed = steps.mapInArrow(tidy(_hash_counts(length, frequent, ranges)), _PACKED)
        found = materialize(packed.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(tidy(_frequent_hashes(least)), "h long, owner long"), "phrase-hashes")
        if found.isEmpty():
            break
        owners = share(found.select("owner"))
        spelled = steps.mapInArrow(tidy(_spelled_out(length, frequent, owners)), "h long, codes array<long>")
        spelled = materialize(spelled.join(found.select("h"), "h", "left_semi"), "phrases")
        for used in (frequent, owners):
            used.unpersist()
        frequent = share(found.select("h"))
        candidates = spelled.select("codes") if candidates is None else candidates.unionByName(spelled.select("codes"))
    if candidates is None:
        return singles, sizes
    every = materialize(candidates.distinct(), "candidates")
    shards = max(1, -(-every.count() // shard))
    tries = materialize(every.repartitionByRange(shards, "codes").mapInArrow(tidy(_tries), "shard int, state int, codes array<long>, trie binary"), "tries")
    counted = None
    for number in range(shards):  # one bounded trie at a time
        arrays = tries.where((F.col("shard") == number) & F.col("trie").isNotNull()).select("trie").first()
        if arrays is None:
            continue
        trie = spark.sparkContext.broadcast(bytes(arrays[0]))
        some = steps.mapInArrow(tidy(_trie_counts(trie, longest)), "range int, counts binary")
        some = some.repartition("range").sortWithinPartitions("range").mapInArrow(tidy(_state_sums), "state int, a long").withColumn("shard", F.lit(number))
        some = materialize(some, "trie-counts")
        trie.unpersist()
        counted = some if counted is None else counted.unionByName(some)
    phrases = tries.where(F.col("trie").isNull()).drop("trie").join(counted, ["shard", "state"]).where(F.col("a") >= least)
    letters = phrases.select("shard", "state", "a", F.posexplode("codes").alias("at", "code")).join(often.select("lang", "word", "code"), "code")
    spelled = letters.groupBy("shard", "state", "a", "lang").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    return singles.unionByName(spelled.select("lang", F.transform("w", lambda x: x["word"]).alias("words"), "a")), sizes


def collocations(docs: DataFrame, least: int = 100, longest: int = LONGEST, top: int = 2000, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` phrases of ``docs`` (text, lang, any others).

    Words, pieces and frequencies are by language (null: ``und``); an occurrence
    lies within a piece, and overlapping ones count. A candidate has 2 to
    ``longest`` words and occurs ``least`` times. Its score is the smallest
    floor(1000 * a * n / (l * r)) over its cuts, of equal ones the first; one that
    lies in a longer candidate which is as frequent is dropped. Order: score and
    a descending, then the phrase in UTF-8 bytes.

    Null and empty texts have no words; repeated rows count each; a very long
    text is one step of its task; an empty table, or one without a frequent
    phrase, gives an empty result. Columns beyond the two are not read.
    """
    counted, sizes = frequent_phrases(docs, least, longest, bits, shard)
    named = materialize(counted.select("lang", F.array_join("words", " ").alias("phrase"), "words", F.size("words").alias("length"), "a"), "phrase-counts")
    longer = named.where("length > 1")
    cuts = longer.select("lang", "phrase", "words", "length", "a", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"),
                       F.array_join(F.slice("words", F.col("k") + 1, F.col("length") - F.col("k")), " ").alias("tail"))
    part = lambda name, count: named.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    wide = lambda c: F.col(c).cast("decimal(18,0)")  # noqa: E731  products of two hold 36 digits
    scored = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(sizes, "lang")
    scored = scored.withColumns({"above": (F.lit(1000) * F.col("a")).cast("decimal(18,0)") * wide("n"), "below": wide("l") * wide("r")})
    scored = scored.withColumn("score", F.expr("above div below"))
    best = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("best")).select("lang", "phrase", "best.*")
    spans = [(at, size) for size in range(2, longest) for at in range(1, longest - size + 2)]
    inner = F.array(*[F.when(F.col("length") >= at + size - 1, F.array_join(F.slice("words", at, size), " ")) for at, size in spans if size < longest])
    held = longer.where("length > 2").select("lang", "a", "length", F.explode(F.array_distinct(inner)).alias("phrase"))
    held = held.where(F.col("phrase").isNotNull() & (F.size(F.split("phrase", " ")) < F.col("length"))).groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    kept = best.join(held, ["lang", "phrase"], "left").where("within is null or within < a")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
