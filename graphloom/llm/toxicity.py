"""Toxicity by class-conditional Kneser-Ney models of the characters of words.

A word's next character is predicted from the four before it by interpolated
Kneser-Ney: raw counts at the highest order, continuation counts (of distinct
left neighbours) below. These shared counts come from all documents. Each class,
toxic and ordinary, puts the discounted counts of its own training texts on top
and backs off to the shared model: where a class knows a context well, what it
has never seen there is unlikely; what neither class knows scores alike under
both. A document is compared by its two log-likelihoods per character and by its
most toxic words; a logistic curve, fitted on labelled documents that its models
have not seen, gives the score.

Counting, continuation counts and context sums are Spark aggregations of the
n-gram table. Each n-gram keeps its own exact count, none is merged with another:
a model holds the distinct n-grams of words, which grow with the vocabulary and
far slower than the texts, and reaches driver and workers in 12 bytes each.
The curve is fitted on a bounded sample of scored labelled rows.
"""

from __future__ import annotations

import pickle
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import distinct_words, text_steps, tidy, without
from graphloom.session import materialize

ORDER = 5
#: Hash buckets for n-grams of each length, of ``_bucket_of`` and ``_hash_bucket``; models do not use them, their counts are exact.
BUCKETS = {5: 1 << 21, 4: 1 << 20, 3: 1 << 18, 2: 1 << 16, 1: 1 << 12}
DISCOUNT = 0.75
#: Words whose log-likelihood ratios count as a document's peak.
PEAK_WORDS = 3
#: Labelled rows on which the curve is fitted, at most.
FITTED_ROWS = 20_000
THRESHOLD = 0.3
_BITS, _START, _END = 12, 1, 2
#: Words whose n-grams are formed together, and distinct n-grams that a task holds before it sends them on.
_WORDS, _HELD = 20_000, 1_000_000
#: Bits of an n-gram that are multiplied, and the factor.
MULTIPLIED, FACTOR = (1 << 40) - 1, 6_700_417

# class columns: models for the curve's rows are trained without them ("first"), the final ones with all
_CLASSES = ("toxic_first", "plain_first", "toxic_rest", "plain_rest")


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 4; 2 is held out, 3 fits the curve."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def word_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """60-bit codes of all 5-character windows of the words, with four starts before and an end after; and each window's word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    text = "".join(["\x01\x01\x01\x01" + w + "\x02" for w in words])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = points & np.uint64((1 << _BITS) - 1)
    window = codes[: len(codes) - 4].copy() if len(codes) >= ORDER else codes[:0]
    for k in range(1, ORDER):
        window = window << np.uint64(_BITS) | codes[k : len(codes) - (ORDER - 1 - k)]
    owner = np.repeat(np.arange(len(words)), lengths + 1)  # the word's characters and its end
    at = np.arange(len(owner)) + 4 * owner
    return window[at], owner


def plain_words(tokens: list[str]) -> list[str]:
    """Lower-cased tokens without the punctuation around them; marks used by ``word_codes`` do not occur."""
    return [t.lower().strip(string.punctuation).replace("\x01", "\x03").replace("\x02", "\x03") for t in tokens]


def _summed(grams: np.ndarray, counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct n-grams and the sums of each of their counts."""
    unique, at = np.unique(grams, return_inverse=True)
    return unique, [np.bincount(at, n, len(unique)) for n in counts]


def count_grams(docs: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(gram, one count for each of ``kinds``): 5-gram counts of ``docs`` (text, kind: a number among ``kinds``)."""
    schema = "gram long, " + ", ".join(f"{k} long" for k in kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list[np.ndarray]]] = []

        def leave() -> pa.RecordBatch:
            unique, sums = _summed(np.concatenate([h[0] for h in held]), [np.concatenate(x) for x in zip(*(h[1] for h in held))])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), *[pa.array(x.astype(np.int64)) for x in sums]], ["gram", *kinds])

        for whole in batches:
            for batch in text_steps(whole):
                words, numbers, bounds = distinct_words(batch.column("text"))
                kind = np.repeat(batch.column("kind").to_numpy(), np.diff(bounds))
                counts = [np.bincount(numbers[kind == k], minlength=len(words)) for k in range(len(kinds))]
                words = words.to_pylist()
                for at in range(0, len(words), _WORDS):
                    grams, owner = word_codes(plain_words(words[at : at + _WORDS]))
                    held.append(_summed(grams, [c[at : at + _WORDS][owner] for c in counts]))
                if held:
                    held[:] = [_summed(np.concatenate([h[0] for h in held]), [np.concatenate(x) for x in zip(*(h[1] for h in held))])]
                if held and len(held[0][0]) > _HELD:
                    yield leave()
        if held:
            yield leave()

    return docs.select("text", "kind").mapInArrow(tidy(run), schema).groupBy("gram").agg(*[F.sum(k).alias(k) for k in kinds])


def _bucket_of(grams: np.ndarray, order: int) -> np.ndarray:
    """A bucket by multiplications that stay within 63 bits, so that Spark's checked arithmetic can do the same."""
    x = grams + np.uint64(order)
    for shift in (23, 11):
        x = ((x ^ (x >> np.uint64(shift))) & np.uint64(MULTIPLIED)) * np.uint64(FACTOR)
    return ((x ^ (x >> np.uint64(29))) & np.uint64(BUCKETS[order] - 1)).astype(np.int64)


Counts = tuple[np.ndarray, np.ndarray]
Contexts = tuple[np.ndarray, np.ndarray, np.ndarray]
#: n-grams in order, discounted counts; contexts in order, sums, backoff weights.
Level = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _level(grams: Counts, contexts: Contexts) -> Level:
    """Discounted counts of n-grams that occur; sums and backoff weights of their contexts."""
    (own, n), (above, total, kinds) = grams, contexts
    used, seen = np.flatnonzero(n > 0), np.flatnonzero(total > 0)
    used, seen = used[np.argsort(own[used])], seen[np.argsort(above[seen])]
    weight = np.minimum(1, DISCOUNT * kinds[seen] / total[seen])
    return own[used].astype(np.uint64), np.maximum(n[used] - DISCOUNT, 0).astype(np.float32), above[seen].astype(np.uint64), total[seen].astype(np.float32), weight.astype(np.float32)


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    """The values of the wanted keys, ``default`` where there is none."""
    if not len(keys):
        return np.full(len(wanted), default, np.float32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], np.float32(default))


def _chance(level: Level, own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Discounted share of an n-gram among what follows its context, and the backoff; an n-gram counts no more than its context."""
    grams, count, contexts, sums, weight = level
    above = own >> np.uint64(_BITS)
    total = _found(contexts, sums, above, 0)
    return np.minimum(_found(grams, count, own, 0), total) / np.maximum(total, 1) + _found(contexts, weight, above, 1) * below


class Model:
    """Exact counts of the shared orders and of both classes; scores words."""

    def __init__(self, shared: dict[int, tuple], classes: tuple[Level, Level]):
        self.shared, self.classes = shared, classes

    def __getstate__(self) -> bytes:
        """Keys as differences, which are small, since models travel to every worker."""
        packed = lambda v: (np.diff(v[0], prepend=np.uint64(0)), v[1], np.diff(v[2], prepend=np.uint64(0)), *v[3:])
        return zlib.compress(pickle.dumps(({k: packed(v) for k, v in self.shared.items()}, [packed(v) for v in self.classes])), 1)

    def __setstate__(self, state: bytes) -> None:
        shared, classes = pickle.loads(zlib.decompress(state))
        unpacked = lambda v: (np.cumsum(v[0], dtype=np.uint64), v[1], np.cumsum(v[2], dtype=np.uint64), *v[3:])
        self.shared, self.classes = {k: unpacked(v) for k, v in shared.items()}, tuple(map(unpacked, classes))

    def ratios(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood ratio (toxic to ordinary) and number of predicted characters of each word."""
        windows, owner = word_codes(words)
        grams, at = np.unique(windows, return_inverse=True)
        chance = np.full(len(grams), 1 / (1 << _BITS), np.float32)
        for order in range(1, ORDER + 1):
            chance = _chance(self.shared[order], grams & np.uint64((1 << _BITS * order) - 1), chance)
        toxic, plain = (_chance(level, grams, chance) for level in self.classes)
        return np.bincount(owner, (np.log(toxic) - np.log(plain))[at], len(words)), np.bincount(owner, minlength=len(words))


def _hash_bucket(gram: Column, order: int) -> Column:
    """The bucket number of ``_bucket_of``, as a column."""
    x = gram + F.lit(order)
    for shift in (23, 11):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(MULTIPLIED)) * F.lit(FACTOR)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 29)).bitwiseAND(F.lit(BUCKETS[order] - 1))


def _sums(table: DataFrame, columns: list[str]) -> list[tuple[Counts, Contexts]]:
    """For each column of a table of distinct n-grams: its values by n-gram, and its sums by context with the number of followers."""
    own = table.select("gram", *columns).toPandas()
    above = table.groupBy(F.shiftright("gram", _BITS).alias("above")).agg(
        *[F.sum(c).alias(c) for c in columns], *[F.sum((F.col(c) > 0).cast("long")).alias(f"kinds_{c}") for c in columns]).toPandas()
    return [((own["gram"].to_numpy(), own[c].to_numpy(float)), (above["above"].to_numpy(), above[c].to_numpy(float), above[f"kinds_{c}"].to_numpy(float))) for c in columns]


def shared_levels(grams: DataFrame) -> dict[int, tuple]:
    """Kneser-Ney levels of all orders from the 5-gram counts (gram, n) of all documents."""
    table, levels = grams, {}
    for order in range(ORDER, 0, -1):
        levels[order] = _level(*_sums(table, ["n"])[0])
        # continuation counts; an n-gram that begins a word has no left neighbour and keeps its count
        rest = F.col("gram").bitwiseAND(F.lit((1 << _BITS * (order - 1)) - 1))
        begins = F.shiftright(rest, _BITS * max(order - 2, 0)) == _START
        table = table.select(rest.alias("gram"), F.when(begins, F.col("n")).otherwise(1).alias("n")).groupBy("gram").agg(F.sum("n").alias("n"))
    return levels


def class_levels(grams: DataFrame, toxic: tuple[str, ...], plain: tuple[str, ...]) -> tuple[tuple, tuple]:
    """Highest-order levels of both classes, whose counts are the sums of the named columns."""
    total = lambda names: sum((F.col(n) for n in names[1:]), F.col(names[0]))
    table = grams.select("gram", total(toxic).alias("t"), total(plain).alias("o")).where("t > 0 or o > 0")
    return tuple(_level(*sums) for sums in _sums(table, ["t", "o"]))


def score_features(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with mean_ratio (per character), peak_ratio (mean of the most toxic words) and n_tokens for each row."""
    names = ("mean_ratio", "peak_ratio", "n_tokens")
    docs = without(docs, *names)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_steps(whole):
                words, numbers, bounds = distinct_words(batch.column("text"))
                words, ratios, lengths = words.to_pylist(), [np.empty(0)], [np.empty(0)]
                for at in range(0, len(words), _WORDS):
                    ratio, length = model.ratios(plain_words(words[at : at + _WORDS]))
                    ratios.append(ratio)
                    lengths.append(length)
                ratios, lengths = np.concatenate(ratios)[numbers], np.concatenate(lengths)[numbers]
                rows = []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    if a == b:
                        rows.append((0.0, 0.0, 0))
                        continue
                    ratio = ratios[a:b]
                    top = np.partition(ratio, -PEAK_WORDS)[-PEAK_WORDS:] if len(ratio) > PEAK_WORDS else np.r_[ratio, np.zeros(PEAK_WORDS - len(ratio))]
                    rows.append((float(ratio.sum() / lengths[a:b].sum()), float(top.mean()), b - a))
                out = batch
                for name, kind, values in zip(names, (pa.float64(), pa.float64(), pa.int64()), zip(*rows)):
                    out = out.append_column(name, pa.array(values, kind))
                yield out

    out = T.StructType([*docs.schema.fields, T.StructField("mean_ratio", T.DoubleType()), T.StructField("peak_ratio", T.DoubleType()), T.StructField("n_tokens", T.LongType())])
    return docs.mapInArrow(tidy(run), out)


def _inputs(mean: np.ndarray, peak: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(mean), 10 * mean, peak / 5, np.log1p(tokens) / 5], 1)


def fit_curve(mean: np.ndarray, peak: np.ndarray, tokens: np.ndarray, toxic: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge-penalised logistic curve, by Newton's method; where a class is missing, the other one's share alone."""
    if not 0 < toxic.sum() < len(toxic):
        return np.array([np.log((toxic.sum() + 0.05) / (len(toxic) - toxic.sum() + 1)), 0, 0, 0])
    x, weights = _inputs(mean, peak, tokens), np.zeros(4)
    penalty = ridge * np.diag([1e-3, 1, 1, 1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (toxic - p) - penalty @ weights)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def score_column(weights: np.ndarray) -> Column:
    inputs = (F.lit(1.0), 10 * F.col("mean_ratio"), F.col("peak_ratio") / 5, F.log1p(F.col("n_tokens").cast("double")) / 5)
    odds = sum((F.lit(float(w)) * c for w, c in zip(weights, inputs)), F.lit(0.0))
    return 1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), odds))))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, any others) with held_out, score (0 to 1) and predicted (score >= ``THRESHOLD``).

    ``labels`` (doc_id, toxic 0 or 1) is used for rows whose fold is not 2; a
    doc_id labelled twice counts as toxic if one label says so, a null label is
    none. Labels and ids are no inputs of a score: the text alone is. Null and
    empty texts are scored as texts without words; repeated rows each get a row;
    without any usable toxic and ordinary labels every score is the same. Columns
    of ``docs`` called like a result are replaced, others are passed through.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    known = known.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 2")
    # texts are shuffled only where a label may be: the shared counts need none
    shared = shared_levels(materialize(count_grams(docs.select("text", F.lit(0).alias("kind")), ("n",)), "grams"))
    labelled = docs.select("doc_id", "text").where(fold(F.col("doc_id")) != 2).join(known.hint("merge"), "doc_id")  # labels grow with the corpus
    kind = F.when(F.col("fold") == 3, 2).otherwise(0) + F.when(F.col("label") == 1, 0).otherwise(1)
    grams = materialize(count_grams(labelled.select("text", kind.cast("int").alias("kind")), _CLASSES), "class-grams")
    first = Model(shared, class_levels(grams, ("toxic_first",), ("plain_first",)))
    fitting = known.where("fold = 3")
    share = min(1.0, FITTED_ROWS / max(1, fitting.count()))
    fitting = fitting.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("doc_id", "label")
    fitting = F.broadcast(fitting)  # about FITTED_ROWS rows at most
    sample = score_features(docs.select("doc_id", "text").join(fitting, "doc_id"), first).select("mean_ratio", "peak_ratio", "n_tokens", "label").toPandas()
    weights = fit_curve(sample["mean_ratio"].to_numpy(float), sample["peak_ratio"].to_numpy(float), sample["n_tokens"].to_numpy(float), sample["label"].to_numpy(float))

    model = Model(shared, class_levels(grams, ("toxic_first", "toxic_rest"), ("plain_first", "plain_rest")))
    docs = without(docs, "held_out", "score", "predicted")
    scored = score_features(docs, model).withColumn("score", score_column(weights))
    held_out = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    return scored.withColumns({"held_out": held_out, "predicted": (F.col("score") >= THRESHOLD).cast("int")})
