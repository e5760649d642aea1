"""A text index of immutable segments: updates write postings of changed documents only, reads merge segments.

A segment holds the postings of the documents it adds, tombstones of the
documents whose older postings no longer count, and the change of every term's
document frequency. Together with the corpus sums in the manifest that is all
that scoring needs; no update reads a document that did not change. Segments are
merged by size, so there are about as many as the logarithm of the updates.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scoring, text
from graphloom.operators.textindex import TextIndex
from graphloom.sources.manifest import CommitClash, Manifests

_POSTINGS = "term string, id string, label string, doc_len int, tf long, segment int"
_DEAD = "id string, segment int"
_TERMS = "term string, n long"


@dataclass(frozen=True)
class Segment:
    """``number`` orders segments; ``size`` counts documents added and removed."""

    number: int
    path: str
    size: int


class SegmentedIndex:
    """Segments and their manifest under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.manifests = spark, folder.rstrip("/"), Manifests(spark, folder)

    # --- writing -----------------------------------------------------------------

    def create(self, documents: DataFrame) -> None:
        """The first segment: all of ``documents (id, label, text)``."""
        nothing = documents.select("id", F.lit(None).cast("string").alias("text")).limit(0)
        self._write(0, [], {"documents": 0, "tokens": 0}, nothing, documents)

    def update(self, before: DataFrame, after: DataFrame, parent: int | None = None) -> None:
        """Replace the documents ``before (id, text)`` by ``after (id, label, text)``.

        An id in ``before`` alone is deleted, one in ``after`` alone is new. Texts
        of ``before`` must be those that are indexed, as a version's diff gives
        them; they tell by how much term frequencies fall. ``CommitClash`` if the
        index is no longer at ``parent``.
        """
        at = self.manifests.head()
        if parent is not None and parent != at:
            raise CommitClash(f"version {parent} is no longer the newest")
        held = self.manifests.read(at)
        self._write(at, [Segment(**s) for s in held["segments"]], held["corpus"], before, after)

    def _write(self, parent: int, segments: list[Segment], corpus: dict, before: DataFrame, after: DataFrame) -> None:
        number, path = parent + 1, f"{self.folder}/segment-{uuid.uuid4().hex}"
        tokens = text.index_tokens(F.coalesce("text", F.lit("")))
        # in steps of their own: beside an explode, the length would be taken from the text again for every token
        sized = after.select("id", "label", tokens.alias("tokens")).select("id", "label", F.size("tokens").alias("doc_len"), "tokens")
        added = sized.select("id", "label", "doc_len", F.explode("tokens").alias("term"))
        postings = added.groupBy("term", "id", "label", "doc_len").agg(F.count(F.lit(1)).alias("tf")).withColumn("segment", F.lit(number))
        postings.sortWithinPartitions("term").write.parquet(f"{path}/postings")
        before.select("id", F.lit(number).alias("segment")).write.parquet(f"{path}/dead")
        up = self.spark.read.schema(_POSTINGS).parquet(f"{path}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        down = before.select(F.explode(F.array_distinct(tokens)).alias("term"), F.lit(-1).cast("long").alias("n"))
        self._terms(up.unionByName(down), path)
        sums = lambda rows: rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(tokens)), F.lit(0)).alias("tokens")).first()
        plus, minus = sums(after), sums(before)
        corpus = {"documents": corpus["documents"] + plus["n"] - minus["n"], "tokens": corpus["tokens"] + plus["tokens"] - minus["tokens"]}
        self._publish(number, self._merged([*segments, Segment(number, path, plus["n"] + minus["n"])]), corpus)

    @staticmethod
    def _terms(changes: DataFrame, path: str) -> None:
        changes.groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0").sortWithinPartitions("term").write.parquet(f"{path}/terms")

    def _merged(self, segments: list[Segment]) -> list[Segment]:
        """Join the newest segments while the older neighbour is no larger than twice what follows it."""
        keep, size = len(segments) - 1, segments[-1].size
        while keep and segments[keep - 1].size <= 2 * size:
            keep -= 1
            size += segments[keep].size
        some = segments[keep:]
        if len(some) == 1:
            return segments
        number, path = some[-1].number, f"{self.folder}/segment-{uuid.uuid4().hex}"
        self._live(some).withColumn("segment", F.lit(number)).sortWithinPartitions("term").write.parquet(f"{path}/postings")
        if keep:  # older segments still need the tombstones
            dead = self._read(some, "dead", _DEAD).select("id").distinct().withColumn("segment", F.lit(number))
        else:
            dead = self.spark.createDataFrame([], _DEAD)
        dead.write.parquet(f"{path}/dead")
        self._terms(self._read(some, "terms", _TERMS), path)
        return [*segments[:keep], Segment(number, path, size)]

    def _publish(self, number: int, segments: list[Segment], corpus: dict) -> None:
        """The average idf needs every term, which are read from the segments' term counts."""
        frequencies = self._frequencies(segments)
        mean = frequencies.agg(F.avg(scoring.idf(F.lit(float(corpus["documents"])), F.col("doc_freq")))).first()[0] or 0.0
        self.manifests.create(number, {"segments": [vars(s) for s in segments], "corpus": corpus, "mean_idf": mean})

    # --- reading -----------------------------------------------------------------

    def _read(self, segments: list[Segment], what: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{s.path}/{what}" for s in segments])

    def _live(self, segments: list[Segment]) -> DataFrame:
        """Postings that no later segment has made void: one join with the newest tombstone of each id."""
        postings = self._read(segments, "postings", _POSTINGS)
        if len(segments) == 1:
            return postings
        dead = self._read(segments, "dead", _DEAD).groupBy("id").agg(F.max("segment").alias("until"))
        return postings.join(dead, "id", "left").where("until is null or segment >= until").drop("until")

    def _frequencies(self, segments: list[Segment]) -> DataFrame:
        terms = self._read(segments, "terms", _TERMS)
        return terms.groupBy("term").agg(F.sum("n").alias("doc_freq")).where("doc_freq > 0")

    @property
    def segments(self) -> list[Segment]:
        return [Segment(**s) for s in self.manifests.read(self.manifests.head())["segments"]]

    def index(self, version: int | None = None) -> TextIndex:
        """The index as of a version (the newest by default), to be scored like one built at once."""
        held = self.manifests.read(self.manifests.head() if version is None else version)
        segments = [Segment(**s) for s in held["segments"]]
        size, tokens = held["corpus"]["documents"], held["corpus"]["tokens"]
        return TextIndex(self._live(segments).drop("segment"), self._frequencies(segments), size, tokens / size if size else 1.0, held["mean_idf"])
