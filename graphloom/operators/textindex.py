"""BM25 postings as a sorted table, and scoring of one query against them."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scoring, text
from graphloom.schema import TERM_LABEL
from graphloom.session import materialize


# Scores are rounded so that equal documents tie exactly whatever the summation order.
SCORE_DIGITS = 9
# Characters of text a task counts; its postings are sorted in memory.
PART_CHARACTERS = 16_000_000


@dataclass(frozen=True)
class TextIndex:
    """``postings (term, id, label, tf, doc_len)``, ``terms (term, doc_freq)`` and corpus scalars.

    Postings are partitioned by document, so a term that fills a large share
    of them is spread over all partitions, and every file is sorted by term: a
    query's term filter skips to the matching pages of each file.
    """

    postings: DataFrame
    terms: DataFrame
    corpus_size: int
    avg_len: float
    mean_idf: float

    @classmethod
    def build(cls, documents: DataFrame) -> "TextIndex":
        """Index ``documents (id, label, text)``; rows without text count as empty documents."""
        size, characters = documents.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
        parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-characters // PART_CHARACTERS))
        # texts move once, to the task that counts all tokens of their id; rows without text and postings are not shuffled
        placed = documents.select("id", "label", "text").filter(F.length("text") > 0).repartition(parts, "id")
        tokenised = placed.select("id", "label", text.index_tokens(F.col("text")).alias("tokens"))
        sized = tokenised.select("id", "label", F.size("tokens").alias("doc_len"), "tokens")
        postings = materialize(
            sized.select("id", "label", "doc_len", F.explode("tokens").alias("term"))
            .groupBy("term", "id", "label", "doc_len").agg(F.count(F.lit(1)).alias("tf"))
            .sortWithinPartitions("term"), "postings")
        terms = materialize(
            postings.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))
            .sortWithinPartitions("term"), "terms")
        length = postings.agg(F.sum("tf")).first()[0] or 0
        mean = terms.agg(F.avg(scoring.idf(F.lit(float(size)), F.col("doc_freq")))).first()[0] or 0.0
        return cls(postings, terms, size, length / size if size else 1.0, mean)

    def weights(self, terms: list[str]) -> DataFrame:
        """BM25 weights ``(term, id, label, weight)`` of the given terms."""
        wanted = F.col("term").isin(*terms)
        idf = self.terms.filter(wanted).select("term", scoring.floored_idf(
            scoring.idf(F.lit(float(self.corpus_size)), F.col("doc_freq")),
            F.lit(self.mean_idf)).alias("idf"))
        # at most one row per distinct query term
        return (self.postings.filter(wanted).join(F.broadcast(idf), "term")
                .select("term", "id", "label", scoring.bm25_weight(
                    F.col("idf"), F.col("tf"), F.col("doc_len"), F.lit(self.avg_len)).alias("weight")))

    def scores(self, query: str, label: str | None = None) -> DataFrame | None:
        """``(id, label, score)`` with positive score; a repeated query token counts again."""
        counts = Counter(text.query_tokens(query))
        if not counts:
            return None
        repeats = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])
        weighted = self.weights(list(counts))
        if label:
            weighted = weighted.filter(F.col("label") == label)
        return (weighted.withColumn("weight", F.col("weight") * F.element_at(repeats, F.col("term")))
                .groupBy("id", "label").agg(F.round(F.sum("weight"), SCORE_DIGITS).alias("score"))
                .filter(F.col("score") > 0))


def node_text(label: Column, name: Column, description: Column, aliases: Column | None = None,
              discovered: Column | None = None, summary: Column | None = None) -> Column:
    """Indexed text of a node: name and description; terms add their aliases and summary."""
    def filled(c: Column) -> Column:
        return F.when(c != "", c)

    parts = [filled(name), filled(description)]
    if summary is not None and aliases is not None and discovered is not None:
        chosen = F.when(F.size(F.coalesce(discovered, F.array())) > 0, discovered).otherwise(aliases)
        names = F.filter(chosen, lambda a: a != "")
        is_term = label == TERM_LABEL
        parts += [F.when(is_term & (F.size(names) > 0), F.array_join(names, " ")),
                  F.when(is_term, filled(summary))]
    return F.concat_ws(" ", *parts)


def corpus_stats(documents: DataFrame) -> DataFrame:
    """One row: document count, mean token count, distinct terms, mean idf."""
    index = TextIndex.build(documents)
    return index.terms.agg(F.count(F.lit(1)).alias("terms")).select(
        F.lit(index.corpus_size).cast("long").alias("documents"), F.lit(index.avg_len).alias("avg_len"),
        "terms", F.lit(index.mean_idf).alias("mean_idf"))


def exact_terms(term_nodes: DataFrame, content: str) -> DataFrame:
    """Term nodes whose name occurs in ``content`` ignoring case; of equal names the largest id."""
    named = term_nodes.filter(F.coalesce(F.col("name"), F.lit("")) != "")
    hit = named.filter(F.contains(F.lit((content or "").lower()), F.lower("name")))
    return (hit.groupBy(F.lower("name").alias("term_lc"))
            .agg(F.max_by(F.struct("id", "name", "description", "label"), "id").alias("n"))
            .select("n.*"))
