"""Which terms occur in which texts, for whole tables of both, as equi-joins.

A text is cut into word tokens and single other characters. Every token of a
term except a word at its very start or end must occur in the text as a whole
token, so the term is looked up under its rarest such token. A term without
one (a single word, or two) is looked up under its longest word, which may be
part of a longer word of the text: the vocabulary is expanded into substrings
of just the lengths needed. Both ways only propose pairs; ``contains`` decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialize

PIECES = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]"
WORD = r"^[\p{L}\p{N}]"


def _pieces(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(PIECES), F.lit(0))


def _occurrences(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(F.array_distinct(_pieces(F.col("body")))).alias("piece"))


def contained_terms(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """``(doc_id, term_id)`` where ``lower(documents.text)`` contains ``lower(terms.name)``.

    Texts are looked up and checked by distinct name; the terms that share a name join at the end.
    """
    docs = documents.select("doc_id", F.lower("text").alias("body"))
    named = terms.filter((F.coalesce(F.col("name"), F.lit("")) != "") & F.col("term_id").isNotNull()).select(
        "term_id", F.lower("name").alias("name_lc"))
    split = named.select("name_lc").distinct().withColumn("p", _pieces(F.col("name_lc")))
    size = F.size("p")
    inner = F.filter(F.col("p"), lambda v, i: ~v.rlike(WORD) | ((i > 0) & (i < size - 1)))
    words = F.filter(inner, lambda v: v.rlike(WORD))
    has_word = F.exists(F.col("p"), lambda v: v.rlike(WORD))

    # whole-token anchors: inner words, or the other characters of a term without any word
    anchors = materialize(split.select("name_lc", F.explode(F.when(
        F.size(words) > 0, F.array_distinct(words)).when(~has_word, F.array_distinct(inner))).alias("piece")), "anchors")
    # counted for the terms' own pieces only; everything else is dropped before the shuffle
    counted = (_occurrences(docs).join(anchors.select("piece").distinct(), "piece", "left_semi")
               .groupBy("piece").agg(F.count(F.lit(1)).alias("docs")))
    anchored = materialize(
        anchors.join(counted, "piece", "left").groupBy("name_lc")
        .agg(F.min_by("piece", F.struct(F.coalesce("docs", F.lit(0)), "piece")).alias("piece")), "anchored")

    edge_terms = materialize(split.filter(has_word & (F.size(words) == 0)).select(
        "name_lc", _longest_word(F.col("p")).alias("part")), "edge-terms")
    lookups = anchored if edge_terms.isEmpty() else anchored.unionByName(_word_parts(docs, edge_terms))
    proposed = _occurrences(docs).join(lookups, "piece").select("doc_id", "name_lc").distinct()
    found = proposed.join(docs, "doc_id").filter(F.contains("body", F.col("name_lc"))).select("doc_id", "name_lc")
    return found.join(named, "name_lc").select("doc_id", "term_id")


def _longest_word(pieces: Column) -> Column:
    return F.element_at(F.array_sort(F.transform(
        F.filter(pieces, lambda v: v.rlike(WORD)), lambda v: F.struct(F.length(v).alias("n"), v.alias("v")))), -1)["v"]


def _word_parts(docs: DataFrame, edge_terms: DataFrame) -> DataFrame:
    """``(name_lc, piece)``: the words of the texts that contain a name's longest word."""
    vocabulary = _occurrences(docs).select("piece").filter(F.col("piece").rlike(WORD)).distinct()
    lengths = edge_terms.select(F.length("part").alias("n")).distinct()
    substrings = F.expr("array_distinct(transform(sequence(1, length(piece) - n + 1), i -> substring(piece, i, n)))")
    parts = (vocabulary.select("piece", F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("n"))
             .join(lengths, "n", "left_semi").select("piece", F.explode(substrings).alias("part")))
    return materialize(parts.join(edge_terms, "part").select("name_lc", "piece"), "word-parts")
