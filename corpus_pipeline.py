"""A training corpus from the documents table: five filtering and packing stages, each written before the next one reads it.

Documents that a stage rejects are gone for the following ones; texts in which a
secret is found stay, with the secret replaced. The last stage returns pieces of
packed sequences instead of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import read_table
from graphloom.llm.decontam import contaminated
from graphloom.llm.neardup import near_duplicates
from graphloom.llm.packing import pack
from graphloom.llm.queries import ship_package, tokenizer
from graphloom.llm.secretscan import redact
from graphloom.llm.toxicity import toxicity
from graphloom.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _columns(docs: DataFrame) -> list:
    """The columns by name, also names with a dot in them."""
    return [F.col(f"`{c}`") for c in docs.columns]


def _numbered(docs: DataFrame) -> DataFrame:
    """(row, doc): the documents as written rows with a number each, whatever their ids and their columns' names are."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*_columns(docs)).alias("doc")), "numbered")


def _as_documents(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text"))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents of ``rows`` whose number is not in ``gone``."""
    return rows.join(gone, "row", "left_anti").select("doc.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not call toxic, each with its columns as they were.

    Null and empty texts are scored like any other, repeated rows each by
    themselves; very long texts are read whole; an empty table stays empty.
    """
    ship_package(spark)
    scored = toxicity(docs.select("doc_id", "text", F.struct(*_columns(docs.drop("text")), F.lit(0).alias("text")).alias("doc")), read_table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(*["text" if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the row with the smallest doc_id, without ids or with equal ones any of them.

    Wordless and null texts are no duplicates and stay. Rows are told apart by
    number, so repeated and missing ids do not matter; very long texts are
    compared whole; an empty table stays empty; columns stay as they were.
    """
    ship_package(spark)
    rows = _numbered(docs)
    found = materialize(near_duplicates(_as_documents(rows)).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"), "kept"), "groups")
    members = found.join(found.where("not kept").select("group").distinct(), "group")
    named = members.join(rows.select("row", F.col("doc.doc_id").alias("doc_id")), "row")
    stays = named.groupBy("group").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row"))
    return _without(rows, members.join(stays.select("row"), "row", "left_anti").select("row"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows are told apart by number, so a clean row stays whatever shares its id.

    Null and wordless texts hold none; very long texts are searched whole; an
    empty table, or an empty benchmark, takes nothing away; columns stay as they
    were.
    """
    ship_package(spark)
    rows = _numbered(docs)
    return _without(rows, contaminated(_as_documents(rows), read_table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("row")).distinct())


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; null and empty texts, repeated rows and other columns stay as they are."""
    ship_package(spark)
    return redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens.

    A null text is packed as an empty one, repeated rows are packed each, a long
    text goes into several sequences, an empty table gives no pieces; columns
    other than doc_id and text are not read.
    """
    ship_package(spark)
    return pack(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: The models, signatures and searches of the stages are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each one's result written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
