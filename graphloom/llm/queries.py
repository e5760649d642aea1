"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chatformat, secretscan, sqltext
from graphloom.llm.common import read_table
from graphloom.llm.decontam import contaminated
from graphloom.llm.hardnegatives import hard_negatives
from graphloom.llm.licenses import license_report
from graphloom.llm.neardup import near_duplicates
from graphloom.llm.packing import pack
from graphloom.llm.phrases import collocations
from graphloom.llm.quality import quality
from graphloom.llm.sharding import shard
from graphloom.llm.tokencount import token_counts
from graphloom.llm.tokenfile import read_tokens, write_tokens
from graphloom.llm.toxicity import toxicity
from graphloom.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run; once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        folder = tempfile.mkdtemp(prefix="graphloom-package-")
        context.addPyFile(shutil.make_archive(f"{folder}/graphloom", "zip", root, "graphloom"))
        _SHIPPED.add(context.applicationId)


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def shipped(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return run(spark, folder)

    QUERIES[run.__name__] = shipped
    return run


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_karmarkar_karp_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = shard(read_table(spark, folder, "documents"), shards=16)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@query
def op2_sum_of_squares_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack(read_table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op3_weak_supervision_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality(read_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@query
def op4_typed_part_chats(spark: SparkSession, folder: str) -> DataFrame:
    hostile = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(sqltext.HOSTILE_TURN).alias("text"))
    turns = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(hostile)
    out = chatformat.format_chats(chatformat.text_turns(turns))
    out = out.select("conv_id", "formatted", chatformat.read_turns(F.col("formatted")).alias("turns"), chatformat.learned_text(F.col("segments")).alias("learned"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


ORACLES["op4_typed_part_chats"] = sqltext.CHATS


@query
def op7_huffman_token_file(spark: SparkSession, folder: str) -> DataFrame:
    path = work_path(spark, "token-file")
    write_tokens(read_table(spark, folder, "documents"), path, tokenizer("byte_bpe_50k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_multi_index_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read_table(spark, folder, "documents"))


@query
def op10_license_diagonals(spark: SparkSession, folder: str) -> DataFrame:
    return license_report(read_table(spark, folder, "documents"))


ORACLES["op10_license_diagonals"] = sqltext.licenses()


@query
def op5_zstd_novelty_secrets(spark: SparkSession, folder: str) -> DataFrame:
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secretscan.secret_spans(read_table(spark, folder, "documents")).select(
        "doc_id", *[count(kind) for kind in secretscan.KINDS],
        F.sha2(secretscan.listed(spans, base_only=True), 256).alias("base_sha256"), secretscan.listed(spans).alias("spans"))


@query
def op8_kneser_ney_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return toxicity(docs, read_table(spark, folder, "labels")).select(
        "doc_id", "held_out", "score", "predicted", "mean_ratio", "peak_ratio")


@query
def op6_latent_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@query
def op11_double_array_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(read_table(spark, folder, "documents"))


ORACLES["op11_double_array_collocations"] = sqltext.COLLOCATIONS


@query
def op12_resynchronised_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(read_table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op13_windowed_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "embeddings")
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


ORACLES["op13_windowed_hard_negatives"] = sqltext.HARD_NEGATIVES
