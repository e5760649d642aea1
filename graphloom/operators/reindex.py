"""Incremental snippet indexing: which files changed, and the tables after the run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import content_hash, embed_text
from graphloom.functions.vectors import Embedder, with_embedding
from graphloom.operators.chunking import chunk_files

# --- fixed values ------------------------------------------------------------
INDEX_VERSION = "v1"
# -----------------------------------------------------------------------------


def classify_files(files: DataFrame, status: DataFrame, version: str = INDEX_VERSION) -> DataFrame:
    """Files ``(codefile_node_id, file_path, code)`` with ``file_hash`` and ``change``.

    ``new`` has no status row, ``changed`` another hash, ``outdated`` another
    index version; ``current`` files need no work.
    """
    known = status.select("codefile_node_id", F.col("file_hash").alias("old_hash"),
                          F.col("index_version").alias("old_version"))
    hashed = files.withColumn("file_hash", content_hash(F.col("code")))
    change = (F.when(F.col("old_version").isNull() & F.col("old_hash").isNull(), F.lit("new"))
              .when(~F.col("old_hash").eqNullSafe(F.col("file_hash")), F.lit("changed"))
              .when(~F.col("old_version").eqNullSafe(F.lit(version)), F.lit("outdated"))
              .otherwise(F.lit("current")))
    return hashed.join(known, "codefile_node_id", "left").withColumn("change", change).drop("old_hash", "old_version")


def change_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("change").agg(F.count(F.lit(1)).alias("files"))


def snippet_id(file_id: Column, start_line: Column, ordinal: Column) -> Column:
    """Unique inside a file even when two chunks start on one line."""
    return F.concat(F.lit("snip:"), file_id, F.lit(":"), start_line.cast("string"), F.lit(":"), ordinal.cast("string"))


def build_snippets(files: DataFrame, embedder: Embedder | None = None, batch: int = 32) -> DataFrame:
    """Snippet rows of ``files (codefile_node_id, file_path, code)``; null vectors without an embedder."""
    chunks = chunk_files(files.select(F.col("codefile_node_id").alias("file_id"),
                                      F.col("file_path").alias("path"), "code"))
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    lang = F.when(suffix == "cs", F.lit("csharp")).otherwise(suffix)
    rows = chunks.withColumn("lang", lang)
    if embedder is not None:
        rows = with_embedding(rows.withColumn("_text", embed_text(
            F.col("path"), F.col("lang"), F.col("symbol_type"), F.col("symbol_name"), F.col("code_text"))),
            "_text", embedder, batch).drop("_text")
    else:
        rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    now = F.current_timestamp()
    return rows.select(
        snippet_id(F.col("file_id"), F.col("start_line"), F.col("ordinal")).alias("id"),
        F.col("file_id").alias("codefile_node_id"), F.col("path").alias("file_path"), "lang", "symbol_type",
        "symbol_name", "start_line", "end_line", "line_count", "code_text", "embedding",
        now.alias("created_at"), now.alias("updated_at"))


@dataclass(frozen=True)
class Reindexed:
    snippets: DataFrame
    status: DataFrame
    work: DataFrame


def reindex(files: DataFrame, snippets: DataFrame, status: DataFrame, embedder: Embedder | None = None,
            version: str = INDEX_VERSION) -> Reindexed:
    """Snippet and status tables after one run; only new, changed and outdated files are chunked."""
    work = classify_files(files, status, version).filter(F.col("change") != "current")
    fresh = build_snippets(work, embedder)
    ids = work.select("codefile_node_id")
    kept = snippets.join(ids, "codefile_node_id", "left_anti").select(*snippets.columns)
    counts = fresh.groupBy("codefile_node_id").agg(F.count(F.lit(1)).cast("int").alias("snippet_count"))
    done = work.join(counts, "codefile_node_id", "left").select(
        "codefile_node_id", "file_path", F.octet_length("code").cast("long").alias("file_size"), "file_hash",
        F.coalesce("snippet_count", F.lit(0)).alias("snippet_count"), F.lit(version).alias("index_version"),
        F.current_timestamp().alias("indexed_at"))
    old = status.join(ids, "codefile_node_id", "left_anti").select(*done.columns)
    return Reindexed(kept.unionByName(fresh), old.unionByName(done), work)
