"""Reading code files: directory scans, single files, and the file list of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.jsonprops import prop

# --- fixed values ------------------------------------------------------------
SCAN_ORDER = ["cs", "py", "lua"]
INDEXED_SUFFIX = r"(?i)\.(lua|cs)$"
# -----------------------------------------------------------------------------


def scan_directory(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """``(file_id, path, code)`` of the code files under ``folder``: C# first, then Python, then Lua.

    ``max_files`` keeps the first files of that order; that cut reads names only.
    """
    contents = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                .option("pathGlobFilter", "*.{cs,py,lua}").load(folder).select("path", "content"))
    if max_files is not None:
        contents = contents.join(_first_files(spark, folder, max_files), "path")
    return contents.select(F.col("path").alias("file_id"), "path", _text(F.col("content")).alias("code"))


def _first_files(spark: SparkSession, folder: str, count: int) -> DataFrame:
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
              .select("path", "length").withColumn("suffix", F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
              .filter(F.col("suffix").isin(*SCAN_ORDER)))
    place = F.array_position(F.array(*[F.lit(s) for s in SCAN_ORDER]), F.col("suffix"))
    return listed.orderBy(place, "path").limit(count).select("path")


def _text(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Whole files as ``(file_id, path, code)``."""
    return (spark.read.text(paths, wholetext=True)
            .select(F.input_file_name().alias("path"), F.col("value").alias("code"))
            .select(F.col("path").alias("file_id"), "path", "code"))


def codefile_sources(nodes: DataFrame) -> DataFrame:
    """Code file nodes with a path that the snippet job indexes: ``(codefile_node_id, file_path)``."""
    path = prop(F.col("properties"), "path")
    return (nodes.filter(F.col("label") == "CodeFile")
            .select(F.col("id").alias("codefile_node_id"), path.alias("file_path"))
            .filter((F.coalesce("file_path", F.lit("")) != "") & F.col("file_path").rlike(INDEXED_SUFFIX)))
