"""The snippet index fed by a stream of code files.

Each micro-batch writes its files' snippets and then their status rows under
its own generation. The current snippets of a file are those of its newest
status row, so a file is replaced as a whole and a half-written generation is
never seen. Nothing is rewritten in place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions.vectors import Embedder
from graphloom.operators.reindex import INDEX_VERSION, build_snippets, classify_files
from graphloom.schema import FILE_STATUS_TABLE, SNIPPET_TABLE
from graphloom.sources.graph_tables import last_write_wins

FILES = "codefile_node_id string, file_path string, code string"

#: Columns that tell which version of a file is newer.
ORDER_COLUMNS = ("sequence", "modified_at")


class SnippetStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def prepare(self) -> None:
        """Empty first generation, so that both tables can be read."""
        for name, schema in (("snippets", SNIPPET_TABLE), ("status", FILE_STATUS_TABLE)):
            self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.folder}/{name}/generation=-1")

    @property
    def status(self) -> DataFrame:
        """The newest status row of every file, with its ``generation``."""
        rows = self.spark.read.parquet(f"{self.folder}/status")
        return last_write_wins(rows.withColumn("g", F.col("generation")), ["codefile_node_id"], F.col("g")).drop("g")

    @property
    def snippets(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/snippets")
        newest = self.status.select("codefile_node_id", "generation")
        return rows.join(newest, ["codefile_node_id", "generation"], "left_semi").drop("generation")

    def apply(self, files: DataFrame, generation: int, embedder: Embedder | None = None,
              version: str = INDEX_VERSION) -> None:
        """Index the new, changed and outdated files of one batch as ``generation``.

        Versions of one file are ordered by ``sequence`` and ``modified_at``, as
        far as the batch has them, then by their text.
        """
        # a file that comes twice in a batch counts as its newest version
        order = [c for c in ORDER_COLUMNS if c in files.columns] + ["code"]
        one_each = files.groupBy("codefile_node_id").agg(F.max_by(F.struct(*files.columns), F.struct(*order)).alias("f")).select("f.*")
        work = classify_files(one_each, self.status, version).filter(F.col("change") != "current")
        path = f"{self.folder}/snippets/generation={generation}"
        build_snippets(work, embedder).write.mode("overwrite").parquet(path)
        counts = (self.spark.read.schema(SNIPPET_TABLE).parquet(path).groupBy("codefile_node_id")
                  .agg(F.count(F.lit(1)).cast("int").alias("snippet_count")))
        done = work.join(counts, "codefile_node_id", "left").select(
            "codefile_node_id", "file_path", F.octet_length("code").cast("long").alias("file_size"), "file_hash",
            F.coalesce("snippet_count", F.lit(0)).alias("snippet_count"), F.lit(version).alias("index_version"),
            F.current_timestamp().alias("indexed_at"))
        done.write.mode("overwrite").parquet(f"{self.folder}/status/generation={generation}")


def index_stream(files: DataFrame, store: SnippetStore, checkpoint: str, embedder: Embedder | None = None,
                 reload: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Index everything available now from a stream of files, then hand the snippets to ``reload``."""
    store.prepare()

    def process(batch: DataFrame, batch_id: int) -> None:
        store.apply(batch, batch_id, embedder)
        if reload is not None:
            reload(store.snippets)

    return (files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(process).start())
