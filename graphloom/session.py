"""Session defaults, the shared work folder, and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from typing import Generic, TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def build_session(app: str = "graphloom", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the defaults this package is written against.

    Anything set by the cluster (spark-submit, spark-defaults) keeps its value
    unless it is named in ``conf``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **(conf or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session without that setting gets a folder of its own; on
    a cluster the folder has to be one every executor can reach, so its absence
    is an error rather than a silent fall-back to a machine-local path.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return context.getCheckpointDir().rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table in the work folder and read it back.

    Cuts the lineage like a reliable checkpoint (lost executors re-read files),
    runs the plan once, and gives later plans a true size: a small result is
    broadcast by Catalyst's own threshold, a large one is not.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(rows: DataFrame, name: str, buckets: int, *columns: str) -> DataFrame:
    """Write ``rows`` as a table of so many buckets by ``columns``; rows that lie by them already are not shuffled."""
    spark, table = rows.sparkSession, f"graphloom_{name}_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, *columns).sortBy(*columns).option("path", work_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def pin_top(df: DataFrame, limit: int) -> DataFrame:
    """Hold an already ranked result of at most ``limit`` rows as a local relation.

    For top-k lists only: they are used by several later joins and the bound is
    the caller's k, not the data.
    """
    rows = df.limit(limit).collect()
    return df.sparkSession.createDataFrame(rows, df.schema)


def together(*steps: Callable[[], T]) -> list[T]:
    """Run independent steps at the same time, so that their small jobs share the cluster."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=len(steps)) as pool:
        return [f.result() for f in [pool.submit(inherit(step)) for step in steps]]


class Once(Generic[T]):
    """A part that is made when it is first asked for, by one of the threads that ask."""

    def __init__(self, make: Callable[[], T]):
        self.make, self.made, self.lock = make, None, Lock()

    def get(self) -> T:
        with self.lock:
            if self.made is None:
                self.made = (self.make(),)
            return self.made[0]
