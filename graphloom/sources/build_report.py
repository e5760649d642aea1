"""Progress of a graph build from its JSON checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PHASES = ["phase1", "phase2", "phase3"]


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """One row per term of ``{"terms": {name: {phase1, phase2, phase3}}, "metadata": {...}}``: ``(name, term, last_saved)``."""
    body = spark.read.text(path, wholetext=True)
    terms = F.from_json(F.get_json_object("value", "$.terms"), "map<string,struct<phase1:string,phase2:string,phase3:string>>")
    listed = body.select(F.explode(terms).alias("name", "raw"),
                         F.get_json_object("value", "$.metadata.last_saved").alias("last_saved"))

    def phase(name: str) -> Column:
        status = F.coalesce(F.get_json_object(F.col(f"raw.{name}"), "$._status"), F.lit(""))
        return F.when(F.col(f"raw.{name}").isNotNull(), F.struct(status.alias("_status"))).alias(name)

    return listed.select("name", F.struct(*[phase(p) for p in PHASES]).alias("term"), "last_saved")


def phase_progress(entries: DataFrame) -> DataFrame:
    """``(phase, done, errors, progress)`` over ``entries (term struct<phaseN: struct<_status>>)``."""
    parts = F.array(*[F.struct(F.lit(p).alias("phase"), F.col(f"term.{p}._status").alias("status"),
                               F.col(f"term.{p}").isNotNull().alias("present")) for p in PHASES])
    failed = F.coalesce(F.col("p.status"), F.lit("")) == "error"
    counted = (entries.select(F.explode(parts).alias("p")).groupBy(F.col("p.phase").alias("phase"))
               .agg(F.count_if(F.col("p.present") & ~failed).alias("done"),
                    F.count_if(F.col("p.present") & failed).alias("errors"), F.count(F.lit(1)).alias("total")))
    return counted.select("phase", "done", "errors", F.format_string(
        "%.1f%%", F.col("done") * F.lit(100.0) / F.col("total")).alias("progress"))
