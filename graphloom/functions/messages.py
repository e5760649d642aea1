"""Chat messages: provider conversion and diagnostics over ``(conv_id, turn, role, text)`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.islands import number_runs


def system_texts(messages: DataFrame) -> DataFrame:
    """``(conv_id, system)``: the last system message of each conversation."""
    return (messages.filter(F.col("role") == "system").groupBy("conv_id")
            .agg(F.max_by("text", "turn").alias("system")))


def convert(messages: DataFrame) -> DataFrame:
    """Messages as ``(conv_id, turn, role, block_type, text)``: system turns leave, tool results
    become user blocks, empty assistant turns are dropped and encoded tool calls are told apart."""
    role = F.when(F.col("role") == "tool", F.lit("user")).otherwise(F.col("role"))
    is_calls = F.get_json_object("text", "$.type") == "tool_calls"
    block = (F.when(F.col("role") == "tool", F.lit("tool_result"))
             .when((F.col("role") == "assistant") & F.coalesce(is_calls, F.lit(False)), F.lit("tool_use"))
             .otherwise(F.lit("text")))
    kept = F.col("role").isin("user", "tool") | ((F.col("role") == "assistant") & (F.coalesce("text", F.lit("")) != ""))
    return messages.filter(kept).select("conv_id", "turn", role.alias("role"), block.alias("block_type"), "text")


def runs(messages: DataFrame, *by: str) -> DataFrame:
    """``(conv_id, run, <by>, first_turn, last_turn, blocks)``: adjacent rows equal in ``by`` as one run."""
    numbered = number_runs(messages, "conv_id", "turn", F.concat_ws("|", *by))
    return (numbered.groupBy("conv_id", "run", *by)
            .agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"),
                 F.count(F.lit(1)).alias("blocks")))


def merge_tool_results(converted: DataFrame) -> DataFrame:
    """Adds ``message``: adjacent tool results of a conversation share one user message,
    every other block is a message of its own."""
    return number_runs(converted, "conv_id", "turn", F.col("block_type"),
                       joins=F.col("block_type") == "tool_result").withColumnRenamed("run", "message")


def diagnostics(messages: DataFrame) -> DataFrame:
    """Per conversation: messages, characters, last role and the last six roles."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = (messages.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 6)
              .groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
              .select("conv_id", F.array_join(F.col("r")["role"], ",").alias("recent_roles")))
    sizes = messages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"), F.sum(F.length("text")).alias("chars"),
        F.max_by("role", "turn").alias("last_role"))
    return sizes.join(recent, "conv_id")
