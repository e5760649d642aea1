"""Source files as line rows with running block depth, shared by chunking and outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: what counts as text or comment, and as a block ------------
LUA_OPENERS = r"\b(function|if|do|repeat)\b"
LUA_CLOSERS = r"\b(end|until)\b"
LUA_TEXT = r"(?s)--\[(=*)\[.*?\]\1\]|--[^\n]*|\[(=*)\[.*?\]\2\]|" + "|".join(
    rf"{q}[^{q}\\\n]*+(?:\\.[^{q}\\\n]*+)*+{q}" for q in "\"'")
CS_TEXT = (r"(?s)/\*.*?\*/|//[^\n]*|\$?@\$?" + r'"[^"]*+(?:""[^"]*+)*+"' + r'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"' + r"|'(?:\\.|[^'\\\n])[^'\n]{0,8}'")
# -----------------------------------------------------------------------------


def blanked(code: Column, pattern: str) -> Column:
    """The code with every match of ``pattern`` replaced by the line feeds it holds, so line numbers stay."""
    inside = F.transform(F.regexp_extract_all(code, F.lit(pattern), F.lit(0)), lambda x: F.regexp_replace(x, r"[^\n]+", ""))
    return F.array_join(F.zip_with(F.split(code, pattern), F.concat(inside, F.array(F.lit(""))), lambda o, i: F.concat(o, i)), "")


def line_rows(files: DataFrame) -> DataFrame:
    """``files (file_id, path, lang, code)`` as ``(file_id, path, lang, no, line, bare)``, numbered from 1.

    ``bare`` is the line without strings and comments, also those that span lines.
    """
    bare = (F.when(F.col("lang") == "lua", blanked(F.col("code"), LUA_TEXT))
            .when(F.col("lang") == "csharp", blanked(F.col("code"), CS_TEXT)).otherwise(F.col("code")))
    rows = F.arrays_zip(F.split("code", "\n").alias("line"), F.split(bare, "\n").alias("bare"))
    return files.select("file_id", "path", "lang", F.posexplode(rows).alias("p", "r")).select(
        "file_id", "path", "lang", (F.col("p") + 1).alias("no"), "r.line", "r.bare")


def in_file() -> "Window":
    return Window.partitionBy("file_id").orderBy("no")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def brace_delta(line: Column) -> Column:
    return _count(line, r"\{") - _count(line, r"\}")


def with_depth(lines: DataFrame) -> DataFrame:
    """Adds ``before`` and ``after``: open blocks around each line, never below zero, and ``closes``."""
    is_lua, bare = F.col("lang") == "lua", F.col("bare")
    opens = F.when(is_lua, _count(bare, LUA_OPENERS)).otherwise(_count(bare, r"\{"))
    closes = F.when(is_lua, _count(bare, LUA_CLOSERS)).otherwise(_count(bare, r"\}"))
    running = lines.withColumn("closes", closes).withColumn("delta", opens - closes)
    return clamped_depth(running, "delta").withColumn("before", F.col("after") - F.col("delta"))


def with_block_ends(lines: DataFrame) -> DataFrame:
    """Adds ``end_line``: the first closing line at or after each line that returns to the depth before it.

    A closing line is the end at every depth it passes, so it is dealt to each of
    these, about as many as its closing marks; lines are dealt to their own
    depth, and one ordered pass over each depth of a file finds the next end.
    """
    passed = F.explode(F.sequence(F.col("after"), F.greatest("before", "after")))
    ends = lines.filter("closes > 0").select("file_id", passed.alias("depth"), F.col("no"), F.col("no").alias("_end"))
    both = lines.withColumn("depth", F.col("before")).unionByName(ends, allowMissingColumns=True)
    later = Window.partitionBy("file_id", "depth").orderBy(F.desc("no")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("end_line", F.min("_end").over(later)).filter("_end IS NULL").drop("_end", "depth")


def with_owner(lines: DataFrame) -> DataFrame:
    """Adds ``owner``: the innermost class whose block a line lies in, or an empty text.

    Lines have ``class_name`` (null for most) and ``end_line`` of their blocks. A
    line's level is the number of classes open before it; at that level the last
    class opened is the one it lies in. Two ordered passes, for any depth.
    """
    classes = lines.filter(F.col("class_name").isNotNull())
    ended = classes.filter(F.col("end_line").isNotNull()).select("file_id", F.col("end_line").alias("no"), F.lit(-1).alias("_step"))
    steps = lines.withColumn("_step", F.when(F.col("class_name").isNotNull(), 1).otherwise(0)).unionByName(ended, allowMissingColumns=True)
    before = Window.partitionBy("file_id").orderBy("no").rangeBetween(Window.unboundedPreceding, -1)
    levelled = steps.withColumn("_level", F.coalesce(F.sum("_step").over(before), F.lit(0))).filter("_step >= 0").drop("_step")
    opened = levelled.filter(F.col("class_name").isNotNull()).select(
        "file_id", (F.col("_level") + 1).alias("_level"), "no", F.col("class_name").alias("_opened"))
    both = levelled.unionByName(opened, allowMissingColumns=True)
    upto = Window.partitionBy("file_id", "_level").orderBy("no").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("owner", F.coalesce(F.last("_opened", ignorenulls=True).over(upto), F.lit("")))
    found = found.withColumn("owner", F.when(F.col("_level") > 0, F.col("owner")).otherwise(F.lit("")))
    return found.filter("_opened IS NULL").drop("_opened", "_level")


def clamped_depth(lines: DataFrame, delta: str) -> DataFrame:
    """Adds ``after``: the running sum of ``delta`` held at or above zero."""
    upto = in_file().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = lines.withColumn("_s", F.sum(delta).over(upto))
    return (summed.withColumn("after", F.col("_s") - F.least(F.lit(0), F.min("_s").over(upto))).drop("_s"))
