"""JSON properties: reading, shallow merging, tool-result unwrapping, block documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.schema import HOT_ARRAY_PROPERTIES, HOT_STRING_PROPERTIES

# --- fixed values ------------------------------------------------------------
BLOCK_PREFIX = {3: "# ", 4: "## ", 5: "### ", 6: "#### ", 12: "- ", 13: "1. ", 14: "> ", 15: "```\n"}
BLOCK_FIELDS = ["page", "heading1", "heading2", "heading3", "heading4", "text", "bullet",
                "ordered", "quote", "code"]
# -----------------------------------------------------------------------------

_RUNS = "struct<elements:array<struct<text_run:struct<content:string>>>>"
BLOCKS_SCHEMA = ("array<struct<block_type:int,"
                 + ",".join(f"{name}:{_RUNS}" for name in BLOCK_FIELDS) + ">>")


def prop(properties: Column, key: str) -> Column:
    """One property as text; null when absent."""
    return F.get_json_object(properties, f"$['{key}']")


def promote(nodes: DataFrame) -> DataFrame:
    """Raw ``(id, label, properties)`` rows with the hot properties as typed columns.

    Keys of the row are never overridden by equally named properties.
    """
    strings = [prop(F.col("properties"), key).alias(key) for key in HOT_STRING_PROPERTIES]
    arrays = [F.from_json(prop(F.col("properties"), key), "array<string>").alias(key)
              for key in HOT_ARRAY_PROPERTIES]
    vector = F.from_json(prop(F.col("properties"), "_embedding"), "array<float>").alias("embedding")
    return nodes.select("id", "label", *strings, *arrays, vector, "properties")


def merge_properties(properties: Column, changes: dict[str, str]) -> Column:
    """Shallow update: given top-level keys are replaced or added, all others kept whole.

    Values of ``changes`` are JSON texts, so numbers, lists and objects keep their type.
    """
    current = F.coalesce(F.from_json(properties, "map<string,variant>"),
                         F.expr("cast(map() as map<string,variant>)"))
    if not changes:
        return F.to_json(current)
    kept = F.map_filter(current, lambda k, _: ~k.isin(*changes))
    new = F.create_map(*[x for k, v in changes.items()
                         for x in (F.lit(k), F.parse_json(F.lit(v)))])
    return F.to_json(F.map_concat(kept, new))


def property_keys(properties: Column) -> Column:
    """Top-level keys, internal ones (leading underscore) left out."""
    keys = F.coalesce(F.json_object_keys(properties), F.array().cast("array<string>"))
    return F.filter(keys, lambda k: ~F.startswith(k, F.lit("_")))


def unwrap_tool_result(result: Column) -> Column:
    """Text of the first text block of a ``{"content": [...]}`` result; plain content is kept."""
    content = F.coalesce(F.get_json_object(result, "$.content"), result)
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.filter(blocks, lambda b: b["type"] == "text")
    return F.when(F.size(texts) > 0, F.get(texts, F.lit(0))["text"]).otherwise(content)


def blocks_to_markdown(items: Column, limit: int | None = None) -> Column:
    """A JSON array of document blocks as Markdown; ``limit`` cuts it to so many characters."""
    blocks = F.from_json(items, BLOCKS_SCHEMA)
    prefixes = F.create_map(*[F.lit(x) for pair in BLOCK_PREFIX.items() for x in pair])

    def line(block: Column) -> Column:
        runs = F.coalesce(*[block[name]["elements"] for name in BLOCK_FIELDS])
        text = F.trim(F.array_join(F.transform(runs, lambda r: r["text_run"]["content"]), ""))
        prefix = F.coalesce(F.try_element_at(prefixes, block["block_type"]), F.lit(""))
        return F.when(text != "", F.concat(prefix, text))

    lines = F.filter(F.transform(blocks, line), lambda v: v.isNotNull())
    text = F.array_join(lines, "\n")
    return text if limit is None else F.substring(text, 1, limit)
