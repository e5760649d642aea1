"""Column layouts of the stored tables and the vocabularies the operators test against."""

from __future__ import annotations

from pyspark.sql import types as T

NODE_TABLE = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("label", T.StringType()),
    T.StructField("properties", T.StringType()),
])

EDGE_TABLE = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("target", T.StringType(), False),
    T.StructField("relationship", T.StringType(), False),
    T.StructField("properties", T.StringType()),
])

SNIPPET_TABLE = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("codefile_node_id", T.StringType(), False),
    T.StructField("file_path", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("symbol_type", T.StringType()),
    T.StructField("symbol_name", T.StringType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("line_count", T.IntegerType()),
    T.StructField("code_text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

FILE_STATUS_TABLE = T.StructType([
    T.StructField("codefile_node_id", T.StringType(), False),
    T.StructField("file_path", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("file_hash", T.StringType()),
    T.StructField("snippet_count", T.IntegerType()),
    T.StructField("index_version", T.StringType()),
    T.StructField("indexed_at", T.TimestampType()),
])

# Properties promoted from the JSON column to typed columns.
HOT_STRING_PROPERTIES = ["name", "description", "summary", "path", "file_type", "infra_layer",
                         "wiki_url", "wiki_link", "story_url", "sheet_url"]
HOT_ARRAY_PROPERTIES = ["aliases", "discovered_aliases"]

# --- fixed values: names and limits that results depend on -------------------
TERM_LABEL = "BusinessTerm"
ENTITY_LABEL = "InBusinessEntity"
CODE_LABEL = "CodeFile"
STORY_LABEL = "WikiStory"
FOLDER_LABEL = "Folder"
QUESTION_LABEL = "Question"
PREFAB_LABEL = "Prefab"
INFRA_LAYER = "L1"
RAISES_QUESTION = "RAISES_QUESTION"
IMPLEMENTED_IN = "IMPLEMENTED_IN"
HAS_ENTITY = "HAS_ENTITY"

NODE_LABELS = ["BusinessTerm", "CodeFile", "Question", "InBusinessEntity", "WikiStory", "Folder",
               "Prefab", "ArchNode", "LogicNode", "ConfigField", "SpecRule", "SpecEvidence",
               "WikiDoc", "NarrativeElement", "Story", "Doc"]
OUTLINE_LABELS = ["LogicNode", "ArchNode", "ConfigField", "SpecRule", "SpecEvidence"]
RELATIONSHIPS = ["RAISES_QUESTION", "IMPLEMENTED_IN", "HAS_ENTITY", "ENTITY_REFS_FILE",
                 "SUBFOLDER_OF", "HAS_CHILD"]
ID_PATTERN = r"^[A-Za-z0-9_:\-./一-鿿]{1,256}$"

MAX_NAME = 200
MAX_TEXT = 5000
MIN_QUESTION = 4
INGEST_LIST_LIMIT = 200
# -----------------------------------------------------------------------------
