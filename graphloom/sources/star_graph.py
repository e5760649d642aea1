"""A property graph over star-schema, document and event tables in parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.schema import (CODE_LABEL, ENTITY_LABEL, FOLDER_LABEL, HAS_ENTITY, IMPLEMENTED_IN,
                              INFRA_LAYER, QUESTION_LABEL, RAISES_QUESTION, STORY_LABEL, TERM_LABEL)

# --- fixed values: how the given tables map to labels, states and categories ---
LABEL_BY_LANG = {"en": CODE_LABEL, "fr": ENTITY_LABEL, "de": STORY_LABEL}
LINK_BY_LANG = {"en": IMPLEMENTED_IN, "fr": HAS_ENTITY, "de": "TOLD_IN"}
SUFFIXES = [".lua", ".cs", ".py", ".json"]
STATUS_BY_EVENT = {"view": "pending", "click": "approved", "purchase": "completed",
                   "signup": "rejected", "error": "failed"}
CATEGORIES = ["proposal", "contradictory", "untraceable", "ambiguous", "wrong_association",
              "weak_association"]
# -------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(column: Column, choices: dict[str, str], default: Column) -> Column:
    result = default
    for key, value in choices.items():
        result = F.when(column == key, F.lit(value)).otherwise(result)
    return result


def _key(prefix: str, column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.concat(F.lit(prefix + ":"), column.cast("string"))


def _node(frame: DataFrame, node_id: Column, label: Column | str, name: Column, **extra: Column) -> DataFrame:
    label = F.lit(label) if isinstance(label, str) else label
    null = F.lit(None).cast("string")
    vector = extra.get("embedding", F.lit(None).cast("array<float>"))
    columns = [extra.get(c, null).alias(c) for c in ("description", "path", "infra_layer")]
    props = F.to_json(F.struct(name.alias("name"), *[c for n, c in (
        ("path", extra.get("path")), ("infra_layer", extra.get("infra_layer"))) if c is not None
        for c in [c.alias(n)]], *[v.alias(k) for k, v in extra.get("props", {}).items()]))
    return frame.select(node_id.alias("id"), label.alias("label"), name.alias("name"), *columns,
                        vector.alias("embedding"), props.alias("properties"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review questions ``(id, question, category, context, status, created_at, related_node_id)``."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), F.pmod(k, F.lit(6)) + 1)
    return events.select(
        _key("question", "event_id").alias("id"),
        F.concat_ws(" ", F.lit("Review"), "event_type", k.cast("string")).alias("question"),
        category.alias("category"),
        F.col("props").alias("context"),
        _choose(F.col("event_type"), STATUS_BY_EVENT, F.lit("pending")).alias("status"),
        F.col("ts").alias("created_at"),
        _key("customer", "user_id").alias("related_node_id"))


def star_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Nodes and edges projected from the tables; edges are unique on all three columns."""
    read = lambda name: table(spark, sf_dir, name)
    documents, benchmark = read("documents"), read("benchmark")
    vectors = read("embeddings").select("vec_id", "embedding")

    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("doc_id") % 4 + 1).cast("int"))
    file_name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), suffix)
    is_code = F.col("lang") == "en"
    asked = questions(spark, sf_dir)
    nodes = [
        _node(read("region"), _key("region", "r_regionkey"), "Region", F.col("r_name"),
              infra_layer=F.lit(INFRA_LAYER)),
        _node(read("nation"), _key("nation", "n_nationkey"), "Nation", F.col("n_name")),
        _node(read("customer"), _key("customer", "c_custkey"), "Customer", F.col("c_name")),
        _node(read("supplier"), _key("supplier", "s_suppkey"), "Supplier", F.col("s_name")),
        _node(read("part"), _key("part", "p_partkey"), "Part", F.col("p_name")),
        _node(read("orders"), _key("order", "o_orderkey"), "Order", F.col("o_orderpriority")),
        _node(read("pages"), _key("page", "page_id"), "WikiDoc", F.col("url")),
        _node(documents.select("source").distinct(), _key("dir", "source"), FOLDER_LABEL, F.col("source")),
        _node(documents.join(vectors, documents["doc_id"] == vectors["vec_id"], "left"),
              _key("doc", "doc_id"), _choose(F.col("lang"), LABEL_BY_LANG, F.lit("Doc")), file_name,
              description=F.col("text"), embedding=F.col("embedding"),
              path=F.when(is_code, F.concat(F.lit("C:\\Git\\record\\"), "source", F.lit("\\"), file_name))),
        _node(benchmark.join(vectors, benchmark["item_id"] == vectors["vec_id"], "left"),
              _key("bt", "item_id"), TERM_LABEL, F.col("text"), embedding=F.col("embedding")),
        _node(asked, F.col("id"), QUESTION_LABEL, F.lit(None).cast("string"),
              props={c: F.col(c) for c in ("question", "category", "status", "related_node_id")}),
    ]

    terms = benchmark.agg(F.count(F.lit(1)).alias("n_terms")).withColumn("one", F.lit(1))
    linked = (documents.select("doc_id", "lang").filter(F.col("lang").isin(*LINK_BY_LANG))
              .withColumn("one", F.lit(1)).join(F.broadcast(terms), "one"))  # one row

    def pairs(frame: DataFrame, source: Column, relationship: str | Column, target: Column) -> DataFrame:
        rel = F.lit(relationship) if isinstance(relationship, str) else relationship
        return frame.select(source.alias("source"), target.alias("target"), rel.alias("relationship"))

    lineitem = read("lineitem")
    edges = [
        pairs(read("nation"), _key("nation", "n_nationkey"), "PART_OF", _key("region", "n_regionkey")),
        pairs(read("customer"), _key("customer", "c_custkey"), "LOCATED_IN", _key("nation", "c_nationkey")),
        pairs(read("supplier"), _key("supplier", "s_suppkey"), "LOCATED_IN", _key("nation", "s_nationkey")),
        pairs(read("orders"), _key("order", "o_orderkey"), "PLACED_BY", _key("customer", "o_custkey")),
        pairs(lineitem.select("l_orderkey", "l_partkey").distinct(),
              _key("order", "l_orderkey"), "CONTAINS", _key("part", "l_partkey")),
        pairs(lineitem.select("l_partkey", "l_suppkey").distinct(),
              _key("part", "l_partkey"), "SUPPLIED_BY", _key("supplier", "l_suppkey")),
        pairs(documents, _key("dir", "source"), "HAS_CHILD", _key("doc", "doc_id")),
        pairs(linked, _key("bt", F.col("doc_id") % F.col("n_terms")),
              _choose(F.col("lang"), LINK_BY_LANG, F.lit(None).cast("string")), _key("doc", "doc_id")),
        pairs(asked, F.col("related_node_id"), RAISES_QUESTION, F.col("id")),
    ]
    all_edges = reduce(DataFrame.unionAll, edges).withColumn("properties", F.lit("{}"))
    return PropertyGraph(reduce(DataFrame.unionAll, nodes), all_edges)


def snippets(spark: SparkSession, sf_dir: str, files: int = 50) -> DataFrame:
    """Stored vectors as code snippets spread over ``files`` files."""
    return table(spark, sf_dir, "embeddings").select(
        _key("snip", "vec_id").alias("id"),
        _key("doc", F.col("vec_id") % files).alias("codefile_node_id"), "embedding")
