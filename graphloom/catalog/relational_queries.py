"""Lookups, joins, counts, set operations and edits over the projected graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog.registry import Context, query
from graphloom.catalog.sqltext import GRAPH, GRAPH_SYM, NODES
from graphloom.operators import relations, reshape, validation
from graphloom.schema import RAISES_QUESTION
from graphloom.sources import graph_tables

N = "cast(count(*) as bigint)"


@query("label_counts", f"WITH {NODES} SELECT label, {N} AS count FROM nodes "
       "WHERE coalesce(label, '') <> '' GROUP BY label")
def label_counts(c: Context):
    return relations.label_counts(c.graph)


@query("all_labels", f"WITH {NODES} SELECT DISTINCT label FROM nodes WHERE coalesce(label, '') <> ''")
def all_labels(c: Context):
    return relations.labels(c.graph)


@query("graph_stats", f"WITH {GRAPH} SELECT (SELECT {N} FROM nodes) AS node_count, "
       f"(SELECT {N} FROM edges) AS edge_count")
def graph_stats(c: Context):
    return relations.graph_counts(c.graph)


@query("schema_overview", f"WITH {GRAPH} SELECT 'node_label' AS kind, label AS name, {N} AS count FROM nodes "
       f"GROUP BY label UNION ALL SELECT 'edge_type', relationship, {N} FROM edges GROUP BY relationship")
def schema_overview(c: Context):
    return relations.schema_overview(c.graph)


@query("schema_relationships", f"""WITH {GRAPH}
SELECT a.label || ' -[' || e.relationship || ']-> ' || b.label AS pattern, {N} AS count
FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target GROUP BY 1""")
def schema_relationships(c: Context):
    return relations.relationship_patterns(c.graph)


@query("schema_label_detail", f"""WITH {NODES}
SELECT label, {N} AS count, CASE label WHEN 'Region' THEN 'infra_layer,name' WHEN 'CodeFile' THEN 'name,path'
  WHEN 'Question' THEN 'category,question,related_node_id,status' ELSE 'name' END AS fields
FROM nodes GROUP BY label""")
def schema_label_detail(c: Context):
    return relations.label_detail(c.graph).withColumn("fields", F.array_join("fields", ","))


@query("degree", f"WITH {GRAPH_SYM} SELECT a AS id, {N} AS degree FROM sym GROUP BY a")
def degree(c: Context):
    return relations.degrees(c.graph)


@query("node_lookup", f"WITH {NODES} SELECT id, label, name FROM nodes WHERE id = 'nation:7'")
def node_lookup(c: Context):
    return relations.node(c.graph, "nation:7").select("id", "label", "name")


@query("edge_lookup", f"WITH {GRAPH} SELECT source, target, relationship FROM edges WHERE source = 'nation:7' "
       "AND target = (SELECT 'region:' || n_regionkey FROM nation WHERE n_nationkey = 7) "
       "ORDER BY relationship LIMIT 1")
def edge_lookup(c: Context):
    region = c.table("nation").filter("n_nationkey = 7").first()["n_regionkey"]
    return relations.edge(c.graph, "nation:7", f"region:{region}").select("source", "target", "relationship")


@query("existence", f"""WITH {GRAPH} SELECT id, id IN (SELECT id FROM nodes) AS has_node,
  id IN (SELECT source FROM edges) AS has_out_edge, id IN (SELECT target FROM edges) AS has_in_edge
FROM (SELECT DISTINCT source AS id FROM edges UNION SELECT target FROM edges)""")
def existence(c: Context):
    """Node and edge existence for every id any edge names."""
    edges = c.graph.edges
    flags = edges.select(F.inline(F.array(
        F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    known = c.graph.nodes.select("id", F.lit(True).alias("known"))
    return (flags.groupBy("id").agg(F.max("o").alias("o"), F.max("i").alias("i")).join(known, "id", "left")
            .select("id", F.coalesce("known", F.lit(False)).alias("has_node"),
                    (F.col("o") == 1).alias("has_out_edge"), (F.col("i") == 1).alias("has_in_edge")))


@query("search_nodes", f"WITH {NODES} SELECT id, label FROM nodes WHERE lower(id) LIKE '%ring%' OR "
       "lower(label) LIKE '%ring%' OR lower(coalesce(name, '')) LIKE '%ring%' ORDER BY id LIMIT 20")
def search_nodes(c: Context):
    return relations.search_nodes(c.graph, "Ring").select("id", "label")


@query("list_by_label_page", f"""WITH {NODES}, hit AS (SELECT id, name FROM nodes WHERE label = 'Part'
  AND contains(lower(name), 'widget'))
SELECT id, name, (SELECT {N} FROM hit) AS total FROM (SELECT * FROM hit ORDER BY id LIMIT 25 OFFSET 10)""")
def list_by_label_page(c: Context):
    page, total = relations.label_page(c.graph, "Part", F.col("name"), "Widget", limit=25, offset=10)
    return page.select("id", "name", F.lit(1).alias("k")).join(
        total.withColumn("k", F.lit(1)), "k").drop("k")


@query("infra_filter", f"WITH {NODES} SELECT label, {N} AS count FROM nodes "
       "WHERE coalesce(infra_layer, '') <> 'L1' GROUP BY label")
def infra_filter(c: Context):
    return (c.graph.nodes.filter(relations.not_infra(F.col("infra_layer")))
            .groupBy("label").agg(F.count(F.lit(1)).alias("count")))


@query("excluded_labels", f"WITH {NODES} SELECT label, {N} AS count FROM nodes "
       "WHERE label NOT IN ('InBusinessEntity', 'Question') GROUP BY label")
def excluded_labels(c: Context):
    return (relations.without_labels(c.graph.nodes, ["InBusinessEntity", "Question"])
            .groupBy("label").agg(F.count(F.lit(1)).alias("count")))


for direction, condition in (("OUT", "e.source = 'customer:7' AND n.id = e.target"),
                             ("IN", "e.target = 'customer:7' AND n.id = e.source")):
    @query(f"related_{direction.lower()}", f"WITH {GRAPH} SELECT n.id, n.label, e.relationship "
           f"FROM edges e JOIN nodes n ON {condition}")
    def related(c: Context, direction=direction):
        return relations.related_nodes(c.graph, "customer:7", None, direction).select("id", "label", "relationship")


@query("related_both", f"""WITH {GRAPH_SYM}
SELECT n.id, n.label, s.relationship FROM sym s JOIN nodes n ON n.id = s.b
WHERE s.a = 'customer:7' AND s.relationship = 'PLACED_BY'""")
def related_both(c: Context):
    return relations.related_nodes(c.graph, "customer:7", "PLACED_BY", "BOTH").select("id", "label", "relationship")


@query("find_edges_both", f"WITH {GRAPH} SELECT source, target, relationship FROM edges WHERE source = 'part:5' "
       "UNION ALL SELECT source, target, relationship FROM edges WHERE target = 'part:5'")
def find_edges_both(c: Context):
    return relations.find_edges(c.graph, "part:5", "BOTH")


@query("induced_subgraph", f"""WITH {GRAPH}, kept AS (SELECT id FROM nodes WHERE label IN ('Supplier', 'Nation', 'Part'))
SELECT source, target, relationship FROM edges
WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept)""")
def induced_subgraph(c: Context):
    _, edges = relations.visible_subgraph(c.graph.nodes, c.graph.edges, ["Supplier", "Nation", "Part"])
    return edges


@query("dangling_edges", f"""WITH {GRAPH} SELECT source, target, relationship FROM edges
WHERE source NOT IN (SELECT id FROM nodes) OR target NOT IN (SELECT id FROM nodes)""")
def dangling_edges(c: Context):
    return relations.dangling_edges(c.graph)


@query("unvisited_nodes", f"""WITH {GRAPH} SELECT label, {N} AS count FROM nodes
WHERE id NOT IN (SELECT source FROM edges) AND id NOT IN (SELECT target FROM edges) GROUP BY label""")
def unvisited_nodes(c: Context):
    touched = c.graph.symmetric_edges().select(F.col("a").alias("id")).distinct()
    return (c.graph.nodes.join(touched, "id", "left_anti").groupBy("label")
            .agg(F.count(F.lit(1)).alias("count")))


@query("neighbor_union", f"""WITH {GRAPH} SELECT DISTINCT target AS id FROM edges WHERE source = 'customer:7'
UNION SELECT source FROM edges WHERE target = 'customer:7'""")
def neighbor_union(c: Context):
    edges = relations.find_edges(c.graph, "customer:7", "BOTH")
    return (edges.select(F.when(F.col("source") == "customer:7", F.col("target"))
                         .otherwise(F.col("source")).alias("id")).distinct())


@query("edge_dedup", f"""WITH {GRAPH}, twice AS (SELECT * FROM edges UNION ALL SELECT * FROM edges
  WHERE relationship = 'CONTAINS') SELECT relationship, {N} AS count FROM
  (SELECT DISTINCT source, target, relationship FROM twice) GROUP BY relationship""")
def edge_dedup(c: Context):
    edges = c.graph.edges.select("source", "target", "relationship")
    twice = edges.unionAll(edges.filter("relationship = 'CONTAINS'"))
    return (twice.dropDuplicates(["source", "target", "relationship"]).groupBy("relationship")
            .agg(F.count(F.lit(1)).alias("count")))


@query("expand_merge", f"""WITH {GRAPH}
SELECT {N} AS nodes, (SELECT {N} FROM (SELECT DISTINCT source, target FROM edges)) AS edges
FROM (SELECT DISTINCT id FROM nodes)""")
def expand_merge(c: Context):
    """Merging one label's view into the whole graph leaves one row per id and per pair."""
    nodes = c.graph.nodes.select("id", "label", "name")
    edges = c.graph.edges.select("source", "target", "relationship")
    all_nodes, all_edges = relations.merge_views(
        nodes, nodes.filter("label = 'Part'"), edges, edges.filter("relationship = 'SUPPLIED_BY'"))
    return (all_nodes.agg(F.count(F.lit(1)).alias("nodes")).withColumn("k", F.lit(1))
            .join(all_edges.agg(F.count(F.lit(1)).alias("edges")).withColumn("k", F.lit(1)), "k").drop("k"))


@query("names_by_label", f"""WITH {NODES}, ranked AS (SELECT label, id, name, row_number() OVER
  (PARTITION BY label ORDER BY id) AS rn FROM nodes)
SELECT label, coalesce(array_to_string(list(name ORDER BY id) FILTER (rn <= 5 AND name IS NOT NULL), ', '), '') AS names,
  {N} AS total FROM ranked GROUP BY label""")
def names_by_label(c: Context):
    return relations.names_by_label(c.graph.nodes)


# --- guard rules -------------------------------------------------------------

@query("id_validation", r"""SELECT url AS raw_id, CASE WHEN trim(url) = '' THEN 'INVALID_NODE_ID'
  WHEN length(trim(url)) > 256 THEN 'INVALID_NODE_ID'
  WHEN NOT regexp_matches(trim(url), '^[A-Za-z0-9_:\-./\x{4e00}-\x{9fff}]{1,256}$') THEN 'INVALID_NODE_ID'
  END AS error FROM pages""")
def id_validation(c: Context):
    return c.table("pages").select(F.col("url").alias("raw_id"), validation.id_error(F.col("url")).alias("error"))


@query("label_whitelist", f"WITH {NODES} SELECT label, label IN ('BusinessTerm', 'CodeFile', 'Question', "
       "'InBusinessEntity', 'WikiStory', 'Folder', 'Prefab', 'ArchNode', 'LogicNode', 'ConfigField', 'SpecRule', "
       f"'SpecEvidence', 'WikiDoc', 'NarrativeElement', 'Story', 'Doc') AS allowed, {N} AS count FROM nodes GROUP BY 1, 2")
def label_whitelist(c: Context):
    return (c.graph.nodes.select("label", validation.label_error(F.col("label")).isNull().alias("allowed"))
            .groupBy("label", "allowed").agg(F.count(F.lit(1)).alias("count")))


@query("node_quality", """SELECT doc_id, CASE WHEN length(trim(text)) > 5000 THEN 'description too long' END AS problem
FROM documents UNION ALL SELECT item_id, CASE WHEN length(trim(text)) > 200 THEN 'name too long' END FROM benchmark
UNION ALL SELECT event_id, CASE WHEN event_type IN ('click', 'purchase', 'signup', 'view', 'error')
  AND event_type NOT IN ('click') THEN 'invalid status' END FROM events""")
def node_quality(c: Context):
    """First quality problem of documents as node descriptions, benchmark texts as names, events as states."""
    none = F.lit(None).cast("string")
    docs = c.table("documents").select("doc_id", validation.first_problem(
        F.lit("Doc"), none, F.col("text"), none, none, none).alias("problem"))
    terms = c.table("benchmark").select("item_id", validation.first_problem(
        F.lit("BusinessTerm"), F.col("text"), none, none, none, none))
    states = c.table("events").select("event_id", validation.first_problem(
        F.lit("Doc"), F.lit("event"), none, none,
        F.when(F.col("event_type") == "click", F.lit("approved")).otherwise(F.col("event_type")), none))
    return docs.unionAll(terms).unionAll(states)


@query("edge_endpoint_rules", f"""WITH {GRAPH}, rules AS (SELECT * FROM (VALUES
  ('HAS_CHILD', 'Folder', 'CodeFile'), ('HAS_CHILD', 'Folder', 'Doc'), ('IMPLEMENTED_IN', 'BusinessTerm', 'CodeFile')) v(r, s, t)),
joined AS (SELECT e.relationship, a.label AS sl, b.label AS tl FROM edges e
  LEFT JOIN nodes a ON a.id = e.source LEFT JOIN nodes b ON b.id = e.target)
SELECT relationship, CASE WHEN sl IS NULL OR tl IS NULL THEN 'ENDPOINT_NOT_FOUND'
  WHEN sl NOT IN ('Region', 'Nation', 'Customer', 'Supplier', 'Part', 'Order', 'Folder', 'CodeFile', 'Doc', 'WikiStory',
                  'InBusinessEntity', 'BusinessTerm', 'Question') THEN 'INVALID_LABEL'
  WHEN relationship IN (SELECT r FROM rules) AND (relationship, sl, tl) NOT IN (SELECT (r, s, t) FROM rules)
  THEN 'INVALID_RELATIONSHIP_ENDPOINT' END AS error, {N} AS count
FROM joined GROUP BY 1, 2""")
def edge_endpoint_rules(c: Context):
    labels = ["Region", "Nation", "Customer", "Supplier", "Part", "Order", "Folder", "CodeFile", "Doc",
              "WikiStory", "InBusinessEntity", "BusinessTerm", "Question"]
    rules = [("HAS_CHILD", "Folder", "CodeFile"), ("HAS_CHILD", "Folder", "Doc"),
             ("IMPLEMENTED_IN", "BusinessTerm", "CodeFile")]
    checked = validation.endpoint_errors(c.graph.edges, c.graph.nodes, labels, rules)
    return checked.groupBy("relationship", "error").agg(F.count(F.lit(1)).alias("count"))


# --- rewrites ----------------------------------------------------------------

_MERGED = f"""WITH {GRAPH}, kept AS (SELECT source, target, relationship FROM edges
  WHERE source NOT IN ('nation:2', 'nation:3') AND target NOT IN ('nation:2', 'nation:3')),
moved AS (SELECT CASE WHEN source IN ('nation:2', 'nation:3') THEN 'nation:1' ELSE source END AS source,
  CASE WHEN target IN ('nation:2', 'nation:3') THEN 'nation:1' ELSE target END AS target, relationship
  FROM edges WHERE source IN ('nation:2', 'nation:3') OR target IN ('nation:2', 'nation:3'))
"""


@query("merge_nodes_edges", _MERGED + "SELECT source, target, relationship FROM kept UNION "
       "SELECT source, target, relationship FROM moved WHERE source <> target")
def merge_nodes_edges(c: Context):
    merged = reshape.merge_nodes(c.graph.nodes, c.graph.edges, ["nation:2", "nation:3"], "nation:1", True)
    return merged.edges.select("source", "target", "relationship")


@query("merge_counts", _MERGED + f"""SELECT (SELECT {N} FROM moved WHERE source <> target) AS attempts,
  (SELECT {N} FROM (SELECT DISTINCT * FROM moved WHERE source <> target EXCEPT SELECT * FROM kept)) AS inserted""")
def merge_counts(c: Context):
    return reshape.merge_nodes(c.graph.nodes, c.graph.edges, ["nation:2", "nation:3"], "nation:1").redirected


@query("merge_impact", f"""WITH {GRAPH}, w AS (SELECT col0 AS source_id FROM (VALUES ('nation:2'), ('nation:1'), ('nation:99')))
SELECT source_id, n.label AS source_label, n.name AS source_name,
  CASE WHEN n.id IS NULL OR source_id = 'nation:1' THEN 'skip' ELSE 'merge' END AS status,
  CASE WHEN n.id IS NULL OR source_id = 'nation:1' THEN 0 ELSE (SELECT {N} FROM edges WHERE source = source_id) END AS out_edges,
  CASE WHEN n.id IS NULL OR source_id = 'nation:1' THEN 0 ELSE (SELECT {N} FROM edges WHERE target = source_id) END AS in_edges
FROM w LEFT JOIN nodes n ON n.id = source_id""")
def merge_impact(c: Context):
    return reshape.merge_impact(c.graph.nodes, c.graph.edges, ["nation:2", "nation:1", "nation:99"], "nation:1")


@query("delete_cascade", f"WITH {GRAPH} SELECT relationship, {N} AS count FROM edges "
       "WHERE source <> 'nation:1' AND target <> 'nation:1' GROUP BY relationship")
def delete_cascade(c: Context):
    _, edges = graph_tables.delete_node(c.graph.nodes, c.graph.edges, "nation:1")
    return edges.groupBy("relationship").agg(F.count(F.lit(1)).alias("count"))


@query("tree_reparent", f"""WITH {GRAPH} SELECT source, target, relationship FROM edges
  WHERE source <> 'supplier:3' AND target <> 'supplier:3' AND relationship <> 'CONTAINS'
UNION SELECT p.source, k.target, 'SUPPLIED_BY' FROM edges p JOIN edges k ON k.source = p.target
WHERE p.target = 'supplier:3' AND p.relationship = 'SUPPLIED_BY' AND k.relationship = 'SUPPLIED_BY'""")
def tree_reparent(c: Context):
    edges = c.graph.edges.filter("relationship <> 'CONTAINS'")
    _, left = reshape.remove_and_reparent(c.graph.nodes, edges, "supplier:3", "SUPPLIED_BY")
    return left.select("source", "target", "relationship")


@query("tree_reparent_preview", f"""WITH {GRAPH}, loc AS (SELECT source, target, 'IN' AS relationship FROM edges
  WHERE relationship IN ('LOCATED_IN', 'PART_OF'))
SELECT p.source, k.target, 'IN' AS relationship FROM loc p JOIN loc k ON k.source = p.target WHERE p.target = 'nation:4'""")
def tree_reparent_preview(c: Context):
    tree = c.graph.edges.filter("relationship IN ('LOCATED_IN', 'PART_OF')").withColumn("relationship", F.lit("IN"))
    return reshape.reparented_edges(tree, "nation:4", "IN").select("source", "target", "relationship")


@query("tree_insert", f"""WITH {GRAPH}, one AS (SELECT source, target FROM edges WHERE relationship = 'PART_OF' AND source = 'nation:4')
SELECT source, target, relationship FROM edges WHERE relationship = 'PART_OF' AND source <> 'nation:4'
UNION ALL SELECT 'nation:4', 'bloc:1', 'PART_OF' UNION ALL SELECT 'bloc:1', (SELECT target FROM one), 'PART_OF'""")
def tree_insert(c: Context):
    region = c.table("nation").filter("n_nationkey = 4").first()["n_regionkey"]
    new = c.spark.createDataFrame([("bloc:1", "Folder", "Bloc")], "id string, label string, name string")
    _, edges = reshape.insert_between(c.graph.nodes, c.graph.edges, "nation:4", f"region:{region}", "PART_OF", new)
    return edges.filter(F.col("relationship") == "PART_OF").select("source", "target", "relationship")


@query("upsert_nodes", """WITH delta AS (SELECT c_custkey, 'renamed ' || c_name AS name FROM customer WHERE c_acctbal < 0)
SELECT c.c_custkey AS id, coalesce(d.name, c.c_name) AS name FROM customer c LEFT JOIN delta d USING (c_custkey)""")
def upsert_nodes(c: Context):
    base = c.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    delta = c.table("customer").filter("c_acctbal < 0").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("renamed "), "c_name").alias("name"))
    return graph_tables.upsert(base, delta, ["id"])


@query("batch_ingest", f"""SELECT 'order:' || l_orderkey AS source, 'part:' || l_partkey AS target, 'CONTAINS' AS relationship,
  max(l_linenumber) AS last_line FROM lineitem GROUP BY 1, 2""")
def batch_ingest(c: Context):
    """Insert-or-replace of all lineitems as edges: the highest line number of a key is the last write."""
    rows = c.table("lineitem").select(
        F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("source"),
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target"),
        F.lit("CONTAINS").alias("relationship"), F.col("l_linenumber").alias("last_line"))
    return graph_tables.last_write_wins(rows, graph_tables.EDGE_KEY, F.col("last_line"))


@query("questions_of_node", f"""WITH {GRAPH}, s AS (SELECT 'question:' || event_id AS qid,
  CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'approved' WHEN 'purchase' THEN 'completed'
    WHEN 'signup' THEN 'rejected' WHEN 'error' THEN 'failed' END AS status FROM events)
SELECT n.id, s.status FROM edges e JOIN nodes n ON n.id = e.target AND n.label = 'Question' JOIN s ON s.qid = n.id
WHERE e.source = 'customer:7' AND e.relationship = 'RAISES_QUESTION' AND s.status = 'pending'""")
def questions_of_node(c: Context):
    related = relations.related_nodes(c.graph, "customer:7", RAISES_QUESTION, "OUT")
    return (related.filter(F.col("label") == "Question")
            .select("id", F.get_json_object("properties", "$.status").alias("status"))
            .filter(F.col("status") == "pending"))
