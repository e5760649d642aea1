"""Versions of the given tables under edits, and a text index that follows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.catalog.registry import Context, query
from graphloom.catalog.sqltext import bm25_index, bm25_scores
from graphloom.operators.textsegments import SegmentedIndex
from graphloom.session import work_path
from graphloom.sources.edit_log import EditLog, cascade
from graphloom.sources.star_graph import star_graph

COMMITS = 5


def _json(**values: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]))


def _customer(key: str) -> Column:
    return F.concat(F.lit("customer:"), F.col(key).cast("string"))


def _in_parts(log: EditLog, name: str, edits: DataFrame) -> None:
    """Commit edits in a few steps along their sequence numbers."""
    last = edits.agg(F.max("seq")).first()[0] or 0
    for part in range(COMMITS):
        some = (F.col("seq") * COMMITS >= part * (last + 1)) & (F.col("seq") * COMMITS < (part + 1) * (last + 1))
        log.commit({name: edits.filter(some)}, f"part {part}")


@query("edit_log_replay", """WITH e AS (SELECT 'customer:' || o_custkey AS id, o_orderkey AS seq, o_orderpriority AS priority, o_totalprice AS price,
  CASE WHEN o_orderstatus = 'P' THEN 'drop' WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'put' ELSE 'set' END AS op, o_orderstatus AS st FROM orders),
last AS (SELECT id, arg_max(op, seq) AS op, max(seq) AS seq FROM e WHERE op <> 'set' GROUP BY id),
later AS (SELECT e.* FROM e LEFT JOIN last USING (id) WHERE e.op = 'set' AND (last.seq IS NULL OR e.seq > last.seq)),
f AS (SELECT id, arg_max(priority, seq) FILTER (st = 'F') AS priority, max(seq) FILTER (st = 'F') AS latest, arg_max(price, seq) FILTER (st <> 'F') AS price FROM later GROUP BY id),
c AS (SELECT 'customer:' || c_custkey AS id, c_name, c_mktsegment FROM customer)
SELECT id, CASE WHEN op = 'put' THEN 'Buyer' ELSE 'Customer' END AS label, CASE WHEN op = 'put' THEN 'order ' || last.seq ELSE c_name END AS name,
  CASE WHEN op = 'put' THEN NULL ELSE c_mktsegment END AS segment, priority, latest, price
FROM c FULL JOIN last USING (id) LEFT JOIN f USING (id) WHERE op = 'put' OR (op IS NULL AND c_name IS NOT NULL)""")
def edit_log_replay(c: Context):
    """Every order as an edit of its customer's node, committed in parts, deltas merged on the way, then a new base."""
    customers = c.table("customer").select(_customer("c_custkey").alias("id"), F.lit("Customer").alias("label"),
                                           _json(name=F.col("c_name"), segment=F.col("c_mktsegment")).alias("properties"))
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    whole = (status == "O") & (key % 3 == 0)
    edits = c.table("orders").select(
        _customer("o_custkey").alias("id"), F.when(whole, "Buyer").alias("label"),
        F.when(whole, _json(name=F.concat(F.lit("order "), key.cast("string")))).when(status == "F", _json(priority=F.col("o_orderpriority"), latest=key))
        .when(status == "O", _json(price=F.col("o_totalprice"))).alias("properties"),
        F.when(status == "P", "drop").when(whole, "put").otherwise("set").alias("op"), key.alias("seq"))
    log = EditLog(c.spark, work_path(c.spark, "edit-log"), most_deltas=2)
    log.create("customers", nodes=customers, edges=c.graph.edges.limit(0))
    _in_parts(log, "nodes", edits)
    log.compact()
    value = lambda k: F.get_json_object("properties", f"$.{k}").alias(k)
    return log.read("nodes").select("id", "label", value("name"), value("segment"), value("priority"),
                                    value("latest").cast("long").alias("latest"), value("price").cast("double").alias("price"))


@query("edge_log_replay", """WITH e AS (SELECT 'customer:' || user_id AS source, 'type:' || event_type AS target, event_id AS seq, value,
  cast(json_extract_string(props, '$.k') as int) AS k FROM events),
ops AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'drop' WHEN k % 5 = 1 THEN 'put' ELSE 'set' END AS op FROM e),
last AS (SELECT source, target, arg_max(op, seq) AS op, max(seq) AS seq, arg_max(value, seq) AS value FROM ops WHERE op <> 'set' GROUP BY ALL),
later AS (SELECT o.source, o.target, max(o.seq) AS latest FROM ops o LEFT JOIN last l USING (source, target) WHERE o.op = 'set' AND (l.seq IS NULL OR o.seq > l.seq) GROUP BY ALL),
base AS (SELECT DISTINCT 'customer:' || user_id AS source, 'type:' || event_type AS target, 'view' AS kind FROM events WHERE event_type = 'view')
SELECT source, target, 'DID' AS relationship, CASE WHEN op = 'put' THEN NULL ELSE kind END AS kind, CASE WHEN op = 'put' THEN value END AS value, latest
FROM base FULL JOIN last USING (source, target) LEFT JOIN later USING (source, target) WHERE op = 'put' OR (op IS NULL AND kind IS NOT NULL)""")
def edge_log_replay(c: Context):
    """Every event as an edit of the edge between its user and its type."""
    events = c.table("events")
    ends = [_customer("user_id").alias("source"), F.concat(F.lit("type:"), "event_type").alias("target"), F.lit("DID").alias("relationship")]
    base = events.filter("event_type = 'view'").select(*ends, F.lit('{"kind":"view"}').alias("properties")).distinct()
    k = F.get_json_object("props", "$.k").cast("int") % 5
    edits = events.select(*ends, F.when(k == 1, _json(value=F.col("value"))).when(k > 1, _json(latest=F.col("event_id"))).alias("properties"),
                          F.when(k == 0, "drop").when(k == 1, "put").otherwise("set").alias("op"), F.col("event_id").alias("seq"))
    log = EditLog(c.spark, work_path(c.spark, "edit-log"))
    log.create("views", nodes=c.graph.nodes.select("id", "label", "properties").limit(0), edges=base)
    _in_parts(log, "edges", edits)
    value = lambda key, kind: F.get_json_object("properties", f"$.{key}").cast(kind).alias(key)
    return log.read("edges").select("source", "target", "relationship", value("kind", "string"), value("value", "double"), value("latest", "long"))


def _parts_log(c: Context) -> EditLog:
    """Parts and their suppliers: whole, without large parts, with small ones marked, and back to the second version."""
    nodes = c.table("part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("Part").alias("label"),
                                   _json(name=F.col("p_name"), size=F.col("p_size")).alias("properties"))
    supplied = star_graph(c.spark, c.sf_dir).edges.filter("relationship = 'SUPPLIED_BY'")  # of the whole graph only these are read
    log = EditLog(c.spark, work_path(c.spark, "edit-log"))
    log.create("parts", nodes=nodes, edges=supplied)
    edges = log.read("edges")  # as written
    sized = lambda where: c.table("part").filter(where).select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"))
    large = sized("p_size > 40")
    log.commit({"nodes": large.select("id", F.lit("drop").alias("op"), F.lit(1).alias("seq")), "edges": cascade(edges, large)}, "no large parts")
    log.commit({"nodes": sized("p_size < 10 or p_size > 45").select("id", F.lit('{"small":true}').alias("properties"), F.lit("set").alias("op"), F.lit(1).alias("seq"))}, "marked")
    log.rollback(2)
    return log


@query("snapshot_rollback", """WITH e AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
n AS (SELECT count(*) AS all_nodes, count(*) FILTER (p_size <= 40) AS kept, count(*) FILTER (p_size < 10) AS small FROM part),
m AS (SELECT count(*) AS all_edges, count(*) FILTER (p_size IS NULL OR p_size <= 40) AS kept FROM e LEFT JOIN part ON p_partkey = l_partkey)
SELECT v AS version, (['save', 'save', 'save', 'rollback'])[v] AS action, CASE WHEN v = 1 THEN all_nodes ELSE n.kept END AS nodes,
  CASE WHEN v = 1 THEN all_edges ELSE m.kept END AS edges, CASE WHEN v = 3 THEN small ELSE 0 END AS marked FROM (SELECT unnest([1, 2, 3, 4])::int AS v), n, m""")
def snapshot_rollback(c: Context):
    """Each version of the store as it reads now."""
    log, rows = _parts_log(c), None
    for number in range(1, log.head() + 1):
        marked = F.count_if(F.get_json_object("properties", "$.small") == "true").alias("marked")
        row = log.read("nodes", number).agg(F.count(F.lit(1)).alias("nodes"), marked).withColumn("version", F.lit(number))
        row = row.join(log.read("edges", number).agg(F.count(F.lit(1)).alias("edges")).withColumn("version", F.lit(number)), "version")
        rows = row if rows is None else rows.unionByName(row)
    return rows.join(log.manifest.select("version", "action"), "version").select("version", "action", "nodes", "edges", "marked")


@query("snapshot_diff", """SELECT old, new, 'part:' || p_partkey AS id, change FROM part, (VALUES (1, 2, 'removed'), (2, 3, 'changed'), (1, 3, 'removed'), (1, 3, 'changed'),
  (3, 4, 'changed'), (4, 1, 'added')) t(old, new, change)
WHERE CASE WHEN change = 'changed' THEN p_size < 10 ELSE p_size > 40 END""")
def snapshot_diff(c: Context):
    """Nodes that differ between versions, also backwards and over a rollback; versions 2 and 4 do not differ."""
    log, rows = _parts_log(c), None
    for old, new in ((1, 2), (2, 3), (1, 3), (3, 4), (4, 1), (2, 4)):
        some = log.diff("nodes", old, new).select(F.lit(old).alias("old"), F.lit(new).alias("new"), "id", "change")
        rows = some if rows is None else rows.unionByName(some)
    return rows


_TOKENS = ["bo", "erine", "the"]
_EDITED = """SELECT 'doc:' || doc_id AS id, lang AS label, CASE WHEN doc_id % 10 = 3 THEN text || ' ' || source || ' ' || lang ELSE text END AS text FROM documents WHERE doc_id % 10 <> 7
  UNION ALL SELECT 'new:' || item_id, 'added', text FROM benchmark"""


def edited_index(c: Context) -> SegmentedIndex:
    """All documents, then one batch of changed and deleted ones, and one of new ones that also restores a part of the changed ones and changes them again."""
    documents = c.table("documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("label"), "text", "source", "doc_id")
    index = SegmentedIndex(c.spark, work_path(c.spark, "segments"))
    index.create(documents.select("id", "label", "text"))
    changed, gone = documents.filter("doc_id % 10 = 3"), documents.filter("doc_id % 10 = 7")
    draft = changed.select("id", "label", F.concat_ws(" ", F.lit("draft"), "text").alias("text"))
    index.update(changed.unionByName(gone).select("id", "text"), draft)
    final = changed.select("id", "label", F.concat_ws(" ", "text", "source", "label").alias("text"))
    added = c.table("benchmark").select(F.concat(F.lit("new:"), F.col("item_id").cast("string")).alias("id"), F.lit("added").alias("label"), "text")
    index.update(draft.select("id", "text"), final.unionByName(added))
    return index


@query("bm25_after_updates", f"WITH {bm25_index(_EDITED)}, {bm25_scores(_TOKENS)} SELECT id, label, round(score, 6) AS score FROM sparse_all")
def bm25_after_updates(c: Context):
    """All scores of the updated index; they equal those of an index built from the final texts."""
    return edited_index(c).index().scores(" ".join(_TOKENS)).select("id", "label", F.round("score", 6).alias("score"))


@query("terms_after_updates", f"WITH {bm25_index(_EDITED)} SELECT term, cast(df as bigint) AS doc_freq FROM dfreq")
def terms_after_updates(c: Context):
    return edited_index(c).index().terms
