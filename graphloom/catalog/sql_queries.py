"""One query per statement class of the read-only SQL surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog.registry import Context, query
from graphloom.catalog.sqltext import GRAPH
from graphloom.plans.sqlsurface import SqlSurface, readable
from graphloom.sources.star_graph import table


def _surface(c: Context) -> SqlSurface:
    def build() -> SqlSurface:
        vectors = c.table("embeddings")
        snippets = c.snippets.join(vectors.select(F.concat(F.lit("snip:"), F.col("vec_id").cast("string")).alias("id"),
                                                  F.col("label").alias("kind")), "id")
        status = table(c.spark, c.sf_dir, "labels").select(
            F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("codefile_node_id"),
            F.col("quality").alias("snippet_count"), F.when(F.col("toxic") == 1, F.lit("v0")).otherwise(F.lit("v1")).alias("index_version"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 5000).alias("indexed_at"))
        return SqlSurface(c.spark, readable(c.graph.nodes), c.graph.edges, snippets.drop("embedding"), status)

    return c._once("sql", build)


_SNIPPETS = """snippets AS (SELECT 'snip:' || vec_id AS id, 'doc:' || (vec_id % 50) AS codefile_node_id, label AS kind FROM embeddings),
file_index_status AS (SELECT 'doc:' || doc_id AS codefile_node_id, quality AS snippet_count,
  CASE WHEN toxic = 1 THEN 'v0' ELSE 'v1' END AS index_version, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 5000) AS indexed_at FROM labels)"""


def _register(name: str, text: str, db: str = "main", oracle: str | None = None) -> None:
    """The same statement on both sides unless the dialects differ."""
    sources = GRAPH if db == "main" else _SNIPPETS
    body = oracle or text
    head = "WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") and oracle is None else "WITH "
    sql = f"{head}{sources}, {body[len(head):]}" if body.startswith("WITH ") else f"WITH {sources} {body}"

    @query(f"sql_{name}", sql)
    def run(c: Context):
        return _surface(c).query(text, db)


_register("inner_join", """SELECT a.label AS source_label, e.relationship, cast(count(*) AS bigint) AS n FROM edges e
JOIN nodes a ON a.id = e.source GROUP BY a.label, e.relationship""")
_register("left_join", """SELECT n.label, cast(count(e.target) AS bigint) AS out_edges, cast(count(DISTINCT n.id) AS bigint) AS nodes
FROM nodes n LEFT JOIN edges e ON e.source = n.id GROUP BY n.label""")
_register("full_join", """SELECT cast(count(s.codefile_node_id) AS bigint) AS with_snippets, cast(count(f.codefile_node_id) AS bigint) AS with_status
FROM (SELECT DISTINCT codefile_node_id FROM snippets) s FULL JOIN file_index_status f ON f.codefile_node_id = s.codefile_node_id""", "snippets")
_register("right_join", """SELECT f.index_version, cast(count(s.id) AS bigint) AS snippets FROM snippets s
RIGHT JOIN file_index_status f ON f.codefile_node_id = s.codefile_node_id GROUP BY f.index_version""", "snippets")
_register("exists", """SELECT label, cast(count(*) AS bigint) AS n FROM nodes n WHERE EXISTS (SELECT 1 FROM edges e WHERE e.source = n.id)
AND n.id NOT IN (SELECT e.target FROM edges e) GROUP BY label""")
_register("aggregates", """SELECT relationship, cast(count(*) AS bigint) AS n, cast(count(DISTINCT source) AS bigint) AS sources,
min(target) AS first_target, max(target) AS last_target, cast(count(*) FILTER (WHERE source LIKE '%7') AS bigint) AS sevens
FROM edges GROUP BY relationship HAVING count(*) > 20""")
_register("group_concat", """SELECT source, listagg(target, ',') WITHIN GROUP (ORDER BY target) AS targets FROM edges
WHERE relationship = 'PART_OF' GROUP BY source""", oracle="""SELECT source, string_agg(target, ',' ORDER BY target) AS targets FROM edges
WHERE relationship = 'PART_OF' GROUP BY source""")
_register("window_rank", """SELECT label, id, rn, prev FROM (SELECT label, id, cast(row_number() OVER (PARTITION BY label ORDER BY id) AS bigint) AS rn,
lag(id) OVER (PARTITION BY label ORDER BY id) AS prev FROM nodes) WHERE rn <= 3""".replace("nodes) WHERE", "nodes) t WHERE"))
_register("window_frame", """SELECT index_version, snippet_count, cast(sum(n) OVER (PARTITION BY index_version ORDER BY snippet_count
ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) AS running FROM (SELECT index_version, snippet_count, count(*) AS n
FROM file_index_status GROUP BY index_version, snippet_count) t""", "snippets")
_register("set_operations", """SELECT source AS id FROM edges WHERE relationship = 'LOCATED_IN' AND source LIKE 'supplier:%' INTERSECT
SELECT target FROM edges WHERE relationship = 'SUPPLIED_BY' EXCEPT SELECT id FROM nodes WHERE id LIKE '%9'""")
_register("union", """SELECT source AS id FROM edges WHERE relationship = 'PART_OF' UNION SELECT target FROM edges WHERE relationship = 'PART_OF'
UNION ALL SELECT id FROM nodes WHERE label = 'Region'""")
_register("cte", """WITH deg AS (SELECT source, count(*) AS d FROM edges GROUP BY source), top AS (SELECT max(d) AS m FROM deg)
SELECT deg.source, cast(deg.d AS bigint) AS d FROM deg JOIN top ON deg.d = top.m""")
_register("recursive_cte", """WITH RECURSIVE up(id, depth) AS (SELECT 'customer:7', 0 UNION ALL
SELECT e.target, up.depth + 1 FROM up JOIN edges e ON e.source = up.id WHERE e.relationship IN ('LOCATED_IN', 'PART_OF'))
SELECT id, depth FROM up""", oracle="""SELECT 'customer:7' AS id, 0 AS depth UNION ALL
SELECT target, 1 FROM edges WHERE source = 'customer:7' AND relationship = 'LOCATED_IN' UNION ALL
SELECT b.target, 2 FROM edges a JOIN edges b ON b.source = a.target AND b.relationship = 'PART_OF'
WHERE a.source = 'customer:7' AND a.relationship = 'LOCATED_IN'""")
_register("json", """SELECT label, cast(count(json_extract(properties, '$.name')) AS bigint) AS named, max(json_extract(properties, '$.name')) AS last_name
FROM nodes WHERE label IN ('Region', 'Nation', 'Folder', 'Question') GROUP BY label""", oracle="""SELECT label, cast(count(name) AS bigint) AS named, max(name) AS last_name
FROM nodes WHERE label IN ('Region', 'Nation', 'Folder', 'Question') GROUP BY label""")
_register("strings", """SELECT id, upper(name) AS up, substr(name, 1, 3) AS head, instr(name, 'A') AS pos, replace(name, 'A', '_') AS masked,
length(trim(name)) AS len FROM nodes WHERE label = 'Nation' AND lower(name) LIKE '%a%'""", oracle="""SELECT id, upper(name) AS up,
substr(name, 1, 3) AS head, cast(instr(name, 'A') AS int) AS pos, replace(name, 'A', '_') AS masked, cast(length(trim(name)) AS int) AS len
FROM nodes WHERE label = 'Nation' AND lower(name) LIKE '%a%'""")
_register("math", """SELECT label, cast(max(abs(length(id) - 10)) AS int) AS spread, cast(sum(length(id) % 3) AS bigint) AS rest,
round(avg(length(id)), 6) AS mean, max(greatest(length(id), 8)) AS longest FROM nodes GROUP BY label""", oracle="""SELECT label,
cast(max(abs(length(id) - 10)) AS int) AS spread, cast(sum(length(id) % 3) AS bigint) AS rest, round(avg(length(id)), 6) AS mean,
cast(max(greatest(length(id), 8)) AS int) AS longest FROM nodes GROUP BY label""")
_register("case", """SELECT CASE WHEN name IS NULL THEN 'unnamed' WHEN length(name) > 20 THEN 'long' ELSE 'short' END AS kind,
cast(count(*) AS bigint) AS n FROM nodes GROUP BY 1""")
_register("order_limit", """SELECT source, cast(count(*) AS bigint) AS n FROM edges GROUP BY source ORDER BY n DESC, source LIMIT 10 OFFSET 5""")
_register("auto_limit", "SELECT label, cast(count(*) AS bigint) AS n FROM nodes GROUP BY label")


_register("dates", """SELECT strftime('%Y-%m', indexed_at) AS month, min(datetime(indexed_at)) AS first_at, round(max(julianday(indexed_at)), 6) AS last_day,
cast(count(*) AS bigint) AS n FROM file_index_status GROUP BY strftime('%Y-%m', indexed_at)""", "snippets", oracle="""SELECT strftime(indexed_at, '%Y-%m') AS month,
min(strftime(indexed_at, '%Y-%m-%d %H:%M:%S')) AS first_at, round(max(epoch_us(indexed_at) / 86400000000.0::double + 2440587.5::double), 6) AS last_day,
count(*) AS n FROM file_index_status GROUP BY 1""")


@query("sql_table_info", f"""WITH {GRAPH}, n AS (SELECT count(*) AS rows, count(id) AS a, count(label) AS b, count(name) AS c FROM nodes)
SELECT cast(0 AS int) AS cid, 'id' AS name, 'string' AS type, rows - a AS nulls FROM n UNION ALL SELECT 1, 'label', 'string', rows - b FROM n
UNION ALL SELECT 2, 'name', 'string', rows - c FROM n UNION ALL SELECT 3, 'properties', 'string', 0 FROM n""")
def sql_table_info(c: Context):
    """Columns of the nodes view and how many of their values are missing."""
    return _surface(c).query("PRAGMA table_info(nodes)").select("cid", "name", "type", "nulls")


_register("dialect", """SELECT label, total(n) AS total_edges, cast(count(*) FILTER (WHERE id GLOB '*:1?') AS bigint) AS teens FROM
(SELECT n.id, n.label, count(e.target) AS n FROM nodes n LEFT JOIN edges e ON e.source = n.id GROUP BY n.id, n.label) t GROUP BY label""",
          oracle="""SELECT label, sum(n)::double AS total_edges, count(*) FILTER (WHERE id GLOB '*:1?') AS teens FROM
(SELECT n.id, n.label, count(e.target) AS n FROM nodes n LEFT JOIN edges e ON e.source = n.id GROUP BY n.id, n.label) t GROUP BY label""")


@query("sql_limit_bites", f"WITH {GRAPH} SELECT least(count(*), 500) AS shown FROM edges")
def sql_limit_bites(c: Context):
    """The surface shows 500 rows of a longer answer."""
    return _surface(c).query("SELECT source, target FROM edges").agg(F.count("*").alias("shown"))


@query("sql_explain", f"WITH {GRAPH} SELECT count(*) > 0 AS explained FROM nodes")
def sql_explain(c: Context):
    plan = _surface(c).query("EXPLAIN SELECT label, count(*) AS n FROM nodes GROUP BY label")
    return plan.agg(F.max(F.contains("plan", F.lit("HashAggregate"))).alias("explained"))


# Both directions of each edge: the walk runs in cycles.
_register("recursive_union", """WITH RECURSIVE reach(id) AS (SELECT 'region:1' UNION
SELECT e.b FROM reach JOIN (SELECT source AS a, target AS b, relationship FROM edges UNION ALL SELECT target, source, relationship FROM edges) e ON e.a = reach.id
WHERE e.relationship IN ('LOCATED_IN', 'PART_OF')) SELECT split_part(id, ':', 1) AS kind, cast(count(*) AS bigint) AS n FROM reach GROUP BY 1""")


@query("sql_json_each", """WITH q AS (SELECT 'question:' || event_id AS id, 'Review ' || event_type || ' ' || json_extract_string(props, '$.k') AS question,
  (['proposal', 'contradictory', 'untraceable', 'ambiguous', 'wrong_association', 'weak_association'])[(json_extract_string(props, '$.k')::int % 6) + 1] AS category,
  CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'approved' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'rejected' ELSE 'failed' END AS status,
  'customer:' || user_id AS related_node_id FROM events),
m AS (SELECT 'question' AS key, question AS value FROM q UNION ALL SELECT 'category', category FROM q UNION ALL SELECT 'status', status FROM q UNION ALL SELECT 'related_node_id', related_node_id FROM q)
SELECT key, 'text' AS type, count(*) AS n, count(DISTINCT value) AS kinds, max(value) AS last_value FROM m GROUP BY key""")
def sql_json_each(c: Context):
    """Members of all question nodes' JSON, as the surface's dialect lists them."""
    return _surface(c).query("""SELECT j.key, j.type, count(*) AS n, count(DISTINCT j.value) AS kinds, max(j.value) AS last_value
FROM nodes, json_each(nodes.properties) j WHERE nodes.label = 'Question' GROUP BY j.key, j.type""")
