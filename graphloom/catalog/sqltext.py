"""SQL of the shared inputs: the projected graph, postings, vectors."""

NODES = r"""
nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'Region' AS label, r_name AS name, NULL AS description,
         NULL AS path, 'L1' AS infra_layer FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'Customer', c_name, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier', s_name, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'Part', p_name, NULL, NULL, NULL FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'Order', o_orderpriority, NULL, NULL, NULL FROM orders
  UNION ALL SELECT 'page:' || page_id, 'WikiDoc', url, NULL, NULL, NULL FROM pages
  UNION ALL SELECT DISTINCT 'dir:' || source, 'Folder', source, NULL, NULL, NULL FROM documents
  UNION ALL SELECT 'doc:' || doc_id,
         CASE lang WHEN 'en' THEN 'CodeFile' WHEN 'fr' THEN 'InBusinessEntity'
                   WHEN 'de' THEN 'WikiStory' ELSE 'Doc' END,
         source || '_' || doc_id || (['.lua', '.cs', '.py', '.json'])[(doc_id % 4 + 1)::int],
         text,
         CASE WHEN lang = 'en' THEN 'C:\Git\record\' || source || '\' || source || '_' || doc_id ||
              (['.lua', '.cs', '.py', '.json'])[(doc_id % 4 + 1)::int] END,
         NULL FROM documents
  UNION ALL SELECT 'bt:' || item_id, 'BusinessTerm', text, NULL, NULL, NULL FROM benchmark
  UNION ALL SELECT 'question:' || event_id, 'Question', NULL, NULL, NULL, NULL FROM events
)"""

EDGES = r"""
edges AS (
  SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target,
         'PART_OF' AS relationship FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'LOCATED_IN' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'LOCATED_IN' FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'PLACED_BY' FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'CONTAINS' FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'SUPPLIED_BY' FROM lineitem
  UNION ALL SELECT 'dir:' || source, 'doc:' || doc_id, 'HAS_CHILD' FROM documents
  UNION ALL SELECT 'bt:' || (doc_id % (SELECT count(*) FROM benchmark)),
         'doc:' || doc_id,
         CASE lang WHEN 'en' THEN 'IMPLEMENTED_IN' WHEN 'fr' THEN 'HAS_ENTITY' ELSE 'TOLD_IN' END
         FROM documents WHERE lang IN ('en', 'fr', 'de')
  UNION ALL SELECT 'customer:' || user_id, 'question:' || event_id, 'RAISES_QUESTION' FROM events
)"""

SYM = r"""
sym AS (SELECT source AS a, target AS b, relationship FROM edges
        UNION ALL SELECT target, source, relationship FROM edges)"""

GRAPH = NODES + "," + EDGES
GRAPH_SYM = GRAPH + "," + SYM


def khop(seeds: list[str], hops: int, relationship: str | None = None, skip_infra: bool = True,
         cap: int | None = None, name: str = "levels") -> str:
    """CTEs ending in ``<name>(seed, id, hop)`` by unrolled breadth-first search."""
    rel = f"AND s.relationship = '{relationship}'" if relationship else ""
    infra = ("AND s.b NOT IN (SELECT id FROM nodes WHERE infra_layer = 'L1')" if skip_infra else "")
    rows = ", ".join(f"('{s}')" for s in seeds)
    ctes = [f"{name}_0 AS MATERIALIZED (SELECT DISTINCT col0 AS seed, col0 AS id, 0 AS hop FROM (VALUES {rows}))"]
    for h in range(1, hops + 1):
        seen = f"{name}_s{h - 1}" if h > 1 else f"{name}_0"
        ctes.append(
            f"{name}_{h} AS MATERIALIZED (SELECT DISTINCT f.seed, s.b AS id, {h} AS hop FROM {name}_{h - 1} f "
            f"JOIN sym s ON s.a = f.id {rel} {infra} WHERE NOT EXISTS "
            f"(SELECT 1 FROM {seen} v WHERE v.seed = f.seed AND v.id = s.b))")
        ctes.append(f"{name}_s{h} AS MATERIALIZED (SELECT * FROM {seen} UNION ALL SELECT * FROM {name}_{h})")
    last = f"{name}_s{hops}" if hops else f"{name}_0"
    if cap is None:
        ctes.append(f"{name} AS MATERIALIZED (SELECT * FROM {last})")
    else:
        ctes.append(
            f"{name} AS MATERIALIZED (SELECT seed, id, hop FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY seed ORDER BY hop, id) AS rn FROM {last}) WHERE rn <= {cap})")
    return ",\n".join(ctes)


def level_edges(name: str = "levels", relationship: str | None = None) -> str:
    """Edges between consecutive levels; each join has two inputs, so that no plan can pair the levels with each other first."""
    rel = f"WHERE e.relationship = '{relationship}'" if relationship else ""
    return (f"WITH outs AS MATERIALIZED (SELECT x.seed, x.hop, e.source, e.target, e.relationship FROM edges e JOIN {name} x ON x.id = e.source {rel}), "
            f"ends AS MATERIALIZED (SELECT seed || '|' || id AS place, hop AS th FROM {name}) "
            "SELECT seed, source, target, relationship FROM outs JOIN ends ON place = seed || '|' || target WHERE abs(hop - th) = 1")


def ppr(seeds: list[str], rounds: int = 10, alpha: float = 0.85) -> str:
    """CTEs ending in ``ppr_<rounds>(id, score)``."""
    n = len(seeds)
    rows = ", ".join(f"('{s}')" for s in dict.fromkeys(seeds))
    ctes = ["deg AS (SELECT a, count(*)::double AS d FROM sym GROUP BY a)",
            f"seeds AS (SELECT col0 AS id FROM (VALUES {rows}))",
            f"ppr_0 AS (SELECT id, 1.0::double / {n} AS score FROM seeds)"]
    for i in range(1, rounds + 1):
        ctes.append(
            f"ppr_{i} AS (SELECT id, sum(score) AS score FROM (SELECT s.b AS id, "
            f"{alpha}::double * x.score / d.d AS score FROM ppr_{i - 1} x JOIN sym s ON s.a = x.id "
            f"JOIN deg d ON d.a = x.id UNION ALL SELECT id, (1 - {alpha}::double) / {n} FROM seeds) GROUP BY id)")
    return ",\n".join(ctes)


def bm25_index(documents: str = "SELECT id, label, concat_ws(' ', nullif(name, ''), nullif(description, '')) AS text FROM nodes") -> str:
    """CTEs ending in ``weights(term, id, label, weight)`` for every term of ``documents(id, label, text)``."""
    return rf"""
texts AS ({documents}),
toks AS (SELECT id, label, regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}]{{2,}}') AS t FROM texts),
tf AS (SELECT id, label, len(t) AS dl, term, count(*)::double AS f
       FROM (SELECT id, label, t, unnest(t) AS term FROM toks) GROUP BY ALL),
tf2 AS (SELECT id, label, dl::double AS dl, term, f FROM tf),
dfreq AS (SELECT term, count(*)::double AS df FROM tf2 GROUP BY term),
corpus AS (SELECT count(*)::double AS n, sum(len(t))::double / count(*) AS avgdl FROM toks),
idf0 AS (SELECT term, df, ln(n - df + 0.5::double) - ln(df + 0.5::double) AS raw FROM dfreq, corpus),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::double * (SELECT avg(raw) FROM idf0) ELSE raw END AS idf FROM idf0),
weights AS (SELECT tf2.term, id, label, idf * f * 2.5::double / (f + 1.5::double * (0.25::double + 0.75::double * dl / avgdl)) AS weight
            FROM tf2 JOIN idf USING (term), corpus)"""


def bm25_scores(tokens: list[str], label: str | None = None, name: str = "sparse_all") -> str:
    rows = ", ".join(f"('{t}')" for t in tokens)
    where = f"WHERE label = '{label}'" if label else ""
    return (f"{name} AS (SELECT id, label, round(sum(weight), 9) AS score FROM weights JOIN (SELECT col0 AS term FROM "
            f"(VALUES {rows})) q USING (term) {where} GROUP BY id, label HAVING sum(weight) > 0)")


def top(source: str, k: int, name: str) -> str:
    return (f"{name} AS (SELECT id, label, score, row_number() OVER (ORDER BY score DESC, id) AS rk FROM {source} "
            f"WHERE score > 0 QUALIFY rk <= {k})")


def dense_scores(vec_id: int, with_snippets: int | None = None, files: int = 50) -> str:
    """CTE ``dense_all(id, label, score)``: cosine of node vectors, pooled with the best snippet files."""
    base = f"""
vecs AS (SELECT 'doc:' || doc_id AS id, embedding::double[] AS v FROM documents JOIN embeddings ON vec_id = doc_id
         UNION ALL SELECT 'bt:' || item_id, embedding::double[] FROM benchmark JOIN embeddings ON vec_id = item_id),
qv AS (SELECT embedding::double[] AS q, sqrt(list_dot_product(embedding::double[], embedding::double[])) AS qn
       FROM embeddings WHERE vec_id = {vec_id}),
cosines AS (SELECT id, round(list_dot_product(v, q) / qn / sqrt(list_dot_product(v, v)), 9) AS score FROM vecs, qv)"""
    if with_snippets is None:
        return base + ",\ndense_all AS (SELECT c.id, n.label, c.score FROM cosines c JOIN nodes n USING (id))"
    return base + f""",
snip AS (SELECT 'doc:' || (vec_id % {files}) AS id, max(round(list_dot_product(embedding::double[], q) / qn /
         sqrt(list_dot_product(embedding::double[], embedding::double[])), 9)) AS score FROM embeddings, qv GROUP BY 1),
snip_top AS (SELECT id, score FROM snip ORDER BY score DESC, id LIMIT {with_snippets}),
dense_all AS (SELECT id, label, max(score) AS score FROM (SELECT * FROM cosines UNION ALL SELECT * FROM snip_top)
              JOIN nodes USING (id) GROUP BY id, label)"""


def fused(dense: str, sparse: str, name: str) -> str:
    return (f"{name} AS (SELECT id, label, sum(1.0::double / (60 + rk)) AS score FROM "
            f"(SELECT id, label, rk FROM {dense} UNION ALL SELECT id, label, rk FROM {sparse}) GROUP BY id, label)")
