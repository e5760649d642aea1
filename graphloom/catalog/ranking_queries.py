"""Composite rankings: default search, code search, index-only pointers, custom expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog.registry import Context, query
from graphloom.catalog.sqltext import GRAPH_SYM, bm25_index, bm25_scores, dense_scores, fused, khop, level_edges, top
from graphloom.catalog.text_queries import GRAPH_QUERY, GRAPH_TOKENS
from graphloom.plans import code_search, default_search, index_only
from graphloom.plans.toolkit import Toolkit
from graphloom.session import materialize

N = "cast(count(*) as bigint)"


def _hits(name: str, top_k: int, label: str = "", files: int = 50) -> str:
    """CTEs ending in ``<name>(id, label, score, rk)``: hybrid retrieval with the late label filter."""
    fetch = top_k * 2
    terms = label == "BusinessTerm"
    dense_source = "dense_terms" if terms else f"{name}_pool"
    pool = "" if terms else f"""
{name}_snip AS (SELECT id, score FROM snip ORDER BY score DESC, id LIMIT {fetch}),
{name}_pool AS (SELECT id, label, max(score) AS score FROM (SELECT id, label, score FROM dense_all UNION ALL
  SELECT s.id, n.label, s.score FROM {name}_snip s JOIN nodes n USING (id)) GROUP BY id, label),"""
    sparse_source = "sparse_terms" if terms else "sparse_all"
    late = f"WHERE label = '{label}'" if label else ""
    return f"""{pool}
{top(dense_source, fetch, name + '_d')},
{top(sparse_source, fetch, name + '_s')},
{fused(name + '_d', name + '_s', name + '_f')},
{top(name + '_f', fetch, name + '_t')},
{name}_l AS (SELECT id, label, score FROM {name}_t {late}),
{name} AS (SELECT id, label, score, row_number() OVER (ORDER BY score DESC, id) AS rk FROM {name}_l QUALIFY rk <= {top_k})"""


def _shared(vec_id: int = 0) -> str:
    snip = """snip AS (SELECT 'doc:' || (vec_id % 50) AS id, max(round(list_dot_product(embedding::double[], q) / qn /
  sqrt(list_dot_product(embedding::double[], embedding::double[])), 9)) AS score FROM embeddings, qv GROUP BY 1)"""
    return f"""WITH {GRAPH_SYM}, {bm25_index()}, {bm25_scores(GRAPH_TOKENS)},
sparse_terms AS (SELECT * FROM sparse_all WHERE label = 'BusinessTerm'),
{dense_scores(vec_id)}, {snip}, dense_terms AS (SELECT * FROM dense_all WHERE label = 'BusinessTerm')"""


_DEFAULT = f"""{_shared()}, {_hits('full_h', 80)}, {_hits('code_h', 40, 'CodeFile')}, {_hits('term_h', 40, 'BusinessTerm')},
sup_seed AS (SELECT id FROM term_h WHERE rk <= 16),
sup_near AS (SELECT DISTINCT t.id AS seed, s.b AS id FROM sup_seed t JOIN sym s ON s.a = t.id WHERE s.b <> t.id
  AND s.b NOT IN (SELECT id FROM nodes WHERE infra_layer = 'L1')),
sup AS (SELECT seed AS id, sum(f.score) AS support FROM sup_near JOIN full_h f USING (id) WHERE f.label = 'InBusinessEntity' GROUP BY seed),
tagged AS (SELECT id, label, score, 0 AS c, 0 AS t FROM full_h UNION ALL SELECT id, label, score, 1, 0 FROM code_h
  UNION ALL SELECT id, label, score, 0, 1 FROM term_h),
cand AS (SELECT id, label, max(score) AS raw_score, max(c) AS c, max(t) AS t FROM tagged
  WHERE label NOT IN ('InBusinessEntity', 'Question') GROUP BY id, label),
sc AS (SELECT cand.*, n.name, CASE WHEN cand.label = 'BusinessTerm' AND (SELECT max(support) FROM sup) > 0
    THEN coalesce(s.support, 0) / (SELECT max(support) FROM sup) ELSE 0.0::double END AS term_support,
  least(1.0::double, raw_score / (SELECT max(score) FROM full_h)) AS base
  FROM cand JOIN nodes n USING (id) LEFT JOIN sup s USING (id)),
reranked AS (SELECT id, label, name, raw_score, term_support, round(greatest(0.0::double, least(1.0::double,
    0.60::double * base + 0.22::double * c + 0.30::double * t + 0.28::double * term_support
    - CASE WHEN label = 'BusinessTerm' AND term_support < 0.12 THEN 0.14::double ELSE 0.0::double END)), 9) AS score FROM sc),
placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, raw_score DESC, name, id) AS place FROM reranked)"""


@query("default_rerank", f"{_DEFAULT} SELECT id, label, round(score, 6) AS score, round(raw_score, 6) AS raw_score, "
       "round(term_support, 6) AS term_support, cast(place as int) AS place FROM placed")
def default_rerank(c: Context):
    rows = default_search.rerank(c.retriever, GRAPH_QUERY, 10, c.vector(0))
    return rows.select("id", "label", F.round("score", 6).alias("score"), F.round("raw_score", 6).alias("raw_score"),
                       F.round("term_support", 6).alias("term_support"), "place")


_RESULTS = f"""{_DEFAULT}, quota AS (SELECT *, label = 'BusinessTerm' AND row_number() OVER (PARTITION BY label = 'BusinessTerm' ORDER BY place) <= 5 AS lead FROM placed),
ranked AS (SELECT *, row_number() OVER (ORDER BY lead DESC, place) AS rank FROM quota QUALIFY rank <= 10)"""


@query("default_results", f"""{_RESULTS} SELECT id, label, cast(rank as int) AS rank, (rank <= 8 OR (label IN ('BusinessTerm', 'WikiStory', 'CodeFile')
  AND score >= greatest(0.28::double, 0.55::double * (SELECT score FROM ranked WHERE rank = 1)))) AS is_core FROM ranked""")
def default_results(c: Context):
    ranked = default_search.order_results(default_search.rerank(c.retriever, GRAPH_QUERY, 10, c.vector(0)), 10)
    return ranked.select("id", "label", "rank", "is_core")


_CENTERS = ["bt:3", "doc:12", "dir:src3"]
_SNAP = f"""WITH {GRAPH_SYM}, {khop(_CENTERS, 2, cap=180)},
sn AS (SELECT l.seed, l.id, n.label, coalesce(n.name, n.id) AS name FROM levels l JOIN nodes n USING (id) WHERE n.label <> 'Question'),
le AS ({level_edges()}),
se AS (SELECT * FROM le WHERE (seed, source) IN (SELECT (seed, id) FROM sn) AND (seed, target) IN (SELECT (seed, id) FROM sn)),
con AS (SELECT seed, source AS id FROM se UNION SELECT seed, target FROM se),
pr AS (SELECT sn.*, CASE WHEN label IN ('WikiStory', 'CodeFile') THEN 2 WHEN label = 'BusinessTerm' THEN 1 ELSE 0 END AS p,
  (sn.seed, sn.id) IN (SELECT (seed, id) FROM con) AS linked FROM sn),
gr AS (SELECT *, CASE WHEN id = seed THEN 0 WHEN linked AND p >= 1 THEN 1 WHEN linked THEN 2 WHEN p >= 1 THEN 3 ELSE 4 END AS g FROM pr),
ff AS (SELECT *, CASE WHEN g = 2 AND label <> 'InBusinessEntity' THEN 1 ELSE 0 END AS f FROM gr),
capd AS (SELECT *, row_number() OVER (PARTITION BY seed, label ORDER BY g, f, p DESC, label <> 'BusinessTerm', name, id) <=
  CASE label WHEN 'CodeFile' THEN 18 WHEN 'WikiStory' THEN 12 WHEN 'BusinessTerm' THEN 8 WHEN 'InBusinessEntity' THEN 10 ELSE 6 END AS fits FROM ff),
tak AS (SELECT *, row_number() OVER (PARTITION BY seed, fits ORDER BY g, f, p DESC, label <> 'BusinessTerm', name, id) AS n FROM capd),
cho AS (SELECT *, fits AND n <= 24 AS chosen FROM tak),
res AS (SELECT *, sum(chosen::int) OVER (PARTITION BY seed) AS kept, count(*) OVER (PARTITION BY seed) AS total,
  row_number() OVER (PARTITION BY seed, chosen ORDER BY p DESC, label <> 'BusinessTerm', name, id) AS r FROM cho),
snap AS (SELECT seed, id, label, name, cast(CASE WHEN chosen THEN n ELSE kept + r END as int) AS place FROM res
  WHERE chosen OR (kept < 8 AND total >= 8 AND kept + r <= 8)),
snap_e AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY source, relationship, target) AS place FROM se
  WHERE (seed, source) IN (SELECT (seed, id) FROM snap) AND (seed, target) IN (SELECT (seed, id) FROM snap) QUALIFY place <= 80)"""


def _snapshots(c: Context) -> default_search.Snapshots:
    return c._once("snapshots", lambda: default_search.snapshots(c.retriever, _CENTERS))


@query("label_caps", f"{_SNAP} SELECT seed, place, id, label FROM snap")
def label_caps(c: Context):
    return _snapshots(c).nodes.select("seed", "place", "id", "label")


@query("snapshot_edges", f"{_SNAP} SELECT seed, cast(place as int) AS place, source, target, relationship FROM snap_e")
def snapshot_edges(c: Context):
    return _snapshots(c).edges.select("seed", "place", "source", "target", "relationship")


@query("snapshot_cards", f"""{_SNAP}, ce AS (SELECT e.*, a.label AS sl, b.label AS tl, (a.name = z.name OR b.name = z.name) AS touch
  FROM snap_e e JOIN snap a ON a.seed = e.seed AND a.id = e.source JOIN snap b ON b.seed = e.seed AND b.id = e.target
  LEFT JOIN snap z ON z.seed = e.seed AND z.id = e.seed),
rk AS (SELECT ce.* EXCLUDE (place), CASE WHEN touch AND 'WikiStory' IN (sl, tl) THEN 0 WHEN touch AND 'CodeFile' IN (sl, tl) THEN 1 WHEN touch THEN 2
  WHEN 'WikiStory' IN (sl, tl) AND 'CodeFile' IN (sl, tl) THEN 3 ELSE 4 END AS rank FROM ce)
SELECT seed, cast(row_number() OVER (PARTITION BY seed ORDER BY rank, relationship, source, target) as int) AS place, source, relationship, target
FROM rk QUALIFY place <= 10""")
def snapshot_cards(c: Context):
    return default_search.cards(_snapshots(c))


@query("code_outline_nodes", f"""{_DEFAULT} SELECT p.id AS code_id, 'record/' || replace(n.path[15:], '\\', '/') AS record_path,
  NULL::varchar AS item_label, NULL::varchar AS item_name, NULL::int AS place FROM (SELECT * FROM placed WHERE label = 'CodeFile' ORDER BY place LIMIT 3) p JOIN nodes n USING (id)""")
def code_outline_nodes(c: Context):
    return default_search.code_outlines(c.retriever, default_search.rerank(c.retriever, GRAPH_QUERY, 10, c.vector(0)))


_TERMS = f"""{_shared()}, {_hits('bt_h', 20, 'BusinessTerm')}, {_hits('en_h', 20, 'InBusinessEntity')},
th AS (SELECT * FROM bt_h UNION ALL SELECT * FROM en_h),
deg AS (SELECT a AS id, {N} AS degree FROM sym GROUP BY a),
q AS (SELECT list_filter(regexp_split_to_array(lower('{GRAPH_QUERY}'), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS t),
tr AS (SELECT th.id, th.label, n.name, th.score, coalesce(d.degree, 0) AS degree, round(least(1.0::double,
    0.45::double * th.score / (SELECT max(score) FROM th)
    + 0.30::double * len(list_filter(q.t, lambda x: contains(lower(n.name || ' '), x)))::double / len(q.t)
    + 0.25::double * least(1.0::double, coalesce(d.degree, 0) / 20.0::double)
    + CASE WHEN th.label = 'BusinessTerm' THEN 0.10::double ELSE 0.0::double END), 9) AS importance
  FROM th JOIN nodes n USING (id) LEFT JOIN deg d USING (id), q),
terms AS (SELECT *, row_number() OVER (ORDER BY importance DESC, degree DESC, score DESC, name, id) AS place FROM tr
  WHERE NOT (label = 'InBusinessEntity' AND degree < 3) AND importance >= 0.25)"""


@query("code_terms", f"{_TERMS} SELECT id, label, degree, round(importance, 6) AS importance FROM terms")
def code_terms(c: Context):
    rows = code_search.rank_terms(c.retriever, GRAPH_QUERY, 10, c.vector(0))
    return rows.select("id", "label", "degree", F.round("importance", 6).alias("importance"))


_ADV = f"""{_shared()}, {_hits('code_h', 120, 'CodeFile')},
q AS (SELECT list_filter(regexp_split_to_array(lower('{GRAPH_QUERY}'), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS t),
items AS (SELECT h.id, n.name, 'record/' || replace(n.path[15:], '\\', '/') AS key, h.score AS raw FROM code_h h JOIN nodes n USING (id)
  WHERE regexp_matches(n.path, '\\.(py|cs|lua)$')),
base AS (SELECT *, raw / (SELECT max(raw) FROM items) AS baseline FROM items)
SELECT cast(row_number() OVER (ORDER BY round(baseline, 9) DESC, baseline DESC, raw DESC, name, id) as int) AS rank, id, key AS path,
  round(round(baseline, 9), 6) AS score,
  round(0.45::double * len(list_filter(q.t, lambda x: contains(lower(name || ' ' || key), x)))::double / len(q.t)
   + 0.55::double * coalesce(b.s, baseline), 6) AS lexical
FROM base LEFT JOIN (SELECT id, score / (SELECT max(score) FROM bm) AS s FROM bm) b USING (id), q QUALIFY rank <= 8"""


@query("code_baseline", _ADV.replace("SELECT cast(row_number()", "SELECT cast(row_number()", 1).replace(
    "base AS (", f"""bm_t AS (SELECT id, label, score, row_number() OVER (ORDER BY score DESC, id) AS rk FROM sparse_all WHERE score > 0 QUALIFY rk <= 160),
bm AS (SELECT id, score FROM bm_t WHERE label = 'CodeFile' ORDER BY score DESC, id LIMIT 80),
base AS (""", 1))
def code_baseline(c: Context):
    """Code files by the plain hybrid baseline, with the lexical part of the full score."""
    options = code_search.CodeOptions(strategy="baseline_hybrid")
    answer = code_search.search(c.retriever, GRAPH_QUERY, options, c.vector(0))
    return answer.files.select("rank", "id", "path", F.round("score", 6).alias("score"), F.round("lexical", 6).alias("lexical"))


_FULL = f"""{_TERMS}, {_hits('code_h', 120, 'CodeFile')},
tok AS (SELECT list_distinct(list_concat((SELECT t FROM q), flatten(list(list_filter(regexp_split_to_array(lower(name), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> ''))))) AS t
  FROM terms WHERE place <= 8),
c0 AS (SELECT id AS seed, id, 0 AS hop, importance FROM terms WHERE place <= 6),
infra AS (SELECT id FROM nodes WHERE infra_layer = 'L1'),
c1 AS (SELECT DISTINCT c.seed, s.b AS id, 1 AS hop, importance FROM c0 c JOIN sym s ON s.a = c.id WHERE s.b <> c.id AND s.b NOT IN (SELECT id FROM infra)),
c01 AS (SELECT * FROM c0 UNION ALL SELECT * FROM c1),
c2 AS (SELECT DISTINCT c.seed, s.b AS id, 2 AS hop, importance FROM c1 c JOIN sym s ON s.a = c.id WHERE s.b NOT IN (SELECT id FROM infra)
  AND NOT EXISTS (SELECT 1 FROM c01 v WHERE v.seed = c.seed AND v.id = s.b)),
call AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hop, id) AS rn FROM (SELECT * FROM c01 UNION ALL SELECT * FROM c2)) WHERE rn <= 260),
comm AS (SELECT c.id, sum(importance) AS support FROM call c JOIN nodes n ON n.id = c.id AND n.label = 'CodeFile' GROUP BY c.id),
w_d AS (SELECT id, label, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rk FROM code_pool WHERE score > 0) WHERE rk <= 160),
dn AS (SELECT id, score FROM w_d WHERE label = 'CodeFile' ORDER BY score DESC, id LIMIT 80),
w_s AS (SELECT id, label, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rk FROM sparse_all) WHERE rk <= 160),
bm AS (SELECT id, score FROM w_s WHERE label = 'CodeFile' ORDER BY score DESC, id LIMIT 80),
items AS (SELECT h.id, n.name, 'record/' || replace(n.path[15:], '\\', '/') AS key, h.score AS raw FROM code_h h JOIN nodes n USING (id)
  WHERE regexp_matches(n.path, '\\.(py|cs|lua)$')),
base AS (SELECT i.*, raw / (SELECT max(raw) FROM items) AS baseline, lower(name || ' ' || key) AS txt FROM items i),
scored AS (SELECT b.*, coalesce(dn.score / (SELECT max(score) FROM dn), baseline) AS semantic,
  0.45::double * len(list_filter(q.t, lambda x: contains(txt, x)))::double / len(q.t) + 0.55::double * coalesce(bm.score / (SELECT max(score) FROM bm), baseline) AS lexical,
  0.18::double * len(list_filter(tok.t, lambda x: contains(txt, x)))::double / len(tok.t) AS intent,
  0.55::double * coalesce(comm.support, 0.0::double) / (SELECT max(support) FROM comm) AS community
  FROM base b LEFT JOIN dn USING (id) LEFT JOIN bm USING (id) LEFT JOIN comm USING (id), q, tok),
adv AS (SELECT *, round(least(1.0::double, 0.82::double * semantic + (1.0::double - 0.82::double) * lexical + intent + community), 9) AS score FROM scored),
fin AS (SELECT *, row_number() OVER (ORDER BY score DESC, baseline DESC, raw DESC, name, id) AS place FROM adv)
SELECT cast(place as int) AS rank, id, key AS path, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS confidence,
  round(score, 6) AS score FROM fin WHERE place <= 8"""
_POOL160 = """snip160 AS (SELECT id, score FROM snip ORDER BY score DESC, id LIMIT 160),
code_pool AS (SELECT id, label, max(score) AS score FROM (SELECT id, label, score FROM dense_all UNION ALL
  SELECT s.id, n.label, s.score FROM snip160 s JOIN nodes n USING (id)) GROUP BY id, label),
w_d AS ("""


@query("code_advanced", _FULL.replace("w_d AS (", _POOL160, 1))
def code_advanced(c: Context):
    """The whole file score: meaning, wording, intent words and term community."""
    options = code_search.CodeOptions(strategy="advanced_rerank")
    answer = code_search.search(c.retriever, GRAPH_QUERY, options, c.vector(0))
    return answer.files.select("rank", "id", "path", "confidence", F.round("score", 6).alias("score"))


_GUARDED = _FULL.replace("w_d AS (", _POOL160, 1)
_GUARDED = _GUARDED[:_GUARDED.index("adv AS (")] + """adv AS (SELECT *, least(1.0::double, 0.82::double * semantic + (1.0::double - 0.82::double) * lexical + intent + community) AS advanced,
  row_number() OVER (ORDER BY raw DESC, name, id) = 1 AS pinned FROM scored),
guarded AS (SELECT *, greatest(advanced, 0.35::double * baseline + (1.0::double - 0.35::double) * advanced) AS guard FROM adv),
fin AS (SELECT *, round(CASE WHEN pinned THEN greatest(guard, baseline) ELSE guard END, 9) AS score FROM guarded),
placed AS (SELECT *, row_number() OVER (ORDER BY pinned DESC, score DESC, baseline DESC, raw DESC, name, id) AS place FROM fin)
SELECT cast(place as int) AS rank, id, key AS path, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS confidence,
  round(score, 6) AS score FROM placed WHERE place <= 8"""


@query("code_rerank", _GUARDED)
def code_rerank(c: Context):
    """The default strategy: the full score held above a share of the baseline, its best file pinned."""
    answer = code_search.search(c.retriever, GRAPH_QUERY, code_search.CodeOptions(), c.vector(0))
    return answer.files.select("rank", "id", "path", "confidence", F.round("score", 6).alias("score"))


@query("index_only", f"""{_shared()}, {_hits('ix', 50)},
conf AS (SELECT ix.id, n.name, ix.label AS node_type, ix.score, least(1.0::double, ix.score / (SELECT max(score) FROM ix)) AS confidence,
  CASE WHEN n.label = 'CodeFile' THEN 'record/' || replace(n.path[15:], '\\', '/') WHEN n.label = 'Folder' THEN 'record/' || n.id[5:] ELSE n.id END AS asset_link
  FROM ix JOIN nodes n USING (id) WHERE ix.label <> 'CodeFile' OR regexp_matches(n.name, '\\.(cs|lua|py|cpp|h|c|js|ts)$')),
kept AS (SELECT * FROM conf ORDER BY score DESC, id LIMIT 10)
SELECT cast(row_number() OVER (ORDER BY confidence DESC, score DESC, name, id) as int) AS rank, name, node_type, asset_link,
  round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.6 THEN 'high' ELSE 'low' END AS confidence_level FROM kept""")
def index_only_pointers(c: Context):
    rows = index_only.index_only(c.retriever, GRAPH_QUERY, 10, vector=c.vector(0))
    return rows.select("rank", "name", "node_type", "asset_link", F.round("confidence", 6).alias("confidence"), "confidence_level")


@query("index_only_lines", f"""{_shared()}, {_hits('ix', 50, 'CodeFile')},
kept AS (SELECT ix.*, n.name, n.path, least(1.0::double, ix.score / (SELECT max(score) FROM ix)) AS confidence FROM ix JOIN nodes n USING (id)
  WHERE regexp_matches(n.name, '\\.(cs|lua|py|cpp|h|c|js|ts)$') ORDER BY ix.score DESC, ix.id LIMIT 10),
placed AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, score DESC, name, id) AS place FROM kept)
SELECT cast(place as int) AS rank, printf('- [rank=%d | score_norm=%.3f | score_raw=%.6f | source=hybrid_index] %s (%s): %s', place, confidence, score,
  name, label, 'record/' || replace(path[15:], '\\', '/')) AS line FROM placed""")
def index_only_lines(c: Context):
    return index_only.format_lines(index_only.index_only(c.retriever, GRAPH_QUERY, 10, node_types=["CodeFile"], vector=c.vector(0)))


@query("custom_expand_nodes", f"""WITH {GRAPH_SYM}, {khop(['bt:3', 'part:7'], 2, cap=180)}
SELECT DISTINCT id, n.label, id IN ('bt:3', 'part:7') AS is_center FROM levels JOIN nodes n USING (id) WHERE n.label <> 'Question'""")
def custom_expand_nodes(c: Context):
    found = Toolkit(c.retriever).lab_custom(GRAPH_QUERY, ["bt:3", "part:7"])
    return found.nodes.select("id", "label", "is_center")


@query("custom_expand_edges", f"""WITH {GRAPH_SYM}, {khop(['bt:3', 'part:7'], 2, cap=180)},
shown AS (SELECT DISTINCT id FROM levels JOIN nodes n USING (id) WHERE n.label <> 'Question')
SELECT DISTINCT source, target, relationship FROM ({level_edges()}) WHERE source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown)""")
def custom_expand_edges(c: Context):
    return Toolkit(c.retriever).lab_custom(GRAPH_QUERY, ["bt:3", "part:7"]).edges


_DEEP = f"""{_shared()}, {_hits('seeds', 5)},
near0 AS (SELECT DISTINCT h.id AS seed, h.rk AS seed_rk, s.b AS id FROM seeds h JOIN sym s ON s.a = h.id
  WHERE s.b <> h.id AND s.b NOT IN (SELECT id FROM nodes WHERE infra_layer = 'L1')),
near AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY id) AS rn FROM near0 QUALIFY rn <= 2 * greatest(3, 15 // (SELECT count(*) FROM seeds)) - 1),
around AS (SELECT id, min(seed_rk) AS place FROM near WHERE id NOT IN (SELECT id FROM seeds) GROUP BY id)"""


@query("deep_retrieve_neighbors", f"{_DEEP} SELECT id, n.label, coalesce(n.name, id) AS name FROM around JOIN nodes n USING (id) ORDER BY place, id LIMIT 20")
def deep_retrieve_neighbors(c: Context):
    result = c.retriever.deep_retrieve(GRAPH_QUERY, 5, vector=c.vector(0))
    return result.neighbors.select("id", "label", "name")


def _ppr_from_seeds(rounds: int = 10, alpha: float = 0.85) -> str:
    """CTEs ending in ``ppr_<rounds>(id, score)`` for the ids of the CTE ``seeds``."""
    ctes = ["deg AS MATERIALIZED (SELECT a, count(*)::double AS d FROM sym GROUP BY a)", "many AS (SELECT count(*)::double AS n FROM seeds)",
            "ppr_0 AS MATERIALIZED (SELECT id, 1.0::double / n AS score FROM seeds, many)"]
    for k in range(1, rounds + 1):
        ctes.append(f"ppr_{k} AS MATERIALIZED (SELECT id, sum(score) AS score FROM (SELECT s.b AS id, {alpha}::double * x.score / d.d AS score FROM ppr_{k - 1} x "
                    f"JOIN sym s ON s.a = x.id JOIN deg d ON d.a = x.id UNION ALL SELECT id, (1 - {alpha}::double) / n FROM seeds, many) GROUP BY id)")
    return ",\n".join(ctes)


@query("deep_retrieve_ranked", f"""{_DEEP}, {_ppr_from_seeds()},
best AS (SELECT id, score FROM ppr_10 ORDER BY round(score, 9) DESC, id LIMIT 40),
found AS (SELECT b.id, n.label, b.score FROM best b JOIN nodes n USING (id) WHERE b.id NOT IN (SELECT id FROM seeds) AND coalesce(n.infra_layer, '') <> 'L1'
  ORDER BY round(b.score, 9) DESC, b.id LIMIT 10)
SELECT id, label, round(score, 6) AS score FROM found WHERE id NOT IN (SELECT id FROM around) ORDER BY round(found.score, 9) DESC, id LIMIT 8""")
def deep_retrieve_ranked(c: Context):
    result = c.retriever.deep_retrieve(GRAPH_QUERY, 5, vector=c.vector(0))
    return materialize(result.ranked, "ranked").select("id", "label", F.round("score", 6).alias("score"))
