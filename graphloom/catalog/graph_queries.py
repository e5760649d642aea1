"""Traversal, paths, ranking and subgraphs over the whole projected graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog.registry import Context, query
from graphloom.catalog.sqltext import GRAPH, GRAPH_SYM, khop, level_edges, ppr
from graphloom.operators import neighborhood, pagerank, paths, relations, sampling

N = "cast(count(*) as bigint)"
SEEDS = ["nation:1", "part:7", "dir:src3"]


@query("khop_nodes", f"WITH {GRAPH_SYM}, {khop(['nation:1'], 2)} "
       "SELECT l.id, n.label, cast(l.hop as int) AS hop FROM levels l JOIN nodes n USING (id)")
def khop_nodes(c: Context):
    nodes, _ = neighborhood.neighbors(c.graph, "nation:1", 2, max_size=None)
    return nodes.select("id", "label", "hop")


@query("khop_edges", f"WITH {GRAPH_SYM}, {khop(['nation:1'], 2)} "
       f"SELECT source, target, relationship FROM ({level_edges()})")
def khop_edges(c: Context):
    _, edges = neighborhood.neighbors(c.graph, "nation:1", 2, max_size=None)
    return edges


@query("khop_through_hubs", f"WITH {GRAPH_SYM}, {khop(['supplier:3'], 3, skip_infra=False)} "
       f"SELECT cast(l.hop as int) AS hop, n.label, {N} AS count FROM levels l JOIN nodes n USING (id) GROUP BY 1, 2")
def khop_through_hubs(c: Context):
    nodes, _ = neighborhood.neighbors(c.graph, "supplier:3", 3, skip_infra=False, max_size=None)
    return nodes.groupBy("hop", "label").agg(F.count(F.lit(1)).alias("count"))


@query("khop_rel_filtered", f"WITH {GRAPH_SYM}, {khop(['part:7'], 3, relationship='SUPPLIED_BY')} "
       f"SELECT source, target, relationship FROM ({level_edges(relationship='SUPPLIED_BY')})")
def khop_rel_filtered(c: Context):
    _, edges = neighborhood.neighbors(c.graph, "part:7", 3, "SUPPLIED_BY", max_size=None)
    return edges


@query("khop_capped", f"WITH {GRAPH_SYM}, {khop(['nation:1'], 2, cap=200)} "
       "SELECT l.id, n.label, cast(l.hop as int) AS hop FROM levels l JOIN nodes n USING (id)")
def khop_capped(c: Context):
    nodes, _ = neighborhood.neighbors(c.graph, "nation:1", 2)
    return nodes.select("id", "label", "hop")


@query("khop_multi_seed", f"WITH {GRAPH_SYM}, {khop(SEEDS, 2)} "
       f"SELECT seed, cast(hop as int) AS hop, {N} AS count FROM levels GROUP BY 1, 2")
def khop_multi_seed(c: Context):
    levels = neighborhood.neighborhood_levels(c.graph, SEEDS, 2, max_size=None)
    return levels.groupBy("seed", "hop").agg(F.count(F.lit(1)).alias("count"))


_SUB = f"""WITH {GRAPH_SYM}, {khop(SEEDS, 2, cap=20)},
near AS (SELECT id, min(hop) AS hop FROM levels GROUP BY id),
kept AS (SELECT id FROM near ORDER BY CASE id WHEN '{SEEDS[0]}' THEN 0 WHEN '{SEEDS[1]}' THEN 1 WHEN '{SEEDS[2]}' THEN 2 ELSE 3 END, hop, id LIMIT 60)
"""


@query("subgraph_nodes", _SUB + "SELECT id, n.label, coalesce(n.description, '')[1:200] AS description "
       "FROM kept JOIN nodes n USING (id)")
def subgraph_nodes(c: Context):
    nodes, _ = neighborhood.subgraph(c.graph, SEEDS, 2, 60)
    return nodes.select("id", "label", "description")


@query("subgraph_edges", _SUB + f"SELECT DISTINCT source, target, relationship FROM ({level_edges()}) "
       "WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept)")
def subgraph_edges(c: Context):
    _, edges = neighborhood.subgraph(c.graph, SEEDS, 2, 60)
    return edges


def _walk(start: str, rels: list[str], hops: int, direction: str = "OUT") -> str:
    """CTEs for layers ``v<hops>(id, hop)`` and the steps that may be taken, ``steps(a, b, source, target, relationship)``."""
    allowed = ", ".join(f"'{r}'" for r in rels)
    sides = {"OUT": ["source AS a, target AS b"], "IN": ["target AS a, source AS b"], "BOTH": ["source AS a, target AS b", "target AS a, source AS b"]}
    steps = " UNION ALL ".join(f"SELECT {side}, source, target, relationship FROM edges WHERE relationship IN ({allowed})" for side in sides[direction])
    ctes = [f"steps AS MATERIALIZED ({steps})", f"w0 AS (SELECT '{start}' AS id, 0 AS hop)", "v0 AS (SELECT * FROM w0)"]
    for h in range(1, hops + 1):
        ctes.append(f"w{h} AS MATERIALIZED (SELECT DISTINCT s.b AS id, {h} AS hop FROM w{h - 1} w JOIN steps s ON s.a = w.id "
                    f"WHERE s.b NOT IN (SELECT id FROM v{h - 1}))")
        ctes.append(f"v{h} AS MATERIALIZED (SELECT * FROM v{h - 1} UNION ALL SELECT * FROM w{h})")
    return ",\n".join(ctes)


def _layer_edges(hops: int) -> str:
    return (f"SELECT DISTINCT cast(y.hop as int) AS hop, s.source, s.target, s.relationship FROM steps s JOIN v{hops} x ON x.id = s.a "
            f"JOIN (SELECT id AS b, hop FROM v{hops}) y ON y.b = s.b WHERE y.hop = x.hop + 1")


_TYPES = ["CONTAINS", "SUPPLIED_BY", "LOCATED_IN", "PLACED_BY"]


@query("traverse_layers", f"WITH {GRAPH}, {_walk('order:5', _TYPES, 3)} "
       "SELECT cast(hop as int) AS hop, id FROM v3 WHERE hop > 0")
def traverse_layers(c: Context):
    nodes, _ = neighborhood.traverse(c.graph, "order:5", _TYPES, "OUT", 3, max_results=None)
    return nodes


@query("traverse_edges", f"WITH {GRAPH}, {_walk('order:5', _TYPES, 3)} {_layer_edges(3)}")
def traverse_edges(c: Context):
    _, edges = neighborhood.traverse(c.graph, "order:5", _TYPES, "OUT", 3, max_results=None)
    return edges


@query("traverse_in", f"WITH {GRAPH}, {_walk('nation:1', _TYPES, 2, 'IN')} {_layer_edges(2)}")
def traverse_in(c: Context):
    """Everything located in a nation, and what leads to that."""
    _, edges = neighborhood.traverse(c.graph, "nation:1", _TYPES, "IN", 2, max_results=None)
    return edges


@query("traverse_both", f"WITH {GRAPH}, {_walk('part:7', _TYPES, 2, 'BOTH')} {_layer_edges(2)}")
def traverse_both(c: Context):
    _, edges = neighborhood.traverse(c.graph, "part:7", _TYPES, "BOTH", 2, max_results=None)
    return edges


@query("ppr_scores", f"WITH {GRAPH_SYM}, {ppr(['nation:1', 'part:7'])} SELECT id, round(score, 6) AS score FROM ppr_10")
def ppr_scores(c: Context):
    ranks = pagerank.personalized_pagerank(c.graph, ["nation:1", "part:7"])
    return ranks.select("id", F.round("score", 6).alias("score"))


@query("ppr_expand", f"""WITH {GRAPH_SYM}, {ppr(['nation:1', 'part:7'])},
best AS (SELECT id, score FROM ppr_10 ORDER BY round(score, 9) DESC, id LIMIT 80)
SELECT id, n.label, round(score, 6) AS score FROM best b JOIN nodes n USING (id)
WHERE id NOT IN ('nation:1', 'part:7') AND coalesce(n.infra_layer, '') <> 'L1' ORDER BY round(b.score, 9) DESC, id LIMIT 20""")
def ppr_expand(c: Context):
    best = pagerank.expand_by_rank(c.graph, ["nation:1", "part:7"])
    return best.select("id", "label", F.round("score", 6).alias("score"))


@query("shortest_path_hops", f"""WITH {GRAPH_SYM}, {khop(['customer:7'], 4, skip_infra=False)}
SELECT 'supplier:9' AS target, (SELECT cast(hop as int) FROM levels WHERE id = 'supplier:9') AS hops""")
def shortest_path_hops(c: Context):
    path = paths.shortest_path(c.graph, "customer:7", "supplier:9")
    return c.spark.createDataFrame([("supplier:9", len(path) - 1)], "target string, hops int")


@query("shortest_path_edges", f"""WITH {GRAPH_SYM}, {khop(['customer:7'], 1, skip_infra=False)}
SELECT 0 AS step, source, target, relationship FROM edges WHERE source = 'customer:7' AND relationship = 'LOCATED_IN'""")
def shortest_path_edges(c: Context):
    nation = c.table("customer").filter("c_custkey = 7").first()["c_nationkey"]
    _, edges = paths.path_detail(c.graph, "customer:7", f"nation:{nation}")
    return edges


@query("term_support", f"""WITH {GRAPH_SYM}, terms AS (SELECT id FROM nodes WHERE label = 'BusinessTerm')
SELECT t.id, round(sum(length(n.name)::double), 6) AS support FROM terms t JOIN (SELECT DISTINCT a, b FROM sym) s ON s.a = t.id
JOIN nodes n ON n.id = s.b AND n.label = 'InBusinessEntity' GROUP BY t.id""")
def term_support(c: Context):
    """Support of every term from its entity neighbours; the hit score here is the name length."""
    scores = c.graph.nodes.filter(F.col("label") == "InBusinessEntity").select(
        "id", F.length("name").cast("double").alias("score"))
    terms = c.graph.nodes.filter(F.col("label") == "BusinessTerm").select("id")
    return relations.neighbor_score_sum(c.graph, terms, scores).select("id", F.round("support", 6).alias("support"))


@query("community_support", f"""WITH {GRAPH_SYM}, {khop(['bt:0', 'bt:1', 'bt:2'], 2)}
SELECT l.id, cast(sum(CASE seed WHEN 'bt:0' THEN 0.5 WHEN 'bt:1' THEN 0.25 ELSE 0.125 END) as double) AS support
FROM levels l JOIN nodes n USING (id) WHERE n.label = 'CodeFile' GROUP BY l.id""")
def community_support(c: Context):
    weights = {"bt:0": 0.5, "bt:1": 0.25, "bt:2": 0.125}
    return relations.community_support(c.graph, weights, 2, max_size=None)


@query("random_nodes", f"WITH {GRAPH} SELECT id, label FROM nodes WHERE label IN ('Customer', 'Supplier') ORDER BY md5('7:' || id), id LIMIT 50")
def random_nodes(c: Context):
    return sampling.random_nodes(c.graph, 50, ["Customer", "Supplier"], seed=7).select("id", "label")


def _snowball(limit: int, seed: int) -> str:
    """CTEs ending in ``grown(id)``: unrolled rounds in which every sampled node offers one neighbour, or one more node is drawn."""
    ctes = [f"g0 AS MATERIALIZED (SELECT id FROM nodes ORDER BY md5('{seed}:' || id), id LIMIT 1)"]
    for k in range(1, limit + 1):  # a round adds a node at least
        ctes.append(
            f"o{k} AS MATERIALIZED (SELECT DISTINCT id FROM (SELECT a, arg_min(b, md5('{seed + k}:' || a || ':' || b)) AS id FROM sym "
            f"WHERE a IN (SELECT id FROM g{k - 1}) AND b NOT IN (SELECT id FROM g{k - 1}) AND b IN (SELECT id FROM nodes) GROUP BY a))")
        ctes.append(
            f"g{k} AS MATERIALIZED (SELECT id FROM g{k - 1} UNION ALL SELECT id FROM (SELECT id, row_number() OVER (ORDER BY md5('{seed + k}:' || id), id) AS place "
            f"FROM o{k}) WHERE place <= {limit} - (SELECT count(*) FROM g{k - 1}) UNION ALL SELECT id FROM (SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM g{k - 1}) "
            f"ORDER BY md5('{seed + k}:' || id), id LIMIT 1) WHERE (SELECT count(*) FROM o{k}) = 0 AND (SELECT count(*) FROM g{k - 1}) < {limit})")
    return ",\n".join([*ctes, f"grown AS (SELECT id FROM g{limit})"])


@query("random_subgraph", f"WITH {GRAPH_SYM}, {_snowball(40, 11)} SELECT id, label, name FROM nodes WHERE id IN (SELECT id FROM grown)")
def random_subgraph(c: Context):
    nodes, _ = sampling.random_subgraph(c.graph, 40, seed=11)
    return nodes


@query("basic_query_dispatch", f"WITH {GRAPH} SELECT id, label FROM nodes WHERE label = 'Supplier'")
def basic_query_dispatch(c: Context):
    from graphloom.plans.toolkit import basic_query

    return basic_query(c.graph, "find_by_label", {"label": "Supplier"}).select("id", "label")
