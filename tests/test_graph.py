"""Graph operators on small graphs with values worked by hand or re-derived in plain Python."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from graphloom import graph as graph_module
from graphloom.graph import PropertyGraph
from graphloom.operators import neighborhood, pagerank, paths, relations, reshape, sampling, validation
from graphloom.sources import graph_tables

EDGES = [("a", "b", "R"), ("a", "b", "S"), ("b", "c", "R"), ("c", "a", "R"), ("b", "d", "R"), ("d", "e", "R"), ("e", "e", "R")]


def make(spark, edges, infra=(), ids=None):
    ids = ids or sorted({x for s, t, _ in edges for x in (s, t)})
    nodes = spark.createDataFrame(
        [(i, "T", i.upper(), "", "L1" if i in infra else None, "{}") for i in ids],
        "id string, label string, name string, description string, infra_layer string, properties string")
    table = spark.createDataFrame([(s, t, r, "{}") for s, t, r in edges],
                                  "source string, target string, relationship string, properties string")
    return PropertyGraph(nodes, table)


@pytest.fixture(scope="module")
def hand(spark):
    return make(spark, EDGES, infra=("d",))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def edge_set(df):
    return sorted((r["source"], r["target"], r["relationship"]) for r in df.select("source", "target", "relationship").collect())


def test_one_hop_keeps_parallel_edges_and_skips_same_level(hand):
    nodes, edges = neighborhood.neighbors(hand, "a", 1)
    assert ids(nodes) == ["a", "b", "c"]
    assert edge_set(edges) == [("a", "b", "R"), ("a", "b", "S"), ("c", "a", "R")]


def test_two_hops_stop_at_infrastructure(hand):
    nodes, edges = neighborhood.neighbors(hand, "a", 2)
    assert ids(nodes) == ["a", "b", "c"]
    assert ("b", "c", "R") not in edge_set(edges)


def test_three_hops_through_infrastructure_without_self_loop(hand):
    nodes, edges = neighborhood.neighbors(hand, "a", 3, skip_infra=False)
    assert {r["id"]: r["hop"] for r in nodes.collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    assert ("e", "e", "R") not in edge_set(edges)


def test_infrastructure_start_is_exempt(hand):
    assert ids(neighborhood.neighbors(hand, "d", 1)[0]) == ["b", "d", "e"]


def test_cap_counts_start_and_uses_hop_then_id(hand):
    nodes, _ = neighborhood.neighbors(hand, "a", 3, skip_infra=False, max_size=3)
    assert ids(nodes) == ["a", "b", "c"]


def test_shortest_path_ignores_infrastructure(hand):
    assert paths.shortest_path(hand, "a", "e") == ["a", "b", "d", "e"]
    assert paths.shortest_path(hand, "a", "e", max_depth=2) == []
    assert paths.shortest_path(hand, "nowhere", "nowhere") == ["nowhere"]
    assert paths.shortest_path(hand, "a", "nowhere") == []
    nodes, edges = paths.path_detail(hand, "a", "e")
    assert [r["id"] for r in nodes.orderBy("step").collect()] == ["a", "b", "d", "e"]
    assert edges.filter("step = 0").first()["relationship"] == "R"


def _ppr(edges, seeds, alpha=0.85):
    out = defaultdict(list)
    for s, t, _ in edges:
        out[s].append(t)
        out[t].append(s)
    x = {s: 1 / len(seeds) for s in seeds}
    for _ in range(10):
        y = defaultdict(float)
        for s in set(seeds):
            y[s] += (1 - alpha) / len(seeds)
        for u, v in x.items():
            for w in out[u]:
                y[w] += alpha * v / len(out[u])
        x = y
    return x


def test_pagerank_matches_rounds_by_hand(hand):
    for seeds in (["a"], ["a", "e"], ["a", "a", "lonely"]):
        got = {r["id"]: r["score"] for r in pagerank.personalized_pagerank(hand, seeds).collect()}
        want = _ppr(EDGES, seeds)
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_pagerank_expansion_drops_seeds_and_infrastructure(hand):
    assert ids(pagerank.expand_by_rank(hand, ["a"])) == ["b", "c", "e"]


def test_split_hot_nodes_give_the_same_answers(spark, monkeypatch):
    edges = [("hub", f"n{i}", "R") for i in range(60)] + [(f"n{i}", f"n{i + 1}", "S") for i in range(20)]
    plain = {r["id"]: r["score"] for r in pagerank.personalized_pagerank(make(spark, edges), ["n1"]).collect()}
    monkeypatch.setattr(graph_module, "HOT_MINIMUM", 10)
    monkeypatch.setattr(graph_module, "HOT_FRACTION", 8)
    split = make(spark, edges)
    assert split.links.hot.count() == 1
    assert split.links.table.filter("a = 'hub'").select("salt").distinct().count() > 1
    got = {r["id"]: r["score"] for r in pagerank.personalized_pagerank(split, ["n1"]).collect()}
    assert got.keys() == plain.keys() and all(abs(got[k] - plain[k]) < 1e-12 for k in got)
    assert paths.shortest_path(split, "n50", "n20", 4) == ["n50", "hub", "n20"]


def test_random_graphs_against_plain_breadth_first_search(spark):
    rng = random.Random(5)
    for trial in range(3):
        names = [f"v{i:02d}" for i in range(14)]
        edges = sorted({(rng.choice(names), rng.choice(names), rng.choice("RS")) for _ in range(22)})
        infra = tuple(rng.sample(names, 2))
        g = make(spark, edges, infra, names)
        dist, queue, kept = {names[0]: 0}, deque([names[0]]), set()
        for hop in range(3):
            for u in [u for u in dist if dist[u] == hop]:
                for s, t, r in edges:
                    if u in (s, t):
                        v = t if s == u else s
                        if v not in infra and (v not in dist or dist[v] == hop + 1):
                            dist.setdefault(v, hop + 1)
                            if dist[v] == hop + 1:
                                kept.add((s, t, r))
        nodes, found = neighborhood.neighbors(g, names[0], 3, max_size=None)
        assert {r["id"]: r["hop"] for r in nodes.collect()} == dist
        assert set(edge_set(found)) == kept
        del queue


def test_traverse_lists_a_node_once_with_all_edges(spark):
    g = make(spark, [("a", "b", "R"), ("a", "c", "R"), ("b", "d", "R"), ("c", "d", "S"), ("d", "a", "R"), ("d", "x", "T")])
    nodes, edges = neighborhood.traverse(g, "a", ["R", "S"], "OUT", 3)
    assert [(r["hop"], r["id"]) for r in nodes.orderBy("hop", "id").collect()] == [(1, "b"), (1, "c"), (2, "d")]
    assert edge_set(edges.filter("hop = 2")) == [("b", "d", "R"), ("c", "d", "S")]
    assert ids(neighborhood.traverse(g, "d", ["R"], "IN", 1)[0]) == ["b"]
    assert ids(neighborhood.traverse(g, "d", ["R"], "BOTH", 1)[0]) == ["a", "b"]
    assert ids(neighborhood.traverse(g, "a", ["R", "S"], "OUT", 3, max_results=2)[0]) == ["b"]
    with pytest.raises(ValueError):
        neighborhood.traverse(g, "a", ["R"], "SIDEWAYS")


def test_subgraph_puts_seeds_first_and_ignores_unknown_ones(hand):
    nodes, edges = neighborhood.subgraph(hand, ["e", "ghost", "a"], 1, 3)
    assert ids(nodes) == ["a", "b", "e"]
    assert edge_set(edges) == [("a", "b", "R"), ("a", "b", "S")]
    assert neighborhood.subgraph(hand, ["ghost"])[0].isEmpty()


def test_find_edges_and_related_nodes(spark):
    g = make(spark, [("e", "e", "R"), ("e", "f", "R"), ("e", "gone", "R")], ids=["e", "f"])
    assert relations.find_edges(g, "e", "BOTH").count() == 4
    assert ids(relations.related_nodes(g, "e")) == ["e", "f"]
    assert ids(relations.related_nodes(g, "e", None, "BOTH")) == ["e", "e", "f"]
    assert edge_set(relations.dangling_edges(g)) == [("e", "gone", "R")]
    assert relations.has_node(g, "f") and not relations.has_node(g, "gone")
    assert relations.has_edge(g, "e", "f") and not relations.has_edge(g, "e", "f", "S")


def test_merge_keeps_existing_edges_and_drops_inner_ones(spark):
    edges = [("t", "x", "R"), ("s1", "x", "R"), ("s2", "x", "S"), ("s1", "s2", "R"), ("s1", "t", "R"), ("y", "s1", "R"), ("y", "s2", "R")]
    g = make(spark, edges)
    merged = reshape.merge_nodes(g.nodes, g.edges, ["s1", "s2"], "t", True)
    assert edge_set(merged.edges) == [("t", "x", "R"), ("t", "x", "S"), ("y", "t", "R")]
    assert ids(merged.nodes) == ["t", "x", "y"]
    counts = merged.redirected.first()
    assert (counts["attempts"], counts["inserted"]) == (4, 2)


def test_tree_edits(spark):
    g = make(spark, [("p", "n", "C"), ("q", "n", "C"), ("n", "c", "C"), ("n", "d", "C"), ("p", "c", "C"), ("n", "z", "X")])
    nodes, edges = reshape.remove_and_reparent(g.nodes, g.edges, "n", "C")
    assert edge_set(edges) == [("p", "c", "C"), ("p", "d", "C"), ("q", "c", "C"), ("q", "d", "C")]
    assert "n" not in ids(nodes)
    new = spark.createDataFrame([("m", "T", "M")], "id string, label string, name string")
    nodes, edges = reshape.insert_between(g.nodes, g.edges, "p", "n", "C", new)
    assert ("p", "m", "C") in edge_set(edges) and ("m", "n", "C") in edge_set(edges) and ("p", "n", "C") not in edge_set(edges)
    assert "m" in ids(nodes)


def test_random_subgraph_is_sized_connected_and_repeatable(spark, hand):
    nodes, edges = sampling.random_subgraph(hand, 4, seed=3)
    again, _ = sampling.random_subgraph(hand, 4, seed=3)
    assert len(ids(nodes)) == 4 and ids(nodes) == ids(again)
    picked = set(ids(nodes))
    assert all(s in picked and t in picked for s, t, _ in edge_set(edges))
    assert len(ids(sampling.random_subgraph(hand, 50)[0])) == 5


def test_ingest_and_deletes(spark):
    g = make(spark, [("a", "b", "R")])
    new_nodes = spark.createDataFrame([("a", "T", "first", 1), ("a", "T", "second", 2), ("z", "T", "z", 3)],
                                      "id string, label string, name string, seq int")
    new_edges = spark.createDataFrame([("a", "b", "R", "{\"w\":1}", 1)], "source string, target string, relationship string, properties string, seq int")
    done = graph_tables.batch_ingest(g.nodes.select("id", "label", "name"), g.edges, new_nodes, new_edges)
    assert {r["id"]: r["name"] for r in done.nodes.collect()} == {"a": "second", "b": "B", "z": "z"}
    assert [r["properties"] for r in done.edges.collect()] == ["{\"w\":1}"]
    assert (done.nodes_added, done.edges_added) == (3, 1)
    assert graph_tables.delete_edge(g.edges, "a", "b", "S").count() == 1
    assert graph_tables.delete_edge(g.edges, "a", "b").count() == 0
    assert graph_tables.delete_node(g.nodes, g.edges, "a")[1].count() == 0


def test_validation_rules(spark):
    row = spark.createDataFrame([(1,)], "one int")
    first = lambda c: row.select(c.alias("v")).first()["v"]
    assert first(validation.id_error(F.lit("bt:登录/x-1.y"))) is None
    assert first(validation.id_error(F.lit("no spaces"))) == "INVALID_NODE_ID"
    assert first(validation.id_error(F.lit("x" * 257))) == "INVALID_NODE_ID"
    none = F.lit(None).cast("string")
    problem = lambda *a, **k: first(validation.first_problem(*[none if x is None else F.lit(x) for x in a], **k))
    assert problem("Question", None, None, "why", None, None) == "question too short"
    assert problem("Doc", None, None, None, None, None) == "name or description required"
    assert problem("Doc", None, None, None, None, None, creating=False) is None
    assert problem("Doc", "x" * 201, None, None, None, None) == "name too long"
    assert problem("Doc", "x", None, None, "odd", None) == "invalid status"
    assert problem("Doc", "x", None, None, "resolved", "nonsense") == "invalid category"
