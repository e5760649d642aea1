"""Steps whose work once grew faster than their input: their rows, and what they form on the way."""

import time

from pyspark.sql import functions as F

from graphloom.operators import containment


def test_a_long_document_is_tokenised_once(spark, tmp_path):
    from graphloom.operators.textsegments import SegmentedIndex

    words = [f"w{i % 5000}" for i in range(40_000)]
    docs = spark.createDataFrame([("d1", "L", " ".join(words)), ("d2", "L", "w1 w1 w2")], "id string, label string, text string")
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    began = time.time()
    index.create(docs)
    assert time.time() - began < 60  # minutes where every token had the whole text cut again
    got = {(r["term"], r["id"]): (r["tf"], r["doc_len"]) for r in index.index().postings.filter("term in ('w1', 'w2')").collect()}
    assert got == {("w1", "d1"): (8, 40_000), ("w2", "d1"): (8, 40_000), ("w1", "d2"): (2, 3), ("w2", "d2"): (1, 3)}


def test_terms_of_one_name_are_looked_up_once(spark, monkeypatch):
    sizes = {}
    write = containment.materialize

    def counted(df, name="step"):
        made = write(df, name)
        sizes[name] = made.count()
        return made

    monkeypatch.setattr(containment, "materialize", counted)
    docs = spark.createDataFrame([(1, "A blue ring."), (2, "blue rings, bluering"), (3, None), (1, "no BLUE RING")], "doc_id long, text string")
    terms = spark.createDataFrame([(k, ("Blue Ring", "blue ring", "green nut")[k % 3]) for k in range(300)] + [(None, "blue ring")], "term_id long, name string")
    got = sorted((r["doc_id"], r["term_id"]) for r in containment.contained_terms(docs, terms).collect())
    assert got == sorted((d, k) for d in (1, 1, 2) for k in range(300) if k % 3 < 2)
    assert sizes["edge-terms"] == 2 and sizes["word-parts"] < 10


def test_not_in_runs_without_a_broadcast_and_knows_missing_values(spark):
    from graphloom.plans.sqlsurface import SqlSurface

    nodes = spark.createDataFrame([("a", "L"), ("b", "L"), ("c", "M"), (None, "M")], "id string, label string")
    edges = spark.createDataFrame([("a", "b", "R"), ("b", None, "S"), ("a", "it's (", "R")], "source string, target string, relationship string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        surface = SqlSurface(spark, nodes, edges)
        for where in ("n.id NOT IN (SELECT e.target FROM edges e WHERE e.relationship = 'R')", "id NOT IN (SELECT target FROM edges)",
                      "id NOT IN (SELECT target FROM edges WHERE target = 'it''s (')", "n.id NOT IN (SELECT target FROM edges WHERE source = 'none')",
                      "NOT (n.id NOT IN (SELECT target FROM edges))", "n.id NOT IN (SELECT source FROM edges WHERE source NOT IN (SELECT target FROM edges WHERE relationship = 'R')) AND n.label = 'L'",
                      "n.id NOT IN (SELECT e.target FROM edges e WHERE e.source = n.id)"):
            got = surface.query(f"SELECT n.id, n.label FROM nodes n WHERE {where}")
            if "e.source = n.id" not in where:
                assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString(), where
            want = spark.sql(f"SELECT n.id, n.label FROM nodes n WHERE {where}")
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), where
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


class _State:
    """State of one proposal in memory, as the stateful processor sees it; counts its calls."""

    def __init__(self):
        self.values, self.timers, self.calls = {}, set(), 0

    def part(self, name):
        outer = self

        class Part:
            def _call(self):
                outer.calls += 1

            def exists(self):
                self._call()
                return name in outer.values

            def get(self):
                self._call()
                return outer.values[name]

            def update(self, value):
                self._call()
                outer.values[name] = value

            def containsKey(self, k):
                self._call()
                return (name, *k) in outer.values

            def getValue(self, k):
                self._call()
                return outer.values[(name, *k)]

            def updateValue(self, k, value):
                self._call()
                outer.values[(name, *k)] = value

            def removeKey(self, k):
                self._call()
                del outer.values[(name, *k)]

        return Part()

    def getValueState(self, name, *_):
        return self.part(name)

    def getMapState(self, name, *_):
        return self.part(name)

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)


def _drive(batches, watermarks):
    """Changes of a proposal, in the order they come out, and the calls on its state."""
    from types import SimpleNamespace

    from graphloom.streaming.proposals import OrderedStates

    state, processor, out = _State(), OrderedStates(), []
    processor.init(state)
    for rows, until in zip(batches, watermarks):
        times = SimpleNamespace(getCurrentWatermarkInMs=lambda until=until: until)
        processor.handleInputRows(("p",), iter(rows), times)
        for ms in sorted(t for t in state.timers if t <= until):
            state.timers.discard(ms)
            out += processor.handleExpiredTimer(("p",), times, SimpleNamespace(getExpiryTimeInMs=lambda ms=ms: ms))
    return out, state.calls


def test_actions_are_held_by_slots_of_time(monkeypatch):
    import random
    from datetime import datetime, timedelta

    from pyspark.sql import Row

    from graphloom.streaming import proposals

    rng, start, hour = random.Random(4), datetime(2024, 1, 1), 3_600_000
    for size, cap in ((300, 4096), (300, 5), (40, 2)):
        monkeypatch.setattr(proposals, "SLOT_ACTIONS", cap, raising=False)
        base = int((start - datetime(1970, 1, 1)).total_seconds() * 1000)
        moments = [rng.choice([rng.randrange(48 * hour), 900_000 * rng.randrange(100)]) for _ in range(size)]
        rows = [Row(id="p", at=start + timedelta(milliseconds=m), seq=k, micros=(base + m) * 1000,
                    action=rng.choice(["approve", "start", "start", "finish", "fail", "restart"])) for k, m in enumerate(moments)]
        status, since, changes = "pending", None, 0
        for row in sorted(rows, key=lambda r: (r.at, r.seq)):
            ms = row.micros // 1000
            if since is not None and since + proposals.TIMEOUT_MS < ms:
                status, since, changes = "approved", None, changes + 1
            following = proposals.TRANSITIONS.get((status, row.action))
            if following:
                status, changes, since = following, changes + 1, ms if following == "in_progress" else None
        if since is not None:
            status, changes = "approved", changes + 1
        rng.shuffle(rows)
        late = base + 1000 * hour
        # all at once, and with a watermark that passes a part of the actions first
        early = [r for r in rows if r.micros // 1000 <= base + 20 * hour]
        rest = [r for r in rows if r.micros // 1000 > base + 20 * hour]
        for batches, marks in (([rows[::2], rows[1::2], [], []], [0, 0, late, 2 * late]), ([early, rest, [], []], [base + 20 * hour, base + 21 * hour, late, 2 * late])):
            out, calls = _drive(batches, marks)
            assert (out[-1]["status"], out[-1]["changes"]) == (status, changes)
            assert [r["changes"] for r in out] == sorted(r["changes"] for r in out)
            assert cap < 4096 or calls < size / 2  # several for every action before


def _graph(spark, edges, infra=()):
    from graphloom.graph import PropertyGraph

    ids = sorted({x for e in edges for x in e[:2] if x})
    nodes = spark.createDataFrame([(i, "N", i, None, "L1" if i in infra else None) for i in ids], "id string, label string, name string, description string, infra_layer string")
    return PropertyGraph(nodes, spark.createDataFrame(edges, "source string, target string, relationship string"))


def test_a_small_frontier_needs_no_laid_out_links(spark, monkeypatch):
    from graphloom import graph as graph_module
    from graphloom.operators import neighborhood, paths

    edges = [("hub", f"n{i}", "R") for i in range(30)] + [(f"n{i}", f"n{i + 1}", "S") for i in range(10)] + [("n1", "n1", "R"), ("n2", None, "R"), ("n3", "root", "R"), ("root", "far", "R")]
    columns = ["a", "b", "relationship", "forward", "b_infra"]
    found = []
    for small in (100_000, 0):
        monkeypatch.setattr(graph_module, "SMALL_FRONTIER", small, raising=False)
        graph = _graph(spark, edges, infra=("root",))
        levels = sorted(map(str, neighborhood.neighborhood_levels(graph, ["n1", "n9"], 2).collect()))
        layers = sorted(map(str, neighborhood.traverse(graph, "n0", ["S"], "OUT", 3)[1].collect()))
        links = sorted(map(str, graph.follow(spark.createDataFrame([("n1",), ("n2",), ("n3",), (None,)], "a string")).select(columns).collect()))
        found.append((levels, layers, links, paths.shortest_path(graph, "n29", "far", 5)))
        assert ("links" in graph.__dict__) == (small == 0)
    assert found[0] == found[1] and found[0][3] == ["n29", "hub", "n3", "root", "far"]


def test_index_is_written_when_searched_and_shuffles_texts_only(spark, monkeypatch):
    from graphloom.operators import textindex
    from graphloom.plans.retrieve import Retriever
    from graphloom.plans.toolkit import Toolkit

    plans, write = {}, textindex.materialize

    def kept(df, name="step"):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(textindex, "materialize", kept)
    retriever = Retriever.build(_graph(spark, [("red fox", "hen", "R"), ("hen", "owl", "R")]))
    assert "**Nodes:** 3" in Toolkit(retriever).stats_text() and not plans
    assert [r["id"] for r in retriever.bm25("fox", 5).collect()] == ["red fox"]
    assert plans["postings"].count("Exchange") == 1
    docs = spark.createDataFrame([("d", "L", "aa bb aa"), ("d", "L", "aa cc dd"), (None, "L", "aa"), (None, "L", "aa"), ("e", None, None)], "id string, label string, text string")
    index = textindex.TextIndex.build(docs)
    assert sorted(map(str, index.postings.select("term", "id", "tf", "doc_len").collect())) == sorted(map(str, spark.createDataFrame(
        [("aa", "d", 3, 3), ("bb", "d", 1, 3), ("cc", "d", 1, 3), ("dd", "d", 1, 3), ("aa", None, 2, 1)], "term string, id string, tf long, doc_len int").collect()))
    assert index.corpus_size == 5
    empty = spark.range(1000).selectExpr("'q' || id AS id", "'Question' AS label", "if(id % 2 = 0, '', null) AS text")
    mixed = textindex.TextIndex.build(docs.unionByName(empty))
    assert "length(text" in plans["postings"].split("Exchange")[1]  # rows without text were shuffled too before
    assert mixed.corpus_size == 1005 and sorted(map(str, mixed.postings.collect())) == sorted(map(str, index.postings.collect()))


def test_related_terms_are_ranked_without_written_edges(spark, monkeypatch):
    from graphloom import graph as graph_module
    from graphloom.graph import StoredGraph
    from graphloom.plans import code_search
    from graphloom.plans.retrieve import Retriever

    written, path = [], graph_module.work_path
    monkeypatch.setattr(graph_module, "work_path", lambda s, name: written.append(name) or path(s, name))
    tiny = _graph(spark, [("red fox", "hen", "R"), ("red fox", "red fox", "R"), ("hen", "owl", "R"), ("fox", "owl", "R"), ("ant", "bee", "R"), ("cow", "dog", "R")])
    tiny.nodes = tiny.nodes.withColumn("label", F.expr("if(id LIKE '%fox', 'BusinessTerm', 'CodeFile')")).withColumn("path", F.lit(None).cast("string"))
    found = code_search.rank_terms(Retriever.build(StoredGraph(tiny)), "fox", 5)
    assert {r["id"]: r["degree"] for r in found.collect()} == {"red fox": 3, "fox": 1}
    assert "edges" not in written  # all edges were written for the degrees before


def test_a_file_is_cut_into_lines_a_few_times_whatever_its_chunks(spark, monkeypatch):
    from graphloom.operators import chunking

    sizes, write = {}, chunking.materialize if hasattr(chunking, "materialize") else None

    def counted(df, name="step"):
        made = write(df, name)
        sizes[name] = made.count()
        return made

    monkeypatch.setattr(chunking, "materialize", counted, raising=False)
    method = lambda k: [f"  int M{k}(int a)", "  {", *["    a++;"] * 60, "  }"]
    big = ["using System;", "class Big {", *[x for k in range(5) for x in method(k)], "  int last;", "}"]
    files = spark.createDataFrame([("1", "a.cs", "\n".join(big)), ("2", "b.lua", "\n".join(["x = 1"] * 40 + ["function f()", *["  y = 2"] * 30, "end"])),
                                   ("3", "c.txt", "\n".join(["line"] * 300))], "file_id string, path string, code string")
    chunks = chunking.chunk_files(files)
    assert chunks._jdf.queryExecution().optimizedPlan().toString().count("split(code") <= 10  # 58, most for every chunk again, before
    got = {f: [(r["symbol_name"], r["start_line"], r["end_line"]) for r in chunks.filter(f"file_id = '{f}'").orderBy("ordinal").collect()] for f in "123"}
    assert got["1"] == [("a:__header+Big.M0", 1, 65)] + [(f"Big.M{k}", 3 + 63 * k, 65 + 63 * k) for k in range(1, 4)] + [("Big.M4+a:__tail", 255, 319)]
    assert got["2"] == [("b:__header+f", 1, 72)] and got["3"] == [(f"__chunk_{k}", 80 * k - 79, min(80 * k + 20, 300)) for k in range(1, 5)]
    assert sizes["lines"] < 20


def test_proposals_of_a_group_share_their_state_calls():
    from datetime import datetime, timedelta

    from pyspark.sql import Row

    from graphloom.streaming import proposals

    start, base = datetime(2024, 1, 1), 1_704_067_200_000
    acts = ["approve", "start", "finish"]
    rows = [Row(id=f"p{p}" if p else None, at=start + timedelta(minutes=k), seq=k, micros=(base + 60_000 * k) * 1000, action=acts[k])
            for p in range(100) for k in range(3) if p % 2 or k < 2]  # even ones stay in progress until they are reset
    out, calls = _drive([rows[::2], rows[1::2], [], []], [0, 0, base + 600_000, base + 2 * proposals.TIMEOUT_MS])
    last = {r["id"]: (r["status"], r["changes"]) for r in out}
    assert last == {f"p{p}" if p else None: ("completed", 3) if p % 2 else ("approved", 3) for p in range(100)}
    assert calls < 6 * 100  # two to four for every action of each proposal before


def test_ranks_need_no_links_by_name(spark, monkeypatch):
    from graphloom import graph as graph_module
    from graphloom.operators.pagerank import personalized_pagerank

    edges = [("hub", f"n{i}", "R") for i in range(30)] + [("hub", "n1", "S"), ("n1", "n1", "R"), ("n2", None, "R"), (None, "n3", "R"), ("n3", "far", "R")]
    degree, links = {}, []
    for s, t, _ in edges:
        for a, b in ((s, t), (t, s)):
            degree[a] = degree.get(a, 0) + 1
            if a and b:
                links.append((a, b))
    want = {"n1": 0.5, "far": 0.5}
    for _ in range(10):
        fresh = {"n1": 0.075, "far": 0.075}
        for a, b in links:
            if a in want:
                fresh[b] = fresh.get(b, 0.0) + 0.85 * want[a] / degree[a]
        want = fresh
    for hot in (100_000, 4):
        monkeypatch.setattr(graph_module, "HOT_MINIMUM", hot)
        graph = _graph(spark, edges)
        got = {r["id"]: r["score"] for r in personalized_pagerank(graph, ["n1", "far"]).collect()}
        assert (graph.walk.links.hot is None) == (hot > 4) and "links" not in graph.__dict__  # laid out by name first before
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_the_parts_log_reads_supplied_edges_only(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from graphloom.catalog import version_queries

    edges = [("part:1", "supplier:1", "SUPPLIED_BY"), ("part:1", "supplier:2", "SUPPLIED_BY"), ("part:2", "supplier:1", "SUPPLIED_BY"), ("order:1", "part:1", "CONTAINS")]
    tiny = _graph(spark, edges)
    tiny.edges = tiny.edges.selectExpr("*", "'{}' AS properties")
    monkeypatch.setattr(version_queries, "star_graph", lambda *_: tiny, raising=False)
    part = spark.createDataFrame([(1, "a", 50), (2, "b", 5)], "p_partkey long, p_name string, p_size int")
    c = SimpleNamespace(spark=spark, sf_dir=str(tmp_path), table=lambda name: part)  # no graph: it was written whole before
    log = version_queries._parts_log(c)
    assert [(log.read("nodes", v).count(), log.read("edges", v).count()) for v in (1, 2, 3, 4)] == [(2, 3), (1, 1), (1, 1), (1, 1)]


def test_a_small_frontier_needs_no_written_graph(spark, monkeypatch):
    from graphloom import graph as graph_module
    from graphloom.graph import PropertyGraph, StoredGraph
    from graphloom.operators import neighborhood

    pairs = [(1, 7), (1, 7), (1, 8), (2, 7), (3, None), (None, 7)]
    lines = spark.createDataFrame(pairs, "o long, p long").distinct().selectExpr("'order:' || o AS source", "'part:' || p AS target", "'CONTAINS' AS relationship")
    twice = spark.createDataFrame([("part:7", "part:7", "SELF"), ("part:7", "root", "IN"), ("part:7", "root", "IN"), ("root", "far", "IN")], lines.schema)
    tiny = PropertyGraph(_graph(spark, [("order:1", "part:7", "R"), ("root", "far", "R")], infra=("root",)).nodes, lines.unionAll(twice))
    written, path = [], graph_module.work_path
    monkeypatch.setattr(graph_module, "work_path", lambda s, name: written.append(name) or path(s, name))
    monkeypatch.setattr(graph_module, "materialize", lambda df, name: written.append(name) or df)

    graph = StoredGraph(tiny)
    ids = spark.createDataFrame([("part:7",), ("order:1",), ("part:7",), (None,)], "a string")
    near = graph.near(ids)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert all("LeftSemi" in part.split("LogicalRDD")[0] for part in plan.split("Aggregate [")[1:]) and plan.count("Aggregate [") == 2
    columns = ["a", "b", "relationship", "forward"]
    want = tiny.symmetric_edges().filter("a IN ('part:7', 'order:1')").select(columns)
    first = sorted(map(str, near.select(columns).collect()))
    assert first == sorted(map(str, want.collect())) and len(first) == 9
    nodes, edges = neighborhood.traverse(graph, "order:1", ["CONTAINS", "IN"], "OUT", 3, max_results=None)
    assert sorted(map(tuple, nodes.collect())) == [(1, "part:7"), (1, "part:8"), (2, "root"), (3, "far")] and edges.count() == 4
    assert neighborhood.traverse(graph, "none", ["CONTAINS"])[1].dtypes == edges.dtypes
    assert written == ["infra"]  # the whole graph, nodes too, before
    assert graph.nodes.count() == 4 and graph.edges.count() == tiny.edges.count() and graph.edges is graph.edges and written == ["infra", "nodes", "edges"]
    assert sorted(map(str, graph.near(ids).select(columns).collect())) == first


def test_a_rank_round_moves_one_value_for_a_node_that_blocks_share(spark, monkeypatch):
    import random

    from graphloom import linkblocks
    from graphloom.operators.pagerank import personalized_pagerank

    rng = random.Random(3)
    edges = [(f"low{i}", f"hub{rng.randrange(4)}", "R") for i in range(900) for _ in range(3)]
    edges += [(f"hub{rng.randrange(4)}", f"low{i}", "S") for i in range(50)] + [(f"x{rng.randrange(40)}", f"x{rng.randrange(40)}", "T") for _ in range(200)]
    edges += [("low1", "low1", "R"), ("hub1", "hub1", "R"), ("low2", None, "R"), (None, "hub2", "R"), (None, None, "R"), ("hub3", "x1", "R"), ("only", None, "R")]
    degree, links = {}, []
    for s, t, _ in edges:
        for a, b in ((s, t), (t, s)):
            degree[a] = degree.get(a, 0) + 1
            if a and b:
                links.append((a, b))
    seeds = ["low1", "x5", "none", "only"]
    want = {s: 0.25 for s in seeds if s in degree}
    for _ in range(10):
        fresh = {s: 0.15 / 4 for s in seeds if s in degree}
        for a, b in links:
            if a in want:
                fresh[b] = fresh.get(b, 0.0) + 0.85 * want[a] / degree[a]
        want = fresh
    want["none"] = 0.15 / 4
    moved, number, cases = [], linkblocks._number, ((10**9, None), (500, None), (500, 0))
    for least, clash in cases:  # one block, several, and numbers that two ids share at first
        monkeypatch.setattr(linkblocks, "LEAST_ENDS", least)
        monkeypatch.setattr(linkblocks, "_number", lambda seed, c: F.least(number(seed, c), F.lit(0)) if seed == clash else number(seed, c))
        graph = _graph(spark, edges)
        got = {r["id"]: r["score"] for r in personalized_pagerank(graph, seeds).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        sizes = graph.blocks.blocks.selectExpr("other >= 0 AS away", "length(hubs) / 4 AS hubs").filter("away").agg(F.sum("hubs")).first()[0]
        moved.append((graph.blocks.blocks.select("block").distinct().count(), sizes))
    assert moved[0][0] == 1 and moved[1][0] == 8
    assert all(2 * hubs < len(links) / 4 for _, hubs in moved)  # a round moved a row for almost every link before


def test_paths_of_several_pairs_share_their_passes(spark, monkeypatch):
    import random

    from graphloom import graph as graph_module
    from graphloom.graph import StoredGraph
    from graphloom.operators import paths

    rng = random.Random(8)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.choice("RST")) for _ in range(75)] + [("n1", "n1", "R"), ("n2", None, "R"), (None, "n3", "R"), ("lone", "other", "R")]
    near = {}
    for s, t, _ in edges:
        if s and t:
            near.setdefault(s, set()).add(t)
            near.setdefault(t, set()).add(s)

    def hops(source, target):
        level, seen = {source}, {source}
        for depth in range(7):
            if target in level:
                return depth
            level = {b for a in level for b in near.get(a, ())} - seen
            seen |= level

    pairs = [("n1", f"n{k}") for k in range(1, 12)] + [("n4", "n1"), ("n1", "lone"), ("n1", "missing"), ("missing", "missing")]
    written, path, passes = [], graph_module.work_path, []
    monkeypatch.setattr(graph_module, "work_path", lambda s, name: written.append(name) or path(s, name))
    graph, follow = StoredGraph(_graph(spark, edges)), graph_module.PropertyGraph.follow
    monkeypatch.setattr(graph_module.PropertyGraph, "follow", lambda self, *a, **k: passes.append(1) or follow(self, *a, **k))
    found = paths.path_details(graph, pairs, 6)
    assert len(passes) <= 6 and not written  # some passes for every pair, and the whole graph was written, before
    for (source, target), (nodes, links) in zip(pairs, found):
        far = hops(source, target)
        if far is None or source == "missing":
            assert not nodes and not links
            continue
        ids = [r["id"] for r in nodes]
        assert (ids[0], ids[-1], len(ids)) == (source, target, far + 1) and [r["step"] for r in nodes] == list(range(far + 1))
        for a, b, link in zip(ids, ids[1:], links, strict=False):
            assert (link["relationship"], link["source"], link["target"]) == min((r, s, t) for s, t, r in edges if {s, t} == {a, b})
        if target == "n4":
            one = paths.path_detail(graph, source, target, 6)
            assert [tuple(r) for r in one[0].orderBy("step").collect()] == [tuple(r)[1:] for r in nodes]
            assert [tuple(r) for r in one[1].orderBy("step").collect()] == [tuple(r)[1:] for r in links]


def test_a_deep_search_reads_its_links_in_few_passes(spark, monkeypatch):
    from graphloom import graph as graph_module
    from graphloom.graph import StoredGraph
    from graphloom.plans.retrieve import Retriever

    edges = [(f"fox {k}", f"den {k % 2}", "R") for k in range(5)] + [("den 0", "wood", "IN"), ("den 1", "wood", "IN"), ("wood", "land", "IN")]
    passes, follow = [], graph_module.PropertyGraph.follow
    monkeypatch.setattr(graph_module.PropertyGraph, "follow", lambda self, *a, **k: passes.append(1) or follow(self, *a, **k))
    tiny = StoredGraph(_graph(spark, edges))
    retriever = Retriever.build(tiny)
    assert tiny._nodes.made is None  # written for every retriever before, whatever was asked of it
    found = retriever.deep_retrieve("fox", 5, "bm25")
    assert [[n["id"] for n in nodes] for nodes, _ in found.paths] == [
        ["fox 0", "den 0", "wood", "den 1", "fox 1"], ["fox 1", "den 1", "wood", "den 0", "fox 2"], ["fox 2", "den 0", "wood", "den 1", "fox 3"]]
    assert sorted(r["id"] for r in found.neighbors.collect()) == ["den 0", "den 1"]
    assert sorted(r["id"] for r in found.ranked.collect()) == ["land", "wood"]
    assert len(passes) <= 5 and not {"links", "walk"} & set(tiny.__dict__)  # two for the neighbours, three for all paths; four a path before
