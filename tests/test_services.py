"""Workflow, editing, versions, SQL guard, settings, file sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.config import Settings, deep_merge
from graphloom.functions import jsonprops, messages
from graphloom.operators import relations
from graphloom.plans import workflow
from graphloom.plans.editing import Editor
from graphloom.plans.sqlsurface import Refused, SqlSurface
from graphloom.plans.versions import VersionStore
from graphloom.sources import build_report, codefiles, graph_tables
from graphloom.streaming import proposals


@pytest.fixture
def editor(spark, tmp_path):
    nodes = spark.createDataFrame([
        ("bt:1", "BusinessTerm", '{"name":"One","_embedding":[1.0]}'), ("file:1", "CodeFile", '{"name":"f.lua","id":"fake"}'),
        ("q:1", "Question", '{"question":"why?","status":"pending","category":"general"}')], "id string, label string, properties string")
    edges = spark.createDataFrame([("bt:1", "file:1", "IMPLEMENTED_IN", "{}")], "source string, target string, relationship string, properties string")
    return Editor(nodes, edges, store=VersionStore(spark, str(tmp_path / "store")))


def test_node_edits(editor):
    assert editor.node("get", "file:1").data["node"] == {"name": "f.lua", "id": "file:1", "label": "CodeFile"}
    assert "_embedding" not in editor.node("get", "bt:1").data["node"]
    assert editor.node("get", "missing").code == "NOT_FOUND"
    assert editor.node("create", "bad id", "Doc", {"name": "x"}).code == "INVALID_NODE_ID"
    assert editor.node("create", "doc:1", "Nope", {"name": "x"}).code == "INVALID_LABEL"
    assert editor.node("create", "doc:1", "Doc", {}).code == "LOW_QUALITY_PAYLOAD"
    preview = editor.node("create", "doc:1", "Doc", {"name": "x"}, dry_run=True)
    assert preview.ok and not preview.data["preview"]["replaces"] and editor.nodes.count() == 3
    assert editor.node("create", "doc:1", "Doc", {"name": "x", "tags": [1, 2]}).ok and editor.nodes.count() == 4
    assert editor.node("update", "doc:1", properties={"name": "y"}).ok
    assert editor.node("get", "doc:1").data["node"]["name"] == "y" and editor.node("get", "doc:1").data["node"]["tags"] == [1, 2]
    assert editor.node("update", "doc:9", properties={"name": "y"}).status == 404
    assert editor.node("list_by_label", label="Doc", key="name", value="Y").data["total"] == 1
    assert editor.node("delete", "bt:1").data["removed_edges"] == 1 and editor.edges.count() == 0
    assert editor.node("explode").code == "UNKNOWN_ACTION"


def test_edge_edits_and_confirm_token(spark, editor):
    assert editor.edge("create", "bt:1", "ghost", "HAS_CHILD").code == "ENDPOINT_NOT_FOUND"
    assert editor.edge("create", "bt:1", "file:1", "LIKES").code == "INVALID_RELATIONSHIP"
    assert editor.edge("create", "bt:1", "file:1", "HAS_CHILD", {"w": 1}).ok
    assert editor.edge("list", node_id="bt:1").data["total"] == 2
    assert editor.edge("get", "bt:1", "file:1").data["edge"]["relationship"] == "HAS_CHILD"
    guarded = Editor(editor.nodes, editor.edges, Settings(require_confirm_token=True, confirm_token="yes"))
    assert guarded.edge("delete", "bt:1", "file:1", "HAS_CHILD").code == "CONFIRM_REQUIRED"
    assert guarded.edge("delete", "bt:1", "file:1", "HAS_CHILD", token="yes").ok and guarded.edges.count() == 1
    assert guarded.merge(["file:1"], "bt:1", dry_run=True).data["preview"]["redirected"] == 1
    assert guarded.tree("remove_and_reparent", "NOPE", "bt:1").code == "INVALID_RELATIONSHIP"
    ruled = Editor(editor.nodes, editor.edges, Settings(enforce_endpoint_rules=True),
                   endpoint_rules=[("HAS_CHILD", "Folder", "CodeFile")])
    assert ruled.edge("create", "bt:1", "file:1", "HAS_CHILD").code == "INVALID_RELATIONSHIP_ENDPOINT"
    assert editor.apply("enrich_logic", "bt:1", description="abc").code == "LOW_QUALITY_PAYLOAD"
    assert editor.apply("enrich_logic", "bt:1", description="long enough").ok


def test_questions_and_versions(editor):
    assert editor.questions("resolve", "q:1", "x").code == "LOW_QUALITY_PAYLOAD"
    assert editor.version("save", message="start").data["snapshot"]["snapshot_id"] == 1
    assert editor.questions("list").data["total"] == 1
    assert editor.questions("resolve", "q:1", "because").ok and editor.questions("list").data["total"] == 0
    assert editor.questions("list", category="odd").code == "INVALID_CATEGORY"
    assert editor.version("rollback", snapshot_id=9).status == 404
    assert editor.version("rollback", snapshot_id=1).ok
    assert editor.questions("list").data["total"] == 1
    items = editor.version("list").data["items"]
    assert [i["snapshot_id"] for i in items] == [2, 1] and items[0]["message"].startswith("[auto-save")
    assert editor.version("search", keyword="START").data["items"][0]["snapshot_id"] == 1
    assert json.loads(editor.store.graph(2).nodes.filter("id = 'q:1'").first()["properties"])["status"] == "resolved"
    assert editor.store.graph().nodes.filter("id = 'q:1'").select(F.get_json_object("properties", "$.status")).first()[0] == "pending"


def test_stored_graph_round_trip(spark, editor, tmp_path):
    graph_tables.save_tables(editor.nodes, editor.edges, str(tmp_path / "n"), str(tmp_path / "e"))
    graph = graph_tables.load_graph(spark, str(tmp_path / "n"), str(tmp_path / "e"))
    assert graph.nodes.filter("label = 'CodeFile'").first()["name"] == "f.lua"
    assert relations.label_counts(graph).count() == 3


def test_sql_guard(spark, editor):
    graph = editor.graph
    surface = SqlSurface(spark, graph.nodes, graph.edges)
    assert surface.answer("SELECT count(*) AS n FROM nodes").rows == [{"n": 3}]
    assert surface.answer("WITH x AS (SELECT id FROM nodes) SELECT * FROM x ORDER BY id -- LIMIT").row_count == 3
    assert surface.answer("SELECT explode(sequence(1, 2000)) AS i LIMIT 900").row_count == 500
    assert surface.answer("EXPLAIN SELECT * FROM edges").row_count == 1
    assert surface.query("PRAGMA table_info('edges')").count() == 4
    for bad in ("DROP VIEW nodes", "INSERT INTO nodes VALUES (1)", "SELECT 1; DROP VIEW nodes", "CREATE TABLE t (a INT)",
                "EXPLAIN DROP VIEW nodes", "SET spark.x=1", "SELECT 1) UNION ALL (SELECT 2); DROP VIEW nodes --", "PRAGMA table_info(snippets)"):
        with pytest.raises(Refused):
            surface.query(bad).collect()
    assert spark.table("nodes").count() == 3


def test_sql_names_only_its_own_tables(spark, editor, tmp_path):
    graph = editor.graph
    spark.range(3).write.parquet(str(tmp_path / "f"))
    spark.range(3).createOrReplaceTempView("other_view")
    surface = SqlSurface(spark, graph.nodes, graph.edges)
    for bad in (f"SELECT * FROM parquet.`{tmp_path}/f`", "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM other_view", "SELECT (SELECT max(id) FROM other_view) AS m",
                "WITH other_view AS (SELECT * FROM other_view) SELECT * FROM other_view", "SELECT id FROM nodes WHERE EXISTS (SELECT 1 FROM other_view)", "SELECT * FROM snippets"):
        with pytest.raises(Refused):
            surface.query(bad).collect()
    with pytest.raises(Refused) as refused:
        surface.query("SELEC id FROM nodes")
    assert str(refused.value)
    ids = [r["id"] for r in graph.nodes.orderBy("id").collect()]
    got = surface.query("SELECT group_concat(id, '; total(x)') AS g, total(1e0) AS t, strftime('%Y/%m', TIMESTAMP '2024-03-05 01:02:03') AS s, "
                        "datetime(TIMESTAMP '2024-03-05 01:02:03') AS d FROM nodes WHERE id GLOB '*'".replace("total(1e0)", "total(one)").replace("FROM nodes", "FROM (SELECT *, 1 AS one FROM nodes) n")).first()
    assert sorted(got.g.split("; total(x)")) == ids and (got.t, got.s, got.d) == (float(len(ids)), "2024/03", "2024-03-05 01:02:03")


def test_settings(spark):
    spark.conf.set("spark.graphloom.embedding_batch", "8")
    got = Settings.load(spark, {"nodes_path": "n", "embedding": {"batch": 64}, "require_confirm_token": "yes"})
    assert (got.nodes_path, got.embedding_batch, got.require_confirm_token) == ("n", 8, True)
    spark.conf.unset("spark.graphloom.embedding_batch")
    assert deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_files_and_build_report(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name, body in (("z.py", "def f(): pass\n"), ("a.lua", "function g() end\n"), ("b.cs", "class C {}\n"), ("skip.txt", "x")):
        (tmp_path / "src" / name).write_text(body)
    names = lambda df: sorted(r["path"].rsplit("/", 1)[1] for r in df.collect())
    assert names(codefiles.scan_directory(spark, str(tmp_path))) == ["a.lua", "b.cs", "z.py"]
    assert names(codefiles.scan_directory(spark, str(tmp_path), 2)) == ["b.cs", "z.py"]
    assert codefiles.read_files(spark, [str(tmp_path / "src" / "a.lua")]).first()["code"] == "function g() end\n"
    report = tmp_path / "ckpt.json"
    report.write_text(json.dumps({"terms": {"x": {"phase1": {"a": 1}, "phase2": {"_status": "error"}}, "y": {"phase1": {}}, "z": {}},
                                  "metadata": {"last_saved": "now"}}))
    terms = build_report.read_checkpoint(spark, str(report))
    got = {r["phase"]: (r["done"], r["errors"], r["progress"]) for r in build_report.phase_progress(terms).collect()}
    assert got == {"phase1": (2, 0, "66.7%"), "phase2": (0, 1, "0.0%"), "phase3": (0, 0, "0.0%")}
    nodes = spark.createDataFrame([("file:1", "CodeFile", '{"path":"a/B.LUA"}'), ("file:2", "CodeFile", '{"path":""}'),
                                   ("file:3", "CodeFile", '{"path":"x.py"}')], "id string, label string, properties string")
    assert [r["codefile_node_id"] for r in codefiles.codefile_sources(nodes).collect()] == ["file:1"]


def test_messages_and_results(spark):
    rows = [(1, 0, "system", "old"), (1, 1, "system", "new"), (1, 2, "user", "hi"), (1, 3, "assistant", '{"type":"tool_calls"}'),
            (1, 4, "tool", "r1"), (1, 5, "tool", "r2"), (1, 6, "assistant", ""), (1, 7, "tool", "r3"), (1, 8, "assistant", "bye")]
    chat = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert messages.system_texts(chat).first()["system"] == "new"
    merged = messages.merge_tool_results(messages.convert(chat)).orderBy("turn").collect()
    assert [(r["turn"], r["role"], r["block_type"], r["message"]) for r in merged] == [
        (2, "user", "text", 1), (3, "assistant", "tool_use", 2), (4, "user", "tool_result", 3), (5, "user", "tool_result", 3),
        (7, "user", "tool_result", 3), (8, "assistant", "text", 4)]
    one = spark.createDataFrame([('{"content":[{"type":"image"},{"type":"text","text":"{\\"a\\":1}"}]}',)], "r string")
    assert one.select(jsonprops.unwrap_tool_result(F.col("r")).alias("v")).first()["v"] == '{"a":1}'


def test_restart_repair_and_history_order(spark):
    rows = [("q1", "in_progress", "proposal", "log", None, "2024-01-03"), ("q2", "completed", "x", "", "2024-01-09", "2024-01-01"),
            ("q3", "pending", "x", "", None, "2024-01-05"), ("q4", None, "proposal", "", None, "2024-01-04")]
    q = spark.createDataFrame(rows, "id string, status string, category string, execution_log string, completed_at string, created_at string")
    fixed = {r["id"]: (r["status"], r["execution_log"]) for r in proposals.reset_unfinished(q).collect()}
    assert fixed["q1"] == ("approved", "log\n[System] restarted, the task was reset") and fixed["q2"] == ("completed", "")
    page, total = workflow.proposal_history(q)
    assert [r["id"] for r in page.collect()] == ["q2", "q4", "q1"] and total.first()["total"] == 3
    stats = {r["status"]: r["count"] for r in workflow.proposal_stats(q).collect()}
    assert stats["pending_proposal"] == 1 and stats["failed"] == 0 and stats["total"] == 3


def test_stuck_proposal_is_reset_by_event_time(spark, tmp_path):
    schema = "id string, action string, at timestamp, seq long"
    base = "2024-01-01 00:%02d:00"
    batches = [[("p", "approve", base % 0, 1), ("p", "start", base % 1, 2), ("r", "approve", base % 1, 3)],
               [("r", "start", "2024-01-01 05:00:00", 4)]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "id string, action string, at string, seq long").withColumn("at", F.to_timestamp("at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = proposals.run_to_folder(proposals.proposal_states(stream, "1 minute"), str(tmp_path / "out"), str(tmp_path / "cp"))
        assert query.awaitTermination(120)
    got = {r["id"]: (r["status"], r["log"].split("\n")[-1]) for r in proposals.latest_states(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {"p": ("approved", "reset after timeout"), "r": ("in_progress", "start -> in_progress")}


# --- edit log, segments, ordered streams -------------------------------------------

@pytest.fixture
def edit_log(spark, tmp_path):
    from graphloom.sources.edit_log import EditLog

    nodes = spark.range(1000).select(F.format_string("n:%d", "id").alias("id"), F.lit("Doc").alias("label"),
                                     F.format_string('{"name":"%d","tags":[1,2]}', "id").alias("properties"))
    edges = spark.range(999).select(F.format_string("n:%d", "id").alias("source"), F.format_string("n:%d", F.col("id") + 1).alias("target"),
                                    F.lit("NEXT").alias("relationship"), F.lit("{}").alias("properties"))
    log = EditLog(spark, str(tmp_path / "log"), most_deltas=3)
    log.create("start", nodes=nodes, edges=edges)
    return log


def _edits(spark, rows):
    return spark.createDataFrame(rows, "id string, label string, properties string, op string, seq long")


def _state(frame):
    return {r.id: (r.label, json.loads(r.properties)) for r in frame.collect()}


def test_edits_fold_in_order_across_deltas_and_merges(spark, edit_log):
    import random

    source, state = random.Random(1), {f"n:{k}": ("Doc", {"name": str(k), "tags": [1, 2]}) for k in range(1000)}
    for _ in range(7):
        rows = []
        for seq in range(60):
            key, op = f"n:{source.randint(0, 12)}", source.choice(["put", "set", "set", "set", "drop"])
            fields = {source.choice("abc"): source.choice([1, "x", None, [1], {"k": True}, 2.5])}
            rows.append((key, "New" if op == "put" else None, None if op == "drop" else json.dumps(fields), op, seq))
            if op == "put":
                state[key] = ("New", fields)
            elif op == "drop":
                state.pop(key, None)
            elif key in state:
                state[key] = (state[key][0], {**state[key][1], **fields})
        source.shuffle(rows)  # only seq orders them
        edit_log.commit({"nodes": _edits(spark, rows)})
    assert _state(edit_log.read("nodes")) == state
    assert len(edit_log.version().files["nodes"].deltas) <= 3
    edit_log.compact()
    assert not edit_log.version().files["nodes"].deltas and _state(edit_log.read("nodes")) == state


def test_plans_do_not_grow_with_edits_and_commits_write_edits_only(spark, edit_log, tmp_path):
    def size(folder):
        return sum(f.stat().st_size for f in (tmp_path / "log" / folder).rglob("*.parquet"))

    def depth():
        return edit_log.read("nodes")._jdf.queryExecution().optimizedPlan().toString().count("\n")

    base = size("nodes")
    edit_log.commit({"nodes": _edits(spark, [("n:1", None, '{"a":1}', "set", 1)])})
    one, few = depth(), size("nodes") - base
    for k in range(2):
        edit_log.commit({"nodes": _edits(spark, [(f"n:{i}", None, f'{{"a":{i}}}', "set", i) for i in range(10)])})
    assert depth() == one and size("nodes") - base < 0.5 * base and few < 0.2 * base


def test_commits_clash_rollback_and_diff(spark, edit_log):
    from graphloom.sources.edit_log import cascade
    from graphloom.sources.manifest import CommitClash

    gone = spark.createDataFrame([("n:5",)], "id string")
    edit_log.commit({"nodes": _edits(spark, [("n:5", None, None, "drop", 1)]), "edges": cascade(edit_log.read("edges"), gone)}, "gone", parent=1)
    with pytest.raises(CommitClash):
        edit_log.commit({"nodes": _edits(spark, [("n:6", None, None, "drop", 1)])}, parent=1)
    with pytest.raises(CommitClash):  # two writers that saw the same head: the manifest decides
        edit_log.manifests.create(2, {})
    assert edit_log.read("edges").count() == 997 and edit_log.read("edges", 1).count() == 999
    edit_log.commit({"nodes": _edits(spark, [("n:7", None, '{"name":"seven"}', "set", 1), ("n:8", None, '{"name":"8"}', "set", 1)])})
    assert [tuple(r)[:2] for r in edit_log.diff("nodes", 1, 3).orderBy("id").collect()] == [("n:5", "removed"), ("n:7", "changed")]
    edit_log.compact()
    assert edit_log.diff("nodes", 3, 4).count() == 0 and edit_log.diff("nodes", 4, 1).count() == 2
    assert edit_log.rollback(1).version == 5 and edit_log.read("nodes").count() == 1000
    assert edit_log.diff("nodes", 5, 1).count() == 0
    with pytest.raises(LookupError):
        edit_log.read("nodes", 9)


def test_editor_saves_its_edits_and_notices_other_writers(editor):
    assert editor.version("save", message="start").ok
    other = Editor(editor.store.graph().nodes, editor.store.graph().edges, store=editor.store)
    assert editor.node("create", "doc:1", "Doc", {"name": "x"}).ok
    plan = lambda: editor.nodes._jdf.queryExecution().optimizedPlan().toString().count("\n")
    once = plan()
    for k in range(30):
        assert editor.node("update", "doc:1", properties={f"k{k}": k}).ok
    assert plan() == once
    assert editor.node("get", "doc:1").data["node"]["k29"] == 29
    assert other.merge(["file:1"], "bt:1", delete_sources=True).ok and other.version("save", message="merged").data["snapshot"]["snapshot_id"] == 2
    assert editor.version("save", message="late").code == "CONFLICT"
    assert other.version("delete", snapshot_id=1).ok
    assert [(r["snapshot_id"], r["action"]) for r in editor.version("list").data["items"]] == [(1, "archive"), (2, "save"), (1, "save")]


def test_index_segments_equal_a_rebuilt_index(spark, tmp_path):
    import random

    from graphloom.operators.textindex import TextIndex
    from graphloom.operators.textsegments import SegmentedIndex

    source = random.Random(2)
    text = lambda: " ".join(source.choice(["ab", "cd", "ef", "gh", "ij", "x"]) for _ in range(source.randint(0, 9)))
    docs = {f"d{k}": text() for k in range(60)}
    frame = lambda some: spark.createDataFrame([(k, "L", v) for k, v in some.items()], "id string, label string, text string")
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    index.create(frame(docs))
    for step in range(4):
        before = {k: docs[k] for k in source.sample(sorted(docs), 7)}
        after = {k: text() for k in list(before)[:4]} | {f"n{step}": text(), f"m{step}": "ab"}
        index.update(frame(before), frame(after))
        docs = {k: v for k, v in docs.items() if k not in before} | after
        built, kept = TextIndex.build(frame(docs)), index.index()
        assert (kept.corpus_size, round(kept.avg_len, 9), round(kept.mean_idf, 9)) == (built.corpus_size, round(built.avg_len, 9), round(built.mean_idf, 9))
        for part in ("postings", "terms"):
            order = sorted(getattr(built, part).columns)
            assert sorted(map(tuple, getattr(kept, part).select(order).collect())) == sorted(map(tuple, getattr(built, part).select(order).collect()))
    assert len(index.segments) < 5 and index.segments[-1].number == 5
    assert index.index(1).corpus_size == 60
