"""Review questions and proposals derived from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog.registry import Context, query
from graphloom.functions import text
from graphloom.plans import editing, versions, workflow
from graphloom.sources import build_report
from graphloom.sources.star_graph import questions

N = "cast(count(*) as bigint)"

_Q = """q AS (SELECT 'question:' || event_id AS id, 'Review ' || event_type || ' ' || json_extract_string(props, '$.k') AS question,
  (['proposal', 'contradictory', 'untraceable', 'ambiguous', 'wrong_association', 'weak_association'])[(json_extract_string(props, '$.k')::int % 6) + 1] AS category,
  props AS context, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'approved' WHEN 'purchase' THEN 'completed'
    WHEN 'signup' THEN 'rejected' ELSE 'failed' END AS status, ts AS created_at, 'customer:' || user_id AS related_node_id, event_id FROM events),
vis AS (SELECT * FROM q WHERE status IN ('approved', 'in_progress', 'completed', 'completed_no_action', 'failed', 'rejected')
  OR (status = 'pending' AND category = 'proposal'))"""


def _questions(c: Context):
    return questions(c.spark, c.sf_dir)


@query("pending_page", f"""WITH {_Q}, p AS (SELECT * FROM q WHERE status = 'pending')
SELECT id, category, (SELECT {N} FROM p) AS total FROM (SELECT * FROM p ORDER BY CASE category WHEN 'proposal' THEN -1
  WHEN 'contradictory' THEN 0 WHEN 'untraceable' THEN 1 WHEN 'ambiguous' THEN 2 WHEN 'wrong_association' THEN 3
  WHEN 'weak_association' THEN 4 WHEN 'game_trivia' THEN 5 ELSE 9 END, id LIMIT 50 OFFSET 20)""")
def pending_page(c: Context):
    page, total = workflow.list_pending(_questions(c), skip=20, limit=50)
    return page.select("id", "category", F.lit(1).alias("k")).join(total.withColumn("k", F.lit(1)), "k").drop("k")


@query("pending_keyword", f"""WITH {_Q} SELECT id, category FROM (SELECT * FROM q WHERE status = 'pending' AND category = 'ambiguous'
  AND (contains(lower(question), 'view 2') OR contains(lower(context), 'view 2')) ORDER BY id LIMIT 50)""")
def pending_keyword(c: Context):
    page, _ = workflow.list_pending(_questions(c), "ambiguous", "VIEW 2")
    return page.select("id", "category")


@query("list_all_questions", f"WITH {_Q} SELECT id, related_node_id FROM q WHERE status = 'failed' AND category = 'proposal'")
def list_all_questions(c: Context):
    return workflow.list_all(_questions(c), "failed", "proposal").select("id", "related_node_id")


@query("proposal_visibility", f"WITH {_Q} SELECT status, category, {N} AS count FROM vis GROUP BY 1, 2")
def proposal_visibility(c: Context):
    rows = _questions(c)
    return rows.filter(workflow.is_visible(rows)).groupBy("status", "category").agg(F.count(F.lit(1)).alias("count"))


@query("proposal_stats", f"""WITH {_Q}, s AS (SELECT unnest(['approved', 'in_progress', 'completed', 'completed_no_action', 'failed', 'rejected', 'pending_proposal']) AS status)
SELECT s.status, cast(count(v.id) as bigint) AS count FROM s LEFT JOIN (SELECT id, CASE status WHEN 'pending' THEN 'pending_proposal' ELSE status END AS status FROM vis) v
  USING (status) GROUP BY s.status UNION ALL SELECT 'total', {N} FROM vis""")
def proposal_stats(c: Context):
    return workflow.proposal_stats(_questions(c))


@query("proposal_history", f"WITH {_Q} SELECT id, status, (SELECT {N} FROM vis WHERE status = 'failed') AS total FROM "
       "(SELECT * FROM vis WHERE status = 'failed' ORDER BY created_at DESC, id LIMIT 20 OFFSET 20)")
def proposal_history(c: Context):
    page, total = workflow.proposal_history(_questions(c), "failed", page=2)
    return page.select("id", "status", F.lit(1).alias("k")).join(total.withColumn("k", F.lit(1)), "k").drop("k")


@query("question_stats", f"""WITH {_Q} SELECT 'status' AS dimension, status AS value, {N} AS count FROM q GROUP BY 2
UNION ALL SELECT 'category', category, {N} FROM q GROUP BY 2 UNION ALL SELECT 'severity', '?', {N} FROM q UNION ALL SELECT 'total', '', {N} FROM q""")
def question_stats(c: Context):
    return workflow.question_stats(_questions(c), with_severity=True)


@query("question_ids", """SELECT event_id, 'question:' || regexp_replace(('Review ' || event_type || ': ' || props)[1:30], '[^\\p{L}\\p{N}_]', '_', 'g')
  || '_' || cast(floor(epoch(ts)) as bigint) || '_' || event_id AS id FROM events""")
def question_ids(c: Context):
    asked = F.concat(F.lit("Review "), "event_type", F.lit(": "), "props")
    return c.table("events").select("event_id", text.question_id(
        asked, F.col("ts").cast("timestamp"), F.col("event_id")).alias("id"))


@query("create_questions", f"""SELECT 'customer:' || user_id AS source, CASE event_type WHEN 'view' THEN 'general' ELSE 'unknown' END AS category, {N} AS edges
FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) GROUP BY 1, 2""")
def create_questions(c: Context):
    """Every event as a draft; only those about known customers of some nations get an edge."""
    drafts = c.table("events").select(
        F.concat(F.lit("About "), "event_type").alias("question"),
        F.when(F.col("event_type") == "view", F.lit("general")).otherwise(F.lit("nonsense")).alias("category"),
        F.col("props").alias("context"), F.concat(F.lit("customer:"), F.col("user_id").cast("string")).alias("related_node_id"),
        F.col("event_id").alias("ordinal"), "ts")
    nodes = c.table("customer").filter("c_nationkey < 12").select(
        F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    rows, edges = workflow.new_questions(drafts, nodes, F.to_timestamp(F.lit("2024-05-01 00:00:00")))
    return (edges.join(rows.select(F.col("id").alias("target"), "category"), "target")
            .groupBy("source", "category").agg(F.count(F.lit(1)).alias("edges")))


@query("change_question_state", f"""WITH {_Q} SELECT CASE WHEN event_id % 5 = 0 THEN 'answered' WHEN event_id % 5 = 1 THEN 'dismissed'
  WHEN event_id % 5 = 2 THEN 'rejected' WHEN event_id % 5 = 3 AND event_id % 2 = 1 THEN 'resolved' ELSE status END AS status, {N} AS count FROM q GROUP BY 1""")
def change_question_state(c: Context):
    """Four actions over all questions; resolving needs a note, which every second one lacks."""
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    action = F.element_at(F.array(*[F.lit(a) for a in ("answer", "dismiss", "reject", "resolve", "unknown")]),
                          (number % 5 + 1).cast("int"))
    changes = _questions(c).select("id", action.alias("action"), F.when(number % 2 == 1, F.lit("because")).alias("note"))
    done = workflow.change_state(_questions(c), changes, F.to_timestamp(F.lit("2024-05-01 00:00:00")))
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


@query("build_progress", """WITH t AS (SELECT p_name AS name, p_size FROM part),
p AS (SELECT unnest(['phase1', 'phase2', 'phase3']) AS phase, unnest([1, 2, 3]) AS n)
SELECT phase, cast(count(CASE WHEN p_size % (n + 1) <> 0 THEN 1 END) as bigint) AS done,
  cast(count(CASE WHEN p_size % (n + 1) = 0 AND p_size % 7 = 0 THEN 1 END) as bigint) AS errors,
  printf('%.1f%%', count(CASE WHEN p_size % (n + 1) <> 0 THEN 1 END) * 100.0::double / count(*)) AS progress FROM t, p GROUP BY phase""")
def build_progress(c: Context):
    """Parts as terms of a build checkpoint: a phase is done, failed or missing by the part size."""
    def phase(n: int):
        return (F.when(F.col("p_size") % (n + 1) != 0, F.struct(F.lit("ok").alias("_status")))
                .when(F.col("p_size") % 7 == 0, F.struct(F.lit("error").alias("_status"))))

    entries = c.table("part").select(F.struct(*[phase(n).alias(f"phase{n}") for n in (1, 2, 3)]).alias("term"))
    return build_report.phase_progress(entries)


@query("snapshot_manifest", """WITH m AS (SELECT snapshot, sum(n_chars) AS chars FROM
  (SELECT doc_id % 4 AS snapshot, n_chars FROM documents) GROUP BY 1)
SELECT cast(snapshot as int) AS snapshot_id, 'load part ' || snapshot AS message FROM m WHERE contains('load part ' || snapshot, 'part')""")
def snapshot_manifest(c: Context):
    manifest = (c.table("documents").groupBy((F.col("doc_id") % 4).cast("int").alias("snapshot_id"))
                .agg(F.max("doc_id").alias("last")).select(
                    "snapshot_id", F.concat(F.lit("load part "), F.col("snapshot_id").cast("string")).alias("message"),
                    F.lit("save").alias("action"), F.current_timestamp().alias("created_at")))
    return versions.search(manifest, "PART").select("snapshot_id", "message")


@query("node_update", """SELECT event_id, CASE WHEN event_type = 'click' THEN 'done' END AS status, cast(json_extract_string(props, '$.k') as int) AS k FROM events""")
def node_update(c: Context):
    """Shallow property updates of all click nodes in one plan."""
    nodes = c.table("events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("label"),
                                     F.col("props").alias("properties"))
    done = editing.update_properties(nodes, F.col("label") == "click", {"status": '"done"'})
    return done.select(F.col("id").cast("long").alias("event_id"), F.get_json_object("properties", "$.status").alias("status"),
                       F.get_json_object("properties", "$.k").cast("int").alias("k"))


@query("list_nodes_filtered", f"""SELECT cast(event_id as varchar) AS id, (SELECT {N} FROM events WHERE event_type = 'click'
  AND contains(json_extract_string(props, '$.k'), '7')) AS total FROM events WHERE event_type = 'click'
  AND contains(json_extract_string(props, '$.k'), '7') ORDER BY 1 LIMIT 50""")
def list_nodes_filtered(c: Context):
    nodes = c.table("events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("label"),
                                     F.col("props").alias("properties"))
    page, total = editing.list_by_label(nodes, "click", "k", "7")
    return page.select("id", F.lit(1).alias("one")).join(total.withColumn("one", F.lit(1)), "one").drop("one")
