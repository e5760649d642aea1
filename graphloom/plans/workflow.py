"""Review questions and proposals: listing, paging, statistics and state changes.

Questions are rows ``(id, question, category, context, status, answer,
created_at, approved_at, completed_at, severity, related_node_id, ...)``;
columns that a table lacks count as missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import question_id
from graphloom.schema import RAISES_QUESTION

# --- fixed values ------------------------------------------------------------
PENDING_PRIORITY = {"proposal": -1, "contradictory": 0, "untraceable": 1, "ambiguous": 2,
                    "wrong_association": 3, "weak_association": 4, "game_trivia": 5}
OTHER_PRIORITY = 9
SHOWN_STATUSES = ["approved", "in_progress", "completed", "completed_no_action", "failed", "rejected"]
PROPOSAL_CATEGORY = "proposal"
MIN_ANSWER, MAX_ANSWER = 2, 5000
# -----------------------------------------------------------------------------


def _text(frame: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in frame.columns else F.lit("")


def keyword_filter(questions: DataFrame, keyword: str) -> DataFrame:
    """Keyword in the question or its context, ignoring case."""
    if not keyword:
        return questions
    low = F.lit(keyword.lower())
    return questions.filter(F.contains(F.lower(_text(questions, "question")), low)
                            | F.contains(F.lower(_text(questions, "context")), low))


def _page(rows: DataFrame, order: Sequence[Column], skip: int, limit: int) -> tuple[DataFrame, DataFrame]:
    return (rows.orderBy(*order).offset(skip).limit(limit), rows.agg(F.count(F.lit(1)).alias("total")))


def list_pending(questions: DataFrame, category: str = "", keyword: str = "", skip: int = 0,
                 limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """One page of pending questions, most urgent category first, and their total."""
    rows = questions.filter(F.col("status") == "pending")
    if category:
        rows = rows.filter(F.col("category") == category)
    rows = keyword_filter(rows, keyword)
    urgency = F.create_map(*[F.lit(x) for pair in PENDING_PRIORITY.items() for x in pair])
    place = F.coalesce(F.try_element_at(urgency, F.coalesce("category", F.lit(""))), F.lit(OTHER_PRIORITY))
    return _page(rows, [place, F.col("id")], skip, limit)


def list_all(questions: DataFrame, status: str = "", category: str = "") -> DataFrame:
    rows = questions.filter(F.col("status") == status) if status else questions
    return rows.filter(F.col("category") == category) if category else rows


def is_visible(questions: DataFrame) -> Column:
    """Shown in the execution monitor: any processed state, or a pending human proposal."""
    status = F.coalesce("status", F.lit("pending"))
    return status.isin(*SHOWN_STATUSES) | ((status == "pending") & (F.col("category") == PROPOSAL_CATEGORY))


def proposal_stats(questions: DataFrame) -> DataFrame:
    """``(status, count)`` of visible proposals: every state listed, pending ones as
    ``pending_proposal``, and the ``total``."""
    status = F.coalesce("status", F.lit("pending"))
    shown = questions.filter(is_visible(questions)).select(
        F.when(status == "pending", F.lit("pending_proposal")).otherwise(status).alias("status"))
    counted = shown.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    listed = questions.sparkSession.createDataFrame(
        [(s,) for s in [*SHOWN_STATUSES, "pending_proposal"]], "status string")
    filled = listed.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("count"))
    total = shown.agg(F.count(F.lit(1)).alias("count")).select(F.lit("total").alias("status"), "count")
    return filled.unionAll(total)


def proposal_history(questions: DataFrame, status: str = "", keyword: str = "", page: int = 1,
                     page_size: int = 20) -> tuple[DataFrame, DataFrame]:
    """One page of visible proposals, latest activity first, and their total."""
    page, page_size = max(1, page), max(1, min(100, page_size))
    rows = questions.filter(is_visible(questions))
    if status and status != "all":
        rows = rows.filter(F.coalesce("status", F.lit("pending")) == status)
    rows = keyword_filter(rows, keyword)
    latest = F.coalesce(*[F.nullif(_text(rows, c), F.lit("")) for c in ("completed_at", "approved_at", "created_at")],
                        F.lit(""))
    return _page(rows, [latest.desc(), F.col("id")], (page - 1) * page_size, page_size)


def question_stats(questions: DataFrame, with_severity: bool = False) -> DataFrame:
    """``(dimension, value, count)``: total, by status, by category and optionally by severity."""
    missing = ("?", "?") if with_severity else ("pending", "unknown")
    keys = [F.coalesce(F.col("status"), F.lit(missing[0])).alias("status"),
            F.coalesce(F.col("category"), F.lit(missing[1])).alias("category")]
    if with_severity:
        keys.append(F.coalesce(F.nullif(_text(questions, "severity"), F.lit("")), F.lit("?")).alias("severity"))
    names = ["status", "category", "severity"][:len(keys)]
    # one row per key combination first: the grouping sets then run over the small cube
    combos = questions.select(*keys).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("value")) for n in names],
                    F.struct(F.lit("total").alias("dimension"), F.lit("").alias("value")))
    return (combos.select(F.explode(pairs).alias("d"), "n").groupBy("d.dimension", "d.value")
            .agg(F.sum("n").alias("count")))


def questions_for_node(graph, node_id: str, status: str = "") -> DataFrame:
    """Questions a node raises."""
    from graphloom.operators.relations import related_nodes

    rows = related_nodes(graph, node_id, RAISES_QUESTION, "OUT").filter(F.col("label") == "Question")
    return rows.filter(F.get_json_object("properties", "$.status") == status) if status else rows


# --- state changes -----------------------------------------------------------

def new_questions(drafts: DataFrame, nodes: DataFrame, created_at: Column) -> tuple[DataFrame, DataFrame]:
    """Question rows of ``drafts (question, category, context, related_node_id, ordinal)`` and their edges.

    A category outside the list becomes ``unknown``; an edge is made only when
    the related node exists.
    """
    from graphloom.operators.validation import CATEGORIES

    rows = drafts.select(
        question_id(F.col("question"), created_at, F.col("ordinal")).alias("id"), "question",
        F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise(F.lit("unknown")).alias("category"),
        "context", F.lit("pending").alias("status"), F.lit("").alias("answer"), created_at.alias("created_at"),
        "related_node_id")
    edges = rows.join(nodes.select(F.col("id").alias("related_node_id")), "related_node_id", "left_semi").select(
        F.col("related_node_id").alias("source"), F.col("id").alias("target"),
        F.lit(RAISES_QUESTION).alias("relationship"), F.lit("{}").alias("properties"))
    return rows, edges


def change_state(questions: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """Apply ``changes (id, action, note)``: answer, dismiss, approve, reject or resolve; one per id.

    ``resolve`` needs a note of 2 to 5000 characters and is skipped otherwise.
    """
    target = F.create_map(*[F.lit(x) for pair in {
        "answer": "answered", "dismiss": "dismissed", "approve": "approved", "reject": "rejected",
        "resolve": "resolved"}.items() for x in pair])
    note_ok = F.length(F.trim(F.coalesce("note", F.lit("")))).between(MIN_ANSWER, MAX_ANSWER)
    valid = changes.filter((F.col("action") != "resolve") | note_ok).select(
        "id", "action", "note", F.try_element_at(target, F.col("action")).alias("new_status")
    ).filter(F.col("new_status").isNotNull())
    joined = questions.join(valid, "id", "left")
    hit = F.col("new_status").isNotNull()
    out = joined.withColumn("status", F.coalesce("new_status", "status"))
    if "answer" in questions.columns:
        out = out.withColumn("answer", F.when(F.col("action").isin("answer", "resolve"), F.col("note"))
                             .otherwise(F.col("answer")))
    stamps = {"approve": "approved_at", "reject": "rejected_at", "answer": "answered_at", "resolve": "resolved_at",
              "dismiss": "dismissed_at"}
    for action, column in stamps.items():
        old = F.col(column) if column in questions.columns else F.lit(None).cast("timestamp")
        out = out.withColumn(column, F.when(hit & (F.col("action") == action), at.cast("timestamp")).otherwise(old))
    old_reason = F.col("reject_reason") if "reject_reason" in questions.columns else F.lit(None).cast("string")
    out = out.withColumn("reject_reason", F.when(F.col("action") == "reject", F.col("note")).otherwise(old_reason))
    return out.drop("action", "note", "new_status")
