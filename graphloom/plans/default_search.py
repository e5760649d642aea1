"""The default search: reranked hits, readable graph snapshots and code outlines around them.

Hit lists are bounded by the caller's k and held locally; what touches the
whole graph (retrieval, neighbourhoods) stays a Spark plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.links import record_path
from graphloom.functions.scoring import clamp01, safe_norm
from graphloom.operators.neighborhood import level_edges, neighborhood_levels
from graphloom.plans.retrieve import Retriever
from graphloom.schema import (CODE_LABEL, ENTITY_LABEL, OUTLINE_LABELS, QUESTION_LABEL, STORY_LABEL,
                              TERM_LABEL)
from graphloom.session import materialize, pin_top, together

# --- fixed values ------------------------------------------------------------
FULL_FACTOR, FULL_MINIMUM = 8, 80
FOCUS_FACTOR, FOCUS_MINIMUM = 4, 40
SUPPORT_TERMS = 16
SUPPORT_SIZE = 260
BASE_WEIGHT = 0.60
CODE_BOOST = 0.22
TERM_BOOST = 0.30
SUPPORT_WEIGHT = 0.28
SUPPORT_FLOOR = 0.12
SUPPORT_PENALTY = 0.14
CORE_LABELS = [TERM_LABEL, STORY_LABEL, CODE_LABEL]
CORE_MINIMUM, CORE_SHARE = 0.28, 0.55
CENTER_LABELS = [TERM_LABEL, STORY_LABEL, CODE_LABEL, ENTITY_LABEL]
CENTERS = 3
SNAPSHOT_SIZE = 180
SNAPSHOT_NODES = 24
SNAPSHOT_MINIMUM = 8
SNAPSHOT_EDGES = 80
LABEL_CAPS = {CODE_LABEL: 18, STORY_LABEL: 12, TERM_LABEL: 8, ENTITY_LABEL: 10}
OTHER_CAP = 6
OUTLINE_FILES, OUTLINE_SIZE, OUTLINE_ITEMS = 3, 80, 10
CARD_EDGES = 10
# -----------------------------------------------------------------------------


def rerank(retriever: Retriever, query: str, top_k: int = 10, vector: Sequence[float] | None = None,
           label_filter: str = "") -> DataFrame:
    """``(id, label, name, score, raw_score, term_support)`` of all candidates, best first in ``place``.

    Candidates are the hits of the full, the code-only and the term-only
    search. Terms gain or lose by how strongly their entity neighbours were hit.
    """
    focus = max(top_k * FOCUS_FACTOR, FOCUS_MINIMUM)
    full, code, terms = together(
        lambda: retriever.hits(query, max(top_k * FULL_FACTOR, FULL_MINIMUM), vector=vector),
        lambda: retriever.hits(query, focus, label_filter=CODE_LABEL, vector=vector),
        lambda: retriever.hits(query, focus, label_filter=TERM_LABEL, vector=vector))

    support = _term_support(retriever, terms, full)
    top_support = support.agg(F.coalesce(F.max("support"), F.lit(0.0)).alias("top_support"), F.lit(1).alias("one"))
    top_raw = full.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("top_raw"), F.lit(1).alias("one"))

    fields = ["id", "label", "name", "score"]
    tagged = (full.select(*fields, F.lit(0).alias("c"), F.lit(0).alias("t"))
              .unionAll(code.select(*fields, F.lit(1).alias("c"), F.lit(0).alias("t")))
              .unionAll(terms.select(*fields, F.lit(0).alias("c"), F.lit(1).alias("t"))))
    candidates = (tagged.groupBy("id").agg(F.first("label").alias("label"), F.first("name").alias("name"),
                                           F.max("score").alias("raw_score"), F.max("c").alias("in_code"),
                                           F.max("t").alias("in_terms"))
                  .filter(~F.col("label").isin(ENTITY_LABEL, QUESTION_LABEL)).withColumn("one", F.lit(1))
                  .join(support, "id", "left").join(F.broadcast(top_raw), "one").join(F.broadcast(top_support), "one"))
    is_term = F.col("label") == TERM_LABEL
    supported = F.when(is_term, safe_norm(F.coalesce("support", F.lit(0.0)), F.col("top_support"))).otherwise(F.lit(0.0))
    score = clamp01(
        F.lit(BASE_WEIGHT) * safe_norm(F.col("raw_score"), F.col("top_raw"))
        + F.lit(CODE_BOOST) * F.col("in_code") + F.lit(TERM_BOOST) * F.col("in_terms")
        + F.lit(SUPPORT_WEIGHT) * F.col("term_support")
        - F.when(is_term & (F.col("term_support") < SUPPORT_FLOOR), F.lit(SUPPORT_PENALTY)).otherwise(F.lit(0.0)))
    ranked = candidates.withColumn("term_support", supported).withColumn("score", F.round(score, 9))
    if label_filter and label_filter not in (ENTITY_LABEL, QUESTION_LABEL):
        ranked = ranked.filter(F.col("label") == label_filter)
    order = Window.orderBy(F.desc("score"), F.desc("raw_score"), "name", "id")  # over the candidate list only
    return ranked.select("id", "label", "name", "score", "raw_score", "term_support",
                         F.row_number().over(order).alias("place"))


def _term_support(retriever: Retriever, terms: DataFrame, full: DataFrame) -> DataFrame:
    """``(id, support)``: full-search scores of the entities next to each of the best terms."""
    ids = [r["id"] for r in terms.orderBy(F.desc("score"), "id").limit(SUPPORT_TERMS).collect()]
    if not ids:
        return retriever.graph.spark.createDataFrame([], "id string, support double")
    levels = neighborhood_levels(retriever.graph, ids, 1, max_size=SUPPORT_SIZE)
    hit = full.filter(F.col("label") == ENTITY_LABEL).select("id", "score")
    return (levels.select("seed", "id").join(F.broadcast(hit), "id")  # at most the full hit list
            .groupBy(F.col("seed").alias("id")).agg(F.sum("score").alias("support")))


def order_results(reranked: DataFrame, top_k: int = 10) -> DataFrame:
    """The answer list: a quota of terms first, then the rest, with ``rank`` and ``is_core``."""
    limit = max(1, top_k)
    quota = max(2, limit // 2)
    is_term = (F.col("label") == TERM_LABEL).cast("int")
    by_kind = Window.partitionBy(is_term).orderBy("place")
    lead = (is_term == 1) & (F.row_number().over(by_kind) <= quota)
    front = Window.orderBy(F.desc("lead"), "place")  # over the candidate list only
    ranked = (reranked.withColumn("lead", lead).withColumn("rank", F.row_number().over(front))
              .filter(F.col("rank") <= limit).drop("lead"))
    top_score = F.first("score").over(Window.orderBy("rank").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))
    threshold = F.greatest(F.lit(CORE_MINIMUM), top_score * CORE_SHARE)
    core = (F.col("rank") <= max(4, min(limit, 8))) | (F.col("label").isin(*CORE_LABELS) & (F.col("score") >= threshold))
    return ranked.withColumn("is_core", core)


def snapshot_centers(reranked: DataFrame, core: DataFrame | None = None) -> DataFrame:
    """Up to three centres: readable labels first, then core results, then any candidate."""
    preferred = F.col("label").isin(*CENTER_LABELS)
    if core is None:
        choice = F.when(preferred, F.lit(0)).otherwise(F.lit(2))
        rows = reranked.withColumn("choice", choice)
    else:
        rows = (reranked.join(core.filter("is_core").select("id", "rank"), "id", "left")
                .withColumn("choice", F.when(preferred, F.lit(0)).when(F.col("rank").isNotNull(), F.lit(1))
                            .otherwise(F.lit(2))))
    return rows.orderBy("choice", "place").limit(CENTERS)


@dataclass(frozen=True)
class Snapshots:
    """``nodes (seed, place, id, label, name, description)`` and ``edges (seed, place, source, target, relationship)``."""

    nodes: DataFrame
    edges: DataFrame


def snapshots(retriever: Retriever, centers: Sequence[str], depth: int = 0) -> Snapshots:
    """A readable excerpt of each centre's neighbourhood, at most 24 nodes and 80 edges."""
    graph = retriever.graph
    hops = max(1, min(3, depth if depth > 0 else 2))
    levels = materialize(neighborhood_levels(graph, centers, hops, max_size=SNAPSHOT_SIZE), "levels")
    listed = levels.join(graph.nodes.select(
        "id", "label", F.coalesce("name", "id").alias("name"),
        F.substring(F.coalesce("description", F.lit("")), 1, 180).alias("description")), "id")
    nodes = materialize(listed.filter(F.col("label") != QUESTION_LABEL), "shown")
    ids = nodes.select("seed", "id")
    edges = materialize(
        level_edges(graph, levels)
        .join(ids.withColumnRenamed("id", "source"), ["seed", "source"], "left_semi")
        .join(ids.withColumnRenamed("id", "target"), ["seed", "target"], "left_semi"), "shown-edges")
    connected = edges.select("seed", F.explode(F.array("source", "target")).alias("id")).distinct()

    priority = (F.when(F.col("label").isin(STORY_LABEL, CODE_LABEL), F.lit(2))
                .when(F.col("label") == TERM_LABEL, F.lit(1)).otherwise(F.lit(0)))
    rows = (nodes.join(connected.withColumn("linked", F.lit(True)), ["seed", "id"], "left")
            .withColumn("priority", priority).withColumn("linked", F.coalesce("linked", F.lit(False))))
    preferred = F.col("priority") >= 1
    group = (F.when(F.col("id") == F.col("seed"), F.lit(0)).when(F.col("linked") & preferred, F.lit(1))
             .when(F.col("linked"), F.lit(2)).when(preferred, F.lit(3)).otherwise(F.lit(4)))
    within = [F.desc("priority"), (F.col("label") != TERM_LABEL).asc(), F.col("name"), F.col("id")]
    first = F.when(F.col("grp") == 2, (F.col("label") != ENTITY_LABEL).cast("int")).otherwise(F.lit(0))
    caps = F.create_map(*[F.lit(x) for pair in LABEL_CAPS.items() for x in pair])
    cap = F.coalesce(F.try_element_at(caps, F.col("label")), F.lit(OTHER_CAP))
    rows = rows.withColumn("grp", group).withColumn("first", first)
    of_label = Window.partitionBy("seed", "label").orderBy("grp", "first", *within)
    rows = rows.withColumn("fits", F.row_number().over(of_label) <= cap)
    taken = Window.partitionBy("seed", "fits").orderBy("grp", "first", *within)
    rows = (rows.withColumn("n", F.row_number().over(taken))
            .withColumn("chosen", F.col("fits") & (F.col("n") <= SNAPSHOT_NODES)))
    per_seed = Window.partitionBy("seed")
    rest = Window.partitionBy("seed", "chosen").orderBy(*within)
    rows = (rows.withColumn("kept", F.sum(F.col("chosen").cast("int")).over(per_seed))
            .withColumn("all", F.count(F.lit(1)).over(per_seed)).withColumn("r", F.row_number().over(rest)))
    sparse = (F.col("kept") < SNAPSHOT_MINIMUM) & (F.col("all") >= SNAPSHOT_MINIMUM)
    filler = ~F.col("chosen") & sparse & (F.col("kept") + F.col("r") <= SNAPSHOT_MINIMUM)
    place = F.when(F.col("chosen"), F.col("n")).otherwise(F.col("kept") + F.col("r"))
    final = materialize(rows.filter(F.col("chosen") | filler).select(
        "seed", place.cast("int").alias("place"), "id", "label", "name", "description"), "snapshot")
    ends = final.select("seed", "id")
    inner = (edges.join(ends.withColumnRenamed("id", "source"), ["seed", "source"], "left_semi")
             .join(ends.withColumnRenamed("id", "target"), ["seed", "target"], "left_semi"))
    order = Window.partitionBy("seed").orderBy("source", "relationship", "target")
    shown = inner.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SNAPSHOT_EDGES)
    return Snapshots(final, shown.select("seed", "place", "source", "target", "relationship"))


def cards(shots: Snapshots) -> DataFrame:
    """``(seed, place, source, relationship, target)``: the ten most telling edges of each snapshot.

    Edges at the centre come first, those to stories before those to code.
    """
    names = shots.nodes.select("seed", "id", "label", "name")
    center = names.filter(F.col("id") == F.col("seed")).select("seed", F.col("name").alias("center_name"))
    end = lambda side: names.select("seed", F.col("id").alias(side), F.col("label").alias(f"{side}_label"),
                                    F.col("name").alias(f"{side}_name"))
    rows = (shots.edges.join(end("source"), ["seed", "source"]).join(end("target"), ["seed", "target"])
            .join(center, "seed", "left"))
    touches = F.coalesce((F.col("source_name") == F.col("center_name")) | (F.col("target_name") == F.col("center_name")),
                         F.lit(False))
    has = lambda label: (F.col("source_label") == label) | (F.col("target_label") == label)
    rank: Column = (F.when(touches & has(STORY_LABEL), F.lit(0)).when(touches & has(CODE_LABEL), F.lit(1))
                    .when(touches, F.lit(2)).when(has(STORY_LABEL) & has(CODE_LABEL), F.lit(3)).otherwise(F.lit(4)))
    order = Window.partitionBy("seed").orderBy("rank", "relationship", "source", "target")
    return (rows.withColumn("rank", rank).withColumn("place", F.row_number().over(order))
            .filter(F.col("place") <= CARD_EDGES).dropDuplicates(["seed", "source", "relationship", "target"])
            .select("seed", "place", "source", "relationship", "target"))


def code_outlines(retriever: Retriever, reranked: DataFrame) -> DataFrame:
    """``(code_id, record_path, item_label, item_name, place)``: structure nodes next to the best code files."""
    graph = retriever.graph
    files = pin_top(reranked.filter(F.col("label") == CODE_LABEL).orderBy("place"), OUTLINE_FILES)
    ids = [r["id"] for r in files.collect()]
    if not ids:
        return graph.spark.createDataFrame(
            [], "code_id string, record_path string, item_label string, item_name string, place int")
    levels = neighborhood_levels(graph, ids, 1, max_size=OUTLINE_SIZE)
    items = levels.join(graph.nodes.filter(F.col("label").isin(*OUTLINE_LABELS)).select(
        "id", "label", F.coalesce("name", "id").alias("name")), "id")
    order = Window.partitionBy("seed").orderBy("id")
    top = (items.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= OUTLINE_ITEMS)
           .select("seed", F.col("label").alias("item_label"), F.col("name").alias("item_name"), "place"))
    own = graph.nodes.filter(F.col("id").isin(*ids)).select(
        F.col("id").alias("code_id"), F.nullif(record_path(F.col("id"), F.col("path")), F.lit("")).alias("rp"))
    return (own.join(top, F.col("code_id") == F.col("seed"), "left")
            .select("code_id", F.coalesce("rp", "code_id").alias("record_path"), "item_label", "item_name", "place"))


@dataclass(frozen=True)
class DefaultAnswer:
    results: DataFrame
    snapshots: Snapshots
    cards: DataFrame
    outlines: DataFrame


def search(retriever: Retriever, query: str, top_k: int = 10, depth: int = 0, label_filter: str = "",
           vector: Sequence[float] | None = None) -> DefaultAnswer:
    ranked = materialize(rerank(retriever, query, top_k, vector, label_filter), "reranked")
    results = materialize(order_results(ranked, top_k), "results")
    centers = [r["id"] for r in snapshot_centers(ranked, results).collect()]
    shots = snapshots(retriever, centers, depth) if centers else Snapshots(
        retriever.graph.nodes.limit(0), retriever.graph.edges.limit(0))
    return DefaultAnswer(results, shots, cards(shots) if centers else shots.edges, code_outlines(retriever, ranked))
