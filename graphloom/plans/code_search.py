"""Code search: code files ranked by meaning, wording and the community of matching terms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.links import is_outline_candidate, record_path
from graphloom.functions.scoring import confidence_bucket, safe_norm
from graphloom.functions.text import lexical_overlap, lexical_query_tokens, prioritised_aliases, token_hit_ratio
from graphloom.operators.neighborhood import neighborhood_levels
from graphloom.operators.relations import community_support
from graphloom.plans.retrieve import Retriever
from graphloom.schema import CODE_LABEL, ENTITY_LABEL, TERM_LABEL
from graphloom.session import materialize, together

# --- fixed values ------------------------------------------------------------
MAX_FILES = 8
RAW_WEIGHT, OVERLAP_WEIGHT, DEGREE_WEIGHT, LABEL_BONUS = 0.45, 0.30, 0.25, 0.10
DEGREE_SCALE = 20.0
ENTITY_DEGREE = 3
IMPORTANCE_FLOOR = 0.25
SUPPORT_TERMS, SUPPORT_HOPS, SUPPORT_SIZE = 6, 2, 260
FALLBACK_TERMS, FALLBACK_SIZE = 4, 200
PROBE_OVERLAP, PROBE_RAW = 0.6, 0.4
EXPANSION_QUERIES, EXPANSION_SCALE, COMMUNITY_SCALE = 6, 0.92, 0.85
LEXICAL_OVERLAP, LEXICAL_SPARSE = 0.45, 0.55
ALPHA_FLOOR = 0.82
GUARD_CEILING = 0.35
INTENT_WEIGHT, COMMUNITY_WEIGHT = 0.18, 0.55
EXPANSION_TERMS, EXPANSION_ALIASES = 8, 8
INTENT_SYNONYMS = {
    "抽卡": ["招募", "卡池", "up招募", "英雄抽卡", "tavern", "神秘屋", "stargazer", "gacha"],
    "招募": ["抽卡", "卡池", "up招募", "tavern", "神秘屋", "英雄抽卡", "stargazer", "gacha"],
    "卡池": ["抽卡", "招募", "up招募", "tavern", "神秘屋", "stargazer", "gacha"],
}
EXPANSION_PRIORITY = ["tavern", "招募", "卡池", "stargazer", "gacha", "抽卡"]
STRATEGIES = ("adaptive_guard", "baseline_hybrid", "advanced_rerank")
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class CodeOptions:
    top_k: int = 10
    max_files: int = 20
    alpha: float = 0.7
    strategy: str = "adaptive_guard"
    confidence_threshold: float = 0.35
    guard_weight: float = 0.65
    community_fallback: bool = True
    protect_top: int = 8
    score_threshold: float = 0.0
    synonyms: dict[str, list[str]] = field(default_factory=lambda: INTENT_SYNONYMS)

    @property
    def files(self) -> int:
        return max(1, min(self.max_files or self.top_k or 1, MAX_FILES))


def rank_terms(retriever: Retriever, query: str, top_k: int = 10,
               vector: Sequence[float] | None = None) -> DataFrame:
    """``(id, label, name, score, degree, importance, aliases)`` of terms and entities worth following."""
    fetch = max(top_k * 2, 12)
    of_terms, of_entities = together(*[
        lambda label=label: retriever.hits(query, fetch, label_filter=label, vector=vector)
        for label in (TERM_LABEL, ENTITY_LABEL)])
    hits = of_terms.unionByName(of_entities)
    best = hits.groupBy("id").agg(F.max_by(F.struct(*hits.columns), "score").alias("h")).select("h.*")
    ids = best.select(F.col("id").alias("a"))  # at most two hit lists long
    degree = retriever.graph.near(ids).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    top = hits.agg(F.max("score").alias("top"), F.lit(1).alias("one"))
    names = _aliases(best)
    rows = (best.withColumn("aliases", names).withColumn("one", F.lit(1)).join(degree, "id", "left")
            .join(F.broadcast(top), "one").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long"))))
    relevance = lexical_overlap(F.lit(query), F.concat_ws(" ", "name", F.array_join("aliases", " ")))
    importance = F.least(F.lit(1.0), F.lit(RAW_WEIGHT) * safe_norm(F.col("score"), F.col("top"))
                         + F.lit(OVERLAP_WEIGHT) * relevance
                         + F.lit(DEGREE_WEIGHT) * F.least(F.lit(1.0), F.col("degree") / F.lit(DEGREE_SCALE))
                         + F.when(F.col("label") == TERM_LABEL, F.lit(LABEL_BONUS)).otherwise(F.lit(0.0)))
    kept = (rows.withColumn("importance", F.round(importance, 9))
            .filter(~((F.col("label") == ENTITY_LABEL) & (F.col("degree") < ENTITY_DEGREE)))
            .filter(F.col("importance") >= IMPORTANCE_FLOOR))
    return kept.select("id", "label", "name", "score", "degree", "importance", "aliases")


def _term_order() -> list[Column]:
    return [F.desc("importance"), F.desc("degree"), F.desc("score"), F.col("name"), F.col("id")]


def _aliases(rows: DataFrame) -> Column:
    found = [F.when(F.size(F.coalesce(c, F.array())) > 0, F.col(c))
             for c in ("discovered_aliases", "aliases") if c in rows.columns]
    empty = F.array().cast("array<string>")
    return prioritised_aliases(F.coalesce(*found, empty), 5) if found else empty


def expanded_tokens(query: str, terms: DataFrame, synonyms: dict[str, list[str]]) -> list[str]:
    """Query tokens, synonyms of the intents they name, and words of the best terms; sorted."""
    tokens = set(lexical_query_tokens(query))
    for intent, names in synonyms.items():
        if intent in query.lower():
            for name in names:
                tokens.update(lexical_query_tokens(name))
    for row in terms.orderBy(*_term_order()).limit(EXPANSION_TERMS).collect():
        for name in [row["name"], *(row["aliases"] or [])[:EXPANSION_ALIASES]]:
            tokens.update(lexical_query_tokens(name or ""))
    return sorted(tokens)


def expansion_queries(tokens: Sequence[str], limit: int = EXPANSION_QUERIES) -> list[str]:
    """Priority words first, then other tokens of two or more characters."""
    first = [p for p in EXPANSION_PRIORITY if p in tokens]
    return (first + [t for t in tokens if t not in first and len(t) >= 2])[:limit]


def _candidates(hits: DataFrame, scale: float = 1.0) -> DataFrame:
    """Code hits the outline can read, one per path: ``(id, name, key, path_text, raw_score)``."""
    columns = hits.columns
    path = F.col("path") if "path" in columns else F.lit(None).cast("string")
    kind = F.col("file_type") if "file_type" in columns else F.lit(None).cast("string")
    located = record_path(F.col("id"), path)
    target = F.when(located != "", located).otherwise(F.col("id"))
    rows = (hits.withColumn("key", target).filter(is_outline_candidate(F.col("id"), F.col("key"), kind))
            .select("id", "name", "key", (F.col("score") * scale).alias("raw_score")))
    return (rows.groupBy("key").agg(F.max_by(F.struct("id", "name", "raw_score"), F.struct("raw_score", "id")).alias("r"))
            .select("r.id", "r.name", "key", "r.raw_score"))


def _file_text() -> Column:
    return F.concat_ws(" ", "name", "key")


def probe_confidence(items: DataFrame, query: str) -> float:
    """How well the direct hits already match: wording and relative score of the best one."""
    top = items.agg(F.max("raw_score")).first()[0] or 0.0
    value = (F.lit(PROBE_OVERLAP) * lexical_overlap(F.lit(query), _file_text())
             + F.lit(PROBE_RAW) * safe_norm(F.col("raw_score"), F.lit(top)))
    return items.agg(F.max(value)).first()[0] or 0.0


@dataclass(frozen=True)
class CodeAnswer:
    files: DataFrame
    terms: DataFrame
    confidence: float
    expansions: list[str]
    community_used: bool


def search(retriever: Retriever, query: str, options: CodeOptions = CodeOptions(),
           vector: Sequence[float] | None = None) -> CodeAnswer:
    """Ranked code files ``(rank, id, name, path, confidence, score, ...)`` and the related terms."""
    if options.strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    graph = retriever.graph
    adaptive = options.strategy == "adaptive_guard"
    fetch = max(options.files * 12, options.top_k * 10, 120)
    hits, terms = together(
        lambda: retriever.hits(query, fetch, label_filter=CODE_LABEL, vector=vector),
        lambda: materialize(rank_terms(retriever, query, options.top_k, vector), "terms"))
    best = terms.orderBy(*_term_order()).limit(SUPPORT_TERMS).collect()
    importance = {r["id"]: max(r["importance"], 0.0) or 0.1 for r in best}
    support = materialize(community_support(graph, importance, SUPPORT_HOPS, CODE_LABEL, SUPPORT_SIZE), "support") \
        if importance else graph.spark.createDataFrame([], "id string, support double")
    if hits.isEmpty() and best:
        hits = _community_hits(retriever, [r["id"] for r in best][:FALLBACK_TERMS - 1], FALLBACK_SIZE)

    items = materialize(_candidates(hits), "candidates")
    baseline = items
    tokens = expanded_tokens(query, terms, options.synonyms)
    confidence, asked, community_used = 0.0, [], False
    if adaptive and best:
        confidence = probe_confidence(items, query)
        if confidence < options.confidence_threshold:
            asked = [q for q in expansion_queries(tokens) if q != query.strip().lower()]
            found = together(*[lambda word=word: retriever.hits(
                word, max(options.max_files * 3, 30), label_filter=CODE_LABEL) for word in asked]) if asked else []
            for extra in found:
                items = _merge(items, _candidates(extra, EXPANSION_SCALE))
            items = materialize(items, "candidates")
            if options.community_fallback:
                nearby = _community_hits(retriever, [r["id"] for r in best][:FALLBACK_TERMS], SUPPORT_SIZE)
                grown = materialize(_merge(items, _candidates(nearby, COMMUNITY_SCALE)), "candidates")
                community_used = grown.count() > items.count()
                items = grown
    scored = score_files(retriever, query, items, baseline, support, tokens, options, vector)
    return CodeAnswer(scored, terms.orderBy(*_term_order()), confidence, asked, community_used)


def _community_hits(retriever: Retriever, terms: Sequence[str], size: int) -> DataFrame:
    """Code files next to the given terms, with score 0."""
    levels = neighborhood_levels(retriever.graph, terms, 1, max_size=size)
    files = retriever.graph.nodes.filter(F.col("label") == CODE_LABEL)
    extra = [c for c in ("path", "file_type") if c in files.columns]
    return (files.join(levels.select("id").distinct(), "id", "left_semi")
            .select("id", F.lit(0.0).alias("score"), "label", F.coalesce("name", "id").alias("name"), *extra))


def _merge(items: DataFrame, extra: DataFrame) -> DataFrame:
    """Add candidates whose path is not listed yet."""
    return items.unionByName(extra.join(items.select("key"), "key", "left_anti").select(*items.columns))


def score_files(retriever: Retriever, query: str, items: DataFrame, baseline: DataFrame, support: DataFrame,
                tokens: Sequence[str], options: CodeOptions, vector: Sequence[float] | None) -> DataFrame:
    """File scores: a mix of dense and lexical evidence plus intent and community boosts.

    ``adaptive_guard`` never falls below a weighted baseline and pins the best
    baseline file; the other strategies use one of the two scores alone.
    """
    wide = max(options.max_files * 4, 40)

    by_mode = dict(zip(("dense", "bm25"), together(*[
        lambda mode=mode: retriever.hits(query, wide, mode, CODE_LABEL, vector) for mode in ("dense", "bm25")])))

    def normed(mode: str, name: str) -> DataFrame:
        found = by_mode[mode].select("id", "score")
        top = found.agg(F.max("score").alias("top"), F.lit(1).alias("one"))
        return (found.withColumn("one", F.lit(1)).join(F.broadcast(top), "one")
                .select("id", safe_norm(F.col("score"), F.col("top")).alias(name)))

    peak = items.agg(F.coalesce(F.max("raw_score"), F.lit(0.0)).alias("peak"), F.lit(1).alias("one"))
    most = support.agg(F.coalesce(F.max("support"), F.lit(0.0)).alias("most"), F.lit(1).alias("one"))
    by_raw = Window.orderBy(F.desc("raw_score"), "name", "id")  # over the candidate list only
    protect = min(options.protect_top, 1) if options.strategy == "adaptive_guard" else 0
    pinned = (baseline.withColumn("base_place", F.row_number().over(by_raw))
              .filter(F.col("base_place") <= protect).select("key", "base_place"))
    rows = (items.withColumn("one", F.lit(1)).join(F.broadcast(peak), "one").join(F.broadcast(most), "one")
            .join(normed("dense", "dense_score"), "id", "left").join(normed("bm25", "bm25_score"), "id", "left")
            .join(support, "id", "left").join(pinned, "key", "left"))
    base = safe_norm(F.col("raw_score"), F.col("peak"))
    lexical = (F.lit(LEXICAL_OVERLAP) * lexical_overlap(F.lit(query), _file_text())
               + F.lit(LEXICAL_SPARSE) * F.coalesce("bm25_score", "baseline"))
    alpha = max(max(0.0, min(1.0, options.alpha)), ALPHA_FLOOR)
    guard = min(max(0.0, min(1.0, options.guard_weight)), GUARD_CEILING)
    intent = F.lit(INTENT_WEIGHT) * token_hit_ratio(
        F.array(*[F.lit(t) for t in tokens]).cast("array<string>"), _file_text())
    community = F.lit(COMMUNITY_WEIGHT) * safe_norm(F.coalesce("support", F.lit(0.0)), F.col("most"))
    rows = (rows.withColumn("baseline", base).withColumn("lexical", lexical)
            .withColumn("semantic", F.coalesce("dense_score", "baseline"))
            .withColumn("advanced", F.least(F.lit(1.0), F.lit(alpha) * F.col("semantic")
                                            + F.lit(1.0 - alpha) * F.col("lexical") + intent + community)))
    guarded = F.greatest("advanced", F.lit(guard) * F.col("baseline") + F.lit(1.0 - guard) * F.col("advanced"))
    final = {"baseline_hybrid": F.col("baseline"), "advanced_rerank": F.col("advanced"),
             "adaptive_guard": F.when(F.col("base_place").isNotNull(), F.greatest(guarded, "baseline")).otherwise(guarded)}
    rows = rows.withColumn("score", F.round(final[options.strategy], 9)).filter(
        F.col("score") >= max(0.0, options.score_threshold))
    order = Window.orderBy(F.col("base_place").asc_nulls_last(), F.desc("score"), F.desc("baseline"),
                           F.desc("raw_score"), "name", "id")  # over the candidate list only
    return (rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= options.files)
            .select("rank", "id", "name", F.col("key").alias("path"), confidence_bucket(F.col("score")).alias("confidence"),
                    "score", "baseline", "lexical", "semantic", "advanced"))
