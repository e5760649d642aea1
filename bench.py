"""Time the headline queries on one data folder and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. The stored graph, its link table and the text index are built
once and timed as ``build_*``; queries then run on them, as a user's would.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "label_counts", "schema_relationships", "degree", "related_both", "khop_nodes", "khop_edges", "khop_through_hubs",
    "khop_rel_filtered", "subgraph_nodes", "traverse_layers", "shortest_path_hops", "ppr_scores", "ppr_expand",
    "merge_nodes_edges", "tree_reparent", "bm25_topk", "dense_topk", "snippet_maxpool", "rrf_hybrid", "hybrid_labelled",
    "exact_term_match", "lexical_overlap", "default_results", "code_rerank", "index_only", "chunk_documents",
    "chunk_incremental", "pending_page", "proposal_stats", "question_stats", "message_runs", "sql_inner_join", "sql_window_rank",
]


def main() -> None:
    from graphloom import build_session
    from graphloom.catalog import QUERIES
    from graphloom.catalog.registry import Context

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("graphloom-bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, step):
        started = time.perf_counter()
        try:
            step()
        except Exception as error:  # keep the line whole; the failure shows as a null time
            print(f"{name}: {error}", file=sys.stderr)
            times[name] = None
            return
        times[name] = round(time.perf_counter() - started, 3)

    context = Context(spark, folder)
    timed("build_graph", lambda: context.graph)
    timed("build_links", lambda: context.graph.links)
    timed("build_index", lambda: context.retriever)
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save())
    total = round(sum(t for t in times.values() if t is not None), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
