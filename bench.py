"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default the list below), BENCH_RUNS (default 1).
Each query runs once to warm up and then BENCH_RUNS times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera import queries as registry  # noqa: E402
from tessera.session import build_session, clear_work  # noqa: E402

HEADLINE = (
    "scan_projected", "add_column_batch", "write_merge", "write_dedupe",
    "vector_search_flat", "vector_search_filtered", "vector_knn_join", "topk_per_query",
    "ivf_build", "vector_search_ivf", "ivf_knn_join", "vector_search_mixed", "index_optimize", "index_merge",
    "pq_build", "vector_search_refine", "knn_recall",
    "fts_build", "fts_search", "btree_lookup", "bitmap_lookup",
    "concat_sources", "hash_embedding", "embed_incremental", "vectorize_table", "model_embedding",
    "ttl_delete", "delete_rows", "compact", "tier_assign",
    "lifecycle_plan", "index_watch_emit", "catalog_reconcile", "catalog_apply", "index_properties",
    "histogram_quantile", "task_state_durations", "claim_order", "latest_event_per_task",
    "stream_embed_on_insert", "stream_index_append", "stream_task_rate", "stream_worker_sessions",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    registry.load_all()
    spark = build_session("tessera-bench", **{
        "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    clear_work(spark)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
