"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import time

from lexigrain.plans import registry
from lexigrain.session import local_session

HEADLINE = [
    "R2_postings", "R3_lexical_search", "R4_dense_search", "R7_hybrid_rrf_topk", "R8_rerank", "C9_chunks", "C9d_hard_split", "G7_grounding_report",
    "V0_apply_rules", "V31_needs_review", "A7_span_f1", "A9_precision_at_recall", "A10_score_cases", "A13_score_paired", "A17_ablation", "A20_build_split",
    "A24_length_stats", "A31_budget_stop", "T1_latency_histogram",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cpus, max(8, int(cpus) if cpus.isdigit() else 8), os.environ.get("BENCH_MEMORY", "12g"), "lexigrain-bench")
    registry.QUERIES["S7_text_index"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
