"""Time the headline queries. Prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` the timed runs after one warm
run (the median counts), ``BENCH_ALL=1`` takes every registered query.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from statera.plans import load
from statera.session import build_session

HEADLINE = (
    "e9_audit_batch",
    "d7_match_sentences",
    "c1_chunk_paragraphs",
    "c2_chunk_windows_fixed",
    "c2_chunk_windows_boundary",
    "b1_normalize_text",
    "b4_html_to_text",
    "c6_section_hierarchy",
    "c9_split_sentences",
    "c16_mask_pii",
    "d1_knn",
    "d1_knn_blocks",
    "d2_match_chunks",
    "d6_retrieve_with_context",
    "a15_upsert_points",
    "d10_drop_known_documents",
    "d12_invalidate_by_source",
    "d13_audit_trail",
    "f2_source_versions",
    "d9_merge_pages",
    "e11_log_statistics",
    "e13_corpus_breakdown",
    "e22_latency_profile",
    "e29_monthly_usage",
    "e36_verify_citations",
    "f6_running_quota",
    "f7_requests_in_window",
    "j3_latency_quantiles",
    "j5_admit",
    "k4_recall",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench", cpus, int(os.environ.get("BENCH_SHUFFLE", cpus)))
    catalog = load()
    names = list(catalog) if os.environ.get("BENCH_ALL") else HEADLINE
    times: dict[str, float] = {}
    for name in names:
        took = []
        for _ in range(runs + 1):
            t0 = time.perf_counter()
            catalog[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(took[1:] or took), 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main()
