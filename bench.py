"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "log_search_page", "keyword_boolean", "keyword_whole_token", "log_histogram", "log_facets", "log_facets_approx", "log_context_batch",
    "trace_search_newest_summaries", "trace_search_slowest", "trace_summaries", "latency_heatmap", "error_groups", "db_calls_top_total", "span_tree",
    "service_stats", "service_overview", "compare_operations", "operation_movers", "service_timeseries",
    "metric_rate", "metric_histogram_quantile", "metric_top_series", "metric_counter_restarts",
    "cost_summary", "cost_breakdown_product", "alloc_detail", "alloc_lines", "cost_compare_30d",
)


def main() -> None:
    from telespark.plans import catalog
    from telespark.plans.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(cpus, partitions=max(2, int(cpus)) if cpus.isdigit() else 8, app="bench")
    catalog.QUERIES["log_count_levels"](spark, sf_dir).collect()          # start the executor threads
    seconds = {}
    for name in names:
        started = time.perf_counter()
        # everything is computed and written nowhere; only counts come back
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": float(sf.group(1)) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
