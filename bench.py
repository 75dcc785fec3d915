"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postmill.queries import load, registry  # noqa: E402
from postmill.session import local_session  # noqa: E402

HEADLINE = [
    "market_view", "salary_by_group", "skill_premium", "correlation_matrix", "top_employers", "deduplicate_latest",
    "assemble_features", "keyword_flags", "split_sections", "weekly_snapshot", "career_graph", "analyze_personas",
    "processed_gates", "segment_quality", "reconcile", "snapshot_delta", "match_profiles", "digest_matches",
    "weekly_cohorts", "sanitize_events",
]


def main() -> None:
    load()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in HEADLINE if n in registry.SPARK]
    for name in names[:1]:  # start the executors and the code generator
        registry.SPARK[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        registry.SPARK[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
