"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barflow.session import local_session  # noqa: E402
from checks.spark_side import all_queries  # noqa: E402

HEADLINE = [
    "clean_bars", "macd", "adx", "build_features", "asof_ffill", "market_summary", "sector_summary", "breadth_summary",
    "symbol_sentiment", "component_metrics", "reliability_report", "stable_signal", "analyze", "walk_forward",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(app="bench")
    queries = all_queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").limit(1).count()
    seconds = {}
    for name in HEADLINE:
        if name not in queries:
            continue
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(sorted(times)[len(times) // 2], 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
