"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from faultline.plans.queries import QUERIES  # noqa: E402
from faultline.session import build_session  # noqa: E402

HEADLINE = (
    "normalize_lines",
    "normalize_loki",
    "normalize_es",
    "normalize_cloudwatch",
    "normalize_datadog",
    "normalize_gcl",
    "error_events",
    "damaged_responses",
    "parse_timestamp",
    "merge_sources",
    "clock_offset",
    "time_range",
    "error_bursts",
    "cascades",
    "cascade_trace",
    "cascade_chains",
    "drift_warnings",
    "suggest_offsets",
    "anomaly",
    "volume_rates",
    "silence",
    "silence_ticks",
    "correlate",
    "result_json",
    "run_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session("faultline-bench", master=f"local[{cpus}]", partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    timings = {}
    for name in names:
        run(name)  # warm-up: class loading and code generation
        timings[name] = run(name)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
