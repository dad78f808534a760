"""Time the headline queries: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from airlens.plans import catalog  # noqa: E402,F401
from airlens.plans.registry import QUERIES  # noqa: E402
from airlens.session import get_session  # noqa: E402

HEADLINE = [
    "ts_integrity", "ts_header", "continuity_errors", "pcr_discontinuities", "scramble_stats", "strip_filter", "packets_with_class",
    "rtp_gaps", "rap_groups", "channel_bitrate", "receiver_collisions", "repair_lookup", "repair_match", "burst_admission", "nack_pressure",
    "latest_snapshots", "group_families", "guide_stats", "guide_window", "match_names_fuzzy", "package_services", "doc_reassembly", "teletext_cues",
    "throttle", "audio_frames", "service_list",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").count()  # start the engine
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
