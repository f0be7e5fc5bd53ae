"""Times the headline queries: ``BENCH_SF_DIR``, ``BENCH_CPUS``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from emberline import plans  # noqa: E402
from emberline.session import build_session  # noqa: E402

HEADLINE = [
    "parse_linux", "parse_bgl", "enrich_logs", "processed_messages", "lake_partitions", "round_robin", "running_totals",
    "build_vocabulary", "message_embedding", "log_vector", "sliding_windows", "window_labels", "fit_threshold",
    "classification_report", "ml_payload", "board_rows", "board_kpis", "dedup_anomalies", "new_incidents",
    "search_board", "align_rate", "pca_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
                          spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    plans.QUERIES["enrich_logs"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    took: dict[str, float] = {}
    for name in names:
        started = time.time()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - started, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "cores": cpus, "log_rows": rows,
                      "enriched_rows_per_sec": round(rows / took["enrich_logs"]) if took.get("enrich_logs") else None}))


if __name__ == "__main__":
    main()
