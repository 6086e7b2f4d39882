"""Times the headline queries on BENCH_SF_DIR with local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH", "")]))

HEADLINE = (
    "interval_metrics", "flow_metrics", "rtt_histogram", "capture_events", "evidence_page", "flow_classification", "endpoint_rollup", "tiered_match",
    "asof_label", "drop_events", "multiway_join", "top_k_groups", "window_session", "bm25_topk", "vector_topk", "rrf_fusion", "ir_metrics", "chunk_documents",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from capsight.plans import registry

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # starts the session before anything is timed
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir}))


if __name__ == "__main__":
    main()
