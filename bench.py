"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lodestar import registry

HEADLINE = (
    "topk_cosine", "topk_l2", "topk_dot", "knn_batch_cosine", "knn_batch_l2", "knn_batch_dot", "lineitem_vector_topk", "latest_per_key", "upsert_report",
    "seal_segments", "merge_segments_equals_live", "shard_histogram", "ivf_full_probe_topk", "jsonl_ingest_roundtrip", "search_after_upserts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}

    def run(name: str) -> float:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    for name in HEADLINE:
        run(name)  # compiles
        took[name] = round(min(run(name) for _ in range(2)), 3)
    rate = {}
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    rate["knn_pairs_a_second"] = round(n * -(-n // 20) / took["knn_batch_cosine"])
    rate["fold_rows_a_second"] = round(spark.read.parquet(f"{sf_dir}/events.parquet").count() / took["latest_per_key"])
    rate["ingest_rows_a_second"] = round(spark.read.parquet(f"{sf_dir}/events.parquet").count() / took["jsonl_ingest_roundtrip"])
    rate["lineitem_vectors_a_second"] = round(spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() / took["lineitem_vector_topk"])
    print(json.dumps({"metric": "total_seconds_of_headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rates": rate, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
