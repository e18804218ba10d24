"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from shelfrank.plans import registry

HEADLINE = [
    "interactions", "sparsity_analysis", "user_behavior", "item_pareto", "split_temporal", "popularity_topn_unseen", "segment_popularity_topn",
    "item_neighbours", "knn_item_predict", "tfidf", "content_topn", "demographic_topn", "metrics_at_k", "events_session",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="spark-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", f"{folder}/local").config("spark.sql.warehouse.dir", f"{folder}/warehouse").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["events_session"](spark, sf).count()  # compiles and warms up
    took = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        began = time.monotonic()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.monotonic() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
