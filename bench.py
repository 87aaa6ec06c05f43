"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import tempfile
import time
from pathlib import Path

from gapweave import catalog
from gapweave.session import session

HEADLINE = (
    "summary_by_method", "summary_by_entropy_bin", "combined_comparison", "run_summary", "rank_in_group", "top_bottom_k", "resume_anti_join", "bucket_filter",
    "corr_matrix", "kruskal_h", "mannwhitney_u", "fdr_bh", "moran_i", "raster_entropy", "fill_nearest", "fill_idw", "metric_psnr", "metric_sam", "bootstrap_ci", "evaluate_pipeline",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.checkpoint.dir": tempfile.mkdtemp()})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    took = {}
    queries["summary_by_method"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compiler
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(Path(sf_dir).name.removeprefix("sf") or 0) if Path(sf_dir).name.startswith("sf") else sf_dir}))


if __name__ == "__main__":
    main()
