"""Timings of headline queries: one JSON line. BENCH_SF_DIR (default sf0.1) and BENCH_CPUS set data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from palimpsest.catalog.queries import QUERIES
from palimpsest.catalog.views import VIEWS, Views

HEADLINE = [
    "src_06_segment_counts", "flt_11_active_corrections", "sig_01_boundary_flags", "sig_07_signal_flags", "sig_11_speaker_turns", "sig_12_event_proposals", "sig_13_worklist", "jon_02_latest_texts", "jon_04_verdict_counts",
    "agg_01_correction_stats", "agg_02_latest_gates", "agg_05_negative_regions", "agg_06_insert_spans", "agg_08_negatives", "prj_01_effective_spine", "pln_13_seams", "cmd_01_run_summary", "cmd_12_transfer_plan", "cmd_14_scan_mishomed", "str_02_replay",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    views = Views(spark, sf_dir)
    began = time.time()
    for name in VIEWS:  # the tables that queries start from; a workspace has them as Parquet
        views.view(name)
    views.effective.count()  # and the spine that most commands stand on
    prepared = round(time.time() - began, 2)
    took = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of headline queries and of the tables they start from", "value": round(sum(took.values()) + prepared, 2), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "prepare_views_sec": prepared}))
    spark.stop()


if __name__ == "__main__":
    main()
