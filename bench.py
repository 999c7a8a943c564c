"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from netloom import catalog

HEADLINE = ["netlist_edges", "sta_summary", "sta_multi_clock", "critical_path_trace", "rudy_grid", "rudy_node_congestion", "node_features", "message_pass_softmax", "fanin_cone_sizes", "keyword_topk", "chunk_text", "cosine_topk", "regression_metrics", "auc_roc", "conflict_reconcile", "design_report", "star_join_agg", "window_frames"]

#: Timed besides, not part of the total.
FURTHER = ["bench_sta", "cyclic_sta", "cone_sta", "timing_embedding", "global_attention", "gps_block", "index_search", "hybrid_answer", "event_numbers"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["netlist_nodes"](spark, folder).write.format("noop").mode("overwrite").save()  # compiles and warms
    times = {}
    for name in HEADLINE + FURTHER:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    scale = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times[n] for n in HEADLINE), 3), "unit": "sec", "queries": times, "sf": float(scale[1]) if scale else None}))


if __name__ == "__main__":
    main()
