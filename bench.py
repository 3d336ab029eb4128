"""Time the headline queries over the driver tables; prints one JSON line.

Each query is run to its last row with a sink that discards rows, so everything it computes is
paid for. One untimed query warms the session up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.plans import catalog  # noqa: E402
from ledgerlens.session import get_session  # noqa: E402

HEADLINES = (
    "riskiest_transactions", "win_all_offline", "win_trades_1h", "rule_score",
    "project_log_columns", "user_profile", "merchant_profile", "device_profile", "enrich_profiles",
    "tx_edges", "entity_degree", "graph_nodes", "neighbor_mean", "components_of_transfers",
    "ring_features", "ring_threshold_sweep", "attach_graph_features", "diverse_order",
    "average_precision", "roc_auc", "calibrate_thresholds", "threshold_sandbox", "feedback_apply",
    "dq_transactions", "fit_logistic", "score_batch", "st_window_state", "st_score",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                        spark__driver__memory="8g", spark__log__level="ERROR")
    catalog.QUERIES["source_counts"](spark, folder).collect()
    times = {}
    chosen = sys.argv[1:] or HEADLINES
    for name in chosen:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    rows = spark.read.parquet(f"{folder}/events.parquet").count()
    derived = {
        "window_rows_per_sec": round(rows / times["win_all_offline"]) if "win_all_offline" in times else None,
        "scored_stream_rows_per_sec": round(rows / times["st_score"]) if "st_score" in times else None,
        "batch_scoring_ms_per_row": round(1000 * times["score_batch"] / rows, 4) if "score_batch" in times else None,
    }
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")), **derived}))
    spark.stop()


if __name__ == "__main__":
    main()
