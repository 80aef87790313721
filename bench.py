"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidegrid.queries import load_all  # noqa: E402
from tidegrid.session import local_session  # noqa: E402

HEADLINE = [
    "regime_episodes", "asof_backward_limited", "rolling_moments", "rolling_quantile_flags", "rolling_ranks", "ewm_macd", "pack_level", "pack_regime", "pack_cross_asset", "calendar_cohorts",
    "transition_event_study", "multi_series_event_study", "continuous_contracts", "gate_status", "decision_search", "outcome_backfill", "calibrated_detector_scores", "isolation_scores",
    "exact_group_quantiles", "tick_rolling_chunks", "tick_running_chunks", "supplier_series_features", "part_series_features", "stream_hourly_bars",
    "pack_meta", "matrix_commodity_columns", "unseen_score_levels",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("tidegrid-bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the executors
    took = {}
    for name in names:
        t0 = time.perf_counter()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
