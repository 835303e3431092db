"""Time the headline queries and print one JSON line.

Each query is planned and run to the end (no result is collected) on
``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``. One small query warms the session.
"""
from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from entry_queries.registry import QUERIES  # noqa: E402

HEADLINE = (
    "scan_fixtures sanitize_numeric standardize_teams merge_match_stats clean_fixtures missing_profile "
    "player_absences absence_distribution poisson_observations empirical_ratings team_last_n "
    "rating_window_members poisson_ratings rolling_ratings expected_goals_summary elo_asof rolling_form "
    "rolling_xg rest_days head_to_head feature_table adjusted_lambda scoreline_grid outcome_probabilities "
    "walk_forward_folds brier_trend"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pitchframe-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["validate_fixtures"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
