"""Times the headline queries: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]. Prints one JSON line.

The shared tables (panel, baseline, components, ...) are written once and read back by every later job, as in production. Building
each of them is timed under its own name, before the queries that use it; the total counts both.
"""

from __future__ import annotations

import json
import os
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TABLES = ("panel", "edges", "reach", "baseline", "components", "bottlenecks", "diagnosed", "calibration", "segment_stats", "stretch_records", "sample_states")
HEADLINE = ("dedupe_first", "sanitized_panel", "sanitizer_report", "lag_features", "neighbor_means", "hops3", "legal_turns", "baseline", "local_drop",
            "snapshot_state", "events", "cause", "evidence", "snapshot_summary", "threshold_sweep", "detector_calibration", "prf_slots", "propagation", "propagation_evaluation",
            "residual_bands", "forecast_metrics", "segment_history_stats", "stretch_matches", "corridor_summary", "route_assessment", "route_ranking",
            "candidate_evaluation", "intervention_scores", "numeric_stats", "orphans", "profile_long", "detours", "operational_options", "corridor_candidates",
            "recommendations", "scenario_kpi_changes", "detected_zone_scores", "stream_sanitised", "stream_slot_means", "robustness")


def main() -> None:
    from pyspark.sql import SparkSession

    from roadlens.plans import catalog
    from roadlens.plans.city import city, release

    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("roadlens-bench").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    c, queries, times = city(spark, SF_DIR), catalog.queries(), {}
    for name in TABLES:
        start = time.perf_counter()
        getattr(c, name)
        times[f"table_{name}"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total time of shared tables and headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
