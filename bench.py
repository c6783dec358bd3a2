"""Time the headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` names the tables (default sf 0.1), ``BENCH_CPUS`` the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = (
    "a1_csv_scan",
    "b12_fields_per_line",
    "c2_one_hot",
    "c5_zscore",
    "p3_projection",
    "x5_distances_to_centers",
    "k1_lloyd_lines",
    "k1_library_lines",
    "k14_two_level_assignment",
    "k18_sweep_over_k",
    "t2_nth_largest",
    "t3_percent_ascending",
    "l5_weighted_centroid_lof",
    "l6_lof_detector",
    "l8_exact_lof_lines",
    "l9_ties_kept",
    "v1_support_vector_scores",
    "v2_one_class_training_unscaled",
    "e7_threshold_grid",
    "s5_streamed_judgements",
    "detector_majority_label",
    "detector_centroid_distance",
    "detector_two_level",
    "detector_weighted_lof",
)


def main() -> None:
    from farpoint.catalog import QUERIES
    from farpoint.session import build_session, ship_package

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    QUERIES["k5_assign"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM and workers
    wanted = sys.argv[1:] or HEADLINES
    timings: dict[str, float] = {}
    for name in wanted:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
