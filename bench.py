"""Headline timings: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is built and fully evaluated (collected result is small), timed
wall-clock including its driver-side statistics jobs.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    ("flagship", "q01_price_incident_by_category"),
    ("area_rollup", "a01_incident_rollup"),
    ("listing_fill_v1", "a08_listing_fill_v1"),
    ("ols_hc3_v2_listing", "m05_ols_coefficients_v2"),
    ("ols_hc3_wide_8_terms", "m04_ols_hc3_wide"),
    ("area_ridge_cv", "m21_area_model_metrics"),
    ("permutation_importance", "m18_permutation_importance_linear"),
    ("stream_rollup", "t01_stream_incident_rollup"),
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from arealens.catalog import QUERIES
    from arealens.session import get_spark
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                      extra={"spark.driver.memory": "16g"})
    # warm the JVM and the Python workers once (not timed)
    QUERIES["a01_incident_rollup"](spark, sf_dir).collect()
    times = {}
    for label, name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).collect()
        times[label] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
