"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import checks  # noqa: E402
from fieldflux.session import build  # noqa: E402

HEADLINE = [
    "e01_median_composite",
    "f01_gradient",
    "e04_nearest_quantiles",
    "e05_conditional_quantiles",
    "c22_longwave_net_radiation",
    "c30_latent_heat_et",
    "i01_stability_iteration",
    "d08_pixels_in_parcels",
    "e07_zonal_statistics",
    "e07_et_zonal_statistics",
    "e12_dissolve_attributes",
    "d02_parcel_to_tile",
    "d10_tile_scene_match",
    "d07_nearest_wind",
    "e08_trajectory",
    "m04_stratified_folds",
    "m11_metrics",
    "m14_threshold_sweep",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(
        f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "16g", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # The first query also pays for starting the session's code paths.
    checks.QUERIES["c01_safe_divide"](spark, path).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.perf_counter()
        checks.QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(path.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
