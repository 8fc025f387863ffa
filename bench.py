"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (data folder) and ``BENCH_CPUS`` (local cores).
"""

from __future__ import annotations

import json
import os
import sys
import time

from scenewright.plans.registry import registered
from scenewright.session import get_spark

HEADLINE = [
    "d18_assign_caption", "d14_components", "d13_staircases", "d08_horizontal_runs", "d04_floor_class",
    "e05_compare_captions", "e18_build_vocab", "e19_encode", "f01_best_caption_match",
    "f02_novel_captions", "f03_mean_edit_distance", "f04_mean_cross_distance", "f09_knn_cosine",
    "g03_phrase_prf", "g12_curve_aggregate", "h03_running_best", "h10_split", "c01_sliding_windows",
    "c04_unique_patches",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark("bench")
    spark.sparkContext.setLogLevel("OFF")
    runs = {name: run for name, (run, _) in registered().items()}
    names = sys.argv[1:] or HEADLINE
    runs[names[0]](spark, sf_dir).limit(1).collect()  # start the workers
    timings = {}
    for name in names:
        start = time.time()
        runs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
        print(f"{name}: {timings[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
