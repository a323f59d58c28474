"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line of seconds."""

from __future__ import annotations

import json
import os
import statistics
import time

from voxelweave.plans import catalog
from voxelweave.session import local_session

HEADLINE = [
    "mask_stats", "mask_status", "axial_extent", "mask_runs", "mask_overlap", "surface_points", "erode_iter", "erosion_profile", "components_3d", "slab_assign", "series_geometry", "select_series",
    "series_equivalence", "consolidate_states", "extent_gaps", "study_sessions", "case_peaks", "queue_matrix", "next_pending", "purge_plan", "fanout_egress", "bone_qc", "steatosis", "job_closure",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus, os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    known, took = catalog.queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(1 + int(os.environ.get("BENCH_REPEATS", "3"))):  # the first warms up
            began = time.time()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
            spark.catalog.clearCache()
        took[name] = round(statistics.median(runs[1:] or runs), 3)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0), "cpus": cpus}))


if __name__ == "__main__":
    main()
