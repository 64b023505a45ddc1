"""Time the headline queries and print one JSON line."""
import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from capstrata.plans.catalog import QUERIES  # noqa: E402
from capstrata.session import local_session  # noqa: E402

HEADLINE = ["stream_timing", "slot_gaps", "sensor_interval_stats", "annotation_window_frames", "quality_flags", "selected_views", "covisible_partners",
            "track_metrics", "ratio_matches", "voxel_average", "plane_labels", "plane_view_samples", "depth_support", "zbuffer_visible", "region_roles",
            "ceiling_height", "room_rectangle", "plan_raster", "dedupe_assets", "asset_identity", "audit_diff", "lineage_breaks",
            "two_core_views", "view_components", "cell_components", "revisit_pairs", "leave_one_out"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    QUERIES["state_counts"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
