"""Headline throughput: seconds per query at $BENCH_SF_DIR on local[$BENCH_CPUS], one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cadaspark.plans import catalog  # noqa: E402

HEADLINE = [
    "screening_summary", "risk_score", "advisory_flags", "plot_units", "ring_area", "self_intersection",
    "traverse_forward", "nearest_river", "nearest_road", "building_rings", "landuse_conflicts", "outfall_asset",
    "registry_match", "prior_report", "slope_pct", "internal_profile", "feed_merge", "lga_benchmark", "compare_reports",
    "assemble_report", "screen_parcels", "parse_auto", "extract_parcels", "input_hazard", "redact_full",
]
ALIASES = {"ring_area": "area_ha"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-bench-"))
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    timings: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[ALIASES.get(name, name)](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    parcels = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")), "parcels": parcels,
                "parcels_per_sec_screened": round(parcels / timings["screen_parcels"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
