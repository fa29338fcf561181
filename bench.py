"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder of the driver's tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8).
Each query runs once to warm up and then BENCH_RUNS times (default 2); the median counts. grid_1100k is the whole grid estimate
over 1100 x 1000 pixels of 100 m.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession

from geovelo.operators.raster import Grid
from geovelo.plans import fixtures, pipeline
from geovelo.plans import queries as plans

HEADLINE = (
    "cpt_stress", "cpt_ic_qtn", "vs_robertson", "vs_kwak", "profile_truncate", "vsz", "vs30_boore_2011", "weighted_vs30", "profile_average", "combine_stdv_weight", "bayes_posterior", "cluster_sites",
    "raster_lookup", "point_in_polygon", "coast_distance", "project_nztm", "mvn_neighbours", "mvn_full", "points_pipeline", "grid_pipeline", "sounding_pipeline",
)
GRID = Grid(fixtures.X0, fixtures.Y0 + 100_000, 100.0, -100.0, 1100, 1000)


def grid_1100k(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = fixtures.sites(spark, sf_dir).drop("gid", "tid")
    return pipeline.estimate_grid(GRID, sites, plans._layers(spark, sf_dir))


def main() -> None:
    sf_dir, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "2"))
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    todo = {name: plans.QUERIES[name] for name in HEADLINE} | {"grid_1100k": grid_1100k}
    took: dict[str, float] = {}
    for name, query in todo.items():
        times = []
        for _ in range(1 + runs):
            began = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:] or times), 3)
    rate = round(GRID.nx * GRID.ny / took["grid_1100k"])
    print(json.dumps({"metric": "sum of median seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "grid_pixels_per_second": rate}))


if __name__ == "__main__":
    main()
