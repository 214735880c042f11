"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores. The points are loaded once into a table with as many
files as cores, because the given file has a single row group that only one task can read. Searches run
on an index that is built and saved before they are timed; building is timed on its own. Every timed run
makes its DataFrame anew and is the second run of its query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession, functions as F  # noqa: E402

from boxquery import build_index, range_count, range_search  # noqa: E402
from boxquery.functions.hilbert import with_hilbert  # noqa: E402
from boxquery.operators import kmeans, order, report, runs, tiles  # noqa: E402
from boxquery.session import ship, written  # noqa: E402
from checks.fixtures import DIMS, boxes64, part_boxes, points3, supplier_boxes  # noqa: E402
from checks.queries import point_index  # noqa: E402


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("boxquery-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = session()
    loaded = written(points3(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism), "points")
    points = lambda: loaded.select("*")
    built = point_index(spark, sf_dir)
    few, some, many = boxes64(spark), supplier_boxes(spark, sf_dir), part_boxes(spark, sf_dir)
    total = lambda counts: counts.agg(F.sum("hits")).collect()
    drain = lambda df: df.write.format("noop").mode("overwrite").save()

    queries = {
        "p2_hilbert_key": lambda: drain(with_hilbert(points(), DIMS)),
        "o2_with_ordinal": lambda: drain(order.ordered(points(), DIMS)),
        "build_index": lambda: drain(build_index(points(), DIMS).nodes),
        "j1_few_boxes": lambda: total(range_count(points(), few, DIMS, "broadcast")),
        "j1_some_boxes": lambda: total(range_count(points(), some, DIMS, "broadcast")),
        "j8_few_boxes": lambda: total(range_count(points(), few, DIMS, "grid")),
        "j8_some_boxes": lambda: total(range_count(points(), some, DIMS, "grid")),
        "j8_many_boxes": lambda: total(range_count(points(), many, DIMS, "grid")),
        "j4_few_boxes": lambda: total(range_count(built, few, method="blocks")),
        "j4_some_boxes": lambda: total(range_count(built, some, method="blocks")),
        "j4_many_boxes": lambda: total(range_count(built, many, method="blocks")),
        "j5_few_boxes": lambda: total(range_count(built, few, method="levels")),
        "j5_some_boxes": lambda: total(range_count(built, some, method="levels")),
        "j5_many_boxes": lambda: total(range_count(built, many, method="levels")),
        "j6_few_boxes": lambda: total(range_count(built, few, method="partitions")),
        "j7_few_boxes": lambda: total(range_count(built, few, method="packed")),
        "j10_few_boxes": lambda: total(range_count(built, few, method="ranges")),
        "j2_search": lambda: drain(range_search(built, few)),
        "j3_first_10": lambda: drain(range_search(built, few, limit_per_query=10)),
        "j9_scan_ranges": lambda: drain(runs.scan_ranges(built, few)),
        "j11_tile_overlaps": lambda: drain(tiles.tile_overlaps(built.blocks, DIMS)),
        "j12_least_enlargement": lambda: drain(tiles.assign_least_enlargement(points(), few, DIMS)),
        "j13_worst_pair": lambda: drain(tiles.worst_pair(built.points, DIMS)),
        "o6_adaptive_tiles": lambda: drain(order.adaptive_tiles(built.points, DIMS)),
        "k2_16": lambda: drain(kmeans.assign_nearest(points(), DIMS, kmeans.pick_seeds(points(), DIMS, 16))),
        "k2_1000": lambda: drain(kmeans.assign_nearest(points(), DIMS, kmeans.pick_seeds(points(), DIMS, 1_000))),
        "k2_20000": lambda: drain(kmeans.assign_nearest(points(), DIMS, kmeans.pick_seeds(points(), DIMS, 20_000))),
        "k3_1000_clusters_3_rounds": lambda: kmeans.kmeans(points(), DIMS, 1_000, tol=0.0, max_iter=3),
        "m1_pruning_report": lambda: drain(report.pruning_report(built, few)),
    }
    wanted = sys.argv[1:]
    seconds = {}
    for name, run in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        run()
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
