"""The grid joins of large sides: what Spark shuffles, whole cells, and how many candidates are looked at."""

import re

import pytest
from pyspark.sql import functions as F

from boxquery import range_count
from boxquery.operators import grid, tiles
from boxquery.session import written
from checks.fixtures import DIMS, flat_boxes, order_boxes, part_boxes, points3

PLANE = ("a", "b")


def text_of(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)


def counted(df):
    return sorted(map(tuple, df.collect()))


def test_many_boxes_are_not_broadcast_by_a_wrong_estimate(spark, sf_dir):
    """An explode multiplies rows that Spark's estimate of the boxes does not have."""
    boxes = part_boxes(spark, sf_dir)
    found = range_count(points3(spark, sf_dir), boxes, DIMS, "grid", broadcast_rows=0)
    text = text_of(found)
    assert "SortMergeJoin" in text
    # only the hot keys are broadcast, one list for each side
    assert len(re.findall("BroadcastHashJoin", text)) == 2
    assert counted(found) == counted(range_count(points3(spark, sf_dir), boxes, DIMS, "broadcast"))


def test_whole_cells_at_the_borders(spark):
    """Points on cell borders, at the ends and beyond them, in boxes that hold cells whole or only touch them."""
    steps = [-0.5, 0.0, 0.125, 0.1250001, 0.25, 0.5, 0.75, 0.9999999, 1.0, 1.5]
    points = spark.createDataFrame([(x, y) for x in steps for y in steps] + [(None, 0.5)], "a float, b float")
    sides = [(0.0, 1.0), (-1.0, 2.0), (0.125, 0.5), (0.1250001, 0.75), (0.25, 0.25), (0.0, 0.9999999), (0.5, 1.0)]
    lines = [(i * 10 + j, *x, *y) for i, x in enumerate(sides) for j, y in enumerate(sides)]
    boxes = spark.createDataFrame(lines, "qid long, la float, ha float, lb float, hb float")
    wanted = counted(range_count(points, boxes, PLANE, "broadcast"))
    assert counted(range_count(points, boxes, PLANE, "grid", broadcast_rows=0)) == wanted
    assert counted(range_count(points, boxes, PLANE, "grid", broadcast_rows=0, cells=1)) == wanted


def candidates_per_pair(df, pairs):
    """Rows that leave the joins without their conditions on the bounds, for each row of the result."""
    return df.count() / pairs


@pytest.mark.parametrize("large", (False, True))
def test_overlaps_look_at_few_other_pairs(spark, sf_dir, large, request):
    if large:
        request.getfixturevalue("few_rows")
    rows = written(order_boxes(spark, sf_dir), "orders")
    found = counted(tiles.tile_overlaps(rows, PLANE, "pid"))
    wanted = rows.alias("l").join(rows.alias("r"), F.expr("l.pid < r.pid AND l.la <= r.ha AND r.la <= l.ha AND l.lb <= r.hb AND r.lb <= l.hb"))
    assert found == counted(wanted.selectExpr("l.pid", "r.pid"))
    a = grid._numbered(rows, PLANE, ["pid"])
    alike = grid._meeting(a, a, PLANE, "v = own", grid.BROADCAST_ROWS, ("a", "b"), alike=True)
    other = grid._meeting(a, a, PLANE, "v < own", grid.BROADCAST_ROWS, ("a", "b"))
    assert candidates_per_pair(alike.unionByName(other), len(found)) < 2


def test_work_on_pairs_is_dealt_out(spark, sf_dir, monkeypatch):
    """The rows of one small file make work for all cores."""
    monkeypatch.setattr(grid, "BROADCAST_ROWS", 0)
    boxes, rows = flat_boxes(spark, sf_dir).coalesce(1), written(order_boxes(spark, sf_dir).coalesce(1), "one-file")
    found = grid.overlap_pairs(boxes, rows, PLANE, ["qid"], ["pid"])
    assert found.rdd.getNumPartitions() >= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
