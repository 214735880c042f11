import itertools
import math

import pytest
from pyspark.sql import functions as F

from boxquery.functions.boxes import Box, enlargement, sphere_volume, union, unit_sphere_volume, volume
from boxquery.operators import tiles
from boxquery.operators.order import adaptive_tiles
from checks.fixtures import boxes64, order_boxes
from tests.brute import overlapping

DIMS = ("x", "y", "z")


def sphere(low, high):
    radius = math.sqrt(sum(((h - l) * 0.5) ** 2 for l, h in zip(low, high)))
    power = radius
    for _ in range(len(low) - 1):
        power *= radius
    return power * unit_sphere_volume(len(low))


def corners(r, dims):
    return [r[f"l{d}"] for d in dims], [r[f"h{d}"] for d in dims]


def joined(a, b):
    return [min(x, y) for x, y in zip(a[0], b[0])], [max(x, y) for x, y in zip(a[1], b[1])]


def test_unit_sphere_volumes():
    # Volumes of the unit sphere in one to five dimensions.
    known = [2.0, 3.141593, 4.188790, 4.934802, 5.263789]
    assert [round(unit_sphere_volume(d), 6) for d in range(1, 6)] == known


def test_box_functions(spark):
    rows = spark.createDataFrame(
        [(0.0, 0.0, 0.5, 1.0, 0.25, 0.25, 2.0, 0.5)], "lp float, lq float, hp float, hq float, ls float, lt float, hs float, ht float"
    )
    a = Box([F.col("lp"), F.col("lq")], [F.col("hp"), F.col("hq")])
    b = Box([F.col("ls"), F.col("lt")], [F.col("hs"), F.col("ht")])
    both = union(a, b)
    got = rows.select(*both.lo, *both.hi, volume(a), sphere_volume(a), enlargement(a, b)).first()
    grown = sphere([0, 0], [2, 1]) - sphere([0, 0], [0.5, 1])
    assert list(got) == pytest.approx([0, 0, 2, 1, 0.5, sphere([0, 0], [0.5, 1]), grown])


def test_tile_cells_hold_their_rows(index):
    rows = adaptive_tiles(index.points, DIMS, 64)
    bounds = tiles.tile_bounds(tiles.tile_summary(rows, DIMS), DIMS)
    scaled = lambda c: f"cast(cast(1000000 AS float) * {c} AS bigint)"
    wrong = " OR ".join(f"{scaled('l' + d)} < cl{d} OR {scaled('h' + d)} > ch{d}" for d in DIMS)
    assert bounds.count() > 50 and bounds.filter(wrong).count() == 0
    boxes = tiles.tile_cell_boxes(bounds, DIMS)
    assert boxes.filter("lx < 0 OR hx > 1.048576 OR hx <= lx").count() == 0


def test_tile_overlaps_match_all_pairs(index):
    data = index.blocks.collect()
    want = {(a.block, b.block) for a in data for b in data if a.block < b.block and overlapping(a, b, DIMS)}
    got = [tuple(r) for r in tiles.tile_overlaps(index.blocks, DIMS).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("chunk", [500_000, 10])
def test_least_enlargement(spark, points, chunk):
    rows, boxes = points.orderBy("pid").limit(200), boxes64(spark)
    every = {b.qid: corners(b, DIMS) for b in boxes.collect()}
    got = tiles.assign_least_enlargement(rows, boxes, DIMS, chunk=chunk).collect()
    assert len(got) == 200
    for r in got:
        p = ([r[d] for d in DIMS],) * 2
        keys = [(sphere(*joined(p, b)) - sphere(*b), sphere(*b), q) for q, b in every.items()]
        assert (r.growth, r.box) == (min(keys)[0], min(keys)[2])


def test_least_enlargement_ties(spark):
    boxes = spark.createDataFrame(
        [(5, 0.0, 0.0, 1.0, 1.0), (3, 0.0, 0.0, 0.5, 0.5), (2, 0.0, 0.0, 0.5, 0.5)],
        "qid long, la float, lb float, ha float, hb float",
    )
    rows = spark.createDataFrame([(1, 0.25, 0.25)], "pid long, a float, b float")
    assert tiles.assign_least_enlargement(rows, boxes, ("a", "b")).first().box == 2


@pytest.mark.parametrize("piece", [192, 7])
def test_worst_pair(spark, sf_dir, piece, monkeypatch):
    monkeypatch.setattr(tiles, "PAIR_CHUNK", piece)
    rows = order_boxes(spark, sf_dir).orderBy("pid").limit(60).select(
        "*", F.expr("pid % 3").alias("block"), F.expr("pid div 3").cast("int").alias("slot")
    )
    single = rows.limit(1).withColumn("block", F.lit(99).cast("long"))
    data = rows.collect()
    got = {r.block: (r.slot_a, r.slot_b, r.waste) for r in tiles.worst_pair(rows.unionByName(single), ("a", "b")).collect()}
    want = {}
    for key, group in itertools.groupby(sorted(data, key=lambda r: (r.block, r.slot)), key=lambda r: r.block):
        boxes = [(r.slot, corners(r, "ab")) for r in group]
        pairs = [
            (sphere(*joined(a, b)) - sphere(*a) - sphere(*b), -i, -j)
            for (i, a), (j, b) in itertools.combinations(boxes, 2)
        ]
        waste, i, j = max(pairs)
        want[key] = (-i, -j, waste)
    assert got == want


def test_quality_totals(index):
    quality = tiles.tile_quality(index.blocks, DIMS, index.degree)
    total = tiles.tile_quality_totals(quality).first()
    assert total.tiles == index.n_blocks and total.entries == index.rows
    data = index.blocks.collect()
    assert total.sphere_volume == pytest.approx(sum(sphere(*corners(r, DIMS)) for r in data))
    assert total.fill == pytest.approx(sum(r.n / 192 for r in data) / len(data))
