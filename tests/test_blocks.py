import pytest
from pyspark.sql import functions as F

from boxquery import build_index, range_count
from boxquery.operators.blocks import (
    block_summary,
    build_levels,
    count_entries,
    level_counts,
    level_sizes,
    pack_blocks,
    unpack_blocks,
)

DIMS = ("x", "y", "z")


@pytest.mark.parametrize(
    "n, sizes", [(0, []), (1, [1]), (192, [1]), (193, [1, 2]), (6000, [1, 32]), (600_000, [1, 17, 3125])]
)
def test_level_sizes(n, sizes):
    assert level_sizes(n) == sizes


@pytest.mark.parametrize("n", [1, 2, 192, 193])
def test_edges_of_the_block_size(spark, n):
    rows = spark.range(n).select(
        F.col("id").alias("pid"), *[(F.col("id") / 200).cast("float").alias(d) for d in DIMS]
    )
    index = build_index(rows, DIMS)
    assert [r.n for r in index.blocks.orderBy("block").collect()] == [min(192, n)] + [n - 192] * (n > 192)
    counts = [r.nodes for r in level_counts(index.nodes).orderBy(F.desc("level")).collect()]
    assert counts == level_sizes(n)
    everything = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "qid long, lx float, ly float, lz float, hx float, hy float, hz float")
    for method in ("blocks", "levels", "packed", "ranges"):
        assert range_count(index, everything, method=method).first().hits == n


def test_pyramid_bounds_and_counts(points, index):
    nodes = build_levels(index.blocks, DIMS, degree=4).collect()
    top = max(r.level for r in nodes)
    roots = [r for r in nodes if r.level == top]
    whole = points.agg(*[f(d) for d in DIMS for f in (F.min, F.max)]).first()
    assert len(roots) == 1 and roots[0].n == index.rows and roots[0].last_ordinal == index.rows
    assert [v for d in DIMS for v in (roots[0][f"l{d}"], roots[0][f"h{d}"])] == list(whole)
    by_key = {(r.level, r.node): r for r in nodes}
    for r in nodes:
        if r.level < top:
            parent = by_key[(r.level + 1, r.parent)]
            assert all(parent[f"l{d}"] <= r[f"l{d}"] and r[f"h{d}"] <= parent[f"h{d}"] for d in DIMS)


def test_pack_and_unpack_are_inverse(index):
    columns = ["block", "slot", "pid", *DIMS]
    packed = pack_blocks(index.points, DIMS)
    assert packed.agg(F.max("n")).first()[0] == 192
    back = unpack_blocks(packed).select(*columns)
    assert back.exceptAll(index.points.select(*columns)).count() == 0
    assert back.count() == index.rows


def test_count_entries(index):
    assert count_entries(index.blocks).first().entries == 6000
    assert count_entries(block_summary(index.points.limit(0), DIMS)).first().entries == 0
