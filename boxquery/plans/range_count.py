"""Rows per box. Every method gives the same answer; they differ in the Spark plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from boxquery.functions.boxes import all_of, bound_names, box, box_of, coordinate_names, has_boxes, overlaps
from boxquery.operators.blocks import pack_blocks
from boxquery.operators.grid import (
    CELLS_PER_BOX,
    CELLS_PER_COUNT_BOX,
    cells_per_level,
    cover,
    overlap_pairs,
    point_cells,
    whole_cell,
    with_levels,
)
from boxquery.operators.index import BoxIndex
from boxquery.operators.order import with_partition
from boxquery.operators.runs import rows_in_runs, scan_ranges
from boxquery.plans.candidates import (
    FLAT_BLOCKS,
    block_candidates,
    candidates,
    join_rows,
    level_candidates,
    query_boxes,
    upright,
    wanted_segments,
)
from boxquery.plans.units import box_units, many_pairs, unit_blocks, unit_hits
from boxquery.session import BROADCAST_ROWS, NESTED_LOOP_BOXES, pair_tasks, skew_join

ROW_METHODS = ("broadcast", "grid")


def range_count(
    data: DataFrame | BoxIndex,
    boxes: DataFrame,
    dims: Sequence[str] | None = None,
    method: str = "auto",
    **options,
) -> DataFrame:
    """(qid, hits) for every box, zero hits included.

    `data` is a table of points or boxes for the methods "broadcast" and "grid", or a BoxIndex for
    "blocks", "levels", "packed", "partitions" and "ranges". "auto" tests few boxes against all rows of a
    plain table and many boxes through the grid. Of an index it tests the blocks, or goes down the pyramid
    where there are too many blocks to test each. A named method is the one that runs. Boxes with a lower
    bound above the upper one are an error.
    """
    upright(boxes, data.dims if isinstance(data, BoxIndex) else dims or ())
    if isinstance(data, BoxIndex):
        if method == "auto":
            method = "blocks" if data.n_blocks <= FLAT_BLOCKS else "levels"
        if method in ROW_METHODS:
            return _of_rows(data.points, boxes, data.dims, method, **options)
        counters = {
            "blocks": _count_blocks,
            "levels": _count_levels,
            "packed": _count_packed,
            "partitions": _count_partitions,
            "ranges": _count_ranges,
        }
        if method not in counters:
            raise ValueError(f"unknown method {method!r}")
        return with_all_boxes(counters[method](data, boxes, **options), boxes)
    if dims is None:
        raise ValueError("dims is required for a plain table")
    if method == "auto":
        method = "broadcast" if boxes.count() <= NESTED_LOOP_BOXES else "grid"
    return _of_rows(data, boxes, dims, method, **options)


def _of_rows(data: DataFrame, boxes: DataFrame, dims: Sequence[str], method: str, **options) -> DataFrame:
    if method not in ROW_METHODS:
        raise ValueError(f"method {method!r} is unknown or needs a BoxIndex")
    count = _count_plain if method == "broadcast" else _count_grid
    return with_all_boxes(count(data, boxes, dims, **options), boxes)


def with_all_boxes(counts: DataFrame, boxes: DataFrame) -> DataFrame:
    """Add up partial counts per box and keep boxes without any."""
    none = boxes.select("qid", F.lit(0).cast("long").alias("hits"))
    return counts.unionByName(none).groupBy("qid").agg(F.sum("hits").alias("hits"))


def _hits(pairs: DataFrame, *by: str) -> DataFrame:
    """One hit per pair; with_all_boxes adds them up, each task its own first."""
    return pairs.select(*by, "qid", F.lit(1).cast("long").alias("hits"))


def _count_plain(data: DataFrame, boxes: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Every row against every box, whose bounds go to all tasks: meant for few boxes."""
    rows = data.select(*coordinate_names(data, dims)).alias("p")
    queries = F.broadcast(boxes.select("qid", *bound_names(dims)).alias("q"))
    return _hits(rows.join(queries, overlaps(box_of(data, dims, "p"), box(dims, "q"))))


def _count_grid(
    data: DataFrame, boxes: DataFrame, dims: Sequence[str], cells: int | None = None, broadcast_rows: int | None = None
) -> DataFrame:
    """Equi join on grid cells. A point lies in one cell per size, so nothing is counted twice.

    Where there are too many boxes to broadcast them, they use smaller cells: those that lie wholly in a box are
    answered by their row counts, and only points of the others meet the box.
    """
    few = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    if has_boxes(data, dims):
        return _hits(overlap_pairs(boxes, data, dims, ["qid"], [], few).withColumnRenamed("a_qid", "qid"))
    rows = boxes.select("qid", *bound_names(dims))
    covered = cover(with_levels(rows, dims, cells or CELLS_PER_BOX), dims)
    per_level = cells_per_level(covered)
    if not per_level:
        return boxes.select("qid", F.lit(0).cast("long").alias("hits"))
    inside = all_of([F.col(d).between(F.col(f"l{d}"), F.col(f"h{d}")) for d in dims])
    if sum(per_level.values()) <= few:
        pairs = point_cells(data.select(*dims), dims, per_level).join(F.broadcast(covered), ["level", "cell"])
        return _hits(pairs.filter(inside))
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    covered = cover(with_levels(rows, dims, cells or CELLS_PER_COUNT_BOX), dims, {"whole": whole_cell(dims)})
    per_level = cells_per_level(covered)
    # rows are told apart by all that they hold; only rows equal in every column stay together
    told = F.xxhash64(*[c for c, kind in data.dtypes if "map<" not in kind and "variant" not in kind])
    placed = point_cells(data.select(*dims, told.alias("_row")), dims, per_level)
    edge = covered.filter(~F.col("whole")).drop("whole")
    pairs = skew_join(placed, edge, ["level", "cell"], "_row", data.count() * len(per_level), small_id=["qid"])
    return _hits(pairs.filter(inside)).unionByName(_whole_cells(placed, covered.filter("whole")))


def _whole_cells(placed: DataFrame, whole: DataFrame) -> DataFrame:
    """Hits of boxes in the cells that lie wholly in them. The row count of a cell goes to all boxes over it."""
    keys = ["level", "cell"]
    rows = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"))
    wanted = whole.select("qid", *keys).repartition(pair_tasks(whole), *keys)
    return wanted.join(rows.repartition(pair_tasks(whole), *keys).hint("merge"), keys).select("qid", "hits")


def refined_hits(index: BoxIndex, found: DataFrame, bound: int, broadcast_rows: int | None = None) -> DataFrame:
    """Hits of block candidates: whole blocks from their row counts, the others row by row."""
    whole = found.filter("inside").select("qid", F.col("n").alias("hits"))
    edge = found.filter(~F.col("inside")).drop("n", "inside")
    coords = coordinate_names(index.points, index.dims)
    renamed = edge.select("qid", "segment", "block", *[F.col(c).alias(f"q_{c}") for c in bound_names(index.dims)])
    rows = index.points.select("segment", "block", *coords)
    pairs = join_rows(index, renamed, bound, rows, broadcast_rows)
    return whole.unionByName(_hits(pairs.filter(_in_box(rows, index.dims))))


def _count_blocks(
    index: BoxIndex, boxes: DataFrame, nested_loop_boxes: int | None = None, broadcast_rows: int | None = None
) -> DataFrame:
    if many_pairs(index, boxes):
        return unit_hits(index, box_units(index, boxes, nested_loop_boxes)).select("qid", "hits")
    return refined_hits(index, *block_candidates(index, boxes, nested_loop_boxes), broadcast_rows)


def _count_levels(
    index: BoxIndex, boxes: DataFrame, start_level: int | None = None, broadcast_rows: int | None = None
) -> DataFrame:
    # the nodes above the blocks are units where both have as many blocks: their blocks are tested beside their rows
    many = start_level is None and unit_blocks(index) == index.degree < index.n_blocks and many_pairs(index, boxes)
    whole, leaves, bound = level_candidates(index, boxes, start_level, lowest=int(many))
    if many:
        hits = unit_hits(index, leaves.withColumnRenamed("node", "unit")).select("qid", "hits")
    else:
        hits = refined_hits(index, leaves, bound, broadcast_rows)
    return whole.select("qid", F.col("n").alias("hits")).unionByName(hits)


def _count_packed(index: BoxIndex, boxes: DataFrame, broadcast_rows: int | None = None) -> DataFrame:
    """Blocks stay packed as arrays; each candidate pair counts inside its arrays."""
    found, bound = candidates(index, boxes)
    whole = found.filter("inside").select("qid", F.col("n").alias("hits"))
    edge = found.filter(~F.col("inside")).drop("n", "inside")
    edge = edge.select("qid", "segment", "block", *[F.col(c).alias(f"q_{c}") for c in bound_names(index.dims)])
    # only blocks that a box looks into are packed, and of their rows only what is compared
    wanted = edge.select("segment", "block").distinct()
    wanted = F.broadcast(wanted) if bound <= BROADCAST_ROWS else wanted
    rows = wanted_segments(index, edge, index.points, bound).join(wanted, ["segment", "block"], "left_semi")
    packed = pack_blocks(rows, index.dims, "slot", ("segment", "block"))
    pairs = join_rows(index, edge, bound, packed.drop("slot"), broadcast_rows, pruned=True)
    b = box_of(packed, index.dims)

    def near(i):
        tests = []
        for axis, d in enumerate(index.dims):
            tests += [F.get(b.lo[axis], i) <= F.col(f"q_h{d}"), F.col(f"q_l{d}") <= F.get(b.hi[axis], i)]
        return all_of(tests)

    slots = F.sequence(F.lit(0), F.col("n") - 1)
    hits = F.size(F.filter(slots, near)).cast("long")
    return whole.unionByName(pairs.select("qid", hits.alias("hits")))


def partitioned_count(index: BoxIndex, boxes: DataFrame, p: int) -> DataFrame:
    """(part, qid, hits): every one of p partitions answers every box.

    Partitions are ranges of ordinals, so a block belongs to one of them unless it lies on a border. Rows of the
    at most p - 1 border blocks are told apart one by one; all others are counted as without partitions.
    """
    found, bound = candidates(index, boxes)
    first, last = "_first", "_last"
    if index.full_blocks:
        ends = {first: F.col("block") * index.degree + 1, last: F.least((F.col("block") + 1) * index.degree, F.lit(index.rows))}
    else:
        found = found.join(index.blocks.select("block", "last_ordinal"), "block")
        ends = {first: F.col("last_ordinal") - F.col("n") + 1, last: F.col("last_ordinal")}
    found = found.withColumns(ends)
    for end in (first, last):
        found = with_partition(found, p, index.rows, end).withColumn(end, F.col("part")).drop("part")
    settled = F.col("inside") & (F.col(first) == F.col(last))
    whole = found.filter(settled).select(F.col(first).alias("part"), "qid", F.col("n").alias("hits"))
    bounds = bound_names(index.dims)
    edge = found.filter(~settled).select("qid", "segment", "block", *[F.col(c).alias(f"q_{c}") for c in bounds])
    rows = index.points.select("segment", "block", "ordinal", *coordinate_names(index.points, index.dims))
    pairs = join_rows(index, edge, bound, rows).filter(_in_box(rows, index.dims))
    parts = _hits(with_partition(pairs, p, index.rows), "part")
    return whole.unionByName(parts).groupBy("part", "qid").agg(F.sum("hits").alias("hits"))


def _in_box(rows: DataFrame, dims: Sequence[str]) -> Column:
    """Whether a row overlaps the box whose bounds stand next to it as q_<bound>."""
    b = box_of(rows, dims)
    return all_of([c for i, d in enumerate(dims) for c in (b.lo[i] <= F.col(f"q_h{d}"), F.col(f"q_l{d}") <= b.hi[i])])


def _count_partitions(index: BoxIndex, boxes: DataFrame, p: int = 8) -> DataFrame:
    return partitioned_count(index, boxes, p).select("qid", "hits")


def _count_ranges(index: BoxIndex, boxes: DataFrame, gap: int = 0) -> DataFrame:
    return scan_by_ranges(index, boxes, scan_ranges(index, boxes, gap))


def scan_by_ranges(index: BoxIndex, boxes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Read the rows of each box's runs of blocks, test them and count."""
    return _hits(rows_in_runs(index, query_boxes(boxes, index), ranges))
