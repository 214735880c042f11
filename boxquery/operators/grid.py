"""Grids of several cell sizes, so that any box covers only a few cells of the size chosen for it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from boxquery.functions.boxes import Box, bound_names, box_of, hi_names, lo_names, overlaps
from boxquery.session import BROADCAST_ROWS, broadcast_limit, pair_tasks, skew_join, written

# Cell sizes on offer: side 1/2**level. Two apart, so a row is repeated for at most eleven sizes.
LEVELS = tuple(range(0, 21, 2))

# A box uses the finest level at which it covers at most this many cells.
CELLS_PER_BOX = 16

# The same where both sides are boxes and are repeated for every level in use. Cells much smaller than the boxes
# leave few candidates that do not overlap.
CELLS_PER_PAIR_BOX = 32

# The same where cells that lie wholly in a box are answered by their row counts.
CELLS_PER_COUNT_BOX = 128


def levels_for(d: int) -> tuple[int, ...]:
    return tuple(level for level in LEVELS if d * level <= 62)


def axis_cell(value: str, level: int | str) -> str:
    """SQL for the cell number on one axis. Values outside [0, 1) fall in the outermost cells."""
    side = f"{float(1 << level)}D" if isinstance(level, int) else f"power(2D, {level})"
    return f"cast(greatest(0D, least(floor(cast({value} AS double) * {side}), {side} - 1D)) AS bigint)"


def cell_id(axes: Sequence[str], level: int | str) -> str:
    """SQL for one number per cell: the axis numbers side by side, `level` bits each."""
    shift = level if isinstance(level, int) else f"cast({level} AS int)"
    return reduce(lambda acc, c: f"(shiftleft({acc}, {shift}) | {c})", axes)


def with_levels(boxes: DataFrame, dims: Sequence[str], cells: int = CELLS_PER_BOX) -> DataFrame:
    """Add `level`: the finest one at which the box covers at most `cells` cells."""
    offered = sorted(levels_for(len(dims)), reverse=True)
    finest, names = offered[0], bound_names(dims)
    # a cell number shifted right is that of the coarser cell around it, so the text stays short enough to be compiled
    placed = boxes.selectExpr("*", *[f"{axis_cell(n, finest)} AS _at_{n}" for n in names])

    def cells_at(level: int) -> str:
        by = finest - level
        pairs = zip(lo_names(dims), hi_names(dims))
        return " * ".join(f"(shiftright(_at_{h}, {by}) - shiftright(_at_{l}, {by}) + 1D)" for l, h in pairs)

    choice = " ".join(f"WHEN {cells_at(level)} <= {cells} THEN {level}" for level in offered)
    return placed.withColumn("level", F.expr(f"CASE {choice} END")).drop(*[f"_at_{n}" for n in names])


def cover(leveled: DataFrame, dims: Sequence[str], extra: dict[str, str] | None = None) -> DataFrame:
    """Repeat each box for every cell it covers at its `level`: adds `cell`.

    Further columns are SQL over the cell's number `_a<i>` on each axis and its place `_p<i>` in the box there.
    """
    out = leveled
    for i, (l, h) in enumerate(zip(lo_names(dims), hi_names(dims))):
        span = f"posexplode(sequence({axis_cell(l, 'level')}, {axis_cell(h, 'level')})) AS (_p{i}, _a{i})"
        out = out.selectExpr("*", span)
    cell = cell_id([f"_a{i}" for i in range(len(dims))], "level")
    return out.selectExpr(*leveled.columns, f"{cell} AS cell", *[f"{sql} AS {name}" for name, sql in (extra or {}).items()])


def whole_cell(dims: Sequence[str]) -> str:
    """SQL for cover: whether all points of the cell lie in the box. Outermost cells hold points beyond them, too."""
    side = "power(2D, level)"
    inner = [
        f"_a{i} > 0 AND _a{i} < {side} - 1D AND {l} <= _a{i} / {side} AND (_a{i} + 1) / {side} <= {h}"
        for i, (l, h) in enumerate(zip(lo_names(dims), hi_names(dims)))
    ]
    return " AND ".join(inner)


def cells_per_level(covered: DataFrame) -> dict[int, int]:
    """How many (box, cell) rows there are at each level in use; at most one entry per level on offer."""
    return {r.level: r["count"] for r in covered.groupBy("level").count().collect()}


def point_cells(points: DataFrame, dims: Sequence[str], levels: Sequence[int]) -> DataFrame:
    """Repeat each point for every level: adds `level` and the one `cell` it lies in there."""
    at = ", ".join(
        f"named_struct('level', {level}, 'cell', {cell_id([axis_cell(d, level) for d in dims], level)})"
        for level in sorted(levels)
    )
    return points.selectExpr("*", f"inline(array({at}))")


def overlap_pairs(
    left: DataFrame,
    right: DataFrame,
    dims: Sequence[str],
    left_cols: Sequence[str],
    right_cols: Sequence[str],
    broadcast_rows: int | None = None,
) -> DataFrame:
    """All pairs of overlapping rows of two tables of boxes or points, each pair once.

    Columns: the named columns and the bounds of both rows, prefixed `a_` and `b_`. Each box is placed
    at its own level. Two boxes meet at the coarser of their two levels, in the cell that holds the
    lower corner of their intersection, so exactly one cell reports a pair. That is two joins: rows of the
    left side at their own level with finer or equal rows of the right side, and rows of the right side at
    their own level with strictly finer rows of the left side. A side is only repeated at levels where the
    other side has boxes of its own, so large boxes meet many rows and small ones meet their neighbours.
    """
    few = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    a, b = _numbered(left, dims, left_cols), _numbered(right, dims, right_cols)
    pairs = _meeting(a, b, dims, "v <= own", few, ("a", "b")).unionByName(_meeting(b, a, dims, "v < own", few, ("b", "a")))
    return _overlapping(pairs, dims)


def self_overlap_pairs(rows: DataFrame, dims: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Every two overlapping rows of one table, once and in either order. Columns as in overlap_pairs."""
    a = _numbered(rows, dims, cols)
    alike = _meeting(a, a, dims, "v = own", BROADCAST_ROWS, ("a", "b"), alike=True)
    return _overlapping(alike.unionByName(_meeting(a, a, dims, "v < own", BROADCAST_ROWS, ("a", "b"))), dims)


def _numbered(side: DataFrame, dims: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The rows with their level and a number of their own, dealt out evenly: the work lies in their pairs."""
    b = box_of(side, dims)
    rows = side.select(*cols, *[c.alias(n) for c, n in zip(b.lo + b.hi, bound_names(dims))])
    rows = rows.repartition(int(side.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(with_levels(rows, dims, CELLS_PER_PAIR_BOX).withColumn("_n", F.monotonically_increasing_id()), "leveled")


def _overlapping(pairs: DataFrame, dims: Sequence[str]) -> DataFrame:
    box_a = Box([F.col(f"a_l{x}") for x in dims], [F.col(f"a_h{x}") for x in dims])
    box_b = Box([F.col(f"b_l{x}") for x in dims], [F.col(f"b_h{x}") for x in dims])
    return pairs.filter(overlaps(box_a, box_b)).drop("level", "cell", "begins", "a__n", "b__n")


def _meeting(
    coarse: DataFrame, fine: DataFrame, dims: Sequence[str], finer: str, few: int, tags: tuple[str, str], alike: bool = False
) -> DataFrame:
    """Rows of `coarse` in the cells of their own level, next to rows of `fine` repeated for those levels.

    A cell holds the lower corner of the intersection if on each axis one of the two boxes begins in it. So rows
    meet by the cell and the axes on which the fine row begins there, which must be all on which the coarse row does
    not. With `alike` both sides are the same rows: of the two orders of a pair only one is looked at.
    """
    every = {r.level for r in coarse.select("level").distinct().collect()}
    finest = fine.agg(F.max("level")).first()[0]
    # rows at levels that no fine row is offered meet nothing
    levels = sorted(v for v in every if finest is not None and (v < finest if finer == "v < own" else v <= finest))
    if len(levels) < len(every):
        coarse = coarse.filter(F.col("level").isin(levels) if levels else F.lit(False))
    begins = {"begins": " | ".join(f"shiftleft(cast(_p{i} = 0 AS int), {i})" for i in range(len(dims)))}
    axes = range(1 << len(dims))
    fitting = [[f for f in axes if c | f == axes[-1] and (f <= c or not alike)] for c in axes]
    offer = ", ".join(f"array({', '.join(map(str, fs))})" if fs else "cast(array() AS array<int>)" for fs in fitting)
    placed = cover(coarse, dims, begins).withColumn("begins", F.expr(f"explode(get(array({offer}), begins))"))
    placed = _tagged(placed, tags[0])
    offered = ", ".join(map(str, levels)) or "0"
    spread = fine.withColumnRenamed("level", "own").selectExpr("*", f"explode(filter(array({offered}), v -> {finer})) AS level")
    spread = _tagged(cover(spread, dims, begins).drop("own"), tags[1])
    keys = ["level", "cell", "begins"]
    if placed.count() <= broadcast_limit(placed, few):
        pairs = spread.join(F.broadcast(placed), keys)
    elif (total := spread.count()) <= broadcast_limit(spread, few):
        pairs = placed.join(F.broadcast(spread), keys)
    else:
        pairs = skew_join(spread, placed, keys, f"{tags[1]}__n", total, small_id=[f"{tags[0]}__n"])
    if not alike:
        return pairs
    return pairs.filter((F.col("begins") < axes[-1]) | (F.col(f"{tags[0]}__n") < F.col(f"{tags[1]}__n")))


def _tagged(placed: DataFrame, tag: str) -> DataFrame:
    keys = ("level", "cell", "begins")
    return placed.select(*keys, *[F.col(c).alias(f"{tag}_{c}") for c in placed.columns if c not in keys])
