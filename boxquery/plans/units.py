"""Many boxes meet many rows in units of consecutive blocks: pairs of boxes and blocks stay inside a task.

A box is sent to the units whose bounds it overlaps, a few whatever their number, and each task tests the blocks of a
unit and then their rows. So what is shuffled grows with the boxes and the rows, and not with boxes times blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from boxquery.functions.boxes import bound_names, box, box_of, hi_names, lo_names, overlaps
from boxquery.operators.index import UNIT_ROWS, BoxIndex
from boxquery.plans.candidates import _grid, query_boxes
from boxquery.session import BROADCAST_ROWS, HOT_KEYS, NESTED_LOOP_BOXES, ROWS_PER_PARTITION, pair_tasks, written

# Boxes times blocks beyond which candidate blocks are not written.
MANY_PAIRS = 200_000_000

# Boxes of a unit that one task answers, and ids that it may gather for one group.
UNIT_BOXES = 20_000
GROUP_IDS = 20_000_000

# Units around which one box is drawn where there are too many to test each.
UNITS_ABOVE = 64

# Rows tested at a time, boxes tested at a time, and ids after which a batch is passed on.
CHUNK = 192
BOX_SLICE = 2_048
BATCH_IDS = 500_000

# Tasks for each ROWS_PER_PARTITION rows and boxes that are sorted by unit: they are wider than stored rows.
SPREAD = 2

# A round of a search for the first k looks into this many times as many units of a box as the one before.
ROUND_GROWTH = 8


def many_pairs(index: BoxIndex, boxes: DataFrame) -> bool:
    """Whether boxes and blocks are so many that their candidate pairs should not be written."""
    return boxes.count() * index.n_blocks > MANY_PAIRS


def unit_blocks(index: BoxIndex) -> int:
    """Blocks of a unit. Segments as small as that are the units, so rows stored by them stay where they are."""
    most = max(1, UNIT_ROWS // index.degree)
    return min(most, index.segment_blocks)


def box_units(index: BoxIndex, boxes: DataFrame, nested_loop_units: int | None = None) -> DataFrame:
    """(qid, bounds, unit) of the units whose bounds a box overlaps, written.

    More than nested_loop_units units meet the boxes in a grid, if that is given.
    """
    size, bounds = unit_blocks(index), bound_names(index.dims)
    shape = [F.min(c).alias(c) for c in lo_names(index.dims)] + [F.max(c).alias(c) for c in hi_names(index.dims)]
    units = written(index.blocks.groupBy(F.expr(f"block div {size}").alias("unit")).agg(*shape), "unit-bounds")
    queries = query_boxes(boxes, index)
    n_units = -(-index.n_blocks // size)
    if n_units > (BROADCAST_ROWS if nested_loop_units is None else nested_loop_units):
        found = _grid(units.withColumn("n", F.lit(0)), queries, index, "unit").select("qid", *bounds, "unit")
        return written(found, "box-units")
    queries = queries.repartition(pair_tasks(queries))
    meet = overlaps(box(index.dims, "q"), box(index.dims, "t"))
    columns = ["q.qid", *[f"q.{c}" for c in bounds], "t.unit"]
    if n_units <= NESTED_LOOP_BOXES or nested_loop_units is not None:
        found = queries.alias("q").join(F.broadcast(units.alias("t")), meet).select(*columns)
    else:
        placed = units.withColumn("_above", F.expr(f"unit div {UNITS_ABOVE}"))
        above = placed.groupBy("_above").agg(*shape)
        near = queries.alias("q").join(F.broadcast(above.alias("t")), meet).select("q.*", "t._above")
        found = near.alias("q").join(F.broadcast(placed.alias("t")), F.col("q._above") == F.col("t._above")).filter(meet).select(*columns)
    return written(found, "box-units")


def unit_hits(index: BoxIndex, pairs: DataFrame) -> DataFrame:
    """(qid, unit, hits) of the boxes in their units, zero hits left out. A `_quota` of a pair ends its count."""
    kinds = {f.name: f.dataType for f in pairs.schema}
    schema = T.StructType().add("qid", kinds["qid"]).add("unit", T.LongType()).add("hits", T.LongType())
    return _met(index, pairs, schema, 1)


def unit_rows(index: BoxIndex, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """(qid, id) of the rows in each box, or of a pair's first `_quota` rows, at most `most`, in index order."""
    kinds = {f.name: f.dataType for f in pairs.schema}
    ids = T.ArrayType(index.points.schema[index.id_col].dataType)
    schema = T.StructType().add("qid", kinds["qid"]).add("ids", ids)
    found = _met(index, pairs, schema, UNIT_ROWS if most is None else min(most, UNIT_ROWS))
    return found.select("qid", F.explode("ids").alias(index.id_col))


def first_rows(index: BoxIndex, boxes: DataFrame, k: int, first: int) -> DataFrame:
    """(qid, id) of the first k rows of each box, in index order.

    Hits are counted in rounds, in `first` units of each box from the front and then in ROUND_GROWTH times as many, for
    boxes that have fewer than k so far. The counts tell how many rows each unit is to give, and only those are made.
    """
    order = Window.partitionBy("qid").orderBy("unit")
    left = written(box_units(index, boxes).withColumns({"_rank": F.row_number().over(order), "_quota": F.lit(k)}), "ranked")
    done, reach, parts = 0, first, []
    while True:
        now = left.filter(F.col("_rank").between(done + 1, reach)).drop("_rank")
        parts.append(written(unit_hits(index, now), "round"))
        found = reduce(DataFrame.unionByName, parts)
        full = found.groupBy("qid").agg(F.sum("hits").alias("hits")).filter(F.col("hits") >= k).select("qid")
        left = written(left.filter(F.col("_rank") > reach).join(full, "qid", "left_anti"), "ranked")
        if left.isEmpty():
            break
        done, reach = reach, reach * ROUND_GROWTH
    before = F.coalesce(F.sum("hits").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = found.withColumn("_quota", F.lit(k) - before).filter("_quota > 0").drop("hits")
    return unit_rows(index, written(wanted.join(query_boxes(boxes, index), "qid"), "quotas"), k)


def _met(index: BoxIndex, pairs: DataFrame, schema: T.StructType, ids_per_box: int) -> DataFrame:
    """What the boxes find in their units. Rows stored by unit are met where they are; others are shuffled to theirs."""
    searching = "ids" in schema.names
    size = unit_blocks(index)
    b = box_of(index.points, index.dims)
    as_points = not set(bound_names(index.dims)) <= set(index.points.columns)
    d = len(index.dims)
    corners = [c.alias(f"_c{i}") for i, c in enumerate(b.lo if as_points else b.lo + b.hi)]
    rows = index.points.select(
        (F.col("segment") if size == index.segment_blocks else F.expr(f"block div {size}")).alias("unit"),
        F.col("ordinal").alias("_n"),
        *([F.col(index.id_col).alias("_id")] if searching else []),
        *corners,
    )
    quota = F.col("_quota").cast("long") if "_quota" in pairs.columns else F.lit(None).cast("long")
    asked = pairs.select(
        "unit", quota.alias("_n"), "qid", *[F.col(c).alias(f"_c{i}") for i, c in enumerate(bound_names(index.dims))]
    )
    answers = _answering(d, as_points, searching, to_arrow_schema(schema))
    counted = asked.groupBy("unit").count()
    total = counted.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    if not index.by_segment or size != index.segment_blocks:
        return _streamed(index, rows, asked, counted, total, answers, schema)
    threshold = max(1, min(UNIT_BOXES, GROUP_IDS // ids_per_box), -(-total // HOT_KEYS) if ids_per_box == 1 else 0)
    hot = [r.unit for r in counted.filter(F.col("count") > threshold).select("unit").collect()]
    here = F.col("unit").isin(hot)
    cold = asked.filter(~here) if hot else asked
    in_place = rows.groupBy("unit").cogroup(cold.groupBy("unit")).applyInArrow(_grouped(answers), schema)
    if not hot:
        return in_place
    moved = _streamed(index, rows.filter(here), asked.filter(here), counted.filter(here), total, answers, schema)
    return in_place.unionByName(moved)


def _streamed(
    index: BoxIndex, rows: DataFrame, asked: DataFrame, counted: DataFrame, total: int, answers: Callable, schema: T.StructType
) -> DataFrame:
    """Rows and boxes of a unit in one task, the rows first, so that boxes stream past them.

    Units that more boxes want than one task should answer go to several, with their rows repeated.
    """
    threshold = max(UNIT_BOXES, -(-total // HOT_KEYS))
    parts = F.ceil(F.col("count") / threshold).cast("int").alias("_parts")
    shared = F.broadcast(written(counted.filter(F.col("count") > threshold).select("unit", parts), "hot-units"))
    n = F.coalesce("_parts", F.lit(1))
    every = F.explode(F.sequence(F.lit(0), n - 1))
    rows = rows.join(shared, "unit", "left").withColumn("_part", every).withColumn("_side", F.lit(0))
    own = F.pmod(F.xxhash64("qid"), n).cast("int")
    asked = asked.join(shared, "unit", "left").withColumn("_part", own).withColumn("_side", F.lit(1))
    both = rows.unionByName(asked, allowMissingColumns=True).drop("_parts")
    keys = ["unit", "_part"]
    tasks = max(pair_tasks(both), -(-SPREAD * (index.rows + total) // ROWS_PER_PARTITION))
    return both.repartition(tasks, *keys).sortWithinPartitions(*keys, "_side").mapInArrow(_sided(answers), schema)


def _sided(answers: Callable) -> Callable:
    """For mapInArrow over rows and boxes sorted by unit, part and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, rows = None, [], None
        for batch in batches:
            unit, part, side = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("unit", "_part", "_side"))
            new = np.flatnonzero((np.diff(unit) != 0) | (np.diff(part) != 0) | (np.diff(side) != 0)) + 1
            for start, end in zip([0, *new], [*new, batch.num_rows]):
                if end == start:
                    continue
                if at != (unit[start], part[start]):
                    at, held, rows = (unit[start], part[start]), [], None
                piece = batch.slice(start, end - start)
                if side[start] == 0:
                    held.append(piece)
                elif held:
                    rows = rows or _Rows(pa.Table.from_batches(held))
                    yield from answers(rows, piece)

    return run


def _grouped(answers: Callable) -> Callable:
    """For applyInArrow over the rows and the boxes of a unit."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            rows = _Rows(left)
            for piece in right.combine_chunks().to_batches():
                found.extend(answers(rows, piece))
        return pa.Table.from_batches(found, answers.schema)

    return run


class _Rows:
    """The rows of a unit in index order, in chunks with their bounds."""

    def __init__(self, table: pa.Table):
        order = np.argsort(table.column("_n").to_numpy())
        self.columns = {
            name: table.column(name).to_numpy()[order]
            for name in table.column_names
            if name.startswith("_c") and table.column(name).null_count < table.num_rows
        }
        self.ids = table.column("_id").combine_chunks().take(pa.array(order)) if "_id" in table.column_names else None
        self.starts = np.arange(0, len(order), CHUNK)
        self.ends = np.append(self.starts[1:], len(order))


def _answering(d: int, as_points: bool, searching: bool, schema: pa.Schema) -> Callable:
    """A function that gives the hits, or the ids, of a batch of boxes among the rows of a unit."""

    def corners(rows: _Rows) -> tuple[list[np.ndarray], list[np.ndarray]]:
        none = np.full(rows.ends[-1], np.nan)
        lo = [rows.columns.get(f"_c{i}", none) for i in range(d)]
        return lo, lo if as_points else [rows.columns.get(f"_c{d + i}", none) for i in range(d)]

    def answers(rows: _Rows, piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lo, hi = corners(rows)
        low = [np.fmin.reduceat(c, rows.starts) for c in lo]
        high = [np.fmax.reduceat(c, rows.starts) for c in hi]
        # a chunk with a row that has no place lies in no box
        least = [np.minimum.reduceat(c, rows.starts) for c in lo]
        most = [np.maximum.reduceat(c, rows.starts) for c in hi]
        lengths = (rows.ends - rows.starts).astype(np.float32)
        for at in range(0, piece.num_rows, BOX_SLICE):
            boxes = piece.slice(at, BOX_SLICE)
            column = {name: boxes.column(i) for i, name in enumerate(boxes.schema.names)}
            l, h = ([column[f"_c{i + j * d}"].to_numpy(zero_copy_only=False) for i in range(d)] for j in (0, 1))
            near = np.ones((len(rows.starts), boxes.num_rows), bool)
            for i in range(d):
                near &= low[i][:, None] <= h[i]
                near &= l[i] <= high[i][:, None]
            limited = column["_n"].null_count == 0
            left = column["_n"].to_numpy(zero_copy_only=False).copy() if limited else None
            hits = np.zeros(boxes.num_rows, np.int64)
            if not searching:  # chunks that lie wholly in a box are answered by their row counts
                whole = near.copy()
                for i in range(d):
                    whole &= l[i] <= least[i][:, None]
                    whole &= most[i][:, None] <= h[i]
                hits += (lengths @ whole.astype(np.float32)).astype(np.int64)
                near &= ~whole
                if limited:
                    np.minimum(hits, left, out=hits)
            owners, sizes, ids, gathered = [], [], [], 0
            for c in np.flatnonzero(near.any(axis=1)):
                who = np.flatnonzero(near[c] & (left > hits) if limited else near[c])
                if not len(who):
                    continue
                chunk = slice(rows.starts[c], rows.ends[c])
                inside = np.ones((len(who), rows.ends[c] - rows.starts[c]), bool)
                for i in range(d):  # bounds that all rows of the chunk keep are not tested row by row
                    upper, lower = h[i][who], l[i][who]
                    if not (most[i][c] <= upper).all():
                        inside &= lo[i][chunk] <= upper[:, None]
                    if not (lower <= least[i][c]).all():
                        inside &= lower[:, None] <= hi[i][chunk]
                if limited:
                    inside &= np.cumsum(inside, axis=1) <= (left - hits)[who, None]
                found = np.count_nonzero(inside, axis=1)
                hits[who] += found
                if searching:
                    owners.append(who[found > 0])
                    sizes.append(found[found > 0])
                    ids.append(np.nonzero(inside)[1] + rows.starts[c])
                    gathered += len(ids[-1])
                    if gathered >= BATCH_IDS:
                        yield listed(rows, column["qid"], owners, sizes, ids)
                        owners, sizes, ids, gathered = [], [], [], 0
            if gathered:
                yield listed(rows, column["qid"], owners, sizes, ids)
            if not searching and hits.any():
                some = np.flatnonzero(hits)
                yield pa.RecordBatch.from_arrays(
                    [column["qid"].take(pa.array(some)), column["unit"].take(pa.array(some)), pa.array(hits[some])], schema=schema
                )

    def listed(rows, qids, owners, sizes, ids) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        values = rows.ids.take(pa.array(np.concatenate(ids)))
        lists = pa.ListArray.from_arrays(pa.array(offsets), values).cast(schema.field("ids").type)
        return pa.RecordBatch.from_arrays([qids.take(pa.array(np.concatenate(owners))), lists], schema=schema)

    answers.schema = schema
    return answers
