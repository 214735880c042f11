"""Runs of neighbouring candidate blocks per box, and reading the rows of such runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from boxquery.functions.boxes import all_of, any_of, bound_names, box_of, coordinate_names
from boxquery.operators.index import BoxIndex, with_segment
from boxquery.plans.candidates import candidates, join_rows
from boxquery.session import BROADCAST_ROWS, written

# Blocks looked at in one window group, and blocks produced by one explode.
RUN_CHUNK = 65_536

# Up to this many merged ordinal ranges go into the scan filter as literals.
LITERAL_RANGES = 64
COARSE_STEPS = 4_096


def scan_ranges(index: BoxIndex, boxes: DataFrame, gap: int = 0) -> DataFrame:
    """(qid, first_block, last_block, blocks): each box's candidate blocks merged into runs."""
    found, _ = candidates(index, boxes)
    if index.n_blocks <= RUN_CHUNK:
        return _merged(found.select("qid", "block"), gap)
    return merge_runs(found.select("qid", "block"), gap)


def _merged(pairs: DataFrame, gap: int) -> DataFrame:
    """Runs where all blocks of a box fit one window group."""
    islands = _islands(pairs.withColumn("_end", F.col("block")), ["qid"], "block", "_end", gap)
    return (
        islands.groupBy("qid", "_run")
        .agg(F.min("block").alias("first_block"), F.max("block").alias("last_block"), F.count(F.lit(1)).alias("blocks"))
        .drop("_run")
    )


def merge_runs(pairs: DataFrame, gap: int = 0, chunk: int = RUN_CHUNK) -> DataFrame:
    """Merge each box's blocks into runs; runs with at most `gap` blocks between them become one.

    Runs are first built inside chunks of the block range, so that a box over most of the data does
    not end up in one task. Only the first and last run of a chunk can continue in another chunk, so
    the second pass looks at those alone.
    """
    pairs = pairs.withColumn("_chunk", F.expr(f"block div {chunk}"))
    in_chunk = _islands(pairs.withColumn("_end", F.col("block")), ["qid", "_chunk"], "block", "_end", gap)
    inner = in_chunk.groupBy("qid", "_chunk", "_run").agg(
        F.min("block").alias("first_block"),
        F.max("block").alias("last_block"),
        F.count(F.lit(1)).alias("blocks"),
    )
    inner = written(inner, "runs")
    of_chunk = Window.partitionBy("qid", "_chunk")
    marked = inner.withColumn(
        "_edge", (F.col("_run") == 0) | (F.col("_run") == F.max("_run").over(of_chunk))
    )
    edges = _islands(marked.filter("_edge").drop("_run"), ["qid"], "first_block", "last_block", gap)
    joined = edges.groupBy("qid", "_run").agg(
        F.min("first_block").alias("first_block"),
        F.max("last_block").alias("last_block"),
        F.sum("blocks").alias("blocks"),
    )
    columns = ["qid", "first_block", "last_block", "blocks"]
    return joined.select(*columns).unionByName(marked.filter(~F.col("_edge")).select(*columns))


def _islands(df: DataFrame, by: list[str], start: str, end: str, gap: int) -> DataFrame:
    """Number the islands of intervals per group from 0, in `_run`."""
    order = Window.partitionBy(*by).orderBy(start)
    broken = F.col(start) - F.lag(end).over(order) > gap + 1
    starts = F.coalesce(broken.cast("int"), F.lit(0))
    return df.withColumn("_new", starts).withColumn("_run", F.sum("_new").over(order)).drop("_new")


def blocks_of_runs(ranges: DataFrame, chunk: int = RUN_CHUNK) -> DataFrame:
    """(qid, block) for every block of every run; long runs are cut before they are unfolded."""
    cut = ranges.select(
        "qid",
        "first_block",
        "last_block",
        F.explode(F.sequence("first_block", "last_block", F.lit(chunk).cast("long"))).alias("_from"),
    )
    until = F.least(F.col("_from") + chunk - 1, F.col("last_block"))
    return cut.select("qid", F.explode(F.sequence("_from", until)).alias("block"))


def rows_in_runs(index: BoxIndex, queries: DataFrame, ranges: DataFrame) -> DataFrame:
    """(qid, id) of the rows in each box's runs that overlap the box."""
    ranges = written(ranges.select("qid", "first_block", "last_block"), "ranges")
    bounds = bound_names(index.dims)
    boxes = queries.select("qid", *[F.col(c).alias(f"q_{c}") for c in bounds])
    most = ranges.agg(F.coalesce(F.sum(F.col("last_block") - F.col("first_block") + 1), F.lit(0))).first()[0]
    wanted = with_segment(blocks_of_runs(ranges).join(boxes, "qid"), index.segment_blocks)
    if most > BROADCAST_ROWS:
        wanted = written(wanted, "run-blocks")
    coords = coordinate_names(index.points, index.dims)
    rows = index.points.select("segment", "block", "ordinal", index.id_col, *coords)
    rows = _only_scanned(index, rows, ranges)
    pairs = join_rows(index, wanted, most, rows)
    b = box_of(rows, index.dims)
    near = [c for i, d in enumerate(index.dims) for c in (b.lo[i] <= F.col(f"q_h{d}"), F.col(f"q_l{d}") <= b.hi[i])]
    return pairs.filter(all_of(near)).select("qid", index.id_col)


def _only_scanned(index: BoxIndex, rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Put the runs of all boxes together into the scan filter when few literal ranges say it all.

    The block range is looked at in at most COARSE_STEPS equal steps, so the list of wanted steps is
    small. Parquet then skips row groups by their ordinals. With more ranges the join alone decides, and where
    blocks can be short, as ordinals are not stored there.
    """
    if not index.full_blocks:
        return rows
    step = max(1, -(-index.n_blocks // COARSE_STEPS))
    steps = F.explode(F.sequence(F.expr(f"first_block div {step}"), F.expr(f"last_block div {step}")))
    wanted = sorted(r.step for r in ranges.select(steps.alias("step")).distinct().collect())
    merged: list[list[int]] = []
    for s in wanted:
        if merged and s <= merged[-1][1] + 1:
            merged[-1][1] = s
        else:
            merged.append([s, s])
    if not merged or len(merged) > LITERAL_RANGES:
        return rows
    span = step * index.degree
    return rows.filter(any_of([F.col("ordinal").between(a * span + 1, (b + 1) * span) for a, b in merged]))
