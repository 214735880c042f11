"""Which blocks each box has to look at."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, functions as F

from boxquery.functions.boxes import any_of, bound_names, box, contains, overlaps
from boxquery.operators.blocks import level_sizes
from boxquery.operators.grid import overlap_pairs
from boxquery.operators.index import BLOCK_KEYS, BoxIndex, with_segment
from boxquery.session import BROADCAST_ROWS, HOT_MIN_ROWS, NESTED_LOOP_BOXES, broadcast_limit, skew_join, written

# A small index is read whole; of a larger one only the segments in a list of this length at most.
FEW_SEGMENTS = 64
SEGMENT_FILTER = 10_000

# Blocks up to which testing each one beats going down the pyramid, and blocks produced by one explode.
FLAT_BLOCKS = 10_000
UNFOLD = 65_536

# Candidate columns: qid, the bounds of the box, block, n (rows of the block) and `inside`, true when
# the whole block lies in the box so that its rows need no test.


def upright(boxes: DataFrame, dims) -> None:
    """Raise if a box has a lower bound above the upper one."""
    turned = any_of([F.col(f"l{d}") > F.col(f"h{d}") for d in dims]) if dims else F.lit(False)
    wrong = boxes.filter(turned).select("qid").head()
    if wrong is not None:
        raise ValueError(f"box {wrong.qid} has a lower bound above its upper bound")


def query_boxes(boxes: DataFrame, index: BoxIndex) -> DataFrame:
    return boxes.select("qid", *bound_names(index.dims))


def _judged(pairs: DataFrame, index: BoxIndex, key: str) -> DataFrame:
    """Keep overlapping (query q, node t) pairs and mark the ones where the node lies inside the box."""
    q, t = box(index.dims, "q"), box(index.dims, "t")
    return pairs.filter(overlaps(q, t)).select(
        "q.qid",
        *[F.col(f"q.{c}").alias(c) for c in bound_names(index.dims)],
        F.col(f"t.{key}").alias(key),
        F.col("t.n").alias("n"),
        contains(q, t).alias("inside"),
    )


def _small_theta(small: DataFrame, queries: DataFrame, index: BoxIndex, key: str, queries_small: bool) -> DataFrame:
    q, t = queries.alias("q"), small.alias("t")
    condition = overlaps(box(index.dims, "q"), box(index.dims, "t"))
    pairs = t.join(F.broadcast(q), condition) if queries_small else q.join(F.broadcast(t), condition)
    return _judged(pairs, index, key)


def _grid(nodes: DataFrame, queries: DataFrame, index: BoxIndex, key: str) -> DataFrame:
    """Overlap join of two large sides on grid cells."""
    bounds = bound_names(index.dims)
    pairs = overlap_pairs(queries, nodes, index.dims, ["qid"], [key, "n"])
    named = pairs.select(
        F.struct(F.col("a_qid").alias("qid"), *[F.col(f"a_{c}").alias(c) for c in bounds]).alias("q"),
        F.struct(
            F.col(f"b_{key}").alias(key), F.col("b_n").alias("n"), *[F.col(f"b_{c}").alias(c) for c in bounds]
        ).alias("t"),
    )
    return _judged(named, index, key)


def candidates(index: BoxIndex, boxes: DataFrame, flat_blocks: int | None = None) -> tuple[DataFrame, int]:
    """Block candidates of an index of any size, and a bound on their number.

    Up to flat_blocks blocks are tested one by one. Of more, the pyramid is gone down, and nodes that lie wholly
    in a box are unfolded into their blocks; where blocks can be short, nodes are opened down to their blocks.
    """
    if index.n_blocks <= (FLAT_BLOCKS if flat_blocks is None else flat_blocks):
        return block_candidates(index, boxes)
    if not index.full_blocks:
        _, leaves, bound = level_candidates(index, boxes, open_whole=True)
        return leaves, bound
    whole, leaves, _ = level_candidates(index, boxes)
    bounds = bound_names(index.dims)
    span = F.lit(index.degree).cast("double") ** F.col("level")
    first = (F.col("node") * span).cast("long")
    last = F.least(first + span.cast("long"), F.lit(index.n_blocks)) - 1
    steps = F.sequence(first, last, F.lit(UNFOLD).cast("long"))
    cut = whole.select("qid", *bounds, last.alias("_last"), F.explode(steps).alias("_from"))
    until = F.least(F.col("_from") + UNFOLD - 1, F.col("_last"))
    blocks = cut.select("qid", *bounds, F.explode(F.sequence("_from", until)).alias("block"))
    size = F.least(F.lit(index.degree).cast("long"), F.lit(index.rows) - F.col("block") * index.degree)
    unfolded = with_segment(blocks.withColumns({"n": size, "inside": F.lit(True)}), index.segment_blocks)
    found = written(leaves.unionByName(unfolded.select(*leaves.columns)), "candidates")
    return found, found.count()


def block_candidates(index: BoxIndex, boxes: DataFrame, nested_loop_boxes: int | None = None) -> tuple[DataFrame, int]:
    """Candidates from testing the boxes against the block summaries, and a bound on their number.

    If even all pairs would be few, that product is the bound and nothing runs yet. Otherwise the
    candidates are written and counted. With more than nested_loop_boxes boxes and blocks they meet in a grid.
    """
    most = NESTED_LOOP_BOXES if nested_loop_boxes is None else nested_loop_boxes
    queries = query_boxes(boxes, index)
    n_queries = queries.count()
    if n_queries <= most:
        found = _small_theta(index.blocks, queries, index, "block", queries_small=True)
    elif index.n_blocks <= most:
        found = _small_theta(index.blocks, queries, index, "block", queries_small=False)
    else:
        found = _grid(index.blocks, queries, index, "block")
    found = with_segment(found, index.segment_blocks)
    if n_queries * index.n_blocks <= BROADCAST_ROWS:
        return found, n_queries * index.n_blocks
    found = written(found, "pairs")
    return found, found.count()


def level_candidates(
    index: BoxIndex, boxes: DataFrame, start_level: int | None = None, open_whole: bool = False, lowest: int = 0
) -> tuple[DataFrame, DataFrame, int]:
    """Go down the pyramid from the root, or from a lower level: test its nodes, then only children of hits.

    Returns the upper nodes (qid, bounds, level, node, n) that lie wholly in their box and are not opened, the
    block candidates, and a bound on the number of candidates. With open_whole all nodes are opened. With a `lowest`
    level above the blocks the candidates are its nodes.
    """
    queries = query_boxes(boxes, index)
    n_queries = queries.count()
    sizes = level_sizes(index.n_blocks * index.degree, index.degree)[::-1] or [0]
    start = len(sizes) - 1 if start_level is None else min(start_level, len(sizes) - 1)
    nodes = index.nodes.filter(F.col("level") == start)
    found = _small_theta(nodes, queries, index, "node", queries_small=n_queries <= sizes[start])
    found, bound = _settled(found, n_queries * sizes[start])
    bounds = bound_names(index.dims)
    whole = found.withColumn("level", F.lit(0)).select("qid", *bounds, "level", "node", "n").limit(0)
    for level in range(start - 1, lowest - 1, -1):
        partial = found if open_whole else found.filter(~F.col("inside"))
        if not open_whole:
            closed = found.filter("inside").withColumn("level", F.lit(level + 1))
            whole = whole.unionByName(closed.select("qid", *bounds, "level", "node", "n"))
        partial = partial.drop("n", "inside").withColumnRenamed("node", "parent")
        children = index.nodes.filter(F.col("level") == level).select(
            "parent", F.struct("node", "n", *bounds).alias("t")
        )
        partial = partial.select("parent", "qid", F.struct("qid", *bounds).alias("q"))
        if bound <= broadcast_limit(partial, BROADCAST_ROWS):
            pairs = children.join(F.broadcast(partial), "parent")
        else:
            pairs = skew_join(partial, children, ["parent"], "qid", bound, small_id=["t"])
        found, bound = _settled(_judged(pairs.select("q", "t"), index, "node"), n_queries * sizes[level])
    if lowest:
        return whole, found, bound
    return whole, with_segment(found.withColumnRenamed("node", "block"), index.segment_blocks), bound


def _settled(found: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Leave candidates lazy while all pairs together are few, else write and count them."""
    if most <= BROADCAST_ROWS:
        return found, most
    found = written(found, "descent")
    return found, found.count()


def join_rows(
    index: BoxIndex,
    candidates: DataFrame,
    bound: int,
    points: DataFrame,
    broadcast_rows: int | None = None,
    pruned: bool = False,
) -> DataFrame:
    """Rows of the candidate blocks next to the boxes that want them.

    Few candidates, up to broadcast_rows, are broadcast: the rows are then scanned in place, and the segment key
    lets Spark skip stored segments no box needs. Many candidates are shuffled to the blocks. With `pruned` the
    caller has left out such segments already.
    """
    points = points if pruned else wanted_segments(index, candidates, points, bound)
    few = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    if bound <= broadcast_limit(candidates, few):
        return points.join(F.broadcast(candidates), list(BLOCK_KEYS))
    return block_join(index, candidates, bound, points)


def block_join(index: BoxIndex, candidates: DataFrame, bound: int, points: DataFrame) -> DataFrame:
    """Equi join of candidates and rows by block. Rows of a bucketed index stay where they are stored.

    A block has no more rows than the degree, so only candidates can be many for one block. Blocks that more boxes
    want than one task should meet are few enough for their rows to be broadcast, at most BROADCAST_ROWS of them;
    their candidates are not shuffled at all. Candidates stream past the rows of their block, which are buffered.
    """
    keys = list(BLOCK_KEYS)
    limit = broadcast_limit(points, BROADCAST_ROWS)
    threshold = max(HOT_MIN_ROWS, -(-bound * index.degree // limit))
    wanted = candidates.groupBy(*keys).count().filter(F.col("count") > threshold)
    hot = [r.block for r in wanted.select("block").collect()]
    if not hot:
        return candidates.join(points, keys)
    here = F.col("block").isin(hot)
    cold = candidates.filter(~here).join(points, keys)
    return cold.unionByName(candidates.filter(here).join(F.broadcast(points.filter(here)), keys))


def wanted_segments(index: BoxIndex, candidates: DataFrame, points: DataFrame, bound: int) -> DataFrame:
    """Leave out stored segments no candidate lies in, where a saved index has many of them.

    The list has at most SEGMENT_FILTER entries; with more segments wanted there is little to leave out.
    """
    segments = len(index.parts) or -(-index.n_blocks // index.segment_blocks)
    if segments <= FEW_SEGMENTS or bound == 0:
        return points
    wanted = [r.segment for r in candidates.select("segment").distinct().limit(SEGMENT_FILTER + 1).collect()]
    if len(wanted) > SEGMENT_FILTER:
        return points
    if index.parts:
        return points.filter(F.col("_part").isin(_parts_of(index, wanted)))
    return points.filter(F.col("segment").isin(wanted))


def _parts_of(index: BoxIndex, segments: list[int]) -> list[str]:
    """The stored parts that hold blocks of the given segments."""
    starts, names = zip(*index.parts)
    found: set[str] = set()
    for segment in segments:
        first = segment * index.segment_blocks
        found.update(names[max(0, bisect_right(starts, first) - 1) : bisect_left(starts, first + index.segment_blocks)])
    return sorted(found)
