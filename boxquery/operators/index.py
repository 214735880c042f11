"""The ordered rows together with their block summaries and pyramid."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from boxquery.operators.blocks import DEGREE, block_summary, build_levels, with_block
from boxquery.operators.order import RESERVED, free_names, ordered
from boxquery.session import written

# Blocks per stored segment: enough segments for parallel reads of small data, and about a gigabyte
# per segment (fifty million rows) for large data.
SEGMENTS_WANTED = 64
SEGMENT_BLOCKS_MAX = 262_144

# Columns by which blocks are joined to their rows.
BLOCK_KEYS = ("segment", "block")

# Most rows of a unit, in which many boxes meet the rows of consecutive blocks; the segments of a bucketed index.
UNIT_ROWS = 36_864

# Where a row of an index that takes changes is stored: its part, block in the part and slot in the block.
STORED_COLUMNS = ("_part", "_block", "_slot")


@dataclass(frozen=True)
class Taken:
    """The rows beside a saved index that an opened one holds: the version they came to, their files and batches."""

    version: tuple
    files: list[str]
    last: dict[str, int]
    any_new: bool


@dataclass(frozen=True)
class BoxIndex:
    """points(segment, block, slot, ordinal, h, id, coordinates), blocks, nodes.

    An index opened by `sources.changes` names its stored parts in order, each with its first block. The last block
    of a part, and blocks that lost rows, are short there; in all others only the very last block is. The points of a
    bucketed index are stored by the hash of their segment. `taken` tells which inserted rows `load_index` has merged.
    """

    points: DataFrame
    blocks: DataFrame
    nodes: DataFrame
    dims: tuple[str, ...]
    rows: int
    n_blocks: int
    segment_blocks: int
    degree: int = DEGREE
    id_col: str = "pid"
    cluster: str = "hilbert"
    parts: tuple[tuple[int, str], ...] = ()
    by_segment: bool = False
    taken: Taken | None = None

    @property
    def full_blocks(self) -> bool:
        return not self.parts

    def with_tables(self, **tables: DataFrame) -> BoxIndex:
        return replace(self, taken=None, **tables)


def segment_size(n_blocks: int) -> int:
    return max(1, min(SEGMENT_BLOCKS_MAX, -(-n_blocks // SEGMENTS_WANTED)))


def with_segment(df: DataFrame, segment_blocks: int) -> DataFrame:
    return df.withColumn("segment", F.expr(f"block div {segment_blocks}"))


def with_small_segments(index: BoxIndex) -> BoxIndex:
    """The same index with segments of at most UNIT_ROWS rows."""
    size = min(index.segment_blocks, max(1, UNIT_ROWS // index.degree))
    return replace(
        index,
        points=with_segment(index.points, size),
        blocks=with_segment(index.blocks, size),
        segment_blocks=size,
    )


def index_of(
    rows: DataFrame,
    dims: Sequence[str],
    degree: int = DEGREE,
    id_col: str = "pid",
    cluster: str = "hilbert",
) -> BoxIndex:
    """Index over rows that already carry an ordinal."""
    placed = with_block(rows, degree)
    summary = written(block_summary(placed, dims), "blocks")
    totals = summary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n, n_blocks = int(totals[0]), int(totals[1])
    size = segment_size(n_blocks)
    summary = with_segment(summary, size)
    return BoxIndex(
        points=with_segment(placed, size),
        blocks=summary,
        nodes=build_levels(summary, dims, degree, n_blocks),
        dims=tuple(dims),
        rows=n,
        n_blocks=n_blocks,
        segment_blocks=size,
        degree=degree,
        id_col=id_col,
        cluster=cluster,
    )


def with_full_blocks(index: BoxIndex) -> BoxIndex:
    """The same rows in the same order, with blocks of `degree` rows."""
    if index.full_blocks:
        return index
    rows = index.points.drop("segment", "block", "slot", *STORED_COLUMNS)
    return index_of(rows, index.dims, index.degree, index.id_col, index.cluster)


def build_index(
    df: DataFrame,
    dims: Sequence[str],
    degree: int = DEGREE,
    cluster: str = "hilbert",
    id_col: str = "pid",
    **order_options,
) -> BoxIndex:
    """Order the rows, cut them into blocks and summarise the blocks. Other columns stay with their rows."""
    free_names(df, RESERVED if cluster != "kmeans" else (*RESERVED, "cluster", "crank"))
    rows = ordered(df, dims, cluster, id_col, **order_options)
    return index_of(rows, dims, degree, id_col, cluster)
