"""Fixed-size blocks of ordered rows, their bounding boxes and coarser summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from boxquery.functions.boxes import bound_names, box_of, coordinate_names, hi_names, lo_names

# Fixed value: rows per block and children per node.
DEGREE = 192


def with_block(df: DataFrame, degree: int = DEGREE, ordinal: str = "ordinal") -> DataFrame:
    """Number the blocks of `degree` rows from 0; only the last block may be short."""
    place = F.col(ordinal) - 1
    return df.withColumn("block", F.expr(f"({ordinal} - 1) div {degree}")).withColumn(
        "slot", F.pmod(place, F.lit(degree)).cast("int")
    )


def block_summary(df: DataFrame, dims: Sequence[str], by: Sequence[str] = ("block",)) -> DataFrame:
    """Bounding box, row count and last ordinal of each group of rows."""
    b = box_of(df, dims)
    return df.groupBy(*by).agg(
        *[F.min(c).alias(n) for c, n in zip(b.lo, lo_names(dims))],
        *[F.max(c).alias(n) for c, n in zip(b.hi, hi_names(dims))],
        F.count(F.lit(1)).alias("n"),
        F.max("ordinal").alias("last_ordinal"),
    )


def level_sizes(n: int, degree: int = DEGREE) -> list[int]:
    """Nodes per level for n rows, root first; one block for a single row."""
    sizes: list[int] = []
    while n > 1 or (n == 1 and not sizes):
        n = -(-n // degree)
        sizes.insert(0, n)
    return sizes


def build_levels(
    blocks: DataFrame, dims: Sequence[str], degree: int = DEGREE, n_blocks: int | None = None
) -> DataFrame:
    """Summary pyramid: level 0 holds the blocks, each level above groups `degree` nodes, up to one root.

    Every upper node is computed straight from the blocks below it, so all levels come out of one
    aggregation with map-side combining.
    """
    n = blocks.count() if n_blocks is None else n_blocks
    upper = len(level_sizes(n, degree)) if n > 1 else 0
    leaves = blocks.select(
        F.lit(0).alias("level"),
        F.col("block").alias("node"),
        F.expr(f"block div {degree}").alias("parent"),
        *bound_names(dims),
        "n",
        "last_ordinal",
    )
    if upper == 0:
        return leaves
    steps = F.array(
        *[
            F.struct(F.lit(i).alias("level"), F.expr(f"block div {degree**i}L").alias("node"))
            for i in range(1, upper + 1)
        ]
    )
    above = (
        blocks.select("*", F.explode(steps).alias("_at"))
        .groupBy(F.col("_at.level").alias("level"), F.col("_at.node").alias("node"))
        .agg(
            *[F.min(c).alias(c) for c in lo_names(dims)],
            *[F.max(c).alias(c) for c in hi_names(dims)],
            F.sum("n").alias("n"),
            F.max("last_ordinal").alias("last_ordinal"),
        )
        .withColumn("parent", F.expr(f"node div {degree}"))
    )
    return leaves.unionByName(above)


def level_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("level").agg(F.count(F.lit(1)).alias("nodes"))


def pack_blocks(
    df: DataFrame, dims: Sequence[str], id_col: str = "pid", by: Sequence[str] = ("block",)
) -> DataFrame:
    """One row per block with an array per coordinate, in slot order. A block never exceeds the degree."""
    fields = [id_col, *coordinate_names(df, dims)]
    rows = F.array_sort(F.collect_list(F.struct(*dict.fromkeys(["slot", *fields]))))
    packed = df.groupBy(*by).agg(rows.alias("_rows"))
    return packed.select(
        *by,
        F.size("_rows").alias("n"),
        *[F.col("_rows").getField(f).alias(f) for f in fields],
    )


def unpack_blocks(packed: DataFrame, by: Sequence[str] = ("block",)) -> DataFrame:
    """Inverse of pack_blocks."""
    fields = [c for c in packed.columns if c not in (*by, "n")]
    rows = packed.select(*by, F.posexplode(F.arrays_zip(*fields)).alias("slot", "_row"))
    return rows.select(*by, "slot", *[F.col(f"_row.{f}").alias(f) for f in fields])


def count_entries(blocks: DataFrame) -> DataFrame:
    """Number of rows, from the block summaries alone."""
    return blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entries"))
