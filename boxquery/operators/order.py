"""Row order: Hilbert clustering, dense ordinals, equal partitions and adaptive tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from boxquery.functions.boxes import box_of
from boxquery.functions.hilbert import default_bits, with_hilbert
from boxquery.session import partitions_for, written

# monotonically_increasing_id() keeps the row number within a partition in its low 33 bits.
ROW_BITS = 33

# Fixed value: most rows of an adaptive tile.
TILE_CAPACITY = 128

# Rows of one window group in adaptive_tiles, not counting the rows shared with its neighbours.
TILE_CHUNK = 65_536


# Names that the layout gives to its own columns.
RESERVED = ("h", "ordinal", "block", "slot", "segment")


def free_names(df: DataFrame, names: Sequence[str]) -> None:
    """Raise if df has a column of one of these names, which would be overwritten."""
    taken = [c for c in df.columns if c.lower() in names]
    if taken:
        raise ValueError(f"rename {', '.join(taken)}: the index has columns of that name")


def with_box_hilbert(df: DataFrame, dims: Sequence[str], key: str = "h") -> DataFrame:
    """Hilbert key of points, or of the lower corners of boxes."""
    free_names(df, [key])
    names = [f"_p{i}" for i in range(len(dims))]
    corners = df.select("*", *[c.alias(n) for c, n in zip(box_of(df, dims).lo, names)])
    return with_hilbert(corners, names, key=key).drop(*names)


def hilbert_cluster(
    df: DataFrame, dims: Sequence[str], id_col: str = "pid", partitions: int | None = None
) -> DataFrame:
    """Add the Hilbert key and lay the rows out in key order; ties follow the id."""
    keyed = with_box_hilbert(df, dims)
    keys = ["h", id_col]
    return _ranged(keyed, keys, partitions).sortWithinPartitions(*keys)


def _ranged(df: DataFrame, keys: Sequence[str], partitions: int | None) -> DataFrame:
    n = partitions or partitions_for(df)
    return df.repartitionByRange(n, *keys) if n else df.repartitionByRange(*keys)


def with_ordinal(
    df: DataFrame, keys: Sequence[str], name: str = "ordinal", partitions: int | None = None
) -> DataFrame:
    """Add 1..N in the order of the keys, which must identify a row.

    One range shuffle and one sort. Unless it is a Parquet table, df is evaluated three times: to count its rows,
    to sample its keys and to shuffle it. The sorted rows are written with their place inside their
    partition; the partition sizes, one row per partition, then give every partition its offset.
    Because the last key makes rows distinct, a repeated first key is cut like any other range.
    """
    ranged = _ranged(df, keys, partitions)
    placed = ranged.sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    placed = written(placed, "sorted").withColumn("_part", F.shiftright("_place", ROW_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    row = F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + row + 1)
        .drop("_part", "_place", "_start")
    )


def ordered(
    df: DataFrame,
    dims: Sequence[str],
    cluster: str = "hilbert",
    id_col: str = "pid",
    k: int | None = None,
    seed: int = 0,
    max_iter: int = 1000,
    tol: float = 1e-5,
    partitions: int | None = None,
) -> DataFrame:
    """Rows with their Hilbert key and ordinal, in one of the three supported orders."""
    if cluster == "hilbert":
        return with_ordinal(with_box_hilbert(df, dims), ["h", id_col], partitions=partitions)
    if cluster == "none":
        return with_ordinal(with_box_hilbert(df, dims), [id_col], partitions=partitions)
    if cluster == "kmeans":
        from boxquery.operators.kmeans import kmeans_cluster

        if k is None:
            raise ValueError("cluster='kmeans' needs k")
        return kmeans_cluster(
            df, dims, k, id_col=id_col, seed=seed, max_iter=max_iter, tol=tol, partitions=partitions
        )
    raise ValueError(f"unknown cluster type {cluster!r}")


def with_partition(df: DataFrame, p: int, total: int | None = None, ordinal: str = "ordinal") -> DataFrame:
    """Cut the ordinals into p contiguous ranges of N div p rows; the first also takes the remainder."""
    n = df.count() if total is None else total
    size, rest = divmod(n, p)
    position = f"({ordinal} - 1 - {rest})"
    part = F.lit(0) if size == 0 else F.greatest(F.lit(0), F.expr(f"{position} div {size}"))
    return df.withColumn("part", part.cast("int"))


def adaptive_tiles(
    df: DataFrame,
    dims: Sequence[str],
    capacity: int = TILE_CAPACITY,
    bits: int | None = None,
    chunk: int = TILE_CHUNK,
) -> DataFrame:
    """Add the tile of each row: the coarsest Hilbert cell around it with at most `capacity` rows.

    Needs `h` and `ordinal` from a Hilbert order. A cell is too full exactly when two rows `capacity`
    apart in key order both lie in it, so a row's tile is one level below the deepest cell shared by
    such a pair around it. That is a window over the order. The windows run over chunks of ordinals
    that also hold the neighbouring `capacity` rows, so no group grows with the data. Rows that share
    one full key cannot be split and stay together.
    """
    d = len(dims)
    bits = bits or default_bits(d)
    if chunk < capacity:
        raise ValueError("a chunk must hold at least one tile")
    first = F.expr(f"greatest(ordinal - 1 - {capacity}, 0) div {chunk}")
    last = F.expr(f"(ordinal - 1 + {capacity}) div {chunk}")
    rows = df.withColumn("_own", F.expr(f"(ordinal - 1) div {chunk}"))
    rows = rows.withColumn("_chunk", F.explode(F.sequence(first, last)))
    n = partitions_for(df)
    rows = rows.repartition(n, "_chunk") if n else rows
    order = Window.partitionBy("_chunk").orderBy("ordinal")
    rows = rows.withColumn("_diff", F.col("h").bitwiseXOR(F.lead("h", capacity).over(order)))
    differing = sum((F.shiftright("_diff", d * i) != 0).cast("int") for i in range(bits))
    rows = rows.withColumn("_shared", F.lit(bits) - differing)
    around = order.rowsBetween(-capacity, 0)
    depth = F.least(F.coalesce(F.max("_shared").over(around) + 1, F.lit(0)), F.lit(bits))
    rows = rows.withColumn("depth", depth.cast("int")).filter(F.col("_chunk") == F.col("_own"))
    rows = rows.withColumn("tile", F.expr(f"shiftright(h, {d} * ({bits} - depth))"))
    return rows.drop("_own", "_chunk", "_diff", "_shared")
