"""K-means over points and the order that follows from it.

Only the k centroids pass through the driver, never rows: every round is one scan in which each task
adds up its own rows per cluster. Nothing is carried per row between rounds, so lineage stays flat and
a lost executor costs only its tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from boxquery.functions.hilbert import with_hilbert
from boxquery.functions.nearest import in_slabs, nearest
from boxquery.operators.order import free_names, with_box_hilbert, with_ordinal
from boxquery.session import released, written

# Default number of clusters, rounds and share of changed rows at which to stop.
CLUSTERS = 20_000
ROUNDS = 1_000
CHANGED_SHARE = 1e-5


def pick_seeds(df: DataFrame, dims: Sequence[str], k: int, seed: int | None = 0, id_col: str = "pid") -> DataFrame:
    """(cluster, coordinates) of k different rows in pseudo-random order; seed=None takes the first k ids.

    A threshold that lets about twice k rows through is found first, so that no task sends k rows of its own to
    the final sort: a share of all hashes, or a quantile of the ids. It is widened until k rows are below it.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    order = [F.col(id_col)] if seed is None else [F.xxhash64(F.lit(seed), F.col(id_col)), F.col(id_col)]
    rows = df.select(id_col, *dims)
    total, share = rows.count(), 2.0
    while True:
        wanted = share * k / total if total else 1.0
        if wanted >= 0.5:
            few = rows
            break
        if seed is None:
            few = rows.filter(F.col(id_col) <= rows.agg(F.approx_percentile(id_col, wanted)).first()[0])
        else:
            few = rows.filter(order[0] < int((wanted * 2 - 1) * (1 << 63)))
        if few.count() >= k:
            break
        share *= 4
    picked = few.orderBy(*order).limit(k)
    number = F.row_number().over(Window.orderBy(*order)) - 1
    return picked.select(number.cast("long").alias("cluster"), *[F.col(d).cast("double").alias(d) for d in dims])


def centers_of(centroids: DataFrame, dims: Sequence[str]) -> np.ndarray:
    """The centroids as an array, row number = cluster."""
    frame = centroids.select("cluster", *dims).toPandas().sort_values("cluster")
    n = len(frame)
    if not np.array_equal(frame["cluster"].to_numpy(), np.arange(n)):
        raise ValueError("clusters must be numbered 0..k-1")
    return frame[list(dims)].to_numpy(dtype=np.float64)


def centroid_table(df: DataFrame, centers: np.ndarray, dims: Sequence[str]) -> DataFrame:
    frame = pd.DataFrame(centers, columns=list(dims))
    frame.insert(0, "cluster", np.arange(len(centers), dtype=np.int64))
    return df.sparkSession.createDataFrame(frame)


def finite(df: DataFrame, dims: Sequence[str]) -> list:
    """The coordinates as doubles; a null, NaN or infinite one is an error."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    out = []
    for d in dims:
        c = F.col(d).cast("double")
        out.append(F.when(fine(c), c).otherwise(F.raise_error(F.lit(f"coordinate {d} must be a finite number"))).alias(d))
    return out


def assign_nearest(df: DataFrame, dims: Sequence[str], centroids: DataFrame | np.ndarray) -> DataFrame:
    """Add the nearest centroid of each row as `cluster`; the lowest number wins a tie.

    Only the coordinates go to Python; the other columns stay as they are. A column `cluster` is an error.
    """
    free_names(df, ["cluster"])
    centers = centroids if isinstance(centroids, np.ndarray) else centers_of(centroids, dims)
    shared = df.sparkSession.sparkContext.broadcast(centers)

    @F.pandas_udf("bigint")
    def assign(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        # large groups of rows rule out more centroids at once; the rows come back in order, in larger batches
        for slab in in_slabs(pd.concat(columns, axis=1) for columns in batches):
            yield pd.Series(nearest(slab.to_numpy(dtype=np.float64), shared.value))

    return df.withColumn("cluster", assign(*finite(df, dims)))


@dataclass(frozen=True)
class KMeans:
    """Last assignment rule, centroids after it, rounds run and share of rows the last round moved."""

    used: np.ndarray
    centers: np.ndarray
    rounds: int
    changed: float
    dims: tuple[str, ...]

    def assignments(self, df: DataFrame) -> DataFrame:
        return assign_nearest(df, self.dims, self.used)

    def centroids(self, df: DataFrame) -> DataFrame:
        return centroid_table(df, self.centers, self.dims)


def kmeans(
    df: DataFrame,
    dims: Sequence[str],
    k: int = CLUSTERS,
    tol: float = CHANGED_SHARE,
    max_iter: int = ROUNDS,
    seed: int | None = 0,
    id_col: str = "pid",
) -> KMeans:
    """Lloyd rounds: assign, move each centroid to the mean of its rows, stop when few rows changed.

    An empty cluster keeps its centroid. The share of changed rows compares each row's nearest centroid
    before and after the last move, so no assignment has to be stored. The coordinates are written once before
    the first round, so that an input that is itself a long plan is not evaluated in every round.
    """
    with released(df.sparkSession):
        return _kmeans(written(df.select(id_col, *finite(df, dims)), "kmeans-points"), dims, k, tol, max_iter, seed, id_col)


def _kmeans(
    df: DataFrame, dims: Sequence[str], k: int, tol: float, max_iter: int, seed: int | None, id_col: str
) -> KMeans:
    centers = centers_of(pick_seeds(df, dims, k, seed, id_col), dims)
    before: np.ndarray | None = None
    rounds, changed = 0, 1.0
    while rounds < max_iter:
        sums = _round(df, dims, centers, before)
        counts, totals, moved = sums
        n = counts.sum()
        before, centers = centers, _means(centers, counts, totals)
        rounds, changed = rounds + 1, (moved / n if n else 0.0)
        if changed <= tol:
            break
    return KMeans(centers if before is None else before, centers, rounds, changed, tuple(dims))


def _means(centers: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    out = centers.copy()
    some = counts > 0
    out[some] = totals[some] / counts[some, None]
    return out


def _round(
    df: DataFrame, dims: Sequence[str], centers: np.ndarray, before: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, int]:
    """Row count and coordinate sums per cluster, and how many rows changed cluster."""
    shared = df.sparkSession.sparkContext.broadcast((centers, before))
    columns = list(dims)
    sums = [f"_sum{i}" for i in range(len(columns))]

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, old = shared.value
        k = len(now)
        counts, totals, moved = np.zeros(k, np.int64), np.zeros((k, len(columns))), np.zeros(k, np.int64)
        for slab in in_slabs(frames):
            points = slab[columns].to_numpy(dtype=np.float64)
            mine = nearest(points, now)
            counts += np.bincount(mine, minlength=k)
            for axis in range(len(columns)):
                totals[:, axis] += np.bincount(mine, weights=points[:, axis], minlength=k)
            other = np.ones(len(mine), bool) if old is None else nearest(points, old) != mine
            moved += np.bincount(mine[other], minlength=k)
        seen = np.flatnonzero(counts)
        frame = pd.DataFrame(totals[seen], columns=sums)
        yield frame.assign(cluster=seen, n=counts[seen], moved=moved[seen])

    schema = ", ".join([f"{s} double" for s in sums] + ["cluster bigint", "n bigint", "moved bigint"])
    per_cluster = (
        df.select(*columns)
        .mapInPandas(partial, schema)
        .groupBy("cluster")
        .agg(F.sum("n").alias("n"), F.sum("moved").alias("moved"), *[F.sum(s).alias(s) for s in sums])
        .toPandas()
    )
    shared.unpersist()
    k = len(centers)
    counts, totals = np.zeros(k, np.int64), np.zeros((k, len(columns)))
    at = per_cluster["cluster"].to_numpy(dtype=np.int64)
    counts[at] = per_cluster["n"].to_numpy()
    totals[at] = per_cluster[sums].to_numpy()
    return counts, totals, int(per_cluster["moved"].sum())


def changed_share(old: DataFrame, new: DataFrame, id_col: str = "pid") -> DataFrame:
    """Share of rows whose cluster differs between two assignments."""
    pairs = old.select(id_col, F.col("cluster").alias("_old")).join(
        new.select(id_col, F.col("cluster").alias("_new")), id_col
    )
    return pairs.agg(F.avg((F.col("_old") != F.col("_new")).cast("double")).alias("changed_share"))


def kmeans_cluster(
    df: DataFrame,
    dims: Sequence[str],
    k: int = CLUSTERS,
    id_col: str = "pid",
    seed: int | None = 0,
    max_iter: int = ROUNDS,
    tol: float = CHANGED_SHARE,
    partitions: int | None = None,
) -> DataFrame:
    """Order rows by the Hilbert rank of their cluster's centroid, then by their own Hilbert key.

    Adds `cluster`, `crank`, `h` and `ordinal`. The assignment is written first, because the range shuffle
    reads its input twice.
    """
    model = kmeans(df, dims, k, tol, max_iter, seed, id_col)
    keyed = with_hilbert(model.centroids(df), dims)
    rank = F.row_number().over(Window.orderBy("h", "cluster"))
    ranks = keyed.select("cluster", rank.alias("crank"))
    assigned = written(model.assignments(df), "assigned")
    rows = with_box_hilbert(assigned, dims).join(F.broadcast(ranks), "cluster")
    return with_ordinal(rows, ["crank", "h", id_col], partitions=partitions)
