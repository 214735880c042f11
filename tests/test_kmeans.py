import numpy as np
import pytest
from pyspark.sql import functions as F

from boxquery.functions.nearest import nearest
from boxquery.operators.kmeans import (
    assign_nearest,
    centers_of,
    changed_share,
    kmeans,
    kmeans_cluster,
    pick_seeds,
)

DIMS = ("x", "y", "z")


@pytest.mark.parametrize("k", [1, 7, 32, 33, 900, 4_000])
def test_pruned_nearest_equals_all_distances(k):
    rng = np.random.default_rng(k)
    points = rng.random((5_000, 3), dtype=np.float32)
    points[:2_000] = points[0]
    centers = np.concatenate([points[rng.integers(0, 5_000, k // 2)], rng.random((k - k // 2, 3))]).astype(float)
    gaps = points[:, None, :].astype(float) - centers[None]
    full = ((gaps[..., 0] ** 2 + gaps[..., 1] ** 2) + gaps[..., 2] ** 2).argmin(axis=1)
    assert np.array_equal(nearest(points, centers), full)


def test_equal_points_and_many_equal_centers():
    points, centers = np.full((1_000, 2), 0.25), np.full((100, 2), 0.5)
    assert nearest(points, centers).tolist() == [0] * 1_000
    assert len(nearest(points[:0], centers)) == 0


def test_lowest_number_wins_a_tie():
    centers = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]])
    assert nearest(np.array([[0.0, 0.0], [1.0, 0.0]]), centers).tolist() == [0, 0]


def test_seeds_are_different_rows_and_repeatable(points):
    first = pick_seeds(points, DIMS, 50, seed=3).collect()
    again = pick_seeds(points.repartition(11), DIMS, 50, seed=3).collect()
    assert first == again and sorted(r.cluster for r in first) == list(range(50))
    assert pick_seeds(points, DIMS, 50, seed=4).collect() != first


def lloyd(points, centers, tol, max_iter):
    old = np.full(len(points), -1)
    for done in range(1, max_iter + 1):
        used = centers.copy()
        mine = ((points[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(len(centers)):
            if (mine == c).any():
                centers[c] = points[mine == c].mean(axis=0)
        share, old = (mine != old).mean(), mine
        if share <= tol:
            break
    return used, centers, done, share


@pytest.mark.parametrize("tol, max_iter", [(0.0, 1), (0.0, 4), (0.05, 50)])
def test_rounds_follow_lloyd(points, tol, max_iter):
    model = kmeans(points, DIMS, 8, tol=tol, max_iter=max_iter, seed=1)
    data = points.select(*DIMS).toPandas().to_numpy(dtype=float)
    seeds = centers_of(pick_seeds(points, DIMS, 8, seed=1), DIMS)
    used, centers, done, share = lloyd(data, seeds, tol, max_iter)
    assert model.rounds == done and model.changed == pytest.approx(share)
    assert np.allclose(model.used, used) and np.allclose(model.centers, centers)


def test_empty_cluster_keeps_its_center(spark):
    rows = spark.createDataFrame([(i, 0.1 * (i % 2), 0.0) for i in range(10)], "pid long, x float, y float")
    model = kmeans(rows, ("x", "y"), 4, tol=0.0, max_iter=3, seed=None)
    assert model.rounds == 2 and model.changed == 0.0
    assert np.isfinite(model.centers).all() and len(model.centers) == 4


def test_changed_share(spark):
    old = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 2)], "pid long, cluster long")
    new = spark.createDataFrame([(1, 0), (2, 2), (3, 1), (4, 0)], "pid long, cluster long")
    assert changed_share(old, new).first().changed_share == 0.5


def test_order_keeps_clusters_together(points):
    rows = kmeans_cluster(points, DIMS, 6, seed=2, max_iter=3).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(1, len(rows) + 1))
    assert [(r.crank, r.h, r.pid) for r in rows] == sorted((r.crank, r.h, r.pid) for r in rows)
    assert len({(r.cluster, r.crank) for r in rows}) == len({r.cluster for r in rows})


def test_number_of_clusters_is_checked(points):
    with pytest.raises(ValueError):
        pick_seeds(points, DIMS, 0)


def test_assignment_keeps_every_row(points):
    got = assign_nearest(points, DIMS, pick_seeds(points, DIMS, 20))
    assert got.drop("cluster").exceptAll(points).count() == 0 and got.count() == points.count()
    assert got.agg(F.max("cluster")).first()[0] < 20
