"""Arrow-batch kernels for choosing one of many candidates per row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd

# Rows looked at together, and below which rows or centers are not pruned any further.
ROWS_TOGETHER = 65_536
CELL_ROWS = 256
FEW_CENTERS = 32

# Entries of one matrix, small enough for the processor cache.
MATRIX = 1 << 15

# Slack for rounding when centroids are ruled out by their distance to a whole group of rows.
SLACK = 1e-9


def in_slabs(frames: Iterator[pd.DataFrame], rows: int = ROWS_TOGETHER) -> Iterator[pd.DataFrame]:
    """Join small Arrow batches up to a useful size."""
    held: list[pd.DataFrame] = []
    size = 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= rows:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if size:
        yield pd.concat(held, ignore_index=True)


def _halved(points: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the points in each part of their box, cut in the middle of every axis."""
    low, high = points.min(axis=0), points.max(axis=0)
    upper = points > (low + high) / 2
    number = upper @ (1 << np.arange(points.shape[1]))
    order = np.argsort(number, kind="stable")
    cuts = np.flatnonzero(np.diff(number[order])) + 1
    return np.split(order, cuts)


def _possible(points: np.ndarray, centers: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The centers that can be nearest to one of the points.

    A center is out when its smallest distance to the box of the points exceeds another center's
    largest distance to it.
    """
    low, high = points.min(axis=0), points.max(axis=0)
    chosen = centers[numbers]
    near = np.maximum(np.maximum(low - chosen, chosen - high), 0)
    far = np.maximum(chosen - low, high - chosen)
    limit = np.einsum("ij,ij->i", far, far).min()
    return numbers[np.einsum("ij,ij->i", near, near) <= limit * (1 + SLACK) + SLACK**2]


def _dist2(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    total = np.zeros((len(points), len(centers)))
    for axis in range(points.shape[1]):
        gap = np.subtract.outer(points[:, axis], centers[:, axis])
        gap *= gap
        total += gap
    return total


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Number of the nearest center of every point; the lowest number wins a tie.

    The points are halved along every axis until few are together or few centers can be nearest to
    them; each part keeps only the centers that are still possible, and compares those exactly.
    """
    points = np.asarray(points, dtype=np.float64)
    out = np.empty(len(points), dtype=np.int64)
    waiting = [(np.arange(len(points)), np.arange(len(centers)))] if len(points) else []
    while waiting:
        rows, numbers = waiting.pop()
        mine = points[rows]
        if len(numbers) > FEW_CENTERS:
            numbers = _possible(mine, centers, numbers)
        if len(rows) > CELL_ROWS and len(numbers) > FEW_CENTERS:
            parts = _halved(mine)
            if len(parts) > 1:
                waiting += [(rows[part], numbers) for part in parts]
                continue
        chosen = centers[numbers]
        step = max(1, MATRIX // len(numbers))
        for start in range(0, len(rows), step):
            part = slice(start, start + step)
            out[rows[part]] = numbers[_dist2(mine[part], chosen).argmin(axis=1)]
    return out


def sphere_volumes(low: Sequence[np.ndarray], high: Sequence[np.ndarray], unit: float) -> np.ndarray:
    """Volume of the sphere through the corners of boxes, given one array per dimension."""
    total = 0.0
    for l, h in zip(low, high):
        half = (h - l) * 0.5
        half *= half
        total = total + half
    radius = np.sqrt(total)
    power = radius.copy()
    for _ in range(len(low) - 1):
        power *= radius
    power *= unit
    return power


def _growths(points: np.ndarray, low: np.ndarray, high: np.ndarray, sizes: np.ndarray, unit: float) -> np.ndarray:
    """How much each box grows by each row (a box itself: lower corner, then upper corner)."""
    d = len(low)
    joined_low = [np.minimum.outer(points[:, i], low[i]) for i in range(d)]
    joined_high = [np.maximum.outer(points[:, d + i], high[i]) for i in range(d)]
    return sphere_volumes(joined_low, joined_high, unit) - sizes[None, :]


def _may_grow_least(points: np.ndarray, low: np.ndarray, high: np.ndarray, sizes: np.ndarray, unit: float) -> np.ndarray:
    """Numbers of the boxes that can be the best one for a row of the group.

    A box grows at least as much as by the smallest common part of all rows (highest lower and lowest upper
    corner), axis by axis, and at most as much as by the box around all rows. What grows more at least than
    another box grows at most is out.
    """
    d = len(low)
    outer = np.concatenate([points[:, :d].min(axis=0), points[:, d:].max(axis=0)])[None, :]
    inner_low, inner_high = points[:, :d].max(axis=0), points[:, d:].min(axis=0)
    least = sphere_volumes(
        [np.minimum(inner_low[i], low[i]) for i in range(d)], [np.maximum(inner_high[i], high[i]) for i in range(d)], unit
    ) - sizes
    most = _growths(outer, low, high, sizes, unit)[0].min()
    return np.flatnonzero(least <= most + SLACK * (1 + abs(most) + sizes))


def least_growth(points: np.ndarray, low: np.ndarray, high: np.ndarray, sizes: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """Per row the box that grows least, and its growth; ties go to the smaller box, then to the earlier one.

    Rows are halved along every axis of their centers until few are together or few boxes are left for them.
    """
    best, growth = np.zeros(len(points), np.int64), np.zeros(len(points))
    d = len(low)
    centers = points[:, :d] + points[:, d:]
    waiting = [(np.arange(len(points)), np.arange(len(sizes)))] if len(points) else []
    while waiting:
        rows, boxes = waiting.pop()
        if len(boxes) > FEW_CENTERS:
            boxes = boxes[_may_grow_least(points[rows], low[:, boxes], high[:, boxes], sizes[boxes], unit)]
        if len(rows) > CELL_ROWS and len(boxes) > FEW_CENTERS:
            parts = _halved(centers[rows])
            if len(parts) > 1:
                waiting += [(rows[part], boxes) for part in parts]
                continue
        step = max(1, MATRIX // len(boxes))
        for start in range(0, len(rows), step):
            part = rows[start : start + step]
            grown = _growths(points[part], low[:, boxes], high[:, boxes], sizes[boxes], unit)
            least = grown.min(axis=1)
            chosen = np.where(grown == least[:, None], sizes[boxes][None, :], np.inf).argmin(axis=1)
            best[part], growth[part] = boxes[chosen], least
    return best, growth
