"""Boxes as plain Column expressions.

A table of boxes has two columns per dimension: `l<dim>` and `h<dim>`. A table of points has one
column per dimension and counts as boxes whose lower and upper corners are equal.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def lo_names(dims: Sequence[str]) -> list[str]:
    return [f"l{d}" for d in dims]


def hi_names(dims: Sequence[str]) -> list[str]:
    return [f"h{d}" for d in dims]


def bound_names(dims: Sequence[str]) -> list[str]:
    return lo_names(dims) + hi_names(dims)


@dataclass(frozen=True)
class Box:
    lo: list[Column]
    hi: list[Column]


def _cols(names: Sequence[str], alias: str | None) -> list[Column]:
    return [F.col(f"{alias}.{n}" if alias else n) for n in names]


def box(dims: Sequence[str], alias: str | None = None) -> Box:
    return Box(_cols(lo_names(dims), alias), _cols(hi_names(dims), alias))


def point(dims: Sequence[str], alias: str | None = None) -> Box:
    cols = _cols(dims, alias)
    return Box(cols, cols)


def has_boxes(df: DataFrame, dims: Sequence[str]) -> bool:
    return set(bound_names(dims)) <= set(df.columns)


def box_of(df: DataFrame, dims: Sequence[str], alias: str | None = None) -> Box:
    """The box of each row of df, whether the rows are boxes or points."""
    return box(dims, alias) if has_boxes(df, dims) else point(dims, alias)


def coordinate_names(df: DataFrame, dims: Sequence[str]) -> list[str]:
    return bound_names(dims) if has_boxes(df, dims) else list(dims)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def overlaps(a: Box, b: Box) -> Column:
    """True when the closed boxes share a point; boxes that only touch count."""
    return all_of([c for i in range(len(a.lo)) for c in (a.lo[i] <= b.hi[i], b.lo[i] <= a.hi[i])])


def contains(outer: Box, inner: Box) -> Column:
    return all_of(
        [c for i in range(len(outer.lo)) for c in (outer.lo[i] <= inner.lo[i], inner.hi[i] <= outer.hi[i])]
    )


def union(a: Box, b: Box) -> Box:
    return Box(
        [F.least(x, y) for x, y in zip(a.lo, b.lo)],
        [F.greatest(x, y) for x, y in zip(a.hi, b.hi)],
    )


def extents(b: Box) -> list[Column]:
    return [h.cast("double") - l.cast("double") for l, h in zip(b.lo, b.hi)]


def volume(b: Box) -> Column:
    return reduce(lambda x, y: x * y, extents(b))


def unit_sphere_volume(d: int) -> float:
    """Volume of the unit sphere in d dimensions, from the Gamma formula."""
    return math.pi ** (d / 2) / math.gamma(d / 2 + 1)


def sphere_volume(b: Box) -> Column:
    """Volume of the sphere through the corners of the box."""
    halves = [e * F.lit(0.5) for e in extents(b)]
    radius = F.sqrt(reduce(lambda x, y: x + y, [h * h for h in halves]))
    power = reduce(lambda x, y: x * y, [radius] * len(halves))
    return power * F.lit(unit_sphere_volume(len(halves)))


def enlargement(b: Box, added: Box) -> Column:
    """How much the sphere volume of a box grows when it takes in another box."""
    return sphere_volume(union(b, added)) - sphere_volume(b)


def dist2(a: Sequence[Column], b: Sequence[Column]) -> Column:
    diffs = [x.cast("double") - y.cast("double") for x, y in zip(a, b)]
    return reduce(lambda x, y: x + y, [v * v for v in diffs])
