"""Multidimensional range queries as Spark DataFrame jobs."""

from boxquery.operators.index import BoxIndex, build_index
from boxquery.plans.range_count import range_count
from boxquery.plans.range_search import range_search

__all__ = ["BoxIndex", "build_index", "range_count", "range_search"]
