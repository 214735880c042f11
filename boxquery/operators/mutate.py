"""Adding and removing rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from boxquery.functions.boxes import bound_names, box, box_of, coordinate_names, hi_names, lo_names, overlaps
from boxquery.operators.index import STORED_COLUMNS, BoxIndex, index_of, segment_size
from boxquery.operators.order import with_box_hilbert, with_ordinal
from boxquery.plans.candidates import upright, wanted_segments
from boxquery.session import BROADCAST_ROWS, ROWS_PER_PARTITION, SPREAD_SEGMENTS, broadcast_limit, skew_join, written

PLACE_COLUMNS = ("segment", "block", "slot", "ordinal", *STORED_COLUMNS)

# How far a segment may grow past its stored size and still be numbered in one task.
SEGMENT_GROWTH = 2


def order_keys(index: BoxIndex) -> list[str]:
    if index.cluster == "none":
        return [index.id_col]
    if index.cluster == "kmeans":
        return ["crank", "h", index.id_col]
    return ["h", index.id_col]


def _rebuilt(index: BoxIndex, rows: DataFrame) -> BoxIndex:
    ordered = with_ordinal(rows, order_keys(index))
    return index_of(ordered, index.dims, index.degree, index.id_col, index.cluster)


def _renumbered(index: BoxIndex, rows: DataFrame) -> BoxIndex:
    """Index over rows that know the stored segment they belong to, in the order of the segments and the keys.

    The order of segments is known, so nothing is sampled or sorted across them: rows are counted per segment
    and numbered inside it. A segment has about a gigabyte of rows. One that has grown to more than SEGMENT_GROWTH
    times its stored size, as when all new rows fall into one region, or past what one task should sort, is numbered
    by a range shuffle over its keys. The rows are read more than once.
    """
    keys = order_keys(index)
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    grown = F.col("count") > min(SEGMENT_GROWTH * index.segment_blocks * index.degree, ROWS_PER_PARTITION)
    counted = rows.groupBy("segment").count().withColumns({"_grown": grown, "_in_grown": F.when(grown, F.col("count"))})
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("count", "_first"), ("_in_grown", "_grown_first"))]
    starts = written(counted.select("segment", "_grown", *sums), "segments")
    placed = rows.join(F.broadcast(starts), "segment")
    place = F.row_number().over(Window.partitionBy("segment").orderBy(*keys))
    segments = -(-index.n_blocks // max(index.segment_blocks, segment_size(index.n_blocks)))  # small ones share a task
    numbered = placed.filter(~F.col("_grown")).repartition(SPREAD_SEGMENTS * max(1, segments), "segment").withColumn("_nth", place)
    if not starts.filter("_grown").isEmpty():
        cut = with_ordinal(placed.filter("_grown"), ["segment", *keys], "_nth")
        numbered = numbered.unionByName(cut.withColumn("_nth", F.col("_nth") - F.col("_grown_first")))
    numbered = numbered.withColumn("ordinal", F.col("_first") + F.col("_nth"))
    numbered = numbered.drop("segment", "_nth", "_first", "_grown", "_grown_first")
    return index_of(written(numbered, "renumbered"), index.dims, index.degree, index.id_col, index.cluster)


def _segment_of(index: BoxIndex, added: DataFrame) -> DataFrame:
    """Add the stored segment whose range of keys each new row falls into; the first one also takes earlier rows."""
    keys = order_keys(index)
    if index.full_blocks:
        first = index.points.filter((F.col("slot") == 0) & (F.col("block") % index.segment_blocks == 0))
    else:
        first = index.points.groupBy("segment").agg(F.min(F.struct(*keys)).alias("_first")).select("_first.*", "segment")
    return in_ranges(added, keys, sorted(first.select(*keys, "segment").collect()), "segment")


def in_ranges(added: DataFrame, keys: list[str], bounds: list[tuple], name: str) -> DataFrame:
    """Add the number of the range each row falls into; `bounds` are the first keys and the number of each, in order."""
    shared = added.sparkSession.sparkContext.broadcast([np.array(column) for column in zip(*bounds)])

    @F.pandas_udf("bigint")
    def segment(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        *heads, numbers = shared.value
        for columns in batches:
            values = [c.to_numpy() for c in columns]
            # the last head that is not above the row: by the first key, then among equal ones by the second
            low = np.searchsorted(heads[0], values[0], "left")
            high = np.searchsorted(heads[0], values[0], "right")
            at = high - 1
            for i in np.flatnonzero(high - low) if len(heads) > 1 else ():
                at[i] = low[i] + np.searchsorted(heads[1][low[i] : high[i]], values[1][i], "right") - 1
            yield pd.Series(numbers[np.maximum(at, 0)])

    return added.withColumn(name, segment(*keys))


def insert(index: BoxIndex, rows: DataFrame, checked: bool = False) -> BoxIndex:
    """Index over the old and the new rows. Keys are computed for the new rows only; places are redone.

    All columns of the index stay; new rows get null where they lack one, and may not bring others. Ids must be
    new: of rows that share a key and an id, the order would be arbitrary, so repeated ids are an error. With `checked`
    the caller knows that they are. Only the new rows are written before all are put in order.
    """
    added, stored = new_to(index, rows, checked), index.points.drop(*PLACE_COLUMNS)
    if index.rows == 0 or rows.count() > index.rows:  # most of the order is new
        return _rebuilt(index, stored.unionByName(added, allowMissingColumns=True))
    stored = index.points.drop(*[c for c in PLACE_COLUMNS if c != "segment"])
    placed = written(_segment_of(index, added), "added")
    return _renumbered(index, stored.unionByName(placed, allowMissingColumns=True))


def new_to(index: BoxIndex, rows: DataFrame, checked: bool = False) -> DataFrame:
    """The rows with their keys; an error where the index cannot take them. The ids of `checked` rows are new."""
    if index.cluster == "kmeans":
        raise ValueError("rows of a k-means index must be clustered again with build_index")
    stored = index.points.drop(*PLACE_COLUMNS)
    unknown = [c for c in rows.columns if c not in stored.columns or c == "h"]
    if unknown:
        raise ValueError(f"the index has no column {', '.join(unknown)} to insert into")
    if checked:
        return with_box_hilbert(rows, index.dims)
    repeated = rows.groupBy(index.id_col).count().filter("count > 1").select(index.id_col)
    known = rows.select(index.id_col).join(stored.select(index.id_col), index.id_col, "left_semi")
    clash = repeated.unionByName(known).head()
    if clash is not None:
        raise ValueError(f"{index.id_col} {clash[0]} is there already or comes twice")
    return with_box_hilbert(rows, index.dims)


def match_deletes(index: BoxIndex, deletes: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Requests (request, id, box) that meet a row: same id, and the row's box overlaps the given box.

    Of a saved index, only segments with blocks in the box around all requests are read. `carried` columns of the
    row come along.
    """
    upright(deletes.withColumnRenamed("request", "qid"), index.dims)
    coords = coordinate_names(index.points, index.dims)
    around = deletes.agg(
        *[F.min(n).alias(n) for n in lo_names(index.dims)], *[F.max(n).alias(n) for n in hi_names(index.dims)]
    )
    near_blocks = index.blocks.alias("t").join(F.broadcast(around.alias("q")), overlaps(box(index.dims, "q"), box(index.dims, "t")))
    stored = wanted_segments(index, near_blocks.select("t.segment"), index.points, index.n_blocks)
    rows = stored.select(index.id_col, *carried, F.struct(*coords).alias("p"))
    wanted = deletes.select("request", index.id_col, F.struct(*bound_names(index.dims)).alias("q"))
    requests = wanted.count()
    if requests <= broadcast_limit(wanted, BROADCAST_ROWS):
        pairs = rows.join(F.broadcast(wanted), index.id_col)
    else:
        pairs = skew_join(wanted, rows, [index.id_col], "request", requests, small_id=["p"])
    near = overlaps(box_of(index.points, index.dims, "p"), box(index.dims, "q"))
    return pairs.filter(near).select("request", index.id_col, *carried)


def remove(index: BoxIndex, deletes: DataFrame) -> tuple[BoxIndex, DataFrame]:
    """Index without the matched rows, and (request, id, found) for every request."""
    matched = written(match_deletes(index, deletes), "matched")
    gone = matched.select(index.id_col).distinct()
    kept = index.points.drop(*[c for c in PLACE_COLUMNS if c != "segment"]).join(gone, index.id_col, "left_anti")
    return _renumbered(index, written(kept, "changed")), with_found(index, deletes, matched)


def with_found(index: BoxIndex, deletes: DataFrame, matched: DataFrame) -> DataFrame:
    """(request, id, found) for every request."""
    found = deletes.select("request", index.id_col).join(
        matched.select("request", F.lit(True).alias("_hit")), "request", "left"
    )
    return found.select("request", index.id_col, F.coalesce("_hit", F.lit(False)).alias("found"))
