"""Hard negatives: for each anchor and each of its nearest rows of its label, rows of other labels a little less near.

A tree of split points (see `gnat`) is fitted on a bounded sample; every row goes to its leaf, and the distance ranges
are taken over all rows. Neighbouring leaves share a bin of some thousand rows, a large leaf has several. A search
first looks into the leaves where the queries lie; with the scores found there it goes to all other leaves that the
tree does not rule out. Leaves are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from boxquery.llm.common import slices
from boxquery.llm.gnat import Tree
from boxquery.session import written

# Vectors that the split points are chosen from, and the bytes that they may take.
SAMPLE, SAMPLE_BYTES = 16_384, 32 << 20
DEGREE = 16
LEAF_ROWS = 1_024
MOST_LEAVES = 4_096  # with their ranges this is what is broadcast; more rows have larger leaves
BIN_ROWS = 16_384  # rows of neighbouring leaves that one group of a task holds
BLOCK = 128  # queries compared with a leaf at once
SLICE_BYTES = 4 << 20
ANY = 1 << 62


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = np.diff(batch.column("vector").offsets.to_numpy())
    for length in np.unique(lengths).tolist():
        yield length, batch.filter(pa.array(lengths == length))


def _trees(rows: DataFrame, sample: int, degree: int, leaf_rows: int, most_leaves: int) -> dict[int, Tree]:
    """A tree for each length of vectors that the sample has; rows of other lengths are few, and all in one leaf."""
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    if not facts["n"]:
        return {}
    sample = max(degree, min(sample, SAMPLE_BYTES // (8 * max(1, facts["width"]))))
    picked = rows.select("vector").orderBy(F.xxhash64("id", F.lit(31)), "id").limit(sample).toPandas()["vector"]
    by_length: dict[int, list] = {}
    for vector in picked:
        by_length.setdefault(len(vector), []).append(vector)
    each = facts["n"] / len(picked)
    leaf_rows = max(leaf_rows, -(-facts["n"] // most_leaves))
    share = {length: max(1, most_leaves * len(found) // len(picked)) for length, found in by_length.items()}
    return {n: Tree(np.array(found, np.float64).reshape(len(found), n), each, degree, leaf_rows, share[n]) for n, found in by_length.items()}


def _routed(rows: DataFrame, trees) -> DataFrame:
    """rows with the leaf of each, written."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            for length, part in _by_length(batch):
                tree = trees.value.get(length)
                leaf = np.zeros(part.num_rows, np.int64) if tree is None else tree.leaf_of(_matrix(part.column("vector")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(leaf), length)), pa.array(leaf)], names=[*part.schema.names, "length", "leaf"])

    found = rows.mapInArrow(route, "id bigint, label string, anchor boolean, vector array<double>, length bigint, leaf bigint")
    return written(found.withColumn("v", F.monotonically_increasing_id()), "gnat-rows")


def _measured(routed: DataFrame, trees) -> dict[int, list[tuple]]:
    """The ranges of every tree over all rows: degree squared numbers for each node."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["length", "node", "i", "j", "least", "most", "short", "long"]
        for batch in slices(batches, SLICE_BYTES):
            for length, part in _by_length(batch):
                if length in trees.value:
                    found = [(length, *row) for row in trees.value[length].measured(_matrix(part.column("vector")))]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*found)], names=names)

    kinds = "length bigint, node bigint, i bigint, j bigint, least double, most double, short double, long double"
    ranges = routed.select("vector").mapInArrow(measure, kinds).groupBy("length", "node", "i", "j")
    out: dict[int, list[tuple]] = {}
    for row in ranges.agg(F.min("least"), F.max("most"), F.min("short"), F.max("long")).collect():
        out.setdefault(row[0], []).append(tuple(row[1:]))
    return out


def _bins(routed: DataFrame, trees: dict[int, Tree], bin_rows: int) -> dict[tuple[int, int], tuple[int, int]]:
    """{(length, leaf): (first bin, bins)}: neighbouring leaves share a bin, a leaf of more rows has several of its own."""
    sizes = routed.filter(F.col("length").isin(list(trees))).groupBy("length", "leaf").count().collect()
    out, number, held, before = {}, -1, math.inf, None
    for length, leaf, n in sorted(map(tuple, sizes)):
        if held + n > bin_rows or length != before:
            number, held = number + 1, 0
        before, bins = length, max(1, -(-n // bin_rows))
        out[length, leaf] = (number, bins)
        number, held = number + bins - 1, held + n if bins == 1 else math.inf
    return out


class _Search:
    """Exact searches over the routed rows."""

    def __init__(self, routed: DataFrame, trees: dict[int, Tree], bin_rows: int):
        self.spark = routed.sparkSession
        for length, ranges in _measured(routed, self.spark.sparkContext.broadcast(trees)).items():
            trees[length].know(ranges)
        bins = _bins(routed, trees, bin_rows)
        self.trees = self.spark.sparkContext.broadcast((trees, bins))
        # a row per leaf
        known = self.spark.createDataFrame([(*key, *value) for key, value in bins.items()], "length bigint, leaf bigint, first bigint, bins bigint")
        placed = routed.join(F.broadcast(known), ["length", "leaf"], "left")
        place = F.coalesce("first", F.lit(0)) + F.pmod(F.xxhash64("v"), F.coalesce("bins", F.lit(1)))
        none = F.lit(None)
        self.rows = placed.select(
            "length", place.alias("bin"), F.lit(0).alias("side"), "leaf", "id", "label", "v", "vector",
            none.cast("array<bigint>").alias("low"), none.cast("array<bigint>").alias("high"), none.cast("array<bigint>").alias("leaves"),
        )

    def _asked(self, queries: DataFrame, home: bool) -> DataFrame:
        """Queries once for each bin with leaves to look into: their own leaf, or all others that the windows reach."""
        shared = self.trees
        names = ["length", "bin", "side", "leaf", "id", "label", "v", "vector", "low", "high", "leaves"]

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, bins = shared.value
            for batch in slices(batches, SLICE_BYTES):
                for length, part in _by_length(batch):
                    own = part.column("leaf").to_numpy()
                    low, high = _windows(part)
                    tree = trees.get(length)
                    if tree is None:
                        reached = np.full((part.num_rows, 1), home)
                    elif home:
                        reached = np.zeros((part.num_rows, tree.leaves), bool)
                        reached[np.arange(len(own)), own] = True
                    else:
                        reached = tree.visits(_matrix(part.column("vector")), low, high)
                        reached[np.arange(len(own)), own] = False
                    leaves_of: dict[int, list[int]] = {}
                    for leaf in np.flatnonzero(reached.any(0)).tolist():
                        first, n = bins.get((length, leaf), (0, 1) if tree is None else (0, 0))
                        for number in range(first, first + n):
                            leaves_of.setdefault(number, []).append(leaf)
                    for number, leaves in leaves_of.items():
                        some = np.flatnonzero(reached[:, leaves].any(1))
                        taken = part.take(pa.array(some))
                        wanted = pa.array([np.array(leaves)[row] for row in reached[np.ix_(some, leaves)]], pa.list_(pa.int64()))
                        full = lambda x: pa.array(np.full(len(some), x, np.int64))
                        columns = {"length": full(length), "bin": full(number), "side": full(1).cast(pa.int32()), "leaf": full(0), "leaves": wanted}
                        yield pa.RecordBatch.from_arrays([columns[name] if name in columns else taken.column(name) for name in names], names=names)

        return queries.select("id", "label", "v", "vector", "leaf", "low", "high").mapInArrow(
            ask, "length bigint, bin bigint, side int, leaf bigint, id bigint, label string, v bigint, vector array<double>, low array<bigint>, high array<bigint>, leaves array<bigint>"
        )

    def _found(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """(v, slot, score, id): the best k of each bin for each window of a query."""

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = None
            for batch in batches:
                keys = np.stack([batch.column("length").to_numpy(), batch.column("bin").to_numpy()])
                cuts = np.flatnonzero((np.diff(keys) != 0).any(0)) + 1
                for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                    key = tuple(keys[:, start].tolist())
                    if now is None or now.key != key:
                        now = _Bin(key)
                    part = batch.slice(start, stop - start)
                    queries = part.column("side").to_numpy() == 1
                    if not queries.all():
                        now.hold(part.filter(pa.array(~queries)))
                    if queries.any():
                        part = part.filter(pa.array(queries))
                        for at in range(0, part.num_rows, BLOCK):
                            yield now.best(part.slice(at, BLOCK), same, k)

        both = self.rows.unionByName(asked)
        dealt = both.repartition("length", "bin").sortWithinPartitions("length", "bin", "side", "leaf", "id")
        return dealt.mapInArrow(compare, "v bigint, slot int, score bigint, id bigint")

    def best(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """(v, slot, rank, score, id): for each window of each query the k rows of highest score, ties by smaller id.

        queries: id, label, v, vector, leaf and the windows as arrays low and high. Rows of the query's label count if
        `same`, else those of all others; rows with the query's id never do.
        """
        first = written(self._found(self._asked(queries, True), same, k), "gnat-home")
        full = _ranked(first, k).groupBy("v", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
        raised = full.groupBy("v").agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("raised"))
        low = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.element_at("raised", i), x)))
        rest = queries.join(raised, "v", "left").withColumn("low", F.when(F.col("raised").isNull(), F.col("low")).otherwise(low))
        return written(_ranked(first.unionByName(self._found(self._asked(rest, False), same, k)), k), "gnat-best")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("v", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """low and high as queries x windows; missing windows are empty."""
    lows, highs = batch.column("low").to_pylist(), batch.column("high").to_pylist()
    width = max([1, *map(len, lows)])
    pad = lambda rows, x: np.array([[*row, *[x] * (width - len(row))] for row in rows], np.float64).reshape(-1, width)
    return pad(lows, 1), pad(highs, 0)


class _Bin:
    """The rows of a bin by leaf and id; queries are compared with the leaves that they ask for."""

    def __init__(self, key: tuple):
        self.key, self.parts, self.vectors = key, [], None

    def hold(self, batch: pa.RecordBatch) -> None:
        self.parts.append((_matrix(batch.column("vector")), batch.column("id").to_numpy(), batch.column("leaf").to_numpy(), batch.column("label").to_pylist()))

    def _settle(self) -> None:
        parts = self.parts or [(np.zeros((0, self.key[0])), np.zeros(0, np.int64), np.zeros(0, np.int64), [])]
        self.vectors, self.ids, leaves = (np.concatenate([part[i] for part in parts]) for i in range(3))
        labels = [label for part in parts for label in part[3]]
        self.codes = {label: i for i, label in enumerate(dict.fromkeys(labels))}
        self.labels = np.array([self.codes[label] for label in labels], np.int64)
        self.leaves = {leaf: (int(np.searchsorted(leaves, leaf)), int(np.searchsorted(leaves, leaf, "right"))) for leaf in np.unique(leaves).tolist()}
        self.parts = []

    def best(self, queries: pa.RecordBatch, same: bool, k: int) -> pa.RecordBatch:
        if self.vectors is None:
            self._settle()
        x, ids, v = _matrix(queries.column("vector")), queries.column("id").to_numpy(), queries.column("v").to_numpy()
        labels = np.array([self.codes.get(label, -1) for label in queries.column("label").to_pylist()], np.int64)
        low, high = _windows(queries)
        wanted: dict[int, list[int]] = {}
        for row, leaves in enumerate(queries.column("leaves").to_pylist()):
            for leaf in leaves:
                wanted.setdefault(leaf, []).append(row)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        for leaf, rows in wanted.items():
            start, stop = self.leaves.get(leaf, (0, 0))
            if start == stop:
                continue
            rows = np.array(rows)
            with np.errstate(invalid="ignore", over="ignore"):
                scores = x[rows] @ self.vectors[start:stop].T
            fits = ((labels[rows][:, None] == self.labels[start:stop]) == same) & (ids[rows][:, None] != self.ids[start:stop])
            for slot in range(low.shape[1]):
                inside = fits & (scores >= low[rows, slot][:, None]) & (scores <= high[rows, slot][:, None])
                some = np.flatnonzero(inside.any(1))
                left, each = np.where(inside[some], scores[some], -np.inf), np.arange(len(some))
                for _ in range(min(k, stop - start)):
                    at = left.argmax(1)  # the first of equal scores has the smallest id
                    top = left[each, at]
                    real = top > -np.inf
                    if not real.any():
                        break
                    found.append((rows[some[real]], np.full(int(real.sum()), slot), top[real], self.ids[start + at[real]]))
                    left[each, at] = -np.inf
        row, slot, score, who = (np.concatenate(column) for column in zip(*found))
        order = np.lexsort((who, -score, slot, row))
        group = (row * low.shape[1] + slot)[order]
        first = np.searchsorted(group, group)
        order = order[np.arange(len(order)) - first < k]
        score = np.clip(score[order], -ANY, ANY).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(v[row[order]]), pa.array(slot[order].astype(np.int32)), pa.array(score), pa.array(who[order])], names=["v", "slot", "score", "id"])


def hard_negatives(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
    sample: int = SAMPLE, degree: int = DEGREE, leaf_rows: int = LEAF_ROWS, most_leaves: int = MOST_LEAVES, bin_rows: int = BIN_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows where `anchor` holds.

    Vectors hold whole numbers; a score is an inner product, exact below 2 to the 53. The positives of an anchor are
    the `positives` other rows of its label with the highest scores, ties by smaller id. For each, the `negatives`
    best rows of other labels with a score of least to most percent of the positive's come back, ranked from 1.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; vectors of different
    lengths are never compared. Rows that share an id are rows of their own, but none is near to the other; a repeated
    anchor repeats its rows. An empty table has no rows. Other columns are not carried.
    """
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector_col, fine))
    rows = rows.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("vector"),
    )
    trees = _trees(rows, sample, degree, leaf_rows, most_leaves)
    routed = _routed(rows, vectors.sparkSession.sparkContext.broadcast(trees))
    search = _Search(routed, trees, bin_rows)
    anchors = routed.filter("anchor").drop("anchor", "length")
    everything = anchors.withColumns({"low": F.array(F.lit(-ANY)), "high": F.array(F.lit(ANY))})
    near = search.best(everything, True, positives).select("v", "rank", "score", F.col("id").alias("positive_id"))
    # at most `positives` for each anchor
    listed = near.groupBy("v").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    asked = anchors.join(listed, "v").select(
        "id", "label", "v", "vector", "leaf",
        F.transform("scores", lambda s: F.ceil(s * least / 100)).alias("low"), F.transform("scores", lambda s: F.floor(s * most / 100)).alias("high"),
    )
    asked = asked.withColumns({name: F.col(name).cast("array<bigint>") for name in ("low", "high")})
    far = search.best(asked, False, negatives).select("v", (F.col("slot") + 1).alias("place"), "rank", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
    named = near.select("v", F.col("rank").alias("place"), "positive_id", F.col("score").alias("positive_score"))
    return far.join(named, ["v", "place"]).join(anchors.select("v", F.col("id").alias("anchor_id")), "v").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
