"""Exact range join of embeddings: pivots cut each label's vectors into cells, which are joined one by one.

On unit vectors a cosine is a distance. A vector belongs to the cell of its nearest pivot, and is repeated in
every other cell where the triangle inequality leaves room for a partner: its distance to that pivot is at most
the cell's radius plus the join radius, and at most two join radii above its distance to its own pivot. Each
cell then counts all partners of its own vectors, so no pair is counted twice and none is written down.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from boxquery.llm.components import Union, components
from boxquery.session import written

# Vectors of a group to each pivot, and own vectors of a cell in one task: a larger cell is cut into several.
CELL = 2_048
# Pivots of all groups: what is broadcast. More vectors get larger cells, which are cut into more tasks.
MOST_PIVOTS = 16_384
BLOCK = 1_024  # partners compared with a cell's own vectors at once
SLACK = 1e-6  # above the rounding of distances


def units(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length one."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _by_group(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    groups = batch.column("grp").to_numpy(zero_copy_only=False)
    for group in dict.fromkeys(groups.tolist()):
        yield group, batch.filter(pa.array(groups == group))


def _vectors(rows: DataFrame) -> DataFrame:
    """(v, grp, embedding, least, n): the different vectors that can have links, numbered, with how often they occur."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf))
    usable = (
        F.col("grp").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", fine) & F.exists("embedding", lambda x: x.cast("double") != 0)
    )
    different = rows.filter(usable).groupBy("grp", "embedding").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    return written(different.withColumn("v", F.monotonically_increasing_id()), "join-vectors")


def _pivots(vectors: DataFrame, cell: int, most: int) -> dict[str, np.ndarray]:
    """Pivots of the groups with more vectors than a cell: about one for each cell, picked by a hash."""
    sizes = vectors.groupBy("grp").agg(F.count("*").alias("size"))
    total = vectors.count()
    cell = max(cell, -(-total // most))
    large = sizes.filter(F.col("size") > cell)
    # at most `most` groups are that large
    draw = F.pmod(F.xxhash64("v", F.lit(11)), F.lit(1 << 31)) / (1 << 31)
    picked = vectors.join(F.broadcast(large), "grp").filter(draw < F.ceil(F.col("size") / cell) / F.col("size"))
    out: dict[str, list] = {}
    for row in picked.select("grp", "embedding").orderBy("grp").toLocalIterator():
        out.setdefault(row["grp"], []).append(row["embedding"])
    return {group: units(pa.array(found, pa.list_(pa.float64()))) for group, found in out.items()}


def range_join(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least_cosine: float = 0.98,
    cell: int = CELL, most_pivots: int = MOST_PIVOTS,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: links join vectors of one label with a cosine of least_cosine or more.

    Null labels, null or empty or zero vectors, vectors with null or non-finite numbers, and vectors of different
    lengths have no links. n_links counts rows, so each copy of a vector is a link of the others. The component is
    the smallest id that links reach, the row's own included; null ids are never the smallest. A row is kept if
    its id is the component's, null with null. Repeated rows come back as they are. Other columns are not carried.
    """
    context = vectors.sparkSession.sparkContext
    group = F.concat_ws(":", F.size(vector_col), F.col(label_col).cast("string"))
    rows = vectors.select(
        F.col(id_col).alias("id"), F.when(F.col(label_col).isNotNull(), group).alias("grp"), F.col(vector_col).alias("embedding")
    )
    different = _vectors(rows)
    number = different.schema["embedding"].dataType.simpleString()
    radius = math.sqrt(max(0.0, 2.0 - 2.0 * least_cosine)) + SLACK
    pivots = context.broadcast(_pivots(different, cell, most_pivots))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, part in _by_group(batch):
                if group not in pivots.value:
                    continue
                apart = _distances(units(part.column("embedding")), pivots.value[group])
                near = apart.argmin(axis=1).astype(np.int32)
                far = apart[np.arange(len(near)), near]
                yield pa.RecordBatch.from_arrays([part.column("grp"), pa.array(near), pa.array(far)], names=["grp", "cell", "apart"])

    # one row per cell of the groups with pivots, no more than there are pivots
    cells = different.select("grp", "embedding").mapInArrow(home, "grp string, cell int, apart double").groupBy("grp", "cell").agg(F.max("apart").alias("radius"), F.count("*").alias("size"))
    known: dict[str, tuple[np.ndarray, np.ndarray]] = {g: (np.full(len(p), -np.inf), np.zeros(len(p), np.int64)) for g, p in pivots.value.items()}
    for row in cells.toLocalIterator():
        known[row["grp"]][0][row["cell"]], known[row["grp"]][1][row["cell"]] = row["radius"], row["size"]
    extents = context.broadcast(known)
    names = ["grp", "cell", "part", "other", "v", "n", "embedding"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, part in _by_group(batch):
                v = part.column("v").to_numpy()
                if group not in pivots.value:
                    yield pa.RecordBatch.from_arrays(
                        [part.column("grp"), *(pa.array(np.zeros(len(v), np.int32)) for _ in range(3)), part.column("v"), part.column("n"), part.column("embedding")], names=names
                    )
                    continue
                reach, sizes = extents.value[group]
                apart = _distances(units(part.column("embedding")), pivots.value[group])
                near = apart.argmin(axis=1)
                own = apart[np.arange(len(v)), near]
                for j in range(len(sizes)):
                    rows = np.flatnonzero((near == j) | ((apart[:, j] <= reach[j] + radius) & (apart[:, j] <= own + 2 * radius)))
                    parts = int(-(-sizes[j] // cell))
                    for p in range(parts):
                        other = (near[rows] != j) | (v[rows] % parts != p)
                        taken = part.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays(
                            [taken.column("grp"), pa.array(np.full(len(rows), j, np.int32)), pa.array(np.full(len(rows), p, np.int32)), pa.array(other.astype(np.int32)), taken.column("v"), taken.column("n"), taken.column("embedding")],
                            names=names,
                        )

    placed = different.select("grp", "v", "n", "embedding").mapInArrow(place, f"grp string, cell int, part int, other int, v bigint, n bigint, embedding {number}")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell_now = None
        for batch in batches:
            keys = list(zip(*(batch.column(name).to_pylist() for name in ("grp", "cell", "part"))))
            start = 0
            while start < len(keys):
                stop = start + 1
                while stop < len(keys) and keys[stop] == keys[start]:
                    stop += 1
                if cell_now is None or cell_now.key != keys[start]:
                    if cell_now is not None:
                        yield from cell_now.finish()
                    cell_now = _Cell(keys[start], least_cosine)
                yield from cell_now.add(batch.slice(start, stop - start))
                start = stop
        if cell_now is not None:
            yield from cell_now.finish()

    dealt = placed.repartition("grp", "cell", "part").sortWithinPartitions("grp", "cell", "part", "other", "v")
    found = written(dealt.mapInArrow(join, "a bigint, b bigint, links bigint"), "join-found")
    counted = found.filter("links IS NOT NULL").select(F.col("a").alias("v"), "links")
    reached = components(found.filter("links IS NULL"), "a", "b").withColumnRenamed("node", "v")
    labelled = different.join(counted, "v").join(reached, "v", "left").withColumn("component", F.coalesce("component", "v"))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    result = labelled.join(smallest, "component").select("grp", "embedding", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id", F.lit(True).alias("linked"))
    every = rows.join(result, ["grp", "embedding"], "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id"))
    return every.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


class _Cell:
    """Own vectors come first; then they are compared with each other and with every block of others."""

    def __init__(self, key: tuple, least: float):
        self.key, self.least = key, least
        self.parts: list[tuple] = []
        self.own = None

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        others = batch.column("other").to_numpy().astype(bool)
        vectors, v, n = units(batch.column("embedding")), batch.column("v").to_numpy(), batch.column("n").to_numpy()
        if not others.all():
            self.parts.append((vectors[~others], v[~others], n[~others]))
        if others.any():
            self._settle()
            for start in range(0, int(others.sum()), BLOCK):
                part = np.flatnonzero(others)[start : start + BLOCK]
                yield self._compare(vectors[part], v[part], n[part])

    def _settle(self) -> None:
        if self.own is None:
            if self.parts:
                vectors, v, n = (np.concatenate(x) for x in zip(*self.parts))
            else:
                vectors, v, n = np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.own, self.v, self.parts = vectors, v, []
            self.links, self.sets = np.zeros(len(v), np.int64), Union(len(v))
            for start in range(0, len(v), BLOCK):
                part = slice(start, start + BLOCK)
                near = self.own @ self.own[part].T >= self.least
                a, b = np.nonzero(near)
                apart = a != b + start
                near[b[~apart] + start, b[~apart]] = False
                self.links += near @ n[part]
                self.sets.join(a[apart], b[apart] + start)

    def _compare(self, vectors: np.ndarray, v: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """Links of own vectors to a block of others: each linked other is tied to one own vector, which ties the rest."""
        if not len(self.v):
            return _found([], [], [])
        near = self.own @ vectors.T >= self.least
        self.links += near @ n
        a, b = np.nonzero(near)
        first = np.full(len(v), len(self.v))
        np.minimum.at(first, b, a)
        self.sets.join(a, first[b])
        linked = first < len(self.v)
        return _found(v[linked], self.v[first[linked]], None)

    def finish(self) -> Iterator[pa.RecordBatch]:
        self._settle()
        root = self.sets.roots(np.arange(len(self.v)))
        apart = root != np.arange(len(root))
        yield _found(self.v[apart], self.v[root[apart]], None)
        yield _found(self.v, None, self.links)


def _found(a, b, links) -> pa.RecordBatch:
    size = len(a)
    column = lambda x: pa.nulls(size, pa.int64()) if x is None else pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays([column(a), column(b), column(links)], names=["a", "b", "links"])
