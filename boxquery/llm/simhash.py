"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees of shards.

Fingerprints that differ in at most `radius` bits agree in at least one of radius + 1 blocks of bits. So each
goes to one shard per block, and a tree is built and searched in each shard alone. What would have to be sent
to all executors, the trees of all fingerprints, has no bound, so each tree stays with its shard instead. A shard
of many different fingerprints is divided again by blocks of its remaining bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from boxquery.llm.bk_trees import BITS, Forest
from boxquery.llm.common import slices, text_bytes
from boxquery.llm.components import Union, components
from boxquery.session import written

SEED = 42
SLICE_BYTES = 4 << 20
SPLIT_ABOVE = 4_096  # fingerprints of a shard before it is divided
DEEPEST = 4
FOREST = 50_000  # fingerprints whose shards are searched together

_BYTES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of each run of `size` words joined by spaces; all words of a shorter text; nothing without words."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda end, n: end + 1 + n))
    digest, size = xxhash.xxh64_intdigest, min(size, len(words))
    starts = [0, *(end + 1 for end in ends)]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])]


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For runs of hashes: the bits set in over half of them. An empty run is zero."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    first = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
    # byte counters hold 255 rows, so runs are summed in parts
    parts = [np.arange(a, a + n, 255) for a, n in zip(first.tolist(), counts[full].tolist())]
    owner = np.repeat(np.arange(len(full)), [len(p) for p in parts])
    parts = np.concatenate(parts)
    ones = np.empty((len(full), BITS), np.int64)
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    for shift in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(shift)) & _BYTES, parts)
        lanes = sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones[:, shift::8] = np.add.reduceat(lanes, starts, axis=0)
    bits = 2 * ones > counts[full][:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, print) of every row; the print is the fingerprint as a signed number, zero without words."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            hashes, counts = [], []
            for text in text_bytes(batch.column("text")):
                found = shingle_hashes(text, shingle)
                counts.append(len(found))
                hashes.append(np.array(found, np.uint64))
            prints = majorities(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(counts, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints.view(np.int64))], names=["id", "print"])

    return rows.mapInArrow(fingerprint, f"id {kind}, print bigint")


def _places(path: int, ways: int) -> list[list[int]]:
    """The blocks of bit places that are still free at a path of earlier choices (a number with a leading 1)."""
    choices = []
    while path > 1:
        path, choice = divmod(path, ways)
        choices.append(choice)
    free = list(range(BITS))
    for choice in reversed(choices):
        gone = set(np.array_split(free, ways)[choice].tolist())
        free = [p for p in free if p not in gone]
    return [block.tolist() for block in np.array_split(free, ways)]


def _divided(rows: DataFrame, ways: int) -> DataFrame:
    """Each row (path, bits, print) once for each free block, with the block's bits appended."""

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, bits, prints = (batch.column(name).to_numpy() for name in ("path", "bits", "print"))
            for old in np.unique(path).tolist():
                here = path == old
                for choice, block in enumerate(_places(old, ways)):
                    more = bits[here]
                    for place in block:
                        more = (more << 1) | ((prints[here] >> place) & 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(more), old * ways + choice, np.int64)), pa.array(more), pa.array(prints[here])], names=["path", "bits", "print"]
                    )

    return rows.mapInArrow(divide, "path bigint, bits bigint, print bigint")


def links(prints: DataFrame, radius: int, split_above: int = SPLIT_ABOVE, deepest: int = DEEPEST) -> DataFrame:
    """(a, b): links that connect what fingerprints at most radius apart connect, no more than one per print and shard."""
    level = _divided(prints.select(F.lit(1).cast("bigint").alias("path"), F.lit(0).cast("bigint").alias("bits"), "print"), radius + 1)
    shards = []
    for _ in range(deepest - 1):
        hot = written(level.groupBy("path", "bits").count().filter(F.col("count") > split_above).drop("count"), "simhash-hot")
        if hot.isEmpty():
            break
        shards.append(level.join(hot, ["path", "bits"], "left_anti"))
        level = _divided(level.join(hot, ["path", "bits"], "left_semi"), radius + 1)
    shards.append(level)
    every = shards[0]
    for part in shards[1:]:
        every = every.unionByName(part)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            held.append(np.stack([batch.column(name).to_numpy() for name in ("path", "bits", "print")]))
            rows += batch.num_rows
            if rows >= FOREST:
                table = np.concatenate(held, axis=1)
                last = np.flatnonzero((table[0] == table[0, -1]) & (table[1] == table[1, -1]))[0]
                held, rows = [table[:, last:]], table.shape[1] - last
                if last:
                    yield joined(table[:, :last])
        if held:
            yield joined(np.concatenate(held, axis=1))

    def joined(table: np.ndarray) -> pa.RecordBatch:
        shard = np.cumsum(np.concatenate([[0], (np.diff(table[0]) != 0) | (np.diff(table[1]) != 0)])) if table.shape[1] else table[0]
        forest, sets = Forest(table[2].view(np.uint64), shard), Union(table.shape[1])
        for later, earlier in forest.earlier_within(radius):
            sets.join(later, earlier)
        root = sets.roots(np.arange(table.shape[1]))
        apart = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(table[2][apart]), pa.array(table[2][root[apart]])], names=["a", "b"])

    dealt = every.repartition("path", "bits").sortWithinPartitions("path", "bits", "print")
    return dealt.mapInArrow(search, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3,
    split_above: int = SPLIT_ABOVE, deepest: int = DEEPEST,
) -> DataFrame:
    """(id, fingerprint, component_id) of every row: documents linked by fingerprints at most radius bits apart.

    The component is the smallest id that can be reached, the row's own included; null if no id is known there.
    Texts without words, null ones too, have fingerprint zero and are linked like others. Repeated rows come back
    as they are. Other columns are not carried. Equal fingerprints are one before anything is linked, so copies
    cost nothing but their row.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle), "simhash-rows")
    prints = written(rows.groupBy("print").agg(F.min("id").alias("least")), "simhash-prints")
    reached = components(links(prints, radius, split_above, deepest), "a", "b")
    labelled = prints.join(reached.withColumnRenamed("node", "print"), "print", "left").select("print", "least", F.coalesce("component", "print").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    found = labelled.join(smallest, "component").select("print", "component_id")
    return rows.join(found, "print").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
