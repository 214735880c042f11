"""Near-duplicate documents by SimHash at a given similarity of their word shingles.

At a similarity of 0.8 fingerprints differ in some 15 % of their bits, too many for blocks that must agree. So a
fingerprint of 256 bits is sampled: in each of several tables a document goes to the shard of some sampled bits.
Tables and bits follow from the number of documents and the wanted chance to meet. In each shard a BK-tree over
64 of the bits finds what may be near; what is connected so is a candidate group. Fingerprints only make these
groups: inside a group all shingle sets are compared exactly, in blocks that one task holds, and only pairs of the
wanted similarity are links. Shards and blocks give back links that connect, never one row for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from boxquery.llm.bk_trees import BITS, Forest
from boxquery.llm.common import slices, text_bytes
from boxquery.llm.components import Union, components
from boxquery.llm.simhash import FOREST, SLICE_BYTES, SPLIT_ABOVE, majorities, shingle_hashes
from boxquery.session import BROADCAST_ROWS, broadcast_limit, released, written

WORDS = 4  # 64-bit parts of a fingerprint
PRINT = [f"p{i}" for i in range(WORDS)]
SENT = 2  # parts of a fingerprint that go to the shards; the first is in the trees
MISSED = 0.01  # the chance that two documents of exactly the least similarity meet in no table
DEVIATIONS = 4.0  # of a distance above its mean at the least similarity: what may be near
CHANCE = 256  # unrelated documents to a shard
FIRST = 4  # tables that are searched before the others, which then leave out what is connected already
LEADERS = 16  # members of a divided shard that all others are compared with first
TILE = 512  # members of a divided shard that are compared with all others at once
BLOCK, BLOCK_SHINGLES = 1_024, 4_000_000  # documents and shingles of a candidate group that are compared together
COLUMNS = 4_096  # shingles that many documents of a block have, multiplied at once
# Majorities of few shingles differ in more bits than those of many: texts of up to SMALL shingles have tables and
# a radius for this share of bits. Sizes from LARGE on use the expected share; those between have both.
SMALL, LARGE, SMALL_SHARE = 30, 20, 0.22


def _mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Another independent hash made from one."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def differing_share(similarity: float) -> float:
    """The expected share of bits that differ between two sets of equal size and this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables_for(documents: int, share: float, missed: float = MISSED) -> list[list[int]]:
    """Sampled bit places of each table: shards of about CHANCE unrelated documents, tables enough to meet."""
    bits = max(4, math.ceil(math.log2(documents / CHANCE + 1)))
    meet = (1 - share) ** bits
    rng = np.random.default_rng(17)
    return [rng.choice(BITS * WORDS, bits, replace=False).tolist() for _ in range(math.ceil(math.log(missed) / math.log(1 - meet)))]


def _hashes(batch: pa.RecordBatch, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Different shingles of each text, and the fingerprints (texts x WORDS)."""
    sets = [np.unique(np.array(shingle_hashes(text, size), np.uint64)) for text in text_bytes(batch.column("text"))]
    counts = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    return sets, np.stack([majorities(_mixed(flat, turn), counts) for turn in range(WORDS)], axis=1).view(np.int64).reshape(-1, WORDS)


def _prints(rows: DataFrame, shingle: int, kind: str, with_sets: bool) -> DataFrame:
    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            sets, prints = _hashes(batch, shingle)
            sizes = pa.array([len(s) for s in sets], pa.int64())
            columns, names = [batch.column("id"), *(pa.array(prints[:, i]) for i in range(WORDS)), sizes], ["id", *PRINT, "size"]
            if with_sets:
                columns.append(pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())))
                names.append("shingles")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", shingles array<bigint>" if with_sets else ""
    return rows.mapInArrow(fingerprint, f"id {kind}, " + ", ".join(f"{p} bigint" for p in [*PRINT, "size"]) + more)


def _radius(share: float, bits: int = BITS, deviations: float = DEVIATIONS) -> int:
    return max(0, min(bits, round(bits * share + deviations * math.sqrt(bits * share * (1 - share)))))


DEALT = ["shard", "sub", "side", *PRINT[:SENT], "c", "label"]


def _dealt(classes: DataFrame, tables: list[list[int]], small_tables: list[list[int]], which: slice) -> DataFrame:
    """(shard, prints, c, label): each class in one shard for each of the tables, small ones in shards below zero."""
    names = ["shard", *DEALT[3:]]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            size = batch.column("size").to_numpy()
            for part, every, sign in ((batch.filter(pa.array(size >= LARGE)), tables, 1), (batch.filter(pa.array(size <= SMALL)), small_tables, -1)):
                prints = [part.column(p).to_numpy() for p in PRINT]
                for number, places in list(enumerate(every))[which]:
                    bits = np.zeros(part.num_rows, np.int64)
                    for place in places:
                        bits = (bits << 1) | ((prints[place // BITS] >> (place % BITS)) & 1)
                    shard = sign * (1 + bits + (number << len(places)))
                    yield pa.RecordBatch.from_arrays([pa.array(shard), *(part.column(name) for name in names[1:])], names=names)

    return classes.mapInArrow(deal, ", ".join(f"{name} bigint" for name in names))


def _in_blocks(rows: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows with the sub and the side of each; a key in hot is divided into as many blocks as it says there.

    Each two of its blocks meet in one sub, and each block meets itself in another. So all pairs of the key are
    looked at, as in one that is not divided. Sides 1 and 2 are the two blocks of a sub; all else is side 0.
    """
    parts = rows.join(F.broadcast(hot) if hot.count() <= broadcast_limit(hot, BROADCAST_ROWS) else hot, key, "left")
    parts = parts.withColumns({"blocks": F.coalesce("blocks", F.lit(1)), "block": F.expr("pmod(xxhash64(c), coalesce(blocks, 1L))")})
    parts = parts.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    parts = parts.withColumn("sub", F.expr("least(block, other) * blocks + greatest(block, other)"))
    parts = parts.withColumn("side", F.expr("CASE WHEN block = other THEN 0 WHEN block < other THEN 1 ELSE 2 END"))
    return parts.drop("blocks", "block", "other")


def _apart(prints: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[:, a] ^ prints[:, b]).sum(axis=0, dtype=np.int64)


def _join_across(prints: np.ndarray, side: np.ndarray, sets: Union, known: Union, most: int) -> None:
    """Join what is near in the two sides of a sub; in known too, if both are of one side, as that side's own sub finds it.

    All are compared with some leaders first. Those that are connected then need no comparison with each other, so
    a large group of copies costs a few comparisons for each member.
    """
    n = len(side)
    leaders = np.unique(np.linspace(0, n - 1, LEADERS).astype(np.int64))

    def compare(some: np.ndarray) -> None:
        apart = np.bitwise_count(prints[:, some, None] ^ prints[:, None, :]).sum(axis=0, dtype=np.int64)
        i, j = np.nonzero(apart <= most)
        i = some[i]
        within = side[i] == side[j]
        known.join(i[within], j[within])
        sets.join(i, j)

    compare(leaders)
    root = sets.roots(np.arange(n))
    rest = np.flatnonzero(root != np.bincount(root).argmax())
    for start in range(0, len(rest), TILE):
        compare(rest[start : start + TILE])


def _connected(shards: DataFrame, share: float, small_share: float) -> DataFrame:
    """(a, b): links that connect classes near to each other in a shard, beyond those with equal labels."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            held.append(np.stack([batch.column(name).to_numpy() for name in DEALT]))
            rows += batch.num_rows
            if rows >= FOREST:
                table = np.concatenate(held, axis=1)
                last = np.flatnonzero((table[0] == table[0, -1]) & (table[1] == table[1, -1]))[0]
                held, rows = [table[:, last:]], table.shape[1] - last
                if last:
                    yield from both(table[:, :last])
        if held:
            yield from both(np.concatenate(held, axis=1))

    def both(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        small = table[0] < 0
        yield found(table[:, small], small_share)
        yield found(table[:, ~small], share)

    def found(table: np.ndarray, share: float) -> pa.RecordBatch:
        side, prints, (c, label) = table[2], table[3 : 3 + SENT].view(np.uint64), table[3 + SENT :]
        n = len(c)
        shard = np.cumsum(np.concatenate([[0], (np.diff(table[0]) != 0) | (np.diff(table[1]) != 0)])) if n else c
        # what has one label in one shard is connected already
        order = np.lexsort((label, shard))
        same = np.flatnonzero((np.diff(shard[order]) == 0) & (np.diff(label[order]) == 0))
        known, sets = Union(n), Union(n)
        for one in (known, sets):
            one.join(order[same], order[same + 1])
        several = np.bincount(shard[known.roots(np.arange(n)) == np.arange(n)], minlength=shard[-1] + 1 if n else 0)[shard] > 1 if n else side > 0
        most = _radius(share, BITS * SENT)
        whole = np.flatnonzero((side == 0) & several)
        for later, earlier in Forest(prints[0, whole], shard[whole]).earlier_within(_radius(share)):
            later, earlier = whole[later], whole[earlier]
            near = _apart(prints, later, earlier) <= most
            sets.join(later[near], earlier[near])
        divided = np.flatnonzero((side > 0) & several)
        for rows in np.split(divided, np.flatnonzero(np.diff(shard[divided])) + 1) if len(divided) else ():
            own, own_known = Union(len(rows)), Union(len(rows))
            for one, of in ((own, sets), (own_known, known)):
                one.join(np.arange(len(rows)), np.searchsorted(rows, of.roots(rows)))
            _join_across(prints[:, rows], side[rows], own, own_known, most)
            sets.join(rows, rows[own.roots(np.arange(len(rows)))])
            known.join(rows, rows[own_known.roots(np.arange(len(rows)))])
        # the first of each group known before stands for it
        first = np.flatnonzero(known.roots(np.arange(n)) == np.arange(n))
        root = sets.roots(first)
        new = root != first
        return pa.RecordBatch.from_arrays([pa.array(c[first[new]]), pa.array(c[root[new]])], names=["a", "b"])

    dealt = shards.repartition("shard", "sub").sortWithinPartitions("shard", "sub", "c")
    return dealt.mapInArrow(search, "a bigint, b bigint")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets (arrays without repeats) have in common, for pairs (earlier, later)."""
    n = len(sets)
    owner, flat = np.repeat(np.arange(n), [len(x) for x in sets]), np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owner, flat = owner[order], flat[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])[: len(flat)])
    often = np.diff(np.append(first, len(flat)))
    counts, dense = np.zeros((n, n), np.int32), max(8, n // 16)
    # values of few sets: their pairs one by one, those `step` places apart at a time
    left = np.where(often < dense, often, 0)
    ends = np.repeat(first + left, often)
    at, step = np.arange(len(flat)), 1
    while len(at := at[at + step < ends[at]]):
        for start in range(0, len(at), 1 << 20):
            some = at[start : start + (1 << 20)]
            np.add.at(counts.ravel(), owner[some] * n + owner[some + step], 1)
        step += 1
    # values of many sets: products of matrices of zeros and ones
    common = np.flatnonzero(often >= dense)
    for start in range(0, len(common), COLUMNS):
        some = common[start : start + COLUMNS]
        column = np.repeat(np.arange(len(some)), often[some])
        place = np.repeat(first[some] - np.cumsum(often[some]) + often[some], often[some]) + np.arange(len(column))
        holds = np.zeros((n, len(some)), np.float32)
        holds[owner[place], column] = 1
        counts += (holds @ holds.T).astype(np.int32)
    return counts


def _linked(blocks: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect the classes of each block whose shingles are similar."""
    least = Fraction(str(similarity))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, c, sets = None, [], []
        for batch in batches:
            shingles, columns = batch.column("shingles"), zip(*(batch.column(name).to_pylist() for name in ("component", "sub", "c")))
            for row, (component, sub, one) in enumerate(columns):
                if (component, sub) != key:
                    yield links(c, sets)
                    key, c, sets = (component, sub), [], []
                c.append(one)
                sets.append(shingles[row].values.to_numpy())
        yield links(c, sets)

    def links(c: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        groups, c = Union(len(c)), np.array(c, np.int64)
        if len(c) > 1:
            shared, sizes = shared_counts(sets).astype(np.int64), np.array([len(x) for x in sets])
            near = shared * least.denominator >= least.numerator * (sizes[:, None] + sizes - shared)
            groups.join(*np.nonzero(np.triu(near, 1)))
        root = groups.roots(np.arange(len(c)))
        apart = root != np.arange(len(c))
        return pa.RecordBatch.from_arrays([pa.array(c[apart]), pa.array(c[root[apart]])], names=["a", "b"])

    dealt = blocks.repartition("component", "sub").sortWithinPartitions("component", "sub", "c")
    return dealt.mapInArrow(compare, "a bigint, b bigint")


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8,
    missed: float = MISSED, split_above: int = SPLIT_ABOVE, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(id, component_id) of every row: documents linked by a Jaccard similarity of their different shingles.

    Every link is a pair that has this similarity. Two documents come into one candidate group with a chance that
    `missed` and the constants above set, or through others; all pairs of a candidate group are compared. Texts with
    equal fingerprints of 256 bits are one class, so copies cost nothing but their row; texts without words, null ones
    too, are one class. The component is the smallest id reached; null ids are never the smallest. A class of null ids
    only is linked to no other. Repeated rows come back as they are. Other columns are not carried. An empty table
    has no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    prints = written(_prints(rows, shingle, kind, False), "similar-rows")
    classes = prints.groupBy(*PRINT).agg(F.min("id").alias("least"), F.max("size").alias("size"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "similar-classes")
    share = differing_share(similarity)
    small_share = max(share, SMALL_SHARE)
    tables = tables_for(classes.filter(F.col("size") >= LARGE).count(), share, missed)
    small_tables = tables_for(classes.filter(F.col("size") <= SMALL).count(), small_share, missed)

    def connected(some: DataFrame, which: slice) -> DataFrame:
        dealt = _dealt(some, tables, small_tables, which)
        large = dealt.groupBy("shard").count().filter(F.col("count") > split_above)
        hot = written(large.select("shard", F.ceil(F.col("count") / split_above).alias("blocks")), "similar-hot")
        return _connected(_in_blocks(dealt, "shard", hot).select(*DEALT), share, small_share)

    searched = classes.drop("least")
    first = components(connected(searched.withColumn("label", F.col("c")), slice(None, FIRST)), "a", "b")
    labelled = searched.join(first.select(F.col("node").alias("c"), F.col("component").alias("label")), "c", "left")
    labelled = written(labelled.withColumn("label", F.coalesce("label", "c")), "similar-labels")
    rest = connected(labelled, slice(FIRST, None)).unionByName(first.select(F.col("node").alias("a"), F.col("component").alias("b")))
    candidates = components(rest, "a", "b").select(F.col("node").alias("c"), "component")

    # the members of each candidate group: its smallest class too, which components leaves out
    members = candidates.unionByName(candidates.select(F.col("component").alias("c"), "component").distinct())
    members = written(members.join(classes, "c").filter(F.col("least").isNotNull()), "similar-members")
    wanted = members.select(F.col("least").alias("id"), *PRINT, "c", "component")
    own = rows.join(F.broadcast(ids) if (ids := wanted.select("id").distinct()).count() <= broadcast_limit(ids, BROADCAST_ROWS) else ids, "id", "left_semi")
    sets = _prints(own, shingle, kind, True).drop("size").join(wanted, ["id", *PRINT]).select("c", "component", "shingles")
    sets = written(sets.dropDuplicates(["c"]), "similar-sets")
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    needed = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("size") / block_shingles)).alias("blocks")
    blocks = written(sizes.select("component", needed).filter(F.col("blocks") > 1), "similar-blocks")
    links = _linked(_in_blocks(sets, "component", blocks), similarity)

    reached = components(links, "a", "b").withColumnRenamed("node", "c")
    labelled = classes.join(reached, "c", "left").withColumn("component", F.coalesce("component", "c"))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labelled.join(smallest, "component").select(*PRINT, "component_id")
    return prints.drop("size").join(named, PRINT).select(F.col("id").alias(id_col), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with all their columns.

    Rows that share an id stay or go together; rows with a null id stay only where their component has no other id.
    """
    with released(docs.sparkSession):
        found = written(similar_documents(docs, id_col, text_col, **how), "similar-found", keep=True)
    gone = found.filter(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(id_col).distinct()
    known = docs.join(gone.filter(F.col(id_col).isNotNull()), id_col, "left_anti")
    return known if gone.filter(F.col(id_col).isNull()).isEmpty() else known.filter(F.col(id_col).isNotNull())
