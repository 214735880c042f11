"""Benchmark decontamination: suffix arrays over shards of the documents, searched for every suffix of the benchmark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from boxquery.llm.common import slices, text_bytes
from boxquery.llm.suffixes import Shard, TestItems, places_of
from boxquery.session import written

WINDOW = 13
# Bytes of text in a shard, and bytes of benchmark text searched at once (a larger benchmark takes several rounds).
SHARD_BYTES = 6 << 20
BENCHMARK_BYTES = 32 << 20

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def benchmark_blocks(benchmark: DataFrame, window: int, block_bytes: int, id_col: str, text_col: str) -> Iterator[TestItems]:
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // block_bytes
    for block in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else rows
        yield TestItems(((r["item_id"], r["text"]) for r in part.toLocalIterator()), window)


def _hits(shard: Shard, items: TestItems) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Changes of the number of windows over each word, and pairs (text, sequence) without repeats."""
    _, _, _, low, high = shard.search(items)
    found = np.flatnonzero(high > low)
    change = np.zeros(shard.size + 1, np.int64)
    pairs = [np.zeros(0, np.int64)]
    sequences = len(items.ids)
    for part in np.array_split(found, max(1, int((high - low)[found].sum()) // 4_000_000)):
        places, which = places_of(shard.order, low[part], high[part])
        suffix = part[which]
        change += np.bincount(places, minlength=len(change))
        change -= np.bincount(places + items.need[suffix], minlength=len(change))
        pairs.append(np.unique(shard.text_at(places) * sequences + items.sequence[suffix]))
    pairs = np.unique(np.concatenate(pairs))
    return change, pairs // max(sequences, 1), pairs % max(sequences, 1)


def _mark(batch: pa.RecordBatch, items: TestItems) -> tuple[list[int], list[list], list[list]]:
    """Words, hit spans and item ids of each row, joined with what earlier rounds have found."""
    texts, before = text_bytes(batch.column("text")), batch.column("spans").to_pylist()
    shard = Shard(texts, items)
    change, text, sequence = _hits(shard, items)
    for row, spans in enumerate(before):
        for span in spans:
            change[shard.first[row] + span["start"]] += 1
            change[shard.first[row] + span["end"]] -= 1
    edges = np.diff(np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
    spans: list[list] = [[] for _ in texts]
    for row, start, end in zip(shard.text_at(starts).tolist(), starts.tolist(), ends.tolist()):
        first = int(shard.first[row])
        spans[row].append({"start": start - first, "end": end - first})
    found = [set(ids) for ids in batch.column("items").to_pylist()]
    for row, which in zip(text.tolist(), sequence.tolist()):
        found[row].update(items.ids[which])
    return shard.counts.tolist(), spans, [sorted(ids) for ids in found]


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BENCHMARK_BYTES,
) -> DataFrame:
    """(id, n_words, spans, items) of every row: word ranges inside any benchmark window, and the items they come from.

    A window is `window` consecutive words of an item, or a whole shorter item. Spans that touch are one span.
    Null and empty texts have no words and no spans; an empty benchmark hits nothing. An item with a null id
    hits words but is not listed; repeated items are listed once. Null ids and repeated rows of docs come back
    as they are. Other columns are not carried. Documents are never shuffled: each shard is a batch of whole texts.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = "id {}, text string, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<bigint>".format(kind)
    state = rows.select(
        "id", "text", F.lit(0).cast("bigint").alias("n_words"),
        F.from_json(F.lit("[]"), "array<struct<start:bigint,end:bigint>>").alias("spans"), F.array().cast("array<bigint>").alias("items"),
    )
    blocks = benchmark_blocks(benchmark, window, block_bytes, item_col, item_text_col)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        shared = context.broadcast(block)

        def mark(batches: Iterator[pa.RecordBatch], shared=shared, last=after is None) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, SHARD_BYTES):
                counts, spans, items = _mark(batch, shared.value)
                text = pa.nulls(batch.num_rows, pa.string()) if last else batch.column("text")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), text, pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.int64()))],
                    names=["id", "text", "n_words", "spans", "items"],
                )

        state = state.mapInArrow(mark, schema)
        if after is not None:
            state = written(state, "contamination")
        block = after
    return state.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def judged(found: DataFrame) -> DataFrame:
    """contamination() with n_hit and the verdict: a twentieth or more of the words are hit."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])
    found = found.withColumn("n_hit", hit)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BENCHMARK_BYTES
) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns; null and empty texts stay.

    A benchmark that takes several rounds is judged by id, so that rows of one id go together.
    """
    blocks = benchmark_blocks(benchmark, window, block_bytes, "item_id", "text")
    block = next(blocks)
    if next(blocks, None) is not None:
        found = judged(contamination(docs, benchmark, id_col, text_col, window=window, block_bytes=block_bytes))
        gone = written(found.filter("contaminated").select(id_col).distinct(), "contaminated")
        same = docs[id_col].eqNullSafe(gone[id_col])
        return docs.join(gone, same, "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(block)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SHARD_BYTES):
            n = batch.num_rows
            part = pa.RecordBatch.from_arrays(
                [batch.column(place), pa.array([[]] * n, _SPANS), pa.array([[]] * n, pa.list_(pa.int64()))], names=["text", "spans", "items"]
            )
            counts, spans, _ = _mark(part, shared.value)
            hit = [sum(s["end"] - s["start"] for s in row) for row in spans]
            yield batch.filter(pa.array([not (h > 0 and 20 * h >= c) for h, c in zip(hit, counts)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(item, start, length, id, place): for each word of each item, the longest verbatim match from there on.

    Of equally long matches the one in the smallest id (null first), then at the earliest word, is given. Words that occur
    in no document have no row, and items with a null id none.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["sequence", "start", "length", "id", "place"]
    out = None
    for block in benchmark_blocks(benchmark, 1, BENCHMARK_BYTES, item_col, item_text_col):
        shared = context.broadcast(block)

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in slices(batches, SHARD_BYTES):
                by_id = batch.take(pa.compute.sort_indices(batch.column("id"), null_placement="at_start"))
                shard = Shard(text_bytes(by_id.column("text")), items)
                length, low, high, _, _ = shard.search(items)
                found = np.flatnonzero(length)
                best = np.full(len(length), -1)
                for part in np.array_split(found, max(1, int((high - low)[found].sum()) // 4_000_000)):
                    places, which = places_of(shard.order, low[part], high[part])
                    first = np.concatenate([[0], np.cumsum((high - low)[part])[:-1]]).astype(np.int64)
                    best[part] = np.minimum.reduceat(places, first) if len(part) else best[part]
                text = shard.text_at(best[found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(items.sequence[found]), pa.array(items.start[found]), pa.array(length[found]), by_id.column("id").take(pa.array(text)), pa.array(best[found] - shard.first[text])],
                    names=names,
                )

        longest = rows.mapInArrow(match, f"sequence bigint, start bigint, length bigint, id {kind}, place bigint")
        best = longest.groupBy("sequence", "start").agg(F.min(F.struct((-F.col("length")).alias("less"), "id", "place")).alias("b"))
        ids = [(s, i) for s, several in enumerate(block.ids) for i in several]
        named = docs.sparkSession.createDataFrame(ids, "sequence bigint, item bigint")
        part = best.join(F.broadcast(named), "sequence").select(
            F.col("item").alias(item_col), "start", (-F.col("b.less")).alias("length"), F.col("b.id").alias(id_col), F.col("b.place").alias("place")
        )
        out = part if out is None else out.unionByName(part)
    return out
