"""Scoring documents with a gated recurrent language model, next to a smoothed unigram base.

Words: the most frequent ones are symbols of the model, in classes of equal size. All others fall into classes
by a rule on their last letters; the model gives the class, and the word's smoothed share of its class comes
from counts over all training texts. So every text has a probability, and every training word takes part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from boxquery.llm import gru
from boxquery.llm.common import remainder_expr, slices
from boxquery.llm.words import frequent
from boxquery.session import written

SMOOTHING = 0.1
END = b""  # the end of a text is the word that no text has

# Words whose counts are broadcast (about 150 bytes each in a worker), and how many of them the model knows.
BROADCAST_WORDS = 131_072
MODEL_WORDS = 2_048
PER_CLASS = 64
OTHER_CLASSES = 64
HIDDEN = 16

# Training takes all words of every training text. A text of more than RUN_WORDS starts anew after so many words: the
# longest run sets how many lanes a task's words can fill, and with them the time that a word takes.
RUN_WORDS = 16_384
ROUNDS = 1
TASK_WORDS = 4_000_000  # words to a training task, trained side by side
MOST_TASKS = 16_384  # each sends one set of weights; averaging a block of them takes MOST_TASKS times 2 kB at most
WEIGHT_BLOCKS = 256
RATE = 0.02

HELD_BYTES = 24 << 20  # of texts whose words a task counts together
SLICE_BYTES = 4 << 20
SCORED_WORDS = 4_000_000  # words laid out and scored together

_EDGES = b".,;:!?()[]\"'*-_|"


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words between ASCII white space, then the end."""
    words = text.lower().split()
    words.append(END)
    return words


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as words_of gives them, one after the other, and where each text begins and ends there."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    # what stands after the last separator is the empty word
    ended = pc.if_else(pc.equal(trimmed, ""), trimmed, pc.binary_join_element_wise(trimmed, "", " "))
    lists = pc.ascii_split_whitespace(ended)
    return lists.flatten().cast(pa.binary()), lists.offsets.to_numpy()


def other_class(word: bytes, classes: int) -> int:
    """By the last four bytes, without punctuation: endings tell languages and word forms apart."""
    return zlib.crc32(word.rstrip(_EDGES)[-4:]) % classes


def other_classes(words: pa.Array, classes: int) -> np.ndarray:
    """other_class of many words: it is worked out once for each ending."""
    stems = pc.ascii_rtrim(words.cast(pa.string()), characters=_EDGES.decode()).cast(pa.binary())
    endings = pc.binary_slice(stems, -4, None).dictionary_encode()
    found = np.array([other_class(ending, classes) for ending in endings.dictionary.to_pylist()], np.int32)
    return found[endings.indices.to_numpy()]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts; the end is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, SLICE_BYTES):
            held.append(split_words(batch.column(0))[0])
            size += batch.nbytes
            if size >= HELD_BYTES:
                yield counted(held)
                held, size = [], 0
        yield counted(held)

    def counted(held: list[pa.Array]) -> pa.RecordBatch:
        counts = pc.value_counts(pa.chunked_array(held, pa.binary()))
        return pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts")], names=["word", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """index: number of each broadcast word; counts and symbols by that number; totals of the other classes."""

    shape: gru.Shape
    index: dict[bytes, int]
    counts: np.ndarray
    symbols: np.ndarray
    class_words: np.ndarray
    class_distinct: np.ndarray
    words: int
    distinct: int

    @property
    def base_total(self) -> float:
        return self.words + SMOOTHING * (self.distinct + 1)


def vocabulary(counts: DataFrame, model_words: int, broadcast_words: int, hidden: int) -> tuple[Vocabulary, int]:
    """The vocabulary of written counts, and the count from which words are broadcast."""
    common, least = frequent(counts, "word", "n", broadcast_words)
    ranked = sorted(common.items(), key=lambda pair: (-pair[1], pair[0]))
    index = {word.encode(): i for i, (word, _) in enumerate(ranked)}
    shape = gru.Shape(min(model_words, len(index)), PER_CLASS, OTHER_CLASSES, hidden)
    model = {word for word, i in index.items() if i < shape.words}
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(OTHER_CLASSES, np.int64), np.zeros(OTHER_CLASSES, np.int64)
        model_array = pa.array(list(shared.value), pa.binary())
        for batch in slices(batches, SLICE_BYTES):
            words = batch.column("word").cast(pa.binary())
            others = pc.invert(pc.is_in(words, model_array))
            c, m = other_classes(words.filter(others), OTHER_CLASSES), batch.column("n").filter(others).to_numpy()
            np.add.at(n, c, m)
            v += np.bincount(c, minlength=OTHER_CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(range(OTHER_CLASSES), pa.int32()), pa.array(n), pa.array(v)], names=["c", "n", "v"])

    class_words, class_distinct = np.zeros(OTHER_CLASSES), np.zeros(OTHER_CLASSES)
    totals = counts.mapInArrow(classes, "c int, n bigint, v bigint").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    for row in totals.collect():
        class_words[row["c"]], class_distinct[row["c"]] = row["n"], row["v"]
    known = np.array([n for _, n in ranked], dtype=np.float64)
    symbols = [i if i < shape.words else shape.words + other_class(word, OTHER_CLASSES) for word, i in index.items()]
    return Vocabulary(
        shape, index, np.append(known, 0.0), np.array([*symbols, 0], np.int32), class_words, class_distinct,
        int(known[: shape.words].sum() + class_words.sum()), int(shape.words + class_distinct.sum()),
    ), least


def runs(symbols: np.ndarray) -> list[np.ndarray]:
    """All symbols of a text, in runs of RUN_WORDS at most."""
    return [symbols[at : at + RUN_WORDS] for at in range(0, len(symbols), RUN_WORDS)]


def _flat(w: dict) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def trained(texts: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, task_words: int = TASK_WORDS) -> dict:
    """Weights after some rounds of local training in parallel on all words, and averaging.

    texts: (row, symbols), where the row tells texts apart. Rows and weights are taken in order of the rows, so that
    a task that runs again gives the same.
    """
    context, shape = texts.sparkSession.sparkContext, vocab.shape
    unigram = np.bincount(vocab.symbols[: len(vocab.index)], vocab.counts[: len(vocab.index)], shape.symbols)[: shape.words]
    weights = gru.initial(shape, np.concatenate([unigram, vocab.class_words]))
    tasks = int(min(MOST_TASKS, 1 + vocab.words // task_words))
    spread = texts.repartition(tasks, "row").sortWithinPartitions("row")
    for turn in range(rounds if vocab.words else 0):
        start = context.broadcast(weights)

        def learn(batches: Iterator[pa.RecordBatch], start=start, rate=RATE / (1 + 2 * turn)) -> Iterator[pa.RecordBatch]:
            w = {k: v.copy() for k, v in start.value.items()}
            optimiser, seen, held, size, first = gru.Adam(w, rate), 0, [], 0, None

            def learn_held():
                rng = np.random.default_rng(len(held))
                gru.train(w, shape, [held[i] for i in rng.permutation(len(held))], optimiser)

            for batch in batches:
                first = batch.column("row")[0].as_py() if first is None and batch.num_rows else first
                for text in batch.column("symbols"):
                    symbols = text.values.to_numpy().astype(np.int32)
                    held.extend(runs(symbols))
                    size += len(symbols)
                    if size >= 2 * task_words:
                        learn_held()
                        seen, held, size = seen + size, [], 0
            if held:
                learn_held()
            blocks = np.array_split(_flat(w), WEIGHT_BLOCKS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(WEIGHT_BLOCKS), pa.int32()), pa.array([first] * WEIGHT_BLOCKS, pa.int64()), pa.array([float(seen + size)] * WEIGHT_BLOCKS), pa.array([b.tobytes() for b in blocks], pa.binary())],
                names=["block", "task", "weight", "data"],
            )

        def average(table: pa.Table) -> pa.Table:
            table = table.sort_by("task")
            weight = table.column("weight").to_numpy()
            total = sum(np.frombuffer(data.as_py(), np.float32) * (w / max(weight.sum(), 1.0)) for data, w in zip(table.column("data"), weight))
            return pa.table({"block": [table.column("block")[0].as_py()], "data": [total.astype(np.float32).tobytes()]}, schema=pa.schema([("block", pa.int32()), ("data", pa.binary())]))

        sent = spread.mapInArrow(learn, "block int, task bigint, weight double, data binary")
        averaged = sorted(sent.groupBy("block").applyInArrow(average, "block int, data binary").collect())
        weights = _shaped(np.concatenate([np.frombuffer(row["data"], np.float32) for row in averaged]), weights)
    return weights


def language_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_of: int = 10, model_words: int = MODEL_WORDS,
    broadcast_words: int = BROADCAST_WORDS, hidden: int = HIDDEN, rounds: int = ROUNDS, task_words: int = TASK_WORDS,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, as log10 probabilities.

    Rows whose crc32(id as text) is divisible by held_out_of are held out; the others, and rows with a null id,
    are learned from. A null or empty text is the end alone. Repeated rows count as often as they occur and come
    back as they are. Other columns are not carried. An empty table has no rows; if every row is held out, the
    counts are all zero and the model is that of equal shares.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
        F.coalesce(remainder_expr(id_col, held_out_of) == 0, F.lit(False)).alias("held_out"),
    )
    training = rows.filter(~F.col("held_out"))
    counts = written(word_counts(training), "lm-words")
    vocab, least = vocabulary(counts, model_words, broadcast_words, hidden)
    shared = context.broadcast(vocab)
    kind = rows.schema["id"].dataType.simpleString()
    rare_type = pa.list_(pa.struct([("word", pa.string()), ("m", pa.int64())]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        shape = vocab.shape
        logs = np.log10(vocab.counts + SMOOTHING)
        # what a symbol's class costs inside, per word of the class: nothing for words of the model
        inside = np.zeros(shape.symbols)
        inside[shape.words :] = np.log10(vocab.class_words + SMOOTHING * (vocab.class_distinct + 1))
        common = pa.array(list(vocab.index), pa.binary())
        for batch in slices(batches, SLICE_BYTES):
            if not batch.num_rows:
                continue
            words, ends = split_words(batch.column("text"))
            numbers = pc.fill_null(pc.index_in(words, common), -1).to_numpy()
            symbols = vocab.symbols[numbers]
            places = np.flatnonzero(numbers < 0)
            rare = words.take(pa.array(places)).dictionary_encode()
            codes = rare.indices.to_numpy()
            symbols[places] = shape.words + other_classes(rare.dictionary, shape.other_classes)[codes]
            each = logs[numbers]
            each[places] = 0.0
            plus = np.where(symbols >= shape.words, each, 0.0) - inside[symbols]
            # the different rare words of each text, with their counts
            texts_of = np.searchsorted(ends, places, side="right") - 1
            different, times = np.unique(texts_of * max(1, len(rare.dictionary)) + codes, return_counts=True)
            owners, codes = np.divmod(different, max(1, len(rare.dictionary)))
            entries = pa.StructArray.from_arrays([rare.dictionary.take(pa.array(codes)).cast(pa.string()), pa.array(times, pa.int64())], fields=list(rare_type.value_type))
            offsets = np.searchsorted(owners, np.arange(batch.num_rows + 1)).astype(np.int32)
            n_tokens = np.diff(ends)
            n_rare = np.bincount(texts_of, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_tokens - n_rare, pa.int64()),
                    pa.array(np.add.reduceat(each, ends[:-1])), pa.array(np.add.reduceat(plus, ends[:-1])),
                    pa.ListArray.from_arrays(pa.array(offsets), entries, type=rare_type), pa.ListArray.from_arrays(pa.array(ends), pa.array(symbols)),
                ],
                names=["id", "held_out", "n_tokens", "known", "base", "plus", "rare", "symbols"],
            )

    looked_up = rows.mapInArrow(
        look_up, f"id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, plus double, rare array<struct<word:string,m:bigint>>, symbols array<int>"
    )
    looked_up = written(looked_up.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    weights = context.broadcast(trained(looked_up.filter(~F.col("held_out")).select("row", "symbols"), vocab, rounds, task_words))
    carried = ["row", "id", "held_out", "n_tokens", "known", "base"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, size = [], [], 0

        def scored() -> Iterator[pa.RecordBatch]:
            found, at = gru.score(weights.value, shared.value.shape, texts) / np.log(10), 0
            for batch in held:
                part = found[at : at + batch.num_rows] + batch.column("plus").to_numpy()
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in carried), pa.array(part)], names=[*carried, "score"])

        for batch in batches:
            held.append(batch.drop_columns(["symbols"]))
            for text in batch.column("symbols"):
                texts.append(text.values.to_numpy())
                size += len(texts[-1])
            if size >= SCORED_WORDS:
                yield from scored()
                held, texts, size = [], [], 0
        yield from scored()

    model = looked_up.drop("rare").mapInArrow(score, f"row bigint, id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, score double")
    c = F.coalesce("n", F.lit(0))
    rest = (
        looked_up.select("row", F.explode("rare").alias("r"))
        .select("row", "r.word", "r.m")
        .join(counts.filter(F.col("n") < least), "word", "left")
        .groupBy("row")
        .agg(F.sum(F.col("m") * F.log10(c + SMOOTHING)).alias("others"), F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("more"))
    )
    others, total = F.coalesce("others", F.lit(0.0)), float(np.log10(vocab.base_total))
    return model.join(rest, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(vocab.words).cast("long").alias("train_tokens"), (F.col("base") + others - F.col("n_tokens") * total).alias("base_score"),
        (F.col("score") + others).alias("score"),
    )
