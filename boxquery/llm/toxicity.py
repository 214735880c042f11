"""Toxicity by non-negative positive-unlabelled learning.

Known positives are documents labelled toxic; everything else, labelled or not, is unlabelled. The risk of a
classifier g with class prior p is p R+(positives) + max(0, R-(unlabelled) - p R-(positives)): the unlabelled
texts count as negative, corrected for the positives among them, and the correction is kept from going below
zero. Several linear classifiers are trained side by side on parts of a bounded sample, and averaged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from boxquery.llm.common import remainder_expr, slices, text_bytes
from boxquery.llm.suffixes import words_of

THRESHOLD = 0.7
BUCKETS = 1 << 20
PREFIXES = (3, 4, 5, 6)
# The sample that the classifiers are fitted on, about this many texts each, picked by a hash of the id.
POSITIVES, UNLABELLED = 4_000, 12_000
CLASSIFIERS = 4
# A feature is used if it occurs in enough of the positives, and clearly more often there than in unlabelled texts.
LEAST_SHARE, LEAST_TEXTS, LEAST_RATIO, LEAST_DEVIATION = 0.005, 4, 2.0, 6.0
FEATURES = 4_096  # so many of them at most, the clearest ones
DEFAULT_PRIOR = 0.1  # only where no label is negative
STEPS, RATE, L2 = 300, 0.05, 2e-4

SLICE_BYTES = 4 << 20
HELD_WORDS = 200_000


def buckets_of(word: bytes) -> list[int]:
    """A word's features: itself and its beginnings, so that inflected forms of a stem share some."""
    found = [zlib.crc32(word) % BUCKETS]
    for n in PREFIXES:
        if len(word) > n:
            found.append(zlib.crc32(word[:n], n) % BUCKETS)
    return found


def features(text: bytes) -> np.ndarray:
    """The buckets of all different words, with repeats."""
    return np.array([b for word in sorted(set(words_of(text))) for b in buckets_of(word)], dtype=np.int32)


class Documents:
    """Rows of feature counts, as flat arrays of row and column."""

    def __init__(self, rows: list[np.ndarray]):
        self.size = len(rows)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)

    def shares(self) -> np.ndarray:
        """The share of rows that have each bucket."""
        pairs = np.unique(self.row * BUCKETS + self.column)
        return np.bincount(pairs % BUCKETS, minlength=BUCKETS) / max(1, self.size)

    def keep(self, number: np.ndarray) -> None:
        """Renumber the columns; -1 leaves one out."""
        column = number[self.column]
        self.row, self.column = self.row[column >= 0], column[column >= 0]

    def logits(self, w: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column], minlength=self.size) + bias

    def gradient(self, slope: np.ndarray, columns: int) -> np.ndarray:
        return np.bincount(self.column, weights=slope[self.row], minlength=columns)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def risk(z_positive: np.ndarray, z_unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk: of positives as positives, and the corrected one of negatives, which may be below zero."""
    loss = lambda z: float(np.logaddexp(0, z).mean())
    return prior * loss(-z_positive), loss(z_unlabelled) - prior * loss(z_positive)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias) of one linear classifier."""
    p, u = Documents(positive), Documents(unlabelled)
    if not p.size or not u.size:
        return np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior)))
    share_p, share_u = p.shares(), u.shares()
    # features that positives have more often than chance gives them, in units of its deviation
    chance = np.maximum(share_u, 1 / u.size)
    tells = (share_p - chance) / np.sqrt(chance / p.size)
    usual = np.flatnonzero((share_p >= LEAST_SHARE) & (share_p * p.size >= LEAST_TEXTS) & (share_p >= LEAST_RATIO * chance) & (tells >= LEAST_DEVIATION))
    chosen = np.sort(usual[np.argsort(-tells[usual], kind="stable")[:FEATURES]])
    number = np.full(BUCKETS, -1)
    number[chosen] = np.arange(len(chosen))
    p.keep(number)
    u.keep(number)
    w, bias = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, steps + 1):
        zp, zu = p.logits(w, bias), u.logits(w, bias)
        sp, su = _sigmoid(zp), _sigmoid(zu)
        # slopes of the corrected negative part; below zero it is climbed, and the positive part left alone
        np_slope, nu_slope = -prior * sp / p.size, su / u.size
        if risk(zp, zu, prior)[1] >= 0:
            np_slope = np_slope - prior * (1 - sp) / p.size
        else:
            np_slope, nu_slope = -np_slope, -nu_slope
        g = np.append(p.gradient(np_slope, len(w)) + u.gradient(nu_slope, len(w)) + L2 * w, np_slope.sum() + nu_slope.sum())
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w = np.maximum(w - step[:-1], 0.0)  # a usual word is no excuse for another
        bias -= step[-1]
    return chosen, w, bias


def score_texts(texts: Iterable[bytes], weights: np.ndarray, bias: float, known: dict[bytes, float]) -> list[float]:
    """Probabilities of being toxic. `known` keeps the weights of words between calls."""
    out = []
    for text in texts:
        words = set(words_of(text))
        found = list(map(known.get, words, repeat(None)))
        if None in found:
            for word in words:
                if word not in known:
                    known[word] = float(weights[buckets_of(word)].sum())
            found = list(map(known.__getitem__, words))
        found.sort()  # so that the sum does not depend on the order of a set
        out.append(float(_sigmoid(np.float64(bias + sum(found)))))
        if len(known) > HELD_WORDS:
            known.clear()
    return out


def trained(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic",
    positives: int = POSITIVES, unlabelled: int = UNLABELLED, classifiers: int = CLASSIFIERS, prior: float | None = None, salt: int = 5,
) -> tuple[np.ndarray, float]:
    """Averaged weights by bucket, and the bias.

    The prior is the share of toxic rows among labelled ones unless it is given. Null labels and ids are not
    labels; an id labelled more than once is positive if any of its labels is. Without positives the bias alone is left.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(toxic_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(toxic_col).cast("int").alias("toxic"))
    row = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    n, p = row["n"], row["p"] or 0
    prior = prior or (p / n if 0 < p < n else DEFAULT_PRIOR)
    total = docs.count()
    draw = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) / (1 << 30)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    wanted = known.filter("toxic = 1").filter(draw < positives / max(p, 1)).select("id", F.lit(1).alias("positive"))
    # ids only: the join keeps the few wanted texts, and no text is shuffled
    sample = rows.join(F.broadcast(wanted), "id").select("id", "text", "positive").unionByName(
        rows.filter(draw < unlabelled / max(total, 1)).select("id", "text", F.lit(0).alias("positive"))
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            found = [features(text) for text in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("positive"), pa.array(found, pa.list_(pa.int32()))], names=["part", "positive", "features"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        flags = table.column("positive").to_numpy()
        rows = [r.values.to_numpy() for r in table.column("features")]
        ordered = sorted(range(len(rows)), key=lambda i: rows[i].tobytes())
        chosen, w, bias = fit([rows[i] for i in ordered if flags[i]], [rows[i] for i in ordered if not flags[i]], prior)
        return pa.table({"buckets": [chosen.astype(np.int32)], "weights": [w], "bias": [bias]}, schema=pa.schema([("buckets", pa.list_(pa.int32())), ("weights", pa.list_(pa.float64())), ("bias", pa.float64())]))

    parts = sample.withColumn("part", F.pmod(F.xxhash64("id", F.lit(salt + 1)), F.lit(classifiers)).cast("int"))
    parts = parts.mapInArrow(extract, "part int, positive int, features array<int>")
    models = parts.groupBy("part").applyInArrow(learn, "buckets array<int>, weights array<double>, bias double").collect()
    weights, bias = np.zeros(BUCKETS), 0.0
    for model in models:
        weights[model["buckets"]] += np.array(model["weights"]) / len(models)
        bias += model["bias"] / len(models)
    return weights, bias if models else float(np.log(prior / (1 - prior)))


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic",
    held_out_of: int = 3, held_out: int = 1, threshold: float = THRESHOLD, **training,
) -> DataFrame:
    """(id, held_out, score, predicted) of every row, judged by its text alone.

    Held out are rows whose crc32(id as text) leaves `held_out` modulo `held_out_of`; neither their labels nor
    their texts are learned from. A null or empty text has the score of the bias. A null id is not held out.
    Repeated rows come back as they are. Other columns are not carried.
    """
    weights, bias = _model(docs, labels, id_col, text_col, toxic_col, held_out_of, held_out, training)
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(remainder_expr(id_col, held_out_of) == held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text")
    )
    kind = rows.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for batch in slices(batches, SLICE_BYTES):
            scores = score_texts(text_bytes(batch.column("text")), weights.value, bias, known)
            predicted = [int(s >= threshold) for s in scores]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32())], names=[id_col, "held_out", "score", "predicted"]
            )

    return rows.mapInArrow(score, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def accepted(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic",
    held_out_of: int = 3, held_out: int = 1, threshold: float = THRESHOLD, **training,
) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    weights, bias = _model(docs, labels, id_col, text_col, toxic_col, held_out_of, held_out, training)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for batch in slices(batches, SLICE_BYTES):
            scores = score_texts(text_bytes(batch.column(place)), weights.value, bias, known)
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def _model(docs, labels, id_col, text_col, toxic_col, held_out_of, held_out, training):
    ours = lambda df: df.filter(F.coalesce(remainder_expr(id_col, held_out_of) != held_out, F.lit(True)))
    weights, bias = trained(ours(docs), ours(labels), id_col, text_col, toxic_col, **training)
    return docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32)), bias
