import random
import zlib

import numpy as np
import pytest

from boxquery.llm import toxicity
from boxquery.llm.toxicity import accepted, fit, risk, score_texts, toxicity_scores

DOCS = "doc_id bigint, text string, score string, held_out int, predicted string"
LABELS = "doc_id bigint, toxic int, text int"


def tables(n=900, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "ke", "lo", "mi", "nu", "so", "ti"]) for _ in range(rng.randint(1, 4)))
    docs, labels, toxic = [], [], {}
    for i in range(n):
        bad = rng.random() < 0.15
        words = [word() for _ in range(rng.randint(20, 200))]
        if bad:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["Awful", "vile", f"dreck{word()}"]))
        toxic[i] = bad
        docs.append((i, " ".join(words), "c", 1, "c"))
        if rng.random() < 0.6:
            labels.append((i, int(bad), 1))
    return docs, labels, toxic


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_texts_of_held_out_rows_are_told_apart(spark):
    docs, labels, toxic = tables()
    docs += [(None, docs[0][1], "c", 1, "c"), (5000, None, "c", 1, "c"), (5001, "", "c", 1, "c"), (5002, "word " * 100_000, "c", 1, "c"), docs[3], docs[3]]
    labels += [(None, 1, 1), (3, None, 1), labels[0], (99_999, 1, 1)]
    got = toxicity_scores(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(map(repr, (r["doc_id"] for r in got))) == sorted(map(repr, (d[0] for d in docs)))
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    unseen = [r for r in got if r["held_out"] and r["doc_id"] in toxic]
    assert sum(r["predicted"] != toxic[r["doc_id"]] for r in unseen) <= 0.04 * len(unseen)
    bare = {r["doc_id"]: r["score"] for r in got if r["doc_id"] in (5000, 5001)}
    assert bare[5000] == bare[5001] < 0.5


def test_held_out_labels_have_no_influence(spark):
    docs, labels, _ = tables(300)
    turned = [(i, 1 - t if held(i) else t, x) for i, t, x in labels]
    frame = spark.createDataFrame(docs, DOCS)
    scores = [sorted((r["doc_id"], r["score"]) for r in toxicity_scores(frame, spark.createDataFrame(ls, LABELS)).collect()) for ls in (labels, turned)]
    assert scores[0] == scores[1]


def test_accepted_rows_keep_their_columns(spark):
    docs, labels, _ = tables()
    frame, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    bad = {r["doc_id"] for r in toxicity_scores(frame, marks).collect() if r["predicted"]}
    kept = accepted(frame, marks)
    assert kept.dtypes == frame.dtypes and bad
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d[0] for d in docs if d[0] not in bad)


def test_without_labels_or_rows(spark):
    docs, labels, _ = tables(30)
    scores = {r["score"] for r in toxicity_scores(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)).collect()}
    assert len(scores) == 1 and max(scores) == pytest.approx(toxicity.DEFAULT_PRIOR)
    assert toxicity_scores(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).collect() == []


def test_the_correction_is_kept_from_below_zero():
    """With few positives that are easy to single out, the corrected risk of negatives would sink far below zero."""
    positive = [np.array([1, 2], np.int32)] * 20
    unlabelled = [np.array([3], np.int32)] * 150 + [np.array([1, 2], np.int32)] * 50
    chosen, w, bias = fit(positive, unlabelled, 0.2)
    z = lambda rows: np.array([w[np.isin(chosen, r)].sum() + bias for r in rows])
    assert risk(z(positive), z(unlabelled), 0.2)[1] > -0.02
    assert z(positive).min() > 1 and z(unlabelled[:1]).max() < -1


def test_scores_are_sums_over_different_words():
    weights = np.random.default_rng(0).random(toxicity.BUCKETS)
    texts = [b"", b"One two, one!", b"two one"]
    got = score_texts(texts, weights, -3.0, {})
    by_hand = [-3.0 + sum(weights[toxicity.buckets_of(w)].sum() for w in words) for words in ([], [b"one", b"two"], [b"one", b"two"])]
    assert got == pytest.approx([1 / (1 + np.exp(-z)) for z in by_hand])
