import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from boxquery.llm import gru
from boxquery.llm.language_model import END, RUN_WORDS, language_scores, other_class, other_classes, runs, split_words, vocabulary, word_counts, words_of

SCHEMA = "doc_id bigint, text string, score string, held_out int"


def test_gradients_against_differences(monkeypatch):
    monkeypatch.setattr(gru, "F32", np.float64)
    shape, rng = gru.Shape(10, 4, 3, 5), np.random.default_rng(0)
    w = {k: v.astype(np.float64) * 3 for k, v in gru.initial(shape, np.ones(13)).items()}
    inputs, targets = rng.integers(0, 13, (6, 4)), rng.integers(0, 13, (6, 4))
    inputs[0] = inputs[3, 2] = shape.begin
    real = np.ones((6, 4), bool)
    real[5, 1] = False
    state = np.zeros((4, 5))
    g = gru.gradients(w, shape, inputs, targets, real, state)[0]
    for k in w:
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w[k].shape)
            old, loss = w[k][at], []
            for step in (1e-5, -1e-5):
                w[k][at] = old + step
                loss.append(gru.gradients(w, shape, inputs, targets, real, state)[2])
            w[k][at] = old
            assert g[k][at] == pytest.approx((loss[0] - loss[1]) / 2e-5, rel=1e-4, abs=1e-8)


def test_probabilities_add_up_and_lanes_do_not_matter():
    shape, rng = gru.Shape(10, 4, 3, 5), np.random.default_rng(1)
    w = gru.initial(shape, rng.random(13))
    start = rng.integers(0, 13, 7)
    ends = gru.score(w, shape, [np.append(start, s) for s in range(13)]) - gru.score(w, shape, [start])
    assert np.exp(ends).sum() == pytest.approx(1, abs=1e-5)
    texts = [rng.integers(0, 13, n) for n in [1, 200, 3, 40, 40, 7, 90]]
    one_by_one = np.concatenate([gru.score(w, shape, [t]) for t in texts])
    for lanes, window in [(1, 32), (3, 5), (64, 1000)]:
        assert gru.score(w, shape, texts, lanes, window) == pytest.approx(one_by_one, abs=1e-3)


def test_gates_lie_side_by_side_and_slices_add_up(monkeypatch):
    shape, rng = gru.Shape(10, 4, 3, 5), np.random.default_rng(3)
    w, inputs, targets = gru.initial(shape, rng.random(13)), rng.integers(0, 13, (6, 4)), rng.integers(0, 13, (6, 4))
    real, state, kept = rng.random((6, 4)) < 0.9, np.zeros((4, 5), np.float32), []
    gru._forward(w, inputs, state, shape.begin, kept)
    assert all(k.shape == (5, 4) and k.flags.c_contiguous for step in kept for k in step)
    whole = gru.gradients(w, shape, inputs, targets, real, state)
    monkeypatch.setattr(gru, "ROWS", 7)
    parts = gru.gradients(w, shape, inputs, targets, real, state)
    assert parts[2] == pytest.approx(whole[2], rel=1e-5) and all(parts[0][k] == pytest.approx(whole[0][k], abs=1e-5) for k in w)


def test_words_and_classes_of_many_texts_at_once():
    texts = [None, "", " \t\n", "a", "  A b", "B ", "A\x0bB\x0c\u00c4 x\x1cz\x85q\u00a0r", " x  y\r\n", "\x00 \x1f", "one two two"]
    for part in (slice(0, 10), slice(3, 8), slice(0, 0)):
        words, ends = split_words(pa.array(texts, pa.string())[part])
        got = [words[ends[i] : ends[i + 1]].to_pylist() for i in range(len(texts[part]))]
        assert got == [words_of((text or "").encode()) for text in texts[part]]
    words = [b"", b"...", b"abc", b"abcde!", b"a.b.c||", b"xyz_", "\u00e4\u00f6\u00fcx-".encode(), "\u65e5\u672c\u8a9e".encode(), b"other.de!"]
    assert other_classes(pa.array(words), 64).tolist() == [other_class(word, 64) for word in words]
    assert len(other_classes(pa.array([], pa.binary()), 64)) == 0


def chain_texts(n, seed=4):
    """Each word depends on the one before, in one of two vocabularies."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        base, word, words = rng.choice([0, 100]), 0, []
        for _ in range(rng.randint(1, 80)):
            word = (word * 3 + rng.choice([1, 2])) % 40
            words.append(f"W{base + word}" if rng.random() < 0.9 else f"rare{rng.randint(0, 5000)}{'xy'[base // 100] * 4}.")
        rows.append((i, " ".join(words), "clash", 1))
    return rows


@pytest.mark.parametrize("broadcast_words", [131_072, 60])
def test_scores(spark, broadcast_words):
    rows = chain_texts(600)
    rows += [(1000, None, "c", 1), (1001, "", "c", 1), (1002, " \t\n", "c", 1), (None, "W1 W5 again", "c", 1), rows[3], (1003, "long " * 30_000, "c", 1)]
    got = language_scores(spark.createDataFrame(rows, SCHEMA), model_words=60, broadcast_words=broadcast_words, task_words=9_000, rounds=5).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, t, *_ in rows if not held(i) for w in words_of((t or "").encode()))
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, *_ in rows:
        words = words_of((t or "").encode())
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        want[(i, held(i), len(words), sum(counts[w] > 0 for w in words), total, round(base, 4))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    unseen = [r for r in got if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen) * 0.95
    assert all(r["score"] < 0 for r in got)


def test_words_of_other_classes_share_their_class(spark):
    """Texts of one word: with the class given by the model, the words of a class and one unseen word make up all of it."""
    rows = [(i, f"a{i % 7}zzzz", "c", 1) for i in range(1, 60)] + [(10_000 + i, "common", "c", 1) for i in range(90)]
    got = language_scores(spark.createDataFrame(rows, SCHEMA), model_words=2, broadcast_words=3, rounds=0).collect()
    scores = {r["doc_id"]: r["score"] for r in got}
    assert other_class(b"a1zzzz", 64) == other_class(b"a2zzzz", 64)
    by_word = {f"a{i % 7}": scores[i] for i in range(1, 60)}
    trained = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 10]
    n = Counter(f"a{i % 7}" for i in trained)
    ratio = 10 ** (by_word["a1"] - by_word["a2"])
    assert ratio == pytest.approx((n["a1"] + 0.1) / (n["a2"] + 0.1), rel=1e-4)


def test_empty_table_and_nothing_to_learn_from(spark):
    assert language_scores(spark.createDataFrame([], SCHEMA)).collect() == []
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    got = language_scores(spark.createDataFrame([(i, "some text", "c", 1) for i in held], SCHEMA)).collect()
    assert len(got) == len(held) and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] < 0 for r in got)
    assert END == b""


def test_shares_of_far_apart_values():
    x = np.array([[0.0, 1.0, -1.0], [-0.5, -0.25, 0.125], [1.0, 0.5, 0.25]])
    want = x - np.array([[np.logaddexp.reduce(row)] for row in x])
    for rows in (slice(0, 3), slice(2, 3), slice(0, 0)):
        states, of, scale = x[rows].astype(np.float32), np.array([1, 0, 2])[rows], np.array([0.5, 0.0, 2.0], np.float32)[rows]
        at_of = want[rows][range(len(of)), of]
        for bias in (np.zeros(3, np.float32), np.array([0.0, 0.0, -500.0], np.float32)):
            if bias.any():
                moved = x[rows] + bias
                at_of = (moved - np.logaddexp.reduce(moved, axis=1)[:, None])[range(len(of)), of]
            slopes, at = gru._slopes(states, np.eye(3, dtype=np.float32), bias, of, scale)
            assert at == pytest.approx(at_of, abs=1e-3) and gru._log_share(states, np.eye(3, dtype=np.float32), bias, of) == pytest.approx(at_of, abs=1e-3)
        assert gru._slopes(states, np.eye(3, dtype=np.float32), np.zeros(3, np.float32), of, scale)[0] == pytest.approx((np.exp(want[rows]) - np.eye(3)[of]) * scale[:, None], abs=1e-4)


def test_runs_hold_every_word():
    for n in (1, 300, RUN_WORDS, RUN_WORDS + 1, 5 * RUN_WORDS):
        symbols = np.arange(n)
        assert np.concatenate(runs(symbols)).tolist() == symbols.tolist() and max(map(len, runs(symbols))) <= RUN_WORDS


def plain_score(w, shape, symbols):
    """Natural log-likelihood of a text by a gated recurrent unit, one word after the other, without classes side by side."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h, k = shape.hidden, shape.per_class
    w = {name: value.astype(np.float64) for name, value in w.items()}
    state, given, total = np.zeros(h), shape.begin, 0.0
    for s in symbols:
        a, b = w["input"][given], state @ w["state"]
        z, r = sigmoid(a[:h] + b[:h]), sigmoid(a[h : 2 * h] + b[h : 2 * h])
        new = np.tanh(a[2 * h :] + r * b[2 * h :])
        state = (1 - z) * state + z * new
        tops = state @ w["top"] + w["top_bias"]
        c = s // k if s < shape.words else s - shape.words + shape.word_classes
        total += tops[c] - np.log(np.exp(tops).sum())
        if s < shape.words:
            inside = state @ w["inner"][c] + w["inner_bias"][c]
            total += inside[s % k] - np.log(np.exp(inside).sum())
        given = s
    return total


def test_scores_equal_a_plain_network_s(spark, monkeypatch):
    """From the texts to the column: words, symbols, the network with the state carried on, and the share of rare words."""
    from boxquery.llm import language_model as lm

    rows = chain_texts(80) + [(900, None, "c", 1), (901, "W1 " * 700, "c", 1)]
    rng, used = np.random.default_rng(2), {}

    def given(texts, vocab, rounds, task_words):
        used["vocab"] = vocab
        used["w"] = {k: v + rng.normal(0, 0.4, v.shape).astype(np.float32) for k, v in gru.initial(vocab.shape, np.ones(vocab.shape.symbols)).items()}
        return used["w"]

    monkeypatch.setattr(lm, "trained", given)
    got = {r["doc_id"]: r["score"] for r in language_scores(spark.createDataFrame(rows, SCHEMA), model_words=30, broadcast_words=70).collect()}
    vocab, w = used["vocab"], used["w"]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(word for i, t, *_ in rows if not held(i) for word in words_of((t or "").encode()))
    model = [word for word, i in vocab.index.items() if i < vocab.shape.words]
    n, v = Counter(), Counter()
    for word, m in counts.items():
        if word not in model:
            n[other_class(word, 64)] += m
            v[other_class(word, 64)] += 1
    for i, t, *_ in rows:
        words = words_of((t or "").encode())
        symbols = [model.index(word) if word in model else vocab.shape.words + other_class(word, 64) for word in words]
        share = sum(math.log10((counts[word] + 0.1) / (n[c] + 0.1 * (v[c] + 1))) for word in words if word not in model for c in [other_class(word, 64)])
        assert got[i] == pytest.approx(plain_score(w, vocab.shape, symbols) / math.log(10) + share, rel=1e-4, abs=1e-3)


def test_training_takes_every_word_and_gives_the_same_again(spark):
    docs = spark.createDataFrame(chain_texts(200), SCHEMA)
    first, again = ({(r["doc_id"], r["score"]) for r in language_scores(docs.repartition(n), task_words=1_500).collect()} for n in (3, 3))
    assert first == again
    counts = word_counts(docs.select("text"))
    vocab, _ = vocabulary(counts, 10, 100, 4)
    assert vocab.words == sum(len(words_of(t.encode())) for _, t, *_ in chain_texts(200))
