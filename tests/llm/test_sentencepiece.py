import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece as library

from boxquery.llm.sentencepiece import MARKER, DoubleArray, Pieces, _fields, decoded, encoded

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
SCHEMA = "doc_id bigint, text string, ids string, score int"


def number(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | (128 if n else 0)])
        if not n:
            return out


def field(i, data):
    return number(i << 3 | 2) + number(len(data)) + data


def as_unigram(pieces):
    """The model file as a unigram model with our scores, for the library."""
    out, i = b"", 0
    for f, value in _fields(MODEL):
        if f == 1:
            piece = dict(_fields(value))
            out += field(1, field(1, piece[1]) + b"\x15" + struct.pack("<f", pieces.scores[i]) + b"\x18" + number(piece.get(3, 1)))
            i += 1
        elif f == 2:
            out += field(2, b"\x18\x01" + b"\x98\x02\x01")  # unigram, byte fallback
        elif f == 3:
            out += field(3, value)
    return out


@pytest.fixture(scope="module")
def pieces():
    return Pieces(MODEL)


@pytest.fixture(scope="module")
def unigram(pieces):
    return library.SentencePieceProcessor(model_proto=as_unigram(pieces))


def strange_texts(n, seed=1):
    rng = random.Random(seed)
    bits = ["the", "tion", "Wort", " ", "  ", "    ", "\n", "\t", "é", "ß", "日本", "梦", "😀", "‍", "\x00", "!", "...", "1234", "�", "ing", "x", "ученый", "<s>", "<0x41>", "<unk>"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def encode(pieces, texts):
    return [(ids.tolist(), score) for ids, score in pieces.encode(texts, {})]


def test_double_array_holds_its_keys():
    rng = random.Random(0)
    keys = {bytes(rng.choice(b"ab\xc3\xa9z\xf0") for _ in range(rng.randint(1, 6))): i for i in range(3000)}
    trie = DoubleArray(keys)
    text = bytes(rng.choice(b"ab\xc3\xa9z\xf0q") for _ in range(500))
    got = {(a, b, v) for a, b, v in zip(*(x.tolist() for x in trie.matches(np.frombuffer(text, np.uint8), np.arange(500))))}
    want = {(a, b, keys[text[a:b]]) for a in range(500) for b in range(a + 1, min(501, a + 7)) if text[a:b] in keys}
    assert got == want


def test_same_as_the_library_s_unigram_model(pieces, unigram):
    texts = strange_texts(1500)
    for text, (ids, score) in zip(texts, encode(pieces, texts)):
        want = unigram.encode(text)
        if ids != want:  # it adds in single precision: only a tie can come out otherwise
            worth = lambda of: sum(pieces.scores[i] for i in of if not 3 <= i < 259)
            assert worth(ids) == pytest.approx(worth(want), abs=1e-4), text
    same = sum(ids == unigram.encode(t) for t, (ids, _) in zip(texts, encode(pieces, texts)))
    assert same > 0.98 * len(texts)


def test_best_of_all_segmentations(pieces):
    """Against every segmentation of short texts."""
    index = {p.decode(): i for i, p in enumerate(pieces.pieces) if i >= 259}

    def every(rest):
        if not rest:
            yield 0.0
        for n in range(1, min(len(rest), 16) + 1):
            worth = pieces.scores[index[rest[:n]]] if rest[:n] in index else pieces.unknown if n == 1 else None
            if worth is not None:
                yield from (worth + more for more in every(rest[n:]))

    texts = ["hello wor", "théâtre", "日本語 x", "\n\n a", "aaaaaaaa", "😀é", "  in  "]
    for text, (_, score) in zip(texts, encode(pieces, texts)):
        assert score == pytest.approx(max(every(MARKER + text.replace(" ", MARKER))), abs=1e-9)


def test_long_chunks_and_round_trips(pieces, unigram):
    texts = ["x" * 3000, "日本" * 2000, " " * 2000, "ab" * 300 + " " + "c" * 700 + "\n", *strange_texts(300, 2)]
    for text, (ids, _) in zip(texts, encode(pieces, texts)):
        assert pieces.decode(ids) == text
        assert unigram.decode(ids) == text


def test_frames(spark, pieces):
    texts = [None, "", " ", "a", "a", *strange_texts(60, 3), "long words " * 20_000]
    rows = [(i or None, t, "clash", 1) for i, t in enumerate(texts)] + [(4, "a", "clash", 1)]
    out = decoded(encoded(spark.createDataFrame(rows, SCHEMA), MODEL, same_col="same"), MODEL)
    assert all(r["same"] for r in out.collect())
    out = out.drop("same")
    assert out.columns == ["doc_id", "text", "ids", "score", "decoded"]
    got = sorted(((r["doc_id"] or 0, r["text"] or "", r["ids"], r["decoded"]) for r in out.collect()), key=repr)
    want = [(i or 0, t or "", None if t is None else ids, t) for (i, t, *_), (ids, _) in zip(rows, encode(pieces, [r[1] or "" for r in rows]))]
    assert got == sorted(want, key=repr)
    assert decoded(encoded(spark.createDataFrame([], SCHEMA), MODEL), MODEL).collect() == []


def test_other_models_are_refused():
    bad = b"".join(field(f, v + b"\x20\x01" if f == 3 else v) for f, v in _fields(MODEL) if f <= 3)
    with pytest.raises(ValueError):
        Pieces(bad)
