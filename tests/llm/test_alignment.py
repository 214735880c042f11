import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from boxquery.llm.alignment import Tokenizers, align_documents, terminals

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, n_a string, pair string"


def by_hand(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) from byte positions, one by one."""
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    from tokenizers.decoders import ByteLevel

    def a_piece(i):
        # decoding the symbols one by one is exact for bytes that are no whole character
        symbols = a.id_to_token(i)
        return bytes(TABLE[c] for c in symbols)

    TABLE = {}
    for value in range(256):
        char = chr(value)
        if not (0x21 <= value < 0x7F or 0xA1 <= value < 0xAD or value >= 0xAE):
            char = chr(256 + sum(1 for v in range(value) if not (0x21 <= v < 0x7F or 0xA1 <= v < 0xAD or v >= 0xAE)))
        TABLE[char] = value
    assert ByteLevel().decode(["ĠÃ©"]) == " é" and bytes(TABLE[c] for c in "ĠÃ©") == " é".encode()

    def b_piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    documents = []
    for _, text, *_ in rows:
        x = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        wanted = (" " + (text or "")).encode() if text else b""
        if b"".join(map(a_piece, x)) != wanted or b"".join(map(b_piece, y)) != wanted:
            x, y = [], []
        groups, i, j = [], 0, 0
        links = []
        while i < len(x):
            first = [x[i]], [y[j]]
            ends = [len(a_piece(x[i])), len(b_piece(y[j]))]
            links.append((x[i], y[j]))
            while ends[0] != ends[1]:
                if ends[0] < ends[1]:
                    i += 1
                    ends[0] += len(a_piece(x[i]))
                    first[0].append(x[i])
                else:
                    j += 1
                    ends[1] += len(b_piece(y[j]))
                    first[1].append(y[j])
                links.append((x[i], y[j]))
            groups.append(first)
            i, j = i + 1, j + 1
        documents.append((x, y, groups, links))
    counts = Counter(pair for *_, links in documents for pair in set(links))
    highest = {}
    for (first, _), n in counts.items():
        highest[first] = max(n, highest.get(first, 0))
    out = []
    for (doc_id, *_), (x, y, groups, links) in zip(rows, documents):
        told = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((
            doc_id, len(x), len(y), len(groups), len(links), sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(told.encode()).hexdigest() if x else "",
        ))
    return sorted(map(repr, out))


def strange_rows():
    rng = random.Random(5)
    bits = ["a", "Word", "'s", " ", "  ", "\n", "\t", " ", " ", "é", "ß", "日本", "١٢", "12", "½", "!", "...", "<|endoftext|>", "</s>", "<s>", "<unk>", "😀", "‍", "é", "\u0000", "▁", "ﬁ", "<0x41>"]
    texts = [None, "", " ", "a", "a", "word " * 40_000, "the house and the garden"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    return [(i if i else None, text, "clash", "clash") for i, text in enumerate(texts)] + [(6, "the house and the garden", "c", "c")]


@pytest.mark.parametrize("broadcast_pairs", [0, 7, 262_144])
def test_strange_texts_by_hand(spark, broadcast_pairs):
    rows = strange_rows()
    got = align_documents(spark.createDataFrame(rows, SCHEMA), A_PATH, B_PATH, broadcast_pairs=broadcast_pairs).collect()
    assert sorted(map(repr, map(tuple, got))) == by_hand(rows)


def test_documents_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = align_documents(docs, A_PATH, B_PATH).collect()
    assert sorted(map(repr, map(tuple, got))) == by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(r["n_groups"] > 0 for r in got) > 150


def test_empty_table(spark):
    assert align_documents(spark.createDataFrame([], SCHEMA), A_PATH, B_PATH).collect() == []


def test_long_texts_are_cut_where_pieces_begin():
    with open(A_PATH) as a, open(B_PATH, "rb") as b:
        tokenizers = Tokenizers(a.read(), b.read())
    assert tokenizers.a_ranks is not None
    for text in (" " * 100_000 + "x", "x\n \t" * 40_000, "don't  stop it's 12 ok " * 20_000, "x" * 300_000, "é ½ don't \x85\x1c\u2003 €" * 30_000, "日本 日本" * 50_000):
        assert tokenizers.encode_a(text).tolist() == tokenizers.a.encode(text, add_special_tokens=False).ids


def test_terminals_of_random_cuts():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a, b = (np.append(np.sort(rng.choice(n, int(rng.integers(0, n)), replace=False)), n) + 1 for _ in range(2))
        both = np.intersect1d(a, b)
        of_a, of_b = terminals(a, b)
        assert a[of_a].tolist() == [int(both[both >= end].min()) for end in a]
        assert a[of_b].tolist() == [int(both[both >= end].min()) for end in b]
