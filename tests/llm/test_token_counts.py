import random

import pytest

import public_tokenizers
from tokenizers import Tokenizer

from boxquery.llm.token_counts import PreTokenizer, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, n_tokens string"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def strange_texts(n, seed=3):
    rng = random.Random(seed)
    bits = ["a", "Word", "'s", "'ll", "'", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "é", "ß", "日本", "١٢", "12", "½", "!", "...", "<|endoftext|>", "<|endof", "😀", "\u200d", "e\u0301", "\u0000", "_"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_split_gives_the_library_s_pieces(library):
    pre = PreTokenizer(open(PATH, encoding="utf-8").read())
    for text in strange_texts(3000):
        pieces, special = pre.split(text)
        assert special + sum(map(library, pieces)) == library(text), repr(text)


@pytest.mark.parametrize("broadcast_pieces", [0, 5, 131_072])
def test_counts_equal_the_library_s(spark, library, broadcast_pieces):
    texts = [None, "", " ", "a", "a", "<|endoftext|>", "x<|endoftext|> y", "word " * 60_000, *strange_texts(200)]
    rows = [(i if i else None, t, "clash") for i, t in enumerate(texts)] + [(7, "again", "clash")]
    got = count_tokens(spark.createDataFrame(rows, SCHEMA), PATH, broadcast_pieces=broadcast_pieces).collect()
    want = [(i, len((t or "").encode()), library(t), library(t) > 1024) for i, t, _ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r["doc_id"]: library(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in count_tokens(docs, PATH).collect()} == want
