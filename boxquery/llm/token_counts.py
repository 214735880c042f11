"""Token counts without token ids: pieces per distinct pre-token, joined to pre-token frequencies of documents."""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from boxquery.llm.common import slices
from boxquery.llm.words import frequent
from boxquery.session import written

# The byte-level split of the byte_bpe vocabularies (fixed by them).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Pre-tokens whose counts are broadcast: at about 150 bytes each, some 20 MB in a worker.
BROADCAST_PIECES = 131_072
# Distinct pre-tokens a task holds before it sends their counts on, and bytes of text taken at once.
HELD_PIECES = 200_000
SLICE_BYTES = 4 << 20
# Bytes of pre-tokens encoded at once: the library keeps about a kilobyte for each.
ENCODE_BYTES = 128 << 10


class PreTokenizer:
    """Splits text as the tokenizer file says: special strings first, then the byte-level pattern."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        split = spec["pre_tokenizer"]
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True):
            raise ValueError("only byte-level tokenizers without a normalizer or prefix space are counted this way")
        special = [t for t in spec["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError("special strings that take the space beside them are not supported")
        contents = sorted((t["content"] for t in special), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, contents))) if contents else None
        space = r"\p{White_Space}"
        self.find = regex.compile(PATTERN.replace(r"[^\s", f"[^{space}").replace(r"\s", space).replace(r"\S", f"[^{space}]")).findall

    def split(self, text: str) -> tuple[list[str], int]:
        """(pre-tokens, number of special strings)."""
        if self.special is None or not self.special.search(text):
            return self.find(text), 0
        parts = self.special.split(text)
        return [piece for part in parts for piece in self.find(part)], len(parts) - 1


def piece_counts(docs: DataFrame, tokenizer_json: str, text_col: str = "text") -> DataFrame:
    """(piece, n, tokens) of every distinct pre-token: occurrences in all texts, and how many tokens it makes."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, counts = PreTokenizer(spec.value), Counter()
        for batch in slices(batches, SLICE_BYTES):
            for text in batch.column(0).to_pylist():
                counts.update(pre.split(text or "")[0])
            if len(counts) >= HELD_PIECES:
                yield counted(counts)
                counts.clear()
        yield counted(counts)

    def counted(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["piece", "n"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec.value)
        tokenizer.encode_special_tokens = True
        for batch in slices(batches, ENCODE_BYTES):
            encoded = tokenizer.encode_batch_fast(batch.column("piece").to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(e) for e in encoded], pa.int64())], names=["piece", "n", "tokens"])

    pieces = docs.select(text_col).mapInArrow(split, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    return pieces.mapInArrow(encode, "piece string, n bigint, tokens bigint")


def count_tokens(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024,
    broadcast_pieces: int = BROADCAST_PIECES,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    A null text is empty: no bytes, no tokens. Null ids and repeated rows come back as they are. Other columns
    are not carried. The most frequent pre-tokens, at most `broadcast_pieces`, are looked up in a broadcast
    table while a document is split; the others are joined on the pre-token itself.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    PreTokenizer(tokenizer_json)
    context = docs.sparkSession.sparkContext
    spec = context.broadcast(tokenizer_json)
    pieces = written(piece_counts(docs, tokenizer_json, text_col), "token-pieces")
    common, least = frequent(pieces, "piece", "tokens", broadcast_pieces)
    known = context.broadcast(common)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, tokens = PreTokenizer(spec.value), known.value
        rare_type = pa.list_(pa.struct([("piece", pa.string()), ("m", pa.int64())]))
        for batch in slices(batches, SLICE_BYTES):
            sizes, sums, rare = [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                found, special = pre.split(text)
                counts, total, unknown = Counter(found), special, []
                for piece, m in counts.items():
                    n = tokens.get(piece)
                    if n is None:
                        unknown.append({"piece": piece, "m": m})
                    else:
                        total += n * m
                sizes.append(len(text.encode()))
                sums.append(total)
                rare.append(unknown)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(rare, rare_type)],
                names=["id", "n_bytes", "known", "rare"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    split = rows.mapInArrow(look_up, f"id {kind}, n_bytes bigint, known bigint, rare array<struct<piece:string,m:bigint>>")
    split = written(split.withColumn("row", F.monotonically_increasing_id()), "token-rows")
    rest = (
        split.select("row", F.explode("rare").alias("r"))
        .select("row", "r.piece", "r.m")
        .join(pieces.filter(F.col("n") < least).select("piece", "tokens"), "piece")
        .groupBy("row")
        .agg(F.sum(F.col("m") * F.col("tokens")).alias("others"))
    )
    total = F.col("known") + F.coalesce("others", F.lit(0))
    return split.drop("rare").join(rest, "row", "left").select(
        F.col("id").alias(id_col), "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit")
    )
