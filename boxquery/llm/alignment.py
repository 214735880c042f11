"""Aligning the tokens of two tokenizers by pointer jumping over their byte ranges.

Every token points to the token that reaches farthest right among those it overlaps, itself included. Doubling the
successors of all tokens of a batch at once ends at the last token of each group: the least runs of tokens of both
tokenizers that cover the same bytes. Links, the pairs of tokens that share bytes, are counted per pair of ids over
all documents; each document then reads the counts of its own pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from boxquery.llm.common import slices
from boxquery.llm.token_counts import PATTERN
from boxquery.llm.words import frequent
from boxquery.session import written

# Id pairs whose counts are broadcast, 16 bytes each.
BROADCAST_PAIRS = 262_144
SLICE_BYTES = 1 << 20  # text aligned at once
ENCODE_BYTES = 128 << 10  # text encoded at once: the library keeps about a kilobyte for each word
# Texts in long established characters, on whose classes all libraries agree, without very long white space: the rank
# encoder takes these, several times faster than the library of the tokenizer file, which takes all others.
UNUSUAL = re.compile("[^\u0000-\u04FF\u2000-\u2064\u20A0-\u20AC\u3040-\u3096\u30A0-\u30FE\u4E00-\u9FA5]|\\s{1000}")
# A space between two letters begins a new piece in byte-level splitting, so long texts may be cut before it.
CUT = regex.compile(r"(?<=\p{L}) (?=\p{L})")

COLUMNS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


@dataclass(frozen=True)
class Tokenizers:
    """The files of a byte-level tokenizer (a) and of a SentencePiece model (b), and the bytes that their ids stand for."""

    a_json: str
    b_model: bytes

    @cached_property
    def a(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(self.a_json)
        tokenizer.encode_special_tokens = True
        return tokenizer

    @cached_property
    def a_ranks(self):
        """The same tokenizer as ranks of its pieces; None where its merges are not in the order of its ids."""
        import tiktoken

        model, added = json.loads(self.a_json)["model"], json.loads(self.a_json)["added_tokens"]
        merged = ["".join(pair) if isinstance(pair, list) else pair.replace(" ", "") for pair in model["merges"]]
        if [model["vocab"].get(piece) for piece in merged] != list(range(256, 256 + len(merged))):
            return None
        special = {token["id"] for token in added}
        ranks = {piece: i for i, piece in enumerate(self.a_bytes) if i not in special}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def b(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.b_model)

    @cached_property
    def a_bytes(self) -> list[bytes]:
        spec, symbols = json.loads(self.a_json), byte_of_symbol()
        vocabulary = spec["model"]["vocab"]
        pieces = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]))
        for piece, i in vocabulary.items():
            pieces[i] = bytes(symbols[c] for c in piece) if all(c in symbols for c in piece) else piece.encode()
        for token in spec["added_tokens"]:
            pieces[token["id"]] = token["content"].encode()
        return pieces

    @cached_property
    def b_bytes(self) -> list[bytes]:
        pieces = ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        return [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]

    def encode_a(self, text: str) -> np.ndarray:
        """Ids of a text; a long one that the library takes is encoded in parts."""
        if self.a_ranks is not None and not UNUSUAL.search(text):
            return np.array(self.a_ranks.encode_ordinary(text), np.int64)
        parts, start = [], 0
        while len(text) - start > ENCODE_BYTES:
            cut = CUT.search(text, start + ENCODE_BYTES)
            if cut is None:
                break
            parts.append(text[start : cut.start()])
            start = cut.start()
        parts.append(text[start:])
        return np.concatenate([np.array(self.a.encode(part, add_special_tokens=False).ids, np.int64) for part in parts])

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both tokenizers for space + text; none if one of them does not give back these bytes."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        a, b = self.encode_a(" " + text), np.array(self.b.encode(text, num_threads=1), np.int64)
        wanted = b" " + text.encode()
        same = all(b"".join(map(pieces.__getitem__, ids.tolist())) == wanted for pieces, ids in ((self.a_bytes, a), (self.b_bytes, b)))
        return (a, b) if same else (none, none)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and how often each occurs, by a sort."""
    values = np.sort(values)
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return values[first], np.diff(np.append(first, len(values)))


def terminals(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terminal token, a number of a, of every token of a and of b; both cover the same bytes.

    Of all tokens that a token overlaps, one that covers its last byte reaches farthest. Tokens of b point to the
    token of a there; a token of a points to the one of b only if that reaches farther, else to itself.
    """
    n = len(a_end)
    over = np.searchsorted(b_end, a_end)
    successor = np.concatenate([np.where(b_end[over] > a_end, n + over, np.arange(n)), np.searchsorted(a_end, b_end)])
    while True:
        doubled = successor[successor]
        if np.array_equal(doubled, successor):
            return successor[:n], successor[n:]
        successor = doubled


class Writer:
    """Writes groups as `a1,a2|b1;a3|b2,b3`: each id with the mark that follows it is one entry of a table."""

    def __init__(self, a_ids: int, b_ids: int):
        self.a_ids, self.b_ids = a_ids, b_ids
        ids = (("%d," , a_ids), ("%d|", a_ids), ("%d,", b_ids), ("%d;", b_ids))
        self.marked = [(mark % i).encode() for mark, n in ids for i in range(n)]

    def entries(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> np.ndarray:
        """Entries of all tokens in the order of writing: by group, first those of a."""
        a_last, b_last = np.append(a_group[1:] != a_group[:-1], True), np.append(b_group[1:] != b_group[:-1], True)
        entry = np.concatenate([a + a_last * self.a_ids, 2 * self.a_ids + b + b_last * self.b_ids])
        return entry[np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")]

    def digest(self, entries: np.ndarray) -> str:
        return hashlib.sha256(b"".join(map(self.marked.__getitem__, entries.tolist()))[:-1]).hexdigest() if len(entries) else ""


def align(encoded: list[tuple[np.ndarray, np.ndarray]], a_sizes: np.ndarray, b_sizes: np.ndarray, writer: Writer) -> dict[str, list]:
    """Columns of documents given as ids of both tokenizers, all aligned at once."""
    n_a, n_b = (np.array([len(ids) for ids in side], np.int64) for side in zip(*encoded)) if encoded else (np.zeros(0, np.int64),) * 2
    docs = len(encoded)
    if not n_a.sum():
        zeros = np.zeros(docs, np.int64)
        return {"n_a": zeros, "n_b": zeros, "n_groups": zeros, "n_links": zeros, "groups_sha256": [""] * docs, "pairs": np.zeros(0, np.int64), "times": np.zeros(0, np.int32), "ends": np.zeros(docs + 1, np.int32)}
    a, b = (np.concatenate(side) for side in zip(*encoded))
    a_end, b_end = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
    a_terminal, b_terminal = terminals(a_end, b_end)
    last = np.flatnonzero(a_terminal == np.arange(len(a)))  # groups in order
    a_group, b_group = np.searchsorted(last, a_terminal), np.searchsorted(last, b_terminal)
    doc_of_a = np.repeat(np.arange(docs), n_a)

    entries, stop = writer.entries(a, b, a_group, b_group), np.cumsum(n_a + n_b)
    digests = [writer.digest(entries[end - n : end]) for end, n in zip(stop.tolist(), (n_a + n_b).tolist())]

    # between two neighbouring ends of tokens lie the bytes of one link
    ends = distinct(np.concatenate([a_end, b_end]))[0]
    at_a = np.searchsorted(a_end, ends)
    pair = a[at_a] * len(b_sizes) + b[np.searchsorted(b_end, ends)]
    span = len(a_sizes) * len(b_sizes)
    different, times = distinct(doc_of_a[at_a] * span + pair)
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc_of_a[last], minlength=docs), "n_links": np.bincount(doc_of_a[at_a], minlength=docs),
        "groups_sha256": digests, "pairs": different % span, "times": times.astype(np.int32),
        "ends": np.searchsorted(different, np.arange(docs + 1) * span).astype(np.int32),
    }


def links(docs: DataFrame, a_json: str, b_model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row, not written.

    pairs holds the linked id pairs of the document as a * (ids of b) + b, times how often each is linked. A null or
    empty text, or one that a tokenizer does not give back byte for byte, has no tokens.
    """
    files = docs.sparkSession.sparkContext.broadcast((a_json, b_model))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers(*files.value)
        a_sizes, b_sizes = (np.array([len(piece) for piece in pieces], np.int64) for pieces in (tokenizers.a_bytes, tokenizers.b_bytes))
        writer = Writer(len(a_sizes), len(b_sizes))
        for batch in slices(batches, SLICE_BYTES):
            found = align([tokenizers.encode(text) for text in batch.column("text").to_pylist()], a_sizes, b_sizes, writer)
            ends = pa.array(found.pop("ends"))
            for name, kind in (("pairs", pa.int64()), ("times", pa.int32())):
                found[name] = pa.ListArray.from_arrays(ends, pa.array(found[name], kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(column) if name != "groups_sha256" else pa.array(column, pa.string()) for name, column in found.items())], names=["id", *found]
            )

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {COLUMNS}")


def align_documents(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    The count of an id pair is the number of rows that hold it linked. n_best is how many links of the row have a
    pair of the highest count that its id of a has anywhere, ties included; count_sum sums the counts over the links.
    A null or empty text, or one that a tokenizer does not give back byte for byte, has zeros and an empty digest.
    Null ids and repeated rows come back as they are, each row counted. Other columns are not carried. The most
    frequent pairs, at most `broadcast_pairs`, are looked up in broadcast arrays; the others are joined.
    """
    context = docs.sparkSession.sparkContext
    with open(a_path, encoding="utf-8") as file:
        a_json = file.read()
    with open(b_path, "rb") as file:
        b_model = file.read()
    b_ids = len(Tokenizers(a_json, b_model).b_bytes)
    found = written(links(docs, a_json, b_model, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "alignment")
    counted = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counted = written(counted.withColumn("a", F.floor(F.col("pair") / b_ids)), "alignment-pairs")
    # a row per id of the first vocabulary at most
    highest = counted.groupBy("a").agg(F.max("n").alias("highest"))
    valued = F.col("n") * 2 + (F.col("n") == F.col("highest")).cast("long")
    counted = written(counted.join(F.broadcast(highest), "a").select("pair", "n", valued.alias("value")), "alignment-counts")
    common, least = frequent(counted, "pair", "value", broadcast_pairs)
    order = np.argsort(np.fromiter(common.keys(), np.int64, len(common)))
    # one last entry above all pairs, so that every search ends at an entry
    known = context.broadcast(
        (np.append(np.fromiter(common.keys(), np.int64, len(common))[order], np.iinfo(np.int64).max), np.append(np.fromiter(common.values(), np.int64, len(common))[order], 0))
    )
    rare_type = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int32())]))
    kind = found.schema["id"].dataType.simpleString()
    kept = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = known.value
        for batch in batches:
            column, times = batch.column("pairs"), batch.column("times")
            sizes = np.diff(column.offsets.to_numpy())
            pairs, times = column.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.searchsorted(keys, pairs)
            common = keys[place] == pairs
            value = np.where(common, values[place], 0)
            total = lambda x: np.bincount(doc, weights=x, minlength=batch.num_rows).astype(np.int64)
            rare = ~common
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=batch.num_rows))]).astype(np.int32)
            entries = pa.StructArray.from_arrays([pa.array(pairs[rare]), pa.array(times[rare].astype(np.int32))], fields=list(rare_type.value_type))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in kept), pa.array(total(times * (value & 1))), pa.array(total(times * (value >> 1))), pa.ListArray.from_arrays(pa.array(ends), entries, type=rare_type)],
                names=[*kept, "best", "sum", "rare"],
            )

    columns = f"row bigint, id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, best bigint, sum bigint, rare array<struct<pair:bigint,times:int>>"
    looked_up = written(found.mapInArrow(look_up, columns), "alignment-rows")
    rest = (
        looked_up.select("row", F.explode("rare").alias("r"))
        .select("row", "r.pair", "r.times")
        .join(counted.filter(F.col("n") < least), "pair")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("value").bitwiseAND(F.lit(1))).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    )
    none = F.lit(0)
    return looked_up.drop("rare").join(rest, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", (F.col("best") + F.coalesce("more_best", none)).alias("n_best"),
        (F.col("sum") + F.coalesce("more_sum", none)).alias("count_sum"), "groups_sha256",
    )
