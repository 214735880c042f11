"""Unigram encoding with a SentencePiece vocabulary: Viterbi over a double-array trie, with byte fallback.

A text becomes U+2581 (the marker), then itself with spaces as markers; null and empty texts have no pieces. The
best segmentation is the one with the highest sum of log scores. A character that is no piece costs ten less than
the lowest score and is written as its UTF-8 bytes. Decoding joins pieces, turns markers into spaces and drops the
first. A marker character in a text is taken for a space, as the format has no way to tell them apart.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from boxquery.llm.common import slices

MARKER = "▁"
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # piece types of the file format
UNIGRAM = 1  # model type of the file format

SLICE_BYTES = 2 << 20
HELD_CHUNKS = 100_000
TOGETHER = 200_000  # bytes of chunks that are encoded side by side
LONG_CHUNK = 512  # bytes; a longer chunk is encoded alone


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        elif kind == 2:
            size = number()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield key >> 3, struct.unpack("<f", data[at : at + 4])[0] if kind == 5 else data[at : at + 8]
            at += size


class DoubleArray:
    """A trie over bytes: the child of state s by byte c is base[s] + c + 1 if check of that place is s."""

    def __init__(self, keys: dict[bytes, int]):
        children: dict[int, dict[int, int]] = {0: {}}
        value_of, count = {}, 1
        for key, value in keys.items():
            node = 0
            for byte in key:
                below = children[node]
                if byte not in below:
                    below[byte] = count
                    children[count] = {}
                    count += 1
                node = below[byte]
            value_of[node] = value
        size = 2 * count + 1024
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken, place, free = bytearray(size), {0: 0}, 257  # every byte of a child is below its place
        taken[0] = 1
        order, last = [0], 257
        for node in order:
            below = sorted(children[node])
            state = place[node]
            self.value[state] = value_of.get(node, -1)
            if not below:
                continue
            while taken[free]:
                free += 1
            # one child fills the first hole; several are placed near the last ones, where there is room for all
            start = free if len(below) == 1 else last
            while any(start - below[0] + byte < size and taken[start - below[0] + byte] for byte in below):
                start += 1
            last = max(last, start - 64)
            base = start - below[0] - 1
            if base + 257 + 1 >= size:
                more = size
                size += more
                taken.extend(bytes(more))
                self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
                self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])
                self.value = np.concatenate([self.value, np.full(more, -1, np.int32)])
            self.base[state] = base
            for byte in below:
                child = base + byte + 1
                taken[child] = 1
                self.check[child] = state
                place[children[node][byte]] = child
                order.append(children[node][byte])
        self.longest = max(map(len, keys), default=0)

    def matches(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, value) of every key at each of the starts, for all starts at once."""
        found, state, at = [], np.zeros(len(starts), np.int64), starts
        for length in range(self.longest):
            inside = at + length < len(data)
            at, state = at[inside], state[inside]
            following = self.base[state] + data[at + length].astype(np.int64) + 1
            there = self.check[np.minimum(following, len(self.check) - 1)] == state
            there &= following < len(self.check)
            at, state = at[there], following[there]
            if not len(at):
                break
            value = self.value[state]
            whole = value >= 0
            found.append((at[whole], at[whole] + length + 1, value[whole]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


class Pieces:
    """A vocabulary read from a SentencePiece model file.

    The scores of a unigram model are taken as they are. Another model's scores only rank its pieces; its pieces
    get the log probabilities of Zipf's law for those ranks.
    """

    def __init__(self, model: bytes):
        rows, trainer, normalizer = [], {}, {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                rows.append((piece[1], piece.get(2, 0.0), piece.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only models without character changes, with a marker before the text and all spaces kept, are supported")
        if not {kind for _, _, kind in rows} <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.byte_ids = np.full(256, -1, np.int32)
        for i, (piece, _, kind) in enumerate(rows):
            if kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces to fall back on")
        self.pieces = [piece for piece, _, _ in rows]
        self.spoken = [bytes([int(piece[3:5], 16)]) if kind == BYTE else piece if kind == NORMAL else b"" for piece, _, kind in rows]
        normal = {piece: i for i, (piece, _, kind) in enumerate(rows) if kind == NORMAL}
        self.scores = np.array([score for _, score, _ in rows])
        if trainer.get(3, UNIGRAM) != UNIGRAM:
            used = np.array(sorted(normal.values()))
            ranks = 1 + self.scores[used].max() - self.scores[used]
            self.scores[used] = -np.log(ranks) - np.log((1 / ranks).sum())
        self.unknown = min(self.scores[i] for i in normal.values()) - UNKNOWN_PENALTY
        self.trie = DoubleArray(normal)
        text = [piece.decode() for piece in normal]
        # a chunk ends before a marker, if no piece goes on over one, and around each line end, if no piece has one
        inner = any(MARKER in piece.lstrip(MARKER) for piece in text)
        line = "" if any("\n" in piece for piece in text) else "\n"
        self.chunks = None if inner else re.compile(f" +[^ {line}]*|[^ {line}]+" + (f"|{line}" if line else ""))

    def split(self, text: str) -> list[str]:
        """Chunks that are encoded one by one; spaces stand for markers."""
        marked = " " + text.replace(MARKER, " ")
        return self.chunks.findall(marked) if self.chunks else [marked]

    def encode_chunks(self, chunks: list[str]) -> list[tuple[tuple[int, ...], float]]:
        """Ids and score of the best segmentation of each chunk."""
        encoded = [chunk.replace(" ", MARKER).encode() for chunk in chunks]
        out: list = [None] * len(chunks)
        held, size = [], 0
        for i, e in enumerate(encoded):
            if len(e) <= LONG_CHUNK:
                held.append(i)
                size += len(e)
            if held and (size >= TOGETHER or i == len(encoded) - 1):
                for j, best in zip(held, self._viterbi([encoded[j] for j in held])):
                    out[j] = best
                held, size = [], 0
        for i, e in enumerate(encoded):
            if out[i] is None:
                out[i] = self._viterbi_alone(e)
        return out

    def _edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id, score) of all pieces in the data; id -1 for a character that is no piece. 255 ends a chunk."""
        first = np.flatnonzero(((data & 0xC0) != 0x80) & (data != 255))
        start, end, piece = self.trie.matches(data, first)
        lead = data[first]
        width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        single = np.full(len(data), -1, np.int64)
        single[first] = first + width
        known = np.zeros(len(data), bool)
        known[start[single[start] == end]] = True
        lone = first[~known[first]]
        return (
            np.concatenate([start, lone]), np.concatenate([end, single[lone]]), np.concatenate([piece, np.full(len(lone), -1)]),
            np.concatenate([self.scores[piece], np.full(len(lone), self.unknown)]),
        )

    def _viterbi(self, chunks: list[bytes]) -> list[tuple[tuple[int, ...], float]]:
        """All chunks side by side: one step for each pair of a start within the chunk and a length."""
        if not chunks:
            return []
        data = np.frombuffer(b"\xff".join(chunks) + b"\xff", np.uint8)
        sizes = np.array([len(c) for c in chunks])
        begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        start, end, piece, score = self._edges(data)
        inside = start - np.repeat(begin, sizes + 1)[start]
        step = inside * (LONG_CHUNK + 1) + end - start
        order = np.argsort(step, kind="stable")
        start, end, piece, score, step = start[order], end[order], piece[order], score[order], step[order]
        bounds = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1], [True]]))
        best, back = np.full(len(data), -np.inf), np.full(len(data), -1, np.int64)
        best[begin] = 0.0
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            goal = end[a:b]
            sums = best[start[a:b]] + score[a:b]
            better = sums > best[goal]
            best[goal[better]] = sums[better]
            back[goal[better]] = a + np.flatnonzero(better)
        which, at, edges = np.arange(len(chunks)), begin + sizes, []
        while True:
            open_ = at > begin[which]
            which, at = which[open_], at[open_]
            if not len(which):
                break
            edge = back[at]
            edges.append((which, edge))
            at = start[edge]
        owner, edge = np.concatenate([w for w, _ in edges]), np.concatenate([e for _, e in edges])
        turn = np.repeat(np.arange(len(edges)), [len(w) for w, _ in edges])
        order = np.lexsort((-turn, owner))
        owner, edge = owner[order], edge[order]
        ids, lone = piece[edge], piece[edge] < 0
        repeats = np.where(lone, end[edge] - start[edge], 1)
        within = np.arange(int(repeats.sum())) - np.repeat(np.cumsum(repeats) - repeats, repeats)
        ids = np.where(np.repeat(lone, repeats), self.byte_ids[data[np.repeat(start[edge], repeats) + within]], np.repeat(ids, repeats)).tolist()
        counts = np.bincount(owner, weights=repeats, minlength=len(chunks)).astype(np.int64)
        stops = np.cumsum(counts).tolist()
        totals = best[begin + sizes].tolist()
        return [(tuple(ids[stop - n : stop]), total) for stop, n, total in zip(stops, counts.tolist(), totals)]

    def _viterbi_alone(self, chunk: bytes) -> tuple[tuple[int, ...], float]:
        start, end, piece, score = self._edges(np.frombuffer(chunk, np.uint8))
        order = np.lexsort((end, start))
        best, back = [-np.inf] * (len(chunk) + 1), [(0, 0)] * (len(chunk) + 1)
        best[0] = 0.0
        for a, b, i, s in zip(start[order].tolist(), end[order].tolist(), piece[order].tolist(), score[order].tolist()):
            if best[a] + s > best[b]:
                best[b], back[b] = best[a] + s, (a, i)
        ids, at = [], len(chunk)
        while at:
            before, i = back[at]
            ids.extend([i] if i >= 0 else self.byte_ids[list(chunk[before:at][::-1])].tolist())
            at = before
        return tuple(reversed(ids)), best[-1]

    def encode(self, texts: list[str], known: dict) -> Iterator[tuple[np.ndarray, float]]:
        """Ids and score of each text. `known` keeps encoded chunks between calls."""
        split = [self.split(text) if text else [] for text in texts]
        fresh = list(dict.fromkeys(chunk for chunks in split for chunk in chunks if chunk not in known))
        known.update(zip(fresh, self.encode_chunks(fresh)))
        for chunks in split:
            found = list(map(known.__getitem__, chunks))
            yield np.fromiter(chain.from_iterable([ids for ids, _ in found]), np.int32), sum([score for _, score in found])
        if len(known) > HELD_CHUNKS:
            known.clear()

    def decode(self, ids: list[int]) -> str:
        """Text of pieces; bytes that are no UTF-8 become U+FFFD, control and unknown pieces nothing."""
        text = b"".join(map(self.spoken.__getitem__, ids)).decode(errors="replace").replace(MARKER, " ")
        return text[1:] if text.startswith(" ") else text


def encoded(
    docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids", score_col: str = "score", same_col: str | None = None
) -> DataFrame:
    """docs with the ids and the log score of the best segmentation of each text.

    With same_col, also whether the ids decode to the text (markers taken for spaces). All columns stay; columns
    of the new names are replaced. A null text has null ids and score, and is the same.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(model))
    added = [ids_col, score_col, *([same_col] if same_col else [])]
    kept = [c for c in docs.columns if c not in added]
    base = docs.select(*[F.col(f"`{c}`") for c in kept])
    place = kept.index(text_col)
    schema = T.StructType([*base.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(score_col, T.DoubleType()), *([T.StructField(same_col, T.BooleanType())] if same_col else [])])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = shared.value, {}
        for batch in slices(batches, SLICE_BYTES):
            column = batch.column(place)
            ids, scores, same = [], [], []
            texts = [text or "" for text in column.to_pylist()]
            for text, (found, score) in zip(texts, pieces.encode(texts, known)):
                ids.append(found)
                scores.append(float(score))
                if same_col:
                    same.append(pieces.decode(found.tolist()) == text.replace(MARKER, " "))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32), mask=np.append(column.is_null().to_numpy(zero_copy_only=False), False) if column.null_count else None)
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))
            scored = pa.array(scores, pa.float64(), mask=column.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, scored, *([pa.array(same, pa.bool_())] if same_col else [])], names=[*kept, *added])

    return base.mapInArrow(encode, schema)


def decoded(rows: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text of their ids; null for null ids. A column named text_col is replaced."""
    shared = rows.sparkSession.sparkContext.broadcast(Pieces(model).spoken)
    kept = [c for c in rows.columns if c != text_col]
    base = rows.select(*[F.col(f"`{c}`") for c in kept])
    place = kept.index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.__new__(Pieces)
        pieces.spoken = shared.value
        for batch in slices(batches, SLICE_BYTES):
            column = batch.column(place)
            flat, offsets = column.flatten().to_pylist(), np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy())]).tolist()
            texts = [pieces.decode(flat[a:b]) if ok else None for a, b, ok in zip(offsets, offsets[1:], column.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, text_col])

    return base.mapInArrow(decode, T.StructType([*base.schema.fields, T.StructField(text_col, T.StringType())]))
