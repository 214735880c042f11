"""Conversations as marked text through a compiled template, and back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from boxquery.llm.template import compile_template

# The strings that carry structure in the default format.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]"]

TURNS = (
    "{% for turn in turns %}<s>[INST] {{ turn.role | escape }} [/INST]"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}{{ turn.text | escape }}{% endif %}</s>{% endfor %}"
)

_CONTROL = re.compile("|".join(map(re.escape, ["\\", *CONTROL])))
_TURN = re.compile(r"(?s)<s>\[INST\] (.*?) \[/INST\](.*?)</s>")
FORMATTED = "formatted string, spans array<struct<start:bigint,end:bigint>>"


def escape(text: str | None) -> str:
    """No control string is left: each gets a backslash after its first character, and a backslash is doubled."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text or "")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of the default format; anything else in the text is an error."""
    turns, at = [], 0
    for found in _TURN.finditer(formatted):
        if found.start() != at:
            raise ValueError(f"no turn starts at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    if at != len(formatted):
        raise ValueError(f"no turn starts at {at}")
    return turns


def format_conversations(conversations: DataFrame, template: str = TURNS) -> DataFrame:
    """(conv_id, formatted, spans): one row per conversation; spans are the generation marks, in code points.

    Turns come in the order of turn, then role, then text (null first), so ties and repeated rows have a place.
    A null role or text is empty. Rows with a null conv_id are one conversation of their own. Other columns are
    not carried. Turns are streamed: a task holds one conversation's output, never its partition.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    compile_template(template, {"escape": escape})  # a faulty template fails here
    kind = rows.schema["conv_id"].dataType.simpleString()

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compile_template(template, {"escape": escape})

        def turns():
            for batch in batches:
                yield from zip(*(batch.column(name).to_pylist() for name in ("conv_id", "role", "text")))

        ids, texts, spans, size = [], [], [], 0
        for conv_id, group in groupby(turns(), key=lambda row: row[0]):
            out = run({"turns": ({"role": role, "text": text} for _, role, text in group)})
            ids.append(conv_id)
            texts.append(out.text())
            spans.append([{"start": a, "end": b} for a, b in out.spans])
            size += out.length
            if size > 8_000_000 or len(ids) >= 10_000:
                yield formatted(ids, texts, spans)
                ids, texts, spans, size = [], [], [], 0
        yield formatted(ids, texts, spans)

    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def formatted(ids, texts, spans):
        pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(texts, pa.string()), pa.array(spans, pairs)], names=["conv_id", "formatted", "spans"])

    return rows.mapInArrow(render, f"conv_id {kind}, {FORMATTED}")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the default format holds: turns, the text under the marks, and digests of both."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("spans").to_pylist()):
                turns = parse_turns(text)
                digest = hashlib.sha256()
                for role, said in turns:
                    digest.update(f"{role}\n{said}\n".encode())
                loss = [unescape(text[s["start"] : s["end"]]) for s in spans]
                marked = hashlib.sha256()
                for piece in loss:
                    marked.update(piece.encode())
                rows.append((len(turns), digest.hexdigest(), sum(map(len, loss)), marked.hexdigest(), len(text)))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *map(pa.array, columns, types)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.mapInArrow(read, schema)
