"""WARC archives: written as one gzip stream, then normalised to one gzip member per record with an offset index.

Three steps, each a Spark job whose result is a table in the scratch folder, so that a lost executor costs a
task and never a file: names are unique per attempt, and only files named in a finished table are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from boxquery.session import scratch_path, written
from boxquery.sources.store import open_store

# Uncompressed bytes after which the next archive is begun: what one task of the later steps reads.
ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 20
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31  # zlib's window bits for a gzip stream

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _fields(kind: str, page_id: int | None, url: str | None, digest: str) -> list[tuple[str, object]]:
    fields: list[tuple[str, object]] = [("WARC-Type", kind), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    return fields + [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]


def response_record(page_id: int | None, url: str | None, payload: bytes, digest: str) -> bytes:
    return _record(_fields("response", page_id, url, digest), _http(len(payload)) + payload)


def revisit_record(page_id: int | None, url: str | None, length: int, digest: str, refers_to: int | None) -> bytes:
    """A record without the payload; the HTTP head keeps the full payload's length."""
    fields = _fields("revisit", page_id, url, digest)
    return _record([*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))], _http(length))


class Record:
    """A parsed record: its fields, its HTTP length and its payload (empty in a revisit)."""

    def __init__(self, raw: bytes):
        head, _, block = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        self.fields = dict(line.split(": ", 1) for line in lines[1:])
        block = block[: int(self.fields["Content-Length"])]
        http, _, self.payload = block.partition(b"\r\n\r\n")
        self.length = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
        self.kind = self.fields["WARC-Type"]
        self.url = self.fields.get("WARC-Target-URI")
        self.digest = self.fields["WARC-Payload-Digest"].removeprefix("sha1:")
        self.page_id = self._page("WARC-Record-ID")
        self.refers_to = self._page("WARC-Refers-To")

    def _page(self, field: str) -> int | None:
        number = self.fields.get(field, "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None


def inflated(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file, whether it is one member or many, chunk by chunk."""
    stream = None
    while data := read(CHUNK):
        while data:
            stream = stream or zlib.decompressobj(GZIP)
            while data and not stream.eof:
                yield stream.decompress(data, 8 * CHUNK)
                data = stream.unconsumed_tail
            if stream.eof:
                data, stream = stream.unused_data, None
    if stream is not None:
        raise ValueError("the archive ends within a gzip member")


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated archive, one at a time."""
    held = bytearray()
    need, ended = 0, False
    while True:
        if not need and (at := held.find(b"\r\n\r\n")) >= 0:
            need = at + 4 + int(re.search(rb"\r\nContent-Length: (\d+)", held[:at])[1]) + 4
        if need and len(held) >= need:
            yield bytes(held[:need])
            del held[:need]
            need = 0
            continue
        if ended:
            break
        chunk = next(chunks, None)
        ended = chunk is None
        held += chunk or b""
    if held:
        raise ValueError("the archive ends within a record")


MANIFEST = "archive string, seq bigint, page_id bigint, payload_bytes bigint, digest string"


def write_monolithic(
    pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL,
) -> DataFrame:
    """Write each row as a response record into archives that are one gzip stream each; the manifest of records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(root)
        store.create_dir(folder, recursive=True)
        out, name, packer, size, rows = None, "", None, 0, []

        def close():
            out.write(packer.flush())
            out.close()
            archive, seq, ids, lengths, digests = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(archive), pa.array(seq, pa.int64()), pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(digests)],
                names=["archive", "seq", "page_id", "payload_bytes", "digest"],
            )

        for batch in batches:
            ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
            for i, html in enumerate(batch.column("html").cast(pa.binary())):
                payload = html.as_py() or b""
                if out is None:
                    name, size, rows = f"{uuid.uuid4().hex}.warc.gz", 0, []
                    out, packer = store.open_output_stream(f"{folder}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, GZIP)
                digest = payload_digest(payload)
                record = response_record(ids[i], urls[i], payload, digest)
                out.write(packer.compress(record))
                rows.append((name, len(rows), ids[i], len(payload), digest))
                size += len(record)
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    return written(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def revisits(manifest: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(archive, decided): per archive, which record numbers become revisits and of which page.

    Of records with equal payloads of min_bytes or more, those with the largest page_id stay responses. Equal
    digests are first counted where they are read, and only digests that occur more than once are joined, so a
    payload that a third of all pages share is one row on one side, and its other side can be split.
    """
    copies = (
        manifest.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("digest", "payload_bytes")
        .agg(F.max("page_id").alias("best"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    later = F.when(F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best")), F.struct("seq", F.col("best").alias("refers_to")))
    joined = manifest.join(copies, ["digest", "payload_bytes"], "left")
    return written(joined.groupBy("archive").agg(F.collect_list(later).alias("decided")), "warc-revisits")


def normalise(archives: DataFrame, source: str, target: str, level: int = LEVEL) -> DataFrame:
    """Rewrite archives with every record as its own gzip member and a sidecar index of offsets; (archive, records).

    Each archive is inflated once, as a stream. `decided` names the records that become revisits. The index,
    beside the archive, has a JSON line per record: offset, length, type and record id.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, old), (goal, new) = open_store(source), open_store(target)
        goal.create_dir(new, recursive=True)
        for batch in batches:
            for name, decided in zip(batch.column("archive").to_pylist(), batch.column("decided").to_pylist()):
                refers = {d["seq"]: d["refers_to"] for d in decided or []}
                fresh, offset, index = f"{uuid.uuid4().hex}.warc.gz", 0, []
                with (
                    store.open_input_stream(f"{old}/{name}", compression=None) as handle,
                    goal.open_output_stream(f"{new}/{fresh}", compression=None) as out,
                ):
                    for seq, raw in enumerate(records(inflated(handle.read))):
                        kind = "response"
                        if seq in refers:
                            was, kind = Record(raw), "revisit"
                            raw = revisit_record(was.page_id, was.url, was.length, was.digest, refers[seq])
                        packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                        member = packer.compress(raw) + packer.flush()
                        out.write(member)
                        record_id = re.search(rb"\r\nWARC-Record-ID: ([^\r]*)", raw)[1].decode()
                        index.append(json.dumps({"offset": offset, "length": len(member), "type": kind, "id": record_id}))
                        offset += len(member)
                with goal.open_output_stream(f"{new}/{fresh}.index", compression=None) as out:
                    out.write("".join(f"{line}\n" for line in index).encode())
                yield pa.RecordBatch.from_arrays([pa.array([fresh]), pa.array([len(index)], pa.int64())], names=["archive", "records"])

    fresh = spread(archives.select("archive", "decided")).mapInArrow(rewrite, "archive string, records bigint")
    return written(fresh, "warc-archives")


def spread(archives: DataFrame) -> DataFrame:
    """The rows with about one archive to a task: by their bytes alone, Spark would put all names into one."""
    return archives.repartition(max(1, archives.count()), "archive")


def read_archives(archives: DataFrame, root: str) -> DataFrame:
    """A row per record of normalised archives, each read by its offset; a payload must have its own digest."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(root)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with store.open_input_stream(f"{folder}/{name}.index", compression=None) as handle:
                    index = [json.loads(line) for line in handle.read().splitlines()]
                rows = []
                with store.open_input_file(f"{folder}/{name}") as handle:
                    for entry in index:
                        handle.seek(entry["offset"])
                        record = Record(zlib.decompress(handle.read(entry["length"]), GZIP))
                        if record.kind == "response" and (payload_digest(record.payload), len(record.payload)) != (record.digest, record.length):
                            raise ValueError(f"{name}: the payload at {entry['offset']} differs from its digest")
                        rows.append((record.page_id, record.length, record.digest, record.kind, record.refers_to))
                columns = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return spread(archives.select("archive")).mapInArrow(
        read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    )


def archive_pages(
    pages: DataFrame, root: str | None = None, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> tuple[DataFrame, str]:
    """Archive pages under root (scratch if not given): the finished archives, and the folder that holds them.

    Null html is an empty payload, a null URL has no target field, a null page_id an empty record id. Repeated
    rows are records of their own: rows that share the largest page_id of a payload are all responses. If no
    copy has a page_id, all are responses. Other columns are not carried.
    """
    root = root or scratch_path(pages.sparkSession, "warc")
    first, final = f"{root}/monolithic", f"{root}/archives"
    manifest = write_monolithic(pages, first, id_col, url_col, html_col, archive_bytes, level)
    return normalise(revisits(manifest, min_bytes), first, final, level), final
