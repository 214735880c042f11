import gzip
import json
import zlib

import pytest

from boxquery.llm import warc

SCHEMA = "page_id bigint, url string, html string, archive string, digest string"
PAGES = [
    (1, "http://a/ b\r\nX: y", "same", "c", "c"), (2, None, "same", "c", "c"), (3, "http://b/", "same", "c", "c"),
    (4, "http://c/", None, "c", "c"), (5, "http://d/", "", "c", "c"), (6, "http://e/", "é\r\n\r\nWARC/1.1\r\n" * 3, "c", "c"),
    (7, "http://f/", "x" * 3_000_000, "c", "c"), (None, "http://g/", "same", "c", "c"), (3, "http://b/", "same", "c", "c"),
    (None, "http://h/", "lonely", "c", "c"), (None, "http://h/", "lonely", "c", "c"),
]


def expected(pages, min_bytes=0):
    out = []
    for page_id, _, html, *_ in pages:
        payload = (html or "").encode()
        ids = [p[0] for p in pages if (p[2] or "").encode() == payload and p[0] is not None]
        best = max(ids, default=None)
        later = len(payload) >= min_bytes and best is not None and page_id != best
        out.append((page_id, len(payload), warc.payload_digest(payload), "revisit" if later else "response", best if later else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("min_bytes, archive_bytes", [(0, 1), (0, 1 << 25), (5, 2000)])
def test_archives_read_back(spark, tmp_path, min_bytes, archive_bytes):
    pages = spark.createDataFrame(PAGES, SCHEMA).repartition(2)
    archives, root = warc.archive_pages(pages, f"file://{tmp_path}", min_bytes, archive_bytes)
    got = warc.read_archives(archives, root).collect()
    assert sorted(map(repr, map(tuple, got))) == expected(PAGES, min_bytes)
    names = {r["archive"]: r["records"] for r in archives.collect()}
    assert sum(names.values()) == len(PAGES)
    for name, n in names.items():
        data = (tmp_path / "archives" / name).read_bytes()
        index = [json.loads(line) for line in (tmp_path / "archives" / f"{name}.index").open()]
        assert len(index) == n and sum(e["length"] for e in index) == len(data)
        whole = b"".join(zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], 31) for e in index)
        assert whole == gzip.decompress(data)


def test_a_record_is_read_from_one_stream_or_many_members():
    parts = [warc.response_record(i, f"http://x/{i}", bytes([i]) * 1000 * i, "d") for i in range(5)]
    for data in (gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts))):
        def reader(size, at=[0], data=data):
            piece = data[at[0] : at[0] + 37]
            at[0] += 37
            return piece
        reader.__defaults__[0][0] = 0
        assert list(warc.records(warc.inflated(reader))) == parts


def test_a_cut_archive_is_an_error():
    data = gzip.compress(warc.response_record(1, None, b"abc" * 100, "d"))
    pieces = iter([data[:60], b""])
    with pytest.raises(ValueError):
        list(warc.records(warc.inflated(lambda size: next(pieces))))


def test_empty_table(spark, tmp_path):
    archives, root = warc.archive_pages(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}")
    assert warc.read_archives(archives, root).collect() == []
