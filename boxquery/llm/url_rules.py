"""Allow and block lists for URLs: a trie over reversed host labels, with a trie over path segments at each host."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ALLOW, BLOCK = "allow", "block"

# Rules in one broadcast trie: at about 500 bytes a rule, some 100 MB. A longer list is judged in several rounds.
RULES_PER_TRIE = 200_000

_URL = re.compile(r"(?s).*?://([^/?#]*)([^?#]*)")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host after the first `://` in lower case, the path up to `?` or `#`; else both empty."""
    found = _URL.match(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


class _Host:
    __slots__ = ("labels", "paths")

    def __init__(self):
        self.labels: dict[str, _Host] = {}
        self.paths: _Path | None = None


class _Path:
    """`ends`: what may follow the segments up to here, as prefixes of the rest, with the rule they complete."""

    __slots__ = ("segments", "ends")

    def __init__(self):
        self.segments: dict[str, _Path] = {}
        self.ends: dict[str, tuple[str, str]] = {}


class RuleTrie:
    """Rules (verdict, host, path). The path is empty or starts with `/`; of equal rules, block wins."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root = _Host()
        for verdict, host, path in rules:
            if verdict not in (ALLOW, BLOCK):
                raise ValueError(f"a rule allows or blocks: {verdict!r}")
            if path and not path.startswith("/"):
                raise ValueError(f"the path of a rule starts with /: {path!r}")
            host = host.translate(_LOWER)
            node = self.root
            for label in reversed(host.split(".")):
                node = node.labels.setdefault(label, _Host())
            node.paths = node.paths or _Path()
            place = node.paths
            *whole, last = path.split("/")
            for segment in whole:
                place = place.segments.setdefault(segment, _Path())
            if place.ends.get(last, ("", ALLOW))[1] == ALLOW:
                place.ends[last] = (f"{host}{path}", verdict)

    def find(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        """(host labels, path length, rule, verdict) of the longest fitting rule: by host first, then by path."""
        node, hosts = self.root, []
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            hosts.append(node.paths)
        for labels in range(len(hosts), 0, -1):
            if hosts[labels - 1] is not None and (best := _longest(hosts[labels - 1], path)):
                return labels, *best
        return None


def _longest(place: _Path | None, path: str) -> tuple[int, str, str] | None:
    at, best = 0, None
    while place is not None:
        fitting = [end for end in place.ends if path.startswith(end, at)]
        if fitting:
            end = max(fitting, key=len)
            best = (at + len(end), *place.ends[end])
        slash = path.find("/", at)
        if slash < 0:
            break
        place, at = place.segments.get(path[at:slash]), slash + 1
    return best


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = ALLOW,
    rules_per_trie: int = RULES_PER_TRIE,
) -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    A rule fits its host and all subdomains if the path starts with the rule's. The rule of the longest host
    wins, then of the longest path. Without one, rule is null and the verdict is `default`. A null URL or one
    without `://` has an empty host and path. Repeated rows and null ids come back as they are; other columns
    are not carried, so their names cannot clash.
    """
    spark = pages.sparkSession
    best = "labels int, length int, rule string, verdict string"
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
        F.lit(0).alias("labels"), F.lit(0).alias("length"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    for start in range(0, max(1, len(rules)), rules_per_trie):
        trie = spark.sparkContext.broadcast(RuleTrie(rules[start : start + rules_per_trie]))

        def look_up(batches: Iterator[pa.RecordBatch], trie=trie) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                urls, found = batch.column("url"), []
                old = zip(*(batch.column(name).to_pylist() for name in ("labels", "length", "rule", "verdict")))
                for url, had in zip(urls.to_pylist(), old):
                    new = trie.value.find(*split_url(url))
                    better = new is not None and (had[2] is None or new[:2] > had[:2] or (new[:2] == had[:2] and new[3] == BLOCK))
                    found.append(new if better else had)
                labels, length, rule, verdict = zip(*found) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), urls, pa.array(labels, pa.int32()), pa.array(length, pa.int32()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                    names=["id", "url", "labels", "length", "rule", "verdict"],
                )

        rows = rows.mapInArrow(look_up, f"id {kind}, url string, {best}")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [split_url(url) for url in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([s[0] for s in split], pa.string()), pa.array([s[1] for s in split], pa.string()), batch.column("rule"), batch.column("verdict")],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    return rows.mapInArrow(parts, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def blocked_out(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """The rows of pages whose URL is allowed, with all their columns."""
    trie = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))
    place = pages.columns.index(url_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [trie.value.find(*split_url(url)) for url in batch.column(place).to_pylist()]
            yield batch.filter(pa.array([(v[3] if v else default) == ALLOW for v in verdicts], pa.bool_()))

    return pages.mapInArrow(keep, pages.schema)
