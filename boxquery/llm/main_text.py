"""Main text of web pages by removal of what the pages of a site share.

Every element's subtree is hashed. For each host Spark counts the pages that hold a subtree, and the pages that have
anything at its place, the path of tags and names that leads to it. A subtree on many pages, at a place where such
subtrees are the rule, belongs to the site's template and is deleted; a passage that some articles share stands where
most texts differ, and stays. Elements that say by tag or name that they are menus, headers, footers, sidebars,
notices, adverts, forms or comments go too, as the pages of a small site are too few to show its template.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from boxquery.llm.common import slices
from boxquery.llm.page_tree import BLOCKS, Page, parse
from boxquery.llm.url_rules import split_url
from boxquery.session import written

MANY = 5  # pages of a host that a template subtree is on
SHARE = 0.5  # of what stands at a place belongs to subtrees on many pages, if it is a template's place
BROADCAST_KEYS = 2_000_000  # template subtrees, 8 bytes each; more are joined
SALTS = 16  # a subtree that very many pages hold is joined in so many parts
SLICE_BYTES = 2 << 20

# What is never the article, by tag and by the words of class, id, role and tag names.
DROPPED_TAGS = frozenset("nav footer aside form noscript template iframe object embed svg canvas audio video button select input textarea dialog menu search".split())
DROPPED_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion outbrain taboola
    sidebar aside complementary cookie cookies consent gdpr notice notices banner popup modal overlay
    menu nav navbar navigation breadcrumb breadcrumbs toolbar topbar masthead pagination pager skip
    footer contentinfo copyright comment comments disqus respond reply replies
    share sharing social related recommended newsletter subscribe subscription signup login widget widgets""".split()
)
HEADER_NAMES = frozenset(["header", "masthead", "banner"])
COMMENT_NAMES = frozenset("comment comments disqus respond reply replies related recommended teaser".split())
CONTENT_NAMES = frozenset("article body content entry main post story text".split())
WHOLE = frozenset(["#page", "html", "body", "main", "article"])
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption hr address".split())


def _sizes(page: Page) -> list[int]:
    """Characters under each element."""
    sizes = [0] * len(page.tags)
    for element, text in page.events:
        if text is not None:
            sizes[element] += len(text)
    for element in range(len(sizes) - 1, 0, -1):
        sizes[page.parents[element]] += sizes[element]
    return sizes


def _around(page: Page, sizes: list[int]) -> set[int]:
    """The longest article (or else main element) that is not named as comment, and all elements around it."""
    for tag in ("article", "main"):
        found = [i for i, t in enumerate(page.tags) if t == tag and COMMENT_NAMES.isdisjoint(page.names[i])]
        if found:
            element, around = max(found, key=lambda i: (sizes[i], -i)), set()
            while element >= 0:
                around.add(element)
                element = page.parents[element]
            return around
    return {0}


def _within(page: Page, tags) -> list[bool]:
    """Which elements lie in, or are, an element of these tags."""
    inside = [False] * len(page.tags)
    for i in range(1, len(inside)):
        inside[i] = inside[page.parents[i]] or page.tags[i] in tags
    return inside


def subtrees(page: Page, host: str) -> Iterator[tuple[int, int, int]]:
    """(element, place, key) of the subtrees with text that can be a template's: the key tells host, place and content.

    Neither what holds the article nor the plain prose of one is asked about.
    """
    around, prose = _around(page, _sizes(page)), _within(page, ("article", "main"))
    seed = xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"))
    for i in range(1, len(page.tags)):
        tag, named = page.tags[i], bool(page.names[i])
        if not page.filled[i] or i in around or tag in WHOLE or (tag not in BLOCKS and not named) or (prose[i] and tag in PROSE and not named):
            continue
        place = xxhash.xxh64_intdigest(page.places[i].to_bytes(8, "big"), seed=seed)
        yield i, place, xxhash.xxh64_intdigest(page.digests[i].to_bytes(8, "big"), seed=place)


def extract(page: Page, template: set[int]) -> str:
    """Text of the blocks that are left: `template` are elements to delete, others go by tag or name."""
    sizes = _sizes(page)
    around, prose = _around(page, sizes), _within(page, ("article", "main"))
    gone = [False] * len(page.tags)
    for i in range(1, len(gone)):
        gone[i] = gone[page.parents[i]] or (i not in around and (i in template or _named_away(page, i, prose[i], sizes)))
    for region in ("article", "main"):
        roots = {i for i, tag in enumerate(page.tags) if tag == region and not gone[i]}
        if roots:
            break
    else:
        roots = {0}
    kept = [0 in roots] * len(gone)
    for i in range(1, len(gone)):
        kept[i] = not gone[i] and (kept[page.parents[i]] or i in roots)
    blocks, parts = [], []
    for element, text in page.events:
        if text is None:
            blocks.append(" ".join("".join(parts).split()))
            parts = []
        elif kept[element]:
            parts.append(text)
    blocks.append(" ".join("".join(parts).split()))
    return "\n\n".join(filter(None, blocks))


def _named_away(page: Page, i: int, in_prose: bool, sizes: list[int]) -> bool:
    tag, names = page.tags[i], page.names[i]
    if tag in DROPPED_TAGS or (tag == "header" and not in_prose):
        return True
    if tag in ("html", "body", "main", "h1"):
        return False
    if tag == "article":
        return not COMMENT_NAMES.isdisjoint(names)
    if DROPPED_NAMES.isdisjoint(names) and (in_prose or HEADER_NAMES.isdisjoint(names)):
        return False
    # a name like post-with-comments may be that of the article's own element
    return CONTENT_NAMES.isdisjoint(names) or 2 * sizes[i] <= sizes[0]


def _long(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _read(page_html: str | None, url: str | None) -> tuple[Page, str]:
    return parse(page_html or "", hashed=True), split_url(url)[0]


def template_keys(pages: DataFrame, many: int, share: float) -> tuple[DataFrame, DataFrame]:
    """(key) of all template subtrees, and (p, q, key) of the subtrees of every page; both written."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            rows, places, keys = [], [], []
            for row, (source, url) in enumerate(zip(batch.column("html").to_pylist(), batch.column("url").to_pylist())):
                found = {(place, key) for _, place, key in subtrees(*_read(source, url))}
                rows.extend([row] * len(found))
                places.extend(place for place, _ in found)
                keys.extend(key for _, key in found)
            taken = batch.select(["p", "q"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, _long(places), _long(keys)], names=["p", "q", "place", "key"])

    # a page that comes several times is one page
    found = written(pages.mapInArrow(read, "p bigint, q bigint, place bigint, key bigint").distinct(), "page-subtrees")
    counted = written(found.groupBy("place", "key").agg(F.count("*").alias("n")), "page-keys")
    often = F.when(F.col("n") >= many, F.col("n")).otherwise(0)
    places = counted.groupBy("place").agg(F.sum("n").alias("all"), F.sum(often).alias("often")).filter(F.col("often") >= F.lit(share) * F.col("all"))
    keys = counted.filter(F.col("n") >= many).join(places, "place", "left_semi")
    return written(keys.select("key"), "page-template"), found.drop("place")


def main_texts(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text", many: int = MANY, share: float = SHARE,
    broadcast_keys: int = BROADCAST_KEYS, salts: int = SALTS,
) -> DataFrame:
    """All rows and columns of pages, with the main text of each (replacing a column of that name).

    A null or empty page has an empty text, as has one whose every element goes. Pages of a null url, or one without
    a host, form one site. Pages that are repeated count once as pages of their host, and come back as they are.
    """
    html, url = F.col(html_col).cast("string"), F.col(url_col).cast("string")
    read = pages.select(html.alias("html"), url.alias("url"), *(F.xxhash64(F.lit(turn), html, url).alias(name) for turn, name in ((1, "p"), (2, "q"))))
    keys, found = template_keys(read, many, share)
    carried = F.struct(*(F.col(f"`{name}`") for name in pages.columns))
    rows = pages.select(carried.alias("carried"), html.alias("html"), url.alias("url"))
    if keys.count() <= broadcast_keys:
        known = pages.sparkSession.sparkContext.broadcast(np.sort(keys.toPandas()["key"].to_numpy(np.int64)))
        rows = rows.withColumn("keys", F.lit(None).cast("array<bigint>"))
    else:
        known = None
        salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        marked = found.withColumn("salt", F.pmod("p", F.lit(salts)).cast("int")).join(salted, ["key", "salt"])
        # at most the elements of one page
        marks = marked.groupBy("p", "q").agg(F.collect_list("key").alias("keys"))
        rows = rows.withColumns({name: F.xxhash64(F.lit(turn), "html", "url") for turn, name in ((1, "p"), (2, "q"))}).join(marks, ["p", "q"], "left").drop("p", "q")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            texts = []
            for source, url, own in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist(), batch.column("keys").to_pylist()):
                page, host = _read(source, url)
                candidates = list(subtrees(page, host))
                values = np.array([key for *_, key in candidates], np.uint64).view(np.int64)
                if known is None:
                    deleted = np.isin(values, np.array(own or [], np.int64))
                else:
                    at = np.searchsorted(known.value, values)
                    deleted = np.append(known.value, 0)[at] == values if len(known.value) else np.zeros(len(values), bool)
                    deleted &= at < len(known.value)
                texts.append(extract(page, {candidates[i][0] for i in np.flatnonzero(deleted).tolist()}))
            yield pa.RecordBatch.from_arrays([batch.column("carried"), pa.array(texts, pa.string())], names=["carried", "main_text"])

    done = rows.mapInArrow(clean, T.StructType([rows.schema["carried"], T.StructField("main_text", T.StringType())]))
    return done.select(*(F.col("carried")[name].alias(name) for name in pages.columns if name != text_col), F.col("main_text").alias(text_col))
