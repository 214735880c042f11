"""A tolerant reader of HTML: elements in page order with their parents, built in one pass without recursion."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import xxhash

# Groups of element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CLOSE_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
# All others stand in a line of text.
BLOCKS = CLOSE_P | frozenset("html head body noscript template li tr caption colgroup tbody thead tfoot legend optgroup option select button object iframe video audio canvas svg".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A new element of the key closes open ones of the set, up to the elements that bound its scope.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
SPACES = frozenset(["br", "td", "th"])
# An end tag does not close what stands outside of these.
SCOPE = frozenset("html table td th caption button object template".split())

TOKEN = re.compile(
    r"<!---?>|<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:\s+|/|[^\s/>=][^\s/>=]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+))?|=)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
NAME_PARTS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Page:
    """tags, parents, names (words of class, id and role) of the elements; events: (element, text) or (element, None) where
    a block begins or ends."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    names: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    events: list[tuple[int, str | None]] = field(default_factory=list)
    digests: list[int] = field(default_factory=list)
    places: list[int] = field(default_factory=list)
    filled: list[bool] = field(default_factory=list)


def _names(attributes: str) -> tuple[str, ...]:
    if not attributes or attributes.isspace():
        return ()
    found = []
    for key, *values in ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id", "role"):
            found.extend(NAME_PARTS.findall(CAMEL.sub(" ", html.unescape("".join(values))).lower()))
    return tuple(sorted(set(found)))


def parse(source: str, hashed: bool = False) -> Page:
    """The elements of a page. hashed: with a digest of every subtree and of its place, the path of tags and names to it.

    A digest covers the tags, the names and the texts of the subtree, white space evened out, but no other attributes
    and no digits of names. Digests of children make those of parents, so the work grows with the page only.
    """
    page, stack, at, end, open_ = Page(), [0], 0, len(source), Counter()
    contents: list[list[bytes]] = [[b"#page"]] if hashed else []
    if hashed:
        page.digests, page.places, page.filled = [0], [0], [False]

    def text(upto: int) -> None:
        if upto > at:
            add(html.unescape(source[at:upto]))

    def add(found: str) -> None:
        page.events.append((stack[-1], found))
        if hashed:
            even = " ".join(found.split())
            if even:
                contents[stack[-1]].append(b"t" + even.encode("utf-8", "surrogatepass"))
                page.filled[stack[-1]] = True

    def close(upto: int) -> None:
        """Close open elements until the stack has this length."""
        while len(stack) > upto:
            element = stack.pop()
            open_[page.tags[element]] -= 1
            if page.tags[element] in BLOCKS:
                page.events.append((element, None))
            if hashed:
                parent = stack[-1]
                page.digests[element] = digest = xxhash.xxh64_intdigest(b"\0".join(contents[element]))
                contents[parent].append(b"e" + digest.to_bytes(8, "big"))
                page.filled[parent] |= page.filled[element]
                contents[element] = []

    def close_open(tags, bounds) -> None:
        while any(open_[tag] for tag in tags):
            for depth in range(len(stack) - 1, 0, -1):
                tag = page.tags[stack[depth]]
                if tag in tags:
                    close(depth)
                    break
                if tag in bounds or tag in SCOPE:
                    return

    def begin(tag: str, attributes: str) -> None:
        if tag in CLOSE_P:
            close_open({"p"}, ())
        if tag in CLOSED_BY:
            close_open(*CLOSED_BY[tag])
        if tag in HEADINGS and page.tags[stack[-1]] in HEADINGS:
            close(len(stack) - 1)
        if tag == "body" or (tag not in VOID and tag not in RAW and tag not in ("html", "head", "noscript", "template") and len(stack) > 1 and page.tags[stack[-1]] == "head"):
            close_open({"head"}, ())
        element = len(page.tags)
        page.tags.append(tag)
        page.parents.append(stack[-1])
        names = _names(attributes)
        if "-" in tag:
            names = tuple(sorted({*names, *NAME_PARTS.findall(tag)}))
        page.names.append(names)
        if tag in BLOCKS:
            page.events.append((element, None))
        elif tag in SPACES:
            page.events.append((stack[-1], " "))
        if hashed:
            head = " ".join((tag, *names)).encode("utf-8", "surrogatepass")
            contents.append([head])
            page.digests.append(0)
            page.filled.append(False)
            page.places.append(xxhash.xxh64_intdigest(head, seed=page.places[stack[-1]]))
        if tag not in VOID:
            stack.append(element)
            open_[tag] += 1

    def finish(tag: str) -> None:
        if not open_[tag] and tag not in HEADINGS:
            return
        for depth in range(len(stack) - 1, 0, -1):
            here = page.tags[stack[depth]]
            if here == tag or (tag in HEADINGS and here in HEADINGS):
                return close(depth)
            # formatting does not end the blocks inside it, nor anything what lies around a table cell
            if (tag not in BLOCKS and here in BLOCKS) or (here in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html")):
                return

    while at < end:
        start = source.find("<", at)
        if start < 0:
            break
        token = TOKEN.match(source, start)
        if token is None:
            # no markup: text up to the next sign
            following = source.find("<", start + 1)
            following = end if following < 0 else following
            text(following)
            at = following
            continue
        text(start)
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if token["end"]:
            finish(tag)
            continue
        begin(tag, token["attributes"])
        if tag in RAW:
            closing = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end if closing is None else closing.end()
            close(len(stack) - 1)
        elif tag == "plaintext":
            break
    text(end)
    close(1)
    return page
