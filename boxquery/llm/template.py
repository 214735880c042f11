"""A small template language for chat formats: parsed to a tree, constants folded, compiled to closures.

    {{ expression }}                          its text
    {% for name in expression %} ... {% endfor %}     loop.index0, loop.first and loop.last are known inside
    {% if a %} ... {% elif b %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}  marks text that the model is trained to produce
    {# comment #}                             a minus inside a tag ({%- -%}) strips the white space beside it

Expressions know strings, whole numbers, true, false, none, names, `a.key`, `a['key']`, the operators
+ ~ - * == != < > <= >= in, not, and, or, `a if c else b`, and filters `value | filter(argument)`. A template
reaches the given variables and filters and nothing else: keys are looked up in mappings and lists only, never
as attributes of Python objects, and nothing can be called but a filter.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Mapping

_TAG = re.compile(r"\{#.*?#\}|\{\{-?(?P<out>(?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|.)*?)-?\}\}|\{%-?(?P<tag>(?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|.)*?)-?%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<number>\d+)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+*~<>().\[\],|=]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_BINARY = [
    {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "in": lambda a, b: a in b},
    {"~": lambda a, b: as_text(a) + as_text(b)},
    {"+": operator.add, "-": operator.sub},
    {"*": lambda a, b: _times(a, b)},
]
FILTERS: dict[str, Callable] = {
    "trim": lambda x: as_text(x).strip(),
    "upper": lambda x: as_text(x).upper(),
    "lower": lambda x: as_text(x).lower(),
    "length": len,
    "default": lambda x, y="": y if x is None else x,
}


class TemplateError(ValueError):
    pass


def as_text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _times(a, b):
    if not isinstance(a, int) or not isinstance(b, int):
        raise TemplateError("only numbers can be multiplied")
    return a * b


def look_up(value, key):
    """value[key] of a mapping or list; None if there is no such key, or nothing to look into."""
    if isinstance(value, Mapping):
        return value.get(key)
    if isinstance(value, (list, tuple)) and isinstance(key, int) and -len(value) <= key < len(value):
        return value[key]
    return None


# Expressions: ("const", value), ("name", name), ("call", function, [expressions]), ("and" | "or", a, b), ("pick", c, a, b)


class _Expression:
    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.filters, self.at, self.tokens = filters, 0, []
        place = 0
        while place < len(source.rstrip()):
            found = _TOKEN.match(source, place)
            if not found:
                raise TemplateError(f"cannot read {source[place:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            place = found.end()

    def peek(self) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return None if kind == "string" else value

    def take(self, *wanted: str) -> str | None:
        value = self.peek()
        if value is None or value not in wanted:
            return None
        self.at += 1
        return value

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"expected {wanted!r}, found {self.peek()!r}")

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind != "name":
            raise TemplateError(f"expected a name, found {value!r}")
        self.at += 1
        return value

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self):
        value = self.choice()
        self.end()
        return value

    def choice(self):
        value = self.disjunction()
        if self.take("if"):
            condition = self.disjunction()
            other = self.choice() if self.take("else") else ("const", None)
            value = fold(("pick", condition, value, other))
        return value

    def disjunction(self):
        value = self.conjunction()
        while self.take("or"):
            value = fold(("or", value, self.conjunction()))
        return value

    def conjunction(self):
        value = self.negation()
        while self.take("and"):
            value = fold(("and", value, self.negation()))
        return value

    def negation(self):
        if self.take("not"):
            return fold(("call", operator.not_, [self.negation()]))
        return self.binary(0)

    def binary(self, level: int):
        if level == len(_BINARY):
            return self.filtered()
        value = self.binary(level + 1)
        while sign := self.take(*_BINARY[level]):
            value = fold(("call", _BINARY[level][sign], [value, self.binary(level + 1)]))
        return value

    def filtered(self):
        value = self.item()
        while self.take("|"):
            name = self.name()
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            given = [value]
            if self.take("("):
                while not self.take(")"):
                    given.append(self.choice())
                    if self.peek() != ")":
                        self.need(",")
            value = fold(("call", self.filters[name], given))
        return value

    def item(self):
        kind, word = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        self.at += 1
        if kind == "string":
            value = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
        elif kind == "number":
            value = ("const", int(word))
        elif kind == "name":
            value = ("const", _WORDS[word]) if word in _WORDS else ("name", word)
        elif word == "(":
            value = self.choice()
            self.need(")")
        else:
            raise TemplateError(f"unexpected {word!r}")
        while sign := self.take(".", "["):
            if sign == ".":
                key = ("const", self.name())
            else:
                key = self.choice()
                self.need("]")
            value = fold(("call", look_up, [value, key]))
        return value


def fold(node):
    """The node, or the constant it always gives. What would fail keeps its place, and fails only if it is reached."""
    kind = node[0]
    if kind in ("and", "or") and node[1][0] == "const":
        return node[2] if bool(node[1][1]) == (kind == "and") else node[1]
    if kind == "pick" and node[1][0] == "const":
        return node[2] if node[1][1] else node[3]
    if kind == "call" and all(x[0] == "const" for x in node[2]):
        try:
            return ("const", node[1](*(x[1] for x in node[2])))
        except Exception:
            return node
    return node


def parse(source: str, filters: Mapping[str, Callable] | None = None) -> list:
    """The tree of a template: ("text", s), ("out", e), ("for", name, e, body), ("if", [(e, body)]), ("set", name, e), ("generation", body)."""
    known = FILTERS | dict(filters or {})
    pieces, at, strip = [], 0, False
    for found in _TAG.finditer(source):
        text, whole = source[at : found.start()], found[0]
        text = text.lstrip() if strip else text
        pieces.append(("text", text.rstrip() if whole[2] == "-" and found.lastgroup else text))
        strip, at = bool(found.lastgroup) and whole[-3] == "-", found.end()
        if found.lastgroup:
            pieces.append((found.lastgroup, found[found.lastgroup].strip()))
    pieces.append(("text", source[at:].lstrip() if strip else source[at:]))
    pieces.reverse()
    body, ended = _block(pieces, known)
    if ended:
        raise TemplateError(f"unexpected {ended!r}")
    return body


def _block(pieces: list, filters) -> tuple[list, str]:
    """Statements up to a closing or middle tag, and that tag."""
    body: list = []

    def text(value: str) -> None:
        if body and body[-1][0] == "text":
            value = body.pop()[1] + value
        if value:
            body.append(("text", value))

    def add(nodes: list) -> None:
        for node in nodes:
            text(node[1]) if node[0] == "text" else body.append(node)

    def inner(*closing: str) -> tuple[list, str]:
        nodes, ended = _block(pieces, filters)
        if not ended or ended.split()[0] not in closing:
            raise TemplateError(f"expected {' or '.join(closing)}, found {ended or 'the end'!r}")
        return nodes, ended

    while pieces:
        kind, source = pieces.pop()
        if kind == "text":
            text(source)
        elif kind == "out":
            value = _Expression(source, filters).whole()
            text(as_text(value[1])) if value[0] == "const" else body.append(("out", value))
        else:
            word, _, rest = source.partition(" ")
            if word in ("endfor", "endif", "endgeneration", "else", "elif"):
                return body, source
            read = _Expression(rest, filters)
            if word == "for":
                name = read.name()
                read.need("in")
                over = read.whole()
                body.append(("for", name, over, inner("endfor")[0]))
            elif word == "set":
                name = read.name()
                read.need("=")
                body.append(("set", name, read.whole()))
            elif word == "generation":
                read.end()
                body.append(("generation", inner("endgeneration")[0]))
            elif word == "if":
                ways, condition = [], read.whole()
                while True:
                    nodes, ended = inner("elif", "else", "endif") if condition != ("const", "else") else inner("endif")
                    ways.append((("const", True) if condition == ("const", "else") else condition, nodes))
                    if ended == "endif":
                        break
                    condition = ("const", "else") if ended == "else" else _Expression(ended[4:], filters).whole()
                ways = [way for way in ways if way[0][0] != "const" or way[0][1]]
                certain = next((i for i, way in enumerate(ways) if way[0][0] == "const"), None)
                ways = ways if certain is None else ways[: certain + 1]
                if certain == 0:
                    add(ways[0][1])
                elif ways:
                    body.append(("if", ways))
            else:
                raise TemplateError(f"no tag {word!r}")
    return body, ""


class Rendered:
    """Text in pieces, with the marked spans as offsets in code points."""

    def __init__(self):
        self.pieces: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)

    def text(self) -> str:
        return "".join(self.pieces)


def _value(node) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        constant = node[1]
        return lambda env: constant
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name)
    if kind == "and":
        a, b = _value(node[1]), _value(node[2])
        return lambda env: a(env) and b(env)
    if kind == "or":
        a, b = _value(node[1]), _value(node[2])
        return lambda env: a(env) or b(env)
    if kind == "pick":
        condition, a, b = map(_value, node[1:])
        return lambda env: a(env) if condition(env) else b(env)
    function, given = node[1], [_value(x) for x in node[2]]
    if function is look_up and node[2][1][0] == "const":
        inside, key = given[0], node[2][1][1]
        return lambda env: look_up(inside(env), key)
    if len(given) == 1:
        only = given[0]
        return lambda env: function(only(env))
    return lambda env: function(*(x(env) for x in given))


def _steps(body: list) -> Callable[[dict, Rendered], None]:
    steps = [_step(node) for node in body]

    def run(env: dict, out: Rendered) -> None:
        for step in steps:
            step(env, out)

    return steps[0] if len(steps) == 1 else run


def _step(node) -> Callable[[dict, Rendered], None]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda env, out: out.add(text)
    if kind == "out":
        value = _value(node[1])
        return lambda env, out: out.add(as_text(value(env)))
    if kind == "set":
        name, value = node[1], _value(node[2])
        return lambda env, out: env.__setitem__(name, value(env))
    if kind == "generation":
        inside = _steps(node[1])

        def marked(env, out):
            start = out.length
            inside(env, out)
            out.spans.append((start, out.length))

        return marked
    if kind == "if":
        ways = [(_value(condition), _steps(body)) for condition, body in node[1]]

        def branch(env, out):
            for condition, body in ways:
                if condition(env):
                    return body(env, out)

        return branch
    name, over, body = node[1], _value(node[2]), _steps(node[3])

    def loop(env, out):
        items = over(env)
        if items is None:
            return
        if isinstance(items, (str, Mapping)) or not isinstance(items, Iterable):
            raise TemplateError("a loop runs over a list")
        inner, index, none = dict(env), 0, object()
        items = iter(items)
        item = next(items, none)
        while item is not none:
            following = next(items, none)
            inner[name] = item
            inner["loop"] = {"index0": index, "index": index + 1, "first": index == 0, "last": following is none}
            body(inner, out)
            item, index = following, index + 1

    return loop


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[[dict], Rendered]:
    """A function from variables to the rendered text and its marked spans."""
    run = _steps(parse(source, filters))

    def render(variables: dict) -> Rendered:
        out = Rendered()
        run(dict(variables), out)
        return out

    return render
