import hashlib
import random

import pytest

from boxquery.llm import chat
from boxquery.llm.template import TemplateError, compile_template, parse

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted int"


def render(source, **variables):
    return compile_template(source)(variables).text()


@pytest.mark.parametrize(
    "source, text",
    [
        ("a{# gone #}b", "ab"),
        ("{{ 'x' ~ 1 + 2 }}", "x3"),
        ("{{ 1 + 2 * 3 }}|{{ (1 + 2) * 3 }}|{{ 7 - 2 - 1 }}", "7|9|4"),
        ("{{ m.a }}{{ m['b'] }}{{ m.none }}{{ l[1] }}{{ l[9] }}", "123"),
        ("{% for x in l %}{{ loop.index0 }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", "02,13"),
        ("{% if m.a == 1 and not m.c %}y{% else %}n{% endif %}", "y"),
        ("{% if m.a > 1 %}a{% elif 'b' in m %}b{% else %}c{% endif %}", "b"),
        ("{% set z = m.a + 1 %}{{ z }}{{ 'q' if z == 2 else 'r' }}", "2q"),
        ("a  {%- if true -%}  b  {%- endif -%}  c", "abc"),
        ("{{ ' x ' | trim | upper }}{{ none | default('d') }}{{ l | length }}", "Xd2"),
        ("{{ '%} }} \\n\\'' }}", "%} }} \n'"),
    ],
)
def test_language(source, text):
    assert render(source, m={"a": 1, "b": 2}, l=[2, 3]) == text


def test_constants_are_folded():
    assert parse("a{{ 'b' ~ 1 }}{% if 1 > 2 %}no{% elif true %}c{{ 'd' | upper }}{% else %}no{% endif %}") == [("text", "ab1cD")]


@pytest.mark.parametrize("source", ["{% for x %}{% endfor %}", "{% if a %}", "{{ a | nope }}", "{{ f(1) }}", "{% endfor %}", "{{ }}", "{% import os %}", "{{ a b }}", "{{ $ }}"])
def test_faults_are_found(source):
    with pytest.raises(TemplateError):
        parse(source)


def test_python_is_out_of_reach():
    assert render("{{ a.__class__ }}{{ ''.__class__ }}{{ l.append }}", a="x", l=[1]) == ""


def test_marks():
    out = compile_template("a{% generation %}b{{ x }}{% endgeneration %}c{% generation %}{% endgeneration %}")({"x": "yz"})
    assert (out.text(), out.spans) == ("abyzc", [(1, 4), (5, 5)])


def strange(rng):
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", " ", "\n", "é😀", "ok", "\\\\", "\r"]
    return "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))


def test_escaping_is_reversible():
    rng = random.Random(5)
    for _ in range(3000):
        text = strange(rng)
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text
        assert not any(c in hidden for c in chat.CONTROL)


def test_conversations_read_back(spark):
    rng = random.Random(9)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, rng.choice([turn, turn, 0, None]), rng.choice(["user", "assistant", "system", None, strange(rng)]), rng.choice([None, "", strange(rng)]), 1))
    rows += [(99, 0, "user", "x" * 300_000, 1), (99, 1, "assistant", None, 1), rows[-1], rows[-1]]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()}
    convs = {}
    for conv, turn, role, text, _ in rows:
        convs.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(convs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        loss = [t[2] for t in turns if t[1] == "assistant"]
        size = sum(22 + len(chat.escape(t[1])) + len(chat.escape(t[2])) for t in turns)
        want = (conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), sum(map(len, loss)), sha("".join(loss)), size)
        assert tuple(got[conv]) == want


def test_empty_table(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []
