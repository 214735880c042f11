import math
import random

import numpy as np
import pytest

from boxquery.llm.similar import CHANCE, differing_share, one_of_each, shared_counts, similar_documents, tables_for

SCHEMA = "doc_id bigint, text string, component_id string, p0 int"


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    texts = [None, "", " \n", "a b", "A  B", "one"]
    for _ in range(60):
        words = [word() for _ in range(rng.choice([8, 60, 200, 600]))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 5)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts.append("long text of words " * 30_000)
    return [(1000 - i, t, "c", 1) for i, t in enumerate(texts)]


def by_hand(rows, least=0.8):
    sets, n = [shingles(t) for _, t, *_ in rows], len(rows)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(n):
        groups.setdefault(root(i), []).append(rows[i][0])
    return {rows[i][0]: min(groups[root(i)]) for i in range(n)}


def groups(label):
    out = {}
    for i, c in label.items():
        out.setdefault(c, set()).add(i)
    return list(out.values())


@pytest.mark.parametrize("how", [{}, {"split_above": 20}, {"block": 3}, {"split_above": 5, "block_shingles": 500}])
def test_groups_by_hand(spark, how):
    """The groups of all links of 0.8 or more and of no others, with the production chance."""
    rows = corpus()
    frame = spark.createDataFrame(rows, SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in similar_documents(frame, **how).collect()} == by_hand(rows)


def test_exactly_the_least_similarity_links(spark):
    """Eight shingles of ten different ones are shared, then seven of nine; then 80 of 100 and 79 of 101."""
    words = lambda i, n: [f"t{i}w{j}" for j in range(n)]
    rows = []
    for i, (n, shared) in enumerate([(13, 8), (12, 7), (94, 80), (94, 79)]):
        base = words(i, n)
        cut = shared + 4
        rows += [(2 * i, " ".join(base), "c", 1), (2 * i + 1, " ".join(base[:cut] + [f"x{i}y{j}" for j in range(n - cut)]), "c", 1)]
    got = {r["doc_id"]: r["component_id"] for r in similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == by_hand(rows) == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}


def test_shared_counts():
    rng = np.random.default_rng(0)
    for n, most in ((2, 5), (40, 30), (200, 60)):
        sets = [np.unique(rng.integers(0, most, int(rng.integers(0, most)))) for _ in range(n)]
        counts = shared_counts(sets)
        assert all(counts[i, j] == len(np.intersect1d(sets[i], sets[j])) for j in range(n) for i in range(j))


def test_one_of_each_stays(spark):
    rows = corpus(1)
    frame = spark.createDataFrame([*rows, (None, "some words of a row without an id here", "c", 1), rows[20]], SCHEMA)
    found = {r["doc_id"]: r["component_id"] for r in similar_documents(frame).collect()}
    kept = one_of_each(frame)
    assert kept.columns == ["doc_id", "text", "component_id", "p0"]
    want = sorted([i for i, c in found.items() if i == c and i is not None] + [rows[20][0]] * (found[rows[20][0]] == rows[20][0]))
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == want and got.count(None) == 1


def test_tables_follow_the_number_of_documents():
    assert differing_share(1.0) == 0 and differing_share(0.0) == 0.5
    for n in (100, 10**6, 10**9):
        tables = tables_for(n, differing_share(0.8))
        assert len(set(map(len, tables))) == 1 and 2 ** len(tables[0]) >= n / CHANCE
        assert (1 - (1 - differing_share(0.8)) ** len(tables[0])) ** len(tables) <= 0.01
    assert math.isclose(differing_share(0.8), 0.1517, abs_tol=1e-3)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert similar_documents(empty).collect() == [] and one_of_each(empty).collect() == []


def family(size, seed, partners=0, words=400, own=6, kept=2):
    """Texts on one boilerplate with some own words each; each of the last ones shares a few of them with a partner."""
    rng, texts = random.Random(seed), []
    changes = [{at: f"o{i}x{at}" for at in rng.sample(range(5, words - 5), own)} for i in range(size)]
    for i in range(partners):
        new = {at: f"c{i}x{at}" for at in rng.sample(range(5, words - 5), own - kept)}
        changes.append(dict(list(changes[size - 1 - i].items())[:kept]) | new)
    for i, change in enumerate(changes):
        texts.append((i, " ".join(change.get(at, f"b{at}") for at in range(words)), "c", 1))
    return texts


def labels(spark, rows, **how):
    return {r["doc_id"]: r["component_id"] for r in similar_documents(spark.createDataFrame(rows, SCHEMA), **how).collect()}


def test_every_link_has_the_similarity(spark):
    """A family of some 0.7 to 0.79 on one boilerplate does not become one component by near fingerprints."""
    rows = corpus(2) + [(10_000 + r[0], *r[1:]) for r in family(250, 3)]
    assert labels(spark, rows) == by_hand(rows)


def test_a_partner_behind_nearer_decoys_is_found(spark):
    """Most of a family are decoys near the limit; partners of just above 0.8 are compared although others are nearer."""
    rows = family(300, 5, partners=40)
    want = by_hand(rows)
    assert sum(want[i] != i for i in want) >= 20
    assert labels(spark, rows) == want


def test_large_shards_and_blocks_give_the_same(spark):
    rows = corpus(4) + [(10_000 + r[0], *r[1:]) for r in family(150, 6, partners=30)]
    assert labels(spark, rows, split_above=20, block=16) == labels(spark, rows) == by_hand(rows)
