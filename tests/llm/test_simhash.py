import random

import numpy as np
import pytest
import xxhash

from boxquery.llm.bk_trees import Forest
from boxquery.llm.components import components
from boxquery.llm.simhash import _places, links, majorities, near_duplicates, shingle_hashes

SCHEMA = "doc_id bigint, text string, print string, component_id int"


def plain_print(text, size=3):
    words = [w for w in (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    size = min(size, len(words))
    hashes = [xxhash.xxh64(" ".join(words[i : i + size]).encode(), seed=42).intdigest() for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, radius=3):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                parent[root(i)] = root(j)
    groups = {}
    for i, key in enumerate(ids):
        groups.setdefault(root(i), []).append(key)
    return [min((k for k in groups[root(i)] if k is not None), default=None) for i in range(len(ids))]


def near_prints(n, seed=0):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    out = set()
    while len(out) < n:
        out.add(rng.getrandbits(64) if rng.random() < 0.2 else rng.choice(centres) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 6))) & ((1 << 64) - 1))
    return list(out)


def test_majorities():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 2, 255, 0, 256, 1000, 3, 0])
    hashes = rng.integers(0, 1 << 64, counts.sum(), dtype=np.uint64)
    got, at = majorities(hashes, counts).tolist(), 0
    for value, n in zip(got, counts.tolist()):
        part = hashes[at : at + n].tolist()
        at += n
        assert value == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in part) > n)


def test_forest_finds_every_earlier_neighbour():
    prints = np.array(near_prints(900), dtype=np.uint64)
    shards = np.sort(np.random.default_rng(0).integers(0, 4, 900))
    got = {(a, b) for later, earlier in Forest(prints, shards).earlier_within(3, at_once=5000) for a, b in zip(later.tolist(), earlier.tolist())}
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    want = {(i, j) for i in range(900) for j in range(i) if near[i, j] and shards[i] == shards[j]}
    assert got == want


def test_blocks_cover_the_free_bits():
    assert sorted(p for block in _places(1, 4) for p in block) == list(range(64))
    assert not set(_places(1, 4)[2]) & {p for block in _places(4 + 2, 4) for p in block}
    assert sum(map(len, _places((4 + 2) * 4 + 1, 4))) == 36


@pytest.mark.parametrize("split_above, deepest", [(4096, 4), (30, 2), (5, 4)])
def test_links_connect_what_is_near(spark, split_above, deepest):
    prints = near_prints(700, seed=5)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "print bigint")
    found = components(links(frame, 3, split_above, deepest), "a", "b").collect()
    label = {p: p for p in signed} | {r["node"]: r["component"] for r in found}
    assert [label[p] for p in signed] == plain_components(prints, signed)


def test_documents_by_hand(spark):
    rng = random.Random(8)
    say = lambda n: [rng.choice(["a", "B", "été", "x,", "longer-word"]) + str(rng.randint(0, 30)) for _ in range(n)]
    texts = [None, "", " \t\x0b\x0c\r\n ", "one", "one two", "ONE two", "one two three"]
    for _ in range(40):
        words = say(rng.randint(1, 400))
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            changed = list(words)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(len(words))] = "changed"
            texts.append("\n".join(changed))
    texts.append("very long text " * 40_000)
    ids = [None if i in (4, 9) else 1000 - i for i in range(len(texts))]
    rows = [(i, t, "c", 1) for i, t in zip(ids, texts)] + [(ids[7], texts[7], "c", 1)]
    prints = [plain_print(t) for _, t, *_ in rows]
    want = sorted(map(repr, zip([r[0] for r in rows], [f"{p:016x}" for p in prints], plain_components(prints, [r[0] for r in rows]))))
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(repr, map(tuple, got))) == want


def test_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000)]
    random.Random(3).shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 400)}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert shingle_hashes(b"", 3) == []
