import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxquery.llm.gnat import Tree
from boxquery.llm.hard_negatives import hard_negatives
from boxquery.llm.queries import hard_negatives_query

SCHEMA = "vec_id bigint, embedding array<double>, label int, leaf string, rank int"


def by_hand(rows, positives=5, negatives=3, every=50):
    """(anchor, positive, rank, negative, scores) from all pairs; vectors hold whole numbers."""
    usable = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for a in usable:
        if a[0] % every:
            continue
        scored = sorted((-sum(int(x) * int(y) for x, y in zip(a[1], b[1])), b[0], b[2]) for b in usable if b[0] != a[0] and len(a[1]) == len(b[1]))
        for minus, positive, _ in [s for s in scored if s[2] == a[2]][:positives]:
            fits = [s for s in scored if s[2] != a[2] and -50 * minus <= -100 * s[0] <= -95 * minus][:negatives]
            out.extend((a[0], positive, rank, s[1], -minus, -s[0]) for rank, s in enumerate(fits, 1))
    return sorted(map(repr, out))


def some_rows(seed=0, n=400, d=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d)) * 40
    rows = []
    for i in range(n):
        x = np.floor(centres[rng.integers(8)] + rng.normal(size=d) * rng.choice([0.5, 6, 25]))
        rows.append((i * 5, [float(v) for v in x], int(rng.integers(0, 3)), "clash", 1))
    rows += [(5000 + i, rows[7][1], i % 3, "clash", 1) for i in range(90)]  # one vector many times: ties
    rows += [(6000, None, 1, "c", 1), (6050, rows[1][1], None, "c", 1), (6100, [1.0, None, 1.0, 1.0, 1.0], 1, "c", 1), (6150, [math.nan] * d, 1, "c", 1), (6200, [math.inf] * d, 1, "c", 1)]
    rows += [(None, rows[3][1], 1, "c", 1), (6250, [], 1, "c", 1), (6251, [], 1, "c", 1), (6252, [], 2, "c", 1), (6300, [3.0, 4.0], 1, "c", 1), (6301, [3.0, 4.0], 1, "c", 1), (6302, [2.0, 4.0], 2, "c", 1)]
    return rows + [rows[20], rows[33]]


def found(frame, **how):
    return sorted(repr(tuple(r)) for r in hard_negatives(frame, F.col("vec_id") % 50 == 0, **how).collect())


@pytest.mark.parametrize(
    "how",
    [{}, {"leaf_rows": 8, "bin_rows": 40, "degree": 4}, {"leaf_rows": 3, "bin_rows": 7, "degree": 3, "sample": 60}, {"leaf_rows": 2, "most_leaves": 9, "degree": 3, "bin_rows": 1000}],
)
def test_by_hand(spark, how):
    rows = some_rows()
    assert found(spark.createDataFrame(rows, SCHEMA), **how) == by_hand(rows)


def test_other_counts(spark):
    rows = some_rows(2, 150)
    assert found(spark.createDataFrame(rows, SCHEMA), positives=2, negatives=6, leaf_rows=10, bin_rows=25, degree=5) == by_hand(rows, 2, 6)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(50, None, 1, "", 1)], SCHEMA)) == []


def test_query_by_hand(spark, sf_dir):
    rows = []
    for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect():
        label = (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]
        rows.append((r["vec_id"], [float(math.floor(256 * x)) for x in r["embedding"]], label))
    assert sorted(repr(tuple(r)) for r in hard_negatives_query(spark, sf_dir).collect()) == by_hand(rows)


def test_no_leaf_with_a_hit_is_ruled_out_and_some_are():
    rng = np.random.default_rng(1)
    x = np.floor(np.repeat(rng.normal(size=(30, 4)) * 60, 40, axis=0) + rng.normal(size=(1200, 4)) * 3)
    tree = Tree(x[::5], 5.0, 6, 20, 500)
    leaf = tree.leaf_of(x)
    tree.know([row for row in tree.measured(x)])
    assert tree.leaves > 30 and leaf.max() < tree.leaves
    queries = x[::40]
    scores = queries @ x.T
    low = np.sort(rng.choice(scores.ravel(), (len(queries), 3)), axis=1)
    high = low + np.array([0.0, 200.0, 50.0])
    high[:, 2] = low[:, 2] - 1  # empty
    reached = tree.visits(queries, low, high)
    hit = ((scores[:, :, None] >= low[:, None]) & (scores[:, :, None] <= high[:, None])).any(2)
    for q in range(len(queries)):
        assert reached[q, np.unique(leaf[hit[q]])].all()
    assert reached.mean() < 0.6
