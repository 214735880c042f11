import math

import numpy as np
import pytest

from boxquery.llm.metric_join import range_join

SCHEMA = "vec_id bigint, embedding array<float>, label int, n_links string, grp int"


def by_hand(rows, least=0.98):
    unit, n = [], len(rows)
    for _, e, label, *_ in rows:
        fine = label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)
        e = np.array(e, dtype=np.float32).astype(np.float64) if fine else None
        unit.append(e / np.linalg.norm(e) if fine else None)
    linked = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(n)]
    out, reach = [], {}
    for i in range(n):
        if i not in reach:
            seen, todo = {i}, [i]
            while todo:
                for j in linked[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            for j in seen:
                reach[j] = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((rows[i][0], len(linked[i]), reach[i], rows[i][0] == reach[i]))
    return sorted(map(repr, out))


def vectors(seed=0, n=260):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 6))
    rows = []
    for i in range(n):
        x = centres[rng.integers(12)] * rng.uniform(0.5, 2) + rng.normal(size=6) * rng.choice([0.02, 0.1, 0.6])
        rows.append((i + 5, [float(np.float32(v)) for v in x], int(rng.choice([1, 1, 1, 2])), "c", 1))
    one = rows[3]
    rows += [(1000 + i, one[1], one[2], "c", 1) for i in range(40)]
    rows += [(2000, one[1], None, "c", 1), (2001, None, 1, "c", 1), (2002, [], 1, "c", 1), (2003, [0.0] * 6, 1, "c", 1), (2004, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, "c", 1)]
    rows += [(2005, [math.nan] * 6, 1, "c", 1), (2006, [math.inf] + [1.0] * 5, 1, "c", 1), (None, one[1], one[2], "c", 1), (None, [9.0, -9.0, 1.0, 0.0, 0.0, 3.0], 7, "c", 1)]
    rows += [(2007, [1.0, 2.0], 1, "c", 1), (2008, [2.0, 4.0], 1, "c", 1), (2009, [1e-30] * 6, 5, "c", 1), (2010, [1e30] * 6, 5, "c", 1), rows[9]]
    return rows


@pytest.mark.parametrize("cell, most", [(2048, 16384), (16, 16384), (5, 16384), (3, 8)])
def test_links_by_hand(spark, cell, most):
    rows = vectors()
    got = range_join(spark.createDataFrame(rows, SCHEMA), cell=cell, most_pivots=most).collect()
    assert sorted(map(repr, map(tuple, got))) == by_hand(rows)


def test_other_thresholds_and_doubles(spark):
    rows = vectors(1, 120)
    frame = spark.createDataFrame(rows, SCHEMA.replace("array<float>", "array<double>"))
    for least in (0.9, 0.5, -0.2):
        got = range_join(frame, least_cosine=least, cell=10).collect()
        assert sorted(map(repr, map(tuple, got))) == by_hand(rows, least)


def test_empty_table(spark):
    assert range_join(spark.createDataFrame([], SCHEMA)).collect() == []
