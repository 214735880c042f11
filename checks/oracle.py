"""The same results in plain SQL, for DuckDB on the same tables."""

from __future__ import annotations

import math

D3 = ("x", "y", "z")
D2 = ("a", "b")
DEGREE = 192
HALF = "CAST(0.5 AS DOUBLE)"

POINTS = """p AS (
  SELECT (((l_orderkey * 100000 + l_partkey) * 1000 + l_suppkey) * 10 + l_linenumber) * 100
           + CAST(l_quantity AS BIGINT) AS pid,
         CAST((l_quantity - CAST(1 AS DOUBLE)) / CAST(49 AS DOUBLE) AS FLOAT) AS x,
         CAST(l_extendedprice / CAST(105000 AS DOUBLE) AS FLOAT) AS y,
         CAST(l_discount / CAST(0.1 AS DOUBLE) AS FLOAT) AS z
  FROM lineitem)"""

_LOWER64 = ", ".join(
    f"CAST(CAST((q * {m}) % 56 AS DOUBLE) / CAST(64 AS DOUBLE) AS FLOAT) AS l{d}" for d, m in zip(D3, (37, 23, 11))
)
BOXES64 = f"""b AS (
  SELECT *, {", ".join(f"CAST(l{d} + CAST(0.125 AS FLOAT) AS FLOAT) AS h{d}" for d in D3)}
  FROM (SELECT q AS qid, {_LOWER64} FROM range(64) t(q)))"""

_LOWER_PART = ", ".join(
    f"CAST(CAST(p_partkey * {m} % {n} AS DOUBLE) / CAST(128 AS DOUBLE) AS FLOAT) AS l{d}"
    for d, m, n in zip(D3, (37, 23, 11), (101, 113, 97))
)
PART_BOXES = f"""b AS (
  SELECT qid, {", ".join(f"l{d}" for d in D3)}, {", ".join(f"CAST(l{d} + side AS FLOAT) AS h{d}" for d in D3)}
  FROM (SELECT CAST(p_partkey AS BIGINT) AS qid, {_LOWER_PART},
               CAST(power(CAST(2 AS DOUBLE), -4 - p_partkey % 3) AS FLOAT) AS side FROM part))"""

EVENTS = """e AS (
  SELECT -1 - CAST(event_id AS BIGINT) AS pid,
         CAST((epoch_us(CAST(ts AS TIMESTAMP)) - epoch_us(TIMESTAMP '2024-01-01 00:00:00'))
              / (CAST(30 AS DOUBLE) * CAST(86400 AS DOUBLE) * CAST(1000000 AS DOUBLE)) AS FLOAT) AS x,
         CAST(user_id / ((SELECT count(*) FROM customer) / CAST(10 AS DOUBLE)) AS FLOAT) AS y,
         CAST(value / CAST(1000 AS DOUBLE) AS FLOAT) AS z
  FROM events)"""

_SIDE = "CAST(CAST(0.01 AS DOUBLE) AS FLOAT)"
ORDER_BOXES = f"""ob AS (
  SELECT *, least(CAST(la + {_SIDE} AS FLOAT), CAST(1 AS FLOAT)) AS ha,
            least(CAST(lb + {_SIDE} AS FLOAT), CAST(1 AS FLOAT)) AS hb
  FROM (SELECT CAST(o_orderkey AS BIGINT) AS pid,
               CAST(o_custkey / CAST((SELECT count(*) FROM customer) AS DOUBLE) AS FLOAT) AS la,
               CAST(o_totalprice / CAST(500000 AS DOUBLE) AS FLOAT) AS lb FROM orders))"""

FLAT_BOXES = """b AS (SELECT CAST(p_partkey AS BIGINT) AS qid,
         CAST(CAST(p_partkey * 37 % 101 AS DOUBLE) / CAST(128 AS DOUBLE) AS FLOAT) AS la,
         CAST(CAST(p_partkey * 23 % 113 AS DOUBLE) / CAST(128 AS DOUBLE) AS FLOAT) AS lb,
         CAST(CAST(p_partkey * 37 % 101 + 2 AS DOUBLE) / CAST(128 AS DOUBLE) AS FLOAT) AS ha,
         CAST(CAST(p_partkey * 23 % 113 + 2 AS DOUBLE) / CAST(128 AS DOUBLE) AS FLOAT) AS hb FROM part)"""


def query(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def _gray(i: int) -> int:
    return i ^ (i >> 1)


def _turned(corner: int, by: int, d: int) -> int:
    """A corner of the unit cube (one bit per axis) with its axes moved up by some places."""
    by %= d
    return ((corner << by) | (corner >> (d - by))) & ((1 << d) - 1)


def _sub_cubes(d: int) -> tuple[list[int], list[int]]:
    """The curve by its definition, as two lists over (orientation, sub-cube): the sub-cube's rank, and its orientation.

    Inside a cube the curve starts at an entry corner and ends one edge away, along its direction. It visits the
    2**d sub-cubes in Gray code order, laid out from the entry corner with the last axis along the direction.
    Sub-cube number w is entered at the corner where the path from sub-cube w - 1 arrives, and left along the
    axis of the next step. An orientation is numbered entry corner * d + direction.
    """
    cubes = 1 << d
    axis_after = [(_gray(w) ^ _gray(w + 1)).bit_length() - 1 for w in range(cubes - 1)]  # axis of the step from w to w + 1
    enters = [0] + [_gray((w - 1) // 2 * 2) for w in range(1, cubes)]
    # the last sub-cube is left along the first axis, as the first one is
    along = [0] + [axis_after[w - 1] if w % 2 == 0 else axis_after[w] for w in range(1, cubes - 1)] + [0]
    ranks, orientations = [], []
    for entry in range(cubes):
        for direction in range(d):
            visited = {entry ^ _turned(_gray(w), direction + 1, d): w for w in range(cubes)}
            for corner in range(cubes):
                w = visited[corner]
                inner = entry ^ _turned(enters[w], direction + 1, d)
                ranks.append(w)
                orientations.append(inner * d + (direction + along[w] + 1) % d)
    return ranks, orientations


def hilbert(source: str, dims, name: str = "k", carry: str = "*", bits: int | None = None) -> list[str]:
    """CTEs ending in `name`: the source rows with their Hilbert key `h`, one CTE per halving of the cube."""
    d = len(dims)
    bits = bits or (20 if d > 2 else 31)
    ranks, orientations = _sub_cubes(d)
    cells = ", ".join(
        f"CAST(trunc(CAST(1000000 AS FLOAT) * CAST({c} AS FLOAT)) AS BIGINT) AS c{i}" for i, c in enumerate(dims)
    )
    # the whole cube is entered at the origin, and the curve runs along the last axis
    ctes = [f"{name}_0 AS (SELECT {carry}, {cells}, CAST(0 AS BIGINT) AS h, CAST({d - 1} AS BIGINT) AS facing FROM {source})"]
    for level in range(bits):
        corner = " + ".join(f"((c{i} >> {bits - 1 - level}) & 1) * {1 << i}" for i in range(d))
        ctes.append(
            f"{name}_{level + 1} AS (SELECT * EXCLUDE (place) REPLACE (h * {1 << d} + {ranks}[place] AS h, {orientations}[place] AS facing)"
            f" FROM (SELECT *, 1 + facing * {1 << d} + {corner} AS place FROM {name}_{level}))"
        )
    drop = ", ".join([f"c{i}" for i in range(d)] + ["facing"])
    ctes.append(f"{name} AS MATERIALIZED (SELECT * EXCLUDE ({drop}) FROM {name}_{bits})")
    return ctes


def ordinals(source: str, keys: str, name: str = "o") -> list[str]:
    return [
        f"{name} AS MATERIALIZED (SELECT *, (ordinal - 1) // {DEGREE} AS block, (ordinal - 1) % {DEGREE} AS slot FROM ("
        f"SELECT *, row_number() OVER (ORDER BY {keys}) AS ordinal FROM {source}))"
    ]


def bounds_of(lo, hi, dims) -> str:
    return ", ".join([f"min({c}) AS l{d}" for c, d in zip(lo, dims)] + [f"max({c}) AS h{d}" for c, d in zip(hi, dims)])


def blocks(source: str = "o", dims=D3, name: str = "blk", boxes: bool = False) -> list[str]:
    lo = [f"l{d}" for d in dims] if boxes else dims
    hi = [f"h{d}" for d in dims] if boxes else dims
    return [
        f"{name} AS MATERIALIZED (SELECT block, {bounds_of(lo, hi, dims)}, count(*) AS n,"
        f" max(ordinal) AS last_ordinal FROM {source} GROUP BY block)"
    ]


ORDERED = [POINTS, *hilbert("p", D3), *ordinals("k", "h, pid")]
BLOCKED = [*ORDERED, *blocks()]
ORDER_BLOCKED = [
    ORDER_BOXES, *hilbert("ob", ("la", "lb")), *ordinals("k", "h, pid"), *blocks("o", D2, boxes=True)
]


def inside(point: str, box: str, dims=D3) -> str:
    return " AND ".join(f"{point}.{d} BETWEEN {box}.l{d} AND {box}.h{d}" for d in dims)


def meet(a: str, b: str, dims=D3) -> str:
    return " AND ".join(f"{a}.l{d} <= {b}.h{d} AND {b}.l{d} <= {a}.h{d}" for d in dims)


COUNT = (
    "SELECT b.qid, CAST(count(p.pid) AS BIGINT) AS hits FROM b LEFT JOIN p ON "
    + inside("p", "b")
    + " GROUP BY b.qid"
)
HITS = "hits AS (" + COUNT + ")"
PAIRS = "pairs AS MATERIALIZED (SELECT b.qid, blk.block, blk.n FROM b JOIN blk ON " + meet("b", "blk") + ")"


def total(terms) -> str:
    out = terms[0]
    for t in terms[1:]:
        out = f"({out} + {t})"
    return out


def times(terms) -> str:
    out = terms[0]
    for t in terms[1:]:
        out = f"({out} * {t})"
    return out


def dbl(c: str) -> str:
    return f"CAST({c} AS DOUBLE)"


def volume(lo, hi) -> str:
    return times([f"({dbl(h)} - {dbl(l)})" for l, h in zip(lo, hi)])


def sphere(lo, hi) -> str:
    d = len(lo)
    halves = [f"(({dbl(h)} - {dbl(l)}) * {HALF})" for l, h in zip(lo, hi)]
    radius = f"sqrt({total([times([h, h]) for h in halves])})"
    unit = math.pi ** (d / 2) / math.gamma(d / 2 + 1)
    return f"({times([radius] * d)} * {unit!r}e0)"


def joint(a_lo, a_hi, b_lo, b_hi):
    return [f"least({x}, {y})" for x, y in zip(a_lo, b_lo)], [f"greatest({x}, {y})" for x, y in zip(a_hi, b_hi)]


def names(prefix: str, side: str, dims):
    return [f"{prefix}.{side}{d}" for d in dims]


def tiles(capacity: int) -> list[str]:
    """Per row the coarsest key prefix with at most `capacity` rows, from the row counts at every depth."""
    counts = ", ".join(f"count(*) OVER (PARTITION BY h >> {3 * (20 - k)}) AS n{k}" for k in range(21))
    depth = "CASE " + " ".join(f"WHEN n{k} <= {capacity} THEN {k}" for k in range(21)) + " ELSE 20 END"
    return [
        f"t AS MATERIALIZED (SELECT *, h >> (3 * (20 - depth)) AS tile FROM ("
        f"SELECT pid, x, y, z, h, ordinal, CAST({depth} AS BIGINT) AS depth FROM (SELECT *, {counts} FROM o)))"
    ]


def rounds(n: int, k: int) -> list[str]:
    """Lloyd rounds from the first k points by id: a<i> assigns under c<i>, c<i+1> holds the moved centroids."""
    ctes = [
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pid) - 1 AS cluster,"
        f" {', '.join(f'{dbl(d)} AS {d}' for d in D3)} FROM (SELECT * FROM p ORDER BY pid LIMIT {k}))"
    ]
    gap = total([times([f"({dbl('p.' + d)} - c.{d})"] * 2) for d in D3])
    for i in range(n):
        ctes.append(
            f"a{i} AS MATERIALIZED (SELECT pid, x, y, z, cluster FROM (SELECT p.*, c.cluster, row_number() OVER ("
            f"PARTITION BY p.pid ORDER BY {gap}, c.cluster) AS rn FROM p CROSS JOIN c{i} c) WHERE rn = 1)"
        )
        moved = ", ".join(f"coalesce(m.{d}, c.{d}) AS {d}" for d in D3)
        means = ", ".join(f"sum({dbl(d)}) / count(*) AS {d}" for d in D3)
        ctes.append(
            f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, {moved} FROM c{i} c LEFT JOIN ("
            f"SELECT cluster, {means} FROM a{i} GROUP BY cluster) m ON c.cluster = m.cluster)"
        )
    return ctes


def six(c: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({c}, {digits}) AS {name or c}"
