"""Hilbert keys as Column expressions.

The key of a cell is read off a small table, a few bits of every axis at a time. The table follows from
one rule (`_step`), and both directions use it: cell to key, and key to cell. All of it is integer
arithmetic and array lookups, so it runs inside whole-stage code generation without Python workers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

from pyspark.sql import DataFrame, functions as F

# Coordinates in [0, 1] are scaled by one million and cut to whole numbers; 20 key bits
# per axis from three dimensions on, 31 below.
SCALE = 1_000_000
SCALE_BITS = 20
BITS_FEW_DIMS = 31
BITS_MANY_DIMS = 20
KEY_BITS = 63


def default_bits(d: int) -> int:
    if d <= 2:
        return BITS_FEW_DIMS
    return min(BITS_MANY_DIMS, KEY_BITS // d)


def _low_bits(n: int) -> int:
    return (1 << n) - 1


def _rotate_right(value: int, by: int, width: int) -> int:
    return ((value >> by) | (value << (width - by))) & _low_bits(width)


State = tuple[int, int, int]

# Flip, turn and carry above the highest bit level.
START: State = (0, 0, 1)


def _step(state: State, cell: int, d: int) -> tuple[int, State]:
    """One bit level: the key digit of a half-size cell (bit i = axis i), and the state below it.

    The cell is flipped and turned into the curve's frame. Its bits are then summed from the top
    (Gray code to number) starting from the carry, the last such sum of the level above.
    """
    flip, turn, carry = state
    framed = _rotate_right(flip ^ cell, turn, d)
    lowest = framed & _low_bits(d - 1)
    skip = (lowest & -lowest).bit_length()
    digit, parity = 0, 1 - carry
    for i in reversed(range(d)):
        parity ^= (framed >> i) & 1
        digit = (digit << 1) | parity
    return digit, ((1 << turn) ^ cell, (turn + 1 + skip) % d, parity)


@cache
def _states(d: int) -> dict[State, int]:
    """Number of every state that can occur, the start being 0."""
    found, queue = {START: 0}, [START]
    for state in queue:
        for cell in range(1 << d):
            _, following = _step(state, cell, d)
            if following not in found:
                found[following] = len(found)
                queue.append(following)
    return found


@cache
def _table(d: int, levels: int, inverse: bool) -> tuple[int, ...]:
    """For each state and input of d*levels bits: next state in the high bits, output in the low bits.

    Cells are given axis by axis, `levels` bits each, axis 0 lowest; key digits as they stand in the key.
    """
    width = d * levels
    states = _states(d)
    entries = [0] * (len(states) << width)
    for state, number in states.items():
        for cells in range(1 << width):
            digits = 0
            for level in reversed(range(levels)):
                cell = sum(((cells >> (axis * levels + level)) & 1) << axis for axis in range(d))
                digit, state_below = _step(state if level == levels - 1 else state_below, cell, d)
                digits = (digits << d) | digit
            given, wanted = (digits, cells) if inverse else (cells, digits)
            entries[(number << width) | given] = (states[state_below] << width) | wanted
    return tuple(entries)


def _table_sql(d: int, levels: int, inverse: bool) -> str:
    values = ",".join(map(str, _table(d, levels, inverse)))
    return f"cast(split('{values}', ',') as array<int>)"


def _lookups(d: int, bits: int) -> list[tuple[int, int]]:
    """Cut the bit levels into table lookups: (levels, levels left below), highest first."""
    most = max(1, 6 // d)
    sizes = [bits % most] * (bits % most > 0) + [most] * (bits // most)
    return [(levels, bits - sum(sizes[: i + 1])) for i, levels in enumerate(sizes)]


def _bits_sql(column: str, shift: int, n: int) -> str:
    return f"(shiftright({column}, {shift}) & {_low_bits(n)})"


def _or_sql(terms: Sequence[str]) -> str:
    return "(" + " | ".join(terms) + ")"


def _check(d: int, bits: int) -> None:
    if d < 1 or bits < 1 or d * bits > KEY_BITS:
        raise ValueError(f"{d} dimensions of {bits} bits do not fit a {KEY_BITS}-bit key")


def hilbert_index(df: DataFrame, cells: Sequence[str], bits: int, key: str = "h") -> DataFrame:
    """Add the Hilbert key of integer cell columns, each in [0, 2**bits)."""
    d = len(cells)
    _check(d, bits)
    if d == 1:
        return df.withColumn(key, F.col(cells[0]).cast("bigint"))
    exprs, parts, state = [], [], "0"
    for i, (levels, below) in enumerate(_lookups(d, bits)):
        width = d * levels
        axes = [f"shiftleft({_bits_sql(c, below, levels)}, {axis * levels})" for axis, c in enumerate(cells)]
        given = f"shiftleft({state}, {width}) | cast({_or_sql(axes)} AS int)"
        exprs.append(f"get({_table_sql(d, levels, False)}, {given}) AS _w{i}")
        parts.append(f"shiftleft(cast(_w{i} & {_low_bits(width)} AS bigint), {d * below})")
        state = f"shiftright(_w{i}, {width})"
    exprs.append(f"{_or_sql(parts)} AS _key")
    kept = [c for c in df.columns if c != key]
    return df.selectExpr("*", *exprs).select(*kept, F.col("_key").alias(key))


def hilbert_cells(df: DataFrame, key: str, cells: Sequence[str], bits: int) -> DataFrame:
    """Inverse of hilbert_index: add the integer cell columns of a key."""
    d = len(cells)
    _check(d, bits)
    if d == 1:
        return df.withColumn(cells[0], F.col(key))
    exprs, state = [], "0"
    parts: list[list[str]] = [[] for _ in cells]
    for i, (levels, below) in enumerate(_lookups(d, bits)):
        width = d * levels
        given = f"shiftleft({state}, {width}) | cast({_bits_sql(key, d * below, width)} AS int)"
        exprs.append(f"get({_table_sql(d, levels, True)}, {given}) AS _w{i}")
        for axis in range(d):
            piece = _bits_sql(f"_w{i}", axis * levels, levels)
            parts[axis].append(f"shiftleft(cast({piece} AS bigint), {below})")
        state = f"shiftright(_w{i}, {width})"
    exprs += [f"{_or_sql(p)} AS {name}" for p, name in zip(parts, cells)]
    return df.selectExpr("*", *exprs).select(*df.columns, *cells)


def with_hilbert(df: DataFrame, dims: Sequence[str], bits: int | None = None, key: str = "h") -> DataFrame:
    """Add the Hilbert key of points with coordinates in [0, 1]; anything else raises."""
    d = len(dims)
    given, bits = bits, bits or default_bits(d)
    _check(d, bits)
    names = [f"_c{i}" for i in range(d)]
    drop = max(0, SCALE_BITS - bits)
    exprs = []
    for name, dim in zip(names, dims):
        scaled = f"cast(cast({SCALE} AS float) * cast({dim} AS float) AS bigint)"
        exprs.append(
            f"CASE WHEN {dim} >= 0 AND {dim} <= 1 THEN shiftright({scaled}, {drop}) "
            f"ELSE raise_error('coordinate {dim} must be a number in [0, 1]') END AS {name}"
        )
    keyed = hilbert_index(df.selectExpr("*", *exprs), names, bits, key)
    return keyed.drop(*names)
