import pytest

from boxquery.functions.hilbert import _states, hilbert_cells, hilbert_index, with_hilbert
from boxquery.session import written

# Points and their keys for three dimensions of 20 bits.
KEYS = {
    (0.0, 0.0, 0.0): 0,
    (1.0, 1.0, 1.0): 777871944665950630,
    (0.5, 0.5, 0.5): 97233993083243828,
    (0.25, 0.5, 0.75): 1111001799239757108,
    (0.1, 0.2, 0.3): 62508585272344576,
    (0.9, 0.1, 0.4): 188266633573706150,
}


def test_known_keys(spark):
    df = spark.createDataFrame(list(KEYS), "x float, y float, z float")
    assert [r.h for r in with_hilbert(df, ["x", "y", "z"]).collect()] == list(KEYS.values())


def test_known_key_in_two_dimensions(spark):
    df = spark.createDataFrame([(0.25, 0.75)], "x float, y float")
    assert with_hilbert(df, ["x", "y"]).first().h == 319650606592


def test_one_dimension_is_the_scaled_coordinate(spark):
    df = spark.createDataFrame([(0.25,), (1.0,)], "x float")
    assert [r.h for r in with_hilbert(df, ["x"]).collect()] == [250000, 1000000]


@pytest.mark.parametrize("d, bits", [(2, 4), (2, 5), (3, 3), (4, 2)])
def test_curve_visits_every_cell_in_unit_steps(spark, d, bits):
    cells = [f"c{i}" for i in range(d)]
    walk = hilbert_cells(spark.range(1 << (d * bits)).withColumnRenamed("id", "h"), "h", cells, bits)
    rows = [tuple(r[c] for c in cells) for r in walk.orderBy("h").collect()]
    assert len(set(rows)) == len(rows) == 1 << (d * bits)
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in zip(rows, rows[1:]))
    assert hilbert_index(walk, cells, bits, "again").filter("h <> again").count() == 0


def test_first_cells(spark):
    flat = hilbert_cells(spark.range(8).withColumnRenamed("id", "h"), "h", ["a", "b"], 4).orderBy("h").collect()
    assert [(r.a, r.b) for r in flat] == [(0, 0), (0, 1), (1, 1), (1, 0), (2, 0), (3, 0), (3, 1), (2, 1)]
    solid = hilbert_cells(spark.range(8).withColumnRenamed("id", "h"), "h", ["a", "b", "c"], 3).orderBy("h").collect()
    assert [(r.a, r.b, r.c) for r in solid] == [
        (0, 0, 0), (0, 0, 1), (1, 0, 1), (1, 0, 0), (1, 1, 0), (1, 1, 1), (0, 1, 1), (0, 1, 0),
    ]


def test_full_width_keys_decode(spark, points):
    keyed = written(with_hilbert(points, ["x", "y", "z"]), "keyed")
    back = hilbert_cells(keyed, "h", ["cx", "cy", "cz"], 20)
    wrong = " OR ".join(f"c{d} <> cast(cast(1000000 AS float) * {d} AS bigint)" for d in "xyz")
    assert back.filter(wrong).count() == 0


@pytest.mark.parametrize("value", [-0.1, 1.5, float("nan"), None])
def test_outside_the_unit_cube_raises(spark, value):
    df = spark.createDataFrame([(value, 0.5)], "x float, y float")
    with pytest.raises(Exception, match=r"coordinate x must be a number in \[0, 1\]"):
        with_hilbert(df, ["x", "y"]).collect()


def test_too_many_key_bits_raise(spark):
    with pytest.raises(ValueError):
        with_hilbert(spark.createDataFrame([(0.1, 0.1, 0.1)], "x float, y float, z float"), ["x", "y", "z"], bits=22)


def test_number_of_states():
    assert [len(_states(d)) for d in (2, 3)] == [8, 24]
