import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxquery.operators.index import build_index
from boxquery.sources import binary
from boxquery.sources import index as stored
from boxquery.sources.normalise import normalise, to_boxes
from boxquery.sources.uniform import uniform_points
from checks.fixtures import part_boxes

DIMS = ("x", "y", "z")


def test_plain_file(spark, tmp_path):
    values = np.arange(30, dtype="<f4") / 32
    path = tmp_path / "points.bin"
    path.write_bytes(values.tobytes())
    rows = binary.read_points(spark, str(path), DIMS).orderBy("pid").collect()
    assert [r.pid for r in rows] == list(range(1, 11))
    assert [v for r in rows for v in (r.x, r.y, r.z)] == values.tolist()
    assert binary.read_points(spark, str(path), DIMS, n=4).count() == 4


def test_splits_number_records(spark, tmp_path, monkeypatch):
    for name, n in (("a.bin", 10), ("b.bin", 7)):
        (tmp_path / name).write_bytes(np.arange(n * 3, dtype="<f4").tobytes())
    monkeypatch.setattr(binary, "SPLIT_BYTES", 48)
    splits = binary._Reader(str(tmp_path), ["pid", *DIMS], None).partitions()
    assert [(s.skip, s.records, s.first) for s in splits] == [
        (0, 4, 1), (4, 4, 5), (8, 2, 9), (0, 4, 11), (4, 3, 15),
    ]


def test_short_and_broken_files_raise(spark, tmp_path):
    path = tmp_path / "bad.bin"
    path.write_bytes(b"\0" * 25)
    with pytest.raises(Exception, match="whole records"):
        binary.read_points(spark, str(path), DIMS).count()
    path.write_bytes(b"\0" * 24)
    with pytest.raises(Exception, match="were asked for"):
        binary.read_points(spark, str(path), DIMS, n=3).count()
    path.write_bytes(np.array([0, np.nan, 1], "<f4").tobytes())
    with pytest.raises(Exception, match="finite"):
        binary.read_points(spark, str(path), DIMS).collect()


def test_points_round_trip(points, spark, tmp_path):
    path = str(tmp_path / "out")
    binary.write_points(points.orderBy("pid"), path, DIMS)
    back = binary.read_points(spark, path, DIMS)
    assert [tuple(r)[1:] for r in back.orderBy("pid").collect()] == [
        tuple(r)[1:] for r in points.orderBy("pid").collect()
    ]
    size = sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".f32"))
    assert size == points.count() * 12


def test_files_of_failed_attempts_are_ignored(points, spark, tmp_path):
    path = str(tmp_path / "out")
    binary.write_points(points, path, DIMS)
    (tmp_path / "out" / "part-000000-dead.f32").write_bytes(b"\0" * 12)
    assert binary.read_points(spark, path, DIMS).count() == points.count()


def test_boxes_round_trip(spark, sf_dir, tmp_path):
    boxes = part_boxes(spark, sf_dir).orderBy("qid")
    binary.write_boxes(boxes, str(tmp_path / "out"), DIMS)
    back = binary.read_boxes(spark, str(tmp_path / "out"), DIMS).orderBy("qid").collect()
    assert [tuple(r)[1:] for r in back] == [tuple(r)[1:] for r in boxes.select("qid", *back[0].__fields__[1:]).collect()]


def test_empty_round_trip(points, spark, tmp_path):
    binary.write_points(points.limit(0), str(tmp_path / "out"), DIMS)
    assert binary.read_points(spark, str(tmp_path / "out"), DIMS).count() == 0


def test_uniform_points_depend_on_number_only(spark):
    whole = {r.pid: tuple(r) for r in uniform_points(spark, 1_000, DIMS).collect()}
    for partitions in (1, 4, 17):
        again = uniform_points(spark, 1_000, DIMS).repartition(partitions)
        assert {r.pid: tuple(r) for r in again.collect()} == whole
    later = uniform_points(spark, 100, DIMS, offset=900).collect()
    assert all(tuple(r) == whole[r.pid] for r in later) and min(r.pid for r in later) == 901
    assert uniform_points(spark, 1_000, DIMS, seed=5).first() != uniform_points(spark, 1_000, DIMS).first()


def test_uniform_points_are_uniform(spark):
    made = uniform_points(spark, 50_000, DIMS)
    for d in DIMS:
        low, high, mean, spread = made.agg(F.min(d), F.max(d), F.avg(d), F.var_samp(d)).first()
        assert 0 < low and high <= 1 and abs(mean - 0.5) < 0.01 and abs(spread - 1 / 12) < 0.005
    assert abs(made.stat.corr("x", "y")) < 0.02


def test_normalise(spark):
    rows = spark.createDataFrame([(10.0,), (20.0,), (15.0,)], "v double")
    assert [r.v for r in normalise(rows, {"v": (10, 20)}).collect()] == [0.0, 1.0, 0.5]
    for bad in (9.0, 21.0, None, float("nan")):
        with pytest.raises(Exception, match="v must be a number"):
            normalise(spark.createDataFrame([(bad,)], "v double"), {"v": (10, 20)}).collect()


def test_points_as_boxes(points):
    rows = to_boxes(points, list(DIMS)).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, 6001))
    assert all(r.lx == r.hx and r.ly == r.hy and r.lz == r.hz for r in rows)


def test_saved_index_is_the_same(index, spark, tmp_path):
    path = str(tmp_path / "ix")
    stored.save_index(index, path)
    back = stored.load_index(spark, path)
    for part in stored.PARTS:
        a, b = getattr(index, part), getattr(back, part)
        assert a.columns == b.columns and a.exceptAll(b).count() == 0 and a.count() == b.count()
    assert (back.dims, back.rows, back.n_blocks, back.degree) == (index.dims, index.rows, index.n_blocks, index.degree)
    rows = spark.read.parquet(f"{path}/points").filter("segment = 3")
    assert "PartitionFilters: [isnotnull(segment" in rows._jdf.queryExecution().toString()


def test_open_reuses_or_rebuilds(points, spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ix")
    builds = []
    monkeypatch.setattr(stored, "build_index", lambda *a, **k: builds.append(1) or build_index(*a, **k))
    open_ = lambda rows=points, **k: stored.open_index(rows, path, DIMS, source="s", **k)
    open_()
    open_()
    assert len(builds) == 1
    open_(degree=100)
    assert len(builds) == 2
    open_(rows=points.limit(5_999), degree=100)
    assert len(builds) == 3
    open_(rows=points.limit(5_999), degree=100, force_rebuild=True)
    assert len(builds) == 4


def test_parts_are_rebuilt_alone(points, spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ix")
    first = stored.open_index(points, path, DIMS, source="s")
    sizes = first.nodes.count(), first.blocks.count()
    monkeypatch.setattr(stored, "build_index", None)
    for lost in ("nodes", "blocks"):
        stored._write_meta(spark, path, lost, None)
        with pytest.raises(FileNotFoundError):
            stored.load_index(spark, path)
        again = stored.open_index(points, path, DIMS, source="s")
        assert (again.nodes.count(), again.blocks.count()) == sizes
        assert again.nodes.exceptAll(build_index(points, DIMS).nodes).count() == 0
