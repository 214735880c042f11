from pathlib import Path

import pytest
from pyspark.sql import functions as F

from boxquery import build_index, range_count, range_search
from boxquery.functions.boxes import bound_names
from boxquery.operators.blocks import block_summary
from boxquery.operators.mutate import insert, remove
from boxquery.operators.runs import scan_ranges
from boxquery.plans.range_count import partitioned_count
from boxquery.sources.changes import insert_rows, open_changing, remove_rows, save_changing, tidy, vacuum_changing
from boxquery.sources.index import load_index, save_index
from checks.fixtures import boxes64, events3

DIMS = ("x", "y", "z")
METHODS = ("blocks", "levels", "packed", "ranges")


def counts(data, boxes, **kwargs):
    return {r.qid: r.hits for r in range_count(data, boxes, **kwargs).collect()}


def files(path, kind):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path, kind).rglob("*.parquet")}


def requests_for(rows, top=1.0):
    corners = dict(zip(bound_names(DIMS), (0.0, 0.0, 0.0, 1.0, top, 1.0)))
    return rows.select(F.col("pid").alias("request"), "pid", *[F.lit(v).alias(n) for n, v in corners.items()])


def agrees(spark, index, rows, methods=("blocks",)):
    """Counts are those of the plain rows; ordinals and summaries those of a new build. All plans for METHODS."""
    boxes = boxes64(spark)
    want = counts(rows, boxes, dims=DIMS)
    for method in methods:
        assert counts(index, boxes, method=method) == want, method
    fresh = build_index(rows, DIMS, degree=index.degree)
    columns = ["pid", "h", "ordinal"]
    assert index.rows == fresh.rows == index.points.count()
    assert index.points.select(*columns).exceptAll(fresh.points.select(*columns)).isEmpty()
    kept = ["block", *bound_names(DIMS), "n", "last_ordinal"]
    exact = block_summary(index.points, DIMS).select(*kept)
    assert exact.exceptAll(index.blocks.select(*kept)).isEmpty() and exact.count() == index.blocks.count()
    if methods is not METHODS:
        return
    first = range_search(index, boxes, limit_per_query=5, first_blocks=2)
    assert first.exceptAll(range_search(fresh, boxes, limit_per_query=5)).isEmpty()
    parts = {(r.part, r.qid): r.hits for r in partitioned_count(index, boxes, 7).filter("hits > 0").collect()}
    assert parts == {(r.part, r.qid): r.hits for r in partitioned_count(fresh, boxes, 7).filter("hits > 0").collect()}


def test_insert_writes_only_the_parts_it_hits(spark, points, tmp_path):
    path = str(tmp_path / "ix")
    index = save_changing(build_index(points, DIMS, degree=16), path)
    assert len(index.parts) > 50
    here = points.orderBy("pid").first()
    added = spark.range(40).selectExpr("-1 - id AS pid", *[f"CAST({here[d]} AS FLOAT) AS {d}" for d in DIMS])
    before = files(path, "points")
    bigger = insert_rows(spark, path, added)
    after = files(path, "points")
    assert {k: after[k] for k in before} == before
    assert len(set(after) - set(before)) <= 2
    changed = {name for _, name in bigger.parts} - {name for _, name in index.parts}
    assert 1 <= len(changed) <= 2 and {name for _, name in index.parts} - {name for _, name in bigger.parts}
    agrees(spark, bigger, points.unionByName(added))


def test_removing_writes_marks_only(spark, points, tmp_path):
    path = str(tmp_path / "ix")
    index = save_changing(build_index(points, DIMS, degree=192), path)
    before = files(path, "points") | files(path, "blocks")
    gone = points.filter("pid % 3 = 0")
    smaller, found = remove_rows(spark, path, requests_for(gone, 0.6))
    assert files(path, "points") | files(path, "blocks") == before
    kept = points.filter((F.col("pid") % 3 != 0) | (F.col("y") > F.lit(0.6).cast("float")))
    assert found.filter("found").count() == points.count() - kept.count() > 100
    assert found.count() == gone.count()
    agrees(spark, smaller, kept, METHODS)
    runs = scan_ranges(smaller, boxes64(spark)).agg(F.sum("blocks")).first()[0]
    assert runs <= scan_ranges(index, boxes64(spark)).agg(F.sum("blocks")).first()[0]
    again, found = remove_rows(spark, path, requests_for(gone, 0.6))
    assert found.filter("found").isEmpty() and again.rows == smaller.rows
    assert len(list((tmp_path / "ix" / "versions").glob("v*"))) == 2


def test_rounds_of_changes(spark, sf_dir, points, tmp_path, monkeypatch):
    """Marks twice in a part, inserts into parts with marks, then full blocks again; marks are joined by a shuffle."""
    import boxquery.plans.candidates as candidates
    import boxquery.sources.changes as changes

    monkeypatch.setattr(changes, "BROADCAST_ROWS", 4)
    monkeypatch.setattr(candidates, "FEW_SEGMENTS", 1)
    monkeypatch.setattr(candidates, "FLAT_BLOCKS", 4)
    path = str(tmp_path / "ix")
    start = points.filter("pid % 3 = 0")
    save_changing(build_index(start, DIMS, degree=70), path)
    added = events3(spark, sf_dir).filter("pid % 4 = 0")
    remove_rows(spark, path, requests_for(start, 0.2))
    remove_rows(spark, path, requests_for(start.filter("pid % 5 = 0")))
    index = insert_rows(spark, path, added)
    rows = start.filter((F.col("y") > 0.2) & (F.col("pid") % 5 != 0)).unionByName(added)
    agrees(spark, index, rows, ("levels", "packed"))
    whole = tidy(spark, path)
    agrees(spark, whole, rows)
    assert whole.blocks.filter("n < 70").count() <= 1


def test_all_rows_go_and_come_back(spark, points, tmp_path):
    path = str(tmp_path / "ix")
    some = points.filter("pid % 7 = 0")
    save_changing(build_index(some, DIMS, degree=8), path)
    index, _ = remove_rows(spark, path, requests_for(some))
    assert index.rows == index.points.count() == index.blocks.count() == 0
    assert set(counts(index, boxes64(spark)).values()) == {0}
    assert tidy(spark, path).rows == 0
    agrees(spark, insert_rows(spark, path, some), some)


def test_a_hot_region_is_cut(spark, points, tmp_path, monkeypatch):
    import boxquery.sources.changes as changes

    path = str(tmp_path / "ix")
    save_changing(build_index(points, DIMS, degree=16), path)
    here = points.orderBy("pid").first()
    added = spark.range(3_000).selectExpr("-1 - id AS pid", *[f"CAST({here[d]} AS FLOAT) AS {d}" for d in DIMS])
    cut = []
    real = changes.with_ordinal
    monkeypatch.setattr(changes, "with_ordinal", lambda df, *a, **k: cut.append(df.count()) or real(df, *a, **k))
    bigger = insert_rows(spark, path, added)
    assert len(cut) == 1 and 3_000 <= cut[0] < 3_500
    most = changes.SEGMENT_GROWTH * bigger.segment_blocks * 16
    assert bigger.points.groupBy("_part").count().agg(F.max("count")).first()[0] <= most
    agrees(spark, bigger, points.unionByName(added))


def test_two_writers_at_once_keep_both(spark, points, tmp_path, monkeypatch):
    import boxquery.sources.changes as changes

    path = str(tmp_path / "ix")
    save_changing(build_index(points, DIMS, degree=16), path)
    one = spark.createDataFrame([(-1, 0.5, 0.5, 0.5)], "pid long, x float, y float, z float")
    two = spark.createDataFrame([(-2, 0.5, 0.5, 0.5)], one.schema)
    real, calls = changes._published, []

    def published(store, parts):
        if not calls:
            calls.append("inner")
            changes.insert_rows(spark, path, two)
        calls.append(real(store, parts))
        return calls[-1]

    monkeypatch.setattr(changes, "_published", published)
    index = changes.insert_rows(spark, path, one)
    assert calls == ["inner", True, False, True]
    agrees(spark, index, points.unionByName(one).unionByName(two))
    assert not list(Path(path, "versions").glob("unpublished-*"))


def test_vacuum_keeps_what_is_read(spark, points, tmp_path):
    path = str(tmp_path / "ix")
    save_changing(build_index(points, DIMS, degree=16), path)
    remove_rows(spark, path, requests_for(points.filter("pid % 3 = 0")))
    one = spark.createDataFrame([(-1, 0.5, 0.5, 0.5)], "pid long, x float, y float, z float")
    insert_rows(spark, path, one)
    rows = points.filter("pid % 3 <> 0").unionByName(one)
    assert vacuum_changing(spark, path, keep=3) == 0 and vacuum_changing(spark, path) == 2
    agrees(spark, open_changing(spark, path), rows)
    tidy(spark, path)
    assert vacuum_changing(spark, path) == 1 and not files(path, "states")
    agrees(spark, open_changing(spark, path), rows)
    with pytest.raises(ValueError):
        vacuum_changing(spark, path, keep=0)


def test_changed_index_goes_elsewhere(spark, points, sf_dir, tmp_path):
    """An opened version can be changed in memory and saved as a plain index, with full blocks."""
    path = str(tmp_path / "ix")
    save_changing(build_index(points.withColumn("tag", F.col("pid") % 5), DIMS, degree=16), path)
    index, _ = remove_rows(spark, path, requests_for(points.filter("pid % 3 = 0"), 0.5))
    added = events3(spark, sf_dir)
    rows = points.filter((F.col("pid") % 3 != 0) | (F.col("y") > 0.5))
    bigger = insert(index, added)
    assert counts(bigger, boxes64(spark)) == counts(rows.unionByName(added), boxes64(spark), dims=DIMS)
    back, _ = remove(bigger, requests_for(added))
    save_index(index, str(tmp_path / "plain"))
    plain = load_index(spark, str(tmp_path / "plain"))
    assert plain.full_blocks and plain.rows == back.rows == index.rows
    assert counts(plain, boxes64(spark), method="levels") == counts(back, boxes64(spark))
    assert plain.points.filter("tag <> pid % 5").isEmpty()


def test_wrong_rows_are_refused(spark, points, tmp_path):
    path = str(tmp_path / "ix")
    index = save_changing(build_index(points, DIMS), path)
    for wrong in (points.limit(1), points.limit(1).withColumns({"pid": F.lit(-5).cast("long"), "other": F.lit(1)})):
        with pytest.raises(ValueError):
            insert_rows(spark, path, wrong)
    with pytest.raises(ValueError):
        save_changing(index, path)
    with pytest.raises(FileNotFoundError):
        open_changing(spark, str(tmp_path / "none"))
    assert insert_rows(spark, path, points.limit(0)).rows == index.rows


def test_first_keys_and_marks_without_sorting_all_rows(spark, points, tmp_path, monkeypatch):
    """A part's first keys come from its first row; marks too many to broadcast meet their rows by hash."""
    import boxquery.sources.changes as changes

    path = str(tmp_path / "ix")
    index = save_changing(build_index(points, DIMS, degree=16), path)
    assert "_head" not in spark.read.parquet(f"{path}/blocks").columns
    least = index.points.groupBy("_part").agg(F.min(F.struct("h", "pid")).alias("least")).collect()
    assert {p.name: p.first for p in changes._latest(spark, path).parts} == {r["_part"]: tuple(r["least"]) for r in least}
    gone = points.filter("pid % 3 = 0")
    monkeypatch.setattr(changes, "BROADCAST_ROWS", 4)
    smaller, _ = remove_rows(spark, path, requests_for(gone))
    assert "ShuffledHashJoin" in smaller.points._jdf.queryExecution().executedPlan().toString()
    agrees(spark, smaller, points.join(gone, "pid", "left_anti"))
