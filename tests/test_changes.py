import pytest
from pyspark.sql import functions as F

from boxquery import build_index, range_count
from boxquery.functions.boxes import bound_names
from boxquery.operators.mutate import insert, remove
from boxquery.sources.index import load_index, save_index
from boxquery.streaming.insert import compacted, current_rows, delta_rows, insert_stream
from checks.fixtures import boxes64, events3, table

DIMS = ("x", "y", "z")


def counts(data, boxes, **kwargs):
    return {r.qid: r.hits for r in range_count(data, boxes, **kwargs).collect()}


def test_insert_equals_a_build_over_both(spark, sf_dir, points, index):
    added = events3(spark, sf_dir)
    bigger = insert(index, added)
    fresh = build_index(points.unionByName(added), DIMS)
    columns = ["pid", "h", "ordinal", "block"]
    assert bigger.points.select(*columns).exceptAll(fresh.points.select(*columns)).count() == 0
    assert bigger.rows == fresh.rows == 7_000


def test_insert_and_remove_restore_the_answers(spark, sf_dir, index):
    boxes, added = boxes64(spark), events3(spark, sf_dir)
    whole = dict(zip(bound_names(DIMS), (0, 0, 0, 1, 1, 1)))
    requests = added.select(
        F.col("pid").alias("request"), "pid", *[F.lit(v).cast("float").alias(n) for n, v in whole.items()]
    )
    back, found = remove(insert(index, added), requests)
    assert counts(back, boxes) == counts(index, boxes)
    assert found.filter("found").count() == found.count() == 1_000
    again, found = remove(back, requests)
    assert found.filter("found").count() == 0 and again.rows == index.rows


def test_remove_needs_id_and_place(spark, index):
    row = index.points.orderBy("pid").first()
    here = [row.x, row.y, row.z]
    away = [2.0, 2.0, 2.0]
    requests = spark.createDataFrame(
        [(1, row.pid, *away, *away), (2, -7, *here, *here), (3, row.pid, *here, *here), (4, row.pid, *here, *here)],
        "request long, pid long, lx double, ly double, lz double, hx double, hy double, hz double",
    )
    smaller, found = remove(index, requests)
    assert {r.request: r.found for r in found.collect()} == {1: False, 2: False, 3: True, 4: True}
    assert smaller.rows == index.rows - 1


def test_kmeans_index_cannot_take_rows(spark, sf_dir, points):
    clustered = build_index(points, DIMS, cluster="kmeans", k=4, max_iter=2)
    assert counts(clustered, boxes64(spark)) == counts(points, boxes64(spark), dims=DIMS)
    with pytest.raises(ValueError):
        insert(clustered, events3(spark, sf_dir))


def test_stream_equals_batch(spark, sf_dir, index, tmp_path):
    path = str(tmp_path / "ix")
    save_index(index, path)
    assert delta_rows(spark, path) is None
    raw = table(spark, sf_dir, "events")
    source = tmp_path / "in"
    raw.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = insert_stream(events3(spark, sf_dir, stream), path, DIMS, str(tmp_path / "progress"))
    query.awaitTermination()
    boxes, batch = boxes64(spark), insert(index, events3(spark, sf_dir))
    assert delta_rows(spark, path).select("batch_id").distinct().count() == 3
    stored = load_index(spark, path)
    assert stored.rows == batch.rows and counts(stored, boxes) == counts(batch, boxes)
    assert counts(current_rows(index, path), boxes, dims=DIMS) == counts(batch, boxes)
    assert counts(compacted(stored, path), boxes) == counts(batch, boxes)
    assert delta_rows(spark, path) is None
    # The same progress folder again: nothing new arrives and nothing is counted twice.
    again = insert_stream(events3(spark, sf_dir, stream), path, DIMS, str(tmp_path / "progress"))
    again.awaitTermination()
    assert compacted(stored, path).rows == batch.rows


def test_two_streams_keep_their_rows(spark, sf_dir, index, tmp_path):
    path = str(tmp_path / "ix")
    save_index(index, path)
    raw = table(spark, sf_dir, "events")
    for part in (0, 1):
        source = str(tmp_path / f"in{part}")
        raw.filter(F.col("event_id") % 2 == part).write.parquet(source)
        stream = spark.readStream.schema(raw.schema).parquet(source)
        insert_stream(events3(spark, sf_dir, stream), path, DIMS, str(tmp_path / f"progress{part}")).awaitTermination()
        if part == 0:
            assert compacted(load_index(spark, path), path).rows == index.rows + raw.filter("event_id % 2 = 0").count()
    assert load_index(spark, path).rows == index.rows + raw.count()
    assert delta_rows(spark, path).count() == raw.filter("event_id % 2 = 1").count()
    assert compacted(index, path).rows == load_index(spark, path).rows == index.rows + raw.count()
    save_index(index, path)  # saved anew: all that was inserted is beside it again
    assert load_index(spark, path).rows == index.rows + raw.count()


def test_insert_keeps_other_columns(spark, sf_dir, points):
    tagged = build_index(points.withColumn("tag", F.col("pid") % 5), DIMS)
    bigger = insert(tagged, events3(spark, sf_dir))
    assert dict(bigger.points.groupBy((F.col("tag") == F.col("pid") % 5).alias("same")).count().collect()) == {True: 6_000, None: 1_000}
    with pytest.raises(ValueError):
        insert(tagged, events3(spark, sf_dir).withColumn("other", F.lit(1)))
    with pytest.raises(ValueError):
        insert(tagged, points.limit(1))


@pytest.mark.parametrize("name", ["h", "slot", "block", "segment", "ordinal"])
def test_names_of_the_index_are_not_overwritten(points, name):
    with pytest.raises(ValueError):
        build_index(points.withColumn(name, F.lit("mine")), DIMS)


def test_many_rounds_of_changes_keep_the_order(spark, points):
    """Inserts before the first, after the last and between equal keys; deletes that empty whole blocks."""
    start = points.filter("pid % 5 > 0").limit(3_000)
    start = spark.createDataFrame(start.collect(), start.schema)
    index = build_index(start, DIMS, degree=8)
    rows = start
    for turn in range(3):
        twins = rows.limit(200).withColumn("pid", -F.col("pid") * 10 - turn)
        corners = spark.sql(f"SELECT {-turn * 10 - 1}L AS pid, 0f AS x, 0f AS y, 0f AS z UNION ALL SELECT {-turn * 10 - 2}L, 1f, 1f, 1f")
        added = twins.unionByName(corners)
        index, rows = insert(index, added), rows.unionByName(added)
        half = rows.filter(F.pmod("pid", F.lit(4)) == turn).select(F.col("pid").alias("request"), "pid")
        whole = dict(zip(bound_names(DIMS), (0.0, 0.0, 0.0, 1.0, 0.6, 1.0)))
        asked = half.select("*", *[F.lit(v).alias(n) for n, v in whole.items()])
        index, _ = remove(index, asked)
        rows = rows.filter(~((F.pmod("pid", F.lit(4)) == turn) & (F.col("y") <= F.lit(0.6))))
    fresh = build_index(rows, DIMS, degree=8)
    columns = ["pid", "h", "ordinal", "block", "slot"]
    assert index.rows == fresh.rows
    assert index.points.select(*columns).exceptAll(fresh.points.select(*columns)).isEmpty()
    assert counts(index, boxes64(spark), method="levels") == counts(rows, boxes64(spark), dims=DIMS)


def test_many_delete_requests_are_joined(spark, sf_dir, index, monkeypatch):
    import boxquery.operators.mutate as mutate

    requests = index.points.filter("pid % 3 = 0").select(F.col("pid").alias("request"), "pid", *[F.lit(v).alias(n) for n, v in zip(bound_names(DIMS), (0.0, 0.0, 0.0, 1.0, 0.5, 1.0))])
    want = {r.request for r in mutate.match_deletes(index, requests).collect()}
    monkeypatch.setattr(mutate, "BROADCAST_ROWS", 4)
    assert {r.request for r in mutate.match_deletes(index, requests).collect()} == want != set()


def test_repeated_ids_do_not_poison_the_index(spark, index, tmp_path):
    """Rows that a stream delivers twice, that another repeats, and ids that are stored: the first row counts."""
    path = str(tmp_path / "ix")
    save_index(index, path)
    stored = index.points.orderBy("pid").first()
    schema = "pid long, x float, y float, z float"
    batches = [
        [(-1, 0.5, 0.5, 0.5), (-1, 0.5, 0.5, 0.5), (-2, 0.1, 0.1, 0.1), (stored.pid, 0.9, 0.9, 0.9)],
        [(-2, 0.7, 0.7, 0.7), (-3, 0.2, 0.2, 0.2)],
    ]
    for number in range(2):
        for at, batch in enumerate(batches):
            source = str(tmp_path / f"in{number}{at}")
            spark.createDataFrame(batch, schema).coalesce(1).write.parquet(source)
            stream = spark.readStream.schema(schema).parquet(source)
            insert_stream(stream, path, DIMS, str(tmp_path / f"progress{number}{at}")).awaitTermination()
        opened = load_index(spark, path)
        for rows in (opened.points, current_rows(index, path)):
            found = {r.pid: (round(r.x, 3), round(r.z, 3)) for r in rows.filter("pid < 0").collect()}
            assert set(found) == {-1, -2, -3} and found[-1] == (0.5, 0.5) and found[-3] == (0.2, 0.2) and found[-2] in ((0.1, 0.1), (0.7, 0.7))
            assert rows.count() == index.rows + 3 and rows.filter(F.col("pid") == stored.pid).count() == 1
    assert compacted(opened, path).rows == index.rows + 3 and delta_rows(spark, path) is None
    kept = load_index(spark, path).points.filter(F.col("pid") == stored.pid).first()
    assert (kept.x, kept.y, kept.z) == (stored.x, stored.y, stored.z)


def test_segments_that_grow_are_cut(spark, points, monkeypatch):
    """All new rows lie in one place; no window then holds their segment, and the order is that of a new build."""
    import boxquery.operators.mutate as mutate

    index = build_index(points, DIMS, degree=16)
    here = points.orderBy("pid").first()
    added = spark.range(3_000).selectExpr("-1 - id AS pid", *[f"CAST({here[d]} AS FLOAT) AS {d}" for d in DIMS])
    ranged = []
    real = mutate.with_ordinal
    monkeypatch.setattr(mutate, "with_ordinal", lambda df, *a, **k: ranged.append(df.count()) or real(df, *a, **k))
    bigger = insert(index, added)
    assert len(ranged) == 1 and 3_000 <= ranged[0] < 3_300
    columns = ["pid", "h", "ordinal", "block", "segment"]
    fresh = build_index(points.unionByName(added), DIMS, degree=16)
    assert bigger.points.select(*columns).exceptAll(fresh.points.select(*columns)).count() == 0
    assert bigger.rows == fresh.rows == 9_000


def delta_batch(rows, path, stream, batch=0):
    from boxquery.operators.order import with_box_hilbert

    with_box_hilbert(rows, DIMS).write.parquet(f"{path}/delta/stream={stream}/batch_id={batch}")


def test_two_compactions_at_once_keep_both(spark, sf_dir, index, tmp_path, monkeypatch):
    """A compaction that ends while another runs makes that one start again from the version just published."""
    import boxquery.sources.index as stored

    path, added = str(tmp_path / "ix"), events3(spark, sf_dir)
    save_index(index, path)
    delta_batch(added.filter("pid % 2 = 0"), path, "a")
    real, published = stored._publish, []

    def publish(spark, path, number, content):
        if not published:
            published.append(None)
            delta_batch(added.filter("pid % 2 <> 0"), path, "b")
            stored.compact(spark, path)
        published.append(real(spark, path, number, content))
        return published[-1]

    monkeypatch.setattr(stored, "_publish", publish)
    merged = stored.compact(spark, path)
    # the inner one had seen both batches, so nothing is left for the outer one, which lost the number
    assert published == [None, True, False]
    assert merged.rows == 7_000 and merged.points.select("pid").distinct().count() == 7_000
    assert delta_rows(spark, path) is None
    assert len(list((tmp_path / "ix").glob("version-*"))) == 1 and not list((tmp_path / "ix").glob("unpublished-*"))


def test_vacuum_leaves_the_kept_versions(spark, sf_dir, index, tmp_path):
    from boxquery.sources.index import compact, vacuum

    path, added = tmp_path / "ix", events3(spark, sf_dir)
    save_index(index, str(path))
    assert vacuum(spark, str(path)) == 0
    for batch in range(2):
        delta_batch(added.filter(f"pmod(pid, 2) = {batch}"), path, "a", batch)
        compact(spark, str(path))
    assert vacuum(spark, str(path), keep=3) == 0
    assert vacuum(spark, str(path), keep=2) == 1
    assert not (path / "points").exists() and len(list(path.glob("version-*"))) == 2
    assert [p.name for p in (path / "delta" / "stream=a").glob("batch_id=*")] == ["batch_id=1"]
    assert vacuum(spark, str(path)) == 1
    assert len(list(path.glob("version-*"))) == 1 and not list((path / "delta").glob("stream=*/batch_id=*"))
    left = load_index(spark, str(path))
    assert left.rows == left.points.count() == 7_000
    # rows that come later are merged and read as before
    delta_batch(added.select((F.col("pid") - 1_000_000).alias("pid"), *DIMS), path, "a", 2)
    assert load_index(spark, str(path)).rows == compact(spark, str(path)).rows == 8_000
    with pytest.raises(ValueError):
        vacuum(spark, str(path), keep=0)


def test_repeated_deliveries_write_no_rows_again(spark, index, tmp_path, monkeypatch):
    """Batches without a new row are merged without writing the index; new ones are looked for once and alone written."""
    import boxquery.operators.mutate as mutate
    import boxquery.sources.index as stored
    from boxquery.session import written
    from boxquery.sources.index import compact, vacuum

    path, labels = str(tmp_path / "ix"), []
    for module in (mutate, stored):
        monkeypatch.setattr(module, "written", lambda df, label, **kw: labels.append(label) or written(df, label, **kw))
    save_index(index, path)
    more = index.points.filter("pid % 5 = 0").select((-1 - F.col("pid")).alias("pid"), "x", "y", "z", "h")
    more.write.parquet(f"{path}/delta/stream=a/batch_id=0")
    assert load_index(spark, path).rows == index.rows + more.count()
    assert "changed" not in labels and labels.count("new-rows") == 1
    merged = compact(spark, path)
    labels.clear()
    more.unionByName(index.points.select(*more.columns)).write.parquet(f"{path}/delta/stream=b/batch_id=0")
    for again in (load_index(spark, path), compact(spark, path), load_index(spark, path)):
        assert again.rows == merged.rows and again.points.count() == merged.rows
    assert set(labels) == {"new-rows"}
    assert vacuum(spark, path) == 1 and load_index(spark, path).points.count() == merged.rows
    more.select((F.col("pid") - 10**15).alias("pid"), "x", "y", "z", "h").write.parquet(f"{path}/delta/stream=c/batch_id=0")
    assert compact(spark, path).rows == merged.rows + more.count()
