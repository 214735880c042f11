import os

import pytest

from boxquery.sources.index import load_index, save_index
from boxquery.streaming.insert import compacted, insert_stream
from checks.fixtures import DIMS, event_stream, events3, table


@pytest.mark.parametrize("layout", ["file", "folder", "partitions"])
def test_events_stream_from_any_layout_of_the_tables(spark, sf_dir, tmp_path, layout):
    """Neither the layout of events nor that of the tables beside it hides rows or ends the stream with an error."""
    for name in ("events", "customer", "lineitem"):
        target = f"{tmp_path}/{name}.parquet"
        if layout == "file" and name != "lineitem":
            os.symlink(f"{sf_dir}/{name}.parquet", target)
            continue
        rows = table(spark, sf_dir, name).limit(100_000).repartition(3)
        if layout == "folder":
            rows.write.parquet(target)
            continue
        for copy in range(2):
            key = {"events": "event_id", "customer": "c_custkey", "lineitem": "l_orderkey"}[name]
            rows.filter(f"{key} % 2 = {copy}").write.parquet(f"{target}/copy={copy}")
    found = []
    stream = events3(spark, str(tmp_path), event_stream(spark, str(tmp_path)))
    keep = lambda batch, _: found.extend(tuple(r) for r in batch.collect())
    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/progress")
    query.trigger(availableNow=True).start().awaitTermination()
    assert sorted(found) == sorted(tuple(r) for r in events3(spark, sf_dir).collect())


def test_stream_beside_partitioned_tables_reaches_the_index(spark, sf_dir, tmp_path, index):
    os.symlink(f"{sf_dir}/events.parquet", f"{tmp_path}/events.parquet")
    os.symlink(f"{sf_dir}/customer.parquet", f"{tmp_path}/customer.parquet")
    table(spark, sf_dir, "lineitem").write.parquet(f"{tmp_path}/lineitem.parquet/copy=0")
    path = f"{tmp_path}/index"
    save_index(index, path)
    stream = events3(spark, str(tmp_path), event_stream(spark, str(tmp_path)))
    insert_stream(stream, path, DIMS, f"{tmp_path}/progress").awaitTermination()
    bigger = compacted(load_index(spark, path), path)
    assert bigger.points.count() == index.rows + table(spark, sf_dir, "events").count()


def test_rows_merged_on_opening_are_not_merged_again(spark, sf_dir, tmp_path, index, monkeypatch):
    """A compaction stores what was opened; with other files beside the index it merges anew."""
    import boxquery.sources.index as stored

    path, merges, merge = f"{tmp_path}/index", [], stored._with_new
    save_index(index, path)
    events = events3(spark, sf_dir, event_stream(spark, sf_dir))
    for part in range(2):
        insert_stream(events.filter(f"pid % 2 = {-part}"), path, DIMS, f"{tmp_path}/progress-{part}").awaitTermination()
        opened = load_index(spark, path)
        if part:  # another stream comes between opening and compaction
            insert_stream(events, path, DIMS, f"{tmp_path}/progress-{part}-late").awaitTermination()
        monkeypatch.setattr(stored, "_with_new", lambda *a: merges.append(1) or merge(*a))
        merged = compacted(opened, path)
        monkeypatch.setattr(stored, "_with_new", merge)
        assert len(merges) == part and stored.delta_rows(spark, path) is None
    assert merged.rows == index.rows + table(spark, sf_dir, "events").count() == merged.points.select("pid").distinct().count()
    assert merged.points.agg({"ordinal": "max"}).first()[0] == merged.rows


def test_repeated_rows_are_looked_for_once(spark, sf_dir, tmp_path, index, monkeypatch):
    """Rows delivered again bring nothing new; what opening has found out is not looked for again by the compaction."""
    import boxquery.sources.index as stored

    path, looked, look = f"{tmp_path}/index", [], stored.new_rows
    save_index(index, path)
    events = events3(spark, sf_dir, event_stream(spark, sf_dir))
    for turn in range(2):
        insert_stream(events, path, DIMS, f"{tmp_path}/progress-{turn}").awaitTermination()
        opened = load_index(spark, path)
        monkeypatch.setattr(stored, "new_rows", lambda *a: looked.append(1) or look(*a))
        merged = compacted(opened, path)
        monkeypatch.setattr(stored, "new_rows", look)
        assert not looked and stored.delta_rows(spark, path) is None
        assert merged.rows == merged.points.count() == index.rows + table(spark, sf_dir, "events").count()
    assert len(stored.folders(spark, f"{path}/version-*")) == 1
