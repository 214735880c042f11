"""How many rows one task sorts when a stored index is changed."""

import pytest
from pyspark.sql import functions as F

from boxquery import build_index, range_count
from boxquery.operators import mutate
from boxquery.sources import changes
from checks.fixtures import DIMS, boxes64, events3


def test_parts_do_not_share_a_few_shuffle_partitions(spark, index, tmp_path):
    """With many more parts than shuffle partitions, no task sorts the rows of many parts."""
    changes.save_changing(index, str(tmp_path / "ix"))
    store = changes._latest(spark, str(tmp_path / "ix"))
    rows = index.points.drop(*mutate.PLACE_COLUMNS, *[c for c in ("_part",) if c in index.points.columns])
    parts = F.expr(f"CAST(conv(substr(md5(CAST(pid AS STRING)), 1, 4), 16, 10) AS BIGINT) % {len(store.parts)}")
    rows = rows.withColumn("_at", parts)
    sizes = {r["_at"]: r["count"] for r in rows.groupBy("_at").count().collect()}
    numbered = changes._numbered(store, rows, ["h", "pid"], sizes, index.rows)
    tasks = numbered.groupBy(F.spark_partition_id().alias("task")).count()
    assert tasks.agg(F.max("count")).first()[0] <= 4 * max(sizes.values())
    assert numbered.count() == index.rows


@pytest.mark.parametrize("most", (50, 4_000_000))
def test_large_ranges_are_cut(spark, sf_dir, points, index, tmp_path, monkeypatch, most):
    """Ranges beyond what one task should sort are numbered by a range shuffle, with the same result."""
    for module in (mutate, changes):
        monkeypatch.setattr(module, "ROWS_PER_PARTITION", most)
    added = events3(spark, sf_dir)
    changes.save_changing(index, str(tmp_path / "ix"))
    inserted = changes.insert_rows(spark, str(tmp_path / "ix"), added)
    everything = points.unionByName(added)
    wanted = sorted(map(tuple, range_count(everything, boxes64(spark), DIMS, "broadcast").collect()))
    places = sorted(map(tuple, build_index(everything, DIMS).points.select("pid", "ordinal").collect()))
    for changed in (inserted, mutate.insert(index, added)):
        assert sorted(map(tuple, range_count(changed, boxes64(spark)).collect())) == wanted
        assert sorted(map(tuple, changed.points.select("pid", "ordinal").collect())) == places
