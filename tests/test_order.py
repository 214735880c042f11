import pytest
from pyspark.sql import functions as F

from boxquery.functions.hilbert import with_hilbert
from boxquery.operators.order import adaptive_tiles, hilbert_cluster, ordered, with_ordinal, with_partition

DIMS = ("x", "y", "z")


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_ordinals_do_not_depend_on_partitions(points, partitions):
    got = ordered(points.repartition(partitions), DIMS, partitions=partitions).collect()
    keys = sorted((r.h, r.pid) for r in got)
    assert {(r.h, r.pid): r.ordinal for r in got} == {k: i + 1 for i, k in enumerate(keys)}


def test_one_key_for_a_third_of_the_rows_is_spread(spark):
    rows = spark.range(30_000).select(
        F.col("id").alias("pid"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("h")
    )
    got = with_ordinal(rows, ["h", "pid"], partitions=12)
    assert got.orderBy("h", "pid").select("ordinal").toPandas().ordinal.tolist() == list(range(1, 30_001))
    sizes = rows.repartitionByRange(12, "h", "pid").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 6_000


def test_hilbert_layout_is_sorted(spark, points):
    rows = hilbert_cluster(points, DIMS).collect()
    assert [(r.h, r.pid) for r in rows] == sorted((r.h, r.pid) for r in rows)


def test_original_order(points):
    got = ordered(points, DIMS, cluster="none").orderBy("pid").collect()
    assert [r.ordinal for r in got] == list(range(1, len(got) + 1))


def test_unknown_order_raises(points):
    with pytest.raises(ValueError):
        ordered(points, DIMS, cluster="random")
    with pytest.raises(ValueError):
        ordered(points, DIMS, cluster="kmeans")


@pytest.mark.parametrize("n, p", [(10, 3), (9, 3), (2, 5), (7, 1)])
def test_partitions_cover_and_first_takes_the_rest(spark, n, p):
    rows = spark.range(1, n + 1).withColumnRenamed("id", "ordinal")
    parts = [r.part for r in with_partition(rows, p).orderBy("ordinal").collect()]
    size, rest = divmod(n, p)
    expected = [0] * (size + rest) + [i for i in range(1, p) for _ in range(size)]
    assert parts == expected


def brute_depths(keys, capacity, d, bits):
    out = []
    for h in keys:
        for depth in range(bits + 1):
            shift = d * (bits - depth)
            if depth == bits or sum((k >> shift) == (h >> shift) for k in keys) <= capacity:
                out.append(depth)
                break
    return out


@pytest.mark.parametrize("capacity, chunk", [(1, 5), (4, 7), (16, 16), (1000, 1000)])
def test_tiles_match_a_count_at_every_depth(spark, points, capacity, chunk):
    few = with_hilbert(points.orderBy("pid").limit(300), DIMS)
    rows = adaptive_tiles(with_ordinal(few, ["h", "pid"]), DIMS, capacity, chunk=chunk).orderBy("ordinal").collect()
    keys = [r.h for r in rows]
    assert [r.depth for r in rows] == brute_depths(keys, capacity, 3, 20)
    assert [r.tile for r in rows] == [r.h >> (3 * (20 - r.depth)) for r in rows]
    assert len(rows) == 300


def test_rows_with_one_key_stay_together(spark):
    same = spark.range(50).select(F.col("id").alias("pid"), *[F.lit(0.5).cast("float").alias(d) for d in DIMS])
    other = spark.range(50, 60).select(
        F.col("id").alias("pid"), *[(F.col("id") / 100).cast("float").alias(d) for d in DIMS]
    )
    rows = adaptive_tiles(ordered(same.unionByName(other), DIMS), DIMS, 8, chunk=20)
    sizes = {(r.depth, r.tile): r["count"] for r in rows.groupBy("depth", "tile").count().collect()}
    assert sum(sizes.values()) == 60
    # Row 50 lies at 0.5 as well and shares the key of the other fifty.
    assert sorted(n for n in sizes.values() if n > 8) == [51]
    assert max(k[0] for k in sizes) == 20


def test_partition_count_follows_the_rows(spark, points, monkeypatch):
    from boxquery import session

    assert session.partitions_for(points) is None
    monkeypatch.setattr(session, "ROWS_PER_PARTITION", 100)
    assert session.partitions_for(points) == 60
    got = with_ordinal(with_hilbert(points, DIMS), ["h", "pid"]).collect()
    assert sorted(r.ordinal for r in got) == list(range(1, 6001))
    rows = adaptive_tiles(ordered(points, DIMS), DIMS, 128)
    assert rows.count() == 6000 and rows.groupBy("depth", "tile").count().agg({"count": "max"}).first()[0] <= 128


def test_scratch_can_be_dropped(spark, points, monkeypatch, tmp_path):
    from boxquery import session

    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path))
    assert session.written(points, "copy").count() == 6000
    assert len(list(tmp_path.iterdir())) == 1
    session.drop_scratch(spark)
    assert list(tmp_path.iterdir()) == []
