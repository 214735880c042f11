import pytest
from pyspark.sql import functions as F

from boxquery import build_index, range_count, range_search
from boxquery.operators.grid import overlap_pairs
from boxquery.operators.report import pruning_report, run_report, search_report, selectivity
from boxquery.operators.runs import _merged, blocks_of_runs, merge_runs
from boxquery.plans.range_count import partitioned_count
from checks.fixtures import boxes64, flat_boxes, order_boxes, part_boxes, points3
from tests.brute import box_hits, overlapping

DIMS = ("x", "y", "z")
BOX = "qid long, lx float, ly float, lz float, hx float, hy float, hz float"
METHODS = ["broadcast", "grid", "blocks", "levels", "packed", "partitions", "ranges"]


@pytest.fixture(scope="module")
def boxes(spark, sf_dir):
    """Many small boxes, boxes with no hits, the whole space, a box without extent and one beyond it."""
    special = [
        (10_001, 0.0, 0.0, 0.0, 1.0, 0.001, 1.0),
        (10_002, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0),
        (10_003, 0.0, 0.5, 0.0, 1.0, 0.5, 1.0),
        (10_004, -5.0, -5.0, -5.0, 5.0, 5.0, 5.0),
        (10_005, 0.0, 0.2, 0.0, 0.001, 0.9, 1.0),
        (10_006, 2.0, 2.0, 2.0, 3.0, 3.0, 3.0),
    ]
    return part_boxes(spark, sf_dir).unionByName(spark.createDataFrame(special, BOX))


@pytest.fixture(scope="module")
def expected(points, boxes):
    return box_hits(points.collect(), boxes.collect(), DIMS)


def as_dict(counts):
    return {r.qid: r.hits for r in counts.collect()}


@pytest.mark.parametrize("method", METHODS)
def test_every_method_gives_the_same_counts(index, boxes, expected, method):
    assert as_dict(range_count(index, boxes, method=method)) == expected


@pytest.mark.parametrize("method", METHODS)
def test_plans_for_large_sides_give_the_same_counts(index, boxes, expected, few_rows, method):
    assert as_dict(range_count(index, boxes, method=method)) == expected


@pytest.mark.parametrize("method", METHODS)
def test_no_boxes(index, boxes, method):
    assert range_count(index, boxes.limit(0), method=method).count() == 0


@pytest.mark.parametrize("method", METHODS)
def test_no_rows(points, boxes, method):
    empty = build_index(points.limit(0), DIMS)
    assert set(as_dict(range_count(empty, boxes, method=method)).values()) == {0}


def test_touching_counts(spark):
    rows = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.25, 0.75)], "pid long, x float, y float")
    queries = spark.createDataFrame(
        [(1, 0.5, 0.5, 0.6, 0.6), (2, 0.0, 0.0, 0.5, 0.5), (3, 0.25, 0.75, 0.25, 0.75), (4, 0.51, 0.5, 0.6, 0.6)],
        "qid long, lx float, ly float, hx float, hy float",
    )
    for method in METHODS:
        assert as_dict(range_count(build_index(rows, ("x", "y")), queries, method=method)) == {1: 1, 2: 1, 3: 1, 4: 0}


def test_all_rows_equal(spark, boxes):
    rows = spark.range(1_000).select(F.col("id").alias("pid"), *[F.lit(0.5).cast("float").alias(d) for d in DIMS])
    index = build_index(rows, DIMS)
    want = {q.qid: 1_000 * all(q[f"l{d}"] <= 0.5 <= q[f"h{d}"] for d in DIMS) for q in boxes.collect()}
    for method in METHODS:
        assert as_dict(range_count(index, boxes, method=method)) == want


def test_boxes_as_rows(spark, sf_dir):
    rows, queries = order_boxes(spark, sf_dir), flat_boxes(spark, sf_dir)
    data = rows.collect()
    want = {q.qid: sum(overlapping(q, r, "ab") for r in data) for q in queries.collect()}
    index = build_index(rows, ("a", "b"))
    for method in METHODS:
        assert as_dict(range_count(index, queries, method=method)) == want


def test_unknown_methods_raise(index, points, boxes):
    with pytest.raises(ValueError):
        range_count(index, boxes, method="magic")
    with pytest.raises(ValueError):
        range_count(points, boxes, DIMS, "blocks")
    with pytest.raises(ValueError):
        range_count(points, boxes)


def test_search_agrees_with_count(index, points, boxes, expected):
    for data in (index, points):
        found = range_search(data, boxes, DIMS)
        assert found.count() == found.distinct().count() == sum(expected.values())
        assert {r.qid: r["count"] for r in found.groupBy("qid").count().collect()} == {
            q: n for q, n in expected.items() if n
        }


def test_search_plans_for_large_sides(index, points, boxes, expected, few_rows):
    for data in (index, points):
        found = range_search(data, boxes, DIMS)
        assert found.distinct().count() == found.count() == sum(expected.values())


def test_first_k_are_the_lowest_ordinals(index, boxes):
    place = {r.pid: r.ordinal for r in index.points.select("pid", "ordinal").collect()}
    everything, first = {}, {}
    for r in range_search(index, boxes).collect():
        everything.setdefault(r.qid, []).append(place[r.pid])
    for r in range_search(index, boxes, limit_per_query=3).collect():
        first.setdefault(r.qid, []).append(place[r.pid])
    assert {q: sorted(v) for q, v in first.items()} == {q: sorted(v)[:3] for q, v in everything.items()}


def test_partition_counts_add_up(index, boxes, expected):
    parts = partitioned_count(index, boxes, 5)
    assert {r.part for r in parts.select("part").distinct().collect()} == set(range(5))
    got = {r.qid: r.hits for r in parts.groupBy("qid").agg(F.sum("hits").alias("hits")).collect()}
    assert {q: n for q, n in got.items() if n} == {q: n for q, n in expected.items() if n}


@pytest.mark.parametrize("gap", [0, 1, 3])
def test_runs_in_chunks_match_runs_in_one_window(spark, gap):
    pairs = spark.range(400).select((F.col("id") % 3).alias("qid"), ((F.col("id") * F.col("id")) % 211).alias("block")).distinct()
    pairs = pairs.unionByName(spark.range(100).select(F.lit(9).cast("long").alias("qid"), F.col("id").alias("block")))
    plain = sorted(tuple(r) for r in _merged(pairs, gap).select("qid", "first_block", "last_block", "blocks").collect())
    for chunk in (1, 4, 10, 1000):
        merged = merge_runs(pairs, gap, chunk).select("qid", "first_block", "last_block", "blocks")
        assert sorted(tuple(r) for r in merged.collect()) == plain


def test_long_runs_unfold(spark):
    ranges = spark.createDataFrame([(1, 3, 40), (2, 5, 5)], "qid long, first_block long, last_block long")
    got = sorted(tuple(r) for r in blocks_of_runs(ranges, chunk=7).collect())
    assert got == [(1, b) for b in range(3, 41)] + [(2, 5)]


@pytest.mark.parametrize("large", [False, True])
def test_overlap_pairs_report_each_pair_once(spark, sf_dir, large, request):
    if large:
        request.getfixturevalue("few_rows")
    rows = order_boxes(spark, sf_dir).orderBy("pid").limit(200)
    wide = spark.createDataFrame(
        [(9001, 0.0, 0.0, 1.0, 1.0), (9002, 0.0, 0.4, 1.0, 0.41), (9003, 0.5, 0.5, 0.5, 0.5)],
        "pid long, la float, lb float, ha float, hb float",
    )
    both = rows.unionByName(wide)
    data = both.collect()
    want = sorted((a.pid, b.pid) for a in data for b in data if overlapping(a, b, "ab"))
    pairs = overlap_pairs(both, both, ("a", "b"), ["pid"], ["pid"])
    assert sorted((r.a_pid, r.b_pid) for r in pairs.collect()) == want


def test_reports(spark, index):
    boxes = boxes64(spark)
    report = pruning_report(index, boxes).collect()
    assert sum(r.hits for r in report) == 742
    assert sum(r.candidate_blocks for r in report) == 184
    assert sum(r.candidate_rows for r in report) == 35_184
    total = search_report(pruning_report(index, boxes)).first()
    assert (total.queries, total.hits, total.hits_per_query, total.blocks_per_query) == (64, 742, 742 / 64, 184 / 64)
    from boxquery.operators.runs import scan_ranges

    runs = run_report(scan_ranges(index, boxes)).collect()
    assert sum(r.runs for r in runs) == 98 and sum(r.blocks for r in runs) == 184


def test_selectivity_buckets(spark):
    counts = spark.createDataFrame([(1, 0), (2, 1), (3, 10), (4, 10_000)], "qid long, hits long")
    got = {r.qid: (r.selectivity, r.bucket_percent) for r in selectivity(counts, 10_000).collect()}
    assert got == {1: (0.0, 0.0), 2: (0.0001, 0.01), 3: (0.001, 0.1), 4: (1.0, 100.0)}


@pytest.mark.parametrize("method", METHODS)
def test_a_third_of_all_rows_in_one_place(spark, points, boxes, few_rows, method):
    """Hot cells and blocks are split in the plans for large sides; no row is lost or counted twice."""
    hot = spark.range(3_000).select(
        (-1 - F.col("id")).alias("pid"), *[F.lit(0.3).cast("float").alias(d) for d in DIMS]
    )
    rows = points.unionByName(hot)
    few = boxes.filter("qid % 4 = 0 OR qid > 10000")
    want = box_hits(rows.collect(), few.collect(), DIMS)
    assert as_dict(range_count(build_index(rows, DIMS), few, method=method)) == want


def test_turned_boxes_are_an_error(spark, points, index):
    turned = boxes64(spark).withColumn("hx", F.when(F.col("qid") == 7, F.col("lx") - 0.5).otherwise(F.col("hx")))
    for ask in (
        lambda: range_count(points, turned, ("x", "y", "z"), "grid"),
        lambda: range_count(points, turned, ("x", "y", "z"), "broadcast"),
        lambda: range_count(index, turned),
        lambda: range_search(index, turned),
    ):
        with pytest.raises(ValueError, match="box 7"):
            ask()


def test_a_named_method_is_the_one_that_runs(spark, points, monkeypatch):
    import boxquery.plans.range_count as counting

    monkeypatch.setattr(counting, "NESTED_LOOP_BOXES", 4)
    monkeypatch.setattr(counting, "_count_grid", lambda *args, **kwargs: pytest.fail("the grid took over"))
    assert range_count(points, boxes64(spark), ("x", "y", "z"), "broadcast").count() == 64


@pytest.mark.parametrize("row_id", ["i", None])
def test_skew_join_splits_keys_hot_on_either_side(spark, row_id):
    from boxquery.session import skew_join

    big = spark.range(4_000).selectExpr("CAST(CASE WHEN id < 2500 THEN 0 ELSE id % 90 END AS INT) AS k", "CAST(id / 2 AS INT) AS i" if row_id is None else "id AS i")
    small = spark.range(300).selectExpr("CAST(CASE WHEN id < 120 THEN id % 2 ELSE id END AS INT) AS k", "CAST(id % 3 AS INT) AS j")
    got = skew_join(big, small, ["k"], row_id, 4_000, min_rows=50)
    want = big.join(small, "k")
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).isEmpty()


@pytest.mark.parametrize("row_id", ["i", None])
def test_skew_join_without_hot_keys_repeats_nothing(spark, row_id):
    from boxquery.session import skew_join

    big, small = spark.range(400).selectExpr("id % 90 AS k", "id AS i"), spark.range(300).selectExpr("id % 70 AS k", "id AS j")
    got = skew_join(big, small, ["k"], row_id, 400, min_rows=50)
    want = big.join(small, "k")
    assert got.columns == want.columns and got.count() == want.count() and got.exceptAll(want).isEmpty()
    assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("flat_blocks", [None, 3])
def test_first_k_stops_where_enough_is_certain(spark, sf_dir, flat_blocks):
    """Boxes over most of the data: whole blocks end the search, and the first rows stay the same."""
    index = build_index(points3(spark, sf_dir), ("x", "y", "z"), degree=8)
    wide = spark.sql("SELECT 1L AS qid, 0f AS lx, 0f AS ly, 0f AS lz, 1f AS hx, 1f AS hy, 1f AS hz UNION ALL SELECT 2L, 0.2f, 0.2f, 0f, 0.9f, 0.9f, 1f")
    got = range_search(index, wide, limit_per_query=5, flat_blocks=flat_blocks)
    everything = range_search(index, wide).join(index.points.select("pid", "ordinal"), "pid")
    want = {q: [] for q in (1, 2)}
    for r in everything.orderBy("ordinal").collect():
        if len(want[r.qid]) < 5:
            want[r.qid].append(r.pid)
    assert {(r.qid, r.pid) for r in got.collect()} == {(q, p) for q, ps in want.items() for p in ps}


@pytest.mark.parametrize("options", [{}, {"first_blocks": 1}, {"first_blocks": 3, "broadcast_rows": 0}])
@pytest.mark.parametrize("k", [1, 200, 1000])
def test_first_k_of_any_size_reads_few_blocks(spark, sf_dir, monkeypatch, options, k):
    import boxquery.plans.range_search as searching

    index = build_index(points3(spark, sf_dir), ("x", "y", "z"), degree=8)
    wide = spark.sql(
        "SELECT 1L AS qid, 0f AS lx, 0f AS ly, 0f AS lz, 1f AS hx, 1f AS hy, 1f AS hz"
        " UNION ALL SELECT 2L, 0.2f, 0.2f, 0f, 0.9f, 0.9f, 1f UNION ALL SELECT 3L, 0.5f, 0f, 0f, 0.501f, 1f, 1f"
        " UNION ALL SELECT 4L, 2f, 2f, 2f, 3f, 3f, 3f"
    )
    read, real = [], searching.join_rows

    def counting(index, wanted, *rest):
        read.extend(r.block for r in wanted.filter("qid = 1").select("block").collect())
        return real(index, wanted, *rest)

    monkeypatch.setattr(searching, "join_rows", counting)
    got = {(r.qid, r.pid) for r in range_search(index, wide, limit_per_query=k, **options).collect()}
    rows = range_search(index.points, wide, index.dims, order_col="ordinal", limit_per_query=k)
    assert got == {(r.qid, r.pid) for r in rows.collect()}
    assert 0 < len(read) <= 8 * (-(-k // 8) + 1) if options else len(read) == -(-k // 8)
    assert len(read) == len(set(read))


def test_windows_of_the_early_stop_hold_a_segment_at_most(spark):
    from boxquery.plans.range_search import enough_blocks

    rows = spark.range(100).selectExpr("id % 2 AS qid", "id div 2 AS block", "id div 20 AS segment", "id % 3 != 0 AS inside", "10L AS n")
    got = {(r.qid, r.block) for r in enough_blocks(rows, 95).collect()}
    for qid in (0, 1):
        total, want = 0, set()
        for r in sorted((r for r in rows.collect() if r.qid == qid), key=lambda r: r.block):
            if total < 95:
                want.add(r.block)
            total += 10 * r.inside
        assert {b for q, b in got if q == qid} == want
