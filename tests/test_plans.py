"""The physical plans: what is scanned, what is shuffled, what runs in Python."""

import re

import pytest
from pyspark.sql import functions as F

import boxquery.plans.candidates as candidates
from boxquery import range_count, range_search
from boxquery.functions.hilbert import with_hilbert
from boxquery.operators.blocks import block_summary, build_levels
from boxquery.operators.order import adaptive_tiles
from boxquery.sources.index import load_index, save_index
from boxquery.session import written
from checks.fixtures import boxes64, part_boxes, points3

DIMS = ("x", "y", "z")


def plan(df):
    df.collect()
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    return text.split("== Initial Plan ==")[0] + text[text.index("\n\n(1)"):]


def shuffles(text):
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange \(", text.split("\n\n(1)")[0]))


@pytest.fixture(scope="module")
def saved(spark, index, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "ix")
    save_index(index, path)
    return load_index(spark, path)


def test_keys_stay_in_the_jvm(spark, sf_dir):
    text = plan(with_hilbert(points3(spark, sf_dir), DIMS).agg(F.max("h")))
    assert "Python" not in text and "* HashAggregate" in text


def test_plain_count_scans_in_place(spark, sf_dir):
    text = plan(range_count(points3(spark, sf_dir), boxes64(spark), DIMS, "broadcast"))
    assert "BroadcastNestedLoopJoin" in text and "SortMergeJoin" not in text and "CartesianProduct" not in text
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double>" in text
    assert shuffles(text) == 1


def test_block_count_neither_shuffles_rows_nor_reads_ids(spark, saved):
    text = plan(range_count(saved, boxes64(spark), method="blocks"))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert re.search(r"ReadSchema: struct<x:float,y:float,z:float,block:bigint>", text)
    assert shuffles(text) == 1


def test_only_wanted_segments_are_read(spark, saved, monkeypatch):
    monkeypatch.setattr(candidates, "FEW_SEGMENTS", 1)
    one = boxes64(spark).filter("qid = 3")
    text = plan(range_count(saved, one, method="blocks"))
    assert re.search(r"PartitionFilters: \[.*segment#\d+L? (IN|=) ", text)


def test_ranges_reach_the_scan(spark, saved):
    one = boxes64(spark).filter("qid = 3")
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ordinal,", plan(range_count(saved, one, method="ranges")))


def test_search_reads_what_it_returns(spark, saved):
    assert "ReadSchema: struct<pid:bigint,x:float,y:float,z:float,block:bigint>" in plan(
        range_search(saved, boxes64(spark))
    )


def test_first_k_is_cut_before_the_shuffle(spark, saved):
    assert "WindowGroupLimit" in plan(range_search(saved, boxes64(spark), limit_per_query=3))


def test_pyramid_is_one_shuffle(saved):
    levels = build_levels(saved.blocks, DIMS, n_blocks=saved.n_blocks)
    assert shuffles(plan(levels)) == 1
    assert shuffles(plan(block_summary(saved.points, DIMS))) == 1


def test_tiles_are_one_shuffle(saved):
    text = plan(adaptive_tiles(saved.points, DIMS))
    assert shuffles(text) == 1 and "Join" not in text


def test_changes_do_not_sort_stored_rows_anew(spark, saved, monkeypatch):
    """Neither an insert nor a delete range-partitions the rows of the index."""
    import boxquery.operators.mutate as mutate

    def refuse(*args, **kwargs):
        raise AssertionError("the order is built anew")

    monkeypatch.setattr(mutate, "with_ordinal", refuse)
    added = spark.sql("SELECT -5L AS pid, 0.25f AS x, 0.5f AS y, 0.75f AS z")
    bigger = mutate.insert(saved, added)
    asked = added.select(F.lit(1).alias("request"), "pid", *[F.lit(v).alias(n) for n, v in zip(("lx", "ly", "lz", "hx", "hy", "hz"), (0.0, 0.0, 0.0, 1.0, 1.0, 1.0))])
    back, _ = mutate.remove(bigger, asked)
    assert (bigger.rows, back.rows) == (saved.rows + 1, saved.rows)
    assert "rangepartitioning" not in plan(back.points.agg(F.max("ordinal")))


def test_one_large_box_does_not_compare_everything(spark, monkeypatch):
    """20,000 small boxes and one over everything: pairs that meet in a cell stay a few times the rows."""
    import boxquery.operators.grid as grid

    small = spark.range(20_000).selectExpr("id AS pid", "(id * 7919 % 20011) / 20011D AS la", "(id * 104729 % 20021) / 20021D AS lb").selectExpr("pid", "la", "lb", "la + 0.0005D AS ha", "lb + 0.0005D AS hb")
    boxes = small.unionByName(spark.sql("SELECT -1L AS pid, 0D AS la, 0D AS lb, 1D AS ha, 1D AS hb"))
    compared = []
    meeting = grid._meeting

    def counted(*args):
        pairs = meeting(*args)
        compared.append(pairs.count())
        return pairs

    monkeypatch.setattr(grid, "_meeting", counted)
    found = grid.overlap_pairs(boxes, boxes, ("a", "b"), ["pid"], ["pid"])
    assert found.count() >= 60_001
    assert sum(compared) < 20 * 20_001


def test_descent_goes_down_several_levels(spark, sf_dir, monkeypatch):
    """Only children of nodes that a box touches are tested."""
    from boxquery import build_index

    index, tested = build_index(points3(spark, sf_dir), DIMS, degree=8), []
    settled = candidates._settled

    def counted(found, most):
        tested.append(found.count())
        return settled(found, most)

    monkeypatch.setattr(candidates, "_settled", counted)
    range_count(index, boxes64(spark).filter("qid < 4"), method="levels").collect()
    assert len(tested) >= 4 and tested[0] <= 4 and max(tested) < 4 * index.n_blocks / 3


def test_seeds_are_cut_before_they_are_sorted(spark, sf_dir, monkeypatch):
    import boxquery.operators.kmeans as kmeans

    seeds = kmeans.pick_seeds(points3(spark, sf_dir), DIMS, 50)
    text = plan(seeds)
    assert re.search(r"Filter.*\n(.*\n)*.*xxhash64", text) and "TakeOrderedAndProject" in text
    assert seeds.count() == 50


@pytest.mark.parametrize("method", ["grid", "blocks", "levels", "packed", "search", "delete"])
def test_large_plans_copy_no_stored_rows(spark, index, few_rows, monkeypatch, method):
    """Beyond all broadcast bounds the join that splits hot keys takes rows by their own identity."""
    import boxquery.operators.mutate as mutate
    import boxquery.session as session
    from boxquery.functions.boxes import bound_names

    copied, real = [], session.written
    monkeypatch.setattr(session, "written", lambda df, label, keep=False: copied.append(label) or real(df, label, keep))
    boxes = boxes64(spark)
    if method == "delete":
        monkeypatch.setattr(mutate, "BROADCAST_ROWS", 4)
        whole = [F.lit(v).alias(n) for n, v in zip(bound_names(DIMS), (0.0, 0.0, 0.0, 1.0, 0.5, 1.0))]
        asked = index.points.filter("pid % 3 = 0").select(F.col("pid").alias("request"), "pid", *whole)
        got = {r.request for r in mutate.match_deletes(index, asked).collect()}
        assert got == {r.pid for r in index.points.filter("pid % 3 = 0 AND y <= 0.5").collect()}
    elif method == "search":
        pairs = {(r.qid, r.pid) for r in range_search(index, boxes).collect()}
        hits = {r.qid: r.hits for r in range_count(index.points, boxes, DIMS, "broadcast").collect()}
        assert {q: sum(1 for a, _ in pairs if a == q) for q in hits} == hits
    else:
        data = index.points if method == "grid" else index
        got = {r.qid: r.hits for r in range_count(data, boxes, DIMS if method == "grid" else None, method).collect()}
        assert got == {r.qid: r.hits for r in range_count(index.points, boxes, DIMS, "broadcast").collect()}
    assert "hot-keys" in copied and not {"skew-small", "skew-big"} & set(copied)


@pytest.fixture(scope="module")
def bucketed(spark, index, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("buckets") / "ix")
    save_index(index, path, buckets=8)
    return load_index(spark, path)


def scanned_in_place(text):
    """Whether stored points are read and reach their join without a shuffle."""
    tree = text.split("\n\n(1)")[0].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    for at, line in enumerate(tree):
        if re.search(r"Scan parquet spark_catalog.*boxquery_", line):
            above, level = [], depth(line)
            for other in reversed(tree[:at]):
                if depth(other) < level:
                    above.append(other)
                    level = depth(other)
            joined = next(i for i, a in enumerate(above) if "Join" in a)
            assert not any(re.search("(?<!Broadcast)Exchange", a) for a in above[:joined]), line
    return any("boxquery_" in line for line in tree)


@pytest.mark.parametrize("method", ["blocks", "levels", "packed"])
def test_buckets_meet_many_boxes_without_a_shuffle_of_points(spark, sf_dir, bucketed, monkeypatch, method):
    boxes = part_boxes(spark, sf_dir)
    want = {(r.qid, r.hits) for r in range_count(bucketed, boxes, method="broadcast").collect()}
    stored = []
    monkeypatch.setattr(candidates, "written", lambda df, label, **kw: stored.append(df.columns) or written(df, label, **kw))
    counted = range_count(bucketed, boxes, method=method, broadcast_rows=0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(counted)
        assert {(r.qid, r.hits) for r in counted.collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert scanned_in_place(text) and "SortMergeJoin" in text
    assert not any("x" in columns for columns in stored)


def test_blocks_that_very_many_boxes_want_are_broadcast(spark, sf_dir, bucketed, monkeypatch):
    monkeypatch.setattr(candidates, "HOT_MIN_ROWS", 5)
    boxes = part_boxes(spark, sf_dir)
    counted = range_count(bucketed, boxes, method="blocks", broadcast_rows=0)
    text = plan(counted)
    assert "BroadcastHashJoin" in text and "Union" in text and scanned_in_place(text)
    want = {(r.qid, r.hits) for r in range_count(bucketed, boxes, method="broadcast").collect()}
    assert {(r.qid, r.hits) for r in counted.collect()} == want


def test_buckets_are_known_to_a_new_session(spark, index, tmp_path):
    path = str(tmp_path / "ix")
    save_index(index, path, buckets=4)
    other = spark.newSession()
    for row in spark.catalog.listTables():
        if row.name.startswith("boxquery_") and row.tableType == "EXTERNAL":
            spark.sql(f"DROP TABLE {row.name}")
    again = load_index(other, path)
    columns = ["pid", "ordinal", "segment", "block"]
    assert again.points.select(*columns).exceptAll(other.createDataFrame(index.points.select(*columns).toPandas())).count() == 0
    assert again.points.count() == index.rows
