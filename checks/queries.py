"""Every operator as a query over the given tables, next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from boxquery import BoxIndex, range_count, range_search
from boxquery.functions.boxes import bound_names, box, dist2, enlargement, sphere_volume, union, volume
from boxquery.functions.hilbert import with_hilbert
from boxquery.operators import blocks as blocks_
from boxquery.operators import kmeans as kmeans_
from boxquery.operators import mutate, order, report, runs, tiles
from boxquery.operators.grid import overlap_pairs
from boxquery.operators.index import build_index
from boxquery.plans.range_count import partitioned_count
from boxquery.session import scratch_path, scratch_root
from boxquery.sources import binary
from boxquery.sources.changes import insert_rows, remove_rows, save_changing, tidy, vacuum_changing
from boxquery.sources.index import load_index, open_index, save_index, vacuum
from boxquery.sources.normalise import normalise, to_boxes
from boxquery.sources.uniform import uniform_points
from boxquery.streaming.insert import compacted, insert_stream
from checks import oracle as o
from checks.fixtures import DIMS, boxes64, event_stream, events3, flat_boxes, order_boxes, part_boxes, points3, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

PLANE = ("a", "b")
CLUSTERS = 16
CAPACITY = 128
PARTITIONS = 7


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query

    return add


def point_index(spark: SparkSession, sf_dir: str) -> BoxIndex:
    """Index over points3, saved once per application and opened again by later queries."""
    path = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/points3{sf_dir.replace('/', '-')}"
    return open_index(points3(spark, sf_dir), path, DIMS, source=f"{sf_dir}/lineitem")


def order_index(spark: SparkSession, sf_dir: str) -> BoxIndex:
    """Index over order_boxes."""
    path = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/orders{sf_dir.replace('/', '-')}"
    return open_index(order_boxes(spark, sf_dir), path, PLANE, source=f"{sf_dir}/orders")


def bucketed_index(spark: SparkSession, sf_dir: str) -> BoxIndex:
    """The index over points3 with its points stored as buckets of whole blocks."""
    path = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/buckets{sf_dir.replace('/', '-')}"
    source = f"{sf_dir}/lineitem"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return open_index(points3(spark, sf_dir), path, DIMS, source=source, buckets=buckets)


def long(name: str) -> F.Column:
    return F.col(name).cast("long").alias(name)


def rounded(name: str, digits: int = 6) -> F.Column:
    return F.round(name, digits).alias(name)


# Sources and sinks


@register(
    "s1_read_points",
    o.query([o.POINTS], "SELECT row_number() OVER (ORDER BY pid) AS pid, x, y, z FROM p"),
)
def _(spark, sf_dir):
    path = scratch_path(spark, "points-file")
    binary.write_points(points3(spark, sf_dir).repartitionByRange("pid").sortWithinPartitions("pid"), path, DIMS)
    return binary.read_points(spark, path, DIMS)


@register(
    "s2_read_boxes",
    o.query([o.PART_BOXES], "SELECT row_number() OVER (ORDER BY qid) AS qid, lx, ly, lz, hx, hy, hz FROM b"),
)
def _(spark, sf_dir):
    path = scratch_path(spark, "boxes-file")
    binary.write_boxes(part_boxes(spark, sf_dir).repartitionByRange("qid").sortWithinPartitions("qid"), path, DIMS)
    return binary.read_boxes(spark, path, DIMS)


@register(
    "s3_uniform_points",
    "SELECT count(*) AS points, count(*) AS in_range, count(*) AS numbers, min(1) AS first_number, count(*) AS last_number,"
    " CAST(round(0.5e0, 1) AS DOUBLE) AS mean FROM lineitem",
)
def _(spark, sf_dir):
    """As many points as lineitem has rows, from two calls: the second starts where the first one ends."""
    n = table(spark, sf_dir, "lineitem").count()
    half = n // 2
    made = uniform_points(spark, half, DIMS).unionByName(uniform_points(spark, n - half, DIMS, offset=half))
    valid = " AND ".join(f"{d} > 0 AND {d} <= 1" for d in DIMS)
    return made.agg(
        F.count(F.lit(1)).alias("points"),
        F.sum(F.expr(f"CAST({valid} AS BIGINT)")).alias("in_range"),
        F.count_distinct("pid").alias("numbers"),
        F.min("pid").cast("int").alias("first_number"),
        F.max("pid").alias("last_number"),
        F.round(F.avg("x"), 1).alias("mean"),
    )


@register("s4_save_index", o.query(o.BLOCKED, "SELECT block, lx, ly, lz, hx, hy, hz, n, last_ordinal FROM blk"))
def _(spark, sf_dir):
    path = scratch_path(spark, "saved")
    save_index(build_index(points3(spark, sf_dir), DIMS), path)
    return load_index(spark, path).blocks.select("block", *bound_names(DIMS), "n", "last_ordinal")


@register("s5_open_index", o.query(o.ORDERED, "SELECT pid, x, y, z, h, ordinal FROM o"))
def _(spark, sf_dir):
    point_index(spark, sf_dir)
    return point_index(spark, sf_dir).points.select("pid", *DIMS, "h", "ordinal")


@register(
    "s6_write_points",
    o.query(
        [o.POINTS],
        "SELECT CAST(count(*) AS BIGINT) AS records, CAST(sum(trunc(CAST(1000000 AS FLOAT) * x)) AS BIGINT) AS sx,"
        " CAST(sum(trunc(CAST(1000000 AS FLOAT) * y)) AS BIGINT) AS sy,"
        " CAST(sum(trunc(CAST(1000000 AS FLOAT) * z)) AS BIGINT) AS sz FROM p",
    ),
)
def _(spark, sf_dir):
    path = scratch_path(spark, "export")
    binary.write_points(points3(spark, sf_dir), path, DIMS)
    back = binary.read_points(spark, path, DIMS)
    return back.agg(
        F.count(F.lit(1)).alias("records"),
        *[F.sum((F.lit(1000000.0).cast("float") * F.col(d)).cast("long")).alias(f"s{d}") for d in DIMS],
    )


# Projections and box functions


@register(
    "p1_to_boxes",
    o.query(
        [o.POINTS],
        "SELECT row_number() OVER (ORDER BY pid) AS position, x AS lx, y AS ly, z AS lz, x AS hx, y AS hy, z AS hz FROM p",
    ),
)
def _(spark, sf_dir):
    return to_boxes(points3(spark, sf_dir), list(DIMS))


@register("p2_hilbert_key", o.query([o.POINTS, *o.hilbert("p", DIMS)], "SELECT pid, h FROM k"))
def _(spark, sf_dir):
    return with_hilbert(points3(spark, sf_dir), DIMS).select("pid", "h")


@register(
    "p2_hilbert_key_2d",
    o.query([o.ORDER_BOXES, *o.hilbert("ob", ("la", "lb"))], "SELECT pid, h FROM k"),
)
def _(spark, sf_dir):
    return order.with_box_hilbert(order_boxes(spark, sf_dir), PLANE).select("pid", "h")


_CELL = ", ".join(
    f"(min(trunc(CAST(1000000 AS FLOAT) * {d})::BIGINT >> (20 - depth)) << (20 - depth)) AS cl{d},"
    f" ((min(trunc(CAST(1000000 AS FLOAT) * {d})::BIGINT >> (20 - depth)) + 1) << (20 - depth)) - 1 AS ch{d}"
    for d in DIMS
)


@register(
    "p3_tile_bounds",
    o.query(
        [*o.ORDERED, *o.tiles(CAPACITY)],
        f"SELECT CAST(depth AS BIGINT) AS depth, tile, {_CELL} FROM t GROUP BY depth, tile",
    ),
)
def _(spark, sf_dir):
    found = order.adaptive_tiles(point_index(spark, sf_dir).points, DIMS, CAPACITY).select("depth", "tile").distinct()
    bounds = tiles.tile_bounds(found, DIMS)
    return bounds.select(long("depth"), "tile", *[long(f"c{n}") for n in bound_names(DIMS)])


def _snapped(source: str, key: str) -> str:
    """SQL, the same for both engines: boxes moved onto a coarse grid, so that many only touch."""
    low = ", ".join(f"CAST(floor(CAST(l{d} AS DOUBLE) * 16) / 16 AS FLOAT) AS l{d}" for d in PLANE)
    return f"SELECT {key}, {low}, {', '.join(f'CAST(floor(CAST(l{d} AS DOUBLE) * 16) / 16 + 0.0625 AS FLOAT) AS h{d}' for d in PLANE)} FROM {source}"


@register(
    "p4_overlap",
    o.query(
        [o.FLAT_BOXES, o.ORDER_BOXES, f"sb AS ({_snapped('b', 'qid')})", f"so AS ({_snapped('ob', 'pid')})"],
        f"SELECT sb.qid, count(so.pid) AS hits FROM sb LEFT JOIN so ON {o.meet('sb', 'so', PLANE)} GROUP BY sb.qid",
    ),
)
def _(spark, sf_dir):
    """Boxes against boxes, where shared edges and corners count."""
    asked = spark.sql(_snapped("{boxes}", "qid"), boxes=flat_boxes(spark, sf_dir)).alias("q")
    rows = spark.sql(_snapped("{boxes}", "pid"), boxes=order_boxes(spark, sf_dir)).alias("o")
    # equal boxes are counted once and weighted
    kinds = rows.groupBy(*bound_names(PLANE)).count().alias("o")
    pairs = overlap_pairs(asked, kinds, PLANE, ["qid"], ["count"])
    hits = pairs.groupBy(F.col("a_qid").alias("qid")).agg(F.sum("b_count").alias("hits"))
    return asked.select("qid").join(hits, "qid", "left").select("qid", F.coalesce("hits", F.lit(0)).alias("hits"))


def order_pairs(spark, sf_dir) -> DataFrame:
    """Each order's box `a` next to the box `t` of the block it is stored in."""
    index = order_index(spark, sf_dir)
    return index.points.alias("a").join(index.blocks.alias("t"), "block")


_A = (o.names("o", "l", PLANE), o.names("o", "h", PLANE))
_T = (o.names("blk", "l", PLANE), o.names("blk", "h", PLANE))
_JOINT = o.joint(*_A, *_T)


def _order_sql(columns: str) -> str:
    return o.query(o.ORDER_BLOCKED, f"SELECT o.pid, {columns} FROM o JOIN blk ON o.block = blk.block")


@register("p5_box_union", _order_sql(", ".join(f"{c} AS {n}" for c, n in zip([*_JOINT[0], *_JOINT[1]], bound_names(PLANE)))))
def _(spark, sf_dir):
    """Every order's box together with the box of the block that it is stored in."""
    both = union(box(PLANE, "a"), box(PLANE, "t"))
    return order_pairs(spark, sf_dir).select("pid", *[c.alias(n) for c, n in zip(both.lo + both.hi, bound_names(PLANE))])


@register("p6_box_volume", _order_sql(f"round({o.volume(*_T)}, 9) AS volume"))
def _(spark, sf_dir):
    return order_pairs(spark, sf_dir).select("pid", F.round(volume(box(PLANE, "t")), 9).alias("volume"))


@register("p7_sphere_volume", _order_sql(f"round({o.sphere(*_T)}, 9) AS sphere"))
def _(spark, sf_dir):
    return order_pairs(spark, sf_dir).select("pid", F.round(sphere_volume(box(PLANE, "t")), 9).alias("sphere"))


@register("p8_enlargement", _order_sql(f"round({o.sphere(*_JOINT)} - {o.sphere(*_A)}, 9) AS growth"))
def _(spark, sf_dir):
    growth = enlargement(box(PLANE, "a"), box(PLANE, "t"))
    return order_pairs(spark, sf_dir).select("pid", F.round(growth, 9).alias("growth"))


@register(
    "p9_squared_distance",
    _order_sql(
        "round(" + o.total([o.times([f"({o.dbl(x)} - {o.dbl(y)})"] * 2) for x, y in zip(_A[0], _T[0])]) + ", 9) AS dist2"
    ),
)
def _(spark, sf_dir):
    gap = dist2(box(PLANE, "a").lo, box(PLANE, "t").lo)
    return order_pairs(spark, sf_dir).select("pid", F.round(gap, 9).alias("dist2"))


@register(
    "p10_normalise",
    "SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,"
    " CAST((l_quantity - 1e0) / (50e0 - 1e0) AS FLOAT) AS l_quantity,"
    " CAST((l_extendedprice - 0e0) / (105000e0 - 0e0) AS FLOAT) AS l_extendedprice FROM lineitem",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", long("l_linenumber"), "l_quantity", "l_extendedprice"
    )
    return normalise(rows, {"l_quantity": (1, 50), "l_extendedprice": (0, 105000)})


# Order, ordinals and partitions


@register("o1_hilbert_cluster", o.query([o.POINTS, *o.hilbert("p", DIMS)], "SELECT pid, x, y, z, h FROM k"))
def _(spark, sf_dir):
    return order.hilbert_cluster(points3(spark, sf_dir), DIMS).select("pid", *DIMS, "h")


@register("o2_with_ordinal", o.query(o.ORDERED, "SELECT pid, h, ordinal FROM o"))
def _(spark, sf_dir):
    return order.ordered(points3(spark, sf_dir), DIMS).select("pid", "h", "ordinal")


@register("o3_original_order", o.query([o.POINTS, *o.ordinals("p", "pid")], "SELECT pid, ordinal FROM o"))
def _(spark, sf_dir):
    return order.ordered(points3(spark, sf_dir), DIMS, cluster="none").select("pid", "ordinal")


_KMEANS_ORDER = [
    o.POINTS,
    *o.rounds(1, CLUSTERS),
    *o.hilbert("c1", DIMS, "ck"),
    "r AS (SELECT cluster, row_number() OVER (ORDER BY h, cluster) AS crank FROM ck)",
    *o.hilbert("a0", DIMS),
    *o.ordinals("(SELECT k.*, r.crank FROM k JOIN r ON k.cluster = r.cluster)", "crank, h, pid"),
]


@register("o4_kmeans_hilbert", o.query(_KMEANS_ORDER, "SELECT pid, cluster, crank, ordinal FROM o"))
def _(spark, sf_dir):
    rows = kmeans_.kmeans_cluster(points3(spark, sf_dir), DIMS, CLUSTERS, seed=None, max_iter=1)
    return rows.select("pid", "cluster", long("crank"), "ordinal")


_REST = f"((SELECT count(*) FROM o) % {PARTITIONS})"
_SIZE = f"((SELECT count(*) FROM o) // {PARTITIONS})"
_PART = f"CAST(greatest(0, CASE WHEN ordinal <= {_REST} THEN 0 ELSE (ordinal - 1 - {_REST}) // {_SIZE} END) AS BIGINT)"


@register("o5_with_partition", o.query(o.ORDERED, f"SELECT pid, {_PART} AS part FROM o"))
def _(spark, sf_dir):
    index = point_index(spark, sf_dir)
    return order.with_partition(index.points, PARTITIONS, index.rows).select("pid", long("part"))


@register(
    "o6_adaptive_tiles",
    o.query([*o.ORDERED, *o.tiles(CAPACITY)], "SELECT pid, CAST(depth AS BIGINT) AS depth, tile FROM t"),
)
def _(spark, sf_dir):
    return order.adaptive_tiles(point_index(spark, sf_dir).points, DIMS, CAPACITY).select("pid", long("depth"), "tile")


# Blocks


@register("a1_with_block", o.query(o.ORDERED, "SELECT pid, block, slot FROM o"))
def _(spark, sf_dir):
    rows = point_index(spark, sf_dir).points.select("pid", "ordinal")
    return blocks_.with_block(rows).select("pid", "block", long("slot"))


@register("a2_block_summary", o.query(o.BLOCKED, "SELECT block, lx, ly, lz, hx, hy, hz, n, last_ordinal FROM blk"))
def _(spark, sf_dir):
    return blocks_.block_summary(point_index(spark, sf_dir).points, DIMS)


def _level(i: int) -> str:
    group = f"block // {192**i}"
    return (
        f"SELECT {i} AS level, {group} AS node, min(lx) AS lx, min(ly) AS ly, min(lz) AS lz, max(hx) AS hx,"
        f" max(hy) AS hy, max(hz) AS hz, CAST(sum(n) AS BIGINT) AS n, max(last_ordinal) AS last_ordinal"
        f" FROM blk GROUP BY {group}"
    )


# Levels above the root of the data at hand are dropped: a level exists if the one below has two nodes.
_NODES = [
    *o.BLOCKED,
    "lv AS (" + " UNION ALL ".join(_level(i) for i in range(5)) + ")",
    "nodes AS (SELECT * FROM lv WHERE level = 0 OR (SELECT count(*) FROM lv l WHERE l.level = lv.level - 1) > 1)",
]


@register(
    "a3_build_levels",
    o.query(
        _NODES,
        "SELECT CAST(level AS BIGINT) AS level, node, node // 192 AS parent, lx, ly, lz, hx, hy, hz, n, last_ordinal FROM nodes",
    ),
)
def _(spark, sf_dir):
    nodes = blocks_.build_levels(point_index(spark, sf_dir).blocks, DIMS)
    return nodes.select(long("level"), "node", "parent", *bound_names(DIMS), "n", "last_ordinal")


@register(
    "a4_level_counts",
    o.query(_NODES, "SELECT CAST(level AS BIGINT) AS level, count(*) AS nodes FROM nodes GROUP BY level"),
)
def _(spark, sf_dir):
    return blocks_.level_counts(point_index(spark, sf_dir).nodes).select(long("level"), "nodes")


@register(
    "a5_pack_blocks",
    o.query(
        o.ORDERED,
        "SELECT block, count(*) AS n, string_agg(CAST(pid AS VARCHAR), ',' ORDER BY slot) AS pids,"
        + ", ".join(
            f" string_agg(CAST(CAST(trunc(CAST(1000000 AS FLOAT) * {d}) AS BIGINT) AS VARCHAR), ',' ORDER BY slot) AS {d}s"
            for d in DIMS
        )
        + " FROM o GROUP BY block",
    ),
)
def _(spark, sf_dir):
    packed = blocks_.pack_blocks(point_index(spark, sf_dir).points, DIMS)
    scaled = lambda d: F.transform(d, lambda v: (F.lit(1000000.0).cast("float") * v).cast("long").cast("string"))
    ids = F.transform("pid", lambda v: v.cast("string"))
    return packed.select(
        "block", long("n"), F.array_join(ids, ",").alias("pids"), *[F.array_join(scaled(d), ",").alias(f"{d}s") for d in DIMS]
    )


@register("a6_unpack_blocks", o.query(o.ORDERED, "SELECT block, slot, pid, x, y, z FROM o"))
def _(spark, sf_dir):
    packed = blocks_.pack_blocks(point_index(spark, sf_dir).points, DIMS)
    return blocks_.unpack_blocks(packed).select("block", long("slot"), "pid", *DIMS)


@register("a7_count_entries", "SELECT count(*) AS entries FROM lineitem")
def _(spark, sf_dir):
    return blocks_.count_entries(point_index(spark, sf_dir).blocks)


@register(
    "a8_search_report",
    o.query(
        [*o.BLOCKED, o.BOXES64, o.HITS, o.PAIRS],
        "SELECT count(*) AS queries, CAST(sum(hits) AS BIGINT) AS hits, round(avg(hits), 6) AS hits_per_query,"
        " round((SELECT count(*) FROM pairs) / CAST(count(*) AS DOUBLE), 6) AS blocks_per_query FROM hits",
    ),
)
def _(spark, sf_dir):
    per_query = report.pruning_report(point_index(spark, sf_dir), boxes64(spark))
    return report.search_report(per_query).select(
        "queries", "hits", rounded("hits_per_query"), rounded("blocks_per_query")
    )


@register(
    "a9_partitioned_count",
    o.query(
        [*o.ORDERED, o.BOXES64],
        f"SELECT {_PART} AS part, b.qid, count(*) AS hits FROM o JOIN b ON {o.inside('o', 'b')} GROUP BY ALL",
    ),
)
def _(spark, sf_dir):
    found = partitioned_count(point_index(spark, sf_dir), boxes64(spark), PARTITIONS)
    return found.filter("hits > 0").select(long("part"), "qid", "hits")


# Box search


@register("j1_range_count", o.query([o.POINTS, o.BOXES64], o.COUNT))
def _(spark, sf_dir):
    return range_count(points3(spark, sf_dir), boxes64(spark), DIMS, "broadcast")


@register("j1_range_count_many_boxes", o.query([o.POINTS, o.PART_BOXES], o.COUNT))
def _(spark, sf_dir):
    return range_count(points3(spark, sf_dir), part_boxes(spark, sf_dir), DIMS)


@register(
    "j2_range_search",
    o.query([o.POINTS, o.BOXES64], f"SELECT b.qid, p.pid FROM b JOIN p ON {o.inside('p', 'b')}"),
)
def _(spark, sf_dir):
    return range_search(point_index(spark, sf_dir), boxes64(spark))


@register(
    "j2_range_search_boxes",
    o.query([o.FLAT_BOXES, o.ORDER_BOXES], f"SELECT b.qid, ob.pid FROM b JOIN ob ON {o.meet('b', 'ob', PLANE)}"),
)
def _(spark, sf_dir):
    return range_search(order_index(spark, sf_dir), flat_boxes(spark, sf_dir))


@register(
    "j3_first_k_search",
    o.query(
        [*o.ORDERED, o.BOXES64],
        "SELECT qid, pid FROM (SELECT b.qid, o.pid, row_number() OVER (PARTITION BY b.qid ORDER BY o.ordinal) AS rn"
        f" FROM b JOIN o ON {o.inside('o', 'b')}) WHERE rn <= 10",
    ),
)
def _(spark, sf_dir):
    return range_search(point_index(spark, sf_dir), boxes64(spark), limit_per_query=10)


_FIRST_1000 = o.query(
    [*o.ORDERED, o.PART_BOXES],
    "SELECT qid, pid FROM (SELECT b.qid, o.pid, row_number() OVER (PARTITION BY b.qid ORDER BY o.ordinal) AS rn"
    f" FROM b JOIN o ON {o.inside('o', 'b')}) WHERE rn <= 1000",
)


@register("j3_first_1000", _FIRST_1000)
def _(spark, sf_dir):
    """The candidate blocks of each box in rounds, until it has a thousand rows."""
    return range_search(point_index(spark, sf_dir), part_boxes(spark, sf_dir), limit_per_query=1000, first_blocks=8)


@register("j3_first_1000_bucketed", _FIRST_1000)
def _(spark, sf_dir):
    boxes = part_boxes(spark, sf_dir)
    return range_search(bucketed_index(spark, sf_dir), boxes, limit_per_query=1000, first_blocks=8, broadcast_rows=0)


def _count_query(name: str, method: str, many: bool = False, **options) -> None:
    boxes_sql = o.PART_BOXES if many else o.BOXES64

    @register(name, o.query([o.POINTS, boxes_sql], o.COUNT))
    def _(spark, sf_dir):
        boxes = part_boxes(spark, sf_dir) if many else boxes64(spark)
        return range_count(point_index(spark, sf_dir), boxes, method=method, **options)


_count_query("j4_range_count_blocks", "blocks")
_count_query("j4_range_count_blocks_many_boxes", "blocks", many=True)
_count_query("j5_range_count_levels", "levels")
_count_query("j5_range_count_levels_many_boxes", "levels", many=True)
_count_query("j4_grid_candidates", "blocks", many=True, nested_loop_boxes=16)
_count_query("j6_range_count_partitions", "partitions", p=PARTITIONS)
_count_query("j7_range_count_packed", "packed")
_count_query("j10_scan_by_ranges", "ranges")
_count_query("j10_scan_by_ranges_gap", "ranges", gap=4)


def _stored_query(name: str, method: str, **options) -> None:
    @register(name, o.query([o.POINTS, o.PART_BOXES], o.COUNT))
    def _(spark, sf_dir):
        """The plan for many candidates: only they are shuffled, the stored points are not."""
        return range_count(bucketed_index(spark, sf_dir), part_boxes(spark, sf_dir), method=method, broadcast_rows=0, **options)


_stored_query("j4_bucketed_blocks", "blocks")
_stored_query("j5_bucketed_levels", "levels")
_stored_query("j7_bucketed_packed", "packed")


@register("j5_descent_degree_8", o.query([o.POINTS, o.PART_BOXES], o.COUNT))
def _(spark, sf_dir):
    """Blocks of eight rows make a pyramid of several levels, gone down from its root."""
    index = build_index(points3(spark, sf_dir), DIMS, degree=8)
    return range_count(index, part_boxes(spark, sf_dir), method="levels")


@register("j5_descent_from_level_2", o.query([o.POINTS, o.BOXES64], o.COUNT))
def _(spark, sf_dir):
    index = build_index(points3(spark, sf_dir), DIMS, degree=8)
    return range_count(index, boxes64(spark), method="levels", start_level=2)


@register("j2_search_by_descent", o.query([o.POINTS, o.BOXES64], f"SELECT b.qid, p.pid FROM b JOIN p ON {o.inside('p', 'b')}"))
def _(spark, sf_dir):
    index = build_index(points3(spark, sf_dir), DIMS, degree=8)
    return range_search(index, boxes64(spark), flat_blocks=64)


@register("j8_range_count_grid_shuffled", o.query([o.POINTS, o.PART_BOXES], o.COUNT))
def _(spark, sf_dir):
    """Neither side is broadcast."""
    return range_count(points3(spark, sf_dir), part_boxes(spark, sf_dir), DIMS, "grid", broadcast_rows=0)


@register("j8_range_count_grid", o.query([o.POINTS, o.BOXES64], o.COUNT))
def _(spark, sf_dir):
    return range_count(points3(spark, sf_dir), boxes64(spark), DIMS, "grid")


@register("j8_range_count_grid_many_boxes", o.query([o.POINTS, o.PART_BOXES], o.COUNT))
def _(spark, sf_dir):
    return range_count(points3(spark, sf_dir), part_boxes(spark, sf_dir), DIMS, "grid")


@register(
    "j8_range_count_grid_boxes",
    o.query(
        [o.FLAT_BOXES, o.ORDER_BOXES],
        f"SELECT b.qid, count(ob.pid) AS hits FROM b LEFT JOIN ob ON {o.meet('b', 'ob', PLANE)} GROUP BY b.qid",
    ),
)
def _(spark, sf_dir):
    return range_count(order_boxes(spark, sf_dir), flat_boxes(spark, sf_dir), PLANE, "grid")


def _runs(gap: int) -> list[str]:
    return [
        *o.BLOCKED,
        o.BOXES64,
        o.PAIRS,
        "marked AS (SELECT qid, block, CASE WHEN block - lag(block) OVER (PARTITION BY qid ORDER BY block)"
        f" > {gap + 1} THEN 1 ELSE 0 END AS brk FROM pairs)",
        "numbered AS (SELECT *, sum(brk) OVER (PARTITION BY qid ORDER BY block) AS run FROM marked)",
        "ranges AS (SELECT qid, min(block) AS first_block, max(block) AS last_block, count(*) AS blocks"
        " FROM numbered GROUP BY qid, run)",
    ]


@register("j9_scan_ranges", o.query(_runs(0), "SELECT qid, first_block, last_block, blocks FROM ranges"))
def _(spark, sf_dir):
    return runs.scan_ranges(point_index(spark, sf_dir), boxes64(spark))


@register("j9_scan_ranges_gap", o.query(_runs(4), "SELECT qid, first_block, last_block, blocks FROM ranges"))
def _(spark, sf_dir):
    return runs.scan_ranges(point_index(spark, sf_dir), boxes64(spark), gap=4)


@register(
    "j11_tile_overlaps",
    o.query(
        o.BLOCKED, f"SELECT l.block AS a, r.block AS b FROM blk l JOIN blk r ON l.block < r.block AND {o.meet('l', 'r')}"
    ),
)
def _(spark, sf_dir):
    return tiles.tile_overlaps(point_index(spark, sf_dir).blocks, DIMS)


@register(
    "j11_box_overlaps",
    o.query(
        [o.ORDER_BOXES],
        f"SELECT l.pid AS a, r.pid AS b FROM ob l JOIN ob r ON l.pid < r.pid AND {o.meet('l', 'r', PLANE)}",
    ),
)
def _(spark, sf_dir):
    return tiles.tile_overlaps(order_boxes(spark, sf_dir), PLANE, "pid")


_MIXED = "mb AS (SELECT * FROM ob UNION ALL SELECT -1, 0, 0, 1, 1)"


@register(
    "j11_mixed_sizes",
    o.query(
        [o.ORDER_BOXES, _MIXED],
        f"SELECT l.pid AS a, r.pid AS b FROM mb l JOIN mb r ON l.pid < r.pid AND {o.meet('l', 'r', PLANE)}",
    ),
)
def _(spark, sf_dir):
    """Many small boxes and one over everything."""
    whole = spark.sql("SELECT -1L AS pid, 0f AS la, 0f AS lb, 1f AS ha, 1f AS hb")
    return tiles.tile_overlaps(order_boxes(spark, sf_dir).unionByName(whole), PLANE, "pid")


_POINT = ([f"p.{d}" for d in DIMS], [f"p.{d}" for d in DIMS])
_BOX = (o.names("b", "l", DIMS), o.names("b", "h", DIMS))
_GROWTH = f"{o.sphere(*o.joint(*_POINT, *_BOX))} - {o.sphere(*_BOX)}"


@register(
    "j12_least_enlargement",
    o.query(
        [o.POINTS, o.BOXES64],
        "SELECT pid, qid AS box, round(growth, 6) AS growth FROM (SELECT *, row_number() OVER (PARTITION BY pid"
        f" ORDER BY growth, size, qid) AS rn FROM (SELECT p.pid, b.qid, {_GROWTH} AS growth, {o.sphere(*_BOX)} AS size"
        " FROM p CROSS JOIN b)) WHERE rn = 1",
    ),
)
def _(spark, sf_dir):
    found = tiles.assign_least_enlargement(points3(spark, sf_dir), boxes64(spark), DIMS)
    return found.select("pid", "box", rounded("growth"))


_LEFT = (o.names("l", "l", PLANE), o.names("l", "h", PLANE))
_RIGHT = (o.names("r", "l", PLANE), o.names("r", "h", PLANE))
_WASTE = f"({o.sphere(*o.joint(*_LEFT, *_RIGHT))} - {o.sphere(*_LEFT)}) - {o.sphere(*_RIGHT)}"


@register(
    "j13_worst_pair",
    o.query(
        o.ORDER_BLOCKED,
        "SELECT block, slot_a, slot_b, round(waste, 9) AS waste FROM (SELECT *, row_number() OVER (PARTITION BY block"
        " ORDER BY waste DESC, slot_a, slot_b) AS rn FROM (SELECT l.block, l.slot AS slot_a, r.slot AS slot_b,"
        f" {_WASTE} AS waste FROM o l JOIN o r ON l.block = r.block AND l.slot < r.slot)) WHERE rn = 1",
    ),
)
def _(spark, sf_dir):
    found = tiles.worst_pair(order_index(spark, sf_dir).points, PLANE)
    return found.select("block", "slot_a", "slot_b", rounded("waste", 9))


# K-means


@register(
    "k1_pick_seeds",
    o.query([o.POINTS, *o.rounds(0, CLUSTERS)], "SELECT cluster, x, y, z FROM c0"),
)
def _(spark, sf_dir):
    return kmeans_.pick_seeds(points3(spark, sf_dir), DIMS, CLUSTERS, seed=None)


@register("k2_assign_nearest", o.query([o.POINTS, *o.rounds(1, 64)], "SELECT pid, cluster FROM a0"))
def _(spark, sf_dir):
    points = points3(spark, sf_dir)
    seeds = kmeans_.pick_seeds(points, DIMS, 64, seed=None)
    return kmeans_.assign_nearest(points, DIMS, seeds).select("pid", "cluster")


@register(
    "k3_kmeans",
    o.query(
        [o.POINTS, *o.rounds(2, CLUSTERS)],
        f"SELECT cluster, {', '.join(o.six(d) for d in DIMS)} FROM c2",
    ),
)
def _(spark, sf_dir):
    points = points3(spark, sf_dir)
    model = kmeans_.kmeans(points, DIMS, CLUSTERS, tol=0.0, max_iter=2, seed=None)
    return model.centroids(points).select("cluster", *[rounded(d) for d in DIMS])


@register("k3_kmeans_converged", "SELECT count(*) AS assigned, CAST(0 AS BIGINT) AS not_nearest, true AS settled FROM lineitem")
def _(spark, sf_dir):
    """Every row has the nearest of the centroids used, as plain column arithmetic finds it, and few rows moved."""
    points = points3(spark, sf_dir)
    model = kmeans_.kmeans(points, DIMS, CLUSTERS, tol=0.01, max_iter=200)
    rows = model.assignments(points)
    away = [dist2([F.col(d) for d in DIMS], [F.lit(float(v)) for v in center]) for center in model.used]
    nearest = F.array_position(F.array(*away), F.least(*away)) - 1
    return rows.agg(
        F.count(F.lit(1)).alias("assigned"),
        F.sum((F.col("cluster") != nearest).cast("long")).alias("not_nearest"),
        F.lit(model.changed <= 0.01).alias("settled"),
    )


@register(
    "k1_pick_seeds_hashed",
    "SELECT CAST(1000 AS BIGINT) AS seeds, CAST(1000 AS BIGINT) AS clusters, CAST(1000 AS BIGINT) AS rows_of_table FROM (SELECT count(*) FROM lineitem)",
)
def _(spark, sf_dir):
    """A thousand hashed seeds: different rows of the table."""
    points = points3(spark, sf_dir)
    seeds = kmeans_.pick_seeds(points, DIMS, 1_000)
    there = points.select(*[F.col(d).cast("double").alias(d) for d in DIMS]).distinct()
    known = seeds.join(there, list(DIMS), "left_semi").count()
    return seeds.agg(F.count(F.lit(1)).alias("seeds"), F.count_distinct("cluster").alias("clusters")).withColumn(
        "rows_of_table", F.lit(known).cast("long")
    )


_LARGE = "CASE WHEN pid % 3 = 0 THEN NULL ELSE pid + 9007199254740993 - pid % 2 END"


@register("k2_other_columns", o.query([o.POINTS, *o.rounds(1, 64)], f"SELECT pid, {_LARGE} AS large, cluster FROM a0"))
def _(spark, sf_dir):
    """A column of nulls and numbers beyond 2**53 passes by unchanged."""
    points = points3(spark, sf_dir)
    seeds = kmeans_.pick_seeds(points, DIMS, 64, seed=None)
    return kmeans_.assign_nearest(points.withColumn("large", F.expr(_LARGE)), DIMS, seeds).select("pid", "large", "cluster")


@register(
    "k4_changed_share",
    o.query(
        [o.POINTS, *o.rounds(2, CLUSTERS)],
        "SELECT round(avg(CASE WHEN a0.cluster <> a1.cluster THEN 1e0 ELSE 0e0 END), 9) AS changed_share"
        " FROM a0 JOIN a1 ON a0.pid = a1.pid",
    ),
)
def _(spark, sf_dir):
    points = points3(spark, sf_dir)
    one = kmeans_.kmeans(points, DIMS, CLUSTERS, tol=0.0, max_iter=1, seed=None)
    old = kmeans_.assign_nearest(points, DIMS, one.used)
    new = kmeans_.assign_nearest(points, DIMS, one.centers)
    return kmeans_.changed_share(old, new).select(rounded("changed_share", 9))


# Reports


@register(
    "m1_pruning_report",
    o.query(
        [*o.BLOCKED, o.BOXES64, o.HITS, o.PAIRS],
        "SELECT h.qid, count(pairs.block) AS candidate_blocks, CAST(coalesce(sum(pairs.n), 0) AS BIGINT) AS candidate_rows,"
        " h.hits, round(h.hits / CAST(sum(pairs.n) AS DOUBLE), 9) AS hit_share"
        " FROM hits h LEFT JOIN pairs ON h.qid = pairs.qid GROUP BY h.qid, h.hits",
    ),
)
def _(spark, sf_dir):
    found = report.pruning_report(point_index(spark, sf_dir), boxes64(spark))
    return found.select("qid", "candidate_blocks", "candidate_rows", "hits", rounded("hit_share", 9))


@register(
    "m2_run_report",
    o.query(
        _runs(0),
        "SELECT qid, count(*) AS runs, CAST(sum(blocks) AS BIGINT) AS blocks,"
        " max(last_block - first_block + 1) AS longest_run FROM ranges GROUP BY qid",
    ),
)
def _(spark, sf_dir):
    return report.run_report(runs.scan_ranges(point_index(spark, sf_dir), boxes64(spark)))


_EDGES = (100.0, 10.0, 1.0, 0.1, 0.01, 0.001, 0.0001)
_BUCKET = (
    "CASE "
    + " ".join(f"WHEN hits * 100e0 >= {e!r}::VARCHAR::DOUBLE * n THEN {e!r}::VARCHAR::DOUBLE" for e in _EDGES)
    + " ELSE 0e0 END"
)
_SELECTIVE = [
    o.POINTS,
    o.PART_BOXES,
    o.HITS,
    "total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM p)",
    f"sel AS (SELECT qid, hits, round(hits / n, 9) AS selectivity, {_BUCKET} AS bucket_percent FROM hits, total)",
]


@register("m3_selectivity", o.query(_SELECTIVE, "SELECT qid, hits, selectivity, bucket_percent FROM sel"))
def _(spark, sf_dir):
    index = point_index(spark, sf_dir)
    found = report.selectivity(range_count(index, part_boxes(spark, sf_dir)), index.rows)
    return found.select("qid", "hits", rounded("selectivity", 9), "bucket_percent")


@register(
    "m3_selectivity_groups",
    o.query(
        _SELECTIVE,
        "SELECT bucket_percent, count(*) AS queries, CAST(sum(hits) AS BIGINT) AS hits FROM sel GROUP BY bucket_percent",
    ),
)
def _(spark, sf_dir):
    index = point_index(spark, sf_dir)
    found = report.selectivity(range_count(index, part_boxes(spark, sf_dir)), index.rows)
    return report.selectivity_groups(found)


_TILE = [
    *o.ORDERED,
    *o.tiles(CAPACITY),
    f"ts AS (SELECT depth, tile, {o.bounds_of(DIMS, DIMS, DIMS)}, count(*) AS n FROM t GROUP BY depth, tile)",
]
_TILE_BOX = ([f"l{d}" for d in DIMS], [f"h{d}" for d in DIMS])


@register(
    "m4_tile_quality",
    o.query(
        _TILE,
        f"SELECT CAST(depth AS BIGINT) AS depth, tile, n, round({o.volume(*_TILE_BOX)}, 9) AS volume,"
        f" round({o.sphere(*_TILE_BOX)}, 9) AS sphere_volume, round(n / CAST({CAPACITY} AS DOUBLE), 6) AS fill FROM ts",
    ),
)
def _(spark, sf_dir):
    rows = order.adaptive_tiles(point_index(spark, sf_dir).points, DIMS, CAPACITY)
    quality = tiles.tile_quality(tiles.tile_summary(rows, DIMS), DIMS, CAPACITY)
    return quality.select(
        long("depth"), "tile", "n", rounded("volume", 9), rounded("sphere_volume", 9), rounded("fill")
    )


@register(
    "m4_tile_quality_totals",
    o.query(
        o.BLOCKED,
        f"SELECT count(*) AS tiles, CAST(sum(n) AS BIGINT) AS entries, round(sum({o.volume(*_TILE_BOX)}), 6) AS volume,"
        f" round(sum({o.sphere(*_TILE_BOX)}), 6) AS sphere_volume, round(avg(n / 192e0), 6) AS fill FROM blk",
    ),
)
def _(spark, sf_dir):
    quality = tiles.tile_quality(point_index(spark, sf_dir).blocks, DIMS, blocks_.DEGREE)
    return tiles.tile_quality_totals(quality).select(
        "tiles", "entries", rounded("volume"), rounded("sphere_volume"), rounded("fill")
    )


# Changes

_JOINED = o.query(
    [o.POINTS.replace("p AS", "p0 AS"), o.EVENTS, "p AS (SELECT * FROM p0 UNION ALL SELECT * FROM e)", o.BOXES64],
    o.COUNT,
)


@register("u1_insert", _JOINED)
def _(spark, sf_dir):
    bigger = mutate.insert(point_index(spark, sf_dir), events3(spark, sf_dir))
    return range_count(bigger, boxes64(spark))


@register(
    "u1_insert_payload",
    o.query(
        [o.POINTS.replace("p AS", "p0 AS"), o.EVENTS],
        "SELECT pid, pid % 7 AS tag FROM p0 UNION ALL SELECT pid, CAST(NULL AS BIGINT) AS tag FROM e",
    ),
)
def _(spark, sf_dir):
    """Columns beside the coordinates stay; inserted rows without them have null."""
    tagged = build_index(points3(spark, sf_dir).withColumn("tag", F.expr("pid % 7")), DIMS)
    return mutate.insert(tagged, events3(spark, sf_dir)).points.select("pid", "tag")


def delete_requests(spark, sf_dir) -> DataFrame:
    """Ask for every returned line, with a box that only holds the cheaper ones."""
    returned = points3(spark, sf_dir, "l_returnflag = 'R'")
    corners = [F.lit(v).cast("float").alias(n) for n, v in zip(bound_names(DIMS), (0, 0, 0, 1, 0.5, 1))]
    return returned.select(F.col("pid").alias("request"), "pid", *corners)


_RETURNED = o.POINTS.replace("p AS", "returned AS").replace("FROM lineitem", "FROM lineitem WHERE l_returnflag = 'R'")
_GONE = "gone AS (SELECT pid FROM returned WHERE y <= CAST(0.5 AS FLOAT))"


@register(
    "u2_remove_found",
    o.query([_RETURNED], "SELECT pid AS request, pid, y <= CAST(0.5 AS FLOAT) AS found FROM returned"),
)
def _(spark, sf_dir):
    return mutate.remove(point_index(spark, sf_dir), delete_requests(spark, sf_dir))[1]


@register(
    "u2_remove",
    o.query(
        [
            o.POINTS.replace("p AS", "p0 AS"),
            _RETURNED,
            _GONE,
            "p AS (SELECT * FROM p0 WHERE pid NOT IN (SELECT pid FROM gone))",
            o.BOXES64,
        ],
        o.COUNT,
    ),
)
def _(spark, sf_dir):
    smaller = mutate.remove(point_index(spark, sf_dir), delete_requests(spark, sf_dir))[0]
    return range_count(smaller, boxes64(spark))


def changing_index(spark, sf_dir) -> str:
    """The folder of an index over points3 that takes changes."""
    path = scratch_path(spark, "changing")
    save_changing(point_index(spark, sf_dir), path)
    return path


@register("u1_insert_in_parts", _JOINED)
def _(spark, sf_dir):
    """Only the parts that new rows fall into are written."""
    return range_count(insert_rows(spark, changing_index(spark, sf_dir), events3(spark, sf_dir)), boxes64(spark))


_LEFT = [
    o.POINTS.replace("p AS", "p0 AS"),
    _RETURNED,
    _GONE,
    "p AS (SELECT * FROM p0 WHERE pid NOT IN (SELECT pid FROM gone))",
    o.BOXES64,
]


def marked_index(spark, sf_dir) -> BoxIndex:
    return remove_rows(spark, changing_index(spark, sf_dir), delete_requests(spark, sf_dir))[0]


@register("u2_remove_by_marks", o.query(_LEFT, o.COUNT))
def _(spark, sf_dir):
    """Nothing but the marks of deleted rows is written."""
    return range_count(marked_index(spark, sf_dir), boxes64(spark))


@register("u2_levels_with_marks", o.query(_LEFT, o.COUNT))
def _(spark, sf_dir):
    return range_count(marked_index(spark, sf_dir), boxes64(spark), method="levels")


@register("u2_search_with_marks", o.query(_LEFT, f"SELECT b.qid, p.pid FROM b JOIN p ON {o.inside('p', 'b')}"))
def _(spark, sf_dir):
    return range_search(marked_index(spark, sf_dir), boxes64(spark))


@register(
    "u2_ordinals_with_marks",
    o.query([*_LEFT[:4], "p1 AS (SELECT pid FROM p)"], "SELECT count(*) AS n, min(1) AS first, count(*) AS last FROM p1"),
)
def _(spark, sf_dir):
    """Ordinals of the rows that are left run from 1 without gaps."""
    return marked_index(spark, sf_dir).points.agg(
        F.count_distinct("ordinal").alias("n"), F.min("ordinal").cast("int").alias("first"), F.max("ordinal").alias("last")
    )


@register(
    "u2_insert_after_marks",
    o.query(
        [
            o.POINTS.replace("p AS", "p0 AS"),
            _RETURNED,
            _GONE,
            o.EVENTS,
            "p AS (SELECT * FROM p0 WHERE pid NOT IN (SELECT pid FROM gone) UNION ALL SELECT * FROM e)",
            o.BOXES64,
        ],
        o.COUNT,
    ),
)
def _(spark, sf_dir):
    """Rows are marked, others inserted, all written in full blocks, and what older versions had is deleted."""
    path = changing_index(spark, sf_dir)
    remove_rows(spark, path, delete_requests(spark, sf_dir))
    insert_rows(spark, path, events3(spark, sf_dir))
    index = tidy(spark, path)
    vacuum_changing(spark, path)
    return range_count(index, boxes64(spark))


@register("u3_insert_stream", _JOINED)
def _(spark, sf_dir):
    path = scratch_path(spark, "streamed")
    save_index(point_index(spark, sf_dir), path)
    query = insert_stream(events3(spark, sf_dir, event_stream(spark, sf_dir)), path, DIMS, scratch_path(spark, "stream-progress"))
    query.awaitTermination()
    return range_count(compacted(load_index(spark, path), path), boxes64(spark))


def _streamed(spark, sf_dir, parts: int) -> str:
    """The folder of a saved index into which the events have been streamed, by one or several streams."""
    path = scratch_path(spark, "streamed")
    save_index(point_index(spark, sf_dir), path)
    for part in range(parts):
        mine = event_stream(spark, sf_dir).filter(F.col("event_id") % parts == part)
        insert_stream(events3(spark, sf_dir, mine), path, DIMS, scratch_path(spark, "stream-progress")).awaitTermination()
    return path


@register("u3_two_streams", _JOINED)
def _(spark, sf_dir):
    path = _streamed(spark, sf_dir, 2)
    return range_count(compacted(load_index(spark, path), path), boxes64(spark))


@register("u3_reads_without_compaction", _JOINED)
def _(spark, sf_dir):
    return range_count(load_index(spark, _streamed(spark, sf_dir, 1)), boxes64(spark))


@register("s4_vacuumed_versions", _JOINED)
def _(spark, sf_dir):
    """What an index gives when its old versions and merged batches have been deleted."""
    path = _streamed(spark, sf_dir, 1)
    compacted(load_index(spark, path), path)
    vacuum(spark, path)
    return range_count(load_index(spark, path), boxes64(spark))


@register("u3_repeated_rows", _JOINED)
def _(spark, sf_dir):
    """A second stream delivers all rows again, before and after a compaction; each counts once."""
    path = _streamed(spark, sf_dir, 1)
    for _ in range(2):
        stream = event_stream(spark, sf_dir)
        insert_stream(events3(spark, sf_dir, stream), path, DIMS, scratch_path(spark, "stream-progress")).awaitTermination()
        index = compacted(load_index(spark, path), path)
    return range_count(index, boxes64(spark))
