"""Shared scratch tables, size checks and the skew-safe join used across the package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Rows of 100 bytes a side may have before it is no longer broadcast, some 50 MB; fewer of wider rows.
BROADCAST_ROWS = 500_000

# Boxes tested against every row by a nested loop. Beyond this the work, not the memory, is the limit.
NESTED_LOOP_BOXES = 4_096

# A key is hot when it holds more than 1/HOT_KEYS of the rows, so there are fewer than HOT_KEYS hot keys.
HOT_KEYS = 1_024
HOT_MIN_ROWS = 200_000

# Keys are counted by this many hashes first; only keys of a hash with as many rows as a hot key are counted one by one.
HOT_HASHES = 65_536

# Rows of one shuffle partition that is sorted: some hundred megabytes of narrow rows, at a hundred bytes each.
ROWS_PER_PARTITION = 4_000_000

# Shuffle partitions for each stored segment whose rows are sorted by one task, so that few share a partition.
SPREAD_SEGMENTS = 4

_local_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's checkpoint folder, or a local one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="boxquery-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write df to a scratch Parquet table and read it back: cuts lineage and survives lost executors.

    Within `released` the table ends with the block, or with the block around it for keep=True.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    around = _scopes[:-1] if keep else _scopes
    if around:
        around[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch tables written inside the block when it ends. For operations whose results are stored."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern of the file system; none if there are none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [str(status.getPath()) for status in found or ()]


def moved_if_free(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder unless the target is there; False if it is. One of several writers wins.

    The file system must rename atomically, as HDFS does; its parent folder must be there.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    hadoop = jvm.org.apache.hadoop.fs
    made, wanted = hadoop.Path(source), hadoop.Path(target)
    qualified = made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(made)
    context = hadoop.FileContext.getFileContext(qualified.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(qualified, context.makeQualified(wanted), gateway.new_array(hadoop.Options.Rename, 0))
    except Py4JJavaError as refused:
        if refused.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def drop_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. Tables and indexes that read them end with it."""
    _delete(spark, f"{scratch_root(spark)}/{spark.sparkContext.applicationId}")


def row_bytes(kind: T.DataType) -> int:
    """A row's width: eight bytes a number, nested fields counted, sixty-four for what has no fixed size."""
    if isinstance(kind, T.StructType):
        return sum(row_bytes(f.dataType) for f in kind.fields)
    return 8 if isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)) else 64


def broadcast_limit(df: DataFrame, rows: int) -> int:
    """How many rows of df may be broadcast, where `rows` rows of 100 bytes may."""
    return rows * 100 // max(100, row_bytes(df.schema))


def partitions_for(df: DataFrame) -> int | None:
    """Partitions that a sort of all rows needs; None if the session's own number is enough.

    Counting reads no more than the file footers where the rows come from Parquet.
    """
    needed = -(-df.count() // ROWS_PER_PARTITION)
    return needed if needed > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def pair_tasks(df: DataFrame) -> int:
    """Tasks for a step whose work lies in the pairs it makes and not in the bytes of its input.

    Spark would size its tasks by those bytes and leave all the work to a few of them.
    """
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def skew_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    row_id: str | None,
    total: int,
    min_rows: int = HOT_MIN_ROWS,
    *,
    small_id: Sequence[str] = (),
) -> DataFrame:
    """Inner equi join that splits the hot keys of either side over several tasks.

    Hot keys are found exactly on both sides. A key that is hot on a side has that side's rows spread over as
    many tasks as its share asks for, and the other side's rows repeated once for each of them; hot on both
    sides, the tasks form a grid. At most HOT_KEYS keys can be hot on a side, so that list is broadcast. Where none
    is, rows are joined as they are.
    row_id names a column of `big` that tells its rows apart, small_id columns of `small`. A side without them is
    numbered in a written copy, so that equal rows are spread too and stay where they are after a failure; stored
    rows have an identity and are never copied. Both sides are shuffled, whatever size Spark estimates: it does not
    see how often an explode repeats a row, and would broadcast a side that is too large for it.
    """
    numbered = small.withColumn("_small", F.xxhash64(*small_id)) if small_id else written(small.withColumn("_small", F.monotonically_increasing_id()), "skew-small")
    if row_id is None:
        big = written(big.withColumn("_big", F.monotonically_increasing_id()), "skew-big")
    tasks, sides = pair_tasks(big), []
    for side, rows, name in ((big, total, "_a"), (numbered, numbered.count(), "_b")):
        threshold = max(min_rows, -(-rows // HOT_KEYS))
        sides.append(_counted_above(side, keys, threshold).select(*keys, F.ceil(F.col("count") / threshold).cast("int").alias(name)))
    hot = written(sides[0].join(sides[1], keys, "full"), "hot-keys")
    if hot.isEmpty():
        return big.drop("_big").repartition(tasks, *keys).join(numbered.drop("_small").repartition(tasks, *keys).hint("merge"), keys)
    hot = F.broadcast(hot)
    one = F.lit(1)
    a, b = F.coalesce("_a", one), F.coalesce("_b", one)
    own = F.pmod(F.xxhash64(row_id or "_big"), a).cast("int")
    left = big.join(hot, keys, "left").withColumns({"_left": own, "_right": F.sequence(F.lit(0), b - 1)})
    left = left.withColumn("_right", F.explode("_right")).drop("_a", "_b", "_big")
    right = numbered.join(hot, keys, "left").withColumn("_right", F.pmod(F.xxhash64("_small"), b).cast("int"))
    right = right.withColumn("_left", F.explode(F.sequence(F.lit(0), a - 1))).drop("_a", "_b", "_small")
    met = [*keys, "_left", "_right"]
    return left.repartition(tasks, *met).join(right.repartition(tasks, *met).hint("merge"), met).drop("_left", "_right")


def _counted_above(side: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """(keys, count) of the keys with more than `threshold` rows. Of mostly different keys few are shuffled, if any."""
    hashed = F.pmod(F.xxhash64(*keys), F.lit(HOT_HASHES))
    full = side.groupBy(hashed.alias("_hash")).count().filter(F.col("count") > threshold).select("_hash").collect()
    here = hashed.isin([r["_hash"] for r in full]) if full else F.lit(False)
    return side.filter(here).groupBy(*keys).count().filter(F.col("count") > threshold)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="boxquery-package-")) / "boxquery.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
