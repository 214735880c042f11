"""Saving an index as Parquet tables and opening it again."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from boxquery.functions.boxes import coordinate_names
from boxquery.operators.blocks import DEGREE, block_summary, build_levels
from boxquery.operators.index import BLOCK_KEYS, BoxIndex, Taken, build_index, with_full_blocks, with_segment, with_small_segments
from boxquery.operators.mutate import insert
from boxquery.session import ROWS_PER_PARTITION, _delete, folders, moved_if_free, released, written

PARTS = ("points", "blocks", "nodes")
META = "meta"
DELTA = "delta"
VERSION = "v"
TABLE = "boxquery_"

# Points of a bucketed index are stored by this column; the setting lets joins by more columns use that.
BUCKET_KEY = "segment"
PARTIAL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def save_index(index: BoxIndex, path: str, params: dict | None = None, buckets: int | None = None) -> None:
    """Write all parts. The points are stored by segment, in ordinal order inside each.

    With a number of buckets they are stored as that many buckets of whole segments instead (`bucket_count` gives a
    fitting one), so that many boxes meet them without a shuffle of the points. These segments are small, and are
    skipped by the statistics of row groups and not by folder.
    """
    params, index = {} if params is None else params, with_full_blocks(index)
    if buckets:
        index = with_small_segments(index)
    stored = _describe(index, params, buckets)
    _save_part(index.points, path, "points", stored)
    _save_part(index.blocks, path, "blocks", stored)
    _save_part(index.nodes, path, "nodes", stored)
    metas = _read_metas(index.points.sparkSession, path)
    if _latest(metas) is not None:  # a compacted version is there: the parts just saved come after it
        parts = {part: metas[part] for part in PARTS}
        spark, content = index.points.sparkSession, {"folder": path, "parts": parts, "merged": {}}
        while not _publish(spark, path, _next_version(_read_metas(spark, path)), content):
            pass  # a compaction has taken that number; the parts just saved come after it


def _latest(metas: dict[str, dict]) -> dict | None:
    """The newest version: the folder of its parts, their descriptions, and the last merged batch of each stream."""
    versions = [part for part in metas if part.startswith(VERSION)]
    return metas[max(versions)] if versions else None


def _next_version(metas: dict[str, dict]) -> int:
    return 1 + max((int(part[len(VERSION) :]) for part in metas if part.startswith(VERSION)), default=0)


def _publish(spark: SparkSession, path: str, number: int, content: dict) -> bool:
    """Describe a version, whole and at once. False if another writer has taken its number."""
    made = f"{path}/unpublished-{uuid.uuid4().hex}"
    _description(spark, content).write.parquet(made)
    if moved_if_free(spark, made, f"{path}/{META}/part={VERSION}{number:08d}"):
        return True
    _delete(spark, made)
    return False


def delta_rows(spark: SparkSession, path: str, metas: dict[str, dict] | None = None) -> DataFrame | None:
    """Rows inserted beside the index and not merged into it, with their stream and batch; None if there are none."""
    try:
        rows = spark.read.option("mergeSchema", "true").parquet(f"{path}/{DELTA}")
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    merged = (_latest(_read_metas(spark, path) if metas is None else metas) or {"merged": {}})["merged"]
    for stream, batch in merged.items():
        rows = rows.filter(~((F.col("stream") == stream) & (F.col("batch_id") <= batch)))
    return None if rows.isEmpty() else rows


def compact(spark: SparkSession, path: str, opened: BoxIndex | None = None) -> BoxIndex:
    """Merge the inserted rows into the index at `path`, in a folder of their own.

    Readers see the new version from the moment its description is there; before that nothing they read is touched.
    Batches that were merged are no longer read. Where they bring no new row the next version has the files of the
    current one. Of several compactions at a time, one publishes the next version;
    the others start again from it, so that what each of them saw is merged. `vacuum` deletes old versions.
    An index that was opened from the same version and files has these rows merged already, and is stored as it is.
    """
    held = opened.taken if opened is not None else None
    while True:
        metas = _read_metas(spark, path)
        delta = delta_rows(spark, path, metas)
        if delta is None:
            return load_index(spark, path)
        if held is not None and (held.version, held.files) == (_current(metas, path), sorted(delta.inputFiles())):
            fresh, content = _stored_version(spark, path, metas, opened if held.any_new else None, held.last)
        else:
            fresh, content = _merged_version(spark, path, metas, delta)
        if _publish(spark, path, _next_version(metas), content):
            return load_index(spark, path)
        if fresh is not None:
            _delete(spark, fresh)


def _merged_version(spark: SparkSession, path: str, metas: dict[str, dict], delta: DataFrame) -> tuple[str | None, dict]:
    """Write the current version with the inserted rows to a folder of its own; the folder and its description."""
    last = _last_batches(delta)
    folder, parts, _ = _current(metas, path)
    taken = delta.filter(" OR ".join(f"(stream = '{s}' AND batch_id <= {b})" for s, b in last.items()))
    with released(spark):
        stored_index = _stored(spark, folder, parts)
        bigger = _with_new(stored_index, taken)
        return _stored_version(spark, path, metas, None if bigger is stored_index else bigger, last)


def _last_batches(delta: DataFrame) -> dict[str, int]:
    return {r["stream"]: r["batch_id"] for r in delta.groupBy("stream").agg(F.max("batch_id").alias("batch_id")).collect()}


def _stored_version(
    spark: SparkSession, path: str, metas: dict[str, dict], bigger: BoxIndex | None, last: dict[str, int]
) -> tuple[str | None, dict]:
    """Write the next version, which holds the batches up to `last`, to a folder of its own; the folder and its description.

    Without new rows nothing is written: no folder, and a description of the current files.
    """
    folder, parts, merged = _current(metas, path)
    if bigger is None:
        return None, {"folder": folder, "parts": parts, "merged": {**merged, **last}}
    fresh = f"{path}/version-{uuid.uuid4().hex}"
    buckets = parts["points"].get("buckets")
    bigger = with_small_segments(bigger) if buckets else bigger
    stored = _describe(bigger, parts["points"]["params"], buckets)
    for part in PARTS:
        _save_part(getattr(bigger, part), fresh, part, stored)
    return fresh, {"folder": fresh, "parts": _read_metas(spark, fresh), "merged": {**merged, **last}}


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete the versions behind the newest `keep`, and inserted batches that all kept ones have merged.

    Returns how many versions went, the parts of the first build counted as one. Nobody may read those any more.
    Descriptions go before the files they describe, so an interrupted run leaves files and never a broken version;
    files of a compaction that has not published are left alone, as it may be running.
    """
    if keep < 1:
        raise ValueError("at least one version must be kept")
    metas = _read_metas(spark, path)
    versions = sorted(part for part in metas if part.startswith(VERSION))
    kept, old = versions[-keep:], versions[:-keep]
    if len(versions) < keep or not kept:
        return 0
    used = {metas[part]["folder"] for part in kept}
    for part in old:
        _delete(spark, f"{path}/{META}/part={part}")
    gone = {metas[part]["folder"] for part in old} | ({path} if any(part in metas for part in PARTS) else set())
    for folder in sorted(gone - used):
        if folder != path:
            _delete(spark, folder)
            continue
        for part in PARTS:
            _write_meta(spark, path, part, None)
        for part in PARTS:
            _delete(spark, f"{path}/{part}")
    for stream, batch in metas[kept[0]]["merged"].items():
        for found in folders(spark, f"{path}/{DELTA}/stream={stream}/batch_id=*"):
            if int(found.rsplit("=", 1)[1]) <= batch:
                _delete(spark, found)
    return len(gone - used)


def new_rows(index: BoxIndex, delta: DataFrame) -> DataFrame:
    """Inserted rows whose id the index does not have, one of each id.

    Sources that deliver at least once repeat rows, within a batch, in later ones or by another stream. The row of
    the earliest batch stays, among those of one batch number the least by stream and coordinates; all others, and
    rows whose id is stored already, are left out: the first row with an id is the one that counts.
    """
    order = Window.partitionBy(index.id_col).orderBy("batch_id", "stream", *coordinate_names(delta, index.dims))
    first = delta.withColumn("_turn", F.row_number().over(order)).filter("_turn = 1")
    return first.drop("_turn", "stream", "batch_id", "h").join(index.points.select(index.id_col), index.id_col, "left_anti")


def _with_new(index: BoxIndex, delta: DataFrame) -> BoxIndex:
    """The index with the rows of delta that it does not have; itself if there are none. They are looked for once."""
    fresh = written(new_rows(index, delta), "new-rows")
    return index if fresh.isEmpty() else insert(index, fresh, checked=True)


def _current(metas: dict[str, dict], path: str) -> tuple[str, dict, dict]:
    latest = _latest(metas)
    if latest is not None:
        return latest["folder"], latest["parts"], latest["merged"]
    missing = [part for part in PARTS if part not in metas]
    if missing:
        raise FileNotFoundError(f"{path} has no finished {', '.join(missing)}")
    return path, {part: metas[part] for part in PARTS}, {}


def _stored(spark: SparkSession, folder: str, parts: dict) -> BoxIndex:
    return _assemble(parts["points"], {p: _read_part(spark, folder, p, parts[p]) for p in PARTS})


def bucket_count(index: BoxIndex) -> int:
    """Buckets for an index: the session's shuffle partitions, or more where one would hold too many rows."""
    session = int(index.points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(session, -(-index.rows // ROWS_PER_PARTITION))


def _describe(index: BoxIndex, params: dict, buckets: int | None = None) -> dict:
    return {
        "saved": uuid.uuid4().hex,
        "buckets": buckets,
        "params": params,
        "dims": list(index.dims),
        "rows": index.rows,
        "n_blocks": index.n_blocks,
        "segment_blocks": index.segment_blocks,
        "degree": index.degree,
        "id_col": index.id_col,
        "cluster": index.cluster,
    }


def _save_part(df: DataFrame, path: str, part: str, stored: dict) -> None:
    """Replace one part. Its description goes away first and comes back last."""
    if part in _read_metas(df.sparkSession, path):
        _write_meta(df.sparkSession, path, part, None)
    layout = uuid.uuid4().hex
    if part == "points" and stored.get("buckets"):
        _write_buckets(df, f"{path}/{part}", layout, stored["buckets"])
        described = {**stored, "layout": layout, "bucket_key": BUCKET_KEY, "schema": df.schema.jsonValue()}
        _write_meta(df.sparkSession, path, part, described)
        return
    if part == "points":
        rows = df.sortWithinPartitions("segment", "ordinal").write.partitionBy("segment")
    elif part == "blocks":
        rows = df.sortWithinPartitions("block").write
    else:
        rows = df.sortWithinPartitions("level", "node").write
    rows.mode("overwrite").parquet(f"{path}/{part}")
    _write_meta(df.sparkSession, path, part, {**stored, "schema": df.schema.jsonValue()})


def _write_buckets(df: DataFrame, folder: str, layout: str, n: int) -> None:
    """Rows by the hash of their segment, one file a bucket, in ordinal order inside it."""
    rows = df.repartition(n, BUCKET_KEY).write.bucketBy(n, BUCKET_KEY).sortBy(*BLOCK_KEYS, "ordinal")
    rows.mode("overwrite").option("path", folder).format("parquet").saveAsTable(TABLE + layout)


def _bucketed(spark: SparkSession, folder: str, meta: dict, schema: T.StructType) -> DataFrame:
    """Make the buckets at `folder` known to this session's catalogue; the files stay where they are.

    Joins by segment and block find the points in place where Spark may take rows that are laid out by some of a join's
    columns as they are, which this session is told.
    """
    spark.conf.set(PARTIAL_KEYS, "false")
    name = TABLE + meta["layout"]
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        keys = ", ".join(BLOCK_KEYS)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({meta.get('bucket_key', keys)}) SORTED BY ({keys}, ordinal)"
            f" INTO {meta['buckets']} BUCKETS LOCATION '{folder}'"
        )
    return spark.table(name)


def _description(spark: SparkSession, content: dict | None) -> DataFrame:
    return spark.range(1, numPartitions=1).select(F.lit(json.dumps(content, sort_keys=True)).alias("content"))


def _write_meta(spark: SparkSession, path: str, part: str, content: dict | None) -> None:
    """Describe a part, or mark it as unfinished with None."""
    _description(spark, content).write.mode("overwrite").parquet(f"{path}/{META}/part={part}")


def _read_metas(spark: SparkSession, path: str) -> dict[str, dict]:
    """Descriptions of the finished parts, one row each."""
    try:
        rows = spark.read.schema("content string, part string").parquet(f"{path}/{META}").collect()
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    found = {r.part: json.loads(r.content) for r in rows}
    return {part: content for part, content in found.items() if content is not None}


def _read_part(spark: SparkSession, path: str, part: str, meta: dict) -> DataFrame:
    schema = T.StructType.fromJson(meta["schema"])
    if meta.get("layout"):
        return _bucketed(spark, f"{path}/{part}", meta, schema).select(*schema.names)
    return spark.read.schema(schema).parquet(f"{path}/{part}").select(*schema.names)


def load_index(spark: SparkSession, path: str) -> BoxIndex:
    """Open a saved index with all rows that have been inserted beside it; `compact` makes that cheap again."""
    metas = _read_metas(spark, path)
    version = folder, parts, _ = _current(metas, path)
    index, delta = _stored(spark, folder, parts), delta_rows(spark, path, metas)
    if delta is None:
        return index
    files, last = sorted(delta.inputFiles()), _last_batches(delta)
    bigger = _with_new(index, delta)
    return replace(bigger, taken=Taken(version, files, last, bigger is not index))


def _assemble(meta: dict, tables: dict[str, DataFrame]) -> BoxIndex:
    return BoxIndex(
        **tables,
        dims=tuple(meta["dims"]),
        rows=meta["rows"],
        n_blocks=meta["n_blocks"],
        segment_blocks=meta["segment_blocks"],
        degree=meta["degree"],
        id_col=meta["id_col"],
        cluster=meta["cluster"],
        by_segment=meta.get("bucket_key") == BUCKET_KEY,
    )


def open_index(
    rows: DataFrame,
    path: str,
    dims: Sequence[str],
    source: str,
    degree: int = DEGREE,
    cluster: str = "hilbert",
    id_col: str = "pid",
    force_rebuild: bool = False,
    buckets: int | None = None,
    **order_options,
) -> BoxIndex:
    """Load the index at `path` if it was built with exactly these parameters, else build and save it.

    Compared are source name, dimensions, row count, degree, cluster type and the order options, the number of
    partitions among them. If only the blocks or nodes are missing or differ, they are made again from the stored
    points. Rows inserted beside the index are part of it. `buckets` as in `save_index`.
    """
    spark = rows.sparkSession
    params = {
        "source": source,
        "dims": list(dims),
        "rows": rows.count(),
        "degree": degree,
        "cluster": cluster,
        "id_col": id_col,
        "order": {k: order_options[k] for k in sorted(order_options)},
    }
    if buckets is not None:
        params["buckets"] = buckets
    metas = {} if force_rebuild else _read_metas(spark, path)
    latest = _latest(metas)
    if latest is not None and latest["parts"]["points"]["params"] == params:
        return load_index(spark, path)
    fitting = {part: meta for part, meta in metas.items() if meta["params"] == params}
    if "points" not in fitting:
        with released(spark):
            save_index(build_index(rows, dims, degree, cluster, id_col, **order_options), path, params, buckets)
        return load_index(spark, path)
    stored = fitting["points"]
    described = {k: v for k, v in stored.items() if k not in ("schema", "layout", "bucket_key")}
    if "blocks" not in fitting:
        points = _read_part(spark, path, "points", stored)
        summary = with_segment(block_summary(points, dims), stored["segment_blocks"])
        _save_part(summary, path, "blocks", described)
    if "blocks" not in fitting or "nodes" not in fitting:
        blocks = spark.read.parquet(f"{path}/blocks")
        _save_part(build_levels(blocks, dims, degree, stored["n_blocks"]), path, "nodes", described)
        fitting = _read_metas(spark, path)
    index, delta = _stored(spark, path, fitting), delta_rows(spark, path)
    return index if delta is None else _with_new(index, delta)
