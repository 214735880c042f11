"""Points and boxes derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from boxquery.session import folders

DIMS = ("x", "y", "z")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream. Only this table is listed, whether it is a file or a folder, partitioned or not.

    Spark takes the path of a folder, or a pattern that files fit; not the path of one file.
    """
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(table(spark, sf_dir, "events").schema)
    return reader.parquet(path if folders(spark, f"{path}/*") else f"{sf_dir}/events.parque[t]")


def points3(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter(where).selectExpr(
        "(((l_orderkey * 100000 + l_partkey) * 1000 + l_suppkey) * 10 + l_linenumber) * 100"
        " + CAST(l_quantity AS BIGINT) AS pid",
        "CAST((l_quantity - 1D) / 49D AS FLOAT) AS x",
        "CAST(l_extendedprice / 105000D AS FLOAT) AS y",
        "CAST(l_discount / 0.1D AS FLOAT) AS z",
    )


def boxes64(spark: SparkSession) -> DataFrame:
    side = "CAST(0.125 AS FLOAT)"
    lower = spark.range(64).selectExpr(
        "id AS qid",
        "CAST(((id * 37) % 56) / 64D AS FLOAT) AS lx",
        "CAST(((id * 23) % 56) / 64D AS FLOAT) AS ly",
        "CAST(((id * 11) % 56) / 64D AS FLOAT) AS lz",
    )
    return lower.selectExpr("*", f"lx + {side} AS hx", f"ly + {side} AS hy", f"lz + {side} AS hz")


def part_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box per part, of three different sizes, so that the number of boxes grows with the data."""
    return _boxes_by_key(table(spark, sf_dir, "part"), "p_partkey")


def supplier_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes_by_key(table(spark, sf_dir, "supplier"), "s_suppkey")


def _boxes_by_key(rows: DataFrame, key: str) -> DataFrame:
    return rows.selectExpr(
        f"{key} AS qid",
        f"CAST(({key} * 37 % 101) / 128D AS FLOAT) AS lx",
        f"CAST(({key} * 23 % 113) / 128D AS FLOAT) AS ly",
        f"CAST(({key} * 11 % 97) / 128D AS FLOAT) AS lz",
        f"CAST(power(2D, -4 - {key} % 3) AS FLOAT) AS side",
    ).selectExpr("qid", "lx", "ly", "lz", "lx + side AS hx", "ly + side AS hy", "lz + side AS hz")


def events3(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events as points: time, user and value. The ids are negative, so they differ from points3."""
    users = table(spark, sf_dir, "customer").agg((F.count(F.lit(1)) / F.lit(10.0)).alias("users"))
    rows = table(spark, sf_dir, "events") if events is None else events
    return rows.join(F.broadcast(users)).selectExpr(
        "-1 - event_id AS pid",
        "CAST((unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(TIMESTAMP '2024-01-01 00:00:00'))"
        " / (30D * 86400D * 1000000D) AS FLOAT) AS x",
        "CAST(user_id / users AS FLOAT) AS y",
        "CAST(value / 1000D AS FLOAT) AS z",
    )


def flat_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-dimensional query boxes, one per part."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS qid",
        "CAST((p_partkey * 37 % 101) / 128D AS FLOAT) AS la",
        "CAST((p_partkey * 23 % 113) / 128D AS FLOAT) AS lb",
        "CAST((p_partkey * 37 % 101 + 2) / 128D AS FLOAT) AS ha",
        "CAST((p_partkey * 23 % 113 + 2) / 128D AS FLOAT) AS hb",
    )


def order_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-dimensional boxes with real extents."""
    customers = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).cast("double").alias("customers"))
    lower = (
        table(spark, sf_dir, "orders")
        .join(F.broadcast(customers))
        .selectExpr(
            "o_orderkey AS pid",
            "CAST(o_custkey / customers AS FLOAT) AS la",
            "CAST(o_totalprice / 500000D AS FLOAT) AS lb",
        )
    )
    side = "CAST(0.01D AS FLOAT)"
    return lower.selectExpr(
        "*", f"least(la + {side}, CAST(1 AS FLOAT)) AS ha", f"least(lb + {side}, CAST(1 AS FLOAT)) AS hb"
    )
