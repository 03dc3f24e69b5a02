"""The roles of a code history over the driver's tables: an order is a commit, a supplier a file, a nation an author."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = 996_624_000  # 2001-08-01, the last order date


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def commits(spark: SparkSession, sf: str) -> DataFrame:
    """(sha, ts, author, path) from lineitem, orders, customer and nation."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_suppkey").alias("path")).distinct()
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sha"), "o_custkey", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)").alias("ts"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("author"))
    authored = o.join(c, "o_custkey").join(F.broadcast(n), "c_nationkey").select("sha", "ts", "author")
    return li.join(authored, "sha").select("sha", "ts", "author", "path")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """(path, lines): distinct parts of a supplier."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("path")).agg(F.count_distinct("l_partkey").alias("lines"))


def part_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst, weight): suppliers (keys x 2) and parts (keys x 2 + 1), weight the number of lines."""
    li = table(spark, sf, "lineitem")
    return li.groupBy((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).agg(F.count("*").cast("double").alias("weight"))


def part_lines(spark: SparkSession, sf: str) -> DataFrame:
    """part_edges line by line, each with a weight of 1."""
    return table(spark, sf, "lineitem").select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"), F.lit(1.0).alias("weight"))
