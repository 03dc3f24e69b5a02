"""Co-change counts kept up to date from a stream of commits.

Counts, supports and sums of decayed times add up over commits, so each batch is aggregated on its own and appended;
readers sum the parts. A batch that is run again replaces its own part, so restarts count nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gneiss.functions import stats
from gneiss.operators import temporal

SCHEMA = "sha string, ts long, author string, path string"


def parts_of(commits: DataFrame, as_of: float, max_files: int = 400) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, files, totals) of some commits, each whole in them."""
    t = temporal.touches(commits)
    p = temporal.cochange_pairs(t, max_files=max_files).select("path_a", "path_b", "n_ab", "support")
    f = t.groupBy("path").agg(F.count("*").alias("n"), F.sum(stats.decayed(F.col("ts"), as_of)).alias("churn"))
    return p, f, commits.agg(F.count_distinct("sha").alias("commits"))


def start(stream: DataFrame, folder: str, checkpoint: str, as_of: float, **trigger):
    """Aggregate each micro-batch of a stream of SCHEMA rows into folder/{pairs,files,totals}/batch=N."""

    def merge(batch: DataFrame, number: int) -> None:
        for name, part in zip(("pairs", "files", "totals"), parts_of(batch.persist(), as_of)):
            part.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Co-change pairs of all batches, with lift and the G statistic."""
    p = spark.read.parquet(f"{folder}/pairs").groupBy("path_a", "path_b").agg(F.sum("n_ab").alias("n_ab"), F.sum("support").alias("support"))
    f = spark.read.parquet(f"{folder}/files").groupBy("path").agg(F.sum("n").alias("n"))
    total = spark.read.parquet(f"{folder}/totals").agg(F.sum("commits").alias("_total"))
    j = p.join(f.toDF("path_a", "n_a"), "path_a").join(f.toDF("path_b", "n_b"), "path_b").crossJoin(F.broadcast(total))
    c = [F.col(x) for x in ("n_ab", "n_a", "n_b", "_total")]
    return j.select("path_a", "path_b", "n_ab", "support", "n_a", "n_b", stats.lift(*c).alias("lift"), stats.g_statistic(*c).alias("g_stat"))


def churn(spark: SparkSession, folder: str, was: float, as_of: float, half_life_days: float = 90.0) -> DataFrame:
    """Churn of all batches, decayed from the time they were summed for to another."""
    f = 0.5 ** ((as_of - was) / (half_life_days * 86400.0))
    return spark.read.parquet(f"{folder}/files").groupBy("path").agg((F.sum("churn") * f).alias("churn"))
