"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one if all runs in this process (tests), else an error."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gneiss-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/gneiss-{uuid.uuid4().hex}-{name}"
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def truncate(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def rewritten(df: DataFrame, compression: str | None = None) -> DataFrame:
    """df, written to the shared folder and read again. Unlike a checkpoint it forgets the size that was estimated for the plan: where each round
    joins what the last one gave with itself, these estimates multiply until planning takes longer than the work."""
    path = scratch(df.sparkSession, "rows")
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._gneiss_path = path
    return out


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """df, dealt out by a hash of its keys and stored as so many buckets: a join with rows that are dealt out likewise moves none of it."""
    spark, name = df.sparkSession, f"gneiss_{uuid.uuid4().hex}"
    path = scratch(spark, "dealt")
    df.repartition(parts, *keys).write.bucketBy(parts, *keys).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._gneiss_path, out._gneiss_table = path, name
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of rewritten and dealt frames that nothing reads any more."""
    for df in frames:
        sc, path = df.sparkSession.sparkContext, getattr(df, "_gneiss_path", None)
        if hasattr(df, "_gneiss_table"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._gneiss_table}")
        if path:
            hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the query that wrote them, not when the driver next collects garbage; tasks that write one bucket don't sort it first."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "1"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
