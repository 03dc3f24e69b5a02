"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without white space (\\x20, \\x09-\\x0D) at both ends and with A-Z in lower case. What is known of the keys
seen so far, in how many rows they occur and the largest id among these, lies in runs of 128-bit hashes. A level is one table, bucketed and sorted by hash, that
holds up to `fan` runs: a new batch is aggregated, merge-anti-joined with the levels (what can change no decision any more is left out:
the key occurs often enough already, in a row with an id as large), and added to the lowest level as a run of its own. A full level
is compacted into one run of the next. Buckets are the same everywhere, so neither joins with runs nor compaction shuffle them.

In the end the keys in at least `need` rows lose all their lines but those of the largest id. Keys that hold a ten-thousandth of all lines or more,
ten thousand at most, are joined by broadcast, the others by hash, so that no task gets a hot line's rows; texts are joined with
the hashes to drop by their row's own number.

Defined cases: null and empty texts are one empty line, which is kept; lines with keys below `least` code points always stay. Very long
texts are split whole. A null id is smaller than all others. Rows are what is counted: rows that repeat an id and text count each, and if that id is
the largest, all of them keep the line. Empty tables give no rows. Extra columns, whatever their names, are kept.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import keyed, numbered, scratch_path, small_batches, stored

WHITE = " \t\n\x0b\x0c\r"
#: A key with one of so many lines, or more, is hot.
HOT = 10_000


def line_hash(line: str, least: int) -> bytes | None:
    """16 bytes of the line's key; none if the key is shorter than `least` code points."""
    key = line.strip(WHITE)
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= least else None


def line_hashes(docs: DataFrame, row: str, doc_id: str, text: str, least: int) -> DataFrame:
    """(hi, lo, row, doc), a row for each distinct key of a row's lines."""

    def work(batches):
        for batch in batches:
            found = [{h for line in (t or "").split("\n") if (h := line_hash(line, least))} for t in batch.column("text").to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            hashes = np.frombuffer(b"".join(h for f in found for h in f), ">i8").astype(np.int64).reshape(-1, 2)
            own = batch.select(["row", "doc"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy()), *own.columns], ["hi", "lo", "row", "doc"])

    d = docs.select(F.col(row).alias("row"), F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    return d.mapInArrow(work, f"hi long, lo long, row long, doc {d.schema['doc'].dataType.simpleString()}")


class LineRuns:
    """Levels of runs (hi, lo, n, last), n the rows that hold a key and last the largest id among them."""

    def __init__(self, spark: SparkSession, need: int = 3, fan: int = 4):
        self.spark, self.need, self.fan = spark, need, fan
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[str, int] | None] = []

    def _write(self, run: DataFrame, level: int) -> None:
        name, runs = self.levels[level] or (f"gneiss_lines_{uuid.uuid4().hex}", 0)
        writer = run.write.bucketBy(self.buckets, "hi", "lo").sortBy("hi", "lo").format("parquet").mode("append")
        (writer if runs else writer.option("path", scratch_path(self.spark, name))).saveAsTable(name)
        self.levels[level] = name, runs + 1

    def _compact(self, level: int, into: int) -> None:
        """Merge a level's runs into one run of another level."""
        name, self.levels[level] = self.levels[level][0], None
        self._write(_merged(self.spark.table(name)), into)
        self.spark.sql(f"drop table {name}")

    def add(self, lines: DataFrame) -> None:
        """Add a batch (hi, lo, doc, ...), a row for each key of each of its rows."""
        new = lines.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("doc").alias("last"))
        for level in filter(None, self.levels):
            known = self.spark.table(level[0]).where(F.col("n") >= self.need).select("hi", "lo", F.col("last").alias("known"))
            same = (new.hi == known.hi) & (new.lo == known.lo) & (new["last"].isNull() | (known.known >= new["last"]))
            new = new.join(known, same, "left_anti")
        level, self.levels = 0, self.levels or [None]
        self._write(new, level)
        while self.levels[level][1] == self.fan:
            if level + 1 == len(self.levels):
                self.levels.append(None)
            self._compact(level, level + 1)
            level += 1

    def repeated(self) -> DataFrame:
        """(hi, lo, last) of the keys in at least `need` rows."""
        # a union of tables would lose their buckets: lower levels become runs of the highest one
        live = [k for k, level in enumerate(self.levels) if level]
        for k in live[:-1]:
            self._compact(k, live[-1])
        return _merged(self.spark.table(self.levels[live[-1]][0])).where(F.col("n") >= self.need).drop("n")

    def drop(self) -> None:
        """Forget the tables; their files go with the session."""
        for level in filter(None, self.levels):
            self.spark.sql(f"drop table if exists {level[0]}")
        self.levels = []


def _merged(runs: DataFrame) -> DataFrame:
    return runs.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def to_drop(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(row, hashes) of the keys that a row loses."""
    total = lines.count()
    hot = lines.groupBy("hi", "lo").agg(F.count("*").alias("n")).where(F.col("n") * HOT >= total).select("hi", "lo")
    repeated = stored(repeated.join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["hi", "lo"], "left"), "repeated")
    few = repeated.where("hot").drop("hot")
    rest = lines.join(F.broadcast(few.select("hi", "lo")), ["hi", "lo"], "left_anti").join(repeated.where("hot is null").drop("hot"), ["hi", "lo"])
    lost = lines.join(F.broadcast(few), ["hi", "lo"]).unionByName(rest).where(~F.col("doc").eqNullSafe(F.col("last")))
    return lost.groupBy("row").agg(F.collect_list(F.struct("hi", "lo")).alias("hashes"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, need: int = 3, batches: int = 4, fan: int = 2) -> DataFrame:
    """docs with n_lines and n_dropped (long) and kept, the lines that stay joined by \\n, in place of columns of these names."""
    spark = docs.sparkSession
    small_batches(spark)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
    d, name = numbered(docs)
    d = keyed(d, "row")
    lines = line_hashes(d, "row", name[id_col], name[text_col], least)
    lines = stored(lines.withColumn("batch", F.pmod(F.xxhash64(F.lit("batch"), "row"), F.lit(batches))), "lines")
    runs = LineRuns(spark, need, fan)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k).drop("batch"))
    dropped = stored(to_drop(lines.drop("batch"), runs.repeated()), "dropped")
    runs.drop()
    own = [name[c] for c in names]
    d = d.select(*own, "row", F.col(name[text_col]).alias("text")).join(dropped.hint("shuffle_hash"), "row", "left").drop("row")

    def work(parts):
        for batch in parts:
            kept, sizes, gone = [], [], []
            texts = batch.column("text").to_pylist()
            for text, hashes in zip(texts, batch.column("hashes")):
                found = (text or "").split("\n")
                left = found
                if hashes.is_valid:
                    lost = {h["hi"].to_bytes(8, "big", signed=True) + h["lo"].to_bytes(8, "big", signed=True) for h in hashes.as_py()}
                    left = [line for line in found if line_hash(line, least) not in lost]
                kept.append("\n".join(left))
                sizes.append(len(found))
                gone.append(len(found) - len(left))
            new = [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *new], [*own, "n_lines", "n_dropped", "kept"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(own).schema), "n_lines long, n_dropped long, kept string"])
    return d.mapInArrow(work, schema).toDF(*names, "n_lines", "n_dropped", "kept")
