"""Helpers shared by the training-data operators."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_names = itertools.count()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of a batch between the JVM and Python; whole texts and shingle sets are wide. A wider row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of Arrow batches, unless the session has smaller bounds."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int(re.match(r"-?\d+", spark.conf.get(name))[0])
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))
    # workers give memory back that they have freed, and don't keep it for each thread
    for name, value in (("MALLOC_ARENA_MAX", "1"), ("MALLOC_TRIM_THRESHOLD_", str(16 << 20)), ("MALLOC_MMAP_THRESHOLD_", str(4 << 20)), ("ARROW_DEFAULT_MEMORY_POOL", "system")):
        spark.sparkContext.environment.setdefault(name, value)


# ---------------------------------------------------------------- shared files


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one if all runs in this process (tests), else an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gneiss-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/gneiss-{uuid.uuid4().hex}-{next(_names)}-{name}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gneiss_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a stored() table that nothing reads any more."""
    path = getattr(df, "_gneiss_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def keyed(docs: DataFrame, name: str = "_row") -> DataFrame:
    """docs with a number of the row's own: a 64-bit hash of its place in its file; where rows have no place, they are stored with a number."""
    try:
        return docs.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(name))
    except AnalysisException:
        return stored(docs.withColumn(name, F.monotonically_increasing_id()), "keyed")


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ... and their names by the old ones, so that no new column can clash with one of them."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


# ---------------------------------------------------------------- words and hashes

MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words (bytes); forgets all when it is full, so its memory is bounded."""

    limit = 30_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_word_hashes = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    m = len(h) - n + 1
    if m <= 0:
        return h[:0]
    out = h[:m].copy()
    for i in range(1, n):
        out = mix(out * MIX + np.uint64(i)) + h[i : i + m]
    return mix(out)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text of fewer words is one shingle."""
    h = hashes_of(words_of(text))
    if not len(h):
        return h
    return np.unique(gram_hashes(h, min(size, len(h))))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---------------------------------------------------------------- order within large groups


def running(df: DataFrame, groups: list[str], order: list[str], value: str, rows: int = 2048) -> DataFrame:
    """df with `before`, the sum of value over the earlier rows of the group, in the order given by `place`, a 64-bit hash that the
    caller has put into the column, then by the columns of order. The caller also says, in the column `group_rows`, how many rows the group
    has; a join here that finds it out would deal whole groups to tasks.

    A group may hold any share of the rows: it is cut into buckets of about `rows` rows by the leading bits
    of place; windows run within a bucket and over the table of bucket sums, never over a whole group. So places must
    be spread evenly within a group, whatever the group is.
    """
    bits = F.ceil(F.log2(F.greatest(F.col("group_rows") / F.lit(rows), F.lit(1.0)))).cast("int")
    cut = df.withColumn("_bits", F.least(bits, F.lit(40))).withColumn("_b", F.expr("shiftrightunsigned(shiftrightunsigned(place, 23), 41 - _bits)"))
    sums = cut.groupBy(*groups, "_b").agg(F.sum(value).cast("long").alias("_s"))
    w = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*groups, "_b", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_base"))
    w = Window.partitionBy(*groups, "_b").orderBy("place", *order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumn("_in", F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))
    out = out.join(sums, [*groups, "_b"])
    return out.withColumn("before", F.col("_base") + F.col("_in")).drop("_b", "_bits", "_base", "_in", "group_rows")


def unrolled(df: DataFrame, first: str, last: str, number: str, most: int, step: int = 1 << 16) -> DataFrame:
    """df with a row for each number from first to last. most: the length of the longest interval; where it is above `step`, intervals
    are cut and dealt out before they are unrolled, so that no task makes all rows of a long one."""
    if most <= step:
        return df.withColumn(number, F.explode(F.sequence(F.col(first), F.col(last))))
    chunk = df.withColumn("_c", F.explode(F.sequence(F.col(first), F.col(last), F.lit(step)))).repartition("_c", first)
    return chunk.withColumn(number, F.explode(F.sequence(F.col("_c"), F.least(F.col("_c") + (step - 1), F.col(last))))).drop("_c")


# ---------------------------------------------------------------- pairs


def confirm(pairs: DataFrame, payload: DataFrame, test: Callable[[list[bytes], list[bytes]], list[bool]]) -> DataFrame:
    """The pairs (a, b) of classes whose payloads (cls, data) pass the test."""

    def run(batches):
        for batch in batches:
            keep = pa.array(test(batch.column("da").to_pylist(), batch.column("db").to_pylist()), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    both = pairs.join(payload.toDF("a", "da"), "a").join(payload.toDF("b", "db"), "b")
    return both.select("a", "b", "da", "db").mapInArrow(run, "a long, b long")


#: Bytes of payloads of a block.
ROOM = 4 << 20


def across(near: DataFrame, payload: DataFrame, linked: Callable[[list[bytes]], np.ndarray], block: int, room: int = ROOM) -> DataFrame:
    """Links (a, b) between members of a neighbourhood that lie in different components, as forests.

    near: (first, cls, root, n), n the bytes of the member's payload (cls, data). linked gives a symmetric boolean matrix for a list of
    payloads. The rows of the largest component of a neighbourhood are dealt to blocks, the others to blocks of their own; a unit is a
    pair of blocks with at least one of the latter, or some neighbourhoods of one block each. All is planned on numbers; payloads,
    which are wide, are joined last, so a neighbourhood may hold any share of the rows.
    """
    by_root = near.groupBy("first", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    plan = by_root.groupBy("first").agg(F.sum("c").alias("m"), F.sum("s").alias("s"), F.max(F.struct("c", "root", "s")).alias("big"), F.count("*").alias("roots")).where("roots > 1")
    parts = lambda c, s: F.ceil(F.greatest(c / block, s / room, F.lit(1e-9))).cast("int")
    plan = plan.select("first", F.col("big.root").alias("major"), parts(F.col("big.c"), F.col("big.s")).alias("nb"), parts(F.col("m") - F.col("big.c"), F.col("s") - F.col("big.s")).alias("no"), "s")
    plan = stored(plan, "plan")
    small = (F.col("nb") == 1) & (F.col("no") == 1)
    units = max(1, -(-(plan.where(small).agg(F.sum("s")).first()[0] or 0) // room))
    rows = near.join(plan.drop("s"), "first").withColumn("is_major", F.col("root") == F.col("major"))
    own = F.expr("cast(pmod(xxhash64(cls, 77), if(is_major, nb, no)) as int)")
    # x: block of the largest component, or -1 - a block of others; y: block of others
    rows = rows.withColumn("own", own).withColumn("u", F.explode(F.expr(
        "if(is_major, transform(sequence(0, no - 1), y -> struct(own as x, y as y)),"
        " concat(transform(sequence(0, nb - 1), x -> struct(x as x, own as y)),"
        " transform(filter(sequence(0, no - 1), o -> o <> own), o -> struct(-1 - least(o, own) as x, greatest(o, own) as y))))")))  # fmt: skip
    several = F.pmod(F.xxhash64("first"), F.lit(units))
    rows = rows.withColumn("unit", F.when(small, several).otherwise(F.xxhash64("first", "u").bitwiseOR(F.lit(1 << 62))))
    rows = rows.select("unit", "first", F.col("u.x").alias("x"), F.col("u.y").alias("y"), "cls", "root").join(payload.toDF("cls", "data"), "cls")

    def run(t: pa.Table) -> pa.Table:
        keys = [t[c].to_numpy() for c in ("y", "x", "first")]
        order = np.lexsort(keys)
        keys = [k[order] for k in keys]
        t = t.take(pa.array(order))
        new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
        cls, root, data, out = t["cls"].to_numpy(), t["root"].to_numpy(), t["data"], []
        for i, j in zip(new.tolist(), [*new[1:].tolist(), t.num_rows]):
            near = linked(data.slice(i, j - i).to_pylist()) & (root[i:j, None] != root[None, i:j])
            if near.any():
                out += forest(near, cls[i:j])
        return pa.table({"a": pa.array([e[0] for e in out], pa.int64()), "b": pa.array([e[1] for e in out], pa.int64())})

    return rows.groupBy("unit").applyInArrow(run, "a long, b long")


# ---------------------------------------------------------------- connected components


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each end of an edge of edges (a long, b long); root is the smallest node that is reachable.

    Alternating large stars and small stars. Minima are aggregated before they are joined; the join deals a hub's edges out only as far as adaptive
    execution splits its partition. Forests of 200,000 edges shrink hubs before; each round is stored in the shared folder.
    """
    spark = edges.sparkSession
    now = stored(_forest(edges.select("a", "b").where("a <> b")), "edges")
    nodes = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = stored(_forest(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()), "edges")
        # settled when each node has one edge and no target of an edge has one itself
        left = new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        left = left or new.join(new.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        discard(now)
        now = new
        if not left:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _forest(edges: DataFrame) -> DataFrame:
    """A spanning forest of each 200,000 edges of a partition, as stars around their smallest nodes."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 200_000:
                yield stars(held)
                held, rows = [], 0
        if rows:
            yield stars(held)

    def stars(batches):
        t = pa.Table.from_batches(batches)
        a, b = union_find(t["a"].to_numpy(), t["b"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes that are no roots; a root is the smallest node of its component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(ids)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array(parent, np.int64)
    while len(root) and (root[root] != root).any():
        root = root[root]
    moved = root != np.arange(len(ids))
    return ids[moved].astype(np.int64), ids[root[moved]].astype(np.int64)


def forest(linked: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Star edges (id, smallest id) of the components of a symmetric boolean matrix."""
    n, left, out = len(ids), np.ones(len(ids), bool), []
    for i in range(n):
        if not left[i]:
            continue
        left[i] = False
        part, edge = [i], [i]
        while edge:
            j = edge.pop()
            new = np.flatnonzero(linked[j] & left)
            if len(new):
                left[new] = False
                part += new.tolist()
                edge += new.tolist()
        if len(part) > 1:
            own = ids[part]
            root = own.min()
            out += [(int(x), int(root)) for x in own if x != root]
    return out
