"""Approximate search over code vectors: a neighbour graph as edges, and a beam that walks over it for all queries at once.

Building. A bounded number of rows, drawn by a hash, are pivots and sent to all tasks. Rows are sorted by their nearest pivot, then by their second
and third, and windows over each order compare rows that lie together, so rows that repeat a vector are no block of their own. The best
`degree` are kept; then rounds of neighbour joins bring a node's neighbours, near and reverse ones, together and compare these. Pivots are joined to some
rows of their cells, drawn by a hash: they lead into groups that hold no pivot.

Searching. A query meets the pivots, then the neighbours of the best `beam` nodes that it has met and not yet opened, until all of its best are opened.
All queries take a step in one join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gneiss.operators.dense import dot, stacked
from gneiss.plans.checkpoint import rewritten

DEGREE, BEAM, PIVOTS, WINDOW, ORDERS = 12, 32, 1024, 128, 3
PAIRS = "src long, dst long, score double"


def nearest_pairs(ids: np.ndarray, x: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst, score): of each row the `degree` others with the largest products."""
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    k = min(degree, len(ids) - 1)
    if k < 1:
        return ids[:0], ids[:0], np.zeros(0)
    at = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[at].ravel(), np.take_along_axis(score, at, 1).ravel()


def _batch(src: list, dst: list, score: list) -> pa.RecordBatch:
    cat = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
    return pa.RecordBatch.from_arrays([cat(src, pa.int64()), cat(dst, pa.int64()), cat(score, pa.float64())], ["src", "dst", "score"])


def _best(pairs: DataFrame, degree: int, by: str = "src") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("score"), "src", "dst")
    once = pairs.where("src <> dst").groupBy("src", "dst").agg(F.max("score").alias("score"))
    return once.withColumn("r", F.row_number().over(w)).where(F.col("r") <= degree).drop("r")


def _windows(rows: DataFrame, degree: int, width: int = WINDOW) -> DataFrame:
    """Pairs of rows (idx, embedding) that lie together in the order of their tasks: windows of `width` rows, each over half of the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = np.zeros(0, np.int64), None
        for b in batches:
            src, dst, score = [], [], []
            for at, new in stacked(b.column(1)):
                ids = np.concatenate([ids, b.column(0).to_numpy()[at]])
                x = new if x is None else np.concatenate([x, new])
            while x is not None and len(ids) >= width:
                for out, part in zip((src, dst, score), nearest_pairs(ids[:width], x[:width], degree)):
                    out.append(part)
                ids, x = ids[width // 2 :], x[width // 2 :]
            yield _batch(src, dst, score)
        if x is not None and len(ids) > 1:
            yield _batch(*([part] for part in nearest_pairs(ids, x, degree)))

    return rows.select("idx", "embedding").mapInArrow(run, PAIRS)


@dataclass
class NeighbourGraph:
    vectors: DataFrame  # idx, embedding
    edges: DataFrame  # src, dst
    pivots: tuple[np.ndarray, np.ndarray]  # ids, vectors

    def start(self, queries: DataFrame, beam: int) -> DataFrame:
        """(query_id, idx, score) of the best pivots of each query."""
        sent = queries.sparkSession.sparkContext.broadcast(self.pivots)
        kind = queries.schema["query_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, p = sent.value
            for b in batches:
                for at, q in stacked(b.column(1)):
                    if len(ids) and q.shape[1] == p.shape[1]:
                        score, k = q @ p.T, min(beam, len(ids))
                        top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                        own = b.column(0).take(pa.array(np.repeat(at, k)))
                        yield pa.RecordBatch.from_arrays([own, pa.array(ids[top].ravel()), pa.array(np.take_along_axis(score, top, 1).ravel())], ["query_id", "idx", "score"])

        return queries.select("query_id", "query_vec").mapInArrow(run, f"query_id {kind}, idx long, score double")

    def walk(self, queries: DataFrame, beam: int = BEAM, steps: int = 40) -> DataFrame:
        """(query_id, idx, score) of all nodes that each query (query_id, query_vec) has met, but pivots that were not among its best."""
        asked = queries.where("query_vec is not null").select("query_id", "query_vec")
        met = rewritten(self.start(asked, beam).withColumn("open", F.lit(True)))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "idx")
        for _ in range(steps):
            front = rewritten(met.withColumn("r", F.row_number().over(w)).where((F.col("r") <= beam) & F.col("open")).select("query_id", "idx"))
            if not front.limit(1).count():
                break
            new = front.join(self.edges, front["idx"] == self.edges["src"]).select("query_id", F.col("dst").alias("idx")).distinct().join(met, ["query_id", "idx"], "left_anti")
            new = new.join(self.vectors, "idx").join(asked, "query_id").select("query_id", "idx", dot("query_vec", "embedding").alias("score"), F.lit(True).alias("open"))
            shut = front.withColumn("shut", F.lit(True))
            old = met.join(shut, ["query_id", "idx"], "left").select("query_id", "idx", "score", (F.col("open") & F.col("shut").isNull()).alias("open"))
            met = rewritten(old.unionByName(new))
        return met.select("query_id", "idx", "score")

    def search(self, queries: DataFrame, k: int = 10, beam: int = BEAM) -> DataFrame:
        """(query_id, idx, score, rank): the k best that the walk has met."""
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "idx")
        return self.walk(queries, max(beam, k)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def save(self, epoch) -> None:
        epoch.write("neighbours", self.edges.repartitionByRange("src").sortWithinPartitions("src"))


def build(vectors: DataFrame, degree: int = DEGREE, pivots: int = PIVOTS, joins: int = 2) -> NeighbourGraph:
    """The graph of (idx, embedding), vectors of one length; null and empty ones are left out. At most `pivots` rows are pivots, and a row in 32."""
    rows = rewritten(vectors.where("embedding is not null and size(embedding) > 0").select(F.col("idx").cast("long").alias("idx"), "embedding"))
    some = rows.orderBy(F.xxhash64("idx"), "idx").limit(max(1, min(pivots, rows.count() // 32))).collect()
    if len({len(r["embedding"]) for r in some}) > 1:
        raise ValueError("vectors of one graph have one length")
    held = np.array([r["idx"] for r in some], np.int64), np.array([r["embedding"] for r in some], np.float64)
    sent = rows.sparkSession.sparkContext.broadcast(held)
    orders = min(ORDERS, max(1, len(some)))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, p = sent.value
        for b in batches:
            for at, x in stacked(b.column(1)):
                score = x @ p.T
                top = np.argsort(-score, axis=1, kind="stable")[:, :orders]
                own = b.take(pa.array(at))
                for k in range(orders):
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(at), k, np.int32)), pa.array(ids[top[:, k]]), pa.array(score[np.arange(len(at)), top[:, k]])], ["idx", "embedding", "k", "cell", "near"])

    kind = rows.schema["embedding"].dataType.simpleString()
    celled = rewritten(rows.mapInArrow(cells, f"idx long, embedding {kind}, k int, cell long, near double"))
    found: DataFrame | None = None
    for k in range(orders if some else 0):
        pairs = _windows(celled.where(F.col("k") == k).repartitionByRange("cell", "near", "idx").sortWithinPartitions("cell", "near", "idx"), degree)
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return NeighbourGraph(rows, rows.sparkSession.createDataFrame([], "src long, dst long"), held)
    near = rewritten(_best(found, degree))
    for _ in range(joins):
        near = rewritten(_best(near.unionByName(_joined(near, rows, degree)), degree))
    back = _best(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"), degree)
    drawn = Window.partitionBy("cell").orderBy(F.xxhash64("idx"), "idx")
    doors = celled.where("k = 0").withColumn("r", F.row_number().over(drawn)).where(F.col("r") <= 2 * degree).select(F.col("cell").alias("src"), F.col("idx").alias("dst"))
    edges = near.select("src", "dst").unionByName(back.select("src", "dst")).unionByName(doors.where("src <> dst")).distinct()
    return NeighbourGraph(rows, rewritten(edges), held)


def _joined(near: DataFrame, rows: DataFrame, degree: int) -> DataFrame:
    """Pairs among the neighbours of each node: those that it has, and the best of those that have it."""
    back = _best(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"), degree)
    members = near.select("src", "dst").unionByName(back.select("src", "dst")).distinct()
    sent = members.join(rows.withColumnRenamed("idx", "dst"), "dst").select("src", "dst", "embedding").repartition("src").sortWithinPartitions("src")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
            yield from compared(t, t.num_rows if not t.num_rows else int(np.searchsorted(t["src"].to_numpy(), t["src"][-1].as_py())))
            held = t.slice(int(np.searchsorted(t["src"].to_numpy(), t["src"][-1].as_py()))) if t.num_rows else t
        if held is not None:
            yield from compared(held, held.num_rows)

    def compared(t: pa.Table, rows: int) -> Iterator[pa.RecordBatch]:
        """Pairs of the first rows of t, which hold whole groups."""
        if not rows:
            return
        t = t.slice(0, rows).combine_chunks()
        src, ids = t["src"].to_numpy(), t["dst"].to_numpy()
        (_, x), *_ = stacked(t["embedding"])
        new = np.flatnonzero(np.append(True, src[1:] != src[:-1]))
        parts = [nearest_pairs(ids[i:j], x[i:j], degree) for i, j in zip(new, np.append(new[1:], rows))]
        yield _batch(*(list(c) for c in zip(*parts)))

    return sent.mapInArrow(run, PAIRS)
