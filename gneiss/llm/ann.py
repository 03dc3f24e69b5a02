"""Nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, each quantised to one of `centroids` points of its own codebook; a row's cell is its
pair of codes. Largest inner products become nearest points by one more component, sqrt(M^2 - |x|^2) with M the largest
norm, in the second half (zero for a query), so norms may differ. A query walks over the cells in order of summed
squared distances, with a heap over the two sorted lists, until the cells it has met hold `enough` rows. All rows of these cells are
reranked with the original vectors in double precision.

`enough` is measured on the fitted sample: the share of the rows that must be met for `recall` of the sample's true k nearest of `trials`
of its rows, times the rows, and `least` and k + 1 at least. Neighbours in a whole table are nearer than those in a sample of it, so the share is on
the safe side for larger tables; where vectors have structure it is small. Each length of vectors has an index of its own.

Codebooks are fitted on the driver by Lloyd's method on at most `sample` rows of a length, drawn by a hash; every
row is indexed. Centroids, and the row counts of centroids^2 cells, are what is broadcast: sizes that parameters bound.

Rows are grouped by first code, in blocks of about `block` rows, so one cell or vector may hold any share of the rows; so are the queries
that meet a code. A pair of blocks is one task's: it returns its k best for each query, and the k best of these are kept. Ties, compared
on exactly equal scores, go to the smaller id.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows without an id, take no part, and vectors
meet only those of their own length. With fewer than k candidates all are returned. Rows that repeat an id
are candidates each, and queries each, whose answers are merged; rows of the query's own id are none. Extra columns, whatever their names,
are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored
from .vectors import matrices

CENTROIDS, SAMPLE, RECALL, TRIALS, LEAST, BLOCK, ROUNDS = 63, 20_000, 0.96, 256, 64, 4_096, 12


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        a = nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), len(c))])
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return distances(x, c).argmin(axis=1)


def halves(x: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    cut = (x.shape[1] + 1) // 2
    rest = np.sqrt(np.maximum(0, most * most - (x * x).sum(1)))
    return x[:, :cut], np.concatenate([x[:, cut:], rest[:, None]], axis=1)


def walk(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, enough: int) -> dict[int, int]:
    """first code -> bits of the second codes met, in order of d1 + d2, until the cells met hold `enough` rows."""
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    n2, rows = len(o2), counts.tolist()
    heap, met, total = [(s1[0] + s2[0], 0, 0)], {}, 0
    while heap and total < enough:
        _, i, j = heapq.heappop(heap)
        a, b = o1[i], o2[j]
        if rows[a][b]:
            met[a] = met.get(a, 0) | (1 << b)
            total += rows[a][b]
        if j + 1 < n2:
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(o1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return met


def share_for(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], most: float, k: int, recall: float, trials: int = TRIALS) -> float:
    """The share of the rows of x that walks must meet to find `recall` of the k nearest other rows of some of them."""
    h1, h2 = halves(x, most)
    a, b = nearest(h1, books[0]), nearest(h2, books[1])
    some = np.random.default_rng(11).choice(len(x), min(trials, len(x)), replace=False)
    h1, h2 = halves(x[some], 0.0)
    cell = distances(h1, books[0])[:, a] + distances(h2, books[1])[:, b]  # of the row's cell, for each trial
    score = x[some] @ x.T
    score[np.arange(len(some)), some] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1.0
    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
    # rows in cells that are met no later
    order = np.sort(cell, axis=1)
    met = np.array([np.searchsorted(o, c[t], side="right") for o, c, t in zip(order, cell, top)]) / len(x)
    return float(np.quantile(met, recall))


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", centroids: int = CENTROIDS, recall: float = RECALL, least: int = LEAST, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (int, from 1), vec_id and score of the k best rows for each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    if not 1 <= centroids <= 63:
        raise ValueError(f"{centroids} centroids: the codes that a walk meets are 63 bits at most")
    kind = "<f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "<f8"

    def prepare(batches):
        for batch in batches:
            out, size, norm = [None] * batch.num_rows, np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for at, x in matrices(batch.column(1)):
                size[at], norm[at] = x.shape[1], np.linalg.norm(x, axis=1)
                for i, v in zip(at.tolist(), x.astype(kind)):
                    out[i] = v.tobytes()
            keep = pa.array((size > 0) & batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (batch.column(0), pa.array(out, pa.binary()), pa.array(size), pa.array(norm))], ["id", "vec", "size", "norm"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInArrow(prepare, "id long, vec binary, size int, norm double")
    rows = stored(rows, "vectors")
    sizes = rows.groupBy("size").agg(F.count("*").alias("n"), F.max("norm").alias("most")).orderBy("size").collect()  # one row for each length
    rows = rows.drop("norm")

    def doubles(data: list[bytes], n: int) -> np.ndarray:
        return np.frombuffer(b"".join(data), kind).astype(np.float64).reshape(n, -1)

    sampled = {}
    for size, n, _ in sizes:
        own = rows.where(F.col("size") == size)
        # a few more than are wanted, by a hash, so that the sorted rows of a task are few too
        spread = own.where(F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30)) < int(min(1.0, 1.25 * sample / n) * (1 << 30)))
        some = spread.orderBy(F.xxhash64("id"), "id", "vec").limit(sample).select("vec").collect()
        if len(some) < min(n, sample) // 4:  # rows that repeat each other share a hash
            some = own.orderBy(F.xxhash64("id", "vec", "_metadata.row_index")).limit(sample).select("vec").collect()
        sampled[size] = doubles([r["vec"] for r in some], len(some))
    indexes, first = {}, 0
    for size, n, most in sizes:
        x = sampled[size]
        h1, h2 = halves(x, most)
        books = (kmeans(h1, centroids), kmeans(h2, centroids))
        enough = max(math.ceil(share_for(x, books, most, k, recall) * n), least, k + 1)
        indexes[size] = {"books": books, "most": most, "enough": enough, "first": first}  # first: number of its first code
        first += len(books[0])
    sent = spark.sparkContext.broadcast(indexes)

    def by_size(batch):
        """(rows, matrix, index) for each length of a batch of (id, vec, size)."""
        sizes = batch.column(2).to_numpy()
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            yield pa.array(at), doubles(batch.column(1).take(pa.array(at)).to_pylist(), len(at)), sent.value[size]

    def encode(batches):
        for batch in batches:
            for at, x, index in by_size(batch):
                h1, h2 = halves(x, index["most"])
                a, b = nearest(h1, index["books"][0]) + index["first"], nearest(h2, index["books"][1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["id", "vec", "a", "b"])

    index = stored(rows.mapInArrow(encode, "id long, vec binary, a int, b int"), "index")
    cells = np.zeros((first, centroids), np.int64)
    for r in index.groupBy("a", "b").count().collect():  # centroids^2 rows of a length at most
        cells[r["a"], r["b"]] = r["count"]
    counted = spark.sparkContext.broadcast(cells)

    def visit(batches):
        for batch in batches:
            for own, q, index in by_size(batch):
                h1, h2 = halves(q, 0.0)
                d1, d2 = distances(h1, index["books"][0]), distances(h2, index["books"][1])
                here = counted.value[index["first"] : index["first"] + d1.shape[1], : d2.shape[1]]
                at, a, bits = [], [], []
                for i in range(len(q)):
                    for code, met in walk(d1[i], d2[i], here, index["enough"]).items():
                        at.append(i)
                        a.append(code + index["first"])
                        bits.append(met)
                at = own.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(a, pa.int32()), pa.array(bits, pa.int64())], ["id", "a", "bits"])

    queries = rows.where(F.col("id") % every == 0).distinct()
    # few queries are much work: deal them out
    asked = queries.repartition(max(8, spark.sparkContext.defaultParallelism * 2), "id").mapInArrow(visit, "id long, a int, bits long")
    asked = stored(asked.groupBy("id", "a").agg(F.bit_or("bits").alias("bits")), "asked")
    met = {r["a"]: r["count"] for r in asked.groupBy("a").count().collect()}  # a row for each code
    many = [(a, int(max(1, -(-cells[a].sum() // block))), -(-met[a] // block)) for a in sorted(met)]
    many = spark.createDataFrame(many, "a int, blocks int, parts int")
    asked = asked.join(F.broadcast(many), "a").withColumn("p", F.expr("cast(pmod(xxhash64(id), parts) as int)")).withColumn("s", F.explode(F.expr("sequence(0, blocks - 1)")))
    asked = asked.select("id", "a", "bits", "p", "s").join(queries.select("id", "vec"), "id")
    held = index.join(F.broadcast(many), "a").withColumn("s", F.expr("cast(pmod(xxhash64(id, vec), blocks) as int)")).withColumn("p", F.explode(F.expr("sequence(0, parts - 1)")))
    held = held.select("id", "vec", "a", "b", "s", "p")

    def rerank(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if asked.num_rows and held.num_rows:
            order = np.argsort(held["b"].to_numpy(), kind="stable")
            held = held.take(pa.array(order))
            codes, ids, x = held["b"].to_numpy(), held["id"].to_numpy(), doubles(held["vec"].to_pylist(), held.num_rows)
            starts = [(int(b), *np.searchsorted(codes, [b, b + 1]).tolist()) for b in np.unique(codes)]
            for lo in range(0, asked.num_rows, 512):
                part = asked.slice(lo, 512)
                q, qid, bits = doubles(part["vec"].to_pylist(), part.num_rows), part["id"].to_numpy(), part["bits"].to_numpy()
                score = np.full((len(q), len(x)), -np.inf)
                for b, i, j in starts:
                    met = np.flatnonzero((bits >> b) & 1)
                    if len(met):
                        score[met, i:j] = q[met] @ x[i:j].T
                score[qid[:, None] == ids[None, :]] = -np.inf
                # all rows that may tie with the k-th are scored again, each on its own
                m = min(k, len(x))
                bar = np.partition(score, len(x) - m, axis=1)[:, len(x) - m]
                bar = np.where(np.isfinite(bar), bar - 1e-9 * np.maximum(1.0, np.abs(bar)), -np.inf)
                r, c = np.nonzero((score >= bar[:, None]) & np.isfinite(score))
                exact = np.einsum("ij,ij->i", q[r], x[c])
                best = np.lexsort((ids[c], -exact, r))
                r, c, exact = r[best], c[best], exact[best]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                top = place < k
                out.append((qid[r[top]], ids[c[top]], exact[top]))
        cat = lambda i, t: pa.array(np.concatenate([o[i] for o in out]) if out else [], t)
        return pa.table({"query_id": cat(0, pa.int64()), "vec_id": cat(1, pa.int64()), "score": cat(2, pa.float64())})

    found = asked.groupBy("a", "s", "p").cogroup(held.groupBy("a", "s", "p")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
