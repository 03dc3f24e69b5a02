"""Dense vectors: encoders, incremental embedding and brute-force cosine search."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F

Encoder = Callable[[list[str]], np.ndarray]

#: Encoders by name. "hash" needs no model: signed feature hashing of words and their letter triples.
BACKENDS: dict[str, Callable[[], Encoder]] = {}

# Documents a second by which a build's time is planned.
RATES = {"static": 20_000, "cuda": 400, "mps": 120, "cpu": 18}


def backend(name: str):
    def add(make):
        BACKENDS[name] = make
        return make

    return add


@backend("hash")
def hash_encoder(size: int = 256) -> Encoder:
    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float64)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                for g in {w, *(w[j : j + 3] for j in range(len(w) - 2))}:
                    h = int.from_bytes(hashlib.blake2b(g.encode("utf-8", "replace"), digest_size=8).digest(), "little")
                    out[i, h % size] += 1.0 if h >> 63 else -1.0
        return out

    return encode


@backend("model2vec")
def model2vec_encoder(name: str = "minishlab/potion-base-8M") -> Encoder:
    from model2vec import StaticModel

    return StaticModel.from_pretrained(name).encode


@backend("st")
def sentence_encoder(name: str = "sentence-transformers/all-MiniLM-L6-v2") -> Encoder:
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(name).encode


def resolve_backend(name: str = "auto") -> str | None:
    """The first backend that can be made, for "auto"; None for "none"."""
    if name == "none":
        return None
    for n in ["st", "model2vec"] if name == "auto" else [name]:
        try:
            BACKENDS[n]()
            return n
        except ImportError:
            continue
    return None


def estimate_seconds(documents: int, device: str) -> float:
    return documents / RATES[device]


def embed(docs: DataFrame, make: Callable[[], Encoder], batch: int = 64, key: str = "node_key") -> DataFrame:
    """(key, embedding) of (key, doc); rows have length one, or zero where the encoder gives zeros."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for pdf in parts:
            for lo in range(0, len(pdf), batch):
                some = pdf.iloc[lo : lo + batch]
                x = np.asarray(encode(some["doc"].fillna("").tolist()), np.float32)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                yield pd.DataFrame({key: some[key].to_numpy(), "embedding": list(np.where(n > 0, x / np.where(n > 0, n, 1), 0).astype(np.float32))})

    return docs.select(key, "doc").mapInPandas(run, f"{key} string, embedding array<float>")


def save(epoch, vectors: DataFrame) -> None:
    """Write (node_key, embedding) with components of 16 bits, two bytes each in a binary column: half the room of 32-bit lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data: list[bytes | None] = [b"" if ok else None for ok in b.column(1).is_valid().to_pylist()]
            for at, x in stacked(b.column(1)):
                for i, row in zip(at.tolist(), x.astype("<f2")):
                    data[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["node_key", "half"])

    epoch.write("vectors", vectors.select("node_key", "embedding").mapInArrow(run, "node_key string, half binary"))


def load(epoch) -> DataFrame | None:
    """(node_key, embedding array<float>) of an epoch; None without vectors. Vectors that were written as lists are read as they are."""
    held = epoch.read("vectors")
    if held is None or "half" not in held.columns:
        return held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [None if x is None else np.frombuffer(x, "<f2").astype(np.float32) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float32()))], ["node_key", "embedding"])

    return held.select("node_key", "half").mapInArrow(run, "node_key string, embedding array<float>")


def dirty_keys(new: DataFrame, old: DataFrame, vectors: DataFrame) -> DataFrame:
    """(node_key, dirty) for new (node_key, content_hash): dirty unless the old hash is equal and a vector is there."""
    o = old.select("node_key", F.col("content_hash").alias("old_hash"))
    v = vectors.select("node_key", F.lit(True).alias("has"))
    j = new.join(o, "node_key", "left").join(v, "node_key", "left")
    same = F.col("content_hash").eqNullSafe(F.col("old_hash")) & F.col("has").isNotNull()
    return j.select("node_key", (~same).alias("dirty"))


def update_vectors(docs: DataFrame, old: DataFrame, vectors: DataFrame, make: Callable[[], Encoder]) -> DataFrame:
    """Vectors of docs (node_key, content_hash, doc): kept where nothing changed, made anew for the rest; others are left out."""
    d = dirty_keys(docs.select("node_key", "content_hash"), old, vectors)
    fresh = embed(docs.join(d.where("dirty"), "node_key", "left_semi"), make)
    return fresh.unionByName(vectors.select("node_key", "embedding").join(d.where("not dirty"), "node_key", "left_semi"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def best(k: int, q: np.ndarray, i: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Positions of the k best of each query number q: the largest scores, ties to smaller ids."""
    order = np.lexsort((i, -score, q))
    new = np.flatnonzero(np.diff(q[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(new, np.diff(new, append=len(order))) < k]


def stacked(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of the vectors of a column of lists; null ones are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pa.compute.fill_null(pa.compute.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == d)
        flat = column.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(float("nan"))
        yield at, flat.to_numpy(zero_copy_only=False).reshape(len(at), d)


def products(a: np.ndarray, r: np.ndarray, b: np.ndarray, c: np.ndarray, at_once: int = 1 << 14) -> np.ndarray:
    """The product of row r[i] of a and row c[i] of b for each i. A matrix product rounds by where a row lies in it, so equal rows would differ; these don't."""
    return np.concatenate([np.einsum("ij,ij->i", a[r[i : i + at_once]], b[c[i : i + at_once]]) for i in range(0, max(1, len(r)), at_once)])


#: Products of queries and rows that a task holds at once.
PRODUCTS = 1 << 18


def search(vectors: DataFrame, queries: DataFrame, k: int = 100, at_once: int = 8192) -> DataFrame:
    """(query_id, idx, score, rank) of (idx, embedding) for (query_id, query_vec).

    Vectors have length one, so the product is the cosine. Queries pass through the driver in blocks of `at_once`, of which one is
    held at a time. Each task multiplies its batches of rows with the queries and keeps k of each, so rows are never shuffled; it holds
    PRODUCTS products at a time, however many rows are equally near.
    Queries of another length find nothing.
    """
    spark, q_type = vectors.sparkSession, dict(queries.dtypes)["query_id"]
    rows = vectors.select(F.col("idx").cast("long").alias("idx"), "embedding")

    def found(asked: list) -> DataFrame:
        by_size: dict[int, list] = {}
        for r in asked:
            if r["query_vec"] is not None:
                by_size.setdefault(len(r["query_vec"]), []).append(r)
        sent = spark.sparkContext.broadcast({d: ([r["query_id"] for r in own], np.array([r["query_vec"] for r in own], np.float64)) for d, own in by_size.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {d: [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)] for d in sent.value}
            kind = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}.get(q_type)
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for own, x in stacked(batch.column(1)):
                    if x.shape[1] not in held:
                        continue
                    idx, q, old = ids[own], sent.value[x.shape[1]][1], held[x.shape[1]]
                    step, kept = max(1, PRODUCTS // len(idx)), []
                    for at in range(0, len(q), step):
                        score = q[at : at + step] @ x.T
                        worth = np.where(np.isnan(score), -np.inf, score)
                        least = np.partition(worth, -k, axis=1)[:, -k, None] if k < len(idx) else -np.inf
                        r, c = np.nonzero(worth >= least - 1e-9 * (1 + np.abs(least)))
                        r, near = r + at, products(q, r + at, x, c)
                        # with what these queries hold, which lies in their order; equal products are cut at once
                        lo, hi = np.searchsorted(old[0], [at, at + step])
                        both = [np.concatenate([z[lo:hi], y]) for z, y in zip(old, (r, idx[c], near))]
                        keep = best(k, *both)
                        kept.append([z[keep] for z in both])
                    held[x.shape[1]] = [np.concatenate(z) for z in zip(*kept)]
            for d, (r, idx, score) in held.items():
                names = pa.array(sent.value[d][0], kind)
                for lo in range(0, len(r), 100_000):
                    some = slice(lo, lo + 100_000)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(r[some])), pa.array(idx[some]), pa.array(score[some])], ["query_id", "idx", "score"])

        return rows.mapInArrow(run, f"query_id {q_type}, idx long, score double")

    out, asked = None, queries.select("query_id", "query_vec").toLocalIterator()
    while True:
        some = list(itertools.islice(asked, at_once))
        if some or out is None:
            out = found(some) if out is None else out.unionByName(found(some))
        if len(some) < at_once:
            break
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "idx")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def seconds_to_confirm(documents: int, device: str, limit: float = 120.0) -> float | None:
    """The planned seconds of a build that takes longer than the limit."""
    s = estimate_seconds(documents, device)
    return s if s > limit and math.isfinite(s) else None
