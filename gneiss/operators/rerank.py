"""Scoring (query, document) pairs again, for all queries of a table in one plan.

The first `top` documents of each ranking meet their texts in a join, and tasks score blocks of pairs with weights that are broadcast. The scorer that
comes with the library reads a pair as a whole, as a cross-encoder does: features of how the query's words lie in the document, and hashed
pairs of a query word and the document word that follows or precedes it, under logistic regression. It is fitted on a bounded number
of labelled pairs. Any other model is a function of the same form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

#: Scores of a block of pairs (query, document).
Scorer = Callable[[list[tuple[str, str]]], np.ndarray]

TOP, BLOCK, SAMPLE, BITS = 50, 64, 20_000, 14
_WORD = regex.compile(r"[\p{L}\p{M}]+|\p{Nd}+")

#: Names of the dense features, in order.
FEATURES = ("bias", "covered", "exact", "first", "near", "density", "short")


def words(text: str | None) -> list[str]:
    return [w.lower() for w in _WORD.findall(text or "")]


def dense_features(query: list[str], doc: list[str]) -> list[float]:
    """The share of the query's words in the document, whether they stand in it as they are, how early, how close and how often, and its shortness."""
    asked = set(query)
    at = [i for i, w in enumerate(doc) if w in asked]
    if not asked or not at:
        return [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0 / (1.0 + len(doc) / 100.0)]
    met = {doc[i] for i in at}
    n, joined = len(query), f" {' '.join(doc)} "
    gap = min((j - i for i, j in zip(at, at[1:]) if doc[i] != doc[j]), default=len(doc))
    return [1.0, len(met) / len(asked), float(n > 0 and f" {' '.join(query)} " in joined), 1.0 / (1.0 + at[0]), 1.0 / gap, len(at) / len(doc), 1.0 / (1.0 + len(doc) / 100.0)]


@cache
def _slot(a: str, b: str, bits: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{a}\x00{b}".encode("utf-8", "surrogatepass")) >> (64 - bits)


def crossed(query: list[str], doc: list[str], bits: int) -> list[int]:
    """Slots of (query word, neighbour) for each place in the document where a query word stands."""
    asked, out = set(query), set()
    for i, w in enumerate(doc):
        if w in asked:
            out |= {_slot(w, doc[j], bits) for j in (i - 1, i + 1) if 0 <= j < len(doc)}
    _slot.cache_clear() if _slot.cache_info().currsize > 200_000 else None
    return sorted(out)


@dataclass
class PairScorer:
    """Logistic regression over FEATURES and hashed word pairs; a callable that gives scores from 0 to 1."""

    weights: np.ndarray = field(default_factory=lambda: np.array([-3.0, 4.0, 2.0, 0.5, 1.0, 1.0, 0.5]))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))

    @property
    def bits(self) -> int:
        return len(self.pairs).bit_length() - 1

    def parts(self, query: str, doc: str) -> tuple[np.ndarray, list[int]]:
        q, d = words(query), words(doc)
        return np.array(dense_features(q, d)), crossed(q, d, self.bits) if self.pairs.any() else []

    def __call__(self, block: list[tuple[str, str]]) -> np.ndarray:
        x = np.array([f @ self.weights + float(self.pairs[s].sum()) / max(1, len(s)) for f, s in (self.parts(q, d) for q, d in block)])
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(pairs: DataFrame, sample: int = SAMPLE, bits: int = BITS, epochs: int = 20, rate: float = 0.5, l2: float = 1e-4) -> PairScorer:
    """A scorer from (query, doc, label) with label 0 or 1: at most `sample` different pairs, first by a hash of the pair; tasks make their features, the
    driver holds these and descends by the averaged gradient with rates of their own for each weight."""
    picked = pairs.where("label is not null").select("query", "doc", F.col("label").cast("double").alias("label")).distinct().orderBy(F.xxhash64("query", "doc"), "label").limit(sample)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [(words(q), words(d)) for q, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([dense_features(q, d) for q, d in split], pa.list_(pa.float64())), pa.array([crossed(q, d, bits) for q, d in split], pa.list_(pa.int32())), b.column(2)], ["x", "slots", "label"])

    rows = picked.mapInArrow(featurise, "x array<double>, slots array<int>, label double").collect()
    scorer = PairScorer(np.zeros(len(FEATURES)), np.zeros(1 << bits, np.float32))
    if not rows:
        return PairScorer()
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows])
    count = np.array([max(1, len(r["slots"])) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r["slots"]) for r in rows])
    slot = np.array([s for r in rows for s in r["slots"]], np.int64)
    w, v = np.zeros(len(FEATURES)), np.zeros(1 << bits)
    sw, sv = np.full_like(w, 1e-8), np.full_like(v, 1e-8)
    for _ in range(epochs * 10):
        z = x @ w + np.bincount(row, v[slot], len(rows)) / count
        g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / len(rows)
        gw, gv = x.T @ g + l2 * w, np.bincount(slot, (g / count)[row], len(v)) + l2 * v
        sw, sv = sw + gw * gw, sv + gv * gv
        w, v = w - rate * gw / np.sqrt(sw), v - 0.1 * rate * gv / np.sqrt(sv)
    scorer.weights, scorer.pairs = w, v.astype(np.float32)
    return scorer


def score_pairs(pairs: DataFrame, scorer: Scorer, block: int = BLOCK, out: str = "pair_score") -> DataFrame:
    """pairs (query, doc, ...) with the scorer's score; null texts are empty. The scorer is broadcast and called with blocks of pairs; those of
    a block on which it fails get null."""
    sent = pairs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(scorer))
    names = pairs.columns
    q, d = names.index("query"), names.index("doc")

    def attempt(score: Scorer, some: list[tuple[str, str]]) -> list[float | None]:
        try:
            return [float(x) for x in score(some)]
        except Exception:  # a scorer is the caller's own
            return [None] * len(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = cloudpickle.loads(sent.value)
        for b in batches:
            both = [(x or "", y or "") for x, y in zip(b.column(q).to_pylist(), b.column(d).to_pylist())]
            scores = [x for lo in range(0, len(both), block) for x in attempt(score, both[lo : lo + block])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*names, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema), f"{out} double"])
    return pairs.mapInArrow(run, schema)


def rerank(ranked: DataFrame, queries: DataFrame, docs: DataFrame, scorer: Scorer, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(query_id, idx, score) of ranked (query_id, idx, score): of each query the best `top` come first, ordered by the scorer of (query, document),
    others keep their scores.

    queries: (query_id, query); docs: (idx, doc); unique ids. Rows above the others score the query's best score + 1 + what the pair scores
    above the lowest of them. A document that isn't there is scored as an empty one. A query for which the scorer fails keeps its scores.
    """
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "idx")
    placed = ranked.select("query_id", "idx", "score").withColumn("_r", F.row_number().over(w))
    head = placed.where(F.col("_r") <= top)
    pairs = head.join(docs.select("idx", "doc"), "idx", "left").join(queries.select("query_id", "query"), "query_id", "left")
    scored = score_pairs(pairs.select("query_id", "idx", "query", "doc"), scorer, block).select("query_id", "idx", "pair_score")
    every = Window.partitionBy("query_id")  # `top` rows
    failed = F.count_if(F.col("pair_score").isNull() | F.isnan("pair_score")).over(every) > 0
    lift = F.when(failed, F.col("score")).otherwise(F.max("score").over(every) + 1.0 + F.col("pair_score") - F.min("pair_score").over(every))
    first = head.join(scored, ["query_id", "idx"]).select("query_id", "idx", lift.alias("score"))
    return first.unionByName(placed.where(F.col("_r") > top).select("query_id", "idx", "score"))
