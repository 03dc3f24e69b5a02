"""Hybrid retrieval for a table of questions in one plan: what Retriever.search does for one, keyed by question.

Exact names meet questions by their first three letters; BM25, vectors, fusion, seeds and blending are grouped by question. Rank
spreads as (question, node) rows: each holds what has settled at a node and a residual that is still to be pushed over its edges, and residuals
below a bound settle where they are, so a question touches the part of the graph where its rank is, not all of it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from gneiss.operators import dense, fusion, graph, lexical
from gneiss.plans.checkpoint import truncate
from gneiss.plans.store import Epoch

#: A residual below this settles at its node.
LEAST = 1e-9


def exact_match(nodes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, idx, score): fusion.exact_match for each question."""
    q = F.regexp_replace(F.regexp_replace(F.regexp_replace("query", r"^\s+|\s+$", ""), r"[()]+$", ""), r"^[.]+", "")
    asked = queries.select("query_id", q.alias("q")).where((F.length("q") >= 3) & ~F.col("q").contains(" ")).withColumn("low", F.lower("q"))
    asked = asked.withColumn("head", F.substring("low", 1, 3))
    named = nodes.select("idx", "label", F.lower("label").alias("name")).withColumn("head", F.substring("name", 1, 3))
    equal = (F.col("label") == F.concat("q", F.lit("()"))) | (F.col("name") == F.col("low"))
    starts = F.startswith(F.col("name"), F.col("low")) & F.col("q").rlike(r"^(?U)[\w.]+$")
    met = named.join(asked, "head").select("query_id", "idx", F.when(equal, 1.0).when(starts, 0.7).alias("score")).where("score is not null")
    return _first(met, k).drop("rank")


def _first(scored: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, idx, score, rank) of each question; scores are compared to twelve places."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "idx")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _peak(scored: DataFrame, name: str) -> DataFrame:
    return scored.groupBy("query_id").agg(F.coalesce(F.nullif(F.max("score"), F.lit(0.0)), F.lit(1.0)).alias(name))


def spread(edges: DataFrame, seeds: DataFrame, alpha: float = graph.ALPHA, iterations: int = graph.ITERATIONS, tolerance: float = graph.TOLERANCE, reverse: bool = False, every: int = 5, least: float = LEAST) -> DataFrame:
    """(query_id, idx, score) of personalised PageRank from each question's seeds (query_id, idx, score); graph.ppr but for residuals below `least`.

    Edges are stored once. Scores and residuals come from a grouping, and every few steps they are stored; the loop ends where
    no question's scores have moved by the tolerance since.
    """
    e = truncate(graph.row_normalize(graph.transpose(edges) if reverse else edges))
    s = seeds.select("query_id", "idx", F.greatest(F.col("score").cast("double"), F.lit(0.0)).alias("score")).groupBy("query_id", "idx").agg(F.sum("score").alias("score"))
    total = s.groupBy("query_id").agg(F.sum("score").alias("_t")).where("_t > 0")
    s = truncate(s.join(total, "query_id").select("query_id", "idx", (F.col("score") / F.col("_t")).alias("seed")))
    sources = truncate(e.select(F.col("src").alias("idx")).distinct())
    state = s.select("query_id", "idx", F.lit(0.0).alias("p"), F.col("seed").alias("r"))
    done, before = 0, None
    while done < iterations:
        for _ in range(min(every, iterations - done)):
            small = F.col("r") < least
            held = state.select("query_id", "idx", (F.col("p") + F.when(small, F.col("r")).otherwise((1.0 - alpha) * F.col("r"))).alias("p"), F.lit(0.0).alias("r"))
            live = state.where(~small).select("query_id", "idx", (alpha * F.col("r")).alias("r"))
            pushed = live.join(e, live["idx"] == e["src"]).select("query_id", F.col("dst").alias("idx"), F.lit(0.0).alias("p"), (F.col("r") * F.col("weight")).alias("r"))
            # what nodes without edges hold goes back to the seeds
            lost = live.join(sources, "idx", "left_anti").groupBy("query_id").agg(F.sum("r").alias("lost"))
            back = s.join(lost, "query_id").select("query_id", "idx", F.lit(0.0).alias("p"), (F.col("lost") * F.col("seed")).alias("r"))
            state = held.unionByName(pushed).unionByName(back).groupBy("query_id", "idx").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
            done += 1
        state = truncate(state)
        if before is not None:
            both = state.join(before.select("query_id", "idx", (F.col("p") + F.col("r")).alias("b")), ["query_id", "idx"], "full_outer")
            moved = both.groupBy("query_id").agg(F.sum(F.abs(F.coalesce(F.expr("p + r"), F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))).alias("m")).agg(F.max("m")).first()[0]
            if moved is None or moved < tolerance:
                break
        before = state
    return state.select("query_id", "idx", (F.col("p") + F.col("r")).alias("score"))


def combined(structural: DataFrame | None, temporal: DataFrame | None, weight: float) -> DataFrame:
    """graph.combine_channels for each question. A channel that the index has counts for every question."""
    if structural is None or temporal is None:
        return temporal if structural is None else structural
    w = min(1.0, max(0.0, weight))
    scaled = lambda d, name: d.join(_peak(d, "_p"), "query_id").select("query_id", "idx", (F.col("score") / F.col("_p")).alias(name))
    both = scaled(structural, "_s").join(scaled(temporal, "_t"), ["query_id", "idx"], "full_outer")
    return both.select("query_id", "idx", ((1.0 - w) * F.coalesce("_s", F.lit(0.0)) + w * F.coalesce("_t", F.lit(0.0))).alias("score"))


class BatchRetriever:
    def __init__(self, epoch: Epoch, temporal_weight: float = 0.3, include_tests: bool = True, encoder: Callable | None = None, use_lexical: bool = True, use_dense: bool = True):
        self.epoch, self.spark, self.encoder = epoch, epoch.spark, encoder
        self.nodes, self.docs = epoch.read("nodes"), epoch.read("docs")
        self.lexical = lexical.LexicalIndex.load(epoch) if use_lexical else None
        if use_lexical and self.lexical is None and self.docs is not None:
            self.lexical = lexical.build(self.docs)
        self.vectors = dense.load(epoch) if use_dense and encoder is not None else None
        self.temporal_weight, self.include_tests = temporal_weight, include_tests

    def candidates(self, queries: DataFrame, k: int = 100) -> DataFrame:
        """(query_id, idx, score): BM25 and vectors fused by rank."""
        lists = []
        if self.lexical is not None:
            lists.append(self.lexical.search(queries, k).select("query_id", "idx", "rank"))
        if self.vectors is not None:
            encode, kind = self.encoder, dict(queries.dtypes)["query_id"]

            def run(parts):
                for pdf in parts:
                    x = np.asarray(encode(pdf["query"].fillna("").tolist()), float)
                    n = np.linalg.norm(x, axis=1, keepdims=True)
                    yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy(), "query_vec": list(np.where(n > 0, x / np.where(n > 0, n, 1), x))})

            asked = queries.select("query_id", "query").mapInPandas(run, f"query_id {kind}, query_vec array<double>")
            v = self.vectors.join(self.nodes.select("node_key", "idx"), "node_key").select("idx", "embedding")
            lists.append(dense.search(v, asked, k).select("query_id", "idx", "rank"))
        if not lists:
            return queries.limit(0).select("query_id", F.lit(0).cast("long").alias("idx"), F.lit(0.0).alias("score"))
        return fusion.rrf(lists)

    def ranked(self, queries: DataFrame, k: int = 100) -> DataFrame:
        """(query_id, idx, score): candidates, exact hits above them, times the prior of tests."""
        fused, exact = truncate(self.candidates(queries, k)), exact_match(self.nodes, queries)
        top = fused.groupBy("query_id").agg(F.max("score").alias("_top"))
        both = fused.join(exact.withColumnRenamed("score", "_exact"), ["query_id", "idx"], "full_outer").join(top, "query_id", "left")
        injected = both.select("query_id", "idx", F.coalesce(F.coalesce("_top", F.lit(0.0)) + F.col("_exact"), F.col("score")).alias("score"))
        weighed = injected.join(self.nodes.select("idx", "source_file"), "idx", "left")
        return truncate(weighed.select("query_id", "idx", (F.col("score") * fusion.prior("source_file", self.include_tests)).alias("score")).where("score > 0"))

    def search(self, queries: DataFrame, k: int = 20, candidate_k: int = 100, seed_k: int = 15, use_ppr: bool = True, reverse: bool = False) -> DataFrame:
        """(query_id, idx, score, rank, label, kind, source_file): the k best of each question (query_id, query); questions that nothing matches have no rows."""
        ranked = self.ranked(queries, candidate_k)
        channels = [self.epoch.edges(c) for c in ("structural", "temporal")] if use_ppr else [None, None]
        channels = [None if e is None or not e.limit(1).count() else e for e in channels]
        if channels == [None, None]:
            return self._described(_first(ranked, k))
        seeds = truncate(_first(ranked, seed_k).drop("rank"))
        parts = [None if e is None else spread(graph.symmetric_weights(e, symmetric=not reverse), seeds, reverse=reverse) for e in channels]
        mixed = combined(*parts, self.temporal_weight)
        both = ranked.select("query_id", "idx", F.col("score").alias("f")).join(mixed.select("query_id", "idx", F.col("score").alias("m")), ["query_id", "idx"], "full_outer")
        both = both.join(_peak(ranked, "fp"), "query_id", "left").join(_peak(mixed, "mp"), "query_id", "left").join(self.nodes.select("idx", "source_file", "label", "kind"), "idx")
        f, m = F.coalesce(F.col("f"), F.lit(0.0)) / F.coalesce("fp", F.lit(1.0)), F.coalesce(F.col("m"), F.lit(0.0)) / F.coalesce("mp", F.lit(1.0))
        score = F.round(fusion.SEED_WEIGHT * f + (1.0 - fusion.SEED_WEIGHT) * m * fusion.prior("source_file", self.include_tests), 12)
        blended = both.where((f > 0) | (m > 0)).select("query_id", "idx", score.alias("score"), "label", "kind")
        same = Window.partitionBy("query_id", F.lower(F.trim(F.coalesce("label", F.lit("")))), F.coalesce("kind", F.lit(""))).orderBy(F.desc("score"), "idx")
        once = blended.withColumn("r", F.row_number().over(same)).where(F.col("r") <= fusion.DUPLICATES).select("query_id", "idx", "score")
        return self._described(_first(once, k))

    def _described(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.nodes.select("idx", "label", "kind", "source_file"), "idx").select("query_id", "idx", "score", "rank", "label", "kind", "source_file")
