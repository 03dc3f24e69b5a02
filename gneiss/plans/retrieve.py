"""Hybrid retrieval over an index: exact names, BM25 and vectors, fused, spread over the graph and explained."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from gneiss.functions.text import tokenize
from gneiss.operators import dense, fusion, graph, lexical
from gneiss.operators.rerank import rerank as rerank_pairs
from gneiss.plans.checkpoint import truncate
from gneiss.plans.store import Epoch


@dataclass
class Result:
    hits: DataFrame | None = None  # idx, score, rank, label, source_file, start_line, end_line, kind, why
    seeds: DataFrame | None = None
    stages: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


class Retriever:
    def __init__(self, epoch: Epoch, temporal_weight: float = 0.3, include_tests: bool = True, encoder: Callable | None = None, use_lexical: bool = True, use_dense: bool = True, reranker: Callable | None = None):
        self.epoch, self.spark = epoch, epoch.spark
        self.nodes, self.docs = epoch.read("nodes"), epoch.read("docs")
        self.lexical = lexical.LexicalIndex.load(epoch)
        self.vectors = dense.load(epoch) if use_dense else None
        self.temporal_weight, self.include_tests, self.encoder, self.use_lexical, self.reranker = temporal_weight, include_tests, encoder, use_lexical, reranker

    def candidates(self, query: str, k: int = 100) -> tuple[DataFrame, dict]:
        lists = []
        stages = {"bm25": 0, "dense": 0}
        if self.use_lexical and (self.docs is not None or self.lexical is not None):
            terms = [r[0] for r in self.spark.range(1).select(F.explode(tokenize(F.lit(query)))).collect()]
            if terms:
                # stored postings; an index without them is read whole
                found = (self.lexical.ask(terms, k).orderBy("rank") if self.lexical is not None else lexical.search_few(self.docs, terms, k)).collect()
                stages["bm25"] = len(found)
                lists.append([(0, r["idx"], i + 1) for i, r in enumerate(found)])
        if self.vectors is not None and self.encoder is not None:
            import numpy as np

            q = np.asarray(self.encoder([query])[0], float)
            n = float(np.linalg.norm(q))
            asked = self.spark.createDataFrame([(0, (q / n if n else q).tolist())], "query_id int, query_vec array<double>")
            v = self.vectors.join(self.nodes.select("node_key", "idx"), "node_key").select("idx", "embedding")
            found = dense.search(v, asked, k).collect()
            stages["dense"] = len(found)
            lists.append([(0, r["idx"], r["rank"]) for r in found])
        frames = [self.spark.createDataFrame(rows, "query_id int, idx long, rank int") for rows in lists if rows]
        if not frames:
            return self.spark.createDataFrame([], "idx long, score double"), stages
        return fusion.rrf(frames).select("idx", "score"), stages

    def search(self, query: str, k: int = 20, candidate_k: int = 100, seed_k: int = 15, use_ppr: bool = True, reverse: bool = False, rerank: bool = False) -> Result:
        """reverse follows edges backwards, over the edges as they are directed; else over both directions."""
        out = Result()
        exact = fusion.exact_match(self.nodes, query)
        fused, out.stages = self.candidates(query, candidate_k)
        ranked = truncate(fusion.apply_prior(fusion.inject_exact(fused, exact), self.nodes, self.include_tests))
        out.stages["exact"] = exact.count()
        out.stages["ranked"] = ranked.count()
        if not out.stages["ranked"]:
            out.warnings.append("nothing in the corpus matches by name, words or meaning")
            return out
        if rerank and self.reranker is not None:
            one = F.lit(0).alias("query_id")
            asked = self.spark.createDataFrame([(0, query)], "query_id int, query string")
            ranked = truncate(rerank_pairs(ranked.select(one, "idx", "score"), asked, self.docs, self.reranker).select("idx", "score"))
        seeds = truncate(graph.top(ranked, seed_k))
        out.seeds = self.described(seeds.withColumn("why", F.lit("seed")))
        s, t = (self.epoch.edges(c) for c in ("structural", "temporal"))
        if not use_ppr or s is None and t is None:
            out.hits = self.described(graph.top(ranked, k).withColumn("why", F.lit("lexical/dense")))
            return out
        spread = [None if e is None or not e.limit(1).count() else truncate(graph.ppr(graph.symmetric_weights(e, symmetric=not reverse), seeds, reverse=reverse)) for e in (s, t)]
        if spread == [None, None]:
            out.hits = self.described(graph.top(ranked, k).withColumn("why", F.lit("lexical/dense")))
            return out
        out.stages["channels"] = "+".join(n for n, d in zip(("structural", "temporal"), spread) if d is not None)
        combined = graph.combine_channels(*spread, self.temporal_weight)
        blended = fusion.blend(ranked, combined, self.nodes, include_tests=self.include_tests)
        best = truncate(fusion.suppress_duplicates(blended, self.nodes, k))
        out.hits = self.described(self.explained(best, seeds, *spread))
        return out

    def explained(self, best: DataFrame, seeds: DataFrame, s: DataFrame | None, t: DataFrame | None) -> DataFrame:
        w = min(1.0, max(0.0, self.temporal_weight))
        if s is not None and t is not None:
            s, t = (None if w >= 1 else s), (None if w <= 0 else t)
        file_of = self.nodes.select("idx", "source_file")
        seed_files = truncate(seeds.join(file_of, "idx").select(F.col("source_file").alias("node")).where("node is not null").distinct())
        pairs = self.epoch.read("cochange")
        none = self.spark.createDataFrame([], "node string")
        reached = near = none
        if t is not None and pairs is not None:
            p = pairs.select(F.col("path_a").alias("a"), F.col("path_b").alias("b"))
            groups = self.epoch.read("cochange_groups")
            reached = graph.closure(graph.components(p) if groups is None else groups, seed_files)
            near = graph.beside(p, seed_files)
        flag = lambda d, c: d.select(F.col("node").alias("source_file"), F.lit(True).alias(c))
        rows = best.join(file_of, "idx").join(seeds.select("idx", F.lit(True).alias("is_seed")), "idx", "left")
        for d, c in ((s, "s"), (t, "t")):
            rows = rows.join(d.withColumnRenamed("score", c), "idx", "left") if d is not None else rows.withColumn(c, F.lit(0.0))
        for d, c in ((seed_files, "in_seed_files"), (reached, "in_history_files"), (near, "next_to_seed_files")):
            rows = rows.join(F.broadcast(flag(d, c)) if c == "in_seed_files" else flag(d, c), "source_file", "left")
        rows = rows.fillna(False, ["is_seed", "in_seed_files", "in_history_files", "next_to_seed_files"])
        return fusion.explain(rows).select("idx", "score", "why")

    def described(self, rows: DataFrame) -> DataFrame:
        """rows (idx, score, why), a bounded number, with rank and what the nodes are."""
        from pyspark.sql import Window

        j = rows.join(self.nodes.select("idx", "label", "source_file", "start_line", "end_line", "kind", "community"), "idx")
        return j.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "idx")))
