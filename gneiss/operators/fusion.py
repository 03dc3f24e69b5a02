"""Fusing rankings into one answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gneiss.functions.text import is_test_path

# Damping of ranks, share of retrieval against diffusion, discount of tests, copies of one label.
RRF_K, SEED_WEIGHT, TEST_PRIOR, DUPLICATES = 60, 0.6, 0.55, 2


def rrf(lists: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K) -> DataFrame:
    """(query_id, idx, score): the sum of weight / (k + rank) over lists of (query_id, idx, rank)."""
    weights = weights or [1.0] * len(lists)
    parts = [d.select("query_id", "idx", (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("score")) for d, w in zip(lists, weights)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query_id", "idx").agg(F.sum("score").alias("score"))


def exact_match(nodes: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(idx, score) of nodes whose label is the query (1.0), then of labels that begin with it (0.7); k at most."""
    import re

    q = query.strip().rstrip("()").lstrip(".")
    out = nodes.select("idx", "label")
    if not q or " " in q or len(q) < 3:
        return out.limit(0).select("idx", F.lit(1.0).alias("score"))
    label = F.lower("label")
    equal = (F.col("label") == q + "()") | (label == q.lower())
    starts = label.startswith(q.lower()) if re.fullmatch(r"[\w.]+", q) else F.lit(False)
    score = F.when(equal, F.lit(1.0)).when(starts, F.lit(0.7))
    return out.select("idx", score.alias("score")).where("score is not null").orderBy(F.desc("score"), "idx").limit(k)


def inject_exact(fused: DataFrame, exact: DataFrame) -> DataFrame:
    """Exact hits score the best fused score plus their own; others keep theirs."""
    top = fused.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("_top"))
    e = exact.select("idx", F.col("score").alias("_exact"))
    j = fused.join(e, "idx", "full_outer").crossJoin(F.broadcast(top))
    return j.select("idx", F.coalesce(F.col("_top") + F.col("_exact"), F.col("score")).alias("score"))


def prior(path, include_tests: bool = True):
    return F.when(is_test_path(path), F.lit(TEST_PRIOR if include_tests else 0.0)).otherwise(F.lit(1.0))


def apply_prior(scored: DataFrame, nodes: DataFrame, include_tests: bool = True) -> DataFrame:
    j = scored.join(nodes.select("idx", "source_file"), "idx", "left")
    return j.select("idx", (F.col("score") * prior("source_file", include_tests)).alias("score")).where("score > 0")


def blend(ranked: DataFrame, diffused: DataFrame, nodes: DataFrame, seed_weight: float = SEED_WEIGHT, include_tests: bool = True) -> DataFrame:
    """(idx, score): seed_weight x retrieval + the rest x diffusion x prior, each divided by its largest; only rows with either above 0."""
    peak = lambda d, c: d.agg(F.coalesce(F.nullif(F.max("score"), F.lit(0.0)), F.lit(1.0)).alias(c))
    r = ranked.select("idx", F.col("score").alias("f"))
    d = diffused.select("idx", F.col("score").alias("m"))
    j = r.join(d, "idx", "full_outer").crossJoin(F.broadcast(peak(ranked, "fp"))).crossJoin(F.broadcast(peak(diffused, "mp")))
    j = j.join(nodes.select("idx", "source_file"), "idx", "left")
    f, m = F.coalesce(F.col("f"), F.lit(0.0)) / F.col("fp"), F.coalesce(F.col("m"), F.lit(0.0)) / F.col("mp")
    # twelve places: the order of sums, which differs from run to run, must not order equal scores
    score = F.round(seed_weight * f + (1.0 - seed_weight) * m * prior("source_file", include_tests), 12)
    return j.where((f > 0) | (m > 0)).select("idx", score.alias("score"))


def suppress_duplicates(scored: DataFrame, nodes: DataFrame, k: int | None = None, most: int = DUPLICATES) -> DataFrame:
    """The best `most` rows of each label (without case and blanks around it) and kind; k rows at most."""
    j = scored.join(nodes.select("idx", "label", "kind"), "idx")
    w = Window.partitionBy(F.lower(F.trim(F.coalesce("label", F.lit("")))), F.coalesce("kind", F.lit(""))).orderBy(F.desc("score"), "idx")
    out = j.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("idx", "score")
    return out if k is None else out.orderBy(F.desc("score"), "idx").limit(k)


def explain(rows: DataFrame) -> DataFrame:
    """`why` for rows of (is_seed, s, t, in_seed_files, in_history_files, next_to_seed_files)."""
    s, t = F.coalesce(F.col("s"), F.lit(0.0)) > 0, F.coalesce(F.col("t"), F.lit(0.0)) > 0
    near = F.col("next_to_seed_files")
    # fixed values: the words of provenance
    why = (
        F.when(F.col("is_seed"), "matched query")
        .when(t & F.col("in_seed_files"), "in the same file as a match")
        .when(t & F.col("in_history_files") & near & s, "connected in code; file co-changes with a matched file")
        .when(t & F.col("in_history_files") & near, "file co-changes with a matched file")
        .when(t & F.col("in_history_files") & s, "connected through code and co-change history")
        .when(t & F.col("in_history_files"), "connected through co-change history")
        .when(s | t, "connected to matches")
        .otherwise("matched query")
    )
    return rows.withColumn("why", why)
