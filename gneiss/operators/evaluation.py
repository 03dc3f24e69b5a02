"""Evaluating rankings against changes that came later."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from gneiss.functions.text import EVAL_NOISE_PATH, PROCESS_SUBJECT, eval_query

KS = (1, 5, 10, 20)


def time_split(commits: DataFrame, fraction: float = 0.8) -> DataFrame:
    """(sha, ts): the commit `fraction` of the way through history, newest first; an error below 20 commits.

    Commits are counted by day; only the day that holds the cut is ranked, so no task orders the whole history.
    """
    c = commits.select("sha", "ts").distinct().withColumn("day", F.floor(F.col("ts") / 86_400))
    days = c.groupBy("day").agg(F.count("*").alias("n"))
    total = days.agg(F.sum("n")).first()[0] or 0
    if total < 20:
        raise ValueError(f"{total} commits are too few to evaluate")
    at = int(total * (1.0 - fraction))
    newer = F.sum("n").over(Window.orderBy(F.desc("day")))  # one row per day
    day = days.withColumn("upto", newer).where(F.col("upto") > at).orderBy("upto").limit(1).select("day", (F.lit(at) - F.col("upto") + F.col("n")).alias("skip"))
    ranked = c.join(F.broadcast(day), "day").withColumn("r", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("ts"), "sha")))
    return ranked.where(F.col("r") == F.col("skip") + 1).select("sha", "ts")


def eval_set(commits: DataFrame, current: DataFrame, after_ts: int, limit: int | None = 200, seed: int = 0, max_files: int = 12, min_length: int = 15) -> DataFrame:
    """(sha, ts, query, files) of (sha, ts, subject, body, path) after a time, with files (path) that are still there."""
    rows = commits.where((F.col("ts") > after_ts) & ~F.col("path").rlike(EVAL_NOISE_PATH))
    rows = rows.select("sha", "ts", eval_query("subject", "body").alias("query"), "path").distinct()
    rows = rows.where(~F.col("query").rlike(PROCESS_SUBJECT) & (F.length("query") >= min_length)).join(current.select("path").distinct(), "path", "left_semi")
    sizes = rows.groupBy("sha").agg(F.count("*").alias("n")).where((F.col("n") >= 1) & (F.col("n") <= max_files))
    out = rows.join(sizes, "sha", "left_semi").groupBy("sha", "ts", "query").agg(F.array_sort(F.collect_list("path")).alias("files"))
    return out if limit is None else out.orderBy(F.xxhash64(F.lit(seed), "sha")).limit(limit)


def hits_to_files(hits: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, path, rank): files in the order of their best hit; hits: (query_id, rank, source_file)."""
    best = hits.where("source_file is not null and source_file <> ''").groupBy("query_id", F.col("source_file").alias("path")).agg(F.min("rank").alias("best"))
    w = Window.partitionBy("query_id").orderBy("best", "path")
    out = best.withColumn("rank", F.row_number().over(w)).drop("best")
    return out if k is None else out.where(F.col("rank") <= k)


def scores(files: DataFrame, truth: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(query_id, recall_<k>..., rr) for each query of truth (query_id, path), which is distinct."""
    t = truth.select("query_id", "path").distinct()
    j = t.join(files.select("query_id", "path", "rank"), ["query_id", "path"], "left")
    hit = [(F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"recall_{k}") for k in ks]
    return j.groupBy("query_id").agg(*hit, F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("rr"))


def group_scores(files: DataFrame, asked: DataFrame, members: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """scores() where a query's truth is a group: asked (query_id, group), members (path, group), a path in one group at most.

    Groups are counted and hits looked up in them, so the pairs of queries and members, which grow with the square of both, are never spelled out.
    """
    sizes = members.groupBy("group").agg(F.count("*").alias("_n"))
    mine = files.select("query_id", "path", "rank").join(asked, "query_id").join(members.select("path", F.col("group").alias("_g")), "path").where("_g = `group`")
    hit = mine.groupBy("query_id").agg(*(F.count_if(F.col("rank") <= k).alias(f"_h{k}") for k in ks), F.min("rank").alias("_best"))
    j = asked.join(sizes, "group").join(hit, "query_id", "left")
    recall = [(F.coalesce(F.col(f"_h{k}"), F.lit(0)) / F.col("_n")).alias(f"recall_{k}") for k in ks]
    return j.select("query_id", *recall, F.coalesce(1.0 / F.col("_best"), F.lit(0.0)).alias("rr"))


@dataclass
class Rung:
    name: str
    n: int = 0
    recall: dict[int, float] = field(default_factory=dict)
    mrr: float = 0.0
    seconds: float = 0.0
    each: dict[int, list[float]] = field(default_factory=dict)
    note: str = ""


def run_ladder(rungs: dict[str, Callable[[DataFrame], DataFrame] | None], items: DataFrame, truth: DataFrame, ks: tuple[int, ...] = KS) -> list[Rung]:
    """Mean recall and reciprocal rank of each rung, a function from (query_id, query) to hits; None is skipped."""
    out, n = [], items.count()
    for name, search in rungs.items():
        if search is None or not n:
            out.append(Rung(name, note="no dense index: skipped" if n else "no items"))
            continue
        began = time.time()
        rows = scores(hits_to_files(search(items), max(ks)), truth, ks).orderBy("query_id").collect()
        out.append(Rung(name, len(rows), {k: float(np.mean([r[f"recall_{k}"] for r in rows])) for k in ks}, float(np.mean([r["rr"] for r in rows])), (time.time() - began) / max(1, len(rows)), {k: [r[f"recall_{k}"] for r in rows] for k in ks}))
    return out


#: The modulus of the draws' numbers, a prime.
PRIME = 2**31 - 1


def thresholds() -> list[int]:
    """Numbers below PRIME that a draw passes as often as a Poisson number with mean 1 is at least 1, 2, ... 8."""
    below, p, out = 0.0, math.exp(-1.0), []
    for k in range(1, 9):
        below += p
        p /= k
        out.append(int(below * PRIME))
    return out


def draw(key: Column, i: Column, seed: int) -> Column:
    """A number from 0 to PRIME - 1 for a key and a resample: squares of sums, modulo a prime. The same in any engine with 64-bit integers."""
    x = F.pmod(F.pmod(key, F.lit(PRIME)) * 48_271 + F.pmod(i, F.lit(PRIME)) * 69_621 + (seed % 1_000_003 + 1) * 40_692, F.lit(PRIME))
    for c in (12_345, 67_891, 23_456):
        x = F.pmod(x * x + c + i * 1_009, F.lit(PRIME))
    return x


def poisson(u: Column) -> Column:
    """How often a row is drawn: a Poisson number with mean 1, by the thresholds that a number from draw() has passed."""
    return sum(((u >= t).cast("int") for t in thresholds()), F.lit(0))


def paired_bootstrap(diffs: DataFrame, iterations: int = 2000, seed: int = 0) -> DataFrame:
    """One row (delta, lo, hi): the mean of diffs (key long, diff) and the bounds of its resampled means.

    Resampling with Poisson weights needs one pass: each row adds its weighted value to the sums of all resamples, which are aggregated
    where the row is. The draws depend on the key and the seed alone, so results don't depend on how rows are dealt out.
    """
    each = diffs.select("key", "diff", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(iterations - 1).cast("long"))).alias("i"))
    weighted = each.withColumn("w", poisson(draw(F.col("key").cast("long"), F.col("i"), seed)))
    means = weighted.groupBy("i").agg(F.sum(F.col("w") * F.col("diff")).alias("s"), F.sum("w").alias("n")).where("n > 0").select((F.col("s") / F.col("n")).alias("m"))
    ranked = means.agg(F.array_sort(F.collect_list("m")).alias("m"))  # one number per resample
    observed = diffs.agg(F.avg("diff").alias("delta"))
    n = F.size("m")
    at = lambda i: F.get("m", F.greatest(F.lit(0), i.cast("int")))
    return observed.crossJoin(ranked).select("delta", at(F.floor(n * 0.025)).alias("lo"), at(F.floor(n * 0.975) - 1).alias("hi"))


def bootstrap(a: list[float], b: list[float], iterations: int = 2000, seed: int = 0) -> tuple[float, float, float]:
    """The same for two short lists on the driver, whose positions are the keys."""
    if not a or len(a) != len(b):
        return 0.0, 0.0, 0.0
    d = np.asarray(b, float) - np.asarray(a, float)
    i, key = np.arange(iterations, dtype=np.int64)[:, None], np.arange(len(d), dtype=np.int64)[None, :]
    x = (key * 48_271 + i * 69_621 + (seed % 1_000_003 + 1) * 40_692) % PRIME
    for c in (12_345, 67_891, 23_456):
        x = (x * x + c + i * 1_009) % PRIME
    w = sum((x >= t).astype(np.int64) for t in thresholds())
    n = w.sum(axis=1)
    means = np.sort((w @ d)[n > 0] / n[n > 0])
    return float(d.mean()), float(means[int(0.025 * len(means))]), float(means[max(0, int(0.975 * len(means)) - 1)])


# Words of the report.
def verdict(lo: float, hi: float) -> str:
    return "significant" if lo > 0 else "regression" if hi < 0 else "not significant"


def comparisons(rungs: list[Rung], ks: tuple[int, ...] = KS) -> list[tuple[str, str, int, float, float, float, str, bool]]:
    """(from, to, k, delta, lo, hi, verdict, near ceiling): neighbours at the largest k, then the first and the last rung at each k."""
    live = [r for r in rungs if r.n]
    pairs = [(a, b, max(ks)) for a, b in zip(live, live[1:])] + [(live[0], live[-1], k) for k in sorted(ks) if len(live) > 1]
    out = []
    for j, (a, b, k) in enumerate(pairs):
        d, lo, hi = bootstrap(a.each[k], b.each[k])
        out.append((a.name, b.name, k, d, lo, hi, verdict(lo, hi), j >= len(live) - 1 and a.recall[k] > 0.8))
    return out


def report(rungs: list[Rung], ks: tuple[int, ...] = KS) -> str:
    live = [r for r in rungs if r.n]
    if not live:
        return "no rung has results"
    lines = [f"{live[0].n} held-out changes", "rung | " + " | ".join(f"R@{k}" for k in ks) + " | MRR | s/query"]
    for r in rungs:
        lines.append(f"{r.name} | " + (" | ".join(f"{r.recall[k]:.3f}" for k in ks) + f" | {r.mrr:.3f} | {r.seconds:.3f}" if r.n else r.note))
    for a, b, k, d, lo, hi, said, near in comparisons(rungs, ks):
        lines.append(f"{a} -> {b}, R@{k}: {d:+.3f} [{lo:+.3f}, {hi:+.3f}] {said}{' (baseline near ceiling)' * near}")
    return "\n".join(lines)
