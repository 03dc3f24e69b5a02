"""Statistics of a change history.

commits: one row per commit and file, (sha, ts long seconds, author, path); rows may repeat. Times come as an argument
(`as_of`), never from the clock, so results can be repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from gneiss.functions import stats
from gneiss.functions.text import is_noise
from gneiss.plans.checkpoint import truncate


@dataclass(frozen=True)
class HistoryConfig:
    """Defaults of the miner: how far to read, and what a pair must show to be kept."""

    max_commits: int = 20_000
    since: str | None = None
    follow_renames: bool = True
    before_ts: int | None = None
    min_count: int = 3
    min_support: float = 0.3
    edge_min_support: float = 1.0
    max_p: float = 0.01
    max_files: int = 400
    half_life_days: float = 90.0


def touches(commits: DataFrame, before_ts: int | None = None, noise: bool = True) -> DataFrame:
    """Distinct (sha, ts, author, path) of files that count, older than a cutoff if there is one."""
    out = commits.where(F.col("path").isNotNull())
    if noise:
        out = out.where(~is_noise("path"))
    if before_ts is not None:
        out = out.where((F.col("ts") > 0) & (F.col("ts") < before_ts))
    # dealt out by commit: rows are told apart, counted and met within commits where they lie
    return out.select("sha", "ts", "author", "path").repartition("sha").distinct()


def file_counts(t: DataFrame) -> DataFrame:
    return t.groupBy("path").agg(F.count("*").alias("n_commits"))


def churn(t: DataFrame, as_of: float, half_life_days: float = 90.0) -> DataFrame:
    return t.groupBy("path").agg(F.sum(stats.decayed(F.col("ts"), as_of, half_life_days)).alias("churn"))


def first_last_touch(t: DataFrame) -> DataFrame:
    return t.groupBy("path").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_modified"))


def cochange_pairs(t: DataFrame, n_commits: int | None = None, max_files: int = 400) -> DataFrame:
    """(path_a, path_b, n_ab, support, n_a, n_b, lift, g_stat) with path_a < path_b.

    A commit of n files gives each of its pairs a support of 1 / C(n, 2). Commits of more than max_files files give no
    pairs (they count in n_a): sizes are filtered before the join, so no commit can make more than C(max_files, 2) rows.
    The touches are stored once: sizes, both sides of the join and the files' counts read them.
    """
    t = truncate(t.select("sha", "path"))
    sizes = t.groupBy("sha").agg(F.count("*").alias("n"))
    total = t.sparkSession.range(1).select(F.lit(n_commits).cast("long").alias("_n")) if n_commits is not None else sizes.agg(F.count("*").alias("_n"))
    kept = t.join(sizes.where((F.col("n") >= 2) & (F.col("n") <= max_files)), "sha")
    a = kept.select("sha", "n", F.col("path").alias("path_a"))
    b = kept.select(F.col("sha").alias("sha_b"), F.col("path").alias("path_b"))
    pairs = a.join(b, F.expr("sha = sha_b and path_a < path_b"))
    size = F.col("n").cast("double")
    pairs = pairs.groupBy("path_a", "path_b").agg(F.count("*").alias("n_ab"), F.sum(2.0 / (size * (size - 1.0))).alias("support"))
    return _scored(pairs, file_counts(t), total)


def _scored(pairs: DataFrame, counts: DataFrame, total: DataFrame) -> DataFrame:
    pairs = pairs.join(counts.toDF("path_a", "n_a"), "path_a").join(counts.toDF("path_b", "n_b"), "path_b").crossJoin(F.broadcast(total))
    cols = [F.col(c) for c in ("n_ab", "n_a", "n_b", "_n")]
    return pairs.select("path_a", "path_b", "n_ab", "support", "n_a", "n_b", stats.lift(*cols).alias("lift"), stats.g_statistic(*cols).alias("g_stat"))


def pair_counts(t: DataFrame, max_files: int = 400, sign: int = 1) -> DataFrame:
    """(path_a, path_b, size, n): how often two files met in commits of a size; with sign -1 the counts that take these commits away again.

    Whole numbers add up and cancel without a rest, which sums of supports would not; pairs_of makes supports of them.
    """
    sized = t.select("sha", "path", F.count("*").over(Window.partitionBy("sha")).alias("size"))
    kept = truncate(sized.where((F.col("size") >= 2) & (F.col("size") <= max_files)))
    a, b = kept.select("sha", "size", F.col("path").alias("path_a")), kept.select(F.col("sha").alias("sha_b"), F.col("path").alias("path_b"))
    return a.join(b, F.expr("sha = sha_b and path_a < path_b")).groupBy("path_a", "path_b", "size").agg((F.count("*") * sign).cast("long").alias("n"))


def merged_counts(counts: DataFrame) -> DataFrame:
    """Pair counts of several parts as one, without those that cancel."""
    return counts.groupBy("path_a", "path_b", "size").agg(F.sum("n").alias("n")).where("n <> 0")


def pairs_of(counts: DataFrame, t: DataFrame, n_commits: int) -> DataFrame:
    """The rows of cochange_pairs from the pair counts of touches t."""
    size = F.col("size").cast("double")
    pairs = merged_counts(counts).groupBy("path_a", "path_b").agg(F.sum("n").alias("n_ab"), F.sum(F.col("n") * (2.0 / (size * (size - 1.0)))).alias("support"))
    return _scored(pairs, file_counts(t), t.sparkSession.range(1).select(F.lit(n_commits).cast("long").alias("_n")))


def significant(pairs: DataFrame, min_count: int = 3, min_support: float = 0.3, max_p: float = 0.01) -> DataFrame:
    """Pairs that meet often enough. The statistic is compared with its quantile first, so only pairs that are kept get a p-value."""
    kept = pairs.where((F.col("n_ab") >= min_count) & (F.col("support") >= min_support))
    if max_p < 1:
        kept = kept.where(F.col("g_stat") >= stats.chi2_quantile(max_p) * (1 - 1e-12))
    return kept.withColumn("p_value", stats.p_value(F.col("g_stat"))).where(F.col("p_value") <= max_p)


def ownership(t: DataFrame) -> DataFrame:
    """(path, author, n_commits, last_ts)."""
    return t.groupBy("path", "author").agg(F.count("*").alias("n_commits"), F.max("ts").alias("last_ts"))


def _ranked():
    return Window.partitionBy("path").orderBy(F.desc("n_commits"), F.desc("last_ts"), "author")


def primary_owner(owners: DataFrame) -> DataFrame:
    """(path, primary_owner, owner_share, n_authors); ties go to the author seen last, then by name."""
    w = _ranked()
    first = owners.withColumn("r", F.row_number().over(w)).where("r = 1").select("path", F.col("author").alias("primary_owner"), F.col("n_commits").alias("top"))
    totals = owners.groupBy("path").agg(F.sum("n_commits").alias("total"), F.count("*").alias("n_authors"))
    return first.join(totals, "path").select("path", "primary_owner", (F.col("top") / F.col("total")).alias("owner_share"), "n_authors")


def bus_factor(owners: DataFrame) -> DataFrame:
    """(path, bus_factor): the fewest top authors with half of the commits."""
    w = _ranked()
    run = owners.withColumn("r", F.row_number().over(w)).withColumn("cum", F.sum("n_commits").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("total", F.sum("n_commits").over(Window.partitionBy("path")))
    return run.where(2 * F.col("cum") >= F.col("total")).groupBy("path").agg(F.min("r").cast("long").alias("bus_factor"))


def hotspots(churned: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, churn, complexity, hotspot) from (path, churn) and (path, lines): complexity is log(1 + lines)."""
    j = churned.join(lines, "path", "left")
    complexity = F.when(F.coalesce("lines", F.lit(0)) > 0, F.log1p("lines")).otherwise(F.lit(0.0))
    return j.select("path", "churn", complexity.alias("complexity"), (F.col("churn") * complexity).alias("hotspot"))


def file_table(t: DataFrame, lines: DataFrame, as_of: float, half_life_days: float = 90.0) -> DataFrame:
    """All per-file columns of the history."""
    base = t.groupBy("path").agg(F.count("*").alias("n_commits"), F.sum(stats.decayed(F.col("ts"), as_of, half_life_days)).alias("churn"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_modified"))
    owners = ownership(t)
    hot = hotspots(base.select("path", "churn"), lines).drop("churn")
    return base.join(hot, "path").join(primary_owner(owners), "path").join(bus_factor(owners), "path")


def file_nodes(nodes: DataFrame) -> DataFrame:
    """(path, file_idx): the first file node of each path."""
    return nodes.where("kind = 'file'").groupBy(F.col("source_file").alias("path")).agg(F.min("idx").alias("file_idx"))


def containment_edges(nodes: DataFrame) -> DataFrame:
    """File to symbol, weight 1."""
    f = file_nodes(nodes)
    return nodes.join(f, nodes["source_file"] == f["path"]).where("idx <> file_idx").select(F.col("file_idx").alias("src"), F.col("idx").alias("dst"), F.lit("file_contains").alias("relation"), F.lit(1.0).alias("weight"))


def cochange_edges(pairs: DataFrame, nodes: DataFrame, min_support: float = 1.0) -> DataFrame:
    """File to file, weight the support."""
    f = file_nodes(nodes)
    kept = pairs.where(F.col("support") >= min_support)
    out = kept.join(f.toDF("path_a", "src"), "path_a").join(f.toDF("path_b", "dst"), "path_b")
    return out.select("src", "dst", F.lit("co_changes_with").alias("relation"), F.col("support").alias("weight"))


def temporal_edges(pairs: DataFrame, nodes: DataFrame, min_support: float = 1.0) -> DataFrame:
    return containment_edges(nodes).unionByName(cochange_edges(pairs, nodes, min_support))
