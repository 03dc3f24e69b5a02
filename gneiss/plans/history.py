"""The history layer of an index, and the commits that it is made of.

An epoch keeps the commits that were read (history/commits) and how often two files met in commits of a size (history/pairs). A refresh reads
the commits since the last one, adds their rows and pair counts, and takes away those of commits that a whole reading would no longer take; the
pairs of the rest, the costly part, are not made again. Tables with a row for each file or author come from the stored commits by one grouping.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, functions as F

from gneiss.operators import graph, ingest, temporal
from gneiss.plans.checkpoint import truncate
from gneiss.plans.store import Epoch
from gneiss.sources import history

COMMITS, PAIRS = "history/commits", "history/pairs"
#: Parts of the pair counts that are merged into one when there are more.
PARTS = 8


def add(epoch: Epoch, rows: DataFrame, max_files: int) -> None:
    """Add commits (sha, ts, author, path; no path for a commit without files) that aren't there yet."""
    epoch.append(COMMITS, rows.select("sha", "ts", "author", "path"))
    epoch.append(PAIRS, temporal.pair_counts(temporal.touches(rows), max_files))
    if len(epoch.tables[PAIRS]) > PARTS:
        epoch.write(PAIRS, temporal.merged_counts(epoch.read(PAIRS)))


def take(epoch: Epoch, gone: DataFrame, max_files: int) -> None:
    """Take away commits (sha) that are there."""
    rows = epoch.read(COMMITS)
    out = truncate(rows.join(gone, "sha", "left_semi"))
    epoch.append(PAIRS, temporal.pair_counts(temporal.touches(out), max_files, sign=-1))
    epoch.write(COMMITS, rows.join(gone, "sha", "left_anti"))


def mined(epoch: Epoch, root: str, config: temporal.HistoryConfig = temporal.HistoryConfig()) -> dict:
    """Bring the stored commits up to the repository's head; how many commits were read and taken away, and whether all were read.

    All are read if there are none yet, if they were read by other settings, or if the head they were read at is no longer in the history.
    The cutoff config.before_ts is no matter of reading: enrich_stored looks at it.
    """
    config = dataclasses.replace(config, before_ts=None)
    settings = {"max_commits": config.max_commits, "since": config.since, "follow_renames": config.follow_renames, "max_files": config.max_files}
    now, was = history.head(root), epoch.meta().get("history", {})
    n = lambda rows: rows.select("sha").distinct().count()
    known = COMMITS in epoch and was.get("settings") == settings and history.is_ancestor(root, was["head"], now)
    done = None
    if known:
        old = epoch.read(COMMITS)
        new = history.log_of(epoch.spark, root, config, f"{was['head']}..{now}")
        had, come, gone = n(old), n(new), 0
        if config.since or had + come > config.max_commits:
            keep = history.kept(epoch.spark, root, config, now)
            away = truncate(old.select("sha").distinct().join(keep, "sha", "left_anti"))
            gone = away.count()
            new = new.join(keep, "sha", "left_semi")
            known = not keep.join(old.select("sha").union(new.select("sha")), "sha", "left_anti").limit(1).count()
            if known and gone:
                take(epoch, away, config.max_files)
        if known:
            if come:
                add(epoch, new, config.max_files)
            done = {"read": come, "gone": gone, "whole": False}
    if not known:
        epoch.drop(COMMITS, PAIRS)
        rows = history.log_of(epoch.spark, root, config, now)
        add(epoch, rows, config.max_files)
        done = {"read": n(rows), "gone": 0, "whole": True}
    epoch.put_meta(history={"head": now, "settings": settings})
    return done


def enrich_stored(epoch: Epoch, as_of: float, config: temporal.HistoryConfig = temporal.HistoryConfig()) -> dict:
    """The history layer of the stored commits. With a cutoff, of those before it: the pair counts of later ones are subtracted."""
    rows, counts, before = epoch.read(COMMITS), epoch.read(PAIRS), config.before_ts
    if before is not None:
        inside = F.coalesce(F.col("ts") < before, F.lit(False))
        # touches with a cutoff count from the first second on
        off = temporal.touches(rows.where(~inside | (F.col("ts") <= 0)))
        counts, rows = counts.unionByName(temporal.pair_counts(off, config.max_files, sign=-1)), rows.where(inside)
    return enrich(epoch, rows, rows.select("sha").distinct().count(), as_of, config, counts)


def refresh(epoch: Epoch, root: str, as_of: float, config: temporal.HistoryConfig = temporal.HistoryConfig()) -> dict:
    read = mined(epoch, root, config)
    return enrich_stored(epoch, as_of, config) | read


def enrich(epoch: Epoch, commits: DataFrame, n_commits: int, as_of: float, config: temporal.HistoryConfig = temporal.HistoryConfig(), counts: DataFrame | None = None) -> dict:
    """Write files, ownership, cochange and the temporal edges from commits (sha, ts, author, path), the pairs from their counts if these are given."""
    t = temporal.touches(commits, config.before_ts).persist()
    nodes = epoch.read("nodes")
    lines = nodes.where("kind = 'file'").groupBy(F.col("source_file").alias("path")).agg(F.max("end_line").alias("lines")) if nodes is not None else t.select("path").distinct().withColumn("lines", F.lit(0))
    table = temporal.file_table(t, lines, as_of, config.half_life_days)
    old = epoch.read("files")
    if old is not None:
        keep = [c for c in old.columns if c not in table.columns or c == "path"]
        table = ingest.upsert(old.select(*keep, *(F.col(c) if c in old.columns else F.lit(None).cast(dict(table.dtypes)[c]).alias(c) for c in table.columns if c != "path")), table, "path", [c for c in table.columns if c != "path"])
    epoch.write("files", table)
    epoch.write("ownership", temporal.ownership(t))
    pairs = temporal.cochange_pairs(t, n_commits, config.max_files) if counts is None else temporal.pairs_of(counts, t, n_commits)
    pairs = temporal.significant(pairs, config.min_count, config.min_support, config.max_p)
    epoch.write("cochange", pairs)
    epoch.write("cochange_groups", graph.components(epoch.read("cochange").select(F.col("path_a").alias("a"), F.col("path_b").alias("b"))))
    if nodes is not None:
        epoch.write_edges(temporal.temporal_edges(epoch.read("cochange"), nodes, config.edge_min_support), "temporal")
    t.unpersist()
    epoch.put_meta(n_commits=n_commits, as_of=as_of)
    return {"commits": n_commits, "pairs": epoch.read("cochange").count(), "files": epoch.read("files").count()}
