"""Reporting queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from gneiss.functions.identity import member_hash

def cochange_partners(pairs: DataFrame, path: str, n: int = 10) -> DataFrame:
    hit = pairs.where((F.col("path_a") == path) | (F.col("path_b") == path))
    other = F.when(F.col("path_a") == path, F.col("path_b")).otherwise(F.col("path_a"))
    return hit.select(other.alias("other"), "support", "n_ab", "lift").orderBy(F.desc("support"), "other").limit(n)


def hotspots(files: DataFrame, n: int = 20) -> DataFrame:
    return files.where("hotspot > 0").orderBy(F.desc("hotspot"), "path").limit(n)


def owners(ownership: DataFrame, path: str, n: int = 10) -> DataFrame:
    return ownership.where(F.col("path") == path).orderBy(F.desc("n_commits"), "author").select("author", "n_commits").limit(n)


def impact_owners(hits: DataFrame, files: DataFrame, n: int = 10) -> DataFrame:
    """Owners of the files of the n best hits (source_file, rank)."""
    f = hits.where(F.col("rank") <= n).select(F.col("source_file").alias("path")).distinct()
    return files.where("primary_owner is not null").join(f, "path", "left_semi").select("path", "primary_owner", "owner_share", "bus_factor")


def impact_split(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits that history explains, and the others."""
    by_history = F.col("why").contains("co-change")
    return hits.where(by_history), hits.where(~by_history)


def stats(nodes: DataFrame, edges: DataFrame, files: DataFrame, pairs: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """One row of counts."""
    out = nodes.agg(F.count("*").alias("nodes"), F.count_distinct("community").alias("communities"))
    out = out.crossJoin(edges.agg(F.count_if(F.col("channel") == "structural").alias("structural_edges"), F.count_if(F.col("channel") == "temporal").alias("temporal_edges")))
    out = out.crossJoin(files.agg(F.count("*").alias("files"))).crossJoin(pairs.agg(F.count("*").alias("cochange_pairs")))
    return out if summaries is None else out.crossJoin(summaries.agg(F.count("*").alias("summaries")))


def member_hashes(nodes: DataFrame) -> DataFrame:
    """(community, size, member_hash): node hashes are summed up per chunk of 10,000 members, then the chunks, in idx order."""
    chunk = F.floor(F.col("idx") / 10_000)
    parts = nodes.where("community is not null").groupBy("community", chunk.alias("chunk")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "node_key", "content_hash"))).alias("m"))
    parts = parts.select("community", "chunk", "n", member_hash(F.transform("m", lambda x: F.concat_ws(":", x["node_key"], x["content_hash"]))).alias("h"))
    out = parts.groupBy("community").agg(F.sum("n").alias("size"), F.array_sort(F.collect_list(F.struct("chunk", "h"))).alias("c"))
    return out.select("community", "size", member_hash(F.transform("c", lambda x: x["h"])).alias("member_hash"))


def overview(nodes: DataFrame, summaries: DataFrame, n: int = 12) -> DataFrame:
    """Summaries whose members are unchanged, largest community first; n = 0 gives none, n < 0 all."""
    m = member_hashes(nodes)
    out = summaries.join(m, ["community", "member_hash"]).select("community", "name", "size", "summary").orderBy(F.desc("size"), "community")
    return out if n < 0 else out.limit(n)


def prompts(nodes: DataFrame, n: int, sample: int = 40) -> DataFrame:
    """(community, name, member_hash, size, members) of the n largest communities, with at most `sample` members each."""
    from pyspark.sql import Window

    sizes = member_hashes(nodes).orderBy(F.desc("size"), "community").limit(n)
    w = Window.partitionBy("community").orderBy("idx")
    some = nodes.join(F.broadcast(sizes.select("community")), "community").withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "label", "kind"))), lambda x: F.concat_ws(" ", x["kind"], x["label"])), "\n")
    return sizes.join(some.groupBy("community").agg(F.max("community_name").alias("name"), text.alias("members")), "community")


def summarize(nodes: DataFrame, cached: DataFrame, caller: Callable[[str], str], n: int = 12) -> tuple[DataFrame, dict]:
    """New community summaries, kept where members are unchanged; caller makes the others. At most n rows reach the driver."""
    counts, rows = {"written": 0, "cached": 0, "errors": []}, []
    have = {r["community"]: r for r in cached.join(F.broadcast(prompts(nodes, n).select("community")), "community", "left_semi").collect()}
    for p in prompts(nodes, n).collect():
        old = have.get(p["community"])
        if old is not None and old["member_hash"] == p["member_hash"]:
            rows.append((p["community"], old["name"], old["member_hash"], old["summary"]))
            counts["cached"] += 1
            continue
        try:
            rows.append((p["community"], p["name"], p["member_hash"], caller(f"Summarize {p['name']}:\n{p['members']}")))
            counts["written"] += 1
        except Exception as e:  # the caller is the user's; its error is part of the report
            counts["errors"].append(f"{p['name']}: {e}")
    return nodes.sparkSession.createDataFrame(rows, "community long, name string, member_hash string, summary string"), counts
