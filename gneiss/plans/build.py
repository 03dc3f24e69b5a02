"""From a source tree or a graph file to node and edge tables."""

from __future__ import annotations

import posixpath
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gneiss.functions.identity import content_hash
from gneiss.functions.text import ingest_label, start_line
from gneiss.operators import community, graph, ingest
from gneiss.sources import tree
from gneiss.sources.imports import import_edges
from gneiss.sources.spans import spans as extract_spans

NODE_COLUMNS = ["idx", "node_key", "id", "label", "kind", "file_type", "source_file", "start_line", "end_line", "signature", "docstring", "community", "community_name", "content_hash"]


def top_folder(path: str) -> str:
    return path.split("/", 1)[0] if "/" in path else "(root)"


def community_name(members: list[str]) -> str:
    """The folders that all members share, else the most frequent top folder, ties by name."""
    shared = posixpath.commonpath([posixpath.dirname(m) or "." for m in members]) if all("/" in m for m in members) else ""
    if shared:
        return shared
    n = Counter(top_folder(m) for m in members)
    return min(n, key=lambda d: (-n[d], d))


def name_communities(group: dict[str, int], files: list[str]) -> dict[str, tuple[int, str]]:
    """(number, name) of each file: groups of two or fewer files join those of their top folder; numbers by falling size, then by members."""
    sets: dict = defaultdict(set)
    for f in files:
        sets[("g", group[f]) if f in group else ("f", f)].add(f)
    large = [s for s in sets.values() if len(s) > 2]
    rest: dict[str, set] = defaultdict(set)
    for s in sets.values():
        if len(s) <= 2:
            for f in s:
                rest[top_folder(f)].add(f)
    out = {}
    for i, s in enumerate(sorted([*large, *rest.values()], key=lambda s: (-len(s), sorted(s)))):
        name = community_name(sorted(s))
        out |= {f: (i, name) for f in s}
    return out


def communities(spark: SparkSession, files: DataFrame, edges: DataFrame, method: str = "moves") -> DataFrame:
    """(path, community, community_name) by the import graph of a repository.

    moves: modularity moves on the cluster; labels: label propagation, coarser and cheaper; louvain: moves one by one on the driver, for a graph
    that fits it. All number and name communities by the same rules; which one runs is the caller's choice alone.
    """
    if method == "louvain":
        group = graph.louvain([(r["importer"], r["target"]) for r in edges.toLocalIterator()])
        named = name_communities(group, [r["path"] for r in files.select("path").distinct().toLocalIterator()])
        return spark.createDataFrame([(p, c, n) for p, (c, n) in sorted(named.items())] or [], "path string, community long, community_name string")
    if method not in ("moves", "labels"):
        raise ValueError(f"no method {method}; there are moves, labels and louvain")
    ids = files.select("path").distinct().withColumn("idx", F.xxhash64("path"))
    e = edges.select(F.xxhash64("importer").alias("src"), F.xxhash64("target").alias("dst"))
    found = community.communities(e) if method == "moves" else community.label_communities(e)
    return named_groups(ids.join(found, "idx", "left").select("path", F.col("community").alias("g")))


def named_groups(groups: DataFrame) -> DataFrame:
    """(path, community, community_name) of (path, g): groups of two or fewer files, and files without one, join those of their top folder;
    numbers by falling size, then by the smallest member; the name is the folders that all members share, else the most frequent top folder."""
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(F.lit("(root)"))
    sizes = groups.where("g is not null").groupBy("g").agg(F.count("*").alias("n"))
    key = F.when(F.col("n") > 2, F.concat(F.lit("g"), F.col("g").cast("string"))).otherwise(F.concat(F.lit("f"), F.col("top")))
    keyed = groups.join(sizes, "g", "left").withColumn("top", top).select("path", "top", key.alias("key"))
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    # folders that the smallest and the largest path share, but for sorting by parts, are shared by all
    ends = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("path").alias("first"), F.min(folders).alias("lo"), F.max(folders).alias("hi"))
    most = keyed.groupBy("key", "top").agg(F.count("*").alias("m")).groupBy("key").agg(F.min_by("top", F.struct(-F.col("m"), "top")).alias("often"))
    same = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size("lo"), F.size("hi")))), lambda i: F.get("lo", i - 1) == F.get("hi", i - 1))
    shared = F.slice("lo", 1, F.coalesce(F.nullif(F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), F.lit(False)), F.lit(0)) - 1, F.size("lo")).cast("int"))
    named = ends.join(most, "key").select("key", "n", "first", F.coalesce(F.nullif(F.array_join(shared, "/"), F.lit("")), "often").alias("community_name"))
    numbered = named.withColumn("community", F.row_number().over(Window.orderBy(F.desc("n"), "first")).cast("long") - 1)  # one row for each community
    return keyed.join(numbered, "key").select("path", "community", "community_name")


def graph_of_tree(spark: SparkSession, root: str, most: int = tree.MOST_TEXT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, links, files, spans): raw nodes and links of a tree, files of `most` bytes at most, and what they were made of."""
    files = tree.scan(spark, root, most).persist()
    found = extract_spans(files.where("not is_doc")).persist()
    imports = import_edges(files)
    groups = communities(spark, files, imports)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    file_nodes = files.select(F.col("path").alias("id"), name.alias("label"), F.when(F.col("is_doc"), "document").otherwise("code").alias("file_type"), F.when(~F.col("is_doc"), F.lit("file")).alias("kind"), F.col("path").alias("source_file"), F.lit("L1").alias("source_location"))
    symbol = F.concat_ws("::", "path", "name", F.col("start_line").cast("string"))
    symbols = found.select(symbol.alias("id"), F.col("name").alias("label"), F.lit("code").alias("file_type"), "kind", F.col("path").alias("source_file"), F.concat(F.lit("L"), "start_line").alias("source_location"))
    nodes = file_nodes.unionByName(symbols).join(groups.withColumnRenamed("path", "source_file"), "source_file", "left")
    first = found.groupBy("path", F.col("qualified").alias("parent")).agg(F.min(F.struct("start_line", "name")).alias("p"))
    parents = found.join(first, ["path", "parent"], "left")
    holder = F.coalesce(F.concat_ws("::", F.when(F.col("p").isNotNull(), F.col("path")), "p.name", F.col("p.start_line").cast("string")), F.col("path"))
    holder = F.when(F.col("p").isNull(), F.col("path")).otherwise(holder)
    contains = parents.select(holder.alias("source"), symbol.alias("target"), F.lit("contains").alias("relation"))
    links = contains.unionByName(imports.select(F.col("importer").alias("source"), F.col("target"), F.lit("imports").alias("relation")))
    return nodes, links.withColumn("weight", F.lit(1.0)).withColumn("confidence_score", F.lit(1.0)), files, found


def node_table(raw: DataFrame, files: DataFrame, spans: DataFrame) -> DataFrame:
    """NODE_COLUMNS of raw nodes, with their spans, kinds, keys and content hashes, numbered without gaps."""
    have = set(raw.columns)
    col = lambda c, t="string": F.col(c) if c in have else F.lit(None).cast(t)
    n = raw.select("id", col("label").alias("label"), col("file_type").alias("file_type"), col("kind").alias("own_kind"), col("source_file").alias("source_file"), start_line(col("source_location")).alias("line"), col("community", "long").cast("long").alias("community"), col("community_name").alias("community_name"))
    n = n.withColumn("clean", ingest_label("label"))
    m = ingest.match_spans(n, spans)
    lines = files.select(F.col("path").alias("source_file"), tree.line_array("text").alias("lines"))
    m = m.join(lines.select("source_file", F.size("lines").alias("n_lines")), "source_file", "left")
    kind = ingest.infer_kind(F.col("span_kind"), F.col("own_kind"), F.col("file_type"), F.col("label"))
    m = m.withColumn("kind", kind)
    whole = (F.col("kind") == "file") & F.col("span_kind").isNull() & F.col("n_lines").isNotNull()
    start = F.when(whole, F.lit(1)).otherwise(F.coalesce("start_line", "line"))
    end = F.when(whole, F.col("n_lines")).otherwise(F.coalesce("end_line", start))
    m = m.withColumn("start_line", start).withColumn("end_line", end)
    # whole bodies tell nodes: the lines of a file meet each extent in it once, where they lie, and only hashes leave with the nodes
    m = m.withColumn("first", F.greatest(F.col("start_line"), F.lit(1))).withColumn("length", F.col("end_line") - F.col("start_line") + 1)
    extents = m.where("length > 0").select("source_file", "first", "length").distinct()
    body = F.nullif(F.array_join(F.slice("lines", F.col("first"), F.col("length")), "\n"), F.lit(""))
    hashed = lines.repartition("source_file").join(extents, "source_file").select("source_file", "first", "length", F.when(body.isNotNull(), content_hash(body)).alias("hash"))
    m = m.join(hashed, ["source_file", "first", "length"], "left")
    fallback = F.concat_ws(":", F.coalesce("source_file", F.lit("")), F.coalesce("label", F.lit("")))
    m = m.withColumn("content_hash", F.coalesce("hash", content_hash(fallback))).withColumn("signature", F.coalesce("signature", F.lit(""))).withColumn("docstring", F.coalesce("docstring", F.lit(""))).drop("n_lines", "first", "length", "hash")
    keyed = ingest.dedupe_keys(m.select("*", F.col("source_file").alias("path"), F.struct("source_file", "start_line", "id").alias("ord")).drop("label").withColumnRenamed("clean", "label"))
    keyed = keyed.join(raw.select("id", F.col("label").alias("raw_label")).dropDuplicates(["id"]), "id")
    return ingest.with_idx(keyed.withColumn("label", F.col("raw_label")), ["source_file", "start_line", "id"]).select(NODE_COLUMNS)


def documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(idx, doc): the retrieval document of each node, with the labels of its first twelve neighbours."""
    from gneiss.functions.text import node_text

    ordered = edges.select(F.struct("src", "dst", "relation").alias("ord"), "src", "dst")
    near = graph.neighbour_cap(ordered, nodes)
    j = nodes.join(near, "idx", "left")
    return j.select("idx", node_text("label", "kind", "source_file", "signature", "docstring", "neighbours").alias("doc"))
