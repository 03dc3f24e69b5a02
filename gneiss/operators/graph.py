"""Graph operators over edge lists.

edges: (src, dst, weight) longs and a double. Iterations are joins between stored frontiers and the edges; lineage is
cut by reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gneiss.functions.text import is_test_file
from gneiss.operators.ingest import with_idx
from gneiss.plans.checkpoint import dealt, discard, rewritten, tidy, truncate

# Fixed values of diffusion.
ALPHA, ITERATIONS, TOLERANCE, WEIGHT_FLOOR = 0.85, 30, 1e-6, 1e-4
#: Edges of a node that one task takes.
HUB = 1_000_000
#: Edges that one task sorts.
TASK_EDGES = 2_000_000
#: Nodes whose scores one task holds.
TASK_NODES = 2_000_000
#: Nodes that are sent to the edges; edges are dealt out to more.
FEW = 500_000
#: Levels of a search that are kept apart before they are stored as one.
LEVELS = 16


def weighed(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): weight x confidence_score (1 where null), WEIGHT_FLOOR at least."""
    one = F.lit(1.0)
    conf = F.coalesce("confidence_score", one) if "confidence_score" in edges.columns else one
    return edges.select("src", "dst", F.greatest(F.coalesce("weight", one) * conf, F.lit(WEIGHT_FLOOR)).alias("weight"))


def symmetric_weights(edges: DataFrame, symmetric: bool = True) -> DataFrame:
    """(src, dst, weight): weighed edges, mirrored, equal pairs summed."""
    e = weighed(edges)
    if symmetric:
        e = mirrored(e)
    return e.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def mirrored(edges: DataFrame) -> DataFrame:
    return edges.unionByName(transpose(edges))


def row_normalize(edges: DataFrame) -> DataFrame:
    """Weights divided by the sum of their row. Sums are aggregated and joined, so a hub is no window of one task."""
    total = edges.groupBy("src").agg(F.sum("weight").alias("_w"))
    return edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("_w")).alias("weight"))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def ppr(edges: DataFrame, seeds: DataFrame, alpha: float = ALPHA, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, reverse: bool = False, every: int = 5, hub: int = HUB, symmetric: bool = False) -> DataFrame:
    """(idx, score) of personalised PageRank from seeds (idx, score), a bounded number of which negative ones count as 0.

    A step spreads alpha of all scores over the edges and gives the rest to the seeds; no mass is lost. Edges may repeat, and count both ways if
    `symmetric`. They are stored as they come. Mass goes an edge further with each step, so only edges of nodes that the seeds reach in so many
    steps are normalised, and dealt out to buckets by source, once. There are as many buckets as tasks run at a time, or more for very many nodes, and not
    more for more edges: a step moves its partial sums alone, which are a sum for each bucket and node at most. Where a node has more
    than `hub` edges, they are dealt to slices, and its score is sent to each. Every few steps the
    scores are stored, and the loop ends where they have moved by less than the tolerance since the last time.
    """
    with tidy(edges.sparkSession):
        return _spread(edges, seeds, alpha, iterations, tolerance, reverse, every, hub, symmetric)


def _spread(edges: DataFrame, seeds: DataFrame, alpha: float, iterations: int, tolerance: float, reverse: bool, every: int, hub: int, symmetric: bool) -> DataFrame:
    spark = edges.sparkSession
    s = seeds.select("idx", F.greatest(F.col("score").cast("double"), F.lit(0.0)).alias("score")).groupBy("idx").agg(F.sum("score").alias("score"))
    total = s.agg(F.sum("score").alias("_t"))
    s = rewritten(s.crossJoin(F.broadcast(total)).where("_t > 0").select("idx", (F.col("score") / F.col("_t")).alias("seed")))
    came = rewritten(edges.select("src", "dst", "weight"), "zstd")
    e = transpose(came) if reverse else came
    e = mirrored(e) if symmetric else e
    near = rewritten(_searched(e.select("src", "dst"), s.select("idx"), iterations - 1).select(F.col("idx").alias("src")))
    reached = near.count()
    sums = [F.sum("weight").alias("_w"), F.count("*").alias("_n")]
    found = rewritten(e.join(F.broadcast(near), "src", "left_semi").groupBy("src").agg(*sums) if reached <= FEW else e.groupBy("src").agg(*sums).join(near, "src", "left_semi"))
    # what a node without edges holds goes back to the seeds, in their shares
    ends = near.join(found, "src", "left_anti")
    back = rewritten(ends.crossJoin(F.broadcast(s.select(F.col("idx").alias("dst"), F.col("seed").alias("weight")))))
    parts = max(spark.sparkContext.defaultParallelism, -(-reached // TASK_NODES))
    rows = dealt(found.unionByName(ends.select("src", F.lit(1.0).alias("_w"), F.lit(s.count()).cast("long").alias("_n"))), parts, "src")
    slices = F.ceil(F.col("_n") / hub).cast("int")
    hubs = rewritten(rows.select(F.col("src").alias("hub"), slices.alias("slices")).where("slices > 1"))
    keys = ["src", "slice"] if hubs.limit(1).count() else ["src"]
    e = e.unionByName(back)
    e = e.join(F.broadcast(rows) if reached <= FEW else rows.hint("shuffle_hash"), "src")
    e = e.select("src", "dst", (F.col("weight") / F.col("_w")).alias("weight"), F.pmod(F.xxhash64("dst"), slices).cast("int").alias("slice"))
    e = dealt(e.select(*keys, "dst", "weight"), parts, *keys)
    discard(came, near, found, back, rows)

    def met(p: DataFrame) -> DataFrame:
        if len(keys) == 1:
            return p.repartition(parts, "idx").hint("shuffle_hash").join(e, F.col("idx") == F.col("src"))
        p = p.join(hubs, F.col("idx") == F.col("hub"), "left").withColumn("s", F.explode(F.expr("sequence(0, coalesce(slices, 1) - 1)")))
        return p.repartition(parts, "idx", "s").hint("shuffle_hash").join(e, (F.col("idx") == F.col("src")) & (F.col("s") == F.col("slice")))

    given = s.select("idx", (F.col("seed") * (1.0 - alpha)).alias("score"))
    p = rewritten(s.select("idx", F.col("seed").alias("score")))
    done = 0
    try:
        while done < iterations:
            before = p
            for _ in range(min(every, iterations - done)):
                spread = met(p).select(F.col("dst").alias("idx"), (alpha * F.col("score") * F.col("weight")).alias("score"))
                sums = spread.groupBy("idx").agg(F.sum("score").alias("score"))
                p = sums.unionByName(given).repartition(parts, "idx").groupBy("idx").agg(F.sum("score").alias("score"))
                done += 1
            p = rewritten(p)
            moved = p.join(before.withColumnRenamed("score", "_b"), "idx", "full_outer").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))))).first()[0] or 0.0
            discard(before)
            if moved < tolerance:
                break
    finally:
        discard(e)
    return p


def top(scores: DataFrame, k: int, exclude: DataFrame | None = None) -> DataFrame:
    if exclude is not None:
        scores = scores.join(exclude.select("idx"), "idx", "left_anti")
    return scores.orderBy(F.round("score", 12).desc(), "idx").limit(k)


def combine_channels(structural: DataFrame | None, temporal: DataFrame | None, temporal_weight: float = 0.3) -> DataFrame:
    """(1 - w) x structural + w x temporal, each divided by its largest; a sole channel passes through."""
    if structural is None and temporal is None:
        raise ValueError("no channel to combine")
    if structural is None or temporal is None:
        return temporal if structural is None else structural
    w = min(1.0, max(0.0, temporal_weight))

    def scaled(d: DataFrame, name: str) -> DataFrame:
        peak = d.agg(F.max("score").alias("_p"))
        return d.crossJoin(F.broadcast(peak)).select("idx", F.when(F.col("_p") > 0, F.col("score") / F.col("_p")).otherwise(F.col("score")).alias(name))

    j = scaled(structural, "_s").join(scaled(temporal, "_t"), "idx", "full_outer")
    return j.select("idx", ((1.0 - w) * F.coalesce("_s", F.lit(0.0)) + w * F.coalesce("_t", F.lit(0.0))).alias("score"))


def undirected(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def tasks(spark: SparkSession, edges: int) -> int:
    """Partitions for so many edges: as many as shuffles have, or more, so that none holds more than TASK_EDGES on average."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-edges // TASK_EDGES))


def bfs(edges: DataFrame, start: DataFrame, depth: int | None = None, until: int | None = None) -> DataFrame:
    """(idx, dist, parent) of nodes reached from start (idx) over edges, which may repeat; parents are the smallest on a shortest path."""
    return _searched(rewritten(edges.select("src", "dst")), start, depth, until)


def _searched(e: DataFrame, start: DataFrame, depth: int | None = None, until: int | None = None) -> DataFrame:
    """bfs over stored edges. Each level is stored by itself: where it has few nodes they are sent to the edges, which are scanned, else edges are shuffled."""
    front = rewritten(start.select(F.col("idx").cast("long").alias("idx"), F.lit(0).alias("dist"), F.lit(None).cast("long").alias("parent")).distinct())
    seen, level, size = front, 0, front.count()
    while depth is None or level < depth:
        at = front.select(F.col("idx").alias("src"))
        new = e.join(F.broadcast(at) if size <= FEW else at.hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("idx")).agg(F.min("src").alias("parent"))
        front = rewritten(new.join(seen.select("idx"), "idx", "left_anti").select("idx", F.lit(level + 1).alias("dist"), "parent"))
        size = front.count()
        if not size:
            break
        seen, level = seen.unionByName(front), level + 1
        if level % LEVELS == 0:
            seen = rewritten(seen)
        if until is not None and front.where(F.col("idx") == until).limit(1).count():
            break
    return seen


def path_nodes(edges: DataFrame, a: int, b: int) -> DataFrame:
    """(step, idx) of a shortest path over edges in either direction, step 0 at a; no rows if there is none.

    The search keeps the smallest parent of each node; the chain is followed back level by level, as joins.
    """
    spark = edges.sparkSession
    seen = bfs(undirected(edges), spark.createDataFrame([(a,)], "idx long"), until=b)
    at = truncate(seen.where(F.col("idx") == b).select(F.col("dist").alias("step"), "idx", "parent"))
    length = at.select("step").first()
    if length is None:
        return spark.createDataFrame([], "step int, idx long")
    out, parents = at, seen.select(F.col("dist").alias("step"), F.col("idx"), "parent")
    for _ in range(length[0]):
        at = parents.join(F.broadcast(at.select(F.col("parent").alias("idx"))), "idx").select("step", "idx", "parent")
        out = out.unionByName(at)
    return out.select("step", "idx")


def shortest_path(edges: DataFrame, a: int, b: int) -> list[int]:
    """The nodes of a shortest path; empty if there is none."""
    return [r["idx"] for r in path_nodes(edges, a, b).orderBy("step").collect()]


def reachable(pairs: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(node) reached from start (node) over pairs (a, b) in either direction, start left out."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = truncate(both)
    seen, level = truncate(start.select("node").distinct().withColumn("d", F.lit(0))), 0
    while depth is None or level < depth:
        front = seen.where(F.col("d") == level)
        new = front.join(both, front["node"] == both["a"]).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("d", F.lit(level + 1))
        grown = truncate(seen.unionByName(new))
        if not grown.where(F.col("d") == level + 1).limit(1).count():
            break
        seen, level = grown, level + 1
    return seen.where("d > 0").select("node")


#: A node with one of so many edges, or more, is a hub: what it holds is broadcast (so many hubs at most).
HUBS = 1000


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of the nodes of pairs (a, b), in either direction; root is the smallest node that is reachable.

    Alternating large and small stars: each node hands its larger neighbours, then its smaller ones, to the smallest of all. Minima are
    aggregated; those of hubs are broadcast to the edges, those of other nodes joined.
    """
    now = rewritten(pairs.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = rewritten(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).where("node is not null").distinct())

    def least(edges: DataFrame) -> DataFrame:
        """edges (a, b) with m, the least of a and its neighbours b."""
        near = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        near = rewritten(near.crossJoin(F.broadcast(near.agg(F.sum("n").alias("all")))).select("a", "m", (F.col("n") * HUBS >= F.col("all")).alias("hub")))
        hubs = F.broadcast(near.where("hub").select("a", "m"))
        return edges.join(hubs, "a").unionByName(edges.join(F.broadcast(near.where("hub").select("a")), "a", "left_anti").join(near.where("not hub").select("a", "m"), "a"))

    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = least(rewritten(large))
        new = rewritten(down.select("a", F.col("m").alias("b")).unionByName(down.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        # settled: one edge for each node, to one that has none itself
        roots = new.select(F.col("b").alias("a")).distinct().join(new, "a", "left_semi").limit(1).count()
        now = new.select("a", "b")
        if not roots and not now.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            break
    return nodes.join(now.toDF("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def beside(pairs: DataFrame, start: DataFrame) -> DataFrame:
    """(node) one step from start (node) over pairs (a, b) in either direction, start left out."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(start.select(F.col("node").alias("a")).distinct(), "a", "left_semi").select(F.col("b").alias("node")).distinct().join(start, "node", "left_anti")


def closure(groups: DataFrame, start: DataFrame) -> DataFrame:
    """(node) reached from start (node) over pairs whose components are groups (node, root), start left out: those of the same components."""
    met = groups.join(start.select("node").distinct(), "node", "left_semi").select("root").distinct()
    return groups.join(met, "root", "left_semi").select("node").join(start, "node", "left_anti")


def trimmed(edges: DataFrame) -> DataFrame:
    """Stored edges (src, dst) without those of nodes that have no predecessor or no successor among the rest.

    Edges are counted by node once. Each round takes from the counts what the nodes that went last stood for, so edges are scanned, and stored again at the end.
    """
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ins"))
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outs"))
    left = rewritten(ins.join(outs, "node", "full_outer").select("node", F.coalesce("ins", F.lit(0)).alias("ins"), F.coalesce("outs", F.lit(0)).alias("outs")))
    whole = True
    while True:
        gone = rewritten(left.where("ins = 0 or outs = 0").select("node"))
        if not gone.limit(1).count():
            break
        whole = False
        less = edges.join(gone.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))
        less = less.unionByName(edges.join(gone.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
        less = less.groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
        left = left.where("ins > 0 and outs > 0").join(less, "node", "left")
        left = rewritten(left.select("node", (F.col("ins") - F.coalesce("i", F.lit(0))).alias("ins"), (F.col("outs") - F.coalesce("o", F.lit(0))).alias("outs")))
    if whole:
        return edges
    return rewritten(edges.join(left.select(F.col("node").alias("src")), "src", "left_semi").join(left.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) for nodes on directed cycles; the component is its smallest node.

    Nodes without predecessors or successors among the rest are trimmed; then each node takes the smallest node that
    reaches it as colour, and those that reach their colour's node inside the colour form its component; repeat.
    Edges are dealt out by the end that they are met at, and each step follows only nodes that the last one changed.
    """
    spark = edges.sparkSession
    node_type = dict(edges.dtypes)["src"]
    rest = rewritten(edges.select("src", "dst").where("src <> dst").distinct())
    found: DataFrame | None = None
    while True:
        rest = trimmed(rest)
        if not (m := rest.count()):
            break
        parts = tasks(spark, m)
        out = rest.repartition(parts, "src").sortWithinPartitions("src").persist()
        color = front = rewritten(out.select(F.col("src").alias("node")).distinct().withColumn("color", F.col("node")))
        while True:
            near = out.join(front.select(F.col("node").alias("src"), "color"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("c"))
            new = rewritten(color.join(near, "node", "left").select("node", F.least("color", "c").alias("color"), (F.col("c") < F.col("color")).alias("moved")))
            front = new.where("moved").select("node", "color")
            if not front.limit(1).count():
                break
            color = new.select("node", "color")
        s, d = color.toDF("src", "cs"), color.toDF("dst", "cd")
        inside = out.join(s, "src").join(d, "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("color")).repartition(parts, "dst").sortWithinPartitions("dst").persist()
        back = front = rewritten(color.where("node = color"))
        level = 0
        while True:
            new = inside.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "color").distinct()
            front = rewritten(new.join(back.select("node"), "node", "left_anti"))
            if not front.limit(1).count():
                break
            back, level = back.unionByName(front), level + 1
            if level % LEVELS == 0:
                back = rewritten(back)
        inside.unpersist()
        out.unpersist()
        back = rewritten(back)
        found = back if found is None else found.unionByName(back)
        rest = rewritten(rest.join(back.select(F.col("node").alias("src")), "src", "left_anti").join(back.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return spark.createDataFrame([], f"node {node_type}, component {node_type}")
    sizes = found.groupBy("color").count().where("count > 1")
    return found.join(sizes, "color").select("node", F.col("color").alias("component"))


def file_cycles(edges: DataFrame, nodes: DataFrame, min_size: int = 2, n: int | None = 10) -> DataFrame:
    """(component, size, files): clusters of files that depend on each other, largest first; all of them if n is None.

    Files are numbered by name, and edges hold numbers alone.
    """
    f = nodes.where("source_file is not null and source_file <> ''").select("idx", "source_file")
    names = rewritten(with_idx(f.select("source_file").distinct(), ["source_file"]).select(F.col("idx").alias("file"), "source_file"))
    f = rewritten(f.join(names, "source_file").select("idx", "file"))
    e = edges.select("src", "dst").join(f.toDF("src", "a"), "src").join(f.toDF("dst", "b"), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    scc = strong_components(e).join(names, F.col("node") == F.col("file"))
    out = scc.groupBy(F.col("component").alias("_c")).agg(F.min("source_file").alias("component"), F.count("*").alias("size"), F.array_sort(F.collect_list("source_file")).alias("files")).drop("_c")
    out = out.where(F.col("size") >= min_size)
    return out if n is None else out.orderBy(F.desc("size"), "component").limit(n)


def _by_file(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    f = nodes.where("source_file is not null and source_file <> ''").select("idx", "source_file")
    return edges.join(f.toDF("src", "a"), "src").join(f.toDF("dst", "b"), "dst")


def diff_impact(edges: DataFrame, nodes: DataFrame, changed: DataFrame, n: int | None = None) -> DataFrame:
    """(path, connections) of unchanged files by their edges to changed (path) ones, most first."""
    e = _by_file(edges, nodes).select("a", "b")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    c = changed.select("path").distinct()
    hit = both.join(c.withColumnRenamed("path", "a"), "a", "left_semi").join(c.withColumnRenamed("path", "b"), "b", "left_anti")
    out = hit.groupBy(F.col("b").alias("path")).agg(F.count("*").alias("connections"))
    return out if n is None else out.orderBy(F.desc("connections"), "path").limit(n)


def unindexed(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    return changed.select("path").distinct().join(nodes.select(F.col("source_file").alias("path")).distinct(), "path", "left_anti")


def tests_for(edges: DataFrame, nodes: DataFrame, target: str, n: int = 10) -> DataFrame:
    """(path, connections) of test files joined to the target's nodes."""
    e = _by_file(edges, nodes).select("a", "b")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hit = both.where((F.col("a") == target) & (F.col("b") != target) & is_test_file("b"))
    return hit.groupBy(F.col("b").alias("path")).agg(F.count("*").alias("connections")).orderBy(F.desc("connections"), "path").limit(n)


def find_node(nodes: DataFrame, text: str) -> DataFrame:
    """The node that a text names: an equal label or path, files first, else a label or path that holds the text."""
    t = text.lower()
    same = (F.col("label") == text) | (F.col("source_file") == text)
    has = F.lower("label").contains(t) | F.lower("source_file").contains(t)
    tier = F.when(same, 0).when(has, 1)
    return nodes.withColumn("_tier", tier).where("_tier is not null").orderBy("_tier", F.desc(F.col("kind") == "file"), "idx").limit(1).drop("_tier")


def explain_neighbours(edges: DataFrame, nodes: DataFrame, idx: int, n: int = 15) -> DataFrame:
    out = edges.where(F.col("src") == idx).select("dst", "relation").join(nodes.select(F.col("idx").alias("dst"), "label", "kind", "source_file"), "dst")
    return out.select("dst", "relation", "label", "kind", "source_file").orderBy("dst", "relation").limit(n)


def neighbour_cap(edges: DataFrame, nodes: DataFrame, cap: int = 12) -> DataFrame:
    """(idx, neighbours): the labels of a node's first `cap` neighbours, edges in either direction in the order of `ord`.

    Each map task keeps a node's first `cap` edges before any are shuffled (the window's limit is pushed down), so a hub brings `cap` rows of a task.
    """
    e = edges.select("ord", "src", "dst")
    both = e.select("ord", F.col("src").alias("idx"), F.col("dst").alias("other"), F.lit(0).alias("side")).unionByName(e.select("ord", F.col("dst").alias("idx"), F.col("src").alias("other"), F.lit(1).alias("side")))
    w = Window.partitionBy("idx").orderBy("ord", "side", "other")
    kept = both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap)
    named = kept.join(nodes.select(F.col("idx").alias("other"), "label"), "other")
    return named.groupBy("idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]).alias("neighbours"))


def file_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, n) undirected edge counts between files."""
    e = _by_file(edges, nodes).where("a <> b")
    return e.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))


def degree(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("src").alias("idx")).unionByName(edges.select(F.col("dst").alias("idx")))
    return both.groupBy("idx").agg(F.count("*").alias("degree"))


def louvain(edges: list[tuple[str, str]], seed: int = 42) -> dict[str, int]:
    """Communities of a small undirected graph (files of one repository) by local moves and merges, in sorted order; on the driver."""
    names = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(names)}
    graph: list[dict[int, float]] = [{} for _ in names]
    for a, b in sorted({(min(e), max(e)) for e in edges if e[0] != e[1]}):
        graph[at[a]][at[b]] = graph[at[b]][at[a]] = 1.0
    loops, group = [0.0] * len(names), list(range(len(names)))
    total = sum(sum(g.values()) for g in graph)
    while total:
        own = list(range(len(graph)))
        k = [sum(g.values()) + loops[i] for i, g in enumerate(graph)]
        weight, moved_ever = list(k), False
        for _ in range(50):
            moved = False
            for i, g in enumerate(graph):
                weight[own[i]] -= k[i]
                links: dict[int, float] = {own[i]: 0.0}
                for j, w in g.items():
                    links[own[j]] = links.get(own[j], 0.0) + w
                best = max(sorted(links), key=lambda c: (links[c] - weight[c] * k[i] / total, c == own[i], -c))
                if best != own[i]:
                    own[i], moved, moved_ever = best, True, True
                weight[own[i]] += k[i]
            if not moved:
                break
        if not moved_ever:
            break
        new = {c: i for i, c in enumerate(dict.fromkeys(own))}
        merged: list[dict[int, float]] = [{} for _ in new]
        inner = [0.0] * len(new)
        for i, g in enumerate(graph):
            inner[new[own[i]]] += loops[i]
            for j, w in g.items():
                a, b = new[own[i]], new[own[j]]
                if a == b:
                    inner[a] += w
                else:
                    merged[a][b] = merged[a].get(b, 0.0) + w
        group, graph, loops = [new[own[g]] for g in group], merged, inner
    return dict(zip(names, group))
