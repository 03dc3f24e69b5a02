"""Queries behind the map of a code graph, and its payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gneiss.operators.graph import degree
from gneiss.operators.ingest import with_idx
from gneiss.plans.checkpoint import rewritten, truncate

# Fixed values of the map.
HOPS, TEMPORAL_DECAY, POSTINGS, SEARCH_TOP = (0.55, 0.3, 0.16), 0.8, 400, 30
MAX_NODES, KEY_FILES, MAX_PER_FILE, MAX_EDGES, TOP_GROUPS = 250_000, 12, 8, 12_000, 36


def blast(edges: DataFrame, root: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """(idx, weight) within three hops of root (idx): each hop has its weight, less over temporal edges; the largest counts.

    edges: (src, dst, temporal boolean), taken in both directions.
    """
    e = edges.select("src", "dst", "temporal").where("src <> dst")
    e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "temporal"))
    e = e.groupBy("src", "dst").agg(F.max(F.when(F.col("temporal"), TEMPORAL_DECAY).otherwise(1.0)).alias("f"))
    if visible is not None:
        e = e.join(visible.select(F.col("idx").alias("dst")), "dst", "left_semi")
    seen = root.select(F.col("idx").cast("long").alias("idx"), F.lit(1.0).alias("weight"))
    front = seen
    for hop in HOPS:
        new = front.join(e, front["idx"] == e["src"]).groupBy(F.col("dst").alias("idx")).agg((F.max("f") * hop).alias("w"))
        both = seen.join(new, "idx", "full_outer")
        old, w = F.coalesce("weight", F.lit(0.0)), F.coalesce("w", F.lit(0.0))
        both = truncate(both.select("idx", F.greatest(old, w).alias("weight"), (w > old).alias("raised")))
        seen, front = both.select("idx", "weight"), both.where("raised").select("idx")
    return seen


def search_tokens(label: Column, path: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(label, F.lit("")), F.coalesce(path, F.lit(""))))
    return F.array_distinct(F.filter(F.split(text, "[^a-z0-9]+"), lambda t: F.length(t) >= 2))


def token_index(nodes: DataFrame) -> DataFrame:
    """(token, idx): the dictionary of search tokens; a token keeps its first POSTINGS nodes, of which each map task keeps as many at most."""
    t = nodes.select("idx", F.explode(search_tokens(F.col("label"), F.col("source_file"))).alias("token"))
    w = Window.partitionBy("token").orderBy("idx")
    return t.withColumn("r", F.row_number().over(w)).where(F.col("r") <= POSTINGS).select("token", "idx")


def save_tokens(epoch, index: DataFrame) -> None:
    """Write the dictionary in order of tokens, files by range: the blocks that hold a prefix lie together, and a scan reads only these."""
    epoch.write("tokens", index.repartitionByRange("token").sortWithinPartitions("token", "idx"))


def query_words(query: str) -> list[str]:
    import re

    return [t for t in re.split(r"[^a-z0-9]+", query.strip().lower()) if t] if len(query.strip()) >= 2 else []


def prefix_hits(index: DataFrame, query: str, k: int = SEARCH_TOP) -> DataFrame:
    """(idx, score) from a dictionary (token, idx): for each query word, 2 for an equal token, 1 / (1 + letters missing) for a token it begins; summed.

    The prefixes are filters of the scan, so blocks of a stored dictionary without them aren't read.
    """
    value, hit = F.lit(0.0), F.lit(False)
    for x in query_words(query):
        value = value + F.when(F.col("token") == x, 2.0).when(F.startswith(F.col("token"), F.lit(x)), 1.0 / (1 + F.length("token") - len(x))).otherwise(0.0)
        hit = hit | F.col("token").startswith(x)
    return index.where(hit).groupBy("idx").agg(F.sum(value).alias("score")).orderBy(F.desc("score"), "idx").limit(k)


def prefix_hits_all(index: DataFrame, queries: DataFrame, k: int = SEARCH_TOP) -> DataFrame:
    """(query_id, idx, score, rank) for queries (query_id, query), in one plan: words meet the tokens that share their first two letters (their
    first, if they have no more), then those that they begin."""
    q = queries.select("query_id", F.trim(F.lower(F.coalesce("query", F.lit("")))).alias("q")).where(F.length("q") >= 2)
    words = q.select("query_id", F.posexplode(F.filter(F.split("q", "[^a-z0-9]+"), lambda t: t != "")).alias("place", "word"))
    words = words.groupBy("query_id", "word").agg(F.count("*").alias("times")).withColumn("head", F.substring("word", 1, 2))
    heads = F.explode(F.array(F.substring("token", 1, 1), F.substring("token", 1, 2)))
    # only tokens that some query asks for are spelled out
    met = index.select("token").distinct().withColumn("head", heads).join(words, "head").where(F.startswith(F.col("token"), F.col("word")))
    value = F.when(F.col("token") == F.col("word"), 2.0).otherwise(1.0 / (1 + F.length("token") - F.length("word"))) * F.col("times")
    met = met.groupBy("query_id", "token").agg(F.sum(value).alias("value"))
    scored = index.join(met, "token").groupBy("query_id", "idx").agg(F.sum("value").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "idx")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def prefix_search(nodes: DataFrame, query: str, k: int = SEARCH_TOP) -> DataFrame:
    """prefix_hits without a stored dictionary: tokens that no query word begins are dropped in the scan."""
    return prefix_hits(token_index(nodes), query, k)


def neighbours_by_degree(edges: DataFrame, idx: int, n: int = 30) -> DataFrame:
    """(other, channel, degree): incident edges of a node, parallel ones repeated, by the neighbour's degree."""
    own = edges.where((F.col("src") == idx) | (F.col("dst") == idx))
    other = F.when(F.col("src") == idx, F.col("dst")).otherwise(F.col("src"))
    own = own.select(other.alias("other"), "channel")
    d = degree(edges).withColumnRenamed("idx", "other")
    return own.join(d, "other").orderBy(F.desc("degree"), "other", "channel").limit(n)


def history_cut(rows: DataFrame, fraction: float, column: str = "last_modified") -> DataFrame:
    """Rows without a time, or whose time is at most the fraction of the way from the first time to the last."""
    span = rows.where(F.col(column) > 0).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    j = rows.crossJoin(F.broadcast(span))
    age = F.coalesce(F.col(column), F.lit(0))
    return j.where((age == 0) | (age <= F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.lit(fraction))).drop("_lo", "_hi")


def scaled(rows: DataFrame) -> DataFrame:
    """(path, hot, age, bus): sqrt(hotspot / largest), age between the first and last time, and the bus factor's bucket 1, 2 or 0."""
    m = rows.agg(F.max("hotspot").alias("_h"), F.min("last_modified").alias("_lo"), F.max("last_modified").alias("_hi"))
    j = rows.crossJoin(F.broadcast(m))
    age = F.when(F.col("_hi") > F.col("_lo"), (F.col("last_modified") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    hot = F.when(F.col("_h") > 0, F.sqrt(F.col("hotspot") / F.col("_h"))).otherwise(0.0)
    return j.select("path", hot.alias("hot"), age.alias("age"), F.when(F.col("bus_factor").isin(1, 2), F.col("bus_factor")).otherwise(F.lit(0)).cast("int").alias("bus"))


def map_nodes(nodes: DataFrame, files: DataFrame, cap: int = MAX_NODES) -> DataFrame:
    """(idx, source_file, owner): the first `cap` nodes (idx has no gaps, so no sort is needed); owners are numbers from 0 in order of name, -1 without one."""
    authors = files.where("primary_owner is not null").select("primary_owner").distinct()
    codes = authors.withColumn("owner", F.row_number().over(Window.orderBy("primary_owner")) - 1)  # one row per author
    owned = files.select(F.col("path").alias("source_file"), "primary_owner").join(codes, "primary_owner").select("source_file", "owner")
    kept = nodes.where(F.col("idx") < cap).select("idx", "source_file")
    return kept.join(owned, "source_file", "left").select("idx", "source_file", F.coalesce("owner", F.lit(-1)).alias("owner"))


def majority(nodes: DataFrame, value: str = "community") -> DataFrame:
    """(path, value): the most frequent value of a file's nodes, ties to the smallest."""
    n = nodes.where(F.col(value).isNotNull() & F.col("source_file").isNotNull()).groupBy(F.col("source_file").alias("path"), value).agg(F.count("*").alias("n"))
    w = Window.partitionBy("path").orderBy(F.desc("n"), value)
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").select("path", value)


def regions(nodes: DataFrame, top: int = 7) -> DataFrame:
    """(path, community, region): the communities of most files by rank from 0; all others share region `top` or fewer."""
    m = majority(nodes)
    best = m.groupBy("community").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "community").limit(top)
    ranked = best.withColumn("region", F.row_number().over(Window.orderBy(F.desc("n"), "community")) - 1).select("community", "region")  # `top` rows
    n = best.agg(F.count("*").cast("int").alias("_n"))
    return m.join(F.broadcast(ranked), "community", "left").crossJoin(F.broadcast(n)).select("path", "community", F.coalesce("region", "_n").alias("region"))


def key_files(files: DataFrame, degrees: DataFrame, n: int = KEY_FILES) -> DataFrame:
    j = files.join(degrees, "path", "left")
    return j.select("path", "hotspot", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.desc("hotspot"), F.desc("degree"), "path").limit(n)


def capped_edges(pairs: DataFrame, per_file: int = MAX_PER_FILE, total: int = MAX_EDGES) -> DataFrame:
    """(a, b) of (a, b, n) by falling weight, left out only if both ends have `per_file` already; `total` at most.

    What a walk in that order would choose, in rounds: an edge that is among the first `per_file` at one of its ends, of those not
    yet left out, is chosen whatever becomes of the others; one that comes behind `per_file` chosen ones at both ends is left out. The first
    undecided edge of all is decided by either rule, so rounds end; each reads a few rows of a file, of which map tasks keep no more.
    """
    order = [F.desc("n"), "a", "b"]
    first = Window.partitionBy("end").orderBy(*order)
    place = lambda x, y, z: F.struct((-F.col(x)).alias("n"), F.col(y).alias("a"), F.col(z).alias("b"))
    ends = lambda e: e.withColumn("end", F.explode(F.array_distinct(F.array("a", "b")))).withColumn("r", F.row_number().over(first))
    left = rewritten(pairs.select("a", "b", "n", F.lit(False).alias("chosen")))
    while left.where("not chosen").limit(1).count():
        head = ends(left).where(F.col("r") <= per_file).select("a", "b").distinct().withColumn("head", F.lit(True))
        now = rewritten(left.join(head, ["a", "b"], "left").select("a", "b", "n", (F.col("chosen") | F.coalesce("head", F.lit(False))).alias("chosen")))
        full = ends(now.where("chosen")).where(F.col("r") == per_file).select("end", place("n", "a", "b").alias("bar"))
        both = now.join(full.toDF("a", "bar_a"), "a", "left").join(full.toDF("b", "bar_b"), "b", "left")
        own = place("n", "a", "b")
        left = rewritten(both.where(F.col("chosen") | ~F.coalesce((own > F.col("bar_a")) & (own > F.col("bar_b")), F.lit(False))).select("a", "b", "n", "chosen"))
    return left.orderBy(*order).limit(total).select("a", "b")


#: The angle between neighbours on the map's spirals, the map's radius and how much the largest hub is drawn to its group's centre.
GOLDEN, RADIUS, PULL = 2.399963229728653, 400.0, 0.55
# Colours of the map, from its centre to its rim.
INNER, OUTER = (255, 214, 170), (130, 170, 255)


def layout(nodes: DataFrame) -> DataFrame:
    """(idx, x, y, color) of (idx, group, degree): groups lie on a spiral, the largest at its centre, each on a disc whose area is its
    share; nodes lie on a spiral in the disc, hubs nearer to its centre. Colours, as 0xRRGGBB, go with the distance from the map's centre.
    """
    sizes = nodes.groupBy("group").agg(F.count("*").alias("n"))
    place = Window.orderBy(F.desc("n"), "group")  # one row for each group
    sizes = sizes.select("group", "n", (F.row_number().over(place) - 1).alias("k"), (F.sum("n").over(place) - F.col("n")).alias("inside"))
    all_ = nodes.agg(F.count("*").alias("total"), F.greatest(F.max("degree"), F.lit(1)).alias("most"))
    # numbered by group and idx, less the nodes of the groups before: a group is no window of one task
    before = sizes.select("group", (F.sum("n").over(Window.orderBy("group")) - F.col("n")).alias("before"))  # one row for each group
    numbered = with_idx(nodes.select("group", "degree", F.col("idx").alias("node")), ["group", "node"])
    j = numbered.join(F.broadcast(sizes.join(before, "group")), "group").crossJoin(F.broadcast(all_))
    j = j.select("*", (F.col("idx") - F.col("before")).alias("j")).drop("idx").withColumnRenamed("node", "idx")
    far = RADIUS * F.sqrt((F.col("inside") + F.col("n") / 2) / F.col("total")) * (F.col("k") > 0).cast("double")
    own = RADIUS * F.sqrt(F.col("n") / F.col("total")) / 2 * F.sqrt((F.col("j") + 0.5) / F.col("n")) * (1 - PULL * F.sqrt(F.col("degree") / F.col("most")))
    x = far * F.cos(F.col("k") * GOLDEN) + own * F.cos(F.col("j") * GOLDEN)
    y = far * F.sin(F.col("k") * GOLDEN) + own * F.sin(F.col("j") * GOLDEN)
    t = F.least(F.lit(1.0), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) / RADIUS)
    color = sum((F.floor(a + (b - a) * t + 0.5).cast("int") * (1 << shift) for a, b, shift in zip(INNER, OUTER, (16, 8, 0))), F.lit(0))
    return j.select("idx", x.alias("x"), y.alias("y")).withColumn("color", color)


def symbols(nodes: DataFrame, edges: DataFrame, cap: int | None = MAX_NODES) -> DataFrame:
    """(idx, label, kind, source_file, group, degree, x, y, color) of the first `cap` nodes; of all if it is None."""
    kept = (nodes if cap is None else nodes.where(F.col("idx") < cap)).withColumn("community", F.coalesce("community", F.lit(-1).cast("long")))
    groups = merge_communities(kept, edges)
    d = degree(edges)
    n = kept.join(groups, "community").join(d, "idx", "left").select("idx", "label", "kind", "source_file", "group", F.coalesce("degree", F.lit(0)).alias("degree"))
    return n.join(layout(n.select("idx", "group", "degree")), "idx")


def merge_communities(nodes: DataFrame, edges: DataFrame, top: int = TOP_GROUPS, passes: int = 4) -> DataFrame:
    """(community, group): the `top` largest communities stay; others join the group they share most edges with, in up to `passes` rounds; the rest get -1."""
    sizes = nodes.groupBy("community").agg(F.count("*").alias("n"))
    kept = sizes.orderBy(F.desc("n"), "community").limit(top).select("community", F.col("community").alias("group"))
    c = nodes.select("idx", "community")
    mass = edges.join(c.toDF("src", "a"), "src").join(c.toDF("dst", "b"), "dst").where("a <> b")
    mass = mass.select("a", "b").unionByName(mass.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.count("*").alias("w"))
    mass = truncate(mass)
    group = truncate(sizes.select("community").join(kept, "community", "left"))
    for _ in range(passes):
        known = group.where("`group` is not null")
        votes = mass.join(known.withColumnRenamed("community", "b"), "b").groupBy("a", "group").agg(F.sum("w").alias("w"))
        best = votes.groupBy("a").agg(F.max(F.struct("w", (-F.col("group")).alias("g"))).alias("v")).select(F.col("a").alias("community"), (-F.col("v.g")).alias("new"))
        new = truncate(group.join(best, "community", "left").select("community", F.coalesce("group", "new").alias("group")))
        more = new.where("`group` is not null").count() > known.count()
        group = new
        if not more:
            break
    return group.select("community", F.coalesce("group", F.lit(-1)).alias("group"))
