"""Communities of a weighted graph by moves that raise modularity, and by labels; the graph stays distributed.

A round moves only nodes of one colour, a hash of the node that changes with each sweep, so most of a moving node's neighbours stand still while it decides. A node joins the
neighbouring community with the largest gain, counted from its links to it and the community's degree without the node; of two
communities of one node each only the later one joins the earlier one, so they don't swap. When a sweep over all colours moves hardly anything, communities become
the nodes of a smaller graph, whose edges are sums, and all is repeated until nothing moves.

Of edges to a node with a thousandth of all edges or more the node's state is broadcast (a thousand nodes at most), so hubs fill no task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gneiss.plans.checkpoint import rewritten

#: A node with one of so many edges, or more, is a hub.
HUBS = 1000


def mirrored(edges: DataFrame) -> DataFrame:
    """(src, dst, w): edges in both directions without loops, parallel ones summed; weight 1 where there is none."""
    w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("w")).where("src <> dst and src is not null and dst is not null")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


class Facing:
    """Mirrored edges, and what their far ends hold."""

    def __init__(self, edges: DataFrame):
        total = edges.count()
        far = edges.groupBy(F.col("dst").alias("hub")).agg(F.count("*").alias("n")).where(F.col("n") * HUBS >= total)
        far = rewritten(far)
        met = far.agg(F.sum("n")).first()[0] or 0
        self.edges, self.hubs = edges, F.broadcast(far.select(F.col("hub").alias("dst")))
        self.any, self.all = met > 0, met == total

    def ends(self, state: DataFrame, colour=None) -> DataFrame:
        """(src, w, c) of the edges, c from state (idx, c) of their far ends; those of sources that meet the condition."""
        e = self.edges if colour is None else self.edges.where(colour)
        s = state.select(F.col("idx").alias("dst"), "c")
        parts = []
        if self.any:
            parts.append(e.join(F.broadcast(s.join(self.hubs, "dst", "left_semi")), "dst"))
        if not self.all:
            parts.append((e.join(self.hubs, "dst", "left_anti") if self.any else e).join(s, "dst"))
        out = [p.select("src", "w", "c") for p in parts] or [e.select("src", "w", F.col("dst").alias("c"))]
        return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _colour(node: str, colours: int, which: int, salt: int = 0):
    return F.pmod(F.xxhash64(F.lit(salt), node), F.lit(colours)) == which


def modularity(edges: DataFrame, groups: DataFrame, resolution: float = 1.0) -> float:
    """The modularity of groups (idx, community) over edges (src, dst[, weight]); 0 without edges."""
    e = rewritten(mirrored(edges))
    of = groups.select(F.col("idx").alias("dst"), F.col("community").alias("b"))
    both = e.join(of, "dst").join(of.toDF("src", "a"), "src")
    by = both.groupBy("a").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("i"))
    total, inner, square = by.agg(F.sum("k"), F.sum("i"), F.sum(F.col("k") * F.col("k"))).first()
    return inner / total - resolution * square / total**2 if total else 0.0


def _moved(facing: Facing, state: DataFrame, total: float, colour, resolution: float) -> DataFrame:
    """(idx, to) of the nodes of a colour that another community suits better. state: (idx, k, c)."""
    sizes = state.groupBy("c").agg(F.sum("k").alias("tot"), F.count("*").alias("n"))
    own = state.where(colour("idx"))
    links = facing.ends(state, colour("src")).toDF("idx", "w", "c").unionByName(own.select("idx", F.lit(0.0).alias("w"), "c")).groupBy("idx", "c").agg(F.sum("w").alias("l"))
    met = links.join(own.select("idx", "k", F.col("c").alias("own")), "idx").join(sizes, "c")
    home = F.col("c") == F.col("own")
    gain = F.col("l") - resolution * F.col("k") * (F.col("tot") - F.when(home, F.col("k")).otherwise(0.0)) / total
    # twelve places: the order of sums must not decide
    met = met.select("idx", "c", "own", home.alias("home"), F.round(gain, 12).alias("gain"), F.when(home, F.col("n")).alias("n_home"), "n")
    best = met.groupBy("idx").agg(F.max(F.struct("gain", "home", (-F.col("c")).alias("c"), "n")).alias("b"), F.max("n_home").alias("n_home"), F.first("own").alias("own"))
    return best.where(~F.col("b.home") & ((F.col("n_home") > 1) | (F.col("b.n") > 1) | (-F.col("b.c") < F.col("own")))).select("idx", (-F.col("b.c")).alias("to"))


def communities(edges: DataFrame, colours: int = 2, sweeps: int = 12, settled: float = 0.02, resolution: float = 1.0) -> DataFrame:
    """(idx, community) for the ends of edges (src, dst[, weight]), longs; a community is called by its smallest node.

    A level ends when each colour has moved less than the share `settled` of the nodes, or after `sweeps`; all ends when a level moves nothing.
    """
    e = rewritten(mirrored(edges))
    whole = rewritten(e.select(F.col("src").alias("idx")).distinct().withColumn("community", F.col("idx")))
    loops: DataFrame | None = None
    total = e.agg(F.sum("w")).first()[0]
    while total:
        degree = e.groupBy(F.col("src").alias("idx")).agg(F.sum("w").alias("k"))
        if loops is not None:
            degree = degree.unionByName(loops).groupBy("idx").agg(F.sum("k").alias("k"))
        state, facing, ever, still, which = rewritten(degree.withColumn("c", F.col("idx"))), Facing(e), False, 0, 0
        few = settled * state.count()
        while still < colours and which < colours * sweeps:
            colour = lambda node, s=which // colours, w=which % colours: _colour(node, colours, w, s)
            to = _moved(facing, state, total, colour, resolution)
            new = rewritten(state.join(to, "idx", "left").select("idx", "k", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved")))
            moved = new.where("moved").count()
            state, still, ever, which = new.drop("moved"), 0 if moved and moved >= few else still + 1, ever or bool(moved), which + 1
        if not ever:
            break
        named = state.groupBy("c").agg(F.min("idx").alias("to"))
        group = rewritten(state.join(named, "c").select("idx", "to"))
        whole = rewritten(whole.join(group, whole["community"] == group["idx"]).select(whole["idx"], F.col("to").alias("community")))
        both = Facing(e).ends(group.select("idx", F.col("to").alias("c"))).join(group.toDF("src", "a"), "src")
        sums = rewritten(both.groupBy("a", "c").agg(F.sum("w").alias("w")))
        inside = sums.where("a = c").select(F.col("a").alias("idx"), F.col("w").alias("k"))
        if loops is not None:
            inside = inside.unionByName(loops.join(group, "idx").select(F.col("to").alias("idx"), "k"))
        loops = rewritten(inside.groupBy("idx").agg(F.sum("k").alias("k")))
        e = rewritten(sums.where("a <> c").select(F.col("a").alias("src"), F.col("c").alias("dst"), "w"))
    return whole


def label_communities(edges: DataFrame, rounds: int = 20, colours: int = 2) -> DataFrame:
    """(idx, community) by label propagation: the label with most weight among neighbours, its own if that is among these, else the smallest;
    nodes of one colour at a time, so that two sides of a star don't swap labels for ever."""
    e = rewritten(mirrored(edges))
    facing = Facing(e)
    state, still = rewritten(e.select(F.col("src").alias("idx")).distinct().withColumn("c", F.col("idx"))), 0
    for which in range(rounds * colours):
        votes = facing.ends(state, _colour("src", colours, which % colours, which // colours)).groupBy(F.col("src").alias("idx"), "c").agg(F.round(F.sum("w"), 12).alias("n"))
        best = votes.join(state.select("idx", F.col("c").alias("own")), "idx").groupBy("idx").agg(F.max(F.struct("n", F.col("c") == F.col("own"), (-F.col("c")).alias("c"))).alias("v"))
        best = best.select("idx", (-F.col("v.c")).alias("to"))
        new = rewritten(state.join(best, "idx", "left").select("idx", F.coalesce("to", "c").alias("c"), (F.col("to") != F.col("c")).alias("moved")))
        still = 0 if new.where("moved").limit(1).count() else still + 1
        state = new.select("idx", "c")
        if still == colours:
            break
    named = state.groupBy("c").agg(F.min("idx").alias("community"))
    return state.join(named, "c").select("idx", "community")
