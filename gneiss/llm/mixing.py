"""Temperature mixing of sources to target weights.

Weights are source token shares raised to an exponent t in [0, 1] and normalised: t = 1 keeps the natural mix, t = 0
is uniform. Two limits are met by bisection: the entropy of the weights must reach `target` x log(sources), which
lowers t, and no source may be repeated more than `repetition` times, which raises it; where both can't hold, the
repetition limit does. A round of the search sums the weights for several exponents at once over the table of sources, so any number of
sources will do. Weights become whole rows by budgeted block permutations: the budget is the number of tokens
at which the source repeated least is read once, so every row is placed at least once; a source with quota q x its
tokens is read in ceil(q) passes, each in a hashed order of its own, and the last pass stops where the quota is met.
Blocks hold the same share of each source's quota; within a block rows lie in hashed order.

Equal rows (id, source and tokens) are counted first and placed as one interval of a pass, so neither they nor a hot source fill one task:
running sums go over hash buckets.

Defined cases: tokens of a row are its words (runs without white space), one at least; null and empty texts have one, very long ones all
of theirs. A null source is a source of its own. Rows that repeat an id are placed each; those without one like others. Extra columns are
ignored by mix() and kept by mixed_documents(), whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .common import keyed, numbered, running, stored, unrolled

#: Exponents tried in a round of the search, and rounds: the exponent is found to within WIDTH ** -ROUNDS.
WIDTH, ROUNDS = 64, 7
#: The entropy aimed at: all of log(sources), so sources come out even as far as the repetition limit lets them.
TARGET = 1.0


def tokens_of(text: str):
    t = F.coalesce(F.col(text), F.lit(""))
    return F.greatest(F.lit(1), F.regexp_count(t, F.lit("[^\\s]+"))).cast("long")


def narrowed(holds: Callable[[list[float]], list[bool]], rounds: int = ROUNDS, width: int = WIDTH) -> float:
    """The largest number in [0, 1] for which holds; it does for 0 and for all numbers below one that it holds for."""
    lo, hi = 0.0, 1.0
    for _ in range(rounds):
        tried = [lo + (hi - lo) * i / width for i in range(1, width)]
        good = [t for t, ok in zip(tried, holds(tried)) if ok]
        lo = good[-1] if good else lo
        hi = next((t for t in tried if t > lo), hi)
    return (lo + hi) / 2


def exponent(entropies: Callable[[list[float]], list[float]], sources: int, least: int, most: int, target: float, repetition: float) -> float:
    """The largest t whose entropy is target x log(sources) at least, but no smaller than the repetition limit needs.

    least, most: the tokens of the smallest and the largest source. At t the smallest is read (most / least) ** (1 - t) times.
    """
    goal = target * math.log(sources) if sources > 1 else 0.0
    by_entropy = 1.0 if entropies([1.0])[0] >= goal else narrowed(lambda ts: [h >= goal for h in entropies(ts)])
    ratio = math.log(most / least)
    by_limit = 0.0 if ratio <= math.log(repetition) else 1.0 - narrowed(lambda us: [u * ratio <= math.log(repetition) for u in us])
    return max(by_entropy, by_limit)


def plan(sizes: DataFrame, target: float, repetition: float) -> tuple[DataFrame, float]:
    """The table with weight and quota, from (source, source_tokens, ...), and the exponent."""
    sources, least, most = sizes.agg(F.count("*"), F.min("source_tokens"), F.max("source_tokens")).first()
    if not sources:
        return sizes.select("*", F.lit(0.0).alias("weight"), F.lit(0.0).alias("quota")), 1.0
    share = F.log(F.col("source_tokens") / F.lit(float(most)))

    def sums(ts: list[float]) -> list[tuple[float, float]]:
        """For each t, the sum of all powers and that of power x logarithm."""
        row = sizes.agg(*(f for t in ts for f in (F.sum(F.exp(t * share)), F.sum(F.exp(t * share) * share)))).first()
        return list(zip(row[::2], row[1::2]))

    t = exponent(lambda ts: [math.log(z) - t * a / z for t, (z, a) in zip(ts, sums(ts))], sources, least, most, target, repetition)
    total = sums([t])[0][0]
    quota = F.least(F.exp((t - 1.0) * share), F.lit(float(repetition)))
    return sizes.select("*", (F.exp(t * share) / F.lit(total)).alias("weight"), quota.alias("quota")), t


def mix(docs: DataFrame, target: float = TARGET, repetition: float = 1.5, blocks: int = 64, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, tokens, pass int, block int, place long, weight, quota, exponent), one row for each time that a row is placed.

    A row is placed in its source's pass p while the tokens before it in that pass are below the quota's rest;
    (block, place) is the order of the mix.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), tokens_of(text_col).alias("tokens"))
    # narrow rows: read by the sums below and again to be placed
    rows = stored(rows.groupBy("id", "source", "tokens").agg(F.count("*").alias("copies")), "counted")
    sizes = rows.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("source_tokens"), F.count("*").alias("group_rows"))
    planned, t = plan(stored(sizes, "sources"), target, repetition)
    most = rows.agg(F.max("copies")).first()[0] or 0
    planned = planned.withColumnRenamed("source", "_source")
    each = rows.join(planned, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    each = each.withColumn("pass", F.explode(F.sequence(F.lit(0), (F.ceil("quota") - 1).cast("int"))))
    each = each.withColumn("place", F.xxhash64(F.lit(seed), "pass", "id", "tokens")).withColumn("size", F.col("tokens") * F.col("copies"))
    each = each.withColumn("_key", F.xxhash64(F.col("source").isNull(), "source", "pass"))
    each = running(each, ["_key"], ["id", "tokens"], "size")
    held = F.col("source_tokens") * F.least(F.lit(1.0), F.col("quota") - F.col("pass"))
    # the copies whose tokens before them are below what is held
    placed = F.least(F.col("copies"), F.ceil((held - F.col("before")) / F.col("tokens")).cast("long")) - 1
    each = each.where(F.col("before") < held).withColumn("zero", F.lit(0).cast("long")).withColumn("upto", placed)
    each = unrolled(each, "zero", "upto", "copy", most)
    before = F.col("before") + F.col("copy") * F.col("tokens")
    share = (F.col("pass") * F.col("source_tokens") + before) / (F.col("quota") * F.col("source_tokens"))
    block = F.least(F.floor(share * blocks), F.lit(blocks - 1)).cast("int")
    return each.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "tokens", "pass", block.alias("block"),
        F.xxhash64(F.lit(seed + 1), "pass", "id", "tokens", "copy").alias("place"), "weight", "quota", F.lit(float(t)).alias("exponent"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs with each row as often as the mix places it, in its own columns. Of rows of one id, source and number of tokens, which are alike to the mix,
    those that are placed once more than the others come first by a hash of the row's place."""
    d, name = numbered(docs)
    d = keyed(d, "row")
    own = [name[c] for c in (id_col, source_col)]
    placed = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how).select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), "tokens", "pass")
    # pass 0 places each row once
    more = placed.groupBy("id", "source", "tokens").agg(F.count("*").alias("placed"), F.count_if(F.col("pass") == 0).alias("group_rows")).where("placed > group_rows")
    more = stored(more.withColumn("group", F.monotonically_increasing_id()), "more")
    rows = d.select("row", F.col(own[0]).alias("_id"), F.col(own[1]).cast("string").alias("_source"), tokens_of(name[text_col]).alias("_tokens"))
    same = F.col("_id").eqNullSafe(F.col("id")) & F.col("_source").eqNullSafe(F.col("source")) & (F.col("_tokens") == F.col("tokens"))
    rows = stored(rows.join(more, same).select("row", "group", "placed", "group_rows"), "repeated")
    each, left = F.expr("placed div group_rows"), F.expr("placed % group_rows")
    alike = rows.where(left > 0).select("*", F.xxhash64(F.lit("copy"), "row").alias("place"), F.lit(1).alias("one"), F.col("group_rows").alias("n"))
    ranked = running(alike, ["group"], ["row"], "one").select("row", F.expr("placed div n + if(before < placed % n, 1, 0)").alias("times"))
    times = rows.where(left == 0).select("row", each.alias("times")).unionByName(ranked).where("times > 1")
    out = d.join(stored(times, "times").hint("shuffle_hash"), "row", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("times").cast("int"), F.lit(1)))))
    return out.select([name[c] for c in docs.columns]).toDF(*docs.columns)
