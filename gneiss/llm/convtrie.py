"""The prefix trie of conversations, as a Cartesian tree over the LCP array of sorted conversations.

1. Turns become hashes, ordered within their conversation by one range sort; counts and sums run on over the ends of partitions.
2. Equal conversations become one with a weight. They are sorted by their turns' hashes, as many as tell a conversation from all others,
   in steps of `step` turns; so a row holds no more turns than its conversation shares with another one, and a step.
3. lcp[i] is the number of turns that conversation i shares with the one before it. Blocks of `size` conversations find the nearest smaller
   values of their own, on a stack; a value whose nearest smaller one lies elsewhere looks for the next block with a smaller minimum, and there in the
   block's ladder of prefix or suffix minima. What goes to all tasks is one row per block.
4. Between its nearest smaller values each lcp spans a node of its depth; equal ones within the same span are one node. Each conversation that
   no other one continues is a leaf. Sums over a span are differences of running sums, least conversations are minima of parts of blocks.
5. A node stands for all depths below its parent's, too, where no conversation ends or branches off: these rows are added last.

The Unicode digest of a node's ends reads its conversations one after the other by its nature: it is streamed over pieces of 4,096 ids.

Defined cases: rows with a null conversation belong to none. Turns are ordered with null first, equal ones by a hash of role and text; rows
that repeat are turns like others. Null role and text are empty. A conversation may have no turn: it ends at the root. A conversation may hold
most rows. Empty tables have no nodes, no root either. Extra columns, whatever their names, are ignored. Turns are told apart by 128-bit
hashes, equal conversations by 64-bit ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import keyed, numbered, small_batches, stored

#: Characters of a turn's hash in a sort key.
WIDE = 32


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv, turn, key, chars, row): the hash of role and text, and the text's code points."""
    d, name = numbered(conversations)
    d = keyed(d, "row")
    role, text = (F.coalesce(F.col(name[c]), F.lit("")) for c in ("role", "text"))
    key = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = d.select(F.col(name["conv_id"]).cast("long").alias("conv"), F.col(name["turn"]).alias("turn"), key.alias("key"), F.char_length(text).cast("long").alias("chars"), "row")
    return rows.where(F.col("conv").isNotNull())


def placed(rows: DataFrame, group: str, order: list[str], sums: list[str], name: str) -> DataFrame:
    """rows with pos, their place in the group from 1, and for each column of sums its running sum modulo 2 ** 64.

    One range sort: a group may fill many partitions. Of each partition the last group's count and sums are added up on the driver.
    """
    names = ["pos", *(f"run_{c}" for c in sums)]
    d = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)

    def work(batches):
        part, last, held = TaskContext.get().partitionId(), None, np.zeros(len(names), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(group).to_numpy()
            values = np.stack([np.ones(len(g), np.uint64), *(batch.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in sums)], 1)
            total = np.cumsum(values, 0, dtype=np.uint64)
            new = np.append(g[0] != last, g[1:] != g[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(g)), -1))
            before = np.where((first > 0)[:, None], total[np.maximum(first, 1) - 1], np.uint64(0))
            run = total - before + np.where((first < 0)[:, None], held, np.uint64(0))
            last, held = g[-1], run[-1].copy()
            new = [pa.array(run[:, k].copy().view(np.int64)) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new, pa.array(np.full(len(g), part, np.int64))], [*batch.schema.names, *names, "part"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in d.schema), *(f"{c} long" for c in names), "part long"])
    out = stored(d.mapInArrow(work, schema), name)
    ends = out.groupBy("part").agg(F.min(group), F.max(F.struct(group, *names)).alias("e")).orderBy("part").collect()
    moved, last, held = [], None, [0] * len(names)
    for part, least, e in ends:
        if least == last:
            moved.append((part, least, *held))
        same = e[0] == last
        last, held = e[0], [_signed(x + (y if same else 0)) for x, y in zip(e[1:], held)]
    spark = rows.sparkSession
    moved = spark.createDataFrame(moved, ", ".join(["part long", f"{group} long", *(f"d{k} long" for k in range(len(names)))]))
    out = out.join(F.broadcast(moved), ["part", group], "left")
    half = 1 << 63
    wrapped = lambda c, k: F.expr(f"cast(pmod(cast({c} as decimal(38)) + d{k} + {half}, {2 * half}) - {half} as long)")
    plus = lambda c, k: F.when(F.col(f"d{k}").isNull(), F.col(c)).otherwise(wrapped(c, k))
    return out.select(*rows.columns, *(plus(c, k).alias(c) for k, c in enumerate(names)))


def _signed(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], share: int = 1000) -> DataFrame:
    """left joined with right, whose keys are unique: keys with a thousandth of left's rows or more, a thousand at most, by broadcast, the rest by hash."""
    total = left.count()
    hot = stored(left.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") * share >= total).drop("_n"), "hot")
    few = right.join(F.broadcast(hot), on, "left_semi")
    rest = left.join(F.broadcast(hot), on, "left_anti").join(right, on)
    return left.join(F.broadcast(few), on).unionByName(rest)


class Minima:
    """Minima of stretches of an array, and the nearest value below a bound."""

    def __init__(self, values):
        self.levels = [np.asarray(values, np.int64)]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            last, width = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-width], last[width:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima of [lo, hi), which aren't empty."""
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.zeros(len(lo), np.int64)
        for level in np.unique(k):
            at = k == level
            table = self.levels[level]
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << level)])
        return out

    def after(self, i: int, bound: int) -> int:
        """The first place from i on with a value below bound; the length if there is none."""
        for k in reversed(range(len(self.levels))):
            if i < len(self.levels[k]) and self.levels[k][i] >= bound:
                i += 1 << k
        return i

    def before(self, i: int, bound: int) -> int:
        """The last place before i with a value below bound, or -1."""
        for k in reversed(range(len(self.levels))):
            if i - (1 << k) >= 0 and self.levels[k][i - (1 << k)] >= bound:
                i -= 1 << k
        return i - 1


def spans(lcp: list[int]) -> tuple[list[int], list[int], list[int]]:
    """For each place the nearest smaller values to the left (or -1) and the right (or the length), and the first equal value of the same span."""
    n = len(lcp)
    left, right, lead, stack = [-1] * n, [n] * n, list(range(n)), []
    for i, x in enumerate(lcp):
        while stack and lcp[stack[-1]] > x:
            right[lead[stack.pop()]] = i
        if stack and lcp[stack[-1]] == x:
            # the last of equal values is the nearest to what follows
            lead[i], left[i], stack[-1] = lead[stack[-1]], left[stack[-1]], i
        else:
            left[i] = stack[-1] if stack else -1
            stack.append(i)
    return left, [right[j] for j in lead], lead


# The left and the right side of a span. Left: the first conversation, the sums before it, the characters of the turns that it shares with the one
# before it, its lcp, its length, whether the span that its lcp belongs to begins in this block (1) or before it (0), and its block.
LEFT = ["rep", "lw", "ll", "la", "lc", "llow", "llen", "lside", "lblock"]
# Right: the sums before the first conversation beyond it, that one's lcp and its block.
RIGHT = ["rw", "rl", "ra", "rlow", "rblock"]
FOUND = ["kind", "block", "side", "v", *LEFT, *RIGHT, "least", "kids", "pconv", "pblock", "pside"]
#: Kinds of rows of a block: whole nodes, parts of nodes that cross its ends, its suffix minima and its prefix minima.
NODE, CROSSING, SUFFIX, PREFIX = range(4)


def block_rows(t: pa.Table, blocks: dict) -> pa.Table:
    """Rows FOUND of a block's conversations."""
    t = t.sort_by("rank")
    col = {c: t[c].to_numpy() for c in t.column_names}
    b, m = int(col["block"][0]), t.num_rows
    lcp, length, conv = col["lcp"], col["len"], col["conv"]
    sums = [np.concatenate([[0], np.cumsum(col[c])]) + blocks[c][b] for c in ("w", "leaf", "a")]
    left, right, lead = (np.array(x, np.int64) for x in spans(lcp.tolist()))
    kids = np.zeros(m, np.int64)
    np.add.at(kids, lead, (length > lcp).astype(np.int64))
    minima = Minima(conv)
    own = minima.of(np.maximum(left, 0), right)
    out = []

    def side(at: np.ndarray, low: np.ndarray, right: bool) -> dict[str, np.ndarray]:
        if right:
            return {**{n: s[at] for n, s in zip(RIGHT, sums)}, "rlow": low, "rblock": np.full(len(at), b)}
        return {"rep": conv[at], **{n: s[at] for n, s in zip(LEFT[1:], sums)}, "lc": col["clcp"][at], "llow": low, "llen": length[at], "lside": (left[at] >= 0).astype(np.int64), "lblock": np.full(len(at), b)}

    def parents(at: np.ndarray, none: np.ndarray) -> dict[str, np.ndarray]:
        """The parent, spanned by the value at a place; m is the next block's first one."""
        beyond = at == m
        g = lead[np.where(beyond, 0, at)]
        inside = (left[g] >= 0) & (right[g] < m) & ~beyond
        gone = none | inside
        return {"pconv": (own[g], ~(inside & ~none)), "pblock": (np.where(beyond, b + 1, b), gone), "pside": (np.where(beyond, 0, left[g] >= 0).astype(np.int64), gone)}

    def emit(kind: int, n: int, **cols) -> None:
        arrays = []
        for name in FOUND:
            x = kind if name == "kind" else b if name == "block" else cols.get(name)
            if x is None:
                arrays.append(pa.nulls(n, pa.int64()))
            elif isinstance(x, tuple):
                arrays.append(pa.array(x[0], pa.int64(), mask=x[1]))
            else:
                arrays.append(pa.array(np.broadcast_to(x, n).astype(np.int64)))
        out.append(pa.table(arrays, names=FOUND))

    # leaves
    i = np.flatnonzero(col["leaf"])
    up = np.maximum(lcp[i], col["next"][i])
    emit(NODE, len(i), v=length[i], **side(i, lcp[i], False), **side(i + 1, col["next"][i], True), least=conv[i], kids=0, **parents(np.where(lcp[i] >= col["next"][i], i, i + 1), up < 0))
    # spans within the block
    heads = np.flatnonzero((lead == np.arange(m)) & (lcp >= 0))
    whole = (left[heads] >= 0) & (right[heads] < m)
    i = heads[whole]
    x, y = left[i], right[i]
    emit(NODE, len(i), v=lcp[i], **side(x, lcp[x], False), **side(y, lcp[y], True), least=own[i], kids=kids[i], **parents(np.where(lcp[x] >= lcp[y], x, y), np.maximum(lcp[x], lcp[y]) < 0))
    # spans across its ends
    i = heads[~whole]
    v, least = lcp[i], own[i].copy()
    open_left, open_right = left[i] < 0, right[i] == m
    x, y = np.where(open_left, 0, left[i]), np.where(open_right, 0, right[i])
    sides = {n: (c, open_left) for n, c in side(x, lcp[x], False).items()} | {n: (c, open_right) for n, c in side(y, lcp[y], True).items()}
    lblock, rblock = np.full(len(i), b), np.full(len(i), b)
    ends = np.zeros(len(i), bool)  # spans up to the last conversation of all
    for k in range(len(i)):
        if open_left[k]:
            lblock[k] = blocks["low"].before(b, v[k])
            if lblock[k] + 1 < b:
                least[k] = min(least[k], blocks["conv"].of(np.array([lblock[k] + 1]), np.array([b]))[0])
        if open_right[k]:
            rblock[k] = blocks["low"].after(b + 1, v[k])
            ends[k] = rblock[k] == blocks["n"]
            if b + 1 < rblock[k]:
                least[k] = min(least[k], blocks["conv"].of(np.array([b + 1]), np.array([rblock[k]]))[0])
    for n, c in zip(("rw", "rl", "ra"), ("w", "leaf", "a")):
        sides[n] = (np.where(ends, blocks[c][-1], sides[n][0]), open_right & ~ends)
    sides["rlow"] = (np.where(ends, -1, sides["rlow"][0]), open_right & ~ends)
    emit(CROSSING, len(i), side=(~open_left).astype(np.int64), v=v, **(sides | {"lblock": lblock, "rblock": rblock}), least=least, kids=kids[i])
    # ladders: nothing before or after these places is as small
    i = np.flatnonzero(left < 0)
    i = i[lead[i] == i]
    emit(PREFIX, len(i), v=lcp[i], **side(i, lcp[i], True), least=(minima.of(np.zeros(len(i), np.int64), np.maximum(i, 1)), i == 0))
    i = np.flatnonzero(right == m)
    last = np.append(lcp[i][1:] != lcp[i][:-1], True)
    i = i[last]
    emit(SUFFIX, len(i), v=lcp[i], **side(i, lcp[i], False), least=minima.of(i, np.full(len(i), m)))
    return pa.concat_tables(out)


def sorted_conversations(turns: DataFrame, convs: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """(part, at, conv, len, total, w, lcp, clcp, next, first_key, first_cums, last_key) in order of (part, at), and members (conv, rep).

    turns: (conv, pos, key, run_chars), convs: (conv). lcp is null in the first row of a part and next, the following lcp, in the last; both have keys.
    """
    mark = F.bit_xor(F.xxhash64("pos", "key")).alias("mark")
    total = turns.groupBy("conv").agg(F.max("pos").alias("len"), F.max("run_chars").alias("total"), mark)
    same = ["len", "total", "mark"]
    total = stored(convs.join(total, "conv", "left").select("conv", *(F.coalesce(c, F.lit(0)).alias(c) for c in same)), "lengths")
    reps = stored(total.groupBy(*same).agg(F.min("conv").alias("rep"), F.count("*").alias("w")), "distinct")
    members = spread_join(total, reps.drop("w"), same).select("conv", "rep")
    reps = reps.withColumnRenamed("rep", "conv")
    # whole steps of turns that conversations begin with, and the longest of these that one shares with another
    steps = turns.groupBy("conv", F.floor((F.col("pos") - 1) / step).alias("step")).agg(F.count("*").alias("n"), mark).where(F.col("n") == step).drop("n")
    steps = placed(spread_join(steps, reps.select("conv"), ["conv"]), "conv", ["step"], ["mark"], "steps")
    shared = steps.groupBy("pos", "run_mark").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    shared = spread_join(steps, shared, ["pos", "run_mark"]).groupBy("conv").agg(F.max("pos").alias("shared"))
    upto = reps.join(shared, "conv", "left").select("conv", ((F.coalesce("shared", F.lit(0)) + 1) * step).alias("upto"))
    heads = spread_join(turns.select("conv", "pos", "key", "run_chars"), upto, ["conv"]).where("pos <= upto")
    keys = heads.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "run_chars"))).alias("t"))
    keys = keys.select("conv", F.array_join("t.key", "").alias("key"), F.col("t.run_chars").alias("cums"))
    rows = reps.drop("mark").join(keys, "conv", "left").withColumn("key", F.coalesce("key", F.lit("")))
    d = rows.select("conv", "len", "total", "w", "key", "cums").repartitionByRange("key").sortWithinPartitions("key")

    def work(batches):
        part, at, before = TaskContext.get().partitionId(), 0, None
        held: list[list] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                conv, length, total, w, key, cums = row
                lcp = clcp = None
                if before is not None:
                    lcp = common(before, key)
                    clcp = cums[lcp - 1] if lcp else 0
                    held[-1][7] = lcp
                held.append([at, conv, length, total, w, lcp, clcp, None, None if at else key, None if at else cums, None])
                at, before = at + 1, key
            if len(held) > 1:
                yield emitted(part, held[:-1])
                del held[:-1]
        if held:
            held[-1][10] = before
            yield emitted(part, held)

    kinds = [pa.int64()] * 8 + [pa.string(), pa.list_(pa.int64()), pa.string()]
    names = ["at", "conv", "len", "total", "w", "lcp", "clcp", "next", "first_key", "first_cums", "last_key"]

    def emitted(part, rows):
        return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["part", *names])

    schema = ", ".join(["part long", *(f"{n} {'array<long>' if n == 'first_cums' else 'string' if n.endswith('key') else 'long'}" for n in names)])
    return stored(d.mapInArrow(work, schema), "sorted"), members


def common(a: str, b: str) -> int:
    """Turns that two keys share."""
    n = min(len(a), len(b)) // WIDE
    for i in range(n):
        if a[i * WIDE : (i + 1) * WIDE] != b[i * WIDE : (i + 1) * WIDE]:
            return i
    return n


def ends_digests(members: DataFrame, piece: int = 4096) -> DataFrame:
    """(rep, ends): SHA-256 of the comma-joined members of each group of equal conversations, in numerical order."""
    at = placed(members, "rep", ["conv"], [], "members")
    pieces = at.groupBy("rep", F.floor((F.col("pos") - 1) / piece).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    d = pieces.repartition("rep").sortWithinPartitions("rep", "piece")

    def work(batches):
        now, digest = None, None
        for batch in batches:
            reps, ends = [], []
            for rep, ids in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist()):
                if rep != now:
                    if digest is not None:
                        reps.append(now)
                        ends.append(digest.hexdigest())
                    now, digest = rep, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(ends, pa.string())], ["rep", "ends"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], ["rep", "ends"])

    return d.select("rep", "ids").mapInArrow(work, "rep long, ends string")


def ladder(asked: DataFrame, steps: DataFrame, names: list[str]) -> DataFrame:
    """(at, v, found) for asked (at, v): of the steps (block, v, ...) of block `at` the one with the largest value below v, a struct of names."""
    steps = steps.select(F.col("block").alias("at"), "v", F.lit(1).alias("is_step"), F.struct(*names).alias("x"))
    both = steps.unionByName(asked.distinct().withColumn("is_step", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("at").orderBy("v", "is_step").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("found", F.last("x", ignorenulls=True).over(w)).where("is_step = 0").select("at", "v", "found")


def whole_nodes(found: DataFrame) -> DataFrame:
    """(rep, v, up, conv, n, leaves, saved, kids, llen, pconv), a row per span and leaf: its first conversation, its depth and its parent's."""
    cross = found.where(F.col("kind") == CROSSING)
    for names, kind, block in ((LEFT, SUFFIX, "lblock"), (RIGHT, PREFIX, "rblock")):
        known = names[0]  # null where the side lies in another block
        asked = cross.where(F.col(known).isNull()).select(F.col(block).alias("at"), "v")
        met = ladder(asked, found.where(F.col("kind") == kind), [*names, "least"]).withColumnRenamed("at", block)
        filled = cross.where(F.col(known).isNull()).join(met, [block, "v"])
        filled = filled.select(*(F.col(f"found.{c}").alias(c) if c in names else F.least("least", "found.least").alias(c) if c == "least" else c for c in FOUND))
        cross = stored(cross.where(F.col(known).isNotNull()).select(FOUND).unionByName(filled), "crossing")
    # equal values of one span in several blocks
    once = ["lw", "ll", "la", "lc", "llow", "llen", "lside", "lblock", *RIGHT]
    spans = stored(cross.groupBy("rep", "v").agg(F.min("least").alias("least"), F.sum("kids").alias("kids"), *(F.first(c).alias(c) for c in once)), "across")
    leans = F.col("llow") >= F.col("rlow")
    has = F.greatest("llow", "rlow") >= 0
    own = spans.withColumn("pblock", F.when(has, F.when(leans, F.col("lblock")).otherwise(F.col("rblock")))).withColumn("pside", F.when(has, F.when(leans, F.col("lside")).otherwise(0)))
    inner = found.where(F.col("kind") == NODE)
    names = ["rep", "v", "least", "kids", *once, "pblock", "pside"]
    nodes = inner.select(*names, "pconv").unionByName(own.select(*names, F.lit(None).cast("long").alias("pconv"))).withColumn("up", F.greatest("llow", "rlow"))
    parents = cross.select("block", "side", "v", "rep").join(spans.select("rep", "v", F.col("least").alias("met")), ["rep", "v"])
    parents = parents.select(F.col("block").alias("pblock"), F.col("side").alias("pside"), F.col("v").alias("up"), "met")
    crossed = nodes.where("pblock is not null").join(parents, ["pblock", "pside", "up"]).withColumn("pconv", F.col("met")).drop("met")
    return nodes.where("pblock is null").unionByName(crossed).select(
        "rep", "v", "up", F.col("least").alias("conv"), F.expr("rw - lw").alias("n"), F.expr("rl - ll").alias("leaves"), F.expr("ra - la - lc").alias("saved"),
        F.expr("kids + if(llen > v, 1, 0)").alias("kids"), "llen", "pconv",
    )


def prefix_trie(turns: DataFrame, convs: DataFrame, step: int = 64, size: int = 1 << 16) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row per node.

    turns: (conv, order, key, chars), order any numbers in order of a conversation's turns; convs: (conv), all conversations, those without turns too.
    """
    spark = turns.sparkSession
    small_batches(spark)
    turns = placed(turns.select("conv", "order", "key", "chars"), "conv", ["order"], ["chars"], "ordered")
    rows, members = sorted_conversations(turns, convs, step)
    # lcp of the first conversation of each part, and the parts' places
    parts = rows.groupBy("part").agg(F.max("at"), F.max("first_key"), F.max("first_cums"), F.max("last_key")).orderBy("part").collect()
    fixes, rank, block, before = [], 0, 0, None
    for part, last, key, cums, end in parts:
        lcp = -1 if before is None else common(before, key)
        fixes.append([part, lcp, cums[lcp - 1] if lcp > 0 else 0, rank, block, -1])
        if len(fixes) > 1:
            fixes[-2][5] = lcp
        rank, block, before = rank + last + 1, block + last // size + 1, end
    fixes = spark.createDataFrame(fixes, "part long, f_lcp long, f_clcp long, f_rank long, f_block long, f_next long")
    rows = rows.join(F.broadcast(fixes), "part").select(
        (F.col("f_rank") + F.col("at")).alias("rank"), (F.col("f_block") + F.floor(F.col("at") / size)).alias("block"), "conv", "len", "total", "w",
        F.coalesce("lcp", "f_lcp").alias("lcp"), F.coalesce("clcp", "f_clcp").alias("clcp"), F.coalesce("next", "f_next").alias("next"),
    )
    rows = rows.withColumn("a", F.col("clcp") + (F.col("w") - 1) * F.col("total")).withColumn("leaf", (F.col("next") < F.col("len")).cast("long")).drop("total")
    minima = rows.groupBy("block").agg(F.min("lcp"), F.min("conv"), F.sum("w"), F.sum("leaf"), F.sum("a")).orderBy("block").collect()
    sums = [np.concatenate([[0], np.cumsum([r[k] for r in minima], dtype=np.int64)]) for k in (3, 4, 5)]
    blocks = {"n": len(minima), "low": Minima([r[1] for r in minima]), "conv": Minima([r[2] for r in minima]), **dict(zip(("w", "leaf", "a"), sums))}
    shared = spark.sparkContext.broadcast(blocks)
    found = rows.groupBy("block").applyInArrow(lambda t: block_rows(t, shared.value), ", ".join(f"{c} long" for c in FOUND))
    nodes = whole_nodes(stored(found, "spans"))
    ended = F.col("llen") == F.col("v")
    nodes = stored(nodes.where(ended).join(ends_digests(members), "rep").unionByName(nodes.where(~ended), allowMissingColumns=True), "nodes")
    # a row for each depth below the parent's; those of long stretches are dealt out
    stretch = 1 << 12
    deep = nodes.withColumn("chunk", F.explode(F.sequence(F.col("up") + 1, F.col("v"), F.lit(stretch)))).repartition("chunk", "rep")
    deep = deep.withColumn("depth", F.explode(F.sequence("chunk", F.least(F.col("chunk") + (stretch - 1), F.col("v"))))).drop("chunk")
    chars = turns.select(F.col("conv").alias("rep"), (F.col("pos") + 1).alias("depth"), "run_chars")
    deep = deep.join(chars, ["rep", "depth"], "left")
    own, none = F.col("depth") == F.col("v"), F.sha2(F.lit("").cast("binary"), 256)
    return deep.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("up") + 1, F.col("conv")).when(F.col("depth") > 0, F.col("pconv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(own, F.col("kids")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * F.coalesce("run_chars", F.lit(0))).alias("saved_tokens"), F.when(own, F.coalesce("ends", none)).otherwise(none).alias("ends_sha256"),
    )
