"""Embedding near-dedup with cross-polytope hashing.

A vector of unit length, padded with zeros to a power of two, is turned by three rounds of random signs and fast
Hadamard transforms; its hash is the axis it is nearest to, with the sign. A table's key joins `k` such hashes. Each
vector lies in its own bucket and in the `probes` buckets that are next nearest. k grows with the logarithm of the
number of distinct vectors, so that a bucket holds a bounded number of unrelated ones at any size, and the number of tables
is the smallest for which simulated pairs at the threshold meet with probability `found`; both are chosen for each length of vectors.

Equal vectors form one class. What is dealt to buckets is a class's number and a sketch, the signs of 128 random projections, never
the vector. A bucket is read as a run of sorted rows: a run of at most `small` rows gives the pairs whose sketches differ in few enough
bits (all but one in 100,000 pairs at the threshold do), a longer one those of its first member only, and its membership. Candidate pairs
are verified with the vectors, in double precision, and joined to components. The members of long runs with the same first member form a
neighbourhood; where one still holds several components, its members are compared in blocks, without a row for each pair.

The numbers of links are then counted over the pairs of each component, in blocks: every pair of a component that is at the threshold
counts, whether a bucket held it or not. Blocks are planned on numbers, and vectors are joined to them last.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors
of different lengths do not link. Rows that repeat an id are rows of their own; a row without an id is a component of its own or part of
one that others name. Extra columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import ROOM, across, confirm, connected_components, mix, stored
from .vectors import matrices, units

PROBES, FOUND, BLOCK, SMALL, CROWD, BITS = 2, 0.998, 1024, 64, 16, 128

WORDS = [f"s{i}" for i in range(BITS // 64)]


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the last axis, of a power of two."""
    shape, d, h = x.shape, x.shape[-1], 1
    while h < d:
        y = x.reshape(*shape[:-1], d // (2 * h), 2, h)
        x = np.concatenate([y[..., :1, :] + y[..., 1:, :], y[..., :1, :] - y[..., 1:, :]], axis=-2).reshape(shape)
        h *= 2
    return x


def rotated(x: np.ndarray, number: int) -> np.ndarray:
    """x (rows of unit length) after the numbered pseudo-random rotation."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([20240229, d, number])
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], d)) / math.sqrt(d)
    return y


def codes(x: np.ndarray, table: int, k: int, probes: int) -> np.ndarray:
    """Bucket keys (rows x (1 + probes)): the own bucket, then the next nearest ones."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    wide = min(3, d)
    axes, losses = [], []
    for j in range(k):
        y = rotated(x, table * 8 + j)
        top = np.argpartition(-np.abs(y), wide - 1, axis=1)[:, :wide]
        size = np.take_along_axis(np.abs(y), top, 1)
        order = np.argsort(-size, axis=1, kind="stable")
        top, size = np.take_along_axis(top, order, 1), np.take_along_axis(size, order, 1)
        axes.append(top * 2 + (np.take_along_axis(y, top, 1) < 0))
        losses.append((size[:, :1] - size) ** 2)
    ways = np.array(list(itertools.product(range(wide), repeat=k)))
    loss = sum(losses[j][:, ways[:, j]] for j in range(k))
    n = min(1 + probes, len(ways))
    best = np.argsort(loss, axis=1, kind="stable")[:, :n]
    key = np.full(best.shape, np.uint64(table + 1) * np.uint64(1_000_003) + np.uint64(x.shape[1]))
    for j in range(k):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.take_along_axis(axes[j], ways[:, j][best], 1).astype(np.uint64))
    return key.view(np.int64)


def hashes_for(n: int, d: int) -> int:
    """Hashes of a key: as many as leave CROWD of n vectors, if they were spread evenly, to a bucket."""
    axes = 2 << max(1, (d - 1).bit_length())
    return min(8, max(1, math.ceil(math.log(max(n, 1) / CROWD) / math.log(axes))))


@functools.lru_cache
def tables_for(d: int, k: int, probes: int, cosine: float, found: float, trials: int = 2000) -> int:
    """The number of tables by simulation of pairs at the threshold."""
    rng = np.random.default_rng(5)
    x = units(rng.standard_normal((trials, d)))
    z = rng.standard_normal((trials, d))
    if d == 1:
        return 1
    z = units(z - (z * x).sum(axis=1, keepdims=True) * x)
    y = cosine * x + math.sqrt(1 - cosine * cosine) * z
    hit = []
    for t in range(2):
        a, b = codes(x, t, k, probes), codes(y, t, k, probes)
        hit.append((a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean())
    p = min(0.999, max(0.01, float(np.mean(hit))))
    return max(2, math.ceil(math.log(1 - found) / math.log(1 - p)))


@functools.lru_cache
def projections(d: int) -> np.ndarray:
    return np.random.default_rng([20240301, d]).standard_normal((d, BITS))


def sketches(x: np.ndarray) -> np.ndarray:
    """BITS bits of each row, in words of 64: the signs of random projections."""
    return np.packbits(x @ projections(x.shape[1]) > 0, axis=1).view("<u8")


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of bits in which sketches differ."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def bits_apart(cosine: float, miss: float = 1e-5) -> int:
    """The number of bits in which sketches of a pair at the threshold differ at most, but for a share of `miss`."""
    p, tail = math.acos(min(1.0, max(-1.0, cosine))) / math.pi, 1.0
    for t in range(BITS):
        tail -= math.comb(BITS, t) * p**t * (1 - p) ** (BITS - t)
        if tail <= miss:
            return t
    return BITS


class Runs:
    """Candidates from rows (key, cls, sketch) that come sorted by key and cls, a batch at a time.

    Rows of a run are held until it ends or is longer than `small`; of a longer one, its first member only.
    """

    def __init__(self, most: int, small: int = SMALL):
        self.most, self.small = most, small
        self.rows = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, BITS // 64), np.uint64)]
        self.long: tuple | None = None  # the key, first member and its sketch of a long run that may go on

    def put(self, key: np.ndarray, cls: np.ndarray, sketch: np.ndarray, last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, long): candidate pairs, and (first, member) rows of long runs."""
        key, cls, sketch = (np.concatenate([x, y]) for x, y in zip(self.rows, (key, cls, sketch)))
        out: list[tuple] = []
        if self.long is not None:
            n = int(np.searchsorted(key != self.long[0], True))
            out += self.follow(cls[:n], sketch[:n])
            key, cls, sketch = key[n:], cls[n:], sketch[n:]
            if len(key):
                self.long = None
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(new, len(key)))
        for i, n in zip(new[size > self.small].tolist(), size[size > self.small].tolist()):
            self.long = (key[i], cls[i], sketch[i])
            out.append((cls[i : i + 1], cls[i : i + 1], True))
            out += self.follow(cls[i + 1 : i + n], sketch[i + 1 : i + n])
            if i + n < len(key):
                self.long = None
        # the last run may go on
        ends = len(key) if last or self.long is not None or not len(new) else int(new[-1])
        self.rows = [x[ends:] for x in (key, cls, sketch)]
        left = np.repeat(np.where(size <= self.small, size, 0), size) - (np.arange(len(key)) - np.repeat(new, size))  # rows of the run from here on
        left[ends:] = 0
        at, step = np.flatnonzero(left > 1), 1
        while len(at):
            to = at + step
            near = (apart(sketch[at], sketch[to]) <= self.most) & (cls[at] != cls[to])
            out.append((cls[at[near]], cls[to[near]], False))
            step += 1
            at = at[left[at] > step]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]), np.repeat([o[2] for o in out], [len(o[0]) for o in out])

    def follow(self, cls: np.ndarray, sketch: np.ndarray) -> list[tuple]:
        _, first, own = self.long
        near = (apart(sketch, own) <= self.most) & (cls != first)
        return [(np.full(len(cls), first), cls, True), (np.full(near.sum(), first), cls[near], False)]


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", probes: int = PROBES, found: float = FOUND, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """One row per row of vectors: its id, n_links, component_id (the smallest id reachable) and kept."""
    kind = "<f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "<f8"

    def classed(batch):
        """(length, row numbers, matrix, class numbers) for each length of usable vectors."""
        for at, x in matrices(batch.column(1)):
            cls = np.array([xxhash.xxh3_64_intdigest(v.tobytes()) for v in x.astype(kind)], np.uint64).view(np.int64)
            yield x.shape[1], at, x, cls

    def names(batches):
        for batch in batches:
            cls, d = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32)
            for size, at, _, c in classed(batch):
                cls[at], d[at] = c, size
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, mask=d == 0), pa.array(d)], ["id", "cls", "d"])

    def payloads(batches):
        for batch in batches:
            for _, _, x, cls in classed(batch):
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())], ["cls", "data"])

    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    rows = stored(source.mapInArrow(names, "id long, cls long, d int"), "names")
    classes = rows.where("cls is not null").groupBy("cls", "d").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = stored(classes, "classes")
    plan = {}
    for d, n in classes.groupBy("d").count().collect():  # one row for each length
        k = hashes_for(n, d)
        plan[d] = (k, tables_for(d, k, probes, cosine, found))
    most = bits_apart(cosine)

    def buckets(batches):
        seen: set[int] = set()
        for batch in batches:
            for d, _, x, cls in classed(batch):
                # copies within a task are dealt out once
                new = np.array([i for i, c in enumerate(cls.tolist()) if not (c in seen or seen.add(c))], np.int64)
                if len(seen) > 1_000_000:
                    seen.clear()
                if not len(new):
                    continue
                x, cls = units(x[new]), cls[new]
                sketch, (k, tables) = sketches(x), plan[d]
                for t in range(tables):
                    c = codes(x, t, k, probes)
                    n = c.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(c.ravel()), pa.array(np.repeat(cls, n)), *(pa.array(np.repeat(w, n).view(np.int64)) for w in sketch.T)], ["key", "cls", *WORDS])

    def candidates(batches):
        runs = Runs(most, small)
        for batch in itertools.chain(batches, [None]):
            key, cls, *sketch = [c.to_numpy() for c in batch.columns] if batch is not None else [np.zeros(0, np.int64)] * (2 + len(WORDS))
            a, b, long = runs.put(key, cls, np.stack(sketch, axis=1).view(np.uint64), batch is None)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(long)], ["a", "b", "long"])

    def units_of(data: list[bytes]) -> np.ndarray:
        return units(np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64))

    def near(left: list[bytes], right: list[bytes]) -> list[bool]:
        out = np.zeros(len(left), bool)
        sizes = np.array([len(x) if len(x) == len(y) else 0 for x, y in zip(left, right)])
        for d in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == d)
            out[at] = (units_of([left[i] for i in at]) * units_of([right[i] for i in at])).sum(axis=1) >= cosine
        return out.tolist()

    def all_near(data: list[bytes]) -> np.ndarray:
        sizes, out = np.array([len(x) for x in data]), np.zeros((len(data), len(data)), bool)
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            x = units_of([data[i] for i in at])
            out[np.ix_(at, at)] = x @ x.T >= cosine
        return out

    dealt = source.mapInArrow(buckets, ", ".join(f"{c} long" for c in ("key", "cls", *WORDS))).repartition("key").sortWithinPartitions("key", "cls")
    found_ = stored(dealt.mapInArrow(candidates, "a long, b long, long boolean").distinct(), "candidates")
    wanted = found_.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    payload = source.mapInArrow(payloads, "cls long, data binary").join(wanted, "cls", "left_semi")
    payload = stored(payload.groupBy("cls").agg(F.first("data").alias("data")), "payload")
    pairs = found_.where("not long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stored(confirm(pairs, payload, near), "links")
    roots = stored(connected_components(links), "roots")
    hoods = found_.where("long").select(F.col("a").alias("first"), F.col("b").alias("cls"))
    hoods = hoods.join(roots, F.col("cls") == F.col("node"), "left").select("first", "cls", F.coalesce("root", "cls").alias("root"), F.lit(int(kind[2]) * max(plan, default=1)).cast("long").alias("n"))
    hoods = stored(hoods, "hoods")
    mixed = stored(hoods.groupBy("first").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("first"), "mixed")
    more = across(hoods.join(mixed, "first", "left_semi"), payload, all_near, block)
    roots = stored(connected_components(links.unionByName(more)), "roots")

    def counts(t: pa.Table) -> pa.Table:
        keys = [t[c].to_numpy() for c in ("hi", "lo", "root")]
        order = np.lexsort(keys)
        t, keys = t.take(pa.array(order)), [k[order] for k in keys]
        new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
        cls, copies, block_, lo, hi = (t[c].to_numpy() for c in ("cls", "copies", "block", "lo", "hi"))
        total = np.zeros(t.num_rows, np.int64)
        for a, b in zip(new.tolist(), [*new[1:].tolist(), t.num_rows]):
            x = units_of(t["data"].slice(a, b - a).to_pylist())
            if lo[a] < hi[a]:
                side = block_[a:b] == lo[a]
                i, j = np.flatnonzero(side), np.flatnonzero(~side)
                near = (x[i] @ x[j].T) >= cosine
                total[a + i] = near @ copies[a + j]
                total[a + j] = near.T @ copies[a + i]
            else:
                near = (x @ x.T) >= cosine
                np.fill_diagonal(near, False)
                total[a:b] = near @ copies[a:b]
        return pa.table({"cls": pa.array(cls, pa.int64()), "n": pa.array(total, pa.int64())})

    members = classes.join(roots, F.col("cls") == F.col("node")).select("root", "cls", "copies", "d")
    plan_ = stored(members.groupBy("root").agg(F.count("*").alias("m"), F.max("d").alias("d")), "components")
    parts = F.ceil(F.greatest(F.col("m") / block, F.col("m") * F.col("d") * int(kind[2]) / ROOM)).cast("int")
    plan_ = plan_.select("root", "m", parts.alias("nb"), (F.col("m") * F.col("d") * int(kind[2])).alias("bytes"))
    several = max(1, -(-(plan_.where("nb = 1").agg(F.sum("bytes")).first()[0] or 0) // ROOM))
    dealt = members.join(plan_, "root").withColumn("block", F.expr("cast(pmod(xxhash64(cls, 77), nb) as int)")).withColumn("o", F.explode(F.expr("sequence(0, nb - 1)")))
    dealt = dealt.withColumn("lo", F.least("block", "o")).withColumn("hi", F.greatest("block", "o"))
    unit = F.when(F.col("nb") == 1, F.pmod(F.xxhash64("root"), F.lit(several))).otherwise(F.xxhash64("root", "lo", "hi").bitwiseOR(F.lit(1 << 62)))
    dealt = dealt.select(unit.alias("unit"), "root", "lo", "hi", "block", "cls", "copies").join(payload, "cls")
    linked = dealt.groupBy("unit").applyInArrow(counts, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n"))
    label = classes.select("cls", "rep", "copies").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "rep", "copies", F.coalesce("root", "cls").alias("root"))
    least = label.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = label.join(least, "root").join(linked, "cls", "left")
    label = label.select(F.col("cls").alias("_cls"), "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = rows.select("id", "cls").join(label, F.col("cls") == F.col("_cls"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
