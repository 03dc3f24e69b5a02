"""MinHash near-dedup with tensored banding.

A text is the set of its distinct word shingles. Two collections of `groups` bands, each of `width` minhashes, are
drawn; table (i, j) is keyed by band i of the left collection and band j of the right one, so groups^2 tables cost
2 x groups x width minhashes. A pair of similarity s meets in a table with probability (1 - (1 - s^width)^groups)^2;
`groups` is the smallest number for which that is `found` at the threshold.

Texts of equal sets form one class, so exact copies cost one row. Members of a table key are first compared with the
key's smallest member only, and links joined to components. The members of all keys with the same smallest member
form a neighbourhood; where one still holds several components, its members outside the largest of them are compared
with all others of another component, in blocks of `block` rows, as products of incidence matrices, without a row for each
pair. So connectivity is that of all pairs that share a key, while a neighbourhood of n linked members costs n - 1
comparisons. All links are confirmed on whole shingle sets.

Defined cases: null texts and texts without words have no shingles, are linked with nothing, and are their own component.
Rows are told apart by a key of their own, not by their id: an id that occurs with several texts links each of them, rows that repeat
an id and text get the same result each, and rows without an id link others; a component whose rows all lack ids has the component id null.
Whole texts count, however long. A class is named by a 64-bit hash of its set. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import across, confirm, connected_components, keyed, mix, shingle_set, signed, stored

WIDTH, FOUND, BLOCK = 3, 0.9985, 512
#: Table keys that a task makes, about.
KEYS = 1_000_000
SIGNATURE = "n_shingles long, cls long, lefts array<long>, rights array<long>"


def groups_for(threshold: float, width: int = WIDTH, found: float = FOUND) -> int:
    q = 1
    while (1 - (1 - threshold**width) ** q) ** 2 < found:
        q += 1
    return q


def seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def bands(shingles: np.ndarray, groups: int, width: int) -> np.ndarray:
    """2 x groups band keys of a set: left ones, then right ones."""
    a = seeds(2 * groups * width) | np.uint64(1)
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 2048):  # long texts in pieces
        least = np.minimum(least, mix_rows(shingles[lo : lo + 2048], a))
    key = np.arange(2 * groups, dtype=np.uint64)
    for c in least.reshape(2 * groups, width).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + c)
    return key


def mix_rows(s: np.ndarray, a: np.ndarray) -> np.ndarray:
    # multiply-shift: the high bits of an odd multiple of an already mixed value
    x = s[None, :] * a[:, None]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x.min(axis=1)


def signatures(docs: DataFrame, size: int, groups: int, width: int, text_col: str = "text") -> DataFrame:
    """docs (without the text) with n_shingles, cls (hash of the set; null without shingles), lefts and rights."""
    keep = [f for f in docs.schema.fields if f.name != text_col]

    def run(batches):
        for batch in batches:
            n, cls, keys, at = [], [], [], [0]
            for text in batch.column(text_col).to_pylist():
                s = shingle_set(text, size)
                n.append(len(s))
                cls.append(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))) if len(s) else None)
                if len(s):
                    keys.append(bands(s, groups, width))
                at.append(len(keys))
            every = signed(np.concatenate(keys).reshape(len(keys), 2, groups)) if keys else np.zeros((0, 2, groups), np.int64)
            lists = []
            for side in (0, 1):
                offsets = np.array(at, np.int32) * groups
                lists.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(every[:, side, :]).ravel())))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(n, pa.int64()), pa.array([None if c is None else int(c) for c in cls], pa.int64()), *lists], [*(f.name for f in keep), "n_shingles", "cls", "lefts", "rights"])

    return docs.mapInArrow(run, StructType([*keep, *StructType.fromDDL(SIGNATURE).fields]))


def similar(percent: int):
    """A test of pairs of whole sets: 100 x intersection >= percent x union."""

    def test(left: list[bytes], right: list[bytes]) -> list[bool]:
        out, last, s = [], None, None
        for x, y in zip(left, right):
            if x is not last:
                last, s = x, np.frombuffer(x, "<u8")
            t = np.frombuffer(y, "<u8")
            both = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
            out.append(100 * both >= percent * (len(s) + len(t) - both))
        return out

    return test


def all_similar(percent: int):
    """The same test for all pairs of a list of sets, as a matrix."""

    def linked(data: list[bytes]) -> np.ndarray:
        sets = [np.frombuffer(x, "<u8") for x in data]
        n = np.array([len(x) for x in sets], np.int64)
        both = intersections(sets)
        return 100 * both >= percent * (n[:, None] + n[None, :] - both)

    return linked


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """(cls, set) of (cls, text)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([shingle_set(t, size).astype("<u8").tobytes() for t in batch.column("text").to_pylist()], pa.binary())], ["cls", "set"])

    return rows.mapInArrow(run, "cls long, set binary")


def intersections(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """The sizes of the intersections of all pairs, as products of 0/1 matrices over the shingles that two sets share."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    u, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    new = np.cumsum(n > 1) - 1
    keep = n[at] > 1
    row, col = row[keep], new[at[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for lo in range(0, int(new[-1]) + 1 if len(new) else 0, width):
        i, j = np.searchsorted(col, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[i:j], col[i:j] - lo] = 1
        out += (m @ m.T).astype(np.int64)  # at most width, so exact
    return out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, found: float = FOUND, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: its id, n_shingles, component_id (the smallest id reachable) and kept."""
    groups = groups_for(percent / 100, width, found)
    # row: rows that repeat an id, or have none, are told apart
    texts = keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "row")
    signed_rows = stored(signatures(texts, size, groups, width), "signatures")
    classes = signed_rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("rep"), F.min("row").alias("row"), F.min_by(F.struct("n_shingles", "lefts", "rights"), "row").alias("s"))
    classes = stored(classes.select("cls", "rep", "row", F.col("s.n_shingles").alias("n"), "s.lefts", "s.rights"), "classes")

    tables = F.flatten(F.transform("lefts", lambda x: F.transform("rights", lambda y: F.xxhash64(x, y))))
    # a row makes groups^2 of them: dealt out so that a task's sums, most of which stay alone, are few
    tasks = max(1, classes.count() * groups * groups // KEYS)
    rows = classes.repartition(tasks, "cls").select("cls", "n", F.explode(tables).alias("key"))
    # stored, so that the join with it can be split where a key is hot
    shared = stored(rows.groupBy("key").agg(F.min("cls").alias("first"), F.count("*").alias("m")).where("m > 1").drop("m"), "shared")
    members = stored(rows.join(shared, "key").select("first", "cls", "n").distinct(), "members")

    fits = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    sizes = members.select("cls", "n").distinct()
    star = members.where("first <> cls").select(F.col("first").alias("a"), F.col("cls").alias("b"), F.col("n").alias("nb"))
    star = star.join(sizes.toDF("a", "na"), "a").where(fits(F.col("na"), F.col("nb"))).select("a", "b")
    star = stored(star, "star")  # so that the join with the sets, which may have a hot side, can be split

    # whole sets of the classes that share a key with another
    wanted = members.select("cls").distinct().join(classes.select("cls", "row"), "cls")
    sets = shingle_sets(texts.select("row", "text").join(wanted, "row").select("cls", "text"), size)
    sets = stored(sets, "sets")

    links = stored(confirm(star, sets, similar(percent)), "links")
    roots = stored(connected_components(links), "roots")
    near = members.join(roots, F.col("cls") == F.col("node"), "left").select("first", "cls", F.coalesce("root", "cls").alias("root"), (F.col("n") * 8).alias("n"))
    near = stored(near, "near")
    several = stored(near.groupBy("first").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("first"), "several")
    mixed = stored(near.join(several, "first", "left_semi"), "mixed")
    links = stored(links.unionByName(across(mixed, sets, all_similar(percent), block)).distinct(), "links")
    roots = stored(connected_components(links), "roots")

    label = classes.select("cls", "rep").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    least = label.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = label.join(least, "root").select(F.col("cls").alias("_cls"), "component_id")
    out = signed_rows.select("id", "n_shingles", "cls").join(label, F.col("cls") == F.col("_cls"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
