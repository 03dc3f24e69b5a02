"""Language-model scores by stupid backoff over the corpus's own n-gram counts.

Words are runs without ASCII white space, A-Z in lower case. The score of a word w_i is c(w_{i-n+1..i}) / c(w_{i-n+1..i-1})
for the longest n up to `order` whose n-gram occurs `least` times or more in all documents, times `alpha` for each order
that was given up; words without such an n-gram get their share of all words. A document's score is the sum of the
logarithms.

The tables are relations of packed rows. Documents are dealt to blocks of about `block` bytes by a hash of the id.
exploded: (block, order, part, hashes, counts), a block's distinct n-grams, cut by the range of their hash into parts;
counts: the exploded rows grouped by part, where equal n-grams of all blocks are summed and each block's row is joined
to the sums; replies: (block, order, part, counts), joined by block to the documents, where the words' scores are
summed per document. A frequent n-gram takes one entry per block, never one per occurrence. N-grams longer than two are
exploded only where both n-grams one shorter occur `least` times; they can't otherwise.

Every document is part of its own counts, so with `least` = 1 no n-gram would ever be given up, and a text of words that occur
nowhere else would get the best score there is; with 2, an n-gram counts if it occurs in another place too.

Counts are 64-bit integers; they are sent with as many bytes as the largest of a row needs. Equal rows of a batch go as one with a number
of copies, and blocks are dealt by a hash of id and text, so neither null nor repeated ids nor repeated rows fill one block.

Defined cases: documents that are null or have no words have n_tokens 0, log_score 0 and a null mean_log_score. Rows that
repeat an id are scored each and counted each. Very long texts are read whole. Empty tables give no rows. Extra columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import gram_hashes, hashes_of, small_batches

ORDER, ALPHA, LEAST, BLOCK, PART = 3, 0.4, 2, 16 << 20, 4_000_000
EXPLODED = "block long, ord int, part long, hashes binary, counts binary"
REPLY = "block long, ord int, part long, counts binary"


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on: equal bytes lie together, for the shuffle's compression."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b""


def unplanes(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def packed(counts: np.ndarray) -> bytes:
    """Counts as planes, after a byte that says how wide they are."""
    most = int(counts.max()) if len(counts) else 0
    kind = next(k for k in ("<u2", "<u4", "<u8") if most < 1 << 8 * np.dtype(k).itemsize)
    return kind[2].encode() + planes(counts.astype(kind))


def unpacked(data: bytes) -> np.ndarray:
    return unplanes(data[1:], f"<u{data[:1].decode()}").astype(np.int64)


def rising(x: np.ndarray) -> bytes:
    """Sorted hashes as the planes of their differences."""
    return planes(np.diff(x, prepend=np.uint64(0)).astype("<u8"))


def risen(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, "<u8"), dtype=np.uint64)


class Block:
    """The n-grams of a block's documents; grams(n) lie at the positions at(n) of their last words."""

    def __init__(self, texts: list[bytes | None], copies: list[int] | None = None):
        self.copies = np.ones(len(texts), np.int64) if copies is None else np.array(copies, np.int64)
        each = [hashes_of(t.lower().split() if t else []) for t in texts]
        self.lengths = np.array([len(h) for h in each], np.int64)
        self.h = np.concatenate(each) if each else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(each)), self.lengths)
        starts = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(len(self.h)) - starts[self.doc] if len(self.h) else np.zeros(0, np.int64)
        self.count: dict[int, np.ndarray] = {}  # n -> corpus count of the n-gram that ends at each position; 0 without one

    def at(self, n: int, least: int) -> np.ndarray:
        """The positions whose n-grams are exploded."""
        if n <= 2:
            return np.flatnonzero(self.place >= n - 1)
        c = self.count[n - 1]
        good = (self.place >= n - 1) & (c >= least)
        good[1:] &= c[:-1] >= least
        return np.flatnonzero(good)

    def grams(self, n: int, at: np.ndarray) -> np.ndarray:
        g = gram_hashes(self.h, n)
        return g[at - (n - 1)]

    def exploded(self, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams in order, and how often each occurs here."""
        at = self.at(n, least)
        u, inverse = np.unique(self.grams(n, at), return_inverse=True)
        return u, np.bincount(inverse, self.copies[self.doc[at]], len(u)).astype(np.int64)

    def learn(self, n: int, counts: np.ndarray, least: int) -> None:
        at = self.at(n, least)
        u, inverse = np.unique(self.grams(n, at), return_inverse=True)
        if len(u) != len(counts):
            raise ValueError(f"{len(counts)} counts for {len(u)} n-grams")
        self.count[n] = np.zeros(len(self.h), np.int64)
        self.count[n][at] = counts[inverse]

    def scores(self, order: int, alpha: float, least: int, total: int) -> np.ndarray:
        """The sum of the logarithms for each document."""
        if not len(self.h):
            return np.zeros(len(self.lengths))
        longest = np.minimum(self.place + 1, order)
        value = np.log(self.count[1]) - math.log(max(1, total)) + math.log(alpha) * (longest - 1)
        for n in range(2, order + 1):
            c = self.count[n]
            at = np.flatnonzero(c >= least)
            value[at] = np.log(c[at]) - np.log(self.count[n - 1][at - 1]) + math.log(alpha) * (longest[at] - n)
        return np.bincount(self.doc, value, len(self.lengths))


def tokens_and_bytes(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    r = docs.agg(F.sum(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long"), F.sum(F.octet_length(text_col)).cast("long")).first()
    return r[0] or 0, r[1] or 0


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST, block: int = BLOCK, part: int = PART, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_tokens, log_score and mean_log_score."""
    total, size = tokens_and_bytes(docs, text_col)
    blocks = max(1, -(-size // block))
    # parts are told by the leading bits of a hash
    bits = max(0, (total // part).bit_length())
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def squeezed(batches):
        # texts are dealt out once and read in each round: zstandard makes them a third smaller than the shuffle would
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            own: dict[tuple, int] = {}
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                own[r] = own.get(r, 0) + 1
            data = [None if t is None else pack(t.encode("utf-8", "surrogatepass")) for _, _, t in own]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in own], pa.int64()), pa.array([r[1] for r in own], batch.schema.field(1).type), pa.array(list(own.values()), pa.int64()), pa.array(data, pa.binary())], ["block", "id", "copies", "text"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select(F.expr(f"pmod(xxhash64(id, text), {blocks}L)").alias("block"), "id", "text")
    texts = texts.mapInArrow(squeezed, f"block long, id {kind}, copies long, text binary").repartition(blocks, "block")

    def restored(held: pa.Table, replies: pa.Table | None) -> Block:
        unpack = zstandard.ZstdDecompressor().decompress
        b = Block([None if t is None else unpack(t) for t in held["text"].to_pylist()], held["copies"].to_pylist())
        if replies is not None:
            rows = sorted(replies.select(["ord", "part", "counts"]).to_pylist(), key=lambda r: (r["ord"], r["part"]))
            for n in sorted({r["ord"] for r in rows}):
                b.learn(n, np.concatenate([unpacked(r["counts"]) for r in rows if r["ord"] == n]), least)
        return b

    def exploded(b: Block, orders: list[int], number: int) -> pa.Table:
        rows = []
        for n in orders:
            u, c = b.exploded(n, least)
            of = (u >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(u), np.int64)
            # only parts that occur; without any, an empty one: a block knows of each order that it was answered
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(u)]
            rows += [{"block": number, "ord": n, "part": int(of[i]) if j > i else 0, "hashes": rising(u[i:j]), "counts": packed(c[i:j])} for i, j in zip(cuts, cuts[1:])]
        return pa.Table.from_pylist(rows, schema=pa.schema([("block", pa.int64()), ("ord", pa.int32()), ("part", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())]))

    def first(held: pa.Table) -> pa.Table:
        return exploded(restored(held, None), [n for n in (1, 2) if n <= order], held["block"][0].as_py())

    def further(n: int):
        return lambda held, replies: exploded(restored(held, replies), [n], held["block"][0].as_py())

    def count(rows: pa.Table) -> pa.Table:
        h = [risen(x) for x in rows["hashes"].to_pylist()]
        _, inverse = np.unique(np.concatenate(h), return_inverse=True)
        sums = np.zeros(int(inverse.max()) + 1 if len(inverse) else 0, np.int64)
        cuts = np.cumsum([0, *(len(x) for x in h)])
        for x, i, j in zip(rows["counts"].to_pylist(), cuts, cuts[1:]):
            sums[inverse[i:j]] += unpacked(x)  # a row's hashes are distinct
        return pa.table({"block": rows["block"], "ord": rows["ord"], "part": rows["part"], "counts": pa.array([packed(sums[inverse[i:j]]) for i, j in zip(cuts, cuts[1:])], pa.binary())})

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy("ord", "part").applyInArrow(count, REPLY)

    replies = counted(texts.groupBy("block").applyInArrow(first, EXPLODED))
    for n in range(3, order + 1):
        replies = replies.unionByName(counted(texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(further(n), EXPLODED)))

    def finish(held: pa.Table, replies: pa.Table) -> pa.Table:
        b = restored(held, replies)
        return pa.table({"id": held["id"], "copies": held["copies"], "n_tokens": pa.array(b.lengths), "log_score": pa.array(b.scores(order, alpha, least, total))})

    out = texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, f"id {kind}, copies long, n_tokens long, log_score double")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))  # at most the rows of a batch
    mean = F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens"))
    return out.select(F.col("id").alias(id_col), "n_tokens", "log_score", mean.alias("mean_log_score"))
