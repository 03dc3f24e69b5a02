"""Periodic runs of words, by the runs theorem.

A run is a maximal stretch of words with smallest period p that holds p at least twice. In one of two opposite orders of words, the longest
Lyndon word at each place where a period of the run begins, but its first, is one period. So each place offers two candidates: its longest
Lyndon word ends before the next smaller value of the inverse suffix array, and before the next greater one for the opposite order. A
candidate is extended to both sides by longest common extensions, which are minima of the LCP array between two ranks, read from
a sparse table; the extension to the left reads an index of the reversed words.

The documents of a batch are indexed together: a word's key begins with its document, later documents first, so that no extension leaves
a document and each document ends before something smaller. Batches are bounded by rows and bytes; a longer text is a batch of its own.
Nothing is shuffled.

Defined cases: null, empty and blank texts have no words and no runs, and their collapsed text is empty. Words are runs of characters other
than \\x20 and \\x09-\\x0D, compared as they are. Very long texts are read whole, in n log n. Rows are treated one by one, so repeated rows and null or
repeated ids give a row each. Empty tables give no rows. The table's other columns, whatever their names, are kept.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import numbered, small_batches

RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Suffixes:
    """Ranks of the suffixes of a sequence of keys, and longest common extensions of two of them."""

    def __init__(self, key: np.ndarray):
        n = self.n = len(key)
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.full(n + 1, -1, np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        #: by_length[k]: ranks by the first 2 ** k keys, equal where these are
        self.by_length = [rank.copy()]
        step = 1
        while True:
            tied = np.flatnonzero(~(new & np.append(new[1:], True)))
            if not len(tied):
                break
            at = order[tied]
            both = (rank[at].astype(np.int64) << 32) + (rank[np.minimum(at + step, n)] + 1)
            by = np.argsort(both, kind="stable")
            at, both = at[by], both[by]
            order[tied] = at
            fresh = np.append(True, both[1:] != both[:-1])
            new[tied] = fresh
            rank[at] = np.maximum.accumulate(np.where(fresh, tied, 0))
            self.by_length.append(rank.copy())
            step *= 2
        self.rank = rank
        self.minima = [self._lcp(order)]

    def _lcp(self, order: np.ndarray) -> np.ndarray:
        """Common keys of each suffix and the one before it in order."""
        first = self.by_length[0]
        near = np.flatnonzero(first[order[1:]] == first[order[:-1]])
        a, b = order[near].copy(), order[near + 1].copy()
        common = np.zeros(len(near), np.int32)
        for k in reversed(range(len(self.by_length))):
            rank = self.by_length[k]
            same = (rank[a] == rank[b]).astype(np.int32) << k
            common += same
            a, b = a + same, b + same
        out = np.zeros(self.n, np.int32)
        out[near + 1] = common
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of the suffixes at i and j, which differ."""
        if not len(i):
            return np.zeros(0, np.int32)
        x, y = self.rank[i], self.rank[j]
        lo, hi = np.minimum(x, y) + 1, np.maximum(x, y)
        k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        while len(self.minima) <= k.max():
            last, width = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-width], last[width:]))
        out = np.zeros(len(i), np.int32)
        for level in np.unique(k):
            of = k == level
            table = self.minima[level]
            out[of] = np.minimum(table[lo[of]], table[hi[of] - (1 << level) + 1])
        return out


def next_values(rank: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each place the next one with a smaller and with a greater value; their number where there is none."""
    n = len(rank)
    smaller, greater = [n] * n, [n] * n
    falling, rising = [], []
    for i, x in enumerate(rank):
        while rising and rank[rising[-1]] > x:
            smaller[rising.pop()] = i
        rising.append(i)
        while falling and rank[falling[-1]] < x:
            greater[falling.pop()] = i
        falling.append(i)
    return np.array(smaller, np.int64), np.array(greater, np.int64)


def find_runs(texts: list[list], least: int = 6, times: int = 4) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, period) of length >= max(least, times x period), by start and period; times >= 4."""
    out = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    n = int(sizes.sum())
    if not n:
        return out
    code = pa.array(chain.from_iterable(texts), pa.large_binary(), size=n).dictionary_encode().indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    begins, end = ends - sizes, ends[doc]
    key = (len(texts) - doc) << 32 | code
    forward = Suffixes(key)
    place, found = np.arange(n), []
    # of the places where a period begins, the first but the run's own start has two periods and more to its right in a run of four
    for after in next_values(forward.rank[:n].tolist()):
        period = after - place
        at = np.flatnonzero((place + 3 * period <= end) & (forward.by_length[0][place] == forward.by_length[0][after]))
        at = at[forward.common(at, after[at]) >= 2 * period[at]]
        found.append(np.stack([at, period[at]], 1))
    at, period = np.unique(np.concatenate(found), axis=0).T
    if not len(at):
        return out
    inside = np.isin(doc, doc[at])
    backward = Suffixes(key[inside][::-1])
    moved = np.cumsum(inside) - 1  # places among the documents that are indexed backwards
    left, own = np.zeros(len(at), np.int64), at > begins[doc[at]]
    x = backward.n - moved[at[own]]
    left[own] = backward.common(x, x - period[own])
    start, length = at - left, left + forward.common(at, at + period) + period
    long = length >= np.maximum(least, times * period)
    for s, p, m in np.unique(np.stack([start, period, length], 1)[long], axis=0).tolist():
        out[doc[s]].append((s - int(begins[doc[s]]), m, p))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for s, m, p in runs:
        depth[s + p] += 1
        depth[s + m] -= 1
    return b" ".join([w for w, d in zip(words, np.cumsum(depth[:-1]).tolist()) if not d])


def strongest(runs: list[tuple[int, int, int]]):
    """The run with the greatest length / period, exactly; of equals the one that starts first, then of the smallest period."""
    return min(runs, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2])) if runs else None


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """docs with runs, an array of (start, length, period) in words, strongest, one of them or null, and collapsed, the text without repeated
    periods, in place of columns of these names."""
    if times < 4:
        raise ValueError("runs are found from four periods on")
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("runs", "strongest", "collapsed")]
    d, name = numbered(docs)
    own = [name[c] for c in kept]
    d = d.select(*own, F.col(name[text_col]).cast("binary").alias("words"))
    run = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])
    named = lambda r: r and dict(zip(("start", "length", "period"), r))

    def work(batches):
        for batch in batches:
            words = [(t or b"").split() for t in batch.column("words").to_pylist()]
            runs = find_runs(words, least, times)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in own),
                    pa.array([[named(r) for r in rs] for rs in runs], pa.list_(run)),
                    pa.array([named(strongest(rs)) for rs in runs], run),
                    pa.array([collapsed(w, rs) for w, rs in zip(words, runs)], pa.binary()).cast(pa.string()),
                ],
                [*own, "runs", "strongest", "collapsed"],
            )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(own).schema), f"runs array<{RUN}>", f"strongest {RUN}", "collapsed string"])
    return d.mapInArrow(work, schema).toDF(*kept, "runs", "strongest", "collapsed")
