"""Sum-of-squares online packing of documents into windows of 4096 tokens.

Each task packs the documents that it reads, in the order that it reads them, with no shuffle. A document is its
token ids and an end id. Whole windows are cut off its head; the rest is one piece. A level array counts the
task's partly filled windows by fill level (`grain` tokens a level, rounded up). A piece goes to the level, or to a
new window, for which the sum of the squared counts afterwards is smallest; windows at the last level are closed.
When the task's input ends, the windows that are still open are joined end to end in order of fill, cut at window
bounds: at most one window a task stays partly filled.

Memory: one Arrow batch of texts, the level array and the piece lists of open windows; a very long document is
encoded as one text, but its whole windows leave at once.

Defined cases: null and empty texts are the end id alone. Repeated rows are packed one by one. An empty table gives
no rows. Extra columns are ignored. sequence_id is (task << 32) + a number from 0, so no pass over all tasks is needed.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import small_batches

WINDOW, END, GRAIN = 4096, 2, 32
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Little-endian uint32 token ids of a text, as bytes.

    The tokenizer drops white space, cuts the lower-cased text into pieces by a pattern, and encodes each piece by
    itself. Texts of Latin letters, ASCII marks and digits are lower-cased and cut here, by the same pattern; other
    texts are cut at blanks and newlines only, across which no rule of the tokenizer looks. Ids of short pieces are kept in
    a table of bounded size, whose older half is dropped when it is full. New pieces are encoded many at a time and
    told apart by the ends of words that their last tokens show; other parts by a symbol of one token between them.
    """

    longest = 48
    symbols = "☃☎♻⚠✂✏❄➡⬇⭐"
    strange = re.compile(r"[^\n -~À-ÖØ-öø-ÿ]|<\|").search
    # Fixed value: the tokenizer's pattern, for such texts.
    pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+").findall

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.limit = limit
        self.tokenizer, self.young, self.old = Tokenizer.from_file(path), {"": b""}, {}
        # pieces are lower-cased and cut already: their blanks are all that is left to cut at
        rest = json.loads(self.tokenizer.to_str())
        rest["normalizer"], rest["pre_tokenizer"] = None, {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.bare = Tokenizer.from_str(json.dumps(rest))
        self.symbol, self.mark = next((c, e.ids[0]) for c in self.symbols if len(e := self.tokenizer.encode(c, add_special_tokens=False)) == 1)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def ids(self, text: str, bare: bool = False) -> np.ndarray:
        return np.array((self.bare if bare else self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def cut(self, some: list[str], ids: np.ndarray, ends: list[int], gap: int) -> None:
        data, at = ids.tobytes(), 0
        for p, k in zip(some, ends, strict=True):
            self.young[p] = data[at * 4 : k * 4]
            at = k + gap

    def learn(self, pieces: set[str], parts: set[str]) -> set[str]:
        """Enter what is new; the long ones among them are to be taken out again."""
        if len(self.young) > self.limit:
            self.young, self.old = {"": b""}, self.young
        young, old = self.young, self.old
        new = []
        for p in pieces.difference(young):
            v = old.get(p)
            if v is None:
                new.append(p)
            else:
                young[p] = v
        for i in range(0, len(new), 1024):
            some = new[i : i + 1024]
            ids = self.ids(" ".join(some), bare=True)
            self.cut(some, ids, (np.flatnonzero(self.last[ids]) + 1).tolist(), 0)
        new = [p for p in parts.difference(young) if self.symbol not in p]
        for i in range(0, len(new), 1024):
            some = new[i : i + 1024]
            ids = self.ids(f" {self.symbol} ".join(some))
            self.cut(some, ids, [*np.flatnonzero(ids == self.mark).tolist(), len(ids)], 1)
        for p in parts.difference(young):
            young[p] = self.ids(p).tobytes()
        return {p for s in (pieces, parts) for p in s if len(p) > self.longest}

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        split, strange = [], []
        for t in texts:
            odd = bool(t) and self.strange(t) is not None
            strange.append(odd)
            split.append(t.replace("\n", " ").split(" ") if odd else self.pieces(t.lower()) if t else [])
        out, i = [], 0
        while i < len(split):
            # as many texts as keep the table of their parts small
            sets, j = (set(), set()), i
            while j < len(split) and (j == i or len(sets[0]) + len(sets[1]) < self.limit // 2):
                sets[strange[j]].update(split[j])
                j += 1
            long = self.learn(*sets)
            known = self.young.__getitem__
            out += [b"".join(map(known, words)) for words in split[i:j]]
            for p in long:
                del self.young[p]
            i = j
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str, limit: int = 400_000) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].limit = limit
    return _encoders[path]


class Packer:
    """The level array. put() takes a piece's length and gives its window and offset."""

    def __init__(self, window: int = WINDOW, grain: int = GRAIN):
        self.window, self.grain, self.levels = window, grain, window // grain
        self.count = np.zeros(self.levels + 1, np.int64)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(self.levels + 1)]  # (window, fill)
        self.next = 0

    def full(self) -> int:
        """A window of its own for a piece of full length."""
        self.next += 1
        return self.next - 1

    def put(self, size: int) -> tuple[int, int]:
        grain, levels, count = self.grain, self.levels, self.count
        # a window of level h has at least window - h x grain tokens free; its level rises by size in levels, rounded up or down
        up = -(-size // grain)
        most = levels - up
        best, least = 0, 2 * count[up] + 1 if up < levels else 0  # a new window
        if most >= 1:
            n = count[1 : most + 1]
            change = 2 * (count[1 + up : most + 1 + up] - n) + 2
            if up + most == levels:  # there the window is closed and counts no more
                change[most - 1] = 1 - 2 * n[most - 1]
            change = np.where(n > 0, change, np.iinfo(np.int64).max)
            k = int(change.argmin())
            if n[k] > 0 and change[k] <= least:
                best = k + 1
        if best:
            window, fill = self.open[best].pop()
            count[best] -= 1
        else:
            window, fill = self.full(), 0
        level = -(-(fill + size) // grain)
        if level < levels:
            self.open[level].append((window, fill + size))
            count[level] += 1
        return window, fill


def cut_at(parts: list[tuple], window: int) -> list[list[tuple]]:
    """Lists of (piece, from, length, offset): the pieces (piece, length) laid end to end and cut at window bounds."""
    out, fill = [[]], 0
    for piece, length in parts:
        at = 0
        while at < length:
            if fill == window:
                out.append([])
                fill = 0
            k = min(length - at, window - fill)
            out[-1].append((piece, at, k, fill))
            at, fill = at + k, fill + k
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, grain: int = GRAIN, end: int = END, known: int = 400_000) -> DataFrame:
    """One row per piece (SCHEMA): its document's ids before it, its length and the CRC of its ids, and its place.

    known: pieces whose ids a worker keeps, about 0.2 KB each, twice that at most.
    """
    small_batches(docs.sparkSession)
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 32
        enc, packer = encoder(tokenizer, known), Packer(window, grain)
        held: dict[int, list] = {}  # pieces of open windows: (doc, start, bytes, doc tokens)
        rows: list[tuple] = []

        def out():
            columns = list(zip(*rows)) or [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in SCHEMA.split(", ")])

        def place(doc, start, data, total, w, offset):
            rows.append((doc, start, len(data) // 4, zlib.crc32(data), total, base + w, offset))

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo in range(0, len(ids), 1024):
                texts = batch.column(1).slice(lo, 1024).to_pylist()
                for doc, data in zip(ids[lo : lo + 1024], enc.encode_batch(texts)):
                    data += tail
                    total, at = len(data) // 4, 0
                    while total - at >= window:
                        place(doc, at, data[at * 4 : (at + window) * 4], total, packer.full(), 0)
                        at += window
                    if at < total:
                        w, offset = packer.put(total - at)
                        fill = offset + total - at
                        held.setdefault(w, []).append((doc, at, data[at * 4 :], total))
                        if -(-fill // grain) >= packer.levels:
                            o = 0
                            for d, s, x, n in held.pop(w):
                                place(d, s, x, n, w, o)
                                o += len(x) // 4
            if len(rows) > 20_000:
                yield out()
        # fullest first, so that few pieces are cut
        fill = {w: sum(len(p[2]) // 4 for p in ps) for w, ps in held.items()}
        parts = [(p, len(p[2]) // 4) for w in sorted(held, key=lambda w: (-fill[w], w)) for p in held[w]]
        names = sorted(held)
        for w, pieces in zip(names, cut_at(parts, window) if parts else []):
            for (d, s, x, n), at, k, o in pieces:
                place(d, s + at, x[at * 4 : (at + k) * 4], n, w, o)
        yield out()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
