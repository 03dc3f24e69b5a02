"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its lower-cased words, word pairs and pairs that skip one word; the
words are also hashed by their first letters (`stem`), which stands for the inflections of a word. Training runs
over a sample of at most `sample` labelled documents (the first by a hash of the id, then of the text; whole texts) and at most `room`
bytes of features, in one task, in a hashed order: FTRL with a learning rate for each coordinate and L1 sparsity. Most coordinates stay at
zero, so the weights that are sent to all tasks are a small array of (index, weight), at most 2^bits entries. Scoring reads
every document once, without a shuffle.

Defined cases: null and empty texts have the score of the bias alone. Rows whose label is null, and labels of other
documents, teach nothing; a document with several labels counts as toxic if one of them is. An id that occurs with several texts teaches
each of them, equal rows teach once. With no labelled rows nothing is known, and all scores are 0. Very long texts are read whole: their
features are bounded by 2^bits. Extra columns are kept; one that has the name of the result is replaced by it. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import MIX, WordHashes, hashes_of, mix, small_batches

BITS, STEM, SAMPLE, ROOM, THRESHOLD = 22, 5, 16_000, 512 << 20, 0.3
UNKNOWN = -700.0  # the bias of a model that has learned nothing
ALPHA, BETA, L1, L2, EPOCHS = 0.6, 1.0, 3.0, 1.0, 5
#: Characters around words.
EDGES = b"\t\n\x0b\x0c\r !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Stems(dict):
    """Hashes of the first letters of words; bounded as WordHashes is."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WordHashes.limit:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word.decode("utf-8", "replace")[:STEM].encode("utf-8", "replace"), 1)
        if len(word) <= 64:
            self[word] = value
        return value


_stems = Stems()


def found(text: str | None, bits: int = BITS) -> np.ndarray:
    """Feature numbers of a text, with repeats."""
    if not text:
        return np.zeros(0, np.int64)
    words = [w for x in text.lower().encode("utf-8", "surrogatepass").split() if (w := x.strip(EDGES))]
    h = hashes_of(words)
    stems = np.fromiter(map(_stems.__getitem__, words), np.uint64, len(words))
    every = np.concatenate([h, mix(h[:-1] * MIX + h[1:]), mix(h[:-2] * MIX + h[2:] + np.uint64(1)), stems])
    return (every >> np.uint64(64 - bits)).astype(np.int64)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct feature numbers of a text."""
    return np.unique(found(text, bits))


def total(at: np.ndarray, w: np.ndarray) -> float:
    """The sum of w over the distinct numbers of at."""
    at = at[w[at] != 0]
    return float(w[np.unique(at)].sum(dtype=np.float64)) if len(at) else 0.0


def fit(rows: list[np.ndarray], labels: list[int], bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature numbers, weights, bias) after FTRL-proximal over the rows in their order."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weight(at):
        x = z[at]
        w = (np.sign(x) * l1 - x) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(x) <= l1] = 0
        return w

    for _ in range(epochs):
        for at, y in zip(rows, labels):
            at = np.append(at, np.int32(bias)).astype(np.int32)
            w = weight(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            m = n[at]
            z[at] += g - (np.sqrt(m + g * g) - np.sqrt(m)) / alpha * w
            n[at] = m + g * g
    used = np.flatnonzero(np.abs(z[:bias]) > l1)
    return used, weight(used), float(weight(np.array([bias]))[0])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, room: int = ROOM, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bits: int = BITS, **how) -> tuple[np.ndarray, np.ndarray, float]:
    """The model from at most `sample` labelled documents; its sparse weights reach the driver."""
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    # labels of documents that aren't there take no place in the sample
    y = y.join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    order = F.xxhash64(F.lit("toxicity"), "id")
    pick = F.broadcast(y.orderBy(order).limit(sample))
    # ids and hashes of texts are picked first: a repeated id brings no more than `sample` texts, a repeated row one
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(pick, "id").withColumn("h", F.xxhash64("text"))
    picked = texts.select("id", "h").distinct().orderBy(order, "h").limit(sample)
    rows = texts.join(F.broadcast(picked.toDF("_id", "_h")), F.expr("id = _id and h = _h")).select("id", "h", "text", "y")

    def featurise(batches):
        for batch in batches:
            data = [features(x, bits).astype("<i4").tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(data, pa.binary()), batch.column(3)], ["id", "h", "at", "y"])

    def learn(batches):
        # the features stay in the batches' own memory, 4 bytes each
        rows, held = [], 0
        for b in batches:
            for i, a, y in zip(b.column(0).to_pylist(), b.column(2), b.column(3).to_pylist()):
                x = a.as_buffer()
                held += x.size
                if held <= room or not rows:
                    rows.append((hash_of(i), np.frombuffer(x, "<i4") if x.size else np.zeros(0, "<i4"), y))
        rows.sort(key=lambda r: (r[0], len(r[1])))
        if rows:
            at, w, bias = fit([r[1] for r in rows], [r[2] for r in rows], bits, **how)
            yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i8").tobytes()]), pa.array([w.astype("<f8").tobytes()]), pa.array([bias])], ["at", "w", "bias"])

    def hash_of(x: str) -> int:
        return xxhash.xxh3_64_intdigest(x or "")

    seen = rows.mapInArrow(featurise, "id string, h long, at binary, y int").groupBy("id", "h", "y").agg(F.first("at").alias("at")).select("id", "h", "at", "y")
    one = seen.repartition(1).sortWithinPartitions(F.xxhash64(F.lit("room"), "id", "h"))
    model = one.mapInArrow(learn, "at binary, w binary, bias double").collect()
    if not model:
        return np.zeros(0, np.int64), np.zeros(0), UNKNOWN
    m = model[0]
    if not m["at"] and not m["bias"]:
        return np.zeros(0, np.int64), np.zeros(0), UNKNOWN
    return np.frombuffer(m["at"], "<i8"), np.frombuffer(m["w"], "<f8"), m["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", bits: int = BITS, out: str = "score") -> DataFrame:
    """docs with the score (0 to 1) of each whole text."""
    small_batches(docs.sparkSession)
    at, weights, bias = model
    keep = [f for f in docs.schema.fields if f.name.lower() != out.lower()]
    column = [f.name for f in keep].index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weights.astype(np.float32)))
    state: dict = {}

    def run(batches):
        if "w" not in state:
            w = np.zeros(1 << bits, np.float32)
            w[sent.value[0]] = sent.value[1]
            state["w"] = w
        w = state["w"]
        for batch in batches:
            x = np.array([bias + total(found(t, bits), w) for t in batch.column(column).to_pylist()], np.float64)
            p = 1 / (1 + np.exp(-np.clip(x, UNKNOWN, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, out])

    return docs.select([f.name for f in keep]).mapInArrow(run, StructType([*keep, StructField(out, DoubleType())]))
