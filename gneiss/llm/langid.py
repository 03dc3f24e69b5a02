"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of sampled texts. A text (lower-cased, runs of characters
that are not letters made one blank) is cut into chunks, each chunk is compressed with each language's dictionary, and
the language with the smallest total is chosen; ties go to the language with more sampled documents, then by name.
Chunks keep the dictionary in reach over long texts; the whole text counts.

The margin is (second smallest - smallest) / second smallest. `score` is 1 - 2^-(margin / `half`), and a text is
rejected if its margin is below `narrow` or it has no letter.

Sample: at most `per_lang` texts of each language, by a hash of the text, copies once; a dictionary holds at most
`dictionary` bytes of them, or `room` bytes shared equally by all languages if that is less, so that what is broadcast is bounded whatever
their number: no language is left out. Each document gives an equal share first (more where others are shorter): pieces of about
`PIECE` bytes from places all over the text, in the order of a hash. A language's dictionary is made in one task from its sampled texts.

Defined cases: texts that are null or have no letters (combining marks alone are none) get `und`, score 0 and are rejected. Rows with a
null language teach nothing, nor does a language whose sampled texts have no letters. With nothing learned every text is `und` with score
0, and none is rejected but those without letters. Rows that repeat an id are predicted each; copies of a text teach once. Very long texts are read whole, chunk by chunk. Extra columns are kept; one that has the name of a result is replaced by it. An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from .common import small_batches, stored

PER_LANG, DICTIONARY, ROOM, CHUNK, LEVEL, NARROW, HALF = 64, 96 * 1024, 128 << 20, 2048, 6, 0.002, 0.05
PIECE = 256
#: Rows of a sample that are broadcast to find their texts; a larger one is joined.
PICKED = 500_000
_GAPS, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}").search
RESULT = "lang_pred string, score double, margin double, rejected boolean"


def plain(text: str | None) -> bytes:
    """The text's letters in lower case, words parted by one blank; empty if it has none."""
    return _GAPS.sub(" ", text.lower()).strip().encode("utf-8", "replace") if text and _LETTER(text) else b""


def spread(data: bytes, most: int, piece: int = PIECE) -> bytes:
    """At most `most` bytes of data: its pieces, which end with a word where one ends soon, in the order of a hash of their place."""
    if not data:
        return data
    data, ends, at = b" " + data, [0], 0
    while at < len(data):
        cut = data.find(b" ", at + piece, at + piece + 64)
        at = min(len(data), at + piece if cut < 0 else cut)
        ends.append(at)
    seed = xxhash.xxh3_64_intdigest(data)  # texts of one length give different places
    order = sorted(range(len(ends) - 1), key=lambda i: xxhash.xxh3_64_intdigest(i.to_bytes(8, "little"), seed))
    # pieces begin with the blank before them
    return b"".join(data[ends[i] : ends[i + 1]] for i in order[: most // piece + 2])[:most]


def made_of(texts: list[bytes], dictionary: int) -> bytes:
    """A dictionary of texts: an equal share of each first, at its end, so that one long text doesn't fill it; at least the 8 bytes that zstandard needs."""
    texts = [t for t in texts if t]
    share = max(256, dictionary // max(1, len(texts)))
    data = b" ".join([t[share:] for t in texts] + [t[:share] for t in texts])[-dictionary:]
    return data and data.rjust(8)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, dictionary: int = DICTIONARY, room: int = ROOM) -> dict[str, bytes]:
    """Dictionaries by language, the language with most sampled documents first."""
    small_batches(docs.sparkSession)
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    keyed = known.withColumn("key", F.xxhash64(F.lit("langid"), "text"))  # of copies, the same
    # of each of a few buckets of a language the row of the least hash, as a sum that is aggregated where the rows are; of these the first
    least = keyed.groupBy("lang", F.pmod("key", F.lit(4 * per_lang)).alias("bucket")).agg(F.min("key").alias("key"))
    order = Window.partitionBy("lang").orderBy("key")  # 4 x per_lang rows of a language at most
    picked = stored(least.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_lang).select(F.col("lang").alias("_lang"), F.col("key").alias("_key")), "picked")
    languages, wanted = picked.agg(F.count_distinct("_lang"), F.count("*")).first()
    most = min(dictionary, max(256, room // max(1, languages)))
    picked = F.broadcast(picked) if wanted <= PICKED else picked
    rows = keyed.join(picked, F.expr("lang = _lang and key = _key")).groupBy("lang", "key").agg(F.first("text").alias("text"))

    def pieces(batches):
        for batch in batches:
            data = [spread(plain(t), most) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("key"), pa.array(data, pa.binary())], ["lang", "key", "data"])

    def gathered(t: pa.Table) -> pa.Table:
        texts = [r["data"] for r in sorted(t.to_pylist(), key=lambda r: r["key"])]
        return pa.table({"lang": t["lang"].slice(0, 1), "n": pa.array([len(texts)], pa.int64()), "data": pa.array([made_of(texts, most)], pa.binary())})

    found = rows.mapInArrow(pieces, "lang string, key long, data binary").groupBy("lang").applyInArrow(gathered, "lang string, n long, data binary").collect()
    return {r["lang"]: bytes(r["data"]) for r in sorted(found, key=lambda r: (-r["n"], r["lang"])) if r["data"]}


class Coders:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.langs = list(dictionaries)
        self.coders = []
        for data in dictionaries.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def sizes(self, data: bytes, chunk: int = CHUNK) -> list[int]:
        parts = [data[i : i + chunk] for i in range(0, len(data), chunk)]
        return [sum(len(c(p)) for p in parts) for c in self.coders]

    def choose(self, text: str | None) -> tuple[str, float, bool]:
        """The language, the margin, and whether there is one; a language may be called `und` itself."""
        data = plain(text)
        if not data or not self.langs:
            return "und", 0.0, False
        sizes = self.sizes(data)
        if len(sizes) == 1:
            return self.langs[0], 1.0, True
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        second = min(s for i, s in enumerate(sizes) if i != best)
        return self.langs[best], (second - sizes[best]) / second, True


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", level: int = LEVEL, narrow: float = NARROW, half: float = HALF) -> DataFrame:
    """docs with lang_pred, score, margin and rejected."""
    small_batches(docs.sparkSession)
    own = StructType.fromDDL(RESULT)
    keep = [f for f in docs.schema.fields if f.name.lower() not in own.names]
    at = [f.name for f in keep].index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    state: list[Coders] = []

    def run(batches):
        if not state:
            state.append(Coders(sent.value, level))
        for batch in batches:
            got = [state[0].choose(t) for t in batch.column(at).to_pylist()]
            margin = np.array([m for _, m, _ in got], np.float64)
            score = 1 - np.exp2(-margin / half)
            bad = np.array([not told for _, _, told in got], bool) | (margin < narrow)
            if not state[0].langs:
                bad = np.array([not plain(t) for t in batch.column(at).to_pylist()], bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([l for l, _, _ in got], pa.string()), pa.array(score), pa.array(margin), pa.array(bad)], names=[*batch.schema.names, *own.names])

    return docs.select([f.name for f in keep]).mapInArrow(run, StructType([*keep, *own.fields]))
