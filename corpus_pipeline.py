"""A corpus pipeline: each stage reads what its predecessor kept and returns the columns of documents; the last one returns packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gneiss.llm import langid, minhash, mixing, packing, toxicity
from gneiss.llm.common import discard, keyed, numbered, stored, table
from gneiss.llm.queries import tokenizer_path

#: SQL can't express FTRL, compression, hashed orders and tokenizers.
ORACLE_SQL = None

# Columns are numbered inside a stage, so that columns of any name may stand beside those of documents.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.3, by a model of the labels of documents that are there; all of them where none has a label.

    Whole texts are scored, null and empty ones by the model's bias. Rows are judged one by one, so rows that repeat an id or text go together;
    null ids have no label and stay if their text does. An empty table stays empty.
    """
    d, name = numbered(docs)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(d, model, text_col=name["text"], out="score")
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(d.columns).toDF(*docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart by compression; lang becomes the predicted one. Where no document has a language, those with letters, as they are.

    Whole texts are compressed, in chunks. Null and empty texts and such without a letter have no language and go. Rows are judged one by one,
    whatever their ids; rows that repeat a text go together. An empty table stays empty.
    """
    d, name = numbered(docs)
    dictionaries = langid.train(docs)
    found = langid.predict(d, dictionaries, text_col=name["text"]).where(~F.col("rejected"))
    return found.withColumn(name["lang"], F.col("lang_pred") if dictionaries else F.col(name["lang"])).select(d.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8): the one with the smallest id; null ids come last.

    Rows are told apart by a key of the stage's own, so null and repeated ids are rows like others: a row that repeats an id and text is
    a copy. Texts without words are in no group, and all stay.
    """
    d, name = numbered(docs)
    d = keyed(d, "row")
    groups = minhash.near_duplicates(d, size=5, percent=80, id_col="row", text_col=name["text"]).select("row", "component_id")
    order = F.struct(F.col(name["doc_id"]).isNull().alias("none"), F.col(name["doc_id"]).alias("id"), F.col("row"))
    least = groups.join(d.select("row", name["doc_id"]), "row").groupBy("component_id").agg(F.min(order).alias("least"))
    out = d.join(least.select(F.col("least.row").alias("kept")), F.col("row") == F.col("kept"), "left_semi")
    return out.drop("row").toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as temperature mixing places them, with op7's defaults: sources even but for the repetition limit of 1.5; each row once at least.

    A null source is one of its own; null and empty texts have one token, very long ones all of theirs. Of rows that repeat an id, source and
    number of tokens as many are repeated as the mix says. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 tokens: op9's rows.

    Texts are encoded whole and cut where a window ends; null and empty ones are the end mark alone. Rows that repeat an id or text are packed each.
    An empty table gives no rows.
    """
    return packing.pack(docs, tokenizer_path(), known=100_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder; each stage before it is written and read again."""
    docs, last = table(spark, sf_dir, "documents"), len(STAGES) - 1
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == last:
            return out
        before, docs = docs, stored(out, name)
        discard(before)
    return docs
