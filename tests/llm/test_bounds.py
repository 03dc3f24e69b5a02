"""What bounds must not lose: samples taken after joins, budgets of repeated rows, values that look like markers."""

import collections
import os

import pytest
from pyspark.sql import functions as F

from gneiss.llm import langid, mixing, queries, toxicity

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_labels_without_documents_take_no_place_in_the_sample(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "you vile nasty fool").otherwise("a calm and kind note").alias("text"))
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("toxic"))
    absent = spark.range(1000, 21_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    model = toxicity.train(docs, labels.unionByName(absent), sample=100)
    rows = toxicity.score(docs, model).collect()
    assert all((r.score > 0.9) == (r.doc_id % 2 == 0) for r in rows)


def test_a_model_of_nothing_knows_nothing(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, "other words")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), l1=1000.0)
    assert all(r.score < 1e-300 for r in toxicity.score(docs, model).collect())


def test_a_language_called_und(spark):
    rows = [(i, " ".join(["alpha beta gamma delta"] * 20), "und") for i in range(5)] + [(i, " ".join(["eins zwei drei vier"] * 20), "de") for i in range(5, 10)] + [(10, "12", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in langid.predict(docs, langid.train(docs)).collect()}
    assert all(got[i] == ("und", False) for i in range(5)) and all(got[i] == ("de", False) for i in range(5, 10)) and got[10] == ("und", True)


def test_repeated_rows_keep_the_budget(spark):
    same = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("small").alias("source"))
    large = spark.range(1500).select(F.col("id") + 100, F.lit("one two three"), F.lit("large"))
    docs = same.union(large).withColumn("row", F.lit(1)).withColumn("times", F.lit("x"))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert dict(mixed.groupBy("source").count().collect()) == {"small": 1500, "large": 1500}
    assert mixing.mix(docs).count() == 3000


@needs_data
def test_mixing_mixes_the_given_tables(spark):
    rows = queries.op7_mixing(spark, SF).collect()
    assert {r.exponent for r in rows} != {1.0} and max(r.exponent for r in rows) < 1
    placed, own, longest, quota = collections.Counter(), collections.Counter(), collections.Counter(), {}
    for r in rows:
        placed[r.source] += r.tokens
        own[r.source] += r.tokens * (r["pass"] == 0)
        longest[r.source] = max(longest[r.source], r.tokens)
        quota[r.source] = r.quota
    top = max(own, key=own.get)
    assert len(rows) > spark.read.parquet(f"{SF}/documents.parquet").count() and len(own) > 1
    for s in own:
        # sources come near to each other, as far as the repetition limit lets them
        assert quota[s] == pytest.approx(min(1.5, (own[top] / own[s]) ** (1 - rows[0].exponent)), rel=1e-3) and (s == top or quota[s] > 1)
        assert quota[s] * own[s] - 1e-6 <= placed[s] <= quota[s] * own[s] + longest[s]
