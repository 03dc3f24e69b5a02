"""The pipeline and the queries on the smallest tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gneiss.llm import mixing, queries
from gneiss.llm.common import keyed

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@needs_data
def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == docs.columns, name
        assert out.join(d.select("doc_id"), "doc_id", "left_anti").count() == 0
        d = out
    kept = d.select("doc_id").distinct().count()
    assert 0.5 * docs.count() < kept < docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, d, SF)
    assert last.select("doc_id").distinct().count() == kept


@needs_data
def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_dedup", "mixing", "packing"]


@needs_data
def test_stages_take_empty_tables(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d, SF).count() == 0


@needs_data
def test_packed_rows_of_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    n = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert n.where("n > 4096").count() == 0 and rows.count() > 0


COLUMNS = {
    "op1_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op2_embedding_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op3_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op4_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op6_nearest_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op8_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op9_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op10_minhash_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
}


@needs_data
@pytest.mark.parametrize("name", COLUMNS)
def test_contract_columns(spark, name):
    out = queries.QUERIES[name](spark, SF)
    assert out.columns[: len(COLUMNS[name])] == COLUMNS[name]
    assert out.limit(1).count() == 1


@pytest.mark.parametrize("filed", [False, True])
def test_one_row_of_each_group_stays_whatever_its_id(spark, tmp_path, filed):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = lambda k: words(k) + " more"
    rows = [(None, words(1)), (None, near(1))]  # a group without ids
    rows += [(7, words(2))] * 5 + [(None, near(2))]  # repeated rows, and a near copy without an id
    rows += [(9, words(3)), (9, words(4)), (8, near(4))]  # an id with two texts
    rows += [(None, words(5)), (6, words(6)), (None, None), (10, "")]
    d = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").repartition(3)
    if filed:
        d.write.parquet(f"{tmp_path}/d")
        d = spark.read.parquet(f"{tmp_path}/d")
    assert keyed(d).select("_row").distinct().count() == len(rows)
    out = corpus_pipeline.drop_near_duplicates(spark, d, "")
    assert out.columns == d.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    first = [x for x in got if x in [(None, words(1)), (None, near(1))]]
    assert len(first) == 1
    assert got == sorted([*first, (7, words(2)), (9, words(3)), (8, near(4)), (None, words(5)), (6, words(6)), (None, None), (10, "")], key=repr)


def test_sources_are_mixed_as_by_op7(spark):
    rows = [(i, f"w{i} x y z", "hot" if i % 11 else "cold") for i in range(660)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed = lambda out: out.groupBy("source").count().orderBy("source").collect()
    got = placed(corpus_pipeline.mix_sources(spark, d, ""))
    assert got == placed(mixing.mixed_documents(d, repetition=1.5)) and got != placed(mixing.mixed_documents(d, repetition=1.25))


CLASH = "score double, rejected boolean, margin double, lang_pred string, _score double, _times int, times int, id long, row long, _row long, c0 string, copy int, source_tokens long, place long, tokens long, text2 string"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls, repeats, blank and long texts and clashing columns, after enough plain ones to learn from."""
    words = lambda k, n=40: " ".join(f"{'abcdefgh'[k % 8]}{'xyzuvw'[(k + i) % 6]}ord{chr(97 + i % 26)}" for i in range(n))
    rows = [(i, words(i) + f" n{i}", "en" if i % 2 else "de", f"s{i % 3}") for i in range(40)]
    rows += [(None, words(50), "en", None), (3, None, "en", "s1"), (60, "", None, "s0"), (61, words(61, 20_000), "de", "s0"), (62, "\u0301", "en", "s0")]
    rows += [(70, " ".join(f"u{j}q" for j in range(40)), "en", "s1")] * 6 + [(None, None, None, None)]
    clash = [0.5, True, 0.1, "x", 0.5, 3, 3, 1, 1, 1, "c", 1, 1, 1, 1, "t"]
    return spark.createDataFrame([(*r, len(r[1] or ""), *clash) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


def labels(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("filed", [False, True])
def test_stages_take_odd_rows(spark, odd, tmp_path, filed):
    sf = labels(spark, tmp_path, [(i, 1, int(i % 5 == 0)) for i in range(30)] + [(None, 1, 1), (3, 1, None)])
    d = odd
    if filed:
        d.write.parquet(f"{tmp_path}/d")
        d = spark.read.parquet(f"{tmp_path}/d")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == d.columns, name
        assert {r.score for r in out.select("score").collect()} == {0.5}
    packed = corpus_pipeline.STAGES[-1][1](spark, d, sf)
    assert packed.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    kept = corpus_pipeline.drop_near_duplicates(spark, d, sf).collect()
    assert sum(r.doc_id == 70 for r in kept) == 1 and sum(r.text is None for r in kept) == 2
    mixed = corpus_pipeline.mix_sources(spark, d, sf)
    assert mixed.count() >= d.count() and mixed.exceptAll(mixed.dropDuplicates()).count() >= 5


def test_nothing_learned_drops_nothing(spark, odd, tmp_path):
    none = labels(spark, tmp_path, [(10_000, 1, 1)])
    assert corpus_pipeline.drop_toxic(spark, odd, none).count() == odd.count()
    unknown = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.keep_languages(spark, unknown, none)
    assert kept.count() == odd.where("text rlike '[a-z]'").count() and kept.where("lang is not null").count() == 0


@needs_data
def test_pipeline_matches_brute_force(spark):
    """Stage by stage over the smallest tables: each stage's rows against plain Python over its input."""
    import xxhash
    from tokenizers import Tokenizer

    from gneiss.llm import langid, toxicity
    from tests.llm.test_operators import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    assert len(rows) == docs.count()
    stages = dict(corpus_pipeline.STAGES)

    # toxicity: all labelled documents, in the order of their ids' hashes
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None and r.doc_id in rows}
    learned = sorted(y, key=lambda i: (xxhash.xxh3_64_intdigest(str(i)), len(toxicity.features(rows[i].text))))
    at, w, bias = toxicity.fit([toxicity.features(rows[i].text) for i in learned], [y[i] for i in learned])
    weight = dict(zip(at.tolist(), w.tolist()))
    score = lambda t: 1 / (1 + np.exp(-(bias + sum(weight.get(f, 0.0) for f in toxicity.features(t).tolist()))))
    kept = stages["toxicity"](spark, docs, SF)
    want = {i for i, r in rows.items() if score(r.text) < 0.3}
    assert {r.doc_id for r in kept.collect()} == want and 0 < len(want) < len(rows)

    # language: the smallest sum of compressed chunks, with the dictionaries of the input
    coders = langid.Coders(langid.train(kept))
    found = {i: coders.choose(rows[i].text) for i in want}
    out = {r.doc_id: r.lang for r in stages["language_id"](spark, kept, SF).collect()}
    assert out == {i: lang for i, (lang, margin, told) in found.items() if told and margin >= langid.NARROW}
    langs = docs.where(F.col("doc_id").isin(list(out)))

    # near duplicates: all pairs of whole sets
    groups = brute([(i, rows[i].text) for i in out], 5, 80)
    unique = stages["near_dedup"](spark, langs, SF)
    want = {i for i, (n, root) in groups.items() if i == root}
    assert {r.doc_id for r in unique.collect()} == want and len(want) < len(out)

    # mixing: each source as often as its quota says, rows rounded up
    mixed = stages["mixing"](spark, unique, SF)
    tokens = lambda t: max(1, len((t or "").split()))
    sizes = {}
    for i in want:
        sizes[rows[i].source] = sizes.get(rows[i].source, 0) + tokens(rows[i].text)
    placed = {}
    for r in mixed.collect():
        placed[r.doc_id] = placed.get(r.doc_id, 0) + 1
    assert set(placed) == want and max(placed.values()) <= 2
    t = mixing.plan(spark.createDataFrame(list(sizes.items()), "source string, source_tokens long"), mixing.TARGET, 1.5)[1]
    for source, n in sizes.items():
        own = sum(tokens(rows[i].text) * c for i, c in placed.items() if rows[i].source == source)
        quota = min(1.5, (max(sizes.values()) / n) ** (1 - t))
        longest = max(tokens(rows[i].text) for i in want if rows[i].source == source)
        assert quota * n - 1e-6 <= own <= quota * n + longest

    # packing: the tokenizer's ids, each once for each time that a document is there
    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = {}
    for r in stages["packing"](spark, mixed, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == len(tok.encode(rows[r.doc_id].text or "", add_special_tokens=False).ids) + 1
    assert got == {i: c * (len(tok.encode(rows[i].text or "", add_special_tokens=False).ids) + 1) for i, c in placed.items()}
