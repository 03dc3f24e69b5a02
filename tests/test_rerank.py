"""Pairs scored on executors, rankings of many queries in one plan, and a scorer fitted on labelled pairs."""

import random

import numpy as np
import pytest

from gneiss.operators import rerank as rr

RANKED = [(q, i, float(100 - i) + q) for q in range(3) for i in range(10)]


@pytest.fixture(scope="module")
def tables(spark):
    ranked = spark.createDataFrame(RANKED, "query_id int, idx long, score double").repartition(3)
    queries = spark.createDataFrame([(0, "red fox"), (1, "blue"), (2, None)], "query_id int, query string")
    docs = spark.createDataFrame([(i, None if i == 9 else "a red fox " * (i == 3) + "blue " * (i % 4) + "text") for i in range(10)], "idx long, doc string")
    return ranked, queries, docs


def by_hand(queries, docs, scorer, top):
    texts, q = {r.idx: r.doc or "" for r in docs.collect()}, {r.query_id: r.query or "" for r in queries.collect()}
    out = {}
    for k in q:
        own = sorted(((s, i) for a, i, s in RANKED if a == k), key=lambda x: (-x[0], x[1]))
        new = scorer([(q[k], texts[i]) for _, i in own[:top]])
        out |= {(k, i): own[0][0] + 1 + x - min(new) for (_, i), x in zip(own, new)} | {(k, i): s for s, i in own[top:]}
    return out


@pytest.mark.parametrize("block", [1, 3, 64])
def test_rankings_match_a_loop_over_queries(tables, block):
    ranked, queries, docs = tables
    got = {(r.query_id, r.idx): r.score for r in rr.rerank(ranked, queries, docs, rr.PairScorer(), top=4, block=block).collect()}
    want = by_hand(queries, docs, rr.PairScorer(), 4)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)
    assert max((s, i) for (q, i), s in got.items() if q == 0)[1] == 3


def test_documents_that_are_not_there_and_nothing_at_all(spark, tables):
    ranked, queries, docs = tables
    out = rr.rerank(ranked, queries, docs.limit(0), rr.PairScorer(), top=2)
    assert out.count() == len(RANKED)
    assert rr.rerank(ranked.limit(0), queries, docs, rr.PairScorer()).collect() == []


def test_a_query_keeps_its_scores_if_the_scorer_fails(tables):
    ranked, queries, docs = tables

    def fails(block):
        if any(q == "blue" for q, _ in block):
            raise RuntimeError
        return [float(len(d)) for _, d in block]

    got = {(r.query_id, r.idx): r.score for r in rr.rerank(ranked, queries, docs, fails, top=4, block=1).collect()}
    assert all(got[q, i] == s for q, i, s in RANKED if q == 1) and got[0, 3] > 101


def test_the_plan_collects_nothing(tables):
    ranked, queries, docs = tables
    plan = rr.rerank(ranked, queries, docs, rr.PairScorer(), top=4)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" in plan


def test_features_by_hand():
    assert rr.dense_features(["b", "c"], ["a", "b", "c", "x"]) == [1.0, 1.0, 1.0, 0.5, 1.0, 0.5, 1 / 1.04]
    assert rr.dense_features([], ["a"])[1:6] == [0.0] * 5 and rr.dense_features(["a"], [])[1:] == [0.0] * 5 + [1.0]
    assert rr.words("Ab_c 12 ÄÖ") == ["ab", "c", "12", "äö"] and rr.words(None) == []


def test_a_fitted_scorer_tells_held_out_pairs(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}x" for i in range(300)]
    rows = []
    for _ in range(900):
        q = rng.sample(vocabulary, 3)
        d = rng.choices(vocabulary, k=30)
        label = rng.random() < 0.5
        at = rng.randrange(25)
        # words of the query side by side are relevant, the same words spread out are not
        if label:
            d[at : at + 3] = q
        else:
            for w in q:
                d[rng.randrange(30)] = w
        rows.append((" ".join(q), " ".join(d), int(label)))
    pairs = spark.createDataFrame(rows, "query string, doc string, label int")
    scorer = rr.fit(pairs.limit(600))
    held = rows[600:]
    scores = scorer([(q, d) for q, d, _ in held])
    assert np.mean((scores > 0.5) == np.array([y for *_, y in held])) > 0.93
    got = rr.score_pairs(spark.createDataFrame(held, "query string, doc string, label int"), scorer).collect()
    assert {(r.query, r.doc): r.pair_score for r in got} == {(q, d): pytest.approx(x, abs=1e-9) for (q, d, _), x in zip(held, scores)}


def test_a_bounded_sample_and_no_labels(spark):
    none = spark.createDataFrame([("a", "b", None)], "query string, doc string, label int")
    assert rr.fit(none)([("a", "a")])[0] > rr.fit(none)([("a", "b")])[0]
    many = spark.createDataFrame([("a", "a" if i % 2 else "b", i % 2) for i in range(100)], "query string, doc string, label int")
    assert rr.fit(many, sample=40)([("a", "a")])[0] > 0.5
