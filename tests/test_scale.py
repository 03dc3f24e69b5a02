"""Pruned postings, prefixes of many questions, components, and rank spread for many questions, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from gneiss.operators import dense, graph, lexical, mapview
from gneiss.plans import batch
from gneiss.plans.store import Epoch


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        # rare words lie close together: most blocks can't hold one of the best
        words = [f"common{rng.randrange(5)}" for _ in range(rng.randrange(1, 30))] + ["needle"] * (rng.randrange(1, 6) if 200 <= i < 230 else 0)
        rows.append((i, " ".join(words)))
    return spark.createDataFrame([*rows, (700, None), (701, "")], "idx long, doc string")


def split(c):
    return F.split(c, " ")


def test_pruned_rows_are_those_of_all_postings(spark, library):
    index = lexical.build(library, split, block=16)
    queries = spark.createDataFrame([(1, "needle common1"), (2, "common0 common0 common3"), (3, "absent"), (4, "needle")], "query_id int, query string")
    every = index.search(queries, None, split).collect()
    for k in (1, 5, 700):
        want = {}
        for r in every:
            want.setdefault(r.query_id, []).append((-round(r.score, 12), r.idx))
        want = {q: [i for _, i in sorted(rows)[:k]] for q, rows in want.items()}
        got = {}
        for r in sorted(index.search(queries, k, split).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.query_id, []).append(r.idx)
        assert got == want


def test_blocks_below_the_threshold_are_not_read(spark, library):
    index = lexical.build(library, split, block=16)
    asked = spark.createDataFrame([(1, "needle", 1), (1, "common1", 1)], "query_id int, term string, qtf long")
    weighted = index._weighted(asked)
    first, left = index.opened(weighted, 5)
    _, remaining = index.remaining(weighted, 5)
    total = first.count() + left.count()
    assert total >= 37 and first.count() + remaining.count() < total / 4


def test_no_postings(spark):
    index = lexical.build(spark.createDataFrame([], "idx long, doc string"))
    assert index.ask(["a"], 5).collect() == [] and index.search(spark.createDataFrame([(1, "a"), (2, None)], "query_id int, query string"), 5).collect() == []


def test_prefixes_of_many_questions(spark):
    rng = random.Random(9)
    nodes = spark.createDataFrame([(i, f"get{rng.choice('ABC')}Name_{rng.choice(['x1', 'name', 'no'])}", f"src/{rng.choice(['na', 'names', 'g'])}.py") for i in range(80)], "idx long, label string, source_file string")
    index = mapview.token_index(nodes)
    asked = [(0, "na n"), (1, "getaname na na"), (2, "x"), (3, ""), (4, None), (5, "py-src"), (6, " g? ")]
    got = {}
    for r in sorted(mapview.prefix_hits_all(index, spark.createDataFrame(asked, "query_id int, query string"), 10).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.idx, round(r.score, 9)))
    for i, q in asked:
        want = [(r.idx, round(r.score, 9)) for r in mapview.prefix_hits(index, q or "", 10).collect()]
        assert got.get(i, []) == want


@pytest.mark.parametrize("hubs", [1, 1000])
def test_components_of_paths_stars_and_names(spark, hubs, monkeypatch):
    monkeypatch.setattr(graph, "HUBS", hubs)
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(500, i) for i in range(501, 540)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(50)] + [(900, 900)]
    pairs = [(f"n{a:04}", f"n{b:04}") for a, b in pairs]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(pairs, "a string, b string").repartition(3)
    groups = graph.components(df)
    assert {r.node: r.root for r in groups.collect()} == {x: find(x) for x in root}
    start = spark.createDataFrame([("n0500",), ("n0030",), ("n0031",), ("n9999",)], "node string")
    got = {r.node for r in graph.closure(groups, start).collect()}
    assert got == {x for x in root if find(x) in {"n0500", "n0000"}} - {"n0500", "n0030", "n0031"}
    assert {r.node for r in graph.beside(df, start).collect()} == {f"n{i:04}" for i in range(501, 540)} | {"n0029", "n0032"}


def test_rank_of_many_questions_is_that_of_each(spark):
    rng = random.Random(3)
    # nodes from 50 on have no edges of their own
    edges = spark.createDataFrame([(rng.randrange(50), rng.randrange(60), 1.0 + rng.randrange(3)) for _ in range(150)], "src long, dst long, weight double").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    seeds = [(7, 1, 2.0), (7, 55, 1.0), (8, 3, 1.0), (8, 4, -1.0), (9, 77, 1.0)]
    got = {}
    for r in batch.spread(edges, spark.createDataFrame(seeds, "query_id int, idx long, score double"), iterations=10).collect():
        got.setdefault(r.query_id, {})[r.idx] = r.score
    for q in (7, 9):
        own = spark.createDataFrame([(i, s) for a, i, s in seeds if a == q], "idx long, score double")
        want = {r.idx: r.score for r in graph.ppr(edges, own, iterations=10).collect()}
        assert all(got[q].get(i, 0.0) == pytest.approx(s, abs=1e-6) for i, s in want.items()) and sum(got[q].values()) == pytest.approx(1.0, abs=1e-6)
    assert set(got) == {7, 8, 9}


def test_vectors_of_half_precision_come_back(spark, tmp_path):
    epoch = Epoch(spark, tmp_path)
    rows = [("a", [1.0, -0.5, 0.333]), ("b", None), ("c", []), ("d", [2.0, 65504.0])]
    dense.save(epoch, spark.createDataFrame(rows, "node_key string, embedding array<float>"))
    got = {r.node_key: r.embedding for r in dense.load(epoch).collect()}
    assert got["a"] == pytest.approx([1.0, -0.5, 0.333], rel=2**-11) and got["b"] is None and got["c"] == [] and got["d"] == [2.0, 65504.0]
    assert dict(epoch.read("vectors").dtypes)["half"] == "binary" and dense.load(Epoch(spark, tmp_path / "none")) is None
    epoch.write("vectors", spark.createDataFrame([("x", [1.0])], "node_key string, embedding array<float>"))
    assert dense.load(epoch).first().embedding == [1.0]
