"""Approximate neighbours against all products."""

import numpy as np
import pytest

from gneiss.operators import dense, neighbours


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def clustered(spark):
    """6,000 vectors in 300 tight groups, some of them copies of each other."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(300, 24))
    x = unit(centres[rng.integers(0, 300, 6000)] + 0.25 * rng.normal(size=(6000, 24)))
    x[100:160] = x[100]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, embedding array<float>").repartition(3)
    return x, rows, neighbours.build(rows)


def test_recall_and_rows_met(spark, clustered):
    x, rows, graph = clustered
    rng = np.random.default_rng(6)
    q = unit(x[rng.integers(0, 6000, 60)] + 0.1 * rng.normal(size=(60, 24)))
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id int, query_vec array<double>")
    want, got, met = {}, {}, {}
    for r in dense.search(rows, asked, 10).collect():
        want.setdefault(r.query_id, {})[r.idx] = r.score
    for r in graph.walk(asked, beam=12).collect():
        met.setdefault(r.query_id, {})[r.idx] = r.score
    for i in met:
        got[i] = sorted(met[i], key=lambda j: (-met[i][j], j))[:10]
    # a copy is as near as another
    recall = np.mean([sum(met[i][j] >= min(want[i].values()) - 1e-6 for j in got[i]) / 10 for i in want])
    touched = np.mean([len(met[i]) for i in met]) + len(graph.pivots[0])
    assert recall >= 0.95 and touched < 0.1 * 6000 and len(got) == 60
    assert all(met[i][j] == pytest.approx(float(np.float32(x[j]).astype(float) @ q[i]), abs=1e-9) for i in list(met)[:3] for j in met[i])


def test_few_rows_nulls_and_none(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, None), (4, [])], "idx long, embedding array<float>")
    asked = spark.createDataFrame([(0, [0.0, 1.0]), (1, None)], "query_id int, query_vec array<double>")
    got = neighbours.build(rows).search(asked, 5).collect()
    assert [(r.query_id, r.idx, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 2, 1), (0, 1, 2)]
    assert neighbours.build(rows.limit(0)).search(asked, 5).collect() == []
