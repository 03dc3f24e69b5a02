"""Communities on the cluster against moves one by one on the driver."""

import random

import pytest

from gneiss.operators import community, graph


def df(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long").repartition(3)


def planted(seed, groups=8, size=16, inside=0.5, between=0.01):
    rng = random.Random(seed)
    n = groups * size
    return [(a, b) for a in range(n) for b in range(a) if rng.random() < (inside if a // size == b // size else between)]


def by_driver(spark, pairs):
    found = graph.louvain([(f"{a:06}", f"{b:06}") for a, b in pairs])
    return spark.createDataFrame([(int(x), int(c)) for x, c in found.items()], "idx long, community long")


def test_modularity_is_near_the_drivers(spark):
    pairs = planted(1)
    e = df(spark, pairs)
    got, want = community.communities(e), by_driver(spark, pairs)
    assert sorted(r.idx for r in got.collect()) == sorted({x for p in pairs for x in p if p[0] != p[1]})
    assert community.modularity(e, got) >= 0.99 * community.modularity(e, want)


def test_modularity_by_hand(spark):
    # two triangles and an edge between them: 6 / 7 inside, degrees 7 and 7
    pairs = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
    groups = spark.createDataFrame([(i, i // 3) for i in range(6)], "idx long, community long")
    assert community.modularity(df(spark, pairs), groups) == pytest.approx(6 / 7 - 0.5)
    assert {r.idx: r.community for r in community.communities(df(spark, pairs)).collect()} == {i: i // 3 * 3 for i in range(6)}


@pytest.mark.parametrize("find", [community.communities, community.label_communities])
def test_a_hub_and_its_leaves_are_one(spark, find):
    pairs = [(7, i) for i in range(100, 140)] + [(8, i) for i in range(200, 240)] + [(7, 8)]
    e = spark.createDataFrame([(a, b, 1.0 if (a, b) == (7, 8) else 5.0) for a, b in pairs], "src long, dst long, weight double")
    got = {r.idx: r.community for r in find(e).collect()}
    assert got == {i: 7 if i == 7 or 100 <= i < 140 else 8 for i in got} and len(got) == 82


@pytest.mark.parametrize("find", [community.communities, community.label_communities])
def test_no_edges_and_loops(spark, find):
    assert find(df(spark, []).limit(0)).collect() == []
    assert find(df(spark, [(3, 3)])).collect() == []
    assert {r.idx: r.community for r in find(df(spark, [(1, 2), (2, 1), (2, 1), (1, 1)])).collect()} == {1: 1, 2: 1}
