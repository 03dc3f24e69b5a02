import random

import pytest
from pyspark.sql import functions as F

from gneiss.operators import community, fusion, graph, mapview, pack


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double")


def seeds(spark, *ids):
    return spark.createDataFrame([(i, 1.0) for i in ids], "idx long, score double")


def scores(d):
    return {r.idx: r.score for r in d.collect()}


def test_ppr_decays_along_a_chain_and_keeps_its_mass(spark):
    e = graph.symmetric_weights(edges(spark, [(0, 1), (1, 2), (2, 3), (3, 4)]))
    s = scores(graph.ppr(e, seeds(spark, 0)))
    assert s[1] > s[2] > s[3] > s[4] and s[0] > s[3] and abs(sum(s.values()) - 1) < 1e-6


def test_reverse_follows_edges_backwards(spark):
    e = edges(spark, [(0, 1), (1, 2)])
    assert scores(graph.ppr(e, seeds(spark, 0))).get(2, 0) > scores(graph.ppr(e, seeds(spark, 0), reverse=True)).get(2, 0)


def test_ppr_with_hubs_in_slices(spark):
    e = edges(spark, [(0, i) for i in range(1, 40)] + [(i, (i * 7) % 40) for i in range(1, 40)] + [(3, i) for i in range(10, 30)])
    plain, sliced = (scores(graph.ppr(e, seeds(spark, 0, 5), hub=h)) for h in (10**6, 6))
    assert plain.keys() == sliced.keys() and all(abs(plain[i] - sliced[i]) < 1e-12 for i in plain) and abs(sum(plain.values()) - 1) < 1e-9


def test_ppr_without_edges_stays_at_the_seed(spark):
    assert scores(graph.ppr(edges(spark, []), seeds(spark, 1))) == {1: pytest.approx(1.0)}


def test_channels(spark):
    s, t = (spark.createDataFrame(x, "idx long, score double") for x in ([(0, 0.01), (1, 0.02)], [(0, 100.0), (1, 1.0)]))
    assert scores(graph.combine_channels(s, t, 0.5))[0] == pytest.approx(0.75)
    assert scores(graph.combine_channels(s, t, 0.0)) == {0: pytest.approx(0.5), 1: pytest.approx(1.0)}
    assert scores(graph.combine_channels(None, t)) == {0: 100.0, 1: 1.0}
    with pytest.raises(ValueError):
        graph.combine_channels(None, None)


def toy(spark):
    names = ["src/a.ts", "src/b.ts", "src/c.ts", "test/a.test.ts"]
    n = spark.createDataFrame([(i, p, "file", p, i % 2) for i, p in enumerate(names)], "idx long, label string, kind string, source_file string, community long")
    return n, edges(spark, [(0, 1), (1, 2), (2, 0), (3, 0)])


def test_paths_cycles_tests_and_impact(spark):
    n, e = toy(spark)
    assert graph.shortest_path(e, 3, 2) in ([3, 0, 2], [3, 0, 1, 2]) and len(graph.shortest_path(e, 3, 2)) == 3
    assert graph.shortest_path(e, 3, 99) == []
    r = graph.file_cycles(e, n).collect()
    assert len(r) == 1 and r[0]["size"] == 3 and "test/a.test.ts" not in r[0]["files"]
    assert [x.path for x in graph.tests_for(e, n, "src/a.ts").collect()] == ["test/a.test.ts"]
    changed = spark.createDataFrame([("src/b.ts",), ("gone.ts",)], "path string")
    assert {x.path: x.connections for x in graph.diff_impact(e, n, changed).collect()} == {"src/a.ts": 1, "src/c.ts": 1}
    assert [x.path for x in graph.unindexed(n, changed).collect()] == ["gone.ts"]
    assert graph.find_node(n, "src/c.ts").first()["idx"] == 2 and graph.find_node(n, "A.TEST").first()["idx"] == 3


def test_strong_components_of_random_graphs(spark):
    rng = random.Random(4)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(60)}
    reach = {a: {a} for a in range(40)}
    for _ in range(40):
        for a, b in pairs:
            for x in reach:
                if a in reach[x]:
                    reach[x].add(b)
    want = {}
    for a in range(40):
        c = {b for b in reach[a] if a in reach[b]}
        if len(c) > 1:
            want[a] = min(c)
    got = {r.node: r.component for r in graph.strong_components(edges(spark, pairs)).collect()}
    assert got == want


def test_louvain_finds_two_cliques_in_any_order():
    a = [(f"a{i}", f"a{j}") for i in range(5) for j in range(i)] + [(f"b{i}", f"b{j}") for i in range(5) for j in range(i)] + [("a0", "b0")]
    one = graph.louvain(a)
    random.Random(1).shuffle(a)
    assert graph.louvain([(y, x) for x, y in a]) == one
    assert len({one[f"a{i}"] for i in range(5)}) == 1 and one["a1"] != one["b1"]


def test_label_propagation(spark):
    e = edges(spark, [(i, j) for i in range(5) for j in range(i)] + [(i + 10, j + 10) for i in range(5) for j in range(i)])
    got = {r.idx: r.community for r in community.label_communities(e).collect()}
    assert len({got[i] for i in range(5)}) == 1 and got[0] != got[10]


def test_community_merge_resolves_chains(spark):
    nodes = [(i, 0) for i in range(5)] + [(i, 1) for i in range(5, 9)] + [(9, 5), (10, 6), (11, 7)]
    n = spark.createDataFrame(nodes, "idx long, community long")
    got = {r.community: r.group for r in mapview.merge_communities(n, edges(spark, [(10, 9), (9, 0)]), top=2).collect()}
    assert got == {0: 0, 1: 1, 5: 0, 6: 0, 7: -1}


def test_capped_edges_skip_only_full_pairs(spark):
    p = spark.createDataFrame([("a", x, n) for n, x in enumerate("bcde", 1)] + [("b", "c", 9)], "a string, b string, n long")
    got = [tuple(r) for r in mapview.capped_edges(p, per_file=1, total=10).collect()]
    assert ("b", "c") in got and ("a", "e") in got and len(got) == 3
    assert mapview.capped_edges(p, total=2).count() == 2


@pytest.mark.parametrize("seed, per_file, total", [(1, 1, 1000), (2, 3, 1000), (3, 2, 15)])
def test_capped_edges_are_those_of_a_walk(spark, seed, per_file, total):
    rng = random.Random(seed)
    # a hub, ties, and a clique in which most edges are left out
    pairs = {(0, i) for i in range(1, 60)} | {(a, b) for b in range(60, 75) for a in range(60, b)} | {tuple(sorted(rng.sample(range(60), 2))) for _ in range(120)}
    rows = [(f"f{a:02}", f"f{b:02}", rng.randrange(1, 6)) for a, b in pairs]
    have, want = {}, []
    for a, b, n in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if len(want) < total and (have.get(a, 0) < per_file or have.get(b, 0) < per_file):
            want.append((a, b))
            have[a], have[b] = have.get(a, 0) + 1, have.get(b, 0) + 1
    got = mapview.capped_edges(spark.createDataFrame(rows, "a string, b string, n long").repartition(3), per_file, total)
    assert [tuple(r) for r in got.collect()] == want


def test_exact_names(spark):
    n = spark.createDataFrame([(0, "load()"), (1, "Load"), (2, "loader"), (3, "x")], "idx long, label string")
    assert scores(fusion.exact_match(n, "load()")) == {0: 1.0, 1: 1.0, 2: 0.7}
    assert fusion.exact_match(n, "ab").count() == 0 and fusion.exact_match(n, "load it").count() == 0


def test_explanations(spark):
    cases = [
        ((True, 0.0, 0.0, False, False, False), "matched query"), ((False, 1.0, 1.0, True, False, False), "in the same file as a match"),
        ((False, 1.0, 1.0, False, True, True), "connected in code; file co-changes with a matched file"), ((False, 0.0, 1.0, False, True, True), "file co-changes with a matched file"),
        ((False, 1.0, 1.0, False, True, False), "connected through code and co-change history"), ((False, 0.0, 1.0, False, True, False), "connected through co-change history"),
        ((False, 1.0, 0.0, False, False, False), "connected to matches"), ((False, 0.0, 0.0, False, False, False), "matched query"),
    ]
    d = spark.createDataFrame([c for c, _ in cases], "is_seed boolean, s double, t double, in_seed_files boolean, in_history_files boolean, next_to_seed_files boolean")
    assert [r.why for r in fusion.explain(d).collect()] == [w for _, w in cases]


def test_packs_hold_back_and_come_again():
    hit = lambda cost, f, c: {"cost": cost, "source_file": f, "community": c}
    hits = [hit(10, "a", 0)] * 4 + [hit(10, "b", 1), hit(200, "c", 2), hit(50, "d", 0)]
    taken, used = pack.order(hits, budget=100)
    assert taken == [0, 1, 2, 4, 6, 3] and used == 100
    assert pack.order([hit(5, None, None)] * 3, budget=4) == ([], 0)



def test_blast_takes_the_largest_weight(spark):
    e = spark.createDataFrame([(0, 1, False), (1, 2, True), (2, 3, False), (3, 4, False), (0, 5, True)], "src long, dst long, temporal boolean")
    got = {r.idx: r.weight for r in mapview.blast(e, spark.createDataFrame([(0,)], "idx long")).collect()}
    assert got == {0: 1.0, 1: 0.55, 2: pytest.approx(0.24), 3: 0.16, 5: pytest.approx(0.44)}
