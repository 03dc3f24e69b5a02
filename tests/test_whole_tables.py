"""Queries over whole tables against brute force on small ones."""

import collections
import datetime
import random

import numpy as np

from pyspark.sql import functions as F

from gneiss import registry
from gneiss.functions import stats, text
from gneiss.operators import dense, evaluation, ingest, temporal


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_file_cycles_of_all_orders(spark, tmp_path):
    rng = random.Random(4)
    owner = {i: rng.randrange(1, 60) for i in range(1, 500)}
    lines = [(rng.randrange(1, 500), rng.choice([rng.randrange(1, 500), rng.randrange(480, 900)])) for _ in range(110)] + [(400, 450), (450, 400)]
    owner |= {400: 100, 450: 101}
    sf = write(spark, tmp_path / "t", lineitem=(lines, "l_orderkey long, l_partkey long"), orders=(list(owner.items()), "o_orderkey long, o_custkey long"))
    edges = collections.defaultdict(set)
    for a, b in lines:
        if a in owner and b in owner and owner[a] != owner[b]:
            edges[owner[a]].add(owner[b])

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            new = edges[todo.pop()] - seen
            seen |= new
            todo += new
        return seen

    reached = {x: reach(x) for x in set(owner.values())}
    want = {tuple(sorted(y for y in reached[x] if x in reached[y])) for x in reached if x in reached[x]}
    got = registry.QUERIES["file_cycles"](spark, sf).collect()
    assert {tuple(int(f[1:]) for f in r.files.split(",")) for r in got} == want and len(got) == len(want) > 1
    assert all(r.size == len(r.files.split(",")) and r.component == r.files.split(",")[0] for r in got)


def test_containers_of_all_users(spark, tmp_path):
    rng = random.Random(5)
    begin = datetime.datetime(2024, 1, 1)
    rows = [(i, rng.choice([3, 41, 77]), begin + datetime.timedelta(minutes=rng.randrange(9000))) for i in range(90)]
    sf = write(spark, tmp_path / "t", events=(rows, "event_id long, user_id long, ts timestamp_ntz"))
    spans = {i: (u, m := (t - begin).days * 1440 + (t - begin).seconds // 60, m + 600 + i * 7919 % 5000) for i, u, t in rows}

    def parent(i):
        u, a, b = spans[i]
        around = [(d - c, -c, j) for j, (v, c, d) in spans.items() if v == u and j != i and c <= a and b <= d and d - c > b - a]
        return min(around)[2] if around else None

    got = {r.span_id: r.parent_id for r in registry.QUERIES["innermost_container"](spark, sf).collect()}
    assert got == {i: parent(i) for i in spans}
    assert any(p is not None and spans[i][0] > 40 for i, p in got.items())


def embeddings(n=210, d=6):
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, (n, d)).astype(np.float64)  # many equal scores
    x[:, 0] += 3
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_every_twentieth_vector_is_a_query(spark, tmp_path):
    x = embeddings()
    labels = [i % 7 for i in range(len(x))]
    sf = write(spark, tmp_path / "t", embeddings=([(i, v.tolist(), labels[i]) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int"))
    y = x.astype(np.float64)
    want = {q: np.lexsort((np.arange(len(y)), -np.round(y @ y[q], 12)))[:50].tolist() for q in range(0, len(y), 20)}
    got = {}
    for r in registry.QUERIES["cosine_topk"](spark, sf).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.idx
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 51)) for g in got.values())
    for q, g in got.items():
        assert np.allclose([y[q] @ y[g[r]] for r in range(1, 51)], y[want[q]] @ y[q], atol=1e-9)
    fused = registry.QUERIES["rrf_fuse"](spark, sf).collect()
    assert {(r.query_id, r.idx) for r in fused} == {(q, i) for q, g in got.items() for i in g.values()}
    rows = {r.query_id: r for r in registry.QUERIES["recall_at_k"](spark, sf).collect()}
    rr = {}
    for q, g in got.items():
        same = [r for r, i in sorted(g.items()) if labels[i] == labels[q]]
        rr[q] = 1 / same[0]
        assert abs(rows[q].recall_10 - sum(r <= 10 for r in same) / labels.count(labels[q])) < 1e-6 and abs(rows[q].rr - rr[q]) < 1e-6
    m = registry.QUERIES["mrr"](spark, sf).first()
    assert m.n == len(want) == 11 and abs(m.mrr - sum(rr.values()) / 11) < 1e-6
    assert {r.query_id for r in registry.QUERIES["pack_greedy"](spark, sf).collect()} == set(want)


def test_search_in_blocks_of_queries_and_rows(spark):
    x = embeddings(90)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [1.0])], "idx long, embedding array<float>")
    q = d.select(d.idx.alias("query_id"), d.embedding.alias("query_vec"))
    got = {(r.query_id, r["rank"]): (r.idx, round(r.score, 9)) for r in dense.search(d, q, 4, at_once=20).collect()}
    y = x.astype(np.float64)
    assert {i for i, _ in got} == {*range(90), 91} and len(got) == 90 * 4 + 1
    for i in range(90):
        s = np.sort(y @ y[i])[::-1][:4]
        assert np.allclose([got[i, r][1] for r in (1, 2, 3, 4)], s, atol=1e-8)
    assert dense.search(d, q.limit(0), 4).count() == 0


def test_blend_and_map_of_all_rows(spark, tmp_path):
    rng = random.Random(7)
    balance = {i: round(rng.uniform(-900, 9000), 2) for i in range(1, 41)}
    orders = [(i, rng.randrange(1, 30), round(rng.uniform(1, 900), 2)) for i in range(120)]
    nations = {i: f"N{(i * 7) % 25:02d}" for i in range(25)}
    suppliers = [(i, f"S{i}", rng.choice([*range(25), 99])) for i in range(1, 81)]
    sf = write(
        spark, tmp_path / "t", customer=([(i, f"C{i}", b) for i, b in balance.items()], "c_custkey long, c_name string, c_acctbal double"), orders=(orders, "o_orderkey long, o_custkey long, o_totalprice double"),
        nation=(list(nations.items()), "n_nationkey long, n_name string"), supplier=(suppliers, "s_suppkey long, s_name string, s_nationkey long"),
    )
    m = collections.Counter()
    for _, c, x in orders:
        m[c] += x
    f = {i: max(b, 0) for i, b in balance.items()}
    want = {i: 0.6 * f[i] / max(f.values()) + 0.4 * m[i] / max(m.values()) for i in f if f[i] > 0 or m[i] > 0}
    got = {r.idx: r.score for r in registry.QUERIES["blend_scores"](spark, sf).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 2e-6 for i in want) and any(i >= 30 for i in got)
    code = {n: k for k, n in enumerate(sorted({nations[k] for _, _, k in suppliers if k in nations}))}
    owner = {r.idx: r.owner for r in registry.QUERIES["map_nodes"](spark, sf).collect()}
    assert owner == {i: code[nations[k]] if k in nations else -1 for i, _, k in suppliers}


def test_page_rank_until_it_settles_and_all_resamples(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    lines = [(rng.randrange(1, 9), rng.randrange(1, 12)) for _ in range(30)]
    sf = write(spark, tmp_path / "t", lineitem=(lines, "l_suppkey long, l_partkey long"), supplier=([(i, 10.0 * i) for i in range(1, 9)], "s_suppkey long, s_acctbal double"), customer=([(i, float(i)) for i in range(9)], "c_custkey long, c_acctbal double"))
    nodes = sorted({a * 2 for a, _ in lines} | {b * 2 + 1 for _, b in lines} | {2 * i for i in range(1, 9)})
    at, w, seed = {x: i for i, x in enumerate(nodes)}, np.zeros((len(nodes),) * 2), np.zeros(len(nodes))
    for a, b in lines:
        w[at[a * 2], at[b * 2 + 1]] += 1
        w[at[b * 2 + 1], at[a * 2]] += 1
    w /= np.maximum(w.sum(axis=1, keepdims=True), 1)
    for i in range(1, 9):
        seed[at[2 * i]] = i / 36
    p = seed
    for _ in range(30):
        spread = 0.85 * p @ w
        p = spread + seed * (1 - spread.sum())
    got = {r.idx: r.score for r in registry.QUERIES["ppr_structural"](spark, sf).collect()}
    assert all(abs(got.get(x, 0) - p[i]) < 1e-5 for x, i in at.items())
    seen, own = [], evaluation.paired_bootstrap
    monkeypatch.setattr(evaluation, "paired_bootstrap", lambda d, iterations=2000: seen.append(iterations) or own(d, iterations))
    assert registry.QUERIES["paired_bootstrap"](spark, sf).first().delta == 4.0 and seen == [2000]


def test_nested_and_crossing_spans(spark):
    """Containers of some kinds only; equal extents hold none of each other."""
    rng = random.Random(9)
    rows = [(rng.choice("ab"), i, a, a + rng.choice([0, 1, 2, 5, 9, 20]), rng.choice(["class", "function"])) for i in range(160) for a in [rng.randrange(1, 30)]]
    d = spark.createDataFrame(rows, "path string, span_id long, start_line int, end_line int, kind string")
    for kinds in (None, ["class"]):
        got = {r.span_id: r.parent_id for r in ingest.innermost_container(d, kinds).collect()}
        for p, i, a, b, _ in rows:
            around = [(y - x, -x, j) for q, j, x, y, k in rows if q == p and j != i and x <= a and b <= y and y - x > b - a and (kinds is None or k in kinds)]
            assert got[i] == (min(around)[2] if around else None)


def test_draws_are_poisson_numbers(spark):
    d = spark.range(300).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(299).cast("long"))))
    w = np.array([r.w for r in d.select(evaluation.poisson(evaluation.draw(F.col("id"), F.col("i"), 0)).alias("w")).collect()]).reshape(300, 300)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    assert abs(np.corrcoef(w.ravel()[:-1], w.ravel()[1:])[0, 1]) < 0.02
    assert abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.02 and w.mean(axis=0).std() < 0.1 and w.mean(axis=1).std() < 0.1
    # rows of the operator and of the driver's version are the same
    x = [float(i % 5) for i in range(40)]
    op = evaluation.paired_bootstrap(spark.createDataFrame(list(enumerate(x)), "key long, diff double")).first()
    assert np.allclose(evaluation.bootstrap([0.0] * 40, x), tuple(op))


def test_quantiles_and_p_values(spark):
    assert abs(stats.chi2_quantile(0.01) - stats.CHI2_01) < 1e-9 and abs(stats.chi2_quantile(0.05) - 3.841458820694124) < 1e-9
    pairs = [(f"a{i}", f"b{i}", 5, 0.5, 10, 10, 1.0, g) for i, g in enumerate([0.0, 3.0, 6.63, 6.64, 50.0])]
    d = spark.createDataFrame(pairs, "path_a string, path_b string, n_ab long, support double, n_a long, n_b long, lift double, g_stat double")
    assert [r.path_a for r in temporal.significant(d).orderBy("path_a").collect()] == ["a3", "a4"]
    assert temporal.significant(d, max_p=1.0).count() == 5


def test_words_that_split(spark):
    texts = ["parseURLPath of the HTTPServer", "plain words only", "naïveté Größe übermorgen", "get2Items 日本語です", "ALLCAPS Mixed mIxed", "", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    split = text.split_identifier
    slow = F.flatten(F.transform(F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(text.WORD), F.lit(0)), lambda w: F.concat(F.array(F.lower(w)), F.when(F.size(split(w)) > 1, split(w)).otherwise(F.array().cast("array<string>")))))
    for r in d.select("i", text.tokenize("t").alias("a"), slow.alias("b")).collect():
        pairs = ["日本", "本語", "語で", "です"] if "日" in (texts[r.i] or "") else []
        assert sorted(r.a) == sorted([*r.b, *pairs]), texts[r.i]
