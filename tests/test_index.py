import hashlib
import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from gneiss import cli, tools, viz
from gneiss.operators import dense, evaluation, ingest, lexical, pack, reports, temporal
from gneiss.plans import build, index
from gneiss.plans.batch import BatchRetriever
from gneiss.plans.retrieve import Retriever
from gneiss.plans.store import Conflict, Store
from gneiss.streaming import cochange
from tests.test_sources import MINI, write


def git(root, *args, **env):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=ann", "-c", "user.email=a@b", *args], check=True, capture_output=True, env=os.environ | env)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    write(root, MINI | {"tests/test_auth.py": "from app.auth import Session\n\n\ndef test_session():\n    Session()\n"})
    git(root, "init", "-q")
    for i in range(4):
        for f in ("app/auth.py", "app/db.py"):
            (root / f).write_text((root / f).read_text() + f"# {i}\n")
        git(root, "add", "app" if i else "-A")
        git(root, "commit", "-qm", f"change {i} of the login", GIT_AUTHOR_DATE=f"{1700000000 + i * 86400} +0000", GIT_COMMITTER_DATE=f"{1700000000 + i * 86400} +0000")
    store = Store(spark, tmp_path_factory.mktemp("index"))
    out = index.build_index(spark, str(root), store, config=temporal.HistoryConfig(min_support=0.1, max_p=1.0, edge_min_support=0.1), backend="hash", as_of=1700400000)
    return root, store, out


def test_index_tables(indexed):
    root, store, out = indexed
    e = store.open()
    nodes = {(r.label, r.kind): r for r in e.read("nodes").collect()}
    assert sorted(r.idx for r in nodes.values()) == list(range(len(nodes)))
    assert ("Session", "class") in nodes and ("refresh", "method") in nodes and ("auth.py", "file") in nodes and ("README.md", "document") in {(k[0], r.file_type) for k, r in nodes.items()}
    assert nodes[("auth.py", "file")].start_line == 1
    edges = {(r.src, r.dst, r.relation) for r in e.edges("structural").collect()}
    idx = {k: r.idx for k, r in nodes.items()}
    assert (idx[("Session", "class")], idx[("refresh", "method")], "contains") in edges
    assert (idx[("auth.py", "file")], idx[("db.py", "file")], "imports") in edges
    assert out["history"]["commits"] == 4 and {r.path_a for r in e.read("cochange").collect()} == {"app/auth.py"}
    assert e.edges("temporal").where("relation = 'co_changes_with'").count() == 1
    files = {r.path: r for r in e.read("files").collect()}
    assert files["app/auth.py"].n_commits == 4 and files["app/auth.py"].bus_factor == 1 and files["app/auth.py"].primary_owner == "ann"


def test_stored_postings_answer_as_documents_do(indexed):
    e = indexed[1].open()
    stored = lexical.LexicalIndex.load(e)
    a = [(r.idx, round(r.score, 9)) for r in stored.ask(["session", "store", "session"], 10).orderBy("rank").collect()]
    b = [(r.idx, round(r.score, 9)) for r in lexical.search_few(e.read("docs"), ["session", "store", "session"], 10).collect()]
    assert a == b and len(a) > 1
    assert "PushedFilters: [" in (plan := stored.ask(["session"])._jdf.queryExecution().toString()) and "In(term" in plan or "EqualTo(term" in plan
    assert lexical.LexicalIndex.load(type(e)(e.spark, f"{e.files.root}/none")) is None


def test_retrieval_and_provenance(indexed):
    root, store, _ = indexed
    r = Retriever(store.open(), encoder=dense.hash_encoder()).search("Session", k=10, seed_k=1)
    hits = {h.label: h for h in r.hits.collect()}
    assert hits["Session"].rank == 1 and hits["Session"].why == "matched query"
    assert hits["auth.py"].why == "in the same file as a match"
    assert hits["db.py"].why in ("connected in code; file co-changes with a matched file", "file co-changes with a matched file")
    none = Retriever(store.open(), use_dense=False).search("zzzzqq")
    assert none.hits is None and none.warnings
    assert Retriever(store.open(), include_tests=False).search("test session", use_ppr=False).hits.where("source_file like 'tests/%'").count() == 0


def test_many_questions_are_answered_as_one_by_one(spark, indexed):
    e = indexed[1].open()
    asked = [("a", "Session"), ("b", "how does the login refresh a session"), ("c", "zzzzqq"), ("d", "db")]
    got = {}
    for r in BatchRetriever(e, encoder=dense.hash_encoder()).search(spark.createDataFrame(asked, "query_id string, query string"), k=12).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.idx, r.score, r.source_file)
    one = Retriever(e, encoder=dense.hash_encoder())
    for name, q in asked[:2]:
        want = {h.rank: (h.idx, h.score, h.source_file) for h in one.search(q, k=12).hits.collect()}
        assert got[name].keys() == want.keys()
        assert all(got[name][k][1] == pytest.approx(want[k][1], abs=1e-6) for k in want)
        # nodes whose scores differ by less than that may change places
        assert {x[0] for x in got[name].values()} == {x[0] for x in want.values()}


def test_components_are_stored_with_the_pairs(indexed):
    e = indexed[1].open()
    groups = {r.node: r.root for r in e.read("cochange_groups").collect()}
    pairs = [(r.path_a, r.path_b) for r in e.read("cochange").collect()]
    assert pairs and groups.keys() == {x for p in pairs for x in p} and all(groups[a] == groups[b] == min(x for x in groups if groups[x] == groups[a]) for a, b in pairs)


def test_stored_tokens_answer_as_nodes_do(indexed):
    e = indexed[1].open()
    stored, nodes = e.read("tokens"), e.read("nodes")
    for q in ("auth ses", "re", "py py", "x", "nothing"):
        assert mapview.prefix_hits(stored, q).collect() == mapview.prefix_search(nodes, q).collect()
    plan = mapview.prefix_hits(stored, "auth ses")._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(StringStartsWith(token,auth)" in plan


def test_tools_answer(indexed):
    root, store, _ = indexed
    t = tools.Tools(store, str(root))
    assert "Session" in t.search("Session") and "class Session" in t.context_pack("Session") and "app/db.py" in t.co_change("app/auth.py")
    assert t.hotspots().startswith("app/") and "ann: 4 commits" in t.owners("app/auth.py") and "refresh" in t.explain("Session")
    assert t.path("auth.py", "db.py") == "auth.py -> db.py" and t.cycles() == "no cycles" or "app/" in t.cycles()
    assert "tests/test_auth.py" in t.tests_for("app/auth.py") and "nodes:" in t.graph_stats() and t.overview() == "no summaries"
    assert "connection(s)" in t.diff_impact("HEAD~1..HEAD") and "By code:" in t.impact_of("Session")
    assert len(tools.names()) == 13


def test_command_line(indexed, spark, capsys, tmp_path):
    root, store, _ = indexed
    base = ["--root", str(root), "--out", str(store.root)]
    assert cli.run([*base, "ask", "Session", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["hits"][0]["label"] == "Session"
    assert cli.run([*base, "map", str(tmp_path / "m.html")], spark) == 0 and "<svg" in (tmp_path / "m.html").read_text()
    assert cli.run([*base, "map", "--symbols", str(tmp_path / "s.html")], spark) == 0
    page = json.loads((tmp_path / "s.html").read_text().split('id="data">')[1].split("</script>")[0])
    assert {"Session", "auth.py"} <= {n["l"] for n in page["nodes"]} and page["edges"] and all(len(f"{n['c']:06x}") == 6 for n in page["nodes"])
    assert cli.run([*base, "stats"], spark) == 0 and cli.run([*base, "eval"], spark) == 1
    assert cli.run(["--out", str(tmp_path / "none"), "stats"], spark) == 1
    assert cli.run([*base, "summarize", "--command", "wc -c"], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["written"] > 0
    assert cli.run([*base, "summarize", "--command", "wc -c"], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["written"] == 0
    assert "(" in tools.Tools(store, str(root)).overview()


def test_epochs(spark, tmp_path):
    s = Store(spark, tmp_path)
    assert not s.exists()
    with pytest.raises(FileNotFoundError):
        s.open()
    d = spark.range(3)
    for i in range(5):
        with s.begin() as e:
            e.write("t", d.withColumn("i", F.lit(i)))
            e.write_edges(spark.createDataFrame([(0, 1)], "src long, dst long"), "structural")
            e.put_meta(**{f"k{i}": i})
    assert s.numbers() == [3, 4, 5] and s.open().read("t").first()["i"] == 4 and set(s.open().meta()) == {f"k{i}" for i in range(5)}
    before = s.open()
    with pytest.raises(RuntimeError):
        with s.begin() as e:
            e.write("t", d.limit(0).withColumn("i", F.lit(0)))
            raise RuntimeError
    assert s.numbers() == [3, 4, 5] and s.open().path == before.path
    with s.begin() as e:
        e.write_edges(spark.createDataFrame([(5, 6)], "src long, dst long"), "temporal")
    assert s.open().edges("structural").count() == 1 and s.open().edges("temporal").count() == 1 and before.read("t").count() == 3


def test_epochs_aside_are_never_published(spark, tmp_path):
    s = Store(spark, tmp_path)
    with s.begin() as e:
        e.write("t", spark.range(3))
        e.put_meta(a=1)
    with s.aside() as e:
        e.write("t", spark.range(5))
        e.put_meta(a=2)
        assert e.read("t").count() == 5 and e.meta() == {"a": 2} and s.open().meta() == {"a": 1}
    assert s.numbers() == [1] and s.open().read("t").count() == 3 and len(list((tmp_path / "data").iterdir())) == 1


def tables_of(path) -> set[str]:
    return {p.name.split("-", 1)[1] for p in (path / "data").iterdir()}


def test_of_two_writers_the_first_wins(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    with s.begin() as e:
        e.write("t", spark.range(3))
    with pytest.raises(Conflict):
        with s.begin() as late:
            late.write("late", spark.range(1))
            with s.begin() as e:
                e.write("t", spark.range(4))
                e.write("t", e.read("t").where("id > 0"))
    assert s.numbers() == [1, 2] and s.open().read("t").count() == 3 and "late" not in s.open() and tables_of(tmp_path) == {"t"}
    assert len(list((tmp_path / "data").iterdir())) == 2 and len(list((tmp_path / "log").glob("[0-9]*"))) == 2


def test_unchanged_tables_are_named_and_appended_ones_not_copied(spark, tmp_path):
    s = Store(spark, tmp_path)
    with s.begin() as e:
        e.write("a", spark.range(3))
    first = s.open()
    for i in range(5):
        with s.begin() as e:
            e.append("b", spark.range(i, i + 1))
            e.write("c", spark.range(i))
    now = s.open()
    assert now.tables["a"] == first.tables["a"] and sorted(r.id for r in now.read("b").collect()) == [0, 1, 2, 3, 4]
    assert sorted(p.name.split("-")[1] for p in (tmp_path / "data").iterdir()) == ["a"] + ["b"] * 5 + ["c"] * 3
    with s.begin(inherit=False) as e:
        e.put_meta(x=1)
    assert "a" not in s.open() and now.read("a").count() == 3 and s.open().edges() is None


def test_an_epoch_on_a_file_system_that_is_not_local(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.gneiss.link./store", f"file://{tmp_path}")
    s = Store(spark, "viewfs://gneiss/store/index")
    with s.begin() as e:
        e.write("t", spark.range(3))
        e.put_meta(said="é<")
    with pytest.raises(Conflict):
        with s.begin():
            with s.begin() as e:
                e.write_edges(spark.createDataFrame([(0, 1)], "src long, dst long"), "structural")
    assert s.numbers() == [1, 2] and s.open().read("t").count() == 3 and s.open().meta() == {"said": "é<"} and s.open().path.startswith("viewfs://gneiss/store")
    assert s.open().edges("structural").count() == 1 and s.open().edges("temporal").count() == 0 and (tmp_path / "index" / "log" / "000002.json").is_file()


def test_evaluation_leaves_the_index_alone(spark, tmp_path):
    root = tmp_path / "repo"
    write(root, {f"pkg/m{i}.py": f"def handler_{i}():\n    return {i}\n" for i in range(30)})
    git(root, "init", "-q")
    for i in range(60):
        f = root / f"pkg/m{i % 30}.py"
        f.write_text(f.read_text() + f"# {i}\n")
        git(root, "add", "-A")
        when = f"{1700000000 + i * 86400} +0000"
        git(root, "commit", "-qm", f"touch handler_{i % 30} in its module", GIT_AUTHOR_DATE=when, GIT_COMMITTER_DATE=when)
    store = Store(spark, tmp_path / "index")
    index.build_index(spark, str(root), store, backend="hash", as_of=1710000000)
    before = store.open().read("files").agg(F.sum("n_commits")).first()[0]
    rungs = cli.evaluate(spark, store, str(root), 0.5, 4, least=4)
    assert [r.name for r in rungs] == ["bm25", "dense", "hybrid", "hybrid+ppr"] and all(r.n == 4 for r in rungs)
    assert rungs[0].recall[20] > 0.9 and rungs[0].each != rungs[1].each
    assert store.numbers() == [1] and store.open().read("files").agg(F.sum("n_commits")).first()[0] == before


def test_communities_by_either_method(spark):
    paths = [f"r{g}/{x}.py" for g in range(3) for x in "abcd"] + ["z/one.py", "two.py"]
    edges = [(f"r{g}/{x}.py", f"r{g}/{y}.py") for g in range(3) for x in "abcd" for y in "abcd" if x < y]
    f, e = spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(edges, "importer string, target string")
    a, b, c = ({r.path: (r.community, r.community_name) for r in build.communities(spark, f, e, m).collect()} for m in ("louvain", "labels", "moves"))
    assert a == b == c and a["r1/a.py"] == (1, "r1") and a["z/one.py"][1] == "z" and a["two.py"][1] == "(root)"
    with pytest.raises(ValueError):
        build.communities(spark, f, e, "other")


def test_packs_are_rendered():
    items = [{"label": "f", "location": "a.py:3", "kind": "function", "why": "matched query", "text": "x = ```1```", "community": 2}, {"label": "g", "text": "", "community": None}]
    page = pack.render("how", items, 120, 2)
    assert page.startswith("# how\n\n2 items of 1 communities, about 120 tokens, 2 left out") and "````\nx = ```1```\n````" in page and "### 2. g" in page
    assert "no match" in pack.render("how", [], 0, 0, ["no match"])


def test_pages_escape_what_they_hold():
    data = {"regions": [{"name": "</script><b>"}], "files": [], "edges": [], "key": []}
    p = viz.page(data, "<t>{data}")
    assert "</script><b>" not in p and "&lt;t&gt;{data}" in p
    assert json.loads(p.split('id="data">')[1].split("</script>")[0]) == data


def test_vectors_are_kept_where_nothing_changed(spark):
    docs = spark.createDataFrame([("k1", "h1", "a b"), ("k2", "CHANGED", "c"), ("k3", "new", "")], "node_key string, content_hash string, doc string")
    old = spark.createDataFrame([("k1", "h1"), ("k2", "h2"), ("k4", "h4")], "node_key string, content_hash string")
    v = spark.createDataFrame([(k, [1.0, 0.0]) for k in ("k1", "k2", "k4")], "node_key string, embedding array<float>")
    assert {r.node_key for r in dense.dirty_keys(docs, old, v).where("dirty").collect()} == {"k2", "k3"}
    got = {r.node_key: r.embedding for r in dense.update_vectors(docs, old, v, dense.hash_encoder).collect()}
    assert set(got) == {"k1", "k2", "k3"} and got["k1"] == [1.0, 0.0] and abs(sum(x * x for x in got["k2"]) - 1) < 1e-5 and not any(got["k3"])


def test_bm25_ways_agree(spark):
    d = spark.createDataFrame([(0, "parse url path"), (1, "parse parse tree"), (2, ""), (3, None), (4, "other words")], "idx long, doc string")
    a = lexical.search_few(d, ["parse", "url", "parse"], 10).collect()
    q = spark.createDataFrame([(0, "parse url parse")], "query_id int, query string")
    b = lexical.build(d).search(q, 10).orderBy("rank").collect()
    assert [(r.idx, round(r.score, 9)) for r in a] == [(r.idx, round(r.score, 9)) for r in b] and {r.idx for r in a} == {0, 1}


def test_overloads_and_ranges(spark):
    rows = [(0, "a.cs", "Read", "method", 3), (1, "a.cs", "Read", "method", 8), (2, "a.cs", "Read", "method", 13), (3, "a.cs", "Read", "method", 8), (4, "a.cs", "X", "class", 1)]
    d = spark.createDataFrame(rows, "ord int, path string, label string, kind string, start_line int")
    got = ingest.dedupe_keys(d)
    assert {r.ord for r in got.collect()} == {0, 1, 2, 4} and got.select("node_key").distinct().count() == 4
    idx = ingest.with_idx(d.withColumn("n", F.col("ord")), ["path", "ord"]).orderBy("ord").collect()
    assert [r.idx for r in idx] == [0, 1, 2, 3, 4]
    spans = spark.createDataFrame([("a.cs", "Read", "S.Read", "method", 3, 4, "", ""), ("a.cs", "Read", "S.Read", "method", 8, 11, "", "")], "path string, name string, qualified string, kind string, start_line int, end_line int, signature string, docstring string")
    n = spark.createDataFrame([("x", "Read", "a.cs", 9), ("y", ".Read()", "a.cs", 3), ("z", "S.Read", "a.cs", 99)], "id string, label string, source_file string, line int")
    assert {r.id: (r.start_line, r.end_line) for r in ingest.match_spans(n, spans).collect()} == {"x": (8, 11), "y": (3, 4), "z": (3, 4)}


def test_communities_are_named_by_folders():
    files = [f"web/{x}.ts" for x in "abc"] + ["app/a.py", "app/b.py", "top.py"]
    got = build.name_communities({f"web/{x}.ts": 1 for x in "abc"}, files)
    assert got["web/a.ts"] == (0, "web") and got["app/a.py"] == got["app/b.py"] == (1, "app") and got["top.py"][1] == "(root)"


def test_time_split_and_items(spark):
    c = spark.createDataFrame([(f"c{i}", i, "f") for i in range(100)], "sha string, ts long, path string")
    assert evaluation.time_split(c, 0.8).first()["ts"] == 80 - (int(100 * (1 - 0.8)) == 20)
    with pytest.raises(ValueError):
        evaluation.time_split(c.limit(10))
    rows = [("a", 10, "fix the parser", "more", "x.py"), ("b", 10, "bump version to 2", "", "x.py"), ("c", 10, "short", "", "x.py"), ("d", 1, "fix the parser", "", "x.py"), ("e", 10, "remove the old file", "", "gone.py"), ("f", 10, "a change of a lock file", "", "uv.lock")]
    d = spark.createDataFrame(rows, "sha string, ts long, subject string, body string, path string")
    got = evaluation.eval_set(d, spark.createDataFrame([("x.py",), ("uv.lock",)], "path string"), 5).collect()
    assert [(r.sha, r.query, r.files) for r in got] == [("a", "fix the parser. more", ["x.py"])]


def test_scores_and_bootstrap(spark):
    hits = spark.createDataFrame([("q", 1, "a"), ("q", 2, "a"), ("q", 3, "b"), ("q", 4, "c")], "query_id string, rank int, source_file string")
    truth = spark.createDataFrame([("q", "b"), ("q", "z"), ("r", "a")], "query_id string, path string")
    got = {r.query_id: r for r in evaluation.scores(evaluation.hits_to_files(hits), truth).collect()}
    assert got["q"].recall_1 == 0 and got["q"].recall_5 == 0.5 and got["q"].rr == 0.5 and got["r"].rr == 0
    d, lo, hi = evaluation.bootstrap([0.0] * 50, [1.0] * 50)
    assert d == lo == hi == 1.0 and evaluation.verdict(lo, hi) == "significant"
    r = evaluation.paired_bootstrap(spark.range(400).select(F.col("id").alias("key"), (F.col("id") % 3).cast("double").alias("diff")), 300).first()
    assert r.lo < r.delta < r.hi and r.hi - r.lo < 0.3


def test_member_hashes_and_overview(spark):
    n = spark.createDataFrame([(i, f"k{i}", "h", i % 2) for i in range(5)], "idx long, node_key string, content_hash string, community long")
    m = {r.community: r for r in reports.member_hashes(n).collect()}
    s = spark.createDataFrame([(0, "zero", m[0].member_hash, "s0"), (1, "one", "stale", "s1")], "community long, name string, member_hash string, summary string")
    assert [r.name for r in reports.overview(n, s).collect()] == ["zero"] and reports.overview(n, s, 0).count() == 0


def test_streamed_counts_equal_the_batch(spark, tmp_path):
    rng = [(f"c{i}", 1700000000 + i, "a", f"f{(i * j) % 5}") for i in range(40) for j in range(3)]
    d = spark.createDataFrame(rng, cochange.SCHEMA)
    for part in range(4):
        d.where(F.pmod(F.xxhash64("sha"), F.lit(4)) == part).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(cochange.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    cochange.start(stream, str(tmp_path / "out"), str(tmp_path / "check"), 1700000000.0).awaitTermination()
    key = lambda r: (r.path_a, r.path_b, r.n_ab, round(r.support, 9), r.n_a, r.n_b, round(r.g_stat, 9))
    assert sorted(map(key, cochange.pairs(spark, str(tmp_path / "out")).collect())) == sorted(map(key, temporal.cochange_pairs(temporal.touches(d)).collect()))
    was = {r.path: r.churn for r in cochange.churn(spark, str(tmp_path / "out"), 1700000000.0, 1700000000.0 + 90 * 86400).collect()}
    now = {r.path: r.churn for r in temporal.churn(temporal.touches(d), 1700000000.0 + 90 * 86400).collect()}
    assert {k: round(v, 9) for k, v in was.items()} == {k: round(v, 9) for k, v in now.items()}


def test_a_change_far_down_in_a_body_is_seen(spark):
    """Bodies were told by their first 200 lines."""
    text = "\n".join(["def f():", *(f"    x{i}" for i in range(900)), "def g():", "    pass"])
    other = text.replace("x850", "y850")
    names = "path string, name string, qualified string, kind string, start_line int, end_line int, signature string, docstring string"
    raw = spark.createDataFrame([(f"{p}{k}", k, "code", None if k != "p.py" else "file", p, f"L{n}") for p in ("a/p.py", "b/p.py") for k, n in (("p.py", 1), ("f", 1), ("g", 902), ("gone", 5000))], "id string, label string, file_type string, kind string, source_file string, source_location string")
    spans = spark.createDataFrame([(p, k, k, "function", a, b, "", "") for p in ("a/p.py", "b/p.py") for k, a, b in (("f", 1, 901), ("g", 902, 903))], names)
    files = spark.createDataFrame([("a/p.py", text), ("b/p.py", other)], "path string, text string")
    got = {(r.source_file[0], r.label): r for r in build.node_table(raw, files, spans).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()[:32]
    for k, t in (("a", text), ("b", other)):
        lines = t.split("\n")
        assert got[k, "p.py"].content_hash == sha(t) and got[k, "f"].content_hash == sha("\n".join(lines[:901])) and got[k, "g"].content_hash == sha("\n".join(lines[901:]))
        assert got[k, "gone"].content_hash == sha(f"{k}/p.py:gone")
    assert got["a", "f"].content_hash != got["b", "f"].content_hash
