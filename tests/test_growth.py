"""Steps that grow with their input alone, and whose results don't depend on how rows are dealt out."""

import random

from pyspark.sql import Window, functions as F

from gneiss.operators import ingest


def test_numbers_have_no_gaps_where_ranges_are_merged(spark):
    """Counts and ranks once took ranges of their own, which Spark merged by the widths of their rows."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        d = spark.range(40_000).select(F.xxhash64("id").alias("k"), F.concat_ws("", *(F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))), 512) for i in range(4))).alias("wide"))
        got = ingest.with_idx(d, ["k"]).select("k", "idx", "wide").orderBy("k").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    assert [r.idx for r in got] == list(range(40_000))


def plain_match(nodes, spans):
    """What match_spans says, by all pairs."""
    def best(label, path, line):
        found = []
        for s in spans:
            if s[0] != path or label not in (s[1], s[2], s[2].split(".")[-1]):
                continue
            holds = label in (s[1], s[2]) and line is not None and s[4] <= line <= s[5]
            tier = 0 if holds else 1 if label == s[1] else 2 if label == s[2] else 3
            found.append((tier, holds and s[4] != line, s[5] - s[4] if holds else 0, s[4], s[5]))
        return min(found)[3:] if found else (None, None)

    return {n[0]: best(n[1], n[2], n[3]) for n in nodes}


def test_spans_are_matched_as_by_all_pairs(spark):
    draw = random.Random(3)
    spans = []
    for i in range(300):
        a, name = draw.randint(1, 200), draw.choice(["a", "b", "c"])
        spans.append((draw.choice(["p", "q"]), name, draw.choice([name, f"K.{name}", "K.d"]), f"k{i}", a, a + draw.choice([0, 1, 2, 7, 30, 150])))
    nodes = [(str(i), draw.choice(["a", "b", "c", "d", "K.a", "K.d", "none"]), draw.choice(["p", "q", "r"]), draw.choice([None, draw.randint(1, 350)])) for i in range(400)]
    s = spark.createDataFrame([(*x, "", "") for x in spans], "path string, name string, qualified string, kind string, start_line int, end_line int, signature string, docstring string")
    n = spark.createDataFrame(nodes, "id string, label string, source_file string, line int")
    got = {r.id: (r.start_line, r.end_line) for r in ingest.match_spans(n, s).collect()}
    assert got == plain_match(nodes, spans)


def test_a_name_that_a_file_repeats_is_no_product(spark):
    """Each of 3,000 methods of one name meets its own span, not all: no join gives more rows than a few for each node."""
    s = spark.range(3000).select(F.lit("p").alias("path"), F.lit("f").alias("name"), F.concat(F.lit("K"), "id", F.lit(".f")).alias("qualified"), F.lit("method").alias("kind"), (F.col("id") * 10 + 4).cast("int").alias("start_line"), (F.col("id") * 10 + 6).cast("int").alias("end_line"), F.lit("").alias("signature"), F.lit("").alias("docstring"))
    n = s.select(F.col("qualified").alias("id"), F.col("name").alias("label"), F.col("path").alias("source_file"), F.col("start_line").alias("line"))
    m = ingest.match_spans(n, s)
    assert m.where("start_line = line").count() == 3000
    m.collect()
    rows = [int(node.metrics().apply("numOutputRows").value()) for node in _nodes(m) if node.metrics().contains("numOutputRows")]
    assert max(rows) <= 20_000


def _nodes(df):
    """The physical nodes of a plan that ran."""
    def below(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from below(node.executedPlan())
            return
        if name.endswith("QueryStageExec"):
            yield from below(node.plan())
            return
        yield node
        for i in range(node.children().size()):
            yield from below(node.children().apply(i))

    return list(below(df._jdf.queryExecution().executedPlan()))


def test_the_whole_map_is_laid_out(spark):
    """Nodes beyond the exported map's bound have places too, as a plain count within their group gives them."""
    from gneiss.operators import mapview

    n = spark.range(300_000).select((F.col("id") * 3).alias("idx"), F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 3).cast("long").alias("community"), F.lit("x").alias("label"), F.lit("s").alias("kind"), F.lit("y").alias("source_file"))
    e = spark.range(1000).select((F.col("id") * 3).alias("src"), (F.col("id") * 6 + 3).alias("dst")).where("src <> dst")
    assert mapview.symbols(n, e, None).count() == 300_000
    placed = mapview.layout(n.select("idx", F.col("community").alias("group"), F.lit(0).alias("degree")))
    w = Window.partitionBy("community").orderBy("idx")
    plain = n.withColumn("j", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("community")))
    own = mapview.RADIUS * F.sqrt(F.col("n") / 300_000) / 2 * F.sqrt((F.col("j") + 0.5) / F.col("n"))
    middle = plain.where("community = -1").select("idx", (own * F.cos(F.col("j") * mapview.GOLDEN)).alias("want"))  # the largest group lies at the centre
    assert middle.join(placed, "idx").where("abs(want - x) < 1e-6").count() == 150_000


def test_a_group_as_truth_scores_as_its_pairs_do(spark):
    from gneiss.operators import evaluation

    m = spark.range(200).select(F.col("id").alias("path"), F.when(F.col("id") % 7 != 0, F.col("id") % 3).alias("group"))
    asked = m.where("path % 10 = 0").select(F.col("path").alias("query_id"), "group")
    files = asked.select("query_id").crossJoin(spark.range(30).toDF("r")).select("query_id", ((F.col("query_id") + F.col("r") * 7) % 200).alias("path"), (F.col("r") + 1).alias("rank"))
    got = evaluation.group_scores(files, asked, m)
    assert sorted(got.collect()) == sorted(evaluation.scores(files, asked.join(m, "group").select("query_id", "path")).collect())
    big = spark.range(40_000).select(F.col("id").alias("path"), F.lit(1).alias("group"))
    few = evaluation.group_scores(files, big.where("path % 100 = 0").select(F.col("path").alias("query_id"), "group"), big)
    few.collect()
    rows = [int(node.metrics().apply("numOutputRows").value()) for node in _nodes(few) if node.metrics().contains("numOutputRows")]
    assert max(rows) <= 100_000  # 400 queries with 40,000 members each


def test_postings_are_counted_without_a_shuffle(spark):
    """The counts are those of a grouping, and the stage that makes them moves no row."""
    from gneiss.functions import text
    from gneiss.operators import lexical

    docs = spark.createDataFrame([(0, "b a b fooBar naïve 12"), (1, None), (2, ""), (3, "..."), (4, "a a a"), (9000, "中文字 b")], "idx long, doc string")
    before = _shuffled(spark)
    postings = lexical.build(docs).postings
    assert _shuffled(spark) == before
    want = docs.select("idx", F.explode(text.tokenize("doc")).alias("term")).groupBy("idx", "term").agg(F.count("*").alias("tf"))
    size = want.groupBy("idx").agg(F.sum("tf").cast("double").alias("dl"))
    assert sorted(postings.select("term", "block", "idx", "tf", "dl").collect()) == sorted(want.join(size, "idx").select("term", F.floor(F.col("idx") / lexical.BLOCK).alias("block"), "idx", "tf", "dl").collect())


def _shuffled(spark):
    """Bytes that stages have written to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_a_library_that_is_not_searched_has_no_postings(spark):
    from gneiss.registry_index import _library

    e = _library(spark, "/root/testdata/sf0.001", search=False)
    assert "nodes" in e and "docs" in e and "cochange" in e
    assert "postings" not in e and "vectors" not in e


def test_a_search_moves_only_what_it_reaches(spark, tmp_path):
    """Edges were made distinct and shuffled with each level, though the search meets five nodes."""
    from gneiss.operators import graph

    far = spark.range(400_000).select((F.col("id") * 7919 % 400_009 + 100).alias("src"), (F.col("id") + 100).alias("dst"))
    far.unionByName(spark.createDataFrame([(1, 2), (1, 2), (2, 3), (1, 4), (4, 3), (3, 5), (5, 1)], "src long, dst long")).write.parquet(f"{tmp_path}/e")
    e, before = spark.read.parquet(f"{tmp_path}/e"), _shuffled(spark)
    got = graph.bfs(e, spark.createDataFrame([(1,)], "idx long")).collect()
    assert _shuffled(spark) - before < 300_000
    assert sorted((r.idx, r.dist, r.parent) for r in got) == [(1, 0, None), (2, 1, 1), (3, 2, 2), (4, 1, 1), (5, 3, 3)]


def test_page_rank_moves_only_what_the_seeds_reach(spark, tmp_path):
    """All edges were normalised and dealt out, though no mass comes near them."""
    from gneiss.operators import graph

    near = spark.createDataFrame([(1, 2, 1.0), (2, 1, 2.0), (2, 3, 2.0), (3, 4, 1.0)], "src long, dst long, weight double")
    far = spark.range(400_000).select((F.col("id") * 7919 % 400_009 + 100).alias("src"), (F.col("id") + 100).alias("dst"), F.lit(1.0).alias("weight"))
    far.unionByName(near).write.parquet(f"{tmp_path}/e")
    seeds = spark.createDataFrame([(1, 1.0), (9, 1.0)], "idx long, score double")
    want = {r.idx: r.score for r in graph.ppr(near, seeds, iterations=7).collect()}
    before = _shuffled(spark)
    got = {r.idx: r.score for r in graph.ppr(spark.read.parquet(f"{tmp_path}/e"), seeds, iterations=7).collect()}
    assert _shuffled(spark) - before < 300_000
    assert got.keys() == want.keys() == {1, 2, 3, 4, 9} and all(abs(got[k] - want[k]) < 1e-12 for k in got) and abs(sum(got.values()) - 1) < 1e-12


def test_cycles_are_trimmed_without_moving_all_edges(spark, tmp_path):
    """Each trim joined and stored all edges anew: a chain of eight nodes that hang on a large cycle took eight rounds of it."""
    from gneiss.operators import graph

    n = 200_000
    chain = spark.createDataFrame([(n + i, n + i + 1) for i in range(8)] + [(n + 8, 0), (n + 20, n + 21), (n + 21, n + 20), (n + 21, n + 22)], "src long, dst long")
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    both = ring.unionByName(ring.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(chain)
    both.write.parquet(f"{tmp_path}/e")
    e = spark.read.parquet(f"{tmp_path}/e")
    before = _shuffled(spark)
    kept = graph.trimmed(e)
    assert kept.count() == 2 * n + 2 and kept.where(f"src >= {n}").count() == 2
    assert _shuffled(spark) - before < 40_000_000


def _workers(spark, action):
    """The largest number that `action` gives in a Python worker, of several tasks."""
    def run(parts):
        import time

        import pandas as pd

        for _ in parts:
            pass
        time.sleep(0.5)  # so that each task has a worker of its own
        yield pd.DataFrame({"n": [action()]})

    return max(r.n for r in spark.range(0, 4, 1, 4).mapInPandas(run, "n long").collect())


def test_equal_products_are_not_all_held(spark):
    """2,500 equal rows of a task met 2,000 queries in five million products that were held together."""
    from gneiss.operators import dense

    def peak():
        return next(int(line.split()[1]) // 1024 for line in open("/proc/self/status") if line.startswith("VmHWM"))

    def start():
        with open("/proc/self/clear_refs", "w") as f:
            f.write("5")
        return peak()

    rows = spark.range(0, 10_000, 1, 4).select(F.col("id").alias("idx"), F.array(F.lit(0.6), F.lit(0.8)).alias("embedding"))
    asked = rows.where("idx % 5 = 0").select(F.col("idx").alias("query_id"), F.col("embedding").alias("query_vec"))
    before = _workers(spark, start)
    found = dense.search(rows, asked, 3).groupBy("idx").count().collect()
    assert _workers(spark, peak) - before < 120
    assert {r.idx: r["count"] for r in found} == {0: 2000, 1: 2000, 2: 2000}


def test_pairs_of_a_commit_meet_where_its_files_lie(spark):
    """Touches were dealt out by all their columns, and again by commit for sizes and both sides of the pairs."""
    from gneiss.operators import temporal

    c = spark.range(60_000).select((F.col("id") % 20_000).alias("sha"), F.lit(1).cast("long").alias("ts"), F.lit("a").alias("author"), F.concat(F.lit("s"), F.col("id") % 7).alias("path"))
    before = _shuffled(spark)
    got = temporal.pair_counts(temporal.touches(c)).collect()
    moved = _shuffled(spark) - before
    assert sum(r.n for r in got) == 60_000 and all(r.size == 3 and r.path_a < r.path_b for r in got)
    once = _shuffled(spark)
    temporal.touches(c).write.format("noop").mode("overwrite").save()
    assert moved < 1.5 * (_shuffled(spark) - once)


def test_page_rank_leaves_no_shuffles_and_moves_a_sum_for_each_bucket_and_node(spark):
    """Partial sums grew with the partitions of shuffles, and their files stayed, with those of the edges, until the driver collected garbage."""
    from gneiss.operators import graph

    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))

    e = spark.range(60_000).select((F.xxhash64("id") % 300).alias("src"), (F.xxhash64("id", F.lit(1)) % 300).alias("dst"), F.lit(1.0).alias("weight"))
    seeds = spark.createDataFrame([(1, 1.0), (2, 3.0)], "idx long, score double")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    try:
        before, disk = _shuffled(spark), held()
        got = graph.ppr(e, seeds, iterations=10)
        moved, left = _shuffled(spark) - before, held() - disk
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert got.count() == 599 and left < 100_000
    assert moved < 2_500_000


def test_page_rank_of_edges_that_repeat_and_count_both_ways(spark, monkeypatch):
    from gneiss.operators import graph

    e = spark.range(3000).select((F.xxhash64("id") % 40).alias("src"), (F.xxhash64("id", F.lit(1)) % 50).alias("dst"), (F.col("id") % 3 + 1).cast("double").alias("weight"))
    seeds = spark.createDataFrame([(1, 1.0), (2, 3.0), (9999, 1.0)], "idx long, score double")
    want = {r.idx: r.score for r in graph.ppr(graph.symmetric_weights(e), seeds, iterations=5).collect()}
    monkeypatch.setattr(graph, "FEW", 10)  # edges are dealt out to the nodes
    for hub in (10**6, 50):
        got = {r.idx: r.score for r in graph.ppr(e, seeds, iterations=5, symmetric=True, hub=hub).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got) and abs(sum(got.values()) - 1) < 1e-12
