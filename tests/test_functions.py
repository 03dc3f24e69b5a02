import math

import pytest
from pyspark.sql import functions as F

from gneiss.functions import identity, stats, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name,words",
    [("parseURLPath", ["parse", "url", "path"]), ("HTTPServer", ["http", "server"]), ("MAX_RETRY_COUNT", ["max", "retry", "count"]), ("_pick_seeds", ["pick", "seeds"]), ("get_user", ["user"]), ("", []), (None, []), ("a.b-c:d", []), ("readFile_readFile", ["read", "file"])],
)
def test_split_identifier(spark, name, words):
    assert one(spark, text.split_identifier(F.lit(name).cast("string"))) == words


def test_stop_words_are_kept_on_request(spark):
    assert one(spark, text.split_identifier(F.lit("get_user"), keep_stop=True)) == ["get", "user"]


def test_path_terms(spark):
    assert one(spark, text.path_terms(F.lit("./src/authFlow\\TokenStore.test.ts"))) == ["src", "auth", "flow", "token", "store", "test"]


def test_tokenize(spark):
    got = one(spark, text.tokenize(F.lit("parseURLPath v2 über")))
    assert got == ["parseurlpath", "parse", "url", "path", "v", "2", "über"] or set(got) >= {"parseurlpath", "parse", "url", "path", "2", "über"}
    assert one(spark, text.tokenize(F.lit("漢字仮名"))) == ["漢字仮名", "漢字", "字仮", "仮名"]
    assert one(spark, text.tokenize(F.lit(None).cast("string"))) == []


def test_node_text_prefers_the_docstring(spark):
    full = text.node_text(F.lit("loadUser()"), F.lit("function"), F.lit("app/auth.py"), F.lit("def loadUser(id)"), F.lit("Loads."), F.array(F.lit("saveUser"), F.lit("getUser")), F.lit("body here"))
    assert one(spark, full) == "loadUser\nload user\nfunction\napp auth\ndef loadUser(id)\nLoads.\nsave user"
    bare = text.node_text(F.lit("x1"), body=F.lit("  a\n\n b "))
    assert one(spark, bare) == "x1\na b"


@pytest.mark.parametrize("path,noise", [("src/x.py", False), ("uv.lock", True), ("a/CHANGELOG.md", True), ("package-lock.json", True), ("a/app.min.js", True), ("x_pb2.py", True), ("a.generated.ts", True), ("lock.py", False)])
def test_noise(spark, path, noise):
    assert one(spark, text.is_noise(F.lit(path))) is noise


@pytest.mark.parametrize("path,test", [("tests/a.py", True), ("src/test_a.py", True), ("a_test.go", True), ("b.spec.ts", True), ("src/contest.py", False), (None, False)])
def test_test_paths(spark, path, test):
    assert one(spark, text.is_test_path(F.lit(path).cast("string"))) is test


@pytest.mark.parametrize("counts,check", [((10, 100, 100, 1000), lambda g, p: abs(g) < 1e-9 and p > 0.9), ((40, 50, 50, 1000), lambda g, p: g > 50 and p < 1e-6), ((1, 100, 100, 1000), lambda g, p: (g, p) == (0, 1)), ((0, 0, 0, 0), lambda g, p: (g, p) == (0, 1)), ((5, 3, 5, 10), lambda g, p: g >= 0)])
def test_g_statistic(spark, counts, check):
    d = spark.createDataFrame([counts], "ab int, a int, b int, n int")
    g = stats.g_statistic(*(F.col(c) for c in ("ab", "a", "b", "n")))
    r = d.select(g.alias("g")).select("g", stats.p_value(F.col("g")).alias("p")).first()
    assert check(r["g"] or 0.0, r["p"])


def test_p_of_the_threshold(spark):
    assert abs(one(spark, stats.p_value(F.lit(stats.CHI2_01))) - 0.01) < 1e-12
    assert abs(one(spark, stats.decayed(F.lit(0.0) + 1000, 1000 + 90 * 86400)) - 0.5) < 1e-12


def test_keys_keep_part_bounds(spark):
    k = lambda *p: one(spark, identity.node_key(*(F.lit(x) for x in p)))
    assert k("f", "a", "function") == k("f", "a", "function")
    assert len({k("f", "a", "function"), k("g", "a", "function"), k("f", "a", "class"), k("f", "ab", "c"), k("fa", "b", "c"), k("f", "a", "function", 3)}) == 6
    assert identity.blake_key("ab", "c") != identity.blake_key("a", "bc")


def test_slices_say_what_they_leave_out(spark):
    lines = F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: i.cast("string"))
    got = one(spark, text.line_slice(lines, F.lit(2), F.lit(49))).split("\n")
    assert got[0] == "2" and len(got) == 41 and "8 more lines" in got[-1]
    assert one(spark, text.line_slice(lines, F.lit(50), F.lit(99))) == "50"
    assert one(spark, text.estimate_tokens(F.lit("x" * 32))) == math.floor(32 / 3.2) + 1
