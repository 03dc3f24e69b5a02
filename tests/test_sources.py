import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from gneiss.operators import ingest
from gneiss.sources import history, imports, nodelink, spans, tree


def write(root, files):
    for name, content in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content, encoding="utf-8")


MINI = {
    "app/auth.py": "from app.db import connect\n\n\nclass Session:\n    \"\"\"A login.\"\"\"\n\n    @property\n    def refresh(self):\n        return connect()\n",
    "app/db.py": "import os\n\n\n# opens the store\ndef connect():\n    return os\n",
    "web/api.ts": "import { f } from './util'\nexport function call(x: number) {\n  return f(x)\n}\n",
    "web/util.ts": "export const f = (x) => {\n  return x\n}\n",
    "web/components/button.tsx": "import { f } from '../util'\nexport class Button {\n  draw() { return f(1) }\n}\n",
    "README.md": "# Title\n\ntext\n",
    "node_modules/junk.js": "function no() {}\n",
    ".hidden/x.py": "x = 1\n",
}


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    write(root, MINI)
    return root


def test_scan_leaves_out_what_is_skipped(spark, repo):
    os.symlink("/etc/hostname", repo / "out.md")
    got = {r.path: r for r in tree.scan(spark, str(repo)).collect()}
    assert set(got) == {"app/auth.py", "app/db.py", "web/api.ts", "web/util.ts", "web/components/button.tsx", "README.md"}
    assert got["README.md"].is_doc and got["web/api.ts"].language == "typescript"
    assert tree.contained(repo, "out.md") is None and tree.contained(repo, "../x") is None and tree.contained(repo, "app/db.py")
    assert tree.read_lines(repo, "out.md") == [] and tree.read_lines(repo, "README.md")[0] == "# Title"


def test_lines_are_numbered(spark):
    d = spark.createDataFrame([("a", "x\r\ny\rz\n"), ("b", "")], "path string, text string")
    assert [(r.path, r.line, r.text) for r in tree.lines(d).orderBy("path", "line").collect()] == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z")]


def test_python_spans():
    s = spans.extract(MINI["app/auth.py"], "python")
    assert [(x.name, x.kind, x.start, x.end, x.parent) for x in s] == [("Session", "class", 4, 9, None), ("refresh", "method", 7, 9, "Session")]
    assert s[0].docstring == "A login." and spans.extract(MINI["app/db.py"], "python")[0].docstring == "opens the store"
    assert spans.extract("def (", "python") == []


@pytest.mark.parametrize(
    "language,code,want",
    [
        ("typescript", MINI["web/api.ts"], [("call", "function", 2, 4)]),
        ("typescript", MINI["web/util.ts"], [("f", "function", 1, 3)]),
        ("typescript", MINI["web/components/button.tsx"], [("Button", "class", 2, 4), ("draw", "method", 3, 3)]),
        ("go", "package a\n\nfunc (s *S) Get(k string) int {\n\treturn 1 // }\n}\n\ntype S struct {\n}\n", [("Get", "method", 3, 5), ("S", "type", 7, 8)]),
        ("rust", "pub struct A {\n  x: i32,\n}\nimpl A {\n  pub fn new() -> A { A { x: 1 } }\n}\n", [("A", "struct", 1, 3), ("A", "impl", 4, 6), ("new", "method", 5, 5)]),
        ("java", "class A {\n  int f(int x) {\n    if (x > 0) { return 1; }\n    return 2;\n  }\n}\n", [("A", "class", 1, 6), ("f", "method", 2, 5)]),
        ("c", "int add(int a, int b)\n{\n  return a + b; /* } */\n}\nint later(int);\n", [("add", "function", 1, 4)]),
        ("typescript", "export class Q<T extends Map<string, number>> {\n  async run<K>(\n    a: (x: number) => void,\n    b = f(1, 2),\n  ): Promise<K> {\n    if (a) { return b }\n    call(a) \n  }\n}\n\nexport const g = async (\n  a: string,\n) => {\n  return a\n}\n\ntype P = { a: string }\nenum E { A, B }\n", [("Q", "class", 1, 9), ("run", "method", 2, 8), ("g", "function", 11, 15), ("P", "type", 17, 17), ("E", "enum", 18, 18)]),
        ("java", "class A {\n  A(int x) {\n    this.x = x;\n  }\n\n  @Override\n  public <T> Map<String,\n      List<T>> f(\n      int a,\n      T[] b) throws X, Y {\n    return g(a);\n  }\n  abstract int h(int a);\n}\nrecord R(int a, String b) {}\n", [("A", "class", 1, 14), ("f", "method", 7, 12), ("R", "record", 15, 15)]),
        ("cpp", "template <class T>\nclass V : public W<T> {\n  int f(int a) const {\n    return a;\n  }\n};\nnamespace n {\nstd::vector<int> make(\n    int a,\n    std::map<int, int> b) {\n  return {};\n}\n}\n", [("V", "class", 1, 6), ("f", "method", 3, 5), ("n", "namespace", 7, 13), ("make", "method", 8, 12)]),
        ("rust", "pub trait T {\n  fn a(&self);\n}\nimpl<'a, T: Clone> From<Vec<T>> for B<'a> {\n  pub async fn b<F>(f: F) -> Result<(), E>\n  where\n    F: Fn(i32) -> i32,\n  {\n    Ok(())\n  }\n}\npub struct U(i32);\n", [("T", "trait", 1, 3), ("B", "impl", 4, 11), ("b", "method", 5, 10), ("U", "struct", 12, 12)]),
        ("javascript", "function a(x) {\n  return 1\n}\nfunction* g() {\n}\nasync function h() {\n}\nif (x) {\n}\nclass Z {\n  get q() { return 1 }\n}\n", [("a", "function", 1, 3), ("g", "function", 4, 5), ("h", "function", 6, 7), ("Z", "class", 10, 12), ("q", "method", 11, 11)]),
        ("scala", "class A(x: Int) extends B {\n  def f(a: Int): Int = {\n    a\n  }\n  def g = 1\n}\ncase class C(a: Int)\nobject D {\n}\n", [("A", "class", 1, 6), ("f", "method", 2, 4), ("g", "method", 5, 5), ("C", "class", 7, 7), ("D", "object", 8, 9)]),
        ("swift", "protocol P {\n}\nextension S {\n  func f<T>(a: T,\n    b: (Int) -> Int) -> [T] {\n    return []\n  }\n}\n", [("P", "protocol", 1, 2), ("S", "class", 3, 8), ("f", "method", 4, 7)]),
        ("kotlin", "data class P(val a: Int)\n\nfun <T> String.ext(\n  a: T,\n): List<T> {\n  return listOf(a)\n}\n", [("P", "class", 1, 1), ("ext", "function", 3, 7)]),
        ("go", "type Num interface {\n\tint\n}\n\nfunc Map[T, U any](\n\txs []T,\n\tf func(T) U,\n) []U {\n\treturn nil\n}\n", [("Num", "type", 1, 3), ("Map", "function", 5, 10)]),
        ("php", "<?php\nclass A {\n  public function b(array $x = []): ?string\n  {\n    return null;\n  }\n}\n", [("A", "class", 2, 7), ("b", "method", 3, 6)]),
        ("bash", "function a {\n  echo 1\n}\nb() {\n  echo 2 # }\n}\n", [("a", "function", 1, 3), ("b", "function", 4, 6)]),
        ("ruby", "class A\n  def f\n    1\n  end\nend\n", [("A", "class", 1, 5), ("f", "method", 2, 4)]),
        ("c_sharp", "class S {\n  int Read(int a) {\n    return a;\n  }\n\n  int Read(string a) {\n    return 1;\n  }\n\n  int Read() {\n    return 0;\n  }\n}\n", [("S", "class", 1, 13), ("Read", "method", 2, 4), ("Read", "method", 6, 8), ("Read", "method", 10, 12)]),
    ],
)
def test_braced_spans(language, code, want):
    assert [(s.name, s.kind, s.start, s.end) for s in spans.extract(code, language)] == want


class Node:
    """A stand-in for a grammar's node."""

    def __init__(self, kind, start, end, children=(), **fields):
        self.type, self.start_byte, self.end_byte, self.children, self.fields = kind, start, end, list(children), fields

    def child_by_field_name(self, name):
        return self.fields.get(name)

    @property
    def start_point(self):
        return (Node.text.count("\n", 0, self.start_byte), 0)

    @property
    def end_point(self):
        return (Node.text.count("\n", 0, self.end_byte), 0)


def test_definitions_by_a_grammar(monkeypatch):
    """A decorated function with a docstring in a class, and a declarator chain, as a grammar would give them."""
    text = Node.text = 'class A:\n    @cached\n    def f(self):\n        "Says\n        f."\n        return 1\n'
    at = lambda s: (text.index(s), text.index(s) + len(s))
    doc = Node("expression_statement", *at('"Says\n        f."'), [Node("string", *at('"Says\n        f."'))])
    body = Node("block", text.index('"Says'), len(text) - 1, [doc])
    inner = Node("function_definition", text.index("def"), len(text) - 1, [body], name=Node("identifier", text.index("f(self"), text.index("f(self") + 1), body=body)
    wrapped = Node("decorated_definition", text.index("@cached"), len(text) - 1, [Node("decorator", *at("@cached")), inner])
    held = Node("block", text.index("@cached"), len(text) - 1, [wrapped])
    root = Node("module", 0, len(text), [Node("class_definition", 0, len(text) - 1, [held], name=Node("identifier", 6, 7), body=held)])
    parser = type("P", (), {"parse": lambda self, data: type("T", (), {"root_node": root})()})()
    monkeypatch.setattr(spans, "grammar", lambda language: parser)
    got = [(s.name, s.kind, s.start, s.end, s.signature, s.docstring, s.parent) for s in spans.extract(text, "python")]
    assert got == [("A", "class", 1, 6, "class A:", "", None), ("f", "method", 2, 6, "def f(self):", "Says f.", "A")]
    Node.text = "int *g(void) { }"
    chain = Node("pointer_declarator", 4, 11, declarator=Node("function_declarator", 5, 11, declarator=Node("identifier", 5, 6)))
    root.children = [Node("function_definition", 0, 16, declarator=chain, body=Node("compound_statement", 12, 16))]
    assert [(s.name, s.kind, s.signature) for s in spans.extract(Node.text, "c")] == [("g", "function", "int *g(void)")]


def test_nested_functions_have_no_parent():
    got = {s.name: s for s in spans.extract("def a():\n    def b():\n        pass\n    return b\n", "python")}
    assert got["b"].parent is None and got["b"].kind == "function"


def test_parents_are_qualified_by_the_tightest_container():
    S = spans.Span
    got = {s.name: s for s in spans.assign_parents([S("Outer", "class", 1, 100), S("Inner", "class", 10, 50), S("meth", "function", 20, 25), S("far", "function", 700, 710)])}
    assert got["meth"].parent == "Outer.Inner" and got["meth"].kind == "method" and got["Inner"].parent == "Outer" and got["far"].parent is None


@pytest.mark.parametrize("spec,importer,files,want", [("./util", "web/api.ts", ["web/util.ts"], "web/util.ts"), ("../util", "web/components/b.tsx", ["web/util.ts"], "web/util.ts"), ("./util", "a.ts", ["util/index.ts"], "util/index.ts"), ("react", "a.ts", ["react.ts"], None), ("../../x", "web/a.ts", ["x.ts"], None), ("./a.js", "b.ts", ["a.js", "a.js.ts"], "a.js")])
def test_script_imports(spec, importer, files, want):
    assert next((c for c in imports.script_candidates(spec, importer) if c in files), None) == want


@pytest.mark.parametrize("module,importer,files,want", [("app.db", "main.py", ["app/db.py"], "app/db.py"), (".db", "app/auth.py", ["app/db.py", "db.py"], "app/db.py"), ("..db", "app/x/a.py", ["app/db.py"], "app/db.py"), ("app.db.connect", "m.py", ["app/db.py"], "app/db.py"), ("pkg", "m.py", ["pkg/__init__.py"], "pkg/__init__.py"), ("db", "app/auth.py", ["app/db.py"], "app/db.py"), ("os", "m.py", ["x.py"], None)])
def test_python_imports(module, importer, files, want):
    assert next((c for c in imports.python_candidates(module, importer) if c in files), None) == want


def test_import_edges(spark, repo):
    got = {(r.importer, r.target) for r in imports.import_edges(tree.scan(spark, str(repo))).collect()}
    assert got == {("app/auth.py", "app/db.py"), ("web/api.ts", "web/util.ts"), ("web/components/button.tsx", "web/util.ts")}


def test_graph_files(spark, tmp_path):
    f = tmp_path / "g.json"
    node = {"id": "a", "label": "a", "file_type": "code", "source_file": "a.py", "source_location": "L1"}
    f.write_text(json.dumps({"nodes": [node], "links": [], "edges": [{"source": "a", "target": "ghost"}, {"source": "a", "target": "a"}]}))
    nodes, links = nodelink.load(spark, str(f))
    ids = nodes.select("id", F.lit(0).cast("long").alias("idx"))
    assert links.count() == 2 and ingest.ingest_edges(links, ids).count() == 0
    f.write_text(json.dumps({"something": "else"}))
    with pytest.raises(nodelink.GraphFormatError):
        nodelink.load(spark, str(f))


def test_edges_take_defaults(spark):
    ids = spark.createDataFrame([("a", 0), ("b", 1)], "id string, idx long")
    links = spark.createDataFrame([("x", "b", "a", "", 0.0, None)], "source string, target string, _src string, _tgt string, weight double, relation string")
    r = ingest.ingest_edges(links, ids).first()
    assert (r.src, r.dst, r.weight, r.confidence_score, r.relation, r.confidence) == (0, 1, 1.0, 1.0, "related", "EXTRACTED")


def git(root, *args, **env):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True, env=os.environ | env)


def test_log_parser():
    r, f = history.RECORD, history.FIELD
    raw = f"{r}abc{f}1000{f}alice\0\0" + "1\t1\ta.py\0" + "1\t1\tb.py\0" + f"{r}def{f}900{f}bob\0\0" + "2\t0\t\0old.py\0new.py\0" + "-\t-\tx => \"y\"\tz\0"
    assert list(history.parse_log(raw[i : i + 7] for i in range(0, len(raw), 7))) == list(history.parse_log(raw))
    assert list(history.parse_log(raw)) == [("abc", 1000, "alice", ["a.py", "b.py"]), ("def", 900, "bob", ["new.py", 'x => "y"\tz'])]


def test_histories(spark, repo):
    git(repo, "init", "-q")
    for i, name in enumerate(["app/auth.py", "app/ü n.py", "README.md"]):
        (repo / name).write_text(f"x{i}")
        git(repo, "add", "-A")
        git(repo, "commit", "-qm", f"change {i} of things", GIT_AUTHOR_DATE=f"{1700000000 + i} +0000", GIT_COMMITTER_DATE=f"{1700000000 + i} +0000")
    commits, n = history.commits(spark, repo)
    assert n == 3 and commits.where("path = 'app/ü n.py'").first()["ts"] == 1700000001
    assert len(list(history.mine(repo, history.HistoryConfig(before_ts=1700000001)))) == 1
    spark.dataSource.register(history.GitLog)
    assert spark.read.format("gitlog").load(str(repo)).select("sha").distinct().count() == 3
    assert {r.path for r in history.changed_files(spark, repo, "HEAD~1..HEAD").collect()} == {"README.md"}
    assert "README.md" in {r.path for r in history.current_files(spark, repo).collect()}
    assert {r.subject for r in history.subjects(spark, repo).collect()} == {f"change {i} of things" for i in range(3)}
    spark.dataSource.register(history.GitLog)
    sliced = spark.read.format("gitlog").option("slice", 2).load(str(repo))
    assert sliced.rdd.getNumPartitions() == 2 and {r.sha for r in sliced.collect()} == {r.sha for r in commits.collect()}
    with pytest.raises(ValueError):
        history.changed_files(spark, repo, "--output=x")
    assert history.is_repo(repo) and not history.is_repo(repo.parent)


def test_folders_that_are_skipped_are_not_listed(spark, tmp_path, monkeypatch):
    write(tmp_path / "r", {"a/b.py": "1", "node_modules/c.py": "2", ".hid/d.py": "3", ".github/e.py": "4", "out/.cache/f.py": "5", "a/.x.md": "6", "a/.y.py": "7", "a/z.bin": "8"})
    os.symlink(tmp_path / "r" / "a", tmp_path / "r" / "link")
    names = {r.path for r in tree.listed(spark, str(tmp_path / "r")).collect()}
    assert names == {"a/b.py", ".github/e.py", "a/.x.md", "a/.y.py", "a/z.bin"}
    assert {r.path for r in tree.scan(spark, str(tmp_path / "r")).collect()} == {"a/b.py", ".github/e.py", "a/.x.md"}
    assert {r.path for r in tree.scan(spark, str(tmp_path / "r"), sources=True).collect()} == {"a/b.py", ".hid/d.py", ".github/e.py", "a/.y.py"}
    write(tmp_path / "build" / "r", {"a.py": "1"})
    assert tree.scan(spark, str(tmp_path / "build" / "r"), sources=True).count() == 0 and tree.scan(spark, str(tmp_path / "build" / "r")).count() == 1
