"""Queries over sources that are written from the driver's tables first: trees of files, graph files and histories."""

from __future__ import annotations

import json
import posixpath
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gneiss.driver_tables import table
from gneiss.operators import ingest
from gneiss.plans import index
from gneiss.plans.store import Epoch
from gneiss.registry_tables import query, r6
from gneiss.registry_index import folder
from gneiss.sources import history, imports, nodelink, spans, tree


def written(files: DataFrame, root: str) -> None:
    """Write files (path, text) below root, each by the task that holds it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = tree.store_of(root)
        for pdf in parts:
            for path, text in zip(pdf["path"], pdf["text"]):
                at = posixpath.join(base, path)
                store.create_dir(posixpath.dirname(at), recursive=True)
                with store.open_output_stream(at) as f:
                    f.write(text.encode("utf-8"))
            yield pd.DataFrame({"n": [len(pdf)]})

    files.select("path", "text").mapInPandas(run, "n long").count()


# ---------------------------------------------------------------- trees

DIRS = ["src", "node_modules", ".git", ".github", "docs/api", "build", "lib/.hidden", ".cache"]
ENDS = [("p", ".py"), ("p", ".md"), (".p", ".txt"), ("p", ".TS"), (".p", ".py"), ("p", ".bin"), ("p", ".go")]
LANGS = "CASE page_id % 7 WHEN 0 THEN 'python' WHEN 3 THEN 'typescript' WHEN 4 THEN 'python' WHEN 6 THEN 'go' END"
PAGE_PATH = f"([{', '.join(repr(d) for d in DIRS)}])[page_id % 8 + 1] || '/' || ([{', '.join(repr(a) for a, _ in ENDS)}])[page_id % 7 + 1] || page_id || ([{', '.join(repr(b) for _, b in ENDS)}])[page_id % 7 + 1]"
LINES = r"regexp_split_to_array(html, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')"


def _tree(spark: SparkSession, sf: str) -> str:
    root = str(folder(spark, "tree"))
    pick = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("page_id") % n + 1).cast("int"))
    path = F.concat(pick(DIRS, 8), F.lit("/"), pick([a for a, _ in ENDS], 7), "page_id", pick([b for _, b in ENDS], 7))
    written(table(spark, sf, "pages").select(path.alias("path"), F.coalesce("html", F.lit("")).alias("text")), root)
    return root


@query(f"WITH p AS (SELECT page_id, {PAGE_PATH} AS path, {LANGS} AS language, page_id % 7 IN (1, 2) AS is_doc, coalesce(html, '') AS html FROM pages), l AS (SELECT *, {LINES} AS ls FROM p) SELECT path, language, is_doc, md5(html) AS md5, (len(ls) - (ls[len(ls)] = '')::INT)::INT AS n_lines FROM l WHERE page_id % 8 IN (0, 3, 4) AND page_id % 7 IN (0, 1, 2, 3, 6)")
def tree_files(spark: SparkSession, sf: str) -> DataFrame:
    """What the walk of a tree reads: no skipped or hidden folders but .github, no hidden files but documents, known endings."""
    files = tree.scan(spark, _tree(spark, sf))
    n = tree.lines(files).groupBy("path").agg(F.count("*").cast("int").alias("n"))
    return files.join(n, "path", "left").select("path", "language", "is_doc", F.md5("text").alias("md5"), F.coalesce("n", F.lit(0)).alias("n_lines"))


@query(f"SELECT {PAGE_PATH} AS path, {LANGS} AS language FROM pages WHERE page_id % 8 IN (0, 3, 4, 6) AND page_id % 7 IN (0, 3, 4, 6)")
def tree_sources(spark: SparkSession, sf: str) -> DataFrame:
    """What the walk for definitions reads: another list of folders, hidden ones besides, code only."""
    return tree.scan(spark, _tree(spark, sf), sources=True).select("path", "language")


# ---------------------------------------------------------------- definitions


def _blocks(spark: SparkSession, sf: str, block) -> DataFrame:
    """(n_nationkey, n_name, n_regionkey, body): a block of text for each supplier of a nation, in order; block: a function of the key and the nation's name, as columns."""
    n = table(spark, sf, "nation")
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("keys"))
    return n.join(s, "n_nationkey", "left").select("n_nationkey", "n_name", "n_regionkey", F.array_join(F.transform(F.coalesce("keys", F.array().cast("array<long>")), lambda k: block(k.cast("string"), F.col("n_name"))), "").alias("body"))


def _python(k: Column, nation: Column) -> Column:
    return F.concat(
        F.lit("class Supplier"), k, F.lit('(Base):\n    """Supplier '), k, F.lit(" of "), nation, F.lit('."""\n\n    def balance(self, rate: float,\n                days: int = 1) -> float:\n        return rate\n\n\ndef make_'), k, F.lit("(x):\n    return x\n"),
    )


SUPPLIERS = "sup AS MATERIALIZED (SELECT n_nationkey, n_name, n_regionkey, s_suppkey AS k, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier JOIN nation ON n_nationkey = s_nationkey)"


def sql_python(before: str) -> str:
    """defs: (n_nationkey, n_regionkey, n_name, k, j, name, kind, a, b, signature, docstring, parent) of the blocks, after `before` lines."""
    part = lambda j, name, kind, a, b, sig, doc, parent: f"SELECT n_nationkey, n_regionkey, n_name, k, 3 * i + {j} AS j, {name} AS name, '{kind}' AS kind, ({before}) + 10 * i + {a} AS a, ({before}) + 10 * i + {b} AS b, {sig} AS signature, {doc} AS docstring, {parent} AS parent FROM sup"
    rows = [
        part(0, "'Supplier' || k", "class", 1, 6, "'class Supplier' || k || '(Base):'", "'Supplier ' || k || ' of ' || n_name || '.'", "NULL"),
        part(1, "'balance'", "method", 4, 6, "'def balance(self, rate: float, days: int = 1) -> float:'", "''", "'Supplier' || k"),
        part(2, "'make_' || k", "function", 9, 10, "'def make_' || k || '(x):'", "''", "NULL"),
    ]
    return f"{SUPPLIERS}, defs AS MATERIALIZED ({' UNION ALL '.join(rows)})"


@query(f"WITH {sql_python('1')} SELECT n_name || '.py' AS path, j::BIGINT AS span_id, name, CASE WHEN parent IS NULL THEN name ELSE parent || '.' || name END AS qualified, kind, a::INT AS start_line, b::INT AS end_line, signature, docstring, parent FROM defs")
def python_definitions(spark: SparkSession, sf: str) -> DataFrame:
    d = _blocks(spark, sf, _python)
    return spans.spans(d.select(F.concat("n_name", F.lit(".py")).alias("path"), F.concat(F.lit("import os\n"), "body").alias("text"), F.lit("python").alias("language")))


@query(f"WITH {sql_python('1')}, names AS (SELECT n_name, name, 0 AS tier, j FROM defs UNION ALL SELECT n_name, parent || '.' || name, 1, j FROM defs WHERE parent IS NOT NULL) SELECT n_name || '.py' AS path, name, arg_min(j, tier * 1000000 + j)::BIGINT AS span_id FROM names GROUP BY ALL")
def definition_names(spark: SparkSession, sf: str) -> DataFrame:
    return spans.name_index(python_definitions(spark, sf))


#: Class and method headers by language: the first line of the class, the two lines of the method, and the names' first letters.
BRACED = {
    "java": ("public class S{k}", "public Map<String, List<Integer>> get{k}(int a,", "List<int[]> b) throws IOException", "class"),
    "typescript": ("export class S{k}", "async get{k}(a: number,", "b = (1 + 2)): Promise<Map<string, number>>", "class"),
    "c_sharp": ("public class S{k}", "public Dictionary<string, List<int>> get{k}(int a,", "List<int> b)", "class"),
    "rust": ("impl S{k}", "pub fn get{k}<T: Clone>(a: Vec<T>,", "b: i32) -> Option<Vec<T>>", "impl"),
}


def _braced(language: str):
    head, first, second, _ = BRACED[language]

    def block(k: Column, nation: Column) -> Column:
        text = f"// Holds {{k}}.\n{head} {{{{\n  {first}\n      {second} {{{{\n    if (a > 0) {{{{ return a; }}}} // }}}}\n  }}}}\n}}}}\n\n"
        parts = text.replace("{{", "{").replace("}}", "}").split("{k}")
        out = [F.lit(parts[0])]
        for p in parts[1:]:
            out += [k, F.lit(p)]
        return F.concat(*out)

    return block


def sql_braced() -> str:
    case = lambda f: "CASE n_nationkey % 4 " + " ".join(f"WHEN {i} THEN {f(*BRACED[x])}" for i, x in enumerate(BRACED)) + " END"
    said = lambda t: "'" + t.replace("{k}", "' || k || '") + "'"
    path = "n_name || '.' || " + "CASE n_nationkey % 4 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(BRACED)) + " END"
    return f"""SELECT {path} AS path, 'S' || k AS name, {case(lambda a, b, c, d: repr(d))} AS kind, (8 * i + 2)::INT AS start_line, (8 * i + 7)::INT AS end_line, {case(lambda a, b, c, d: said(a))} AS signature, 'Holds ' || k || '.' AS docstring, NULL AS parent FROM sup
UNION ALL SELECT {path}, 'get' || k, 'method', (8 * i + 3)::INT, (8 * i + 6)::INT, {case(lambda a, b, c, d: said(b + ' ' + c))}, '', 'S' || k FROM sup"""


@query(f"WITH {SUPPLIERS} {sql_braced()}")
def braced_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """Four languages; headers over two lines, with nested type arguments and parameters in brackets."""
    out = None
    for i, language in enumerate(BRACED):
        d = _blocks(spark, sf, _braced(language)).where(F.col("n_nationkey") % 4 == i)
        d = d.select(F.concat("n_name", F.lit(f".{language}")).alias("path"), F.col("body").alias("text"), F.lit(language).alias("language"))
        out = d if out is None else out.unionByName(d)
    return spans.spans(out).select("path", "name", "kind", "start_line", "end_line", "signature", "docstring", "parent")


#: Files import the next two suppliers' files: relative ones, from the root and from packages that aren't there.
IMPORTS = """f AS (SELECT s_suppkey AS k, 'p' || (s_suppkey % 5) || '/s' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.py' ELSE '.ts' END AS path, s_suppkey % 2 = 0 AS py FROM supplier)"""


@query(f"WITH {IMPORTS} SELECT DISTINCT a.path AS importer, b.path AS target FROM f a JOIN f b ON b.py = a.py AND (b.k = a.k + 2 OR b.k = a.k + 10 OR (a.py AND b.k = a.k + 4))")
def import_edges(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = lambda n: F.concat(F.lit("s"), (k + n).cast("string"))
    pack = lambda n: F.concat(F.lit("p"), ((k + n) % 5).cast("string"))
    py = F.concat(F.lit("import os, "), pack(2), F.lit("."), s(2), F.lit("\nfrom ."), s(10), F.lit(" import (a,\n    b as c)\nfrom .."), pack(4), F.lit(" import "), s(4), F.lit("  # one\n"))
    ts = F.concat(F.lit("import {x} from '../"), pack(2), F.lit("/"), s(2), F.lit("';\nexport * from './"), s(10), F.lit(".ts';\nconst r = require('react');\nimport q from '../../out/x';\n"))
    even = k % 2 == 0
    files = table(spark, sf, "supplier").select(F.concat(F.lit("p"), (k % 5).cast("string"), F.lit("/s"), k.cast("string"), F.when(even, ".py").otherwise(".ts")).alias("path"), F.when(even, py).otherwise(ts).alias("text"), F.when(even, "python").otherwise("typescript").alias("language"))
    return imports.import_edges(files)


# ---------------------------------------------------------------- a tree as an index

#: A region's files import each other, so each region is a community; a file begins with its imports.
ROOM = "(SELECT count(*) FROM nation o WHERE o.n_regionkey = sup.n_regionkey) - 1"
PATH = "'r' || n_regionkey || '/' || n_name || '.py'"
BODIES = f"""{sql_python(ROOM)}, imp AS (SELECT a.n_nationkey, string_agg('from .' || b.n_name || ' import x' || chr(10), '' ORDER BY b.n_nationkey) AS t, count(b.n_nationkey) AS n FROM nation a LEFT JOIN nation b ON b.n_regionkey = a.n_regionkey AND b.n_nationkey <> a.n_nationkey GROUP BY a.n_nationkey),
body AS (SELECT n_nationkey, string_agg('class Supplier' || k || '(Base):' || chr(10) || '    \"\"\"Supplier ' || k || ' of ' || n_name || '.\"\"\"' || chr(10) || chr(10) || '    def balance(self, rate: float,' || chr(10) || '                days: int = 1) -> float:' || chr(10) || '        return rate' || chr(10) || chr(10) || chr(10) || 'def make_' || k || '(x):' || chr(10) || '    return x' || chr(10), '' ORDER BY i) AS t FROM sup GROUP BY n_nationkey),
txt AS MATERIALIZED (SELECT n.n_nationkey, n.n_regionkey, n.n_name, {PATH} AS path, string_split(coalesce(imp.t, '') || coalesce(body.t, ''), chr(10)) AS ls FROM nation n JOIN imp USING (n_nationkey) LEFT JOIN body USING (n_nationkey)),
raw AS (SELECT path AS id, n_name || '.py' AS label, 'file' AS kind, path, 1 AS a, greatest(1, len(ls) - 1) AS b, '' AS signature, '' AS docstring, n_regionkey, ls, path AS owner FROM txt
  UNION ALL SELECT {PATH.replace('n_name', 'd.n_name').replace('n_regionkey', 'd.n_regionkey')} || '::' || name || '::' || a, name, kind, path, a, b, signature, docstring, d.n_regionkey, ls, CASE WHEN parent IS NULL THEN path ELSE path || '::' || parent || '::' || (a - 3) END FROM defs d JOIN txt ON txt.n_nationkey = d.n_nationkey),
nums AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY path, a, id) - 1 AS idx, row_number() OVER (PARTITION BY path, label, kind ORDER BY a, id) AS nth FROM raw)"""


def sql_key(*parts: str) -> str:
    return "substr(sha256(" + " || ".join(f"octet_length(encode({p}))::VARCHAR || chr(31) || {p} || chr(30)" for p in parts) + "), 1, 32)"


def _index(spark: SparkSession, sf: str) -> tuple[Epoch, dict]:
    n = table(spark, sf, "nation")
    others = n.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("o"), F.col("n_name").alias("name"))
    own = n.join(others, (F.col("r") == F.col("n_regionkey")) & (F.col("o") != F.col("n_nationkey"))).groupBy("n_nationkey").agg(F.array_sort(F.collect_list(F.struct("o", "name"))).alias("others"))
    lines = F.array_join(F.transform(F.coalesce("others", F.array().cast("array<struct<o:int,name:string>>")), lambda x: F.concat(F.lit("from ."), x["name"], F.lit(" import x\n"))), "")
    d = _blocks(spark, sf, _python).join(own, "n_nationkey", "left")
    root = str(folder(spark, "sources"))
    written(d.select(F.concat(F.lit("r"), "n_regionkey", F.lit("/"), "n_name", F.lit(".py")).alias("path"), F.concat(lines, "body").alias("text")), root)
    epoch = Epoch(spark, folder(spark, "index"))
    return epoch, index.ingest_into(epoch, root, most=1 << 31)  # a nation's file grows with its suppliers, and the SQL leaves none out


@query(
    f"""WITH {BODIES} SELECT idx, id, label, kind, 'code' AS file_type, path AS source_file, a::INT AS start_line, b::INT AS end_line, signature, docstring, n_regionkey::BIGINT AS community, 'r' || n_regionkey AS community_name,
CASE WHEN nth = 1 THEN {sql_key('path', 'label', 'kind')} ELSE {sql_key('path', 'label', 'kind', 'a::VARCHAR')} END AS node_key, substr(sha256(array_to_string(list_slice(ls, a, b), chr(10))), 1, 32) AS content_hash FROM nums"""
)
def tree_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The node table of a tree: spans, kinds, communities, keys with their collisions, hashes and numbers."""
    nodes = _index(spark, sf)[0].read("nodes")
    return nodes.select("idx", "id", "label", "kind", "file_type", "source_file", "start_line", "end_line", "signature", "docstring", "community", "community_name", "node_key", "content_hash")


@query(
    f"""WITH {BODIES} SELECT o.idx AS src, n.idx AS dst, 'contains' AS relation FROM nums n JOIN nums o ON o.id = n.owner WHERE n.kind <> 'file'
UNION ALL SELECT x.idx, y.idx, 'imports' FROM nums x JOIN nums y ON y.n_regionkey = x.n_regionkey AND y.idx <> x.idx WHERE x.kind = 'file' AND y.kind = 'file'"""
)
def tree_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf)[0].edges("structural").select("src", "dst", "relation")


@query("SELECT (25 + 3 * s)::BIGINT AS nodes, (3 * s)::BIGINT AS symbols, (3 * s)::BIGINT AS matched, 0::BIGINT AS unparsed, 0::BIGINT AS external_refs, (3 * s + i)::BIGINT AS edges, 0::BIGINT AS dropped_edges, 0::BIGINT AS duplicate_nodes FROM (SELECT count(*) AS s FROM supplier), (SELECT count(*) AS i FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey)")
def tree_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = _index(spark, sf)[1]
    names = ["nodes", "symbols", "matched", "unparsed", "external_refs", "edges", "dropped_edges", "duplicate_nodes"]
    return spark.createDataFrame([tuple(int(m[n]) for n in names)], ", ".join(f"{n} long" for n in names))


# ---------------------------------------------------------------- graph files


@query("SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, CASE WHEN s_suppkey % 2 = 0 THEN 'in' ELSE 'related' END AS relation, round(CASE WHEN s_acctbal = 0 THEN 1 ELSE s_acctbal END, 6) AS weight FROM supplier WHERE s_suppkey % 5 <> 4 AND s_nationkey IN (SELECT n_nationkey FROM nation)")
def graph_file(spark: SparkSession, sf: str) -> DataFrame:
    """A graph file with empty links and its edges under another name; the ends of some are told by other keys, others lead nowhere or back."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    node = lambda i: F.struct(i.alias("id"), i.alias("label"), F.lit("code").alias("file_type"), F.lit("a.py").alias("source_file"))
    nodes = s.select(F.concat(F.lit("s"), "s_suppkey").alias("i")).unionByName(table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("i")))
    a, b = F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey")
    lost = F.when(F.col("s_suppkey") % 10 == 4, "ghost").otherwise(a)
    target = F.when(F.col("s_suppkey") % 5 == 4, lost).otherwise(b)
    turned = F.col("s_suppkey") % 3 == 0
    link = F.struct(F.when(turned, target).otherwise(a).alias("source"), F.when(turned, a).otherwise(target).alias("target"), F.when(turned, a).alias("_src"), F.when(turned, target).alias("_tgt"), F.when(F.col("s_suppkey") % 2 == 0, "in").alias("relation"), F.col("s_acctbal").alias("weight"))
    n = nodes.agg(F.collect_list(node(F.col("i"))).alias("nodes"))
    e = s.agg(F.collect_list(link).alias("edges"))
    path = f"{folder(spark, 'graph')}/g"
    n.crossJoin(e).select("nodes", F.array().cast("array<string>").alias("links"), "edges").coalesce(1).write.option("ignoreNullFields", "true").json(path)
    found, links = nodelink.load(spark, path)
    ids = found.select("id", F.col("ord").cast("long").alias("idx"))
    out = ingest.ingest_edges(links, ids)
    return out.join(ids.toDF("src_id", "src"), "src").join(ids.toDF("dst_id", "dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "relation", r6("weight").alias("weight"))


@query("SELECT 4 AS tried, 4 AS refused")
def graph_file_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Files that hold no graph."""
    at, refused = folder(spark, "graphs"), 0
    for i, text in enumerate(['{"something": "else"}', '{"nodes": []}', "[1, 2]", '{"links": []}']):
        (at / f"{i}.json").write_text(text)
        try:
            nodelink.load(spark, str(at / f"{i}.json"))
        except nodelink.GraphFormatError:
            refused += 1
    return spark.createDataFrame([(4, refused)], "tried int, refused int")


# ---------------------------------------------------------------- histories

OF_ORDERS = "SELECT DISTINCT o_orderkey, epoch(o_orderdate)::BIGINT AS ts, n_name, l_suppkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN lineitem ON l_orderkey = o_orderkey"


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """(o_orderkey, ts, n_name, o_orderpriority, o_orderstatus, files): orders as commits of their suppliers' files."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("files"))
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(table(spark, sf, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    ts = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)")
    return o.join(li, "o_orderkey").select("o_orderkey", ts.alias("ts"), "n_name", "o_orderpriority", "o_orderstatus", "files")


def _logs(rows: DataFrame, record: Column) -> DataFrame:
    """Exported logs of each author's commits, 1,024 order keys at most in each, so that no log grows with the table."""
    return rows.select("n_name", "o_orderkey", record.alias("r")).groupBy("n_name", F.expr("o_orderkey div 1024").alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "r"))), lambda x: x["r"]), "").alias("raw"))


@query(f"SELECT 'o' || o_orderkey AS sha, ts, n_name AS author, 'dir é/s' || l_suppkey || '.py' AS path FROM ({OF_ORDERS})")
def log_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Logs with NUL between fields, as git writes them; each third file was renamed."""
    sep = lambda c: F.lit(c)
    name = lambda x: F.concat(F.lit("dir é/s"), x.cast("string"), F.lit(".py"))
    entry = F.transform("files", lambda x: F.when(x % 3 == 0, F.concat(F.lit("1\t0\t\0old/"), x.cast("string"), F.lit("\0"), name(x), F.lit("\0"))).otherwise(F.concat(F.lit("2\t1\t"), name(x), F.lit("\0"))))
    head = F.concat(sep(history.RECORD), F.lit("o"), F.col("o_orderkey").cast("string"), sep(history.FIELD), F.col("ts").cast("string"), sep(history.FIELD), F.col("n_name"), F.lit("\0\0\n"))
    return history.logs(_logs(_orders(spark, sf), F.concat(head, F.array_join(entry, ""))))


@query("SELECT 'o' || o_orderkey AS sha, epoch(o_orderdate)::BIGINT AS ts, o_orderpriority AS subject, 'status ' || o_orderstatus AS body, 's' || l_suppkey AS path FROM orders JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def subject_rows(spark: SparkSession, sf: str) -> DataFrame:
    f = F.lit(history.FIELD)
    files = F.array_join(F.transform("files", lambda x: F.concat(F.lit("s"), x.cast("string"), F.lit("\0"))), "")
    head = F.concat(F.lit(history.RECORD), F.lit("o"), F.col("o_orderkey").cast("string"), f, F.col("ts").cast("string"), f, F.col("o_orderpriority"), f, F.concat(F.lit("status "), "o_orderstatus"), f, F.lit("\n\n"))
    return history.subject_logs(_logs(_orders(spark, sf), F.concat(head, files)))


@query(
    """SELECT 'commit' AS what, n_name AS author, 1600000000::BIGINT + n_nationkey * 86400 AS ts, 'r' || n_regionkey || '/n' || n_nationkey || '.py' AS path FROM nation UNION ALL SELECT 'old', n_name, 1600000000::BIGINT + n_nationkey * 86400, 'r' || n_regionkey || '/n' || n_nationkey || '.py' FROM nation WHERE n_nationkey < 10
UNION ALL SELECT 'file', NULL, NULL, 'r' || n_regionkey || '/n' || n_nationkey || '.py' FROM nation UNION ALL SELECT 'changed', NULL, NULL, 'r' || n_regionkey || '/n' || n_nationkey || '.py' FROM nation WHERE n_nationkey >= (SELECT count(*) - 3 FROM nation) UNION ALL SELECT 'subject', 'add ' || n_name, 1600000000::BIGINT + n_nationkey * 86400, 'r' || n_regionkey || '/n' || n_nationkey || '.py' FROM nation"""
)
def git_history(spark: SparkSession, sf: str) -> DataFrame:
    """A repository with a commit for each nation, read in slices of seven commits; its files, subjects and last changes."""
    root = folder(spark, "repository")

    def git(*args: str, **env: str) -> None:
        import os

        subprocess.run(["git", "-C", str(root), "-c", "user.email=a@b", *args], check=True, capture_output=True, env=os.environ | env)

    git("init", "-q")
    for n in table(spark, sf, "nation").orderBy("n_nationkey").collect():
        at = root / f"r{n.n_regionkey}" / f"n{n.n_nationkey}.py"
        at.parent.mkdir(exist_ok=True)
        at.write_text(f"x = {n.n_nationkey}\n" * (n.n_nationkey + 1))
        when = f"{1600000000 + n.n_nationkey * 86400} +0000"
        git("add", "-A")
        git("-c", f"user.name={n.n_name}", "commit", "-qm", f"add {n.n_name}", GIT_AUTHOR_DATE=when, GIT_COMMITTER_DATE=when)
    if not history.is_repo(root):
        raise ValueError("no repository")
    spark.dataSource.register(history.GitLog)
    log = lambda **o: spark.read.format("gitlog").options(slice=7, **o).load(str(root))
    none = F.lit(None)
    out = log().select(F.lit("commit").alias("what"), "author", "ts", "path")
    out = out.unionByName(log(before_ts=1600000000 + 10 * 86400).select(F.lit("old").alias("what"), "author", "ts", "path"))
    out = out.unionByName(history.current_files(spark, root).select(F.lit("file").alias("what"), none.cast("string").alias("author"), none.cast("long").alias("ts"), "path"))
    out = out.unionByName(history.changed_files(spark, root, "HEAD~3..HEAD").select(F.lit("changed").alias("what"), none.cast("string").alias("author"), none.cast("long").alias("ts"), "path"))
    return out.unionByName(history.subjects(spark, root).select(F.lit("subject").alias("what"), F.col("subject").alias("author"), "ts", "path"))


@query("SELECT count(*)::BIGINT AS tried, count(*)::BIGINT AS right FROM nation")
def contained_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths inside a root, links out of it, links inside it, paths above it and folders: only regular files that lie inside count."""
    root, out = folder(spark, "root"), folder(spark, "outside")
    (out / "x").write_text("x")
    right, names = 0, [r.n_name for r in table(spark, sf, "nation").collect()]
    for i, name in enumerate(names):
        at = root / name
        if i % 4 == 0:
            at.write_text("a\x0bb\n")
            right += tree.contained(root, name) == at.resolve() and tree.read_lines(root, name) == ["a", "b"]
        elif i % 4 == 1:
            at.symlink_to(out / "x")
            right += tree.contained(root, name) is None and tree.read_lines(root, name) == []
        elif i % 4 == 2:
            at.symlink_to(root / names[0])
            right += tree.contained(root, name) == (root / names[0]).resolve()
        else:
            at.mkdir()
            right += tree.contained(root, name) is None and tree.contained(root, f"../{out.name}/x") is None
    return spark.createDataFrame([(len(names), right)], "tried long, right long")


@query("SELECT count(*)::BIGINT AS n, sum(n_regionkey)::BIGINT AS total, 'x<y' AS said FROM nation")
def meta_json(spark: SparkSession, sf: str) -> DataFrame:
    """Values that an epoch keeps as JSON, and a payload that goes through a page."""
    from gneiss import viz

    epoch = Epoch(spark, folder(spark, "meta"))
    rows = table(spark, sf, "nation").collect()
    for r in rows:
        epoch.put_meta(**{r.n_name: r.n_regionkey}, said="x<y")
    meta = epoch.meta()
    page = json.loads(viz.page({"said": meta.pop("said")}, "t").split('id="data">')[1].split("</script>")[0])
    return spark.createDataFrame([(len(meta), sum(meta.values()), page["said"])], "n long, total long, said string")
