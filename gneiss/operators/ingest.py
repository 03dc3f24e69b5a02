"""From raw nodes, spans and links to the node and edge tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gneiss.functions.identity import node_key
from gneiss.functions.text import ingest_label
from gneiss.plans.checkpoint import truncate


def infer_kind(span_kind: Column, node_kind: Column, file_type: Column, label: Column) -> Column:
    """A span's kind wins, then the node's own; of code, a label with a dot that is no path or call is a file's, others are symbols; else the file type."""
    label = F.coalesce(label, F.lit(""))
    file = label.contains(".") & ~label.contains("/") & ~label.endswith(")")
    return F.coalesce(span_kind, node_kind, F.when(file_type == "code", F.when(file, F.lit("file")).otherwise(F.lit("symbol"))), F.nullif(file_type, F.lit("")), F.lit("unknown"))


class Enclosing:
    """The least value among those entered with an end of at least some end; ends are numbered by rank (a Fenwick tree from the right)."""

    def __init__(self, ends: np.ndarray):
        self.ends = np.unique(ends)
        self.least: list[tuple | None] = [None] * (len(self.ends) + 1)

    def rank(self, end) -> int:
        return len(self.ends) - int(np.searchsorted(self.ends, end))  # 1 for the largest end

    def enter(self, end, value: tuple) -> None:
        i = self.rank(end)
        while i < len(self.least):
            if self.least[i] is None or value < self.least[i]:
                self.least[i] = value
            i += i & -i

    def find(self, end) -> tuple | None:
        i, best = self.rank(end), None
        while i:
            if self.least[i] is not None and (best is None or self.least[i] < best):
                best = self.least[i]
            i -= i & -i
        return best


def innermost_container(spans: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """spans (path, span_id, start_line, end_line, and kind if kinds are given) with parent_id: the tightest longer span around it.

    Of containers, which are of the given kinds if any are, the shortest, then the one that starts last, then the smallest id. Spans of a
    file, whose number its size bounds, are read once in the order of their starts: n log n steps for n of them.
    """
    kind = {f.name: f.dataType.simpleString() for f in spans.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_line", "end_line", "span_id"], ascending=[True, False, True])
        tree, waiting, parents = Enclosing(pdf["end_line"].to_numpy()), [], []
        for i, a, b, holds in zip(pdf["span_id"], pdf["start_line"], pdf["end_line"], pdf["holds"]):
            if waiting and waiting[0][:2] != (a, b):  # spans of the same extent hold none of each other
                for x, y, j in waiting:
                    tree.enter(y, (y - x, -x, j))
                waiting = []
            best = tree.find(b)
            parents.append(None if best is None else best[2])
            if holds:
                waiting.append((a, b, i))
        return pd.DataFrame({"path": pdf["path"], "span_id": pdf["span_id"], "parent_id": pd.Series(parents, index=pdf.index, dtype="object")})

    holds = F.lit(True) if kinds is None else F.col("kind").isin(kinds)
    found = spans.select("path", "span_id", "start_line", "end_line", holds.alias("holds")).groupBy("path").applyInPandas(run, f"path {kind['path']}, span_id {kind['span_id']}, parent_id {kind['span_id']}")
    return spans.join(found, ["path", "span_id"], "left")


#: Halvings of a span's lines: more than any file has.
HALVINGS = 31


def match_spans(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """nodes (id, label, source_file, line) with the span each means: one that holds its line and has its name, else the first of its
    qualified or bare name, else the first whose last name it is. spans: (path, name, qualified, kind, start_line, end_line, signature, docstring).

    Nodes meet one row for each name of a file, and one for each name and first line, so that a name that a file repeats is no product. Only
    nodes whose line is no such first line look for the tightest span around it: spans are cut into aligned stretches of 2^level lines, of
    which the tightest span is kept, and a line lies in one stretch of each level.
    """
    n = nodes.withColumn("_clean", ingest_label("label"))
    names = F.array(*(F.struct(F.col(c).alias("key"), F.lit(t).alias("tier")) for t, c in enumerate(("name", "qualified", "last"), 1)))
    s = spans.withColumn("last", F.element_at(F.split("qualified", r"\."), -1)).withColumn("k", F.explode(names))
    s = s.select(F.col("path").alias("_path"), F.col("k.key").alias("_key"), F.col("k.tier").alias("tier"), (F.col("end_line") - F.col("start_line")).alias("width"), "kind", "start_line", "end_line", "signature", "docstring")
    told = ["kind", "signature", "docstring"]
    own = s.where("tier < 3 and width >= 0")
    first = s.groupBy("_path", "_key").agg(F.min(F.struct("tier", "start_line", "end_line", *told)).alias("_first"))
    begins = own.groupBy("_path", "_key", F.col("start_line").alias("_line")).agg(F.min(F.struct("width", "start_line", "end_line", *told)).alias("_begins"))
    same = (n["source_file"] == F.col("_path")) & (n["_clean"] == F.col("_key"))
    j = n.join(first, same, "left").drop("_path", "_key").join(begins, same & (n["line"] == F.col("_line")), "left").drop("_path", "_key", "_line")
    asked = j.where("_first is not null and _begins is null and line is not null").select("source_file", "_clean", "line").distinct()
    around = asked.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(HALVINGS - 1)))).withColumn("_at", F.expr("shiftright(cast(line as bigint), _level)"))
    levels = own.where("width > 0").withColumn("_level", F.explode(F.expr("sequence(0, cast(floor(log2(width + 1)) as int))")))
    levels = levels.withColumn("_lo", F.expr("shiftright(start_line + shiftleft(1L, _level) - 1, _level)")).withColumn("_hi", F.expr("shiftright(end_line + 1L, _level)"))
    pieces = levels.where("_lo < _hi").withColumn("_at", F.explode(F.expr("filter(array(if(_lo % 2 = 1, _lo, null), if(_hi % 2 = 1, _hi - 1, null)), x -> x is not null)")))
    tight = pieces.groupBy("_path", "_key", "_level", "_at").agg(F.min(F.struct("width", "start_line", "end_line", *told)).alias("_held"))
    met = around.join(tight, (F.col("source_file") == F.col("_path")) & (F.col("_clean") == F.col("_key")) & (around["_level"] == tight["_level"]) & (around["_at"] == tight["_at"]))
    held = met.groupBy("source_file", "_clean", "line").agg(F.min("_held").alias("_around"))
    j = j.join(held, ["source_file", "_clean", "line"], "left")
    of = lambda c: F.coalesce(F.col(f"_begins.{c}"), F.col(f"_around.{c}"), F.col(f"_first.{c}"))
    return j.select(*nodes.columns, of("kind").alias("span_kind"), *(of(c).alias(c) for c in ("start_line", "end_line", "signature", "docstring")))


def dedupe_keys(nodes: DataFrame) -> DataFrame:
    """nodes (ord, path, label, kind, start_line, ...) with node_key; the first of a key keeps it, others get one with their line, repeats of that are dropped.

    The first of a key, and of a key and line, are aggregated, so equal keys are no window of one task.
    """
    plain = node_key(F.col("path"), F.col("label"), F.col("kind"))
    lined = node_key(F.col("path"), F.col("label"), F.col("kind"), F.col("start_line"))
    keyed = nodes.withColumn("_plain", plain).withColumn("_lined", lined)
    first = keyed.groupBy("_plain").agg(F.min("ord").alias("_first"))
    marked = keyed.join(first, "_plain").withColumn("_later", F.col("ord") > F.col("_first"))
    second = marked.where("_later").groupBy(F.col("_lined").alias("_l")).agg(F.min("ord").alias("_second"))
    kept = marked.join(second, F.col("_later") & (F.col("_lined") == F.col("_l")), "left").where(~F.col("_later") | (F.col("ord") == F.col("_second")))
    return kept.withColumn("node_key", F.when(F.col("_later"), F.col("_lined")).otherwise(F.col("_plain"))).drop("_plain", "_lined", "_first", "_later", "_l", "_second")


def with_idx(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes with idx from 0 without gaps, in order: ranks within range partitions and the counts before them, so no window spans all rows.

    The ranges are stored, since counts and ranks must see the same ones: ranges that each works out for itself are sampled, and merged, differently.
    """
    ranged = truncate(nodes.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    base = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_base"))  # one row per partition
    out = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return out.join(F.broadcast(base), "_p").withColumn("idx", F.col("_base") + F.col("_r") - 1).drop("_p", "_r", "_base")


def flat_ranges(nodes: DataFrame, reach: int = 60) -> DataFrame:
    """(idx, end_line) of nodes (idx, source_file, start_line, total): to the line before the next node of the file, `reach` lines and the file's end at most."""
    w = Window.partitionBy("source_file").orderBy("start_line", "idx")
    upto = F.coalesce(F.lead("start_line").over(w) - 1, F.col("total"))
    return nodes.select("idx", "source_file", "start_line", F.greatest(F.col("start_line"), F.least(upto, F.col("start_line") + reach, F.col("total"))).alias("end_line"))


def ends_before_next(spans: DataFrame, group: str = "path") -> DataFrame:
    """spans with end_line set to the line before the next start in the group; the last one keeps its own."""
    w = Window.partitionBy(group).orderBy("start_line", "span_id")
    return spans.withColumn("end_line", F.greatest("start_line", F.coalesce(F.lead("start_line").over(w) - 1, "end_line")))


def links_of(graph: DataFrame) -> DataFrame:
    """The rows of `links`, or of `edges` where links are missing or empty."""
    some = F.when(F.size(F.coalesce("links", F.array())) > 0, F.col("links")) if "links" in graph.columns else F.lit(None)
    column = F.coalesce(some, F.col("edges")) if "edges" in graph.columns else some
    return graph.select(F.posexplode(column).alias("ord", "l")).select("ord", "l.*")


def ingest_edges(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges between known nodes (id, idx) of raw links; the explicit ends come first, loops and unknown ends go, zero or missing weights are 1."""
    have = set(links.columns)
    col = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    filled = lambda c: F.nullif(col(c), F.lit(""))
    number = lambda c: F.coalesce(F.nullif(col(c, "double").cast("double"), F.lit(0.0)), F.lit(1.0))
    e = links.select(
        F.coalesce(filled("_src"), col("source")).alias("s"), F.coalesce(filled("_tgt"), col("target")).alias("t"),
        F.coalesce(filled("relation"), F.lit("related")).alias("relation"), F.coalesce(filled("confidence"), F.lit("EXTRACTED")).alias("confidence"),
        number("confidence_score").alias("confidence_score"), number("weight").alias("weight"), col("source_file").alias("source_file"), col("source_location").alias("source_location"),
    )
    i = ids.select("id", "idx")
    e = e.join(i.toDF("s", "src"), "s").join(i.toDF("t", "dst"), "t").where("src <> dst")
    return e.select("src", "dst", "relation", "confidence", "confidence_score", "weight", "source_file", "source_location", F.lit("structural").alias("channel"))


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """old with the given columns of new where new has the key, and rows of new keys; other columns keep their old values."""
    n = new.select(F.col(key).alias("_k"), F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in columns))
    j = old.join(n, old[key] == n["_k"], "full_outer")
    out = [F.coalesce(F.col(key), F.col("_k")).alias(key)]
    out += [F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns if c != key]
    return j.select(out)


def metrics(nodes: DataFrame) -> DataFrame:
    """One row: nodes, symbols, symbols with a span, external references, and the share with a span."""
    symbol = (F.col("file_type") == "code") & (F.col("kind") != "file") & F.col("parsed")
    out = nodes.agg(F.count("*").alias("nodes"), F.count_if(symbol).alias("symbols"), F.count_if(symbol & F.col("matched")).alias("matched"), F.count_if((F.col("file_type") == "code") & ~F.col("parsed")).alias("unparsed"))
    return out.select("*", (F.col("symbols") - F.col("matched")).alias("external_refs"), F.when(F.col("symbols") > 0, F.col("matched") / F.col("symbols")).alias("span_coverage"))


def resolve_imports(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(importer, target): for each import (importer, import_id) the candidate path of least priority that is a file; self-imports go."""
    hit = candidates.join(files.select("path"), "path", "left_semi")
    best = hit.groupBy("importer", "import_id").agg(F.min_by("path", F.struct("priority", "path")).alias("target"))
    return best.where("importer <> target").select("importer", "target").distinct()
