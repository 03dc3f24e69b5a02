"""Building a whole index."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from gneiss.operators import dense, ingest, lexical, mapview
from gneiss.operators.temporal import HistoryConfig
from gneiss.plans import build
from gneiss.plans.history import refresh
from gneiss.plans.store import Epoch, Store
from gneiss.sources import history, nodelink, tree


class LongBuild(RuntimeError):
    """Embedding would take longer than the user has agreed to."""


def ingest_into(epoch: Epoch, root: str, graph_file: str | None = None, most: int = tree.MOST_TEXT) -> dict:
    """Write nodes and structural edges of a tree, files of `most` bytes at most, or of a graph file over it."""
    spark = epoch.spark
    nodes, links, files, spans = build.graph_of_tree(spark, root, most)
    if graph_file:
        nodes, links = nodelink.load(spark, graph_file)
    epoch.write("nodes", build.node_table(nodes, files, spans))
    table = epoch.read("nodes")
    edges = ingest.ingest_edges(links, table)
    n_links = links.count()
    epoch.write_edges(edges, "structural")
    kept = epoch.edges("structural").count()
    code = files.where("not is_doc").select(F.col("path").alias("source_file"), F.lit(True).alias("parsed"))
    m = table.join(code, "source_file", "left").withColumn("parsed", F.coalesce("parsed", F.lit(False))).withColumn("matched", F.col("end_line") > F.col("start_line"))
    out = ingest.metrics(m).first().asDict() | {"edges": kept, "dropped_edges": n_links - kept, "duplicate_nodes": nodes.count() - table.count()}
    files.unpersist()
    spans.unpersist()
    return out


def embed_into(epoch: Epoch, before: Epoch | None, make, device: str = "static", agreed: bool = False) -> None:
    """Write vectors; unchanged nodes of the epoch before keep theirs."""
    nodes = epoch.read("nodes").select("node_key", "content_hash", "idx")
    docs = nodes.join(epoch.read("docs"), "idx").select("node_key", "content_hash", "doc")
    slow = dense.seconds_to_confirm(docs.count(), device)
    if slow and not agreed:
        raise LongBuild(f"about {slow:.0f} s")
    if before is not None and "vectors" in before:
        new = dense.update_vectors(docs, before.read("nodes"), dense.load(before), make)
    else:
        new = dense.embed(docs, make)
    dense.save(epoch, new)


def build_index(spark: SparkSession, root: str, store: Store, graph_file: str | None = None, config: HistoryConfig = HistoryConfig(), backend: str = "none", force: bool = False, agreed: bool = False, as_of: float | None = None) -> dict:
    """A new epoch with nodes, edges, history, documents and, with a backend, vectors."""
    before = store.open() if store.exists() and not force else None
    with store.begin(inherit=not force) as epoch:
        out = ingest_into(epoch, root, graph_file)
        if history.is_repo(root):
            out |= {"history": refresh(epoch, root, time.time() if as_of is None else as_of, config)}
        epoch.write("docs", build.documents(epoch.read("nodes"), epoch.edges("structural")))
        lexical.build(epoch.read("docs")).save(epoch)
        mapview.save_tokens(epoch, mapview.token_index(epoch.read("nodes")))
        name = dense.resolve_backend(backend)
        if name:
            embed_into(epoch, before, dense.BACKENDS[name], agreed=agreed)
            epoch.put_meta(embedding_backend=name)
        epoch.put_meta(root=str(Path(root).resolve()))
    return out


def encoder_of(epoch: Epoch):
    """The encoder that made an epoch's vectors; None without one."""
    name = epoch.meta().get("embedding_backend")
    return dense.BACKENDS[name]() if name in dense.BACKENDS else None


def stats(epoch: Epoch) -> DataFrame:
    from gneiss.operators import reports

    spark = epoch.spark
    empty = spark.createDataFrame([], "x int")
    return reports.stats(epoch.read("nodes"), epoch.edges(), *(t if (t := epoch.read(n)) is not None else empty for n in ("files", "cochange")), summaries=t if (t := epoch.read("community_summaries")) is not None else empty)
