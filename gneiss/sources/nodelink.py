"""Node-link graphs in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gneiss.operators.ingest import links_of

MOST_BYTES = 512 << 20
NODE = "struct<id:string,label:string,file_type:string,kind:string,source_file:string,source_location:string,community:bigint,community_name:string>"
LINK = "struct<source:string,target:string,relation:string,confidence:string,confidence_score:double,weight:double,_src:string,_tgt:string,source_file:string,source_location:string>"
SCHEMA = f"nodes array<{NODE}>, links array<{LINK}>, edges array<{LINK}>"


class GraphFormatError(ValueError):
    """A file that holds no node-link graph, or too large a one."""


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a graph file; `edges` stands in for `links`."""
    size = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    if size is None or size > MOST_BYTES:
        raise GraphFormatError(f"{path}: {size} bytes")
    g = spark.read.schema(SCHEMA).option("multiLine", "true").json(path)
    if not g.where("nodes is not null and (links is not null or edges is not null)").limit(1).count():
        raise GraphFormatError(f"{path}: no nodes or links")
    nodes = g.select(F.posexplode("nodes").alias("ord", "n")).select("ord", "n.*")
    return nodes, links_of(g)
