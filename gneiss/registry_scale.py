"""Queries of the operators that take many questions, large graphs or large indexes at once, and the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gneiss.driver_tables import table
from gneiss.operators import community, dense, lexical, mapview
from gneiss.operators.rerank import PairScorer, rerank
from gneiss.plans.batch import BatchRetriever
from gneiss.plans.store import Epoch
from gneiss.registry_index import LIB, TERMS, _library, folder, one_hot
from gneiss.registry_tables import query, r6, sql_parts

# ---------------------------------------------------------------- communities

STARS = "SELECT c_custkey AS idx, min(c_custkey) OVER (PARTITION BY c_nationkey) AS community FROM customer"


def _stars(spark: SparkSession, sf: str) -> DataFrame:
    """Customers around the first one of their nation, and these in a chain of weaker edges."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_nationkey").alias("nation"))
    hubs = c.groupBy("nation").agg(F.min("idx").alias("hub"))
    near = c.join(F.broadcast(hubs), "nation").where("idx <> hub").select(F.col("idx").alias("src"), F.col("hub").alias("dst"), F.lit(10.0).alias("weight"))
    chain = hubs.select(F.col("hub").alias("src"), F.lead("hub").over(Window.orderBy("nation")).alias("dst"), F.lit(1.0).alias("weight"))  # one row for each nation
    return near.unionByName(chain.where("dst is not null"))


@query(STARS)
def graph_communities(spark: SparkSession, sf: str) -> DataFrame:
    return community.communities(_stars(spark, sf))


@query(STARS)
def graph_labels(spark: SparkSession, sf: str) -> DataFrame:
    return community.label_communities(_stars(spark, sf))


# ---------------------------------------------------------------- search

def sql_asked(n: int) -> str:
    """bm: the documents of each benchmark item, which asks with its first n words, by BM25."""
    return rf"""{TERMS}, item AS (SELECT item_id AS query_id, list_slice(regexp_extract_all(text, '[\p{{L}}\p{{M}}]+|\p{{Nd}}+'), 1, {n}) AS raws FROM benchmark),
said AS (SELECT query_id, raw, {sql_parts('raw')} AS parts FROM (SELECT query_id, unnest(raws) AS raw FROM item)),
asked AS (SELECT query_id, term, count(*)::DOUBLE AS qtf FROM (SELECT query_id, lower(raw) AS term FROM said UNION ALL SELECT query_id, unnest(parts) FROM said WHERE len(parts) > 1) GROUP BY ALL),
tf AS MATERIALIZED (SELECT idx, term, count(*)::DOUBLE AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY ALL), df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
bm AS MATERIALIZED (SELECT query_id, idx, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, idx) AS rank
FROM (SELECT query_id, idx, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN lens USING (idx) CROSS JOIN corpus GROUP BY ALL))"""


ASKED_ALL = sql_asked(3)


def _items(spark: SparkSession, sf: str, n: int = 3) -> DataFrame:
    words = F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{M}]+|\p{Nd}+"), 0), 1, n)
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("query"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("doc"))


@query(f"WITH {ASKED_ALL} SELECT query_id, idx, rank::INT AS rank, round(score, 9) AS score FROM bm WHERE rank <= 10")
def bm25_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of each item; blocks of documents whose bound doesn't reach the tenth are not scored."""
    index = lexical.build(_texts(spark, sf), block=64)
    return index.search(_items(spark, sf), 10).select("query_id", "idx", "rank", r6("score", 9).alias("score"))


@query(
    """WITH t AS (SELECT DISTINCT c_custkey AS idx, unnest(regexp_split_to_array(lower(concat_ws(' ', c_name, c_mktsegment)), '[^a-z0-9]+')) AS token FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY idx) AS r FROM t WHERE length(token) >= 2 QUALIFY r <= 400),
q AS (SELECT DISTINCT c_mktsegment AS query_id, unnest([lower(c_mktsegment[1:3]), 'custom', 'custom', lower(c_mktsegment)]) AS word, generate_subscripts([1, 2, 3, 4], 1) AS i FROM customer),
s AS (SELECT query_id, idx, sum(CASE WHEN token = word THEN 2.0::DOUBLE ELSE 1.0::DOUBLE / (1 + length(token) - length(word)) END) AS score FROM k JOIN q ON starts_with(token, word) GROUP BY ALL)
SELECT query_id, idx, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s.score, 12) DESC, idx)::INT AS rank FROM s QUALIFY rank <= 30"""
)
def prefix_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Each market segment asks for its first letters and its name over a stored dictionary."""
    c = table(spark, sf, "customer")
    epoch = Epoch(spark, folder(spark, "tokens"))
    mapview.save_tokens(epoch, mapview.token_index(c.select(F.col("c_custkey").alias("idx"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("source_file"))))
    name = F.col("c_mktsegment")
    asked = c.select(name.alias("query_id"), F.concat(F.substring(name, 1, 3), F.lit(" custom custom-"), name).alias("query")).distinct()
    return mapview.prefix_hits_all(epoch.read("tokens"), asked).select("query_id", "idx", r6("score").alias("score"), "rank")


@query(
    f"""WITH {LIB}, {sql_asked(1)}, qs AS (SELECT query_id, array_to_string(raws, ' ') AS q FROM item),
near AS (SELECT query_id, idx, row_number() OVER (PARTITION BY query_id ORDER BY (text <> '' AND q <> '' AND length(text) % 8 = length(q) % 8)::INT DESC, idx) AS rank FROM lib CROSS JOIN qs QUALIFY rank <= 100),
fused AS (SELECT query_id, idx, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, idx, rank FROM bm WHERE rank <= 100 UNION ALL SELECT * FROM near) GROUP BY ALL),
exact AS (SELECT query_id, idx, CASE WHEN lower(label) = lower(q) THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS score FROM lib JOIN qs ON starts_with(lower(label), lower(q)) WHERE length(q) >= 3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY (lower(label) = lower(q))::INT DESC, idx) <= 10),
peak AS (SELECT query_id, max(score) AS top FROM fused GROUP BY query_id),
injected AS (SELECT query_id, idx, coalesce(p.top + e.score, f.score) AS score FROM fused f FULL JOIN exact e USING (query_id, idx) LEFT JOIN peak p USING (query_id)),
ranked AS (SELECT query_id, idx, i.score * (CASE WHEN starts_with(file, 'tests/') THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END) AS score FROM injected i JOIN lib USING (idx))
SELECT query_id, idx, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(ranked.score, 12) DESC, idx)::INT AS rank FROM ranked QUALIFY rank <= 30"""
)
def search_questions(spark: SparkSession, sf: str) -> DataFrame:
    """All items' answers by names, words and vectors, in one plan."""
    r = BatchRetriever(_library(spark, sf), encoder=one_hot())
    return r.search(_items(spark, sf, 1), k=30, use_ppr=False).select("query_id", "idx", r6("score", 9).alias("score"), "rank")


# ---------------------------------------------------------------- vectors


@query("SELECT vec_id, len(embedding)::INT AS n, 2 * len(embedding)::INT AS bytes, true AS near FROM embeddings")
def half_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector after a round trip through 16 bits: its length, its bytes, and whether no component moved by more than 2^-11 of itself (2^-24 near zero)."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("node_key"), "embedding")
    epoch = Epoch(spark, folder(spark, "halves"))
    dense.save(epoch, v)
    held = epoch.read("vectors").select("node_key", F.octet_length("half").alias("bytes"))
    back = dense.load(epoch).withColumnRenamed("embedding", "back").join(v, "node_key").join(held, "node_key")
    far = F.zip_with("embedding", "back", lambda x, y: F.abs(x.cast("double") - y) <= F.greatest(F.abs(x) * 2.0**-11, F.lit(2.0**-24)))
    return back.select(F.col("node_key").cast("long").alias("vec_id"), F.size("back").alias("n"), "bytes", F.forall(far, lambda ok: ok).alias("near"))


# ---------------------------------------------------------------- reranking

WORDS = r"list_transform(regexp_extract_all(coalesce({x}, ''), '[\p{{L}}\p{{M}}]+|\p{{Nd}}+'), lambda w: lower(w))"


@query(
    rf"""WITH {ASKED_ALL}, r AS (SELECT bm.query_id, bm.idx, score, rank, {WORDS.format(x="array_to_string(raws, ' ')")} AS qw FROM bm JOIN item USING (query_id) WHERE rank <= 100),
s AS (SELECT r.*, CASE WHEN rank <= 20 THEN {WORDS.format(x='d.text')} END AS dw FROM r JOIN documents d ON d.doc_id = r.idx),
h AS (SELECT *, CASE WHEN rank <= 20 THEN 1 / (1 + exp(2.0::DOUBLE - 4.0::DOUBLE * len(list_filter(list_distinct(qw), lambda w: list_contains(dw, w))) / greatest(1, len(list_distinct(qw))))) END AS new FROM s)
SELECT query_id, idx, round(CASE WHEN rank <= 20 THEN max(score) OVER w + 1 + new - min(new) OVER w ELSE score END, 6) AS score FROM h WINDOW w AS (PARTITION BY query_id)"""
)
def reranked_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred best documents of each item, of which twenty are ordered anew by the share of the item's words that they cover, in one plan."""
    items, docs = _items(spark, sf), _texts(spark, sf)
    ranked = lexical.build(docs).search(items, 100).select("query_id", "idx", "score")
    scorer = PairScorer(np.array([-2.0, 4.0, 0.0, 0.0, 0.0, 0.0, 0.0]))
    return rerank(ranked, items, docs, scorer, top=20).select("query_id", "idx", r6("score").alias("score"))
