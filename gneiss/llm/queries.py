"""The operators' queries over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, convtrie, embed_dedup, langid, linededup, lmscore, minhash, mixing, packing, runs, sharding, toxicity, warc
from .common import scratch_path, stored, table

SHARDS, TOKENIZER = 24, "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(column: str, n: int, rest: int):
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n == rest, F.lit(False))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 5, 0)
    dictionaries = langid.train(docs.where(~held))
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), dictionaries).drop("text")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold("doc_id", 4, 2)
    model = toxicity.train(docs.where(~held), labels.where(~held))
    scored = toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lmscore.score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder, least=0)
    out = warc.read(spark, folder, payload=False)
    return out.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def _repeating(doc_id: str, text: str):
    """The text of op12: where crc32 of the id leaves no remainder by 10, its words repeat from some place on."""
    h = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w):
        # w is bound once, not split again for each word
        n = F.size(w)
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    rewritten = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(""))[0]
    return F.when(h % 10 == 0, rewritten).otherwise(F.col(text))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _repeating("doc_id", "text").alias("text"))
    line = lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))
    best = F.col("strongest")
    return runs.periodic_runs(docs).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.start.alias("start"), best.length.alias("length"), best.period.alias("period"),
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _shared_starts(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The turns of op13: the first crc32(id) mod 6 of a conversation are those of the first conversation of its hundred."""
    at = convtrie.placed(turns, "conv", ["turn", "key", "row"], [], "turns")
    shared = F.crc32(F.col("conv").cast("string")) % 6
    own = at.where(F.col("pos") > shared)
    heads = at.where("conv % 100 = 0 and pos < 6").withColumnRenamed("conv", "base")
    lent = convs.withColumn("base", F.expr("conv - conv % 100")).join(heads, "base").where(F.col("pos") <= shared)
    return own.unionByName(lent.drop("base")).select("conv", F.col("pos").alias("order"), "key", "chars")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = convtrie.turn_rows(table(spark, sf_dir, "conversations"))
    convs = stored(turns.select("conv").distinct(), "convs")
    return convtrie.prefix_trie(_shared_starts(turns, convs), convs)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_embedding_dedup, op3_language_id, op4_toxicity, op5_lm_scoring, op6_nearest_neighbours, op7_mixing, op8_warc, op9_packing, op10_minhash_dedup, op11_line_dedup, op12_periodic_runs, op13_prefix_trie, pipeline)}

_COMPONENTS = """
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a)
"""

ORACLE_SQL = {
    "op2_embedding_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_inner_product(x.e, y.e) >= 0.9 * x.n * y.n
), {_COMPONENTS}
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(l.component_id, v.vec_id) AS component_id, coalesce(l.component_id, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN least l ON l.a = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = v.vec_id
""",
    "op5_lm_scoring": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), t AS (
  SELECT doc_id, i, ws[i] AS w3, CASE WHEN i > 1 THEN ws[i - 1] END AS w2, CASE WHEN i > 2 THEN ws[i - 2] END AS w1 FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)
), c1 AS (SELECT w3 AS a, count(*) AS n FROM t GROUP BY ALL),
c2 AS (SELECT w2 AS a, w3 AS b, count(*) AS n FROM t WHERE w2 IS NOT NULL GROUP BY ALL),
c3 AS (SELECT w1 AS a, w2 AS b, w3 AS c, count(*) AS n FROM t WHERE w1 IS NOT NULL GROUP BY ALL),
total AS (SELECT count(*) AS n FROM t),
s AS (
  SELECT t.doc_id, CASE
    WHEN c3.n >= 2 THEN ln(c3.n::DOUBLE) - ln(p2.n::DOUBLE)
    WHEN c2.n >= 2 THEN ln(c2.n::DOUBLE) - ln(p1.n::DOUBLE) + (CASE WHEN i > 2 THEN ln(0.4::DOUBLE) ELSE 0 END)
    ELSE ln(c1.n::DOUBLE) - ln(total.n::DOUBLE) + ln(0.4::DOUBLE) * (least(i, 3) - 1) END AS v
  FROM t JOIN c1 ON c1.a = t.w3 LEFT JOIN c2 ON c2.a = t.w2 AND c2.b = t.w3 LEFT JOIN c1 p1 ON p1.a = t.w2
  LEFT JOIN c3 ON c3.a = t.w1 AND c3.b = t.w2 AND c3.c = t.w3 LEFT JOIN c2 p2 ON p2.a = t.w1 AND p2.b = t.w2 CROSS JOIN total
), d AS (SELECT doc_id, count(*) AS n, sum(v) AS v FROM s GROUP BY doc_id)
SELECT w.doc_id, coalesce(d.n, 0)::BIGINT AS n_tokens, round(coalesce(d.v, 0), 3)::DOUBLE AS log_score, round(d.v / d.n, 6)::DOUBLE AS mean_log_score
FROM w LEFT JOIN d ON d.doc_id = w.doc_id
""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, upper(sha1(coalesce(html, ''))) AS x FROM pages),
b AS (SELECT page_id, h, x, array_to_string(list_transform(range(1, 41), lambda i: right('000' || (strpos('0123456789ABCDEF', x[i]) - 1)::BIGINT::BIT::VARCHAR, 4)), '') AS bits FROM p),
d AS (
  SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + substr(bits, 5 * i + 1, 1)::INT * 16 + substr(bits, 5 * i + 2, 1)::INT * 8 + substr(bits, 5 * i + 3, 1)::INT * 4 + substr(bits, 5 * i + 4, 1)::INT * 2 + substr(bits, 5 * i + 5, 1)::INT]), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY x) AS keeper
  FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM d
""",
    "op11_line_dedup": r"""
WITH l AS (
  SELECT doc_id, t.ord AS i, t.line, translate(regexp_replace(regexp_replace(t.line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS ord) t
), r AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, r.keeper IS NOT NULL AND r.keeper <> l.doc_id AS gone FROM l LEFT JOIN r USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
""",
    "op13_prefix_trie": """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT c, c - c % 100 AS base, xor(4294967295, list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda x, y: list_reduce(range(8), lambda z, i: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END, xor(x, y)), 4294967295)) % 6 AS h
  FROM (SELECT DISTINCT c FROM t)
),
r AS (
  SELECT c.c, t.i, t.k, t.n FROM c JOIN t ON t.c = c.base AND t.i <= c.h
  UNION ALL SELECT c.c, t.i, t.k, t.n FROM c JOIN t ON t.c = c.c AND t.i > c.h
), p AS (SELECT c.c, coalesce(list(k ORDER BY i) FILTER (WHERE k IS NOT NULL), []) AS ks, coalesce(list(n ORDER BY i) FILTER (WHERE n IS NOT NULL), []) AS ns FROM c LEFT JOIN r ON r.c = c.c GROUP BY c.c),
e AS (SELECT c, len(ks) AS m, unnest(range(0, len(ks) + 1)) AS d, ks, ns FROM p),
nodes AS (
  SELECT d, ks[1:d] AS path, min(c) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN ns[d] ELSE 0 END) AS chars, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE m = d), '')) AS ends_sha256 FROM e GROUP BY ALL
), kids AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
up AS (SELECT path[1:a] AS path, a AS d, n.d AS below, n.n_convs, n.chars, n.leaf FROM (SELECT nodes.*, kids.path IS NULL AS leaf, unnest(range(0, nodes.d + 1)) AS a FROM nodes LEFT JOIN kids USING (path, d)) n),
sums AS (SELECT path, d, count_if(leaf) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens FROM up GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (path, d) LEFT JOIN kids k USING (path, d) LEFT JOIN nodes q ON q.path = n.path[1:n.d - 1] AND q.d = n.d - 1
""",
    "op10_minhash_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)) AS sh FROM w
), g AS (
  SELECT sh, min(doc_id) AS rep, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh
), e AS (SELECT rep, n, unnest(sh) AS x FROM g),
i AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL
), one AS (SELECT a, b FROM i WHERE 100 * shared >= 85 * (na + nb - shared)),
links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one), {_COMPONENTS},
c AS (SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(l.component_id, g.rep, s.doc_id) AS component_id FROM s LEFT JOIN g ON g.sh = s.sh LEFT JOIN least l ON l.a = g.rep)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM c
""",
}
