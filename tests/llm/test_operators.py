"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import ann, embed_dedup, langid, lmscore, minhash, mixing, packing, sharding, toxicity, warc
from gneiss.llm.common import connected_components, running, scratch_path, shingle_set, words_of
from gneiss.llm.queries import tokenizer_path

WORDS = [f"w{i}" for i in range(400)]
#: Names that the operators use inside.
CLASH = "id long, vec string, cls long, key long, root long, n long, block int, before long, total long, place long, size long, shard int"


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank and long texts, ties, repeated rows, null sources, and extra columns with clashing names."""
    rng = random.Random(3)
    rows = [(i, text(rng, rng.randrange(1, 60)), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, None, None, None), (101, "", "en", "s0"), (102, " \t\n", "de", None), (103, text(rng, 30_000), "en", "s1"), (104, "ÄÖ ß é", "de", "s1")]
    rows += [(105, rows[5][1], "en", "s2"), (106, rows[5][1].upper(), "en", "s2"), rows[7], rows[7], (107, "x" * 5000, "en", "s1")]
    clash = [0, "v", 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]
    return spark.createDataFrame([(*r, *clash) for r in rows], f"doc_id long, text string, lang string, source string, {CLASH}")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


# ---------------------------------------------------------------- helpers


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert got == want


def test_running_sums_in_buckets(spark):
    d = spark.range(5000).select((F.col("id") % 2 * F.col("id") % 3).alias("g"), "id", (F.col("id") % 5).alias("v"), F.xxhash64("id").alias("place"))
    d = d.join(d.groupBy("g").agg(F.count("*").alias("group_rows")), "g")
    rows = running(d, ["g"], ["id"], "v", rows=50).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.g].append((r.place if r.place >= 0 else r.place + (1 << 64), r.id, r.v, r.before))
    for g in by.values():
        at = 0
        for _, _, v, before in sorted(g):
            assert before == at
            at += v


# ---------------------------------------------------------------- sharding


def test_shards_are_even_and_slots_gapless(odd, nothing):
    rows = sharding.assign(odd, 7).collect()
    assert len(rows) == odd.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    assert all(r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in rows)
    assert sharding.assign(nothing, 7).count() == 0


@pytest.mark.parametrize("shards,vnodes,rows", [(5, 8, 700), (2, 1, 6000)])
def test_shards_match_a_walk_on_the_ring(spark, shards, vnodes, rows):
    """Round r lets what is left of each arc, in ring order, try the r-th point ahead; the second case has arcs of more rows than a bucket."""
    d = spark.range(rows).select(F.when(F.col("id") > 20, F.floor(F.col("id") / 3)).alias("doc_id"), F.lit("x").alias("text"))
    got = collections.defaultdict(list)
    for r in sharding.assign(d, shards, vnodes=vnodes).collect():
        got[r.doc_id].append((r.shard, r.slot))
    at = d.groupBy("doc_id").agg(F.count("*").alias("n"), F.first(F.crc32("text")).alias("crc"))
    at = at.withColumn("h", F.xxhash64("doc_id", "crc", F.lit(9).cast("long"))).withColumn("rank", F.xxhash64(F.lit("rank"), "h")).collect()
    points, owner = sharding.ring(shards, vnodes)
    arcs = [[] for _ in points]
    for r in at:
        p = (r.h % (1 << 64)) >> (64 - sharding.BITS)
        arcs[next((i for i, x in enumerate(points) if x >= p), 0)].append(r)
    queues = []
    for rs in arcs:
        rs.sort(key=lambda r: r["rank"] % (1 << 64) if len(rs) > 2048 else r["rank"])
        queues.append([r.doc_id for r in rs for _ in range(r.n)])
    free, want, slot = sharding.capacities(rows, shards), collections.defaultdict(list), [0] * shards
    for step in range(len(points)):
        for a, q in enumerate(queues):
            s = owner[(a + step) % len(points)]
            while q and free[s]:
                want[q.pop(0)].append((s, slot[s]))
                free[s], slot[s] = free[s] - 1, slot[s] + 1
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_most_rows_stay_when_a_shard_is_added(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a = {r.doc_id: r.shard for r in sharding.assign(d, 24).collect()}
    b = {r.doc_id: r.shard for r in sharding.assign(d, 25).collect()}
    moved = sum(a[k] != b[k] for k in a) / len(a)
    assert 1 / 25 <= moved < 0.35
    points, owner = sharding.ring(24)
    assert len(points) == len(owner) == 24 * sharding.VNODES


def test_equal_rows_fill_several_shards(spark):
    d = spark.range(1000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    n = collections.Counter(r.shard for r in sharding.assign(d, 3).collect())
    assert sorted(n.values()) == [333, 333, 334]


# ---------------------------------------------------------------- vectors


def vectors(spark, rng, n=300, d=16):
    x = rng.standard_normal((n, d))
    for i in range(40):
        x[200 + i] = x[i % 5] + 0.15 * rng.standard_normal(d)
    x[250], x[251], x[252] = x[3], 2 * x[3], -x[3]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(900, None), (901, [0.0] * d), (902, [float("nan")] * d), (903, [float("inf")] + [1.0] * (d - 1)), (904, []), (905, [1.0, 2.0]), (906, [None] + [1.0] * (d - 1))]
    return x, spark.createDataFrame([(*r, 5, 1) for r in rows], "vec_id long, embedding array<double>, label int, cls long")


@pytest.mark.parametrize("block", [1024, 7])
def test_embedding_links_match_brute_force(spark, block):
    x, d = vectors(spark, np.random.default_rng(2))
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(d, 0.9, block=block).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    for i in range(len(x)):
        assert got[i].n_links == near[i].sum()
    seen = {}
    for i in range(len(x)):
        edge, part = [i], {i}
        while edge:
            for j in np.flatnonzero(near[edge.pop()]).tolist():
                if j not in part:
                    part.add(j)
                    edge.append(j)
        seen[i] = min(part)
    assert all(got[i].component_id == seen[i] and got[i].kept == (seen[i] == i) for i in seen)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 907))
    assert embed_dedup.near_duplicates(d.limit(0), 0.9).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 12))
    y = embed_dedup.rotated(x, 3)
    assert y.shape == (5, 16) and np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))


def test_nearest_neighbours(spark):
    x, d = vectors(spark, np.random.default_rng(4))
    got = ann.search(d, k=5, every=20, centroids=4, least=10**6, block=50).collect()
    s = x @ x.T
    for q in range(0, 300, 20):
        rows = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        want = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[q, i], i))[:5]
        assert [r.vec_id for r in rows] == want and [r.rank for r in rows] == [1, 2, 3, 4, 5]
        assert np.allclose([r.score for r in rows], s[q, want], atol=1e-12)
    assert not {r.query_id for r in got} - set(range(300))
    assert ann.search(d.limit(0)).count() == 0
    few = ann.search(d.where("vec_id in (20, 21, 900)"), k=5).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(20, 21)]


def test_nearest_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[3000:3100] = x[40]  # a large group of equal vectors, next to query 40
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(d, k=20, every=200).orderBy("rank").collect():
        got[r.query_id].append(r.vec_id)
    hit = n = 0
    for q, ids in got.items():
        s = x @ x[q]
        s[q] = -9
        want = set(np.lexsort((np.arange(6000), -s))[:20].tolist())
        hit, n = hit + len(want & set(ids)), n + 20
    assert hit / n >= 0.9


def test_neighbours_of_all_lengths_and_odd_ids(spark):
    rng = np.random.default_rng(16)
    rows = [(i, rng.standard_normal(2).tolist()) for i in range(30)] + [(40 + i, rng.standard_normal(3).tolist()) for i in range(3)]
    rows += [(None, [1.0, 2.0]), (20, rows[20][1]), (60, [1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4).orderBy("query_id", "rank").collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.query_id].append((r.vec_id, r.score))
    assert set(by) == {0, 20, 40}
    assert {v for v, _ in by[40]} == {41, 42} and all(len(by[q]) == 4 for q in (0, 20))
    x = dict(rows[:30])
    want = sorted((-np.dot(x[0], x[i]), i) for i in range(1, 30))
    want = sorted(want + [w for w in want if w[1] == 20])[:4]  # the id that is there twice is a candidate twice
    assert [v for v, _ in by[0]] == [i for _, i in want]
    assert 20 not in [v for v, _ in by[20]]
    with pytest.raises(ValueError):
        ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), centroids=64)


def test_share_falls_where_vectors_have_structure():
    rng = np.random.default_rng(17)
    centers = rng.standard_normal((40, 16))
    near = centers[rng.integers(0, 40, 4000)] + 0.05 * rng.standard_normal((4000, 16))
    even = rng.standard_normal((4000, 16))
    shares = []
    for x in (near, even):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        h1, h2 = ann.halves(x, 1.0)
        shares.append(ann.share_for(x, (ann.kmeans(h1, 16), ann.kmeans(h2, 16)), 1.0, 20, 0.95))
    assert shares[0] < 0.1 < shares[1] <= 1


def test_equal_scores_go_to_smaller_ids(spark):
    d = spark.createDataFrame([(i, [0.6, 0.8]) for i in range(300)], "vec_id long, embedding array<float>")
    got = ann.search(d, k=20, every=100, block=16).where("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20))


def test_heap_walks_pairs_in_order():
    rng = np.random.default_rng(8)
    d1, d2 = rng.random(7), rng.random(9)
    counts = np.ones((7, 9), np.int64)
    for enough in (1, 10, 40):
        met = ann.walk(d1, d2, counts, enough)
        cells = {(a, b) for a, bits in met.items() for b in range(9) if bits >> b & 1}
        want = sorted((d1[a] + d2[b], a, b) for a in range(7) for b in range(9))[:enough]
        assert cells == {(a, b) for _, a, b in want}


# ---------------------------------------------------------------- language and toxicity

LANGS = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "qrstuvwx"}


def lang_docs(spark, n=240):
    rng = random.Random(5)
    stems = {k: ["".join(rng.choice(v) for _ in range(rng.randrange(3, 8))) for _ in range(80)] for k, v in LANGS.items()}
    rows = [(i, " ".join(rng.choice(stems[k]) for _ in range(rng.randrange(5, 80))), k) for i in range(n) for k in [list(LANGS)[i % 3]]]
    return spark.createDataFrame([(*r, "x", 0.0) for r in rows], "doc_id long, text string, lang string, margin0 string, s double")


def test_language_is_told_apart(spark, odd, nothing):
    d = lang_docs(spark)
    model = langid.train(d.where("doc_id % 5 <> 0"))
    assert set(model) == set(LANGS)
    rows = langid.predict(d.where("doc_id % 5 = 0"), model).collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {100, 101, 102}
    assert all(got[i].rejected and got[i].score == 0 for i in (100, 101, 102))
    assert langid.predict(nothing, model).count() == 0
    assert langid.train(nothing) == {} and {r.lang_pred for r in langid.predict(d, {}).collect()} == {"und"}


def test_narrow_margins_are_rejected(spark):
    d = lang_docs(spark)
    model = langid.train(d)
    tie = spark.createDataFrame([(1, "zzzz"), (2, "abcdefgh abcdefgh")], "doc_id long, text string")
    rows = {r.doc_id: r for r in langid.predict(tie, model).collect()}
    assert rows[1].margin == 0 and rows[1].rejected


def test_language_matches_compression_with_each_dictionary(spark):
    import zstandard

    d = lang_docs(spark, 90)
    model = langid.train(d.where("doc_id < 45"))
    for r in langid.predict(d, model).collect():
        data, sizes = langid.plain(r.text), {}
        for lang, raw in model.items():
            c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(data[i : i + langid.CHUNK])) for i in range(0, len(data), langid.CHUNK))
        a, b = sorted(sizes.values())[:2]
        assert sizes[r.lang_pred] == a and abs(r.margin - (b - a) / b) < 1e-12 and r.rejected == (r.margin < langid.NARROW)


def test_no_language_is_left_out(spark):
    rows = [(i * 2 + j, f"{chr(0x4E00 + 7 * i)}{chr(0x4E01 + 7 * i)}" * 3, f"l{i}") for i in range(300) for j in range(2)]
    rows += [(9000, "q", "tiny"), (9001, "123", "numbers"), (None, "no id abc", "none"), (9002, None, "nothing")]
    rows += [(9003, f"copy {i % 4}", "same") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(d)
    assert set(model) == {f"l{i}" for i in range(300)} | {"tiny", "none", "same"}
    assert len(model["tiny"]) == 8
    rooms = langid.train(d, room=303 * 256)
    assert set(rooms) == set(model) and all(len(x) <= 256 for x in rooms.values())


def test_texts_without_letters_have_no_language(spark):
    d = spark.createDataFrame([(1, "\u0301\u0302"), (2, "12 ."), (3, "abc")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(d, {"aa": b"abc abc abc", "bb": b"xyz xyz xyz"}).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und", "und", "aa"]
    none = {r.doc_id: r.rejected for r in langid.predict(d, {}).collect()}
    assert none == {1: True, 2: True, 3: False}


def test_dictionaries_hold_pieces_of_whole_texts(spark):
    """Documents that begin with the same long foreign passage."""
    rng = random.Random(12)
    heading = " ".join(rng.choice("zyxwvuts") * rng.randrange(3, 8) for _ in range(900))
    own = lambda alphabet, n: " ".join("".join(rng.choice(alphabet) for _ in range(5)) for _ in range(n))
    rows = [(i, heading + " " + own(v, 2500), k) for i in range(128) for k, v in [list(LANGS.items())[i % 2]]]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for k, alphabet in list(LANGS.items())[:2]:
        assert len(model[k]) == langid.DICTIONARY
        assert sum(chr(x) in alphabet for x in model[k]) > 0.5 * len(model[k])
    data = b" ".join(b"w%04d" % i for i in range(5000))
    some = langid.spread(data, 3000)
    places = [int(w[1:]) for w in some.split() if len(w) == 5]
    assert len(some) == 3000 and min(places) < 1250 and max(places) > 3750
    assert sorted(langid.spread(data, len(data) + 1).split()) == sorted(data.split()) and langid.spread(b"", 9) == b""


def toxic_docs(spark, n=2400):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = text(rng, rng.randrange(5, 40)).split()
        bad = i % 6 == 0
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["scoundrel", "rascal", "villain"]))
        rows.append((i, " ".join(words), 9, "a"))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, y int, at string"), spark.createDataFrame([*labels, (5000, 1), (3, None), (None, 1)], "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark, odd, nothing):
    d, labels = toxic_docs(spark)
    model = toxicity.train(d.where("doc_id % 4 <> 2"), labels.where("doc_id % 4 <> 2 or doc_id is null"))
    rows = toxicity.score(d.where("doc_id % 4 = 2"), model).collect()
    assert {r.doc_id for r in rows if r.score >= 0.3} == {r.doc_id for r in rows if r.doc_id % 6 == 0}
    assert 0 < len(model[0]) < 1000  # L1 leaves few weights
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    empty = [r.score for r in got if not r.text]
    assert len(set(empty)) == 1 and empty[0] < 0.3
    assert toxicity.score(nothing, model).count() == 0
    none = toxicity.train(nothing, labels)
    assert all(r.score < 1e-300 for r in toxicity.score(d.limit(5), none).collect())


def test_toxicity_matches_scalar_ftrl(spark):
    rng = random.Random(14)
    rows = [(i, text(rng, rng.randrange(1, 9)) + (" rascal" if i % 3 == 0 else "")) for i in range(60)]
    rows += [(7, "another text of seven"), (7, "another text of seven"), (8, None)]
    labels = [(i, int(i % 3 == 0)) for i in range(60)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), bits=12, l1=0.4)
    import xxhash

    y = dict(labels)
    learned = sorted({(i, t) for i, t in rows}, key=lambda r: (xxhash.xxh3_64_intdigest(str(r[0])), len(toxicity.features(r[1], 12))))
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= 0.4 else (math.copysign(0.4, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for i, t in learned:
            at = [*toxicity.features(t, 12).tolist(), "bias"]
            w = {j: weight(j) for j in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y[i]
            for j in at:
                step = (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / toxicity.ALPHA
                z[j] += g - step * w[j]
                n[j] += g * g
    want = {j: weight(j) for j in z if j != "bias" and abs(z[j]) > 0.4}
    assert dict(zip(model[0].tolist(), model[1])).keys() == want.keys() and len(want) > 5
    assert all(abs(w - want[j]) < 1e-9 for j, w in zip(model[0].tolist(), model[1])) and abs(model[2] - weight("bias")) < 1e-9


def test_toxicity_of_repeated_ids_is_bounded(spark):
    d = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"))
    labels = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, toxic int")
    at, _, _ = toxicity.train(d, labels, sample=10, l1=0.01)
    assert 0 < len(at) <= 2 * 10
    at, _, _ = toxicity.train(d, labels, sample=1000, room=200, l1=0.01)
    assert 0 < len(at) <= 2 * 25  # two features of four bytes a text


def test_results_replace_columns_of_their_name(spark):
    d = spark.createDataFrame([(1, "abc def", 0.5, "x", True)], "doc_id long, text string, score double, lang_pred string, rejected boolean")
    out = toxicity.score(d, (np.zeros(0, np.int64), np.zeros(0), 0.0))
    assert sorted(out.columns) == sorted(d.columns) and out.first().score == 0.5
    out = langid.predict(d, {"aa": b"abc def ghi", "bb": b"zzz yyy xxx"})
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "margin", "rejected"] and out.first().lang_pred == "aa"


def test_toxicity_learns_from_all_labels_below_its_bound(spark):
    """15,000 labelled rows, of which the last 2,500 by the sample's hash alone hold the toxic words."""
    ids = spark.range(15_000).select(F.col("id").alias("doc_id"))
    late = ids.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id").desc()).limit(2500).withColumn("late", F.lit(True))
    d = ids.join(late, "doc_id", "left").select("doc_id", F.when(F.col("late"), "a scoundrel").otherwise("a friend").alias("text"), F.coalesce(F.col("late"), F.lit(False)).cast("int").alias("toxic")).cache()
    model = toxicity.train(d.select("doc_id", "text"), d.select("doc_id", "toxic"))
    asked = spark.createDataFrame([(1, "a scoundrel"), (2, "a friend")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(asked, model).collect()}
    assert got[1] > 0.9 and got[2] < 0.1
    assert toxicity.BITS == 22


def test_features_are_words_pairs_and_skips():
    two = set(toxicity.features("one two").tolist())
    assert set(toxicity.features("one").tolist()) < two
    a, b = (set(toxicity.features(t).tolist()) for t in ("one two three", "One, TWO three!"))
    assert a == b
    assert len(a) > len(two)
    assert len(toxicity.features(None)) == 0


# ---------------------------------------------------------------- LM scoring


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff_matches_counting(odd, order):
    got = sorted((r.doc_id, r.n_tokens, round(r.log_score, 4)) for r in lmscore.score(odd, order=order, block=2000).collect())
    rows = [(r.doc_id, words_of(r.text)) for r in odd.collect()]
    c = [collections.Counter(tuple(w[i : i + n]) for _, w in rows for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
    total, want = sum(c[0].values()), []
    for k, w in rows:
        s = 0.0
        for i in range(len(w)):
            most = min(order, i + 1)
            for n in range(most, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1 or c[n - 1][g] >= 2:
                    s += math.log(0.4) * (most - n) + math.log(c[n - 1][g] / (c[n - 2][g[:-1]] if n > 1 else total))
                    break
        want.append((k, len(w), round(s, 4)))
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    assert all(abs(g[2] - w[2]) <= 2e-4 for g, w in zip(got, sorted(want)))


def test_backoff_of_no_rows(nothing, odd):
    assert lmscore.score(nothing).count() == 0
    blank = lmscore.score(odd.where("doc_id in (100, 101, 102)")).collect()
    assert len(blank) == 3 and all(r.n_tokens == 0 and r.log_score == 0 and r.mean_log_score is None for r in blank)


def test_counts_do_not_saturate():
    for most in (3, 70_000, 1 << 32, 1 << 40):
        x = np.array([1, most, 2], np.int64)
        assert (lmscore.unpacked(lmscore.packed(x)) == x).all()
    assert len(lmscore.packed(np.array([1]))) == 3 and len(lmscore.unpacked(lmscore.packed(np.zeros(0, np.int64)))) == 0
    b = lmscore.Block([b"a b a b", b""])
    b.learn(1, np.array([1 << 40, 1 << 33]), 2)  # in the order of the hashes
    b.learn(2, np.array([1 << 35, 1 << 34]), 2)
    assert np.isfinite(b.scores(2, 0.4, 2, 1 << 41)).all() and {1 << 40, 1 << 33} == set(b.count[1].tolist())


def test_repeated_ids_and_rows_are_scored_each(spark):
    rng = random.Random(23)
    rows = [(None, text(rng, 20)) for _ in range(40)] + [(1, text(rng, 20)) for _ in range(40)] + [(2, "a b c d")] * 3000
    d = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = d.select(F.expr("pmod(xxhash64(doc_id, text), 64L)").alias("b")).groupBy("b").count().where("b is not null").count()
    assert blocks > 30
    got = lmscore.score(d, block=500, part=100).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows)
    n = 40 * 40 + 4 * 3000
    same = [r for r in got if r.doc_id == 2]
    assert len({r.log_score for r in same}) == 1 and abs(same[0].log_score - math.log(3000 / n)) < 1e-9


def test_byte_planes_round_trip():
    x = np.unique(np.random.default_rng(1).integers(0, 2**64 - 1, 1000, np.uint64))
    assert (lmscore.risen(lmscore.rising(x)) == x).all()
    assert len(lmscore.risen(lmscore.rising(x[:0]))) == 0


# ---------------------------------------------------------------- mixing


def powers(tokens, t):
    raw = [(x / max(tokens)) ** t for x in tokens]
    return [x / sum(raw) for x in raw]


def entropy(w):
    return -sum(x * math.log(x) for x in w)


def exponent(tokens, target, repetition):
    return mixing.exponent(lambda ts: [entropy(powers(tokens, t)) for t in ts], len(tokens), min(tokens), max(tokens), target, repetition)


def test_exponent_meets_its_limits():
    tokens = [1000, 100, 10]
    t = exponent(tokens, 0.9, 1e9)
    assert abs(entropy(powers(tokens, t)) - 0.9 * math.log(3)) < 1e-6
    t = exponent(tokens, 0.99, 1.5)
    reads = [w / n for w, n in zip(powers(tokens, t), tokens)]
    assert abs(max(reads) / min(reads) - 1.5) < 1e-6
    assert exponent([5, 5], 0.9, 4.0) == 1.0
    assert exponent([7], 0.9, 4.0) == 1.0


def test_weights_of_many_sources(spark):
    tokens = [10 + i % 977 for i in range(3000)]
    sizes = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(tokens)], "source string, source_tokens long")
    planned, t = mixing.plan(sizes, 0.997, 1e9)
    assert 0 < t < 1 and abs(entropy(powers(tokens, t)) - 0.997 * math.log(3000)) < 1e-6
    w = dict(zip((f"s{i}" for i in range(3000)), powers(tokens, t)))
    rows = planned.collect()
    assert len(rows) == 3000 and all(abs(r.weight - w[r.source]) < 1e-12 for r in rows)
    assert abs(min(r.quota for r in rows) - 1) < 1e-9


def test_mix_matches_brute_force(spark):
    """Order, passes and blocks of each copy, with repeated rows, null ids and null sources."""
    rng = random.Random(21)
    rows = [(i, "w " * rng.randrange(1, 9), rng.choice(["big"] * 8 + ["small", None])) for i in range(900)]
    rows += [(5, "w w", "big")] * 400 + [(None, "w w w", "small")] * 30 + [(None, "w", None)] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d, repetition=1.5).collect()
    quota = {r.source: r.quota for r in got}
    counted = collections.Counter((i, s, max(1, len(x.split()))) for i, x, s in rows)
    keys = spark.createDataFrame([(i, s, n, p) for (i, s, n) in counted for p in range(2)], "id long, source string, tokens long, p int")
    place = {(r.id, r.source, r.tokens, r.p): r.h for r in keys.withColumn("h", F.xxhash64(F.lit(7), "p", "id", "tokens")).collect()}
    want = collections.Counter()
    for s in quota:
        own = [(i, n, c) for (i, x, n), c in counted.items() if x == s]
        total = sum(n * c for _, n, c in own)
        for p in range(math.ceil(quota[s])):
            unsigned = len(own) > 2048
            at = 0
            for i, n, c in sorted(own, key=lambda r: place[r[0], s, r[1], p] % (1 << 64) if unsigned else place[r[0], s, r[1], p]):
                for _ in range(c):
                    if at < total * min(1.0, quota[s] - p) - 1e-9:
                        want[i, s, n, p, min(63, int((p * total + at) / (quota[s] * total) * 64))] += 1
                    at += n
    have = collections.Counter((r.doc_id, r.source, r.tokens, r["pass"], r.block) for r in got)
    assert have == want
    assert len({r.place for r in got if r.doc_id == 5}) == sum(v for k, v in want.items() if k[0] == 5)


def test_mix_places_quotas(spark, nothing):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.when(F.col("id") % 10 > 0, "big").when(F.col("id") % 20 > 0, "small").alias("source"))
    rows = mixing.mix(d, target=0.99, repetition=2.5).collect()
    n = collections.Counter(r.doc_id for r in rows)
    assert len(n) == 3000  # each row once at least
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    assert set(by) == {"big", "small", None}
    for rs in by.values():
        own = sum(r.tokens for r in rs if r["pass"] == 0)
        placed, quota = sum(r.tokens for r in rs), rs[0].quota
        assert own * quota - 1e-6 <= placed + 7 and placed <= own * quota + 7 * math.ceil(quota)
        blocks = collections.Counter()
        for r in rs:
            blocks[r.block] += r.tokens
        assert max(blocks.values()) <= placed / 64 + 8
    assert abs(sum({r.source: r.weight for r in rows}.values()) - 1) < 1e-9
    assert mixing.mix(nothing).count() == 0
    back = mixing.mixed_documents(d, target=0.99, repetition=2.5)
    assert back.columns == d.columns and back.count() == len(rows)


def test_mix_of_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()}
    assert mixing.mixed_documents(odd).columns == odd.columns


# ---------------------------------------------------------------- WARC


def pages(spark):
    rng = random.Random(11)
    rows = [(i, f"https://example.com/{i}", "<p>" + text(rng, rng.randrange(1, 400)) + "</p>") for i in range(80)]
    rows += [(100 + i, None, "<p>hot</p>") for i in range(40)] + [(200, "u", None), (201, "u\r\nX: y", ""), (202, "u", "é\r\n\r\n漢字 " * 5000), rows[3]]
    return spark.createDataFrame([(*r, b"x", "y") for r in rows], "page_id long, url string, html string, payload binary, sha string")


@pytest.mark.parametrize("split", [64, 1000, 1 << 25])
def test_warc_round_trip(spark, split):
    d = pages(spark).repartition(3)
    folder = scratch_path(spark, "warc-test")
    files = warc.write(d, folder).collect()
    rows = d.collect()
    assert sum(f.records for f in files) == len(rows)
    got = warc.read(spark, folder, split=split).collect()
    data = {r.page_id: (r.html or "").encode() for r in rows}
    keeper = {}
    for k, v in data.items():
        keeper[v] = max(k, keeper.get(v, -1))
    assert sorted(int(r.record_id) for r in got) == sorted(r.page_id for r in rows)
    for r in got:
        k = int(r.record_id)
        assert r.payload_bytes == len(data[k]) and r.payload_digest == base64.b32encode(hashlib.sha1(data[k]).digest()).decode()
        if keeper[data[k]] == k:
            assert r.record_type == "response" and r.payload == data[k] and r.refers_to is None
        else:
            assert r.record_type == "revisit" and int(r.refers_to) == keeper[data[k]]


def test_warc_false_magic_is_passed_over(spark, tmp_path):
    good = warc.record("response", "1", "u", warc.MAGIC * 50 + b"x", warc.digest(b""), None, 3)
    (tmp_path / "a.warc.gz").write_bytes(warc.MAGIC * 3 + b"noise" + good + warc.MAGIC + b"\0" * 7 + good)
    for split in (3, 50, 1 << 20):
        rows = warc.read(spark, f"file://{tmp_path}", split=split).collect()
        assert len(rows) == 2 and {r.payload for r in rows} == {warc.MAGIC * 50 + b"x"}


def test_warc_of_rows_without_ids(spark):
    """Groups of null ids only, of null and other ids, and one hot payload without bytes."""
    rows = [(None, "u", "<p>a</p>"), (None, "u", "<p>a</p>"), (None, "u", "<p>b</p>"), (7, "u", "<p>b</p>"), (5, "u", "<p>b</p>")] + [(1000 + i, "u", None if i % 2 else "") for i in range(500)]
    folder = scratch_path(spark, "warc-null")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7), folder)
    got = collections.Counter((r.record_id or None, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(spark, folder, split=700).collect())
    want = collections.Counter([(None, "response", None, 8)] * 2 + [(None, "revisit", "7", 8), ("7", "response", None, 8), ("5", "revisit", "7", 8), ("1499", "response", None, 0)] + [(str(1000 + i), "revisit", "1499", 0) for i in range(499)])
    assert got == want


def test_warc_of_no_pages(spark):
    folder = scratch_path(spark, "warc-none")
    warc.write(pages(spark).limit(0), folder)
    assert warc.read(spark, folder).count() == 0


# ---------------------------------------------------------------- packing


def test_packed_pieces_give_the_documents_back(spark, odd, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(odd, tokenizer_path()).collect()
    ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 2] for r in odd.collect()}
    times = collections.Counter(r.doc_id for r in odd.collect())
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for k, ps in pieces.items():
        cover = collections.Counter(i for p in ps for i in range(p.start, p.start + p.length))
        assert cover == collections.Counter({i: times[k] for i in range(len(ids[k]))})
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 4096
    assert set(pieces) == set(ids)
    assert packing.pack(nothing, tokenizer_path()).count() == 0


def test_encoder_matches_the_tokenizer():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    texts = ["Don't  stop\n\nnow", "a\tb\x0bc\x1cd", "<|startoftext|> x<|endoftext|>y", "é é İstanbul ΑΣ", "日本語 ☃ a☃b ♻", "", "12 345 !!!", " ́x", "   z"]
    enc.limit = 4  # tables turn over
    for _ in range(2):
        for t, got in zip(texts, enc.encode_batch(texts)):
            assert np.frombuffer(got, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_sum_of_squares_choice():
    """A piece of whole levels goes where the sum of squared counts is smallest: levels are exact, so no other choice may be better."""
    rng, p = random.Random(2), packing.Packer(64, 4)
    fills = {}
    ss = lambda c: int((c[1:16] ** 2).sum())
    for _ in range(3000):
        up, before = rng.randrange(1, 16), p.count.copy()
        w, offset = p.put(4 * up)
        assert offset == fills.get(w, 0) and offset + 4 * up <= 64
        fills[w] = offset + 4 * up
        least = []
        for h in range(0, 17 - up):
            if h and not before[h]:
                continue
            c = before.copy()
            c[h] -= bool(h)
            c[h + up] += h + up < 16
            least.append(ss(c))
        assert ss(p.count) == min(least)
    assert sum(fills.values()) / (64 * p.next) > 0.9


def test_pieces_of_any_length_fit():
    rng, p, fills = random.Random(3), packing.Packer(64, 4), {}
    for _ in range(3000):
        size = rng.randrange(1, 64)
        w, offset = p.put(size)
        assert offset == fills.get(w, 0) and offset + size <= 64
        fills[w] = offset + size


# ---------------------------------------------------------------- near duplicates


def brute(rows, size, percent):
    sets = {}
    for k, t in rows:
        w = [x for x in words_of(t)]
        n = min(size, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    root = {k: k for k in sets}
    keys = sorted(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def near_docs(rng, families=25):
    rows = []
    for f in range(families):
        base = text(rng, rng.randrange(20, 150)).split()
        for c in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 12)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("size,percent,block", [(3, 85, 512), (5, 80, 3), (3, 85, 2)])
def test_near_duplicates_match_brute_force(spark, size, percent, block):
    rows = near_docs(random.Random(size * percent))
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "one two"), (1005, rows[3][1].upper())]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, cls long, root long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(d, size, percent, block=block).collect()}
    assert got == brute(rows, size, percent)


def test_near_duplicates_without_ids_of_their_own(spark):
    rng = random.Random(31)
    base = [text(rng, 80) for _ in range(6)]
    near = [b + " w1" for b in base]
    rows = [(None, base[0]), (None, near[0])]  # only rows without an id
    rows += [(4, base[1]), (4, base[2]), (3, near[2]), (9, near[1])]  # an id with two texts
    rows += [(None, base[3]), (12, near[3])] + [(20, base[4])] * 5 + [(21, near[4])] * 2
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == collections.Counter([(None, None, True)] * 2 + [(4, 4, True), (9, 4, False), (4, 3, False), (3, 3, True), (None, 12, False), (12, 12, True)] + [(20, 20, True)] * 5 + [(21, 20, False)] * 2)


def test_large_neighbourhood_of_near_copies(spark):
    """Copies of one text that differ in a word each, chained so that the ends are not alike."""
    rng = random.Random(33)
    words, rows = text(rng, 60).split(), []
    for i in range(240):
        words[(i * 7) % 60] = f"n{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, text(rng, 60)) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(d, 3, 85, block=16).collect()}
    assert got == brute(rows, 3, 85)


def test_near_duplicates_of_odd_rows(odd, nothing):
    rows = minhash.near_duplicates(odd).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count()
    assert got[105].component_id == got[106].component_id == 5 and not got[105].kept and got[5].kept
    assert all(got[i].n_shingles == 0 and got[i].kept for i in (100, 101, 102))
    assert minhash.near_duplicates(nothing).count() == 0


def test_tensored_bands_and_intersections():
    s = [shingle_set(t, 3) for t in ("a b c d e f", "a b c d e g", "x y z", "a b c d e f")]
    want = np.array([[len(set(a.tolist()) & set(b.tolist())) for b in s] for a in s])
    got = minhash.intersections(s, width=2)
    assert (got[~np.eye(4, dtype=bool)] == want[~np.eye(4, dtype=bool)]).all()
    a, b = (minhash.bands(x, 5, 3) for x in (s[0], s[3]))
    assert (a == b).all() and len(a) == 10 and len(set(a.tolist())) == 10
    assert (1 - (1 - 0.85**3) ** minhash.groups_for(0.85)) ** 2 >= minhash.FOUND
