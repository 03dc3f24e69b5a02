"""Line dedup, periodic runs and the prefix trie against brute force, and on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gneiss.llm import convtrie, linededup, queries, runs

CLASH = "row long, hi long, lo long, doc long, part long, words string, runs string, kept string, collapsed string, n_lines long"
CLASHING = [0, 0, 0, 0, 0, "w", "r", "k", "c", 7]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank and long texts, repeated rows, null and repeated ids, names that the operators use."""
    rng = random.Random(5)
    line = lambda k: f"  Line {k} of many that OTHERS share, too\t"
    rows = [(i, "\n".join(rng.choice([line(rng.randrange(12)), f"own {i} {rng.random()} of this text", "short", ""]) for _ in range(rng.randrange(1, 9)))) for i in range(40)]
    rows += [(90, None), (91, ""), (92, " \n\n \t"), (93, line(1) * 3000), (94, "\n".join(line(k % 12).upper() for k in range(4000))), (None, line(2)), (None, line(2) + "\n" + line(77)), rows[3], rows[3], (41, "\x1f\x85 " + line(3)), (94, line(3))]
    rows += [(100 + i, " ".join(f"w{rng.randrange(1 + i % 5)}" for _ in range(rng.randrange(60)))) for i in range(120)]
    rows += [(300, "a b " * 5000), (301, "x " * 5), (302, "x " * 6), (303, " ".join(f"v{i % 700}" for i in range(3500))), (304, "  ".join(["p"] * 8))]
    return spark.createDataFrame([(*r, *CLASHING) for r in rows], f"doc_id long, text string, {CLASH}")


# ---------------------------------------------------------------- lines


def brute_lines(rows, least=20, need=3):
    key = lambda x: (k := x.strip(" \t\n\x0b\x0c\r")) and "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
    held = collections.defaultdict(list)
    for doc_id, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least:
                held[k].append(-1 if doc_id is None else doc_id)
    gone = {k: max(ids) for k, ids in held.items() if len(ids) >= need}
    out = []
    for doc_id, text in rows:
        found = (text or "").split("\n")
        left = [x for x in found if gone.get(key(x), doc_id if doc_id is not None else -1) == (doc_id if doc_id is not None else -1)]
        out.append((doc_id, len(found), len(found) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches, fan", [(1, 2), (4, 2), (5, 3)])
def test_lines_match_brute_force(odd, batches, fan):
    out = linededup.dedup_lines(odd, batches=batches, fan=fan)
    assert set(out.columns) == set(odd.columns) | {"n_dropped"}
    rows = out.collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in rows), key=repr) == brute_lines([tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert {r.words for r in rows} == {"w"}


def test_no_documents_no_lines(odd):
    assert linededup.dedup_lines(odd.limit(0)).collect() == []


def test_runs_of_hashes_are_compacted_and_left_alone(spark):
    runs = linededup.LineRuns(spark, need=3, fan=2)
    batch = lambda ids: spark.createDataFrame([(h, 0, d) for h, d in ids], "hi long, lo long, doc long")
    runs.add(batch([(1, 9), (1, 8), (1, 7), (2, 5)]))
    runs.add(batch([(2, 6), (3, 1)]))
    assert [bool(x) for x in runs.levels] == [False, True]
    name = runs.levels[1][0]
    assert sorted(map(tuple, spark.table(name).collect())) == [(1, 0, 3, 9), (2, 0, 2, 6), (3, 0, 1, 1)]
    # 1 is settled: one more row with a smaller id changes nothing, and isn't added
    runs.add(batch([(1, 3), (2, 4), (3, None)]))
    assert sorted(spark.table(runs.levels[0][0]).toPandas().hi) == [2, 3]
    assert sorted(map(tuple, runs.repeated().collect())) == [(1, 0, 9), (2, 0, 6)]
    runs.drop()
    assert not spark.catalog.tableExists(name)


def test_joins_with_runs_do_not_shuffle_them(spark):
    runs = linededup.LineRuns(spark, fan=4)
    lines = spark.range(1000).select(F.xxhash64("id").alias("hi"), F.col("id").alias("lo"), F.col("id").alias("doc"))
    runs.add(lines)
    plan = runs.repeated()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    runs.drop()


# ---------------------------------------------------------------- runs


def brute_runs(w, least=6, times=4):
    out = []
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            m = i - s + p
            if i > s and m >= max(least, times * p) and not any(w[s + q : s + m] == w[s : s + m - q] for q in range(1, p)):
                out.append((s, m, p))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(w, found):
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_match_brute_force():
    rng = random.Random(11)
    for _ in range(60):
        docs = []
        for _ in range(rng.randrange(1, 9)):
            k, n = rng.choice([1, 2, 2, 3, 5, 30]), rng.randrange(90)
            w = [b"w%d" % rng.randrange(k) for _ in range(n)]
            for _ in range(rng.randrange(3)):
                a, p = rng.randrange(n + 1), rng.randrange(1, 9)
                w[a:a] = w[a : a + p] * rng.randrange(2, 7)
            docs.append(w)
        found = runs.find_runs(docs)
        assert found == [brute_runs(w) for w in docs]
        assert [runs.collapsed(w, r) for w, r in zip(docs, found)] == [brute_collapsed(w, r) for w, r in zip(docs, found)]


def test_runs_of_odd_documents(odd):
    out = runs.periodic_runs(odd)
    assert sorted(out.columns) == sorted({*odd.columns, "strongest"})
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed) for r in out.collect()), key=repr)
    want = []
    for doc_id, text in odd.select("doc_id", "text").collect():
        w = (text or "").encode().split()
        found = runs.find_runs([w])[0] if len(w) > 2000 else brute_runs(w)
        want.append((doc_id, found, runs.strongest(found), brute_collapsed(w, found).decode()))
    assert got == sorted(want, key=repr)
    by = {g[0]: g for g in got}
    assert by[300][1] == [(0, 10000, 2)] and by[300][3] == "a b" and by[301][1] == [] and by[302][1] == [(0, 6, 1)]
    assert by[303][1] == [(0, 3500, 700)] and by[303][3] == " ".join(f"v{i}" for i in range(700))


def test_strongest_is_exact():
    assert runs.strongest([]) is None
    assert runs.strongest([(5, 9, 2), (0, 13, 3), (2, 9, 2)]) == (2, 9, 2)
    big = 10**9
    assert runs.strongest([(0, 4 * big + 5, big + 1), (1, 4 * big + 1, big)]) == (1, 4 * big + 1, big)
    assert runs.periodic_runs.__defaults__[1:] == (6, 4)


def test_op12_on_rewritten_documents(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(rng.randrange(0, 200)))) for i in range(150)] + [(150, None), (151, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    some = 0
    for doc_id, text in rows:
        w = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute_runs(w)
        some += bool(found)
        best = runs.strongest(found) or (None, None, None)
        assert tuple(got[doc_id])[:6] == (doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2])
        assert got[doc_id].runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in found).encode()).hexdigest()
        assert got[doc_id].collapsed_sha256 == hashlib.sha256(brute_collapsed(w, found)).hexdigest()
    assert some > 5 and len(got) == len(rows)


# ---------------------------------------------------------------- conversations


def brute_trie(paths):
    """paths: conversation -> list of turns (role, text)."""
    nodes = collections.defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    kids = collections.Counter(n[:-1] for n in nodes if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(members) - 1) * len(n[-1][1]) if n else 0
    out = []
    for n, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(n))))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), kids[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt(rows):
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in by.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + t[h:]
    return out


def talk(seed, n, most):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(450), n):
        rows += [(c, k if k else None, rng.choice(["user", None, "bot"]), rng.choice(["", None, "hi", "ÄÖ text", "a longer turn"])) for k in range(rng.randrange(1, most))]
    return rows


@pytest.mark.parametrize("seed, n, most, step, size, parts", [(1, 150, 6, 2, 8, 5), (2, 200, 4, 64, 1 << 16, 1), (3, 60, 30, 3, 2, 7), (4, 120, 12, 1, 1, 3)])
def test_trie_matches_brute_force(spark, seed, n, most, step, size, parts):
    rows = talk(seed, n, most)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, row long, key long").repartition(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        turns = convtrie.turn_rows(df)
        convs = turns.select("conv").distinct()
        got = convtrie.prefix_trie(queries._shared_starts(turns, convs), convs, step=step, size=size).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got), key=repr) == brute_trie(rebuilt(rows))


def test_trie_of_one_giant_and_many_equal_conversations(spark):
    giant = [(1, k, "user", f"turn {k % 50}") for k in range(4000)]
    rows = giant + [(2, k, r, t) for _, k, r, t in giant[:700]] + [(c, k, "user", f"turn {k}") for c in range(10, 90) for k in range(3)] + [(None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    turns = convtrie.turn_rows(df)
    order = turns.select("conv", F.col("turn").alias("order"), "key", "chars")
    got = convtrie.prefix_trie(order, turns.select("conv").distinct(), size=16).collect()
    paths = collections.defaultdict(list)
    for c, _, r, t in rows:
        if c is not None:
            paths[c].append((r, t))
    nodes = {(r.conv_id, r.depth): r for r in got}
    assert len(got) == len(nodes) == 4001
    assert nodes[1, 0].n_convs == nodes[1, 1].n_convs == nodes[1, 3].n_convs == 82 and nodes[1, 4].n_convs == 2 and nodes[1, 701].n_convs == 1
    assert nodes[1, 3].ends_sha256 == hashlib.sha256(",".join(map(str, range(10, 90))).encode()).hexdigest()
    assert nodes[1, 700].ends_sha256 == hashlib.sha256(b"2").hexdigest() and nodes[1, 0].n_leaves == 1
    assert nodes[1, 0].saved_tokens == 81 * 18 + sum(len(t) for _, t in paths[2][3:])


def test_trie_without_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    turns = convtrie.turn_rows(spark.createDataFrame([], schema))
    assert convtrie.prefix_trie(turns.withColumnRenamed("turn", "order"), turns.select("conv")).collect() == []
    some = spark.createDataFrame([(5,), (3,)], "conv long")
    assert [tuple(r) for r in convtrie.prefix_trie(turns.withColumnRenamed("turn", "order"), some).collect()] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]


def test_pieces_of_ends_are_joined(spark):
    members = spark.range(1000).select(F.col("id").alias("conv"), (F.col("id") % 3).alias("rep"))
    got = dict(map(tuple, convtrie.ends_digests(members, piece=7).collect()))
    assert got == {k: hashlib.sha256(",".join(map(str, range(k, 1000, 3))).encode()).hexdigest() for k in range(3)}


def test_nearest_smaller_values():
    rng = random.Random(4)
    for _ in range(50):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 30))]
        left, right, _ = convtrie.spans(a)
        m = convtrie.Minima(a)
        for i, x in enumerate(a):
            assert left[i] == m.before(i, x) == max((k for k in range(i) if a[k] < x), default=-1)
            assert right[i] == m.after(i, x) == min((k for k in range(i, len(a)) if a[k] < x), default=len(a))
