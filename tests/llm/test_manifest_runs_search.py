"""Manifest, runs and top-k search against brute force, and their edge cases."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import merkle, runs, topk_search

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def crc(n):
    return zlib.crc32(str(n).encode())


# manifest


def leaf_of(r, text):
    parts = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 8 * 8
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 8])))
        i //= 8
    return out


def manifest_by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
    trees = [tree([leaf_of(r, r["text"]) for r in groups[g]]) for g in order]
    crown = tree([t[-1][0] for t in trees])
    root, out = crown[-1][0] if order else None, []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            proof, text = path(trees[k], i) + path(crown, k), r["text"]
            if r["doc_id"] is not None and text is not None and crc(r["doc_id"]) % 3 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            h = leaf_of(r, text)
            for a, b in proof:
                h = H(a + h + b)
            out.append((r["doc_id"], trees[k][0][i], trees[k][-1][0], root, H("".join(a + b for a, b in proof)), h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n,langs", [(0, [None]), (1, ["en"]), (8, ["en"]), (9, [None]), (150, [None, "", "en", "é", "z", "￿", "\U0001f600"]), (600, ["en"] * 30 + [f"l{i}" for i in range(20)])])
def test_manifest_equals_trees_by_hand(spark, n, langs):
    rnd = random.Random(n)
    rows = [(rnd.choice([None, i, 7, 1 << 60 | i]), rnd.choice([None, "", "Ab É\tx", f"Text {i}"]), rnd.choice(langs), rnd.choice([None, "s"]), i) for i in range(n)]
    df = spark.createDataFrame(rows, DOC)
    got = sorted(map(tuple, merkle.manifest_table(df.repartition(3)).collect()), key=str)
    assert got == manifest_by_hand([r.asDict() for r in df.collect()])


def test_trees_of_many_stages_and_clashing_columns(spark):
    # blocks of 8 leaves: four stages below a subroot
    df = spark.range(2000).select(F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("root"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit(1).alias("Index"), F.lit(2).alias("i__"))
    one, four = (merkle.manifest(df, key="key", group="root", digest="leaf", levels=k).select("key", "subroot", "root", "index", "proof", "i__") for k in (1, 4))
    rows = {r.key: r for r in one.collect()}
    assert rows == {r.key: r for r in four.collect()} and len(rows) == 2000
    a = tree([H(str(i)) for i in range(2000) if i % 3])
    b = tree([H(str(i)) for i in range(2000) if i % 3 == 0])
    assert {r.root for r in rows.values()} == {tree([a[-1][0], b[-1][0]])[-1][0]}
    assert [(s.before, s.after) for s in rows[1999].proof] == path(a, sum(1 for i in range(1999) if i % 3)) + path([[a[-1][0], b[-1][0]], [0]], 0)
    assert one.where(merkle.fold(F.col("proof"), F.sha2(F.col("key").cast("string"), 256)) != F.col("root")).count() == 0


# runs


def runs_by_hand(w, exponent, least):
    out = {}
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 4)])
def test_runs_equal_brute_force(exponent, least):
    rnd, seen = random.Random(exponent), 0
    for _ in range(800):
        texts = []
        for _ in range(rnd.randint(1, 6)):
            k, w = rnd.choice([1, 2, 3, 5]), []
            for _ in range(rnd.randint(0, 5)):
                part = [bytes([97 + rnd.randrange(k)]) for _ in range(rnd.randint(1, 6))]
                w += (part * rnd.randint(1, 6))[: rnd.randint(1, 40)]
                if rnd.random() < 0.3:
                    w += w[-rnd.randint(1, 25) :]
                if rnd.random() < 0.3:
                    w.append(b"rare%d" % rnd.randrange(9))
            texts.append(w)
        want = [runs_by_hand(w, exponent, least) for w in texts]
        seen += sum(map(len, want))
        assert runs.runs_of(texts, exponent, least) == want
    assert seen > 800


def test_inner_runs_are_copied():
    # the second half is one LZ block that holds whole runs
    rnd = random.Random(8)
    part = [b for _ in range(30) for b in [b"w%d" % rnd.randrange(9999)] * rnd.choice([1, 1, 7])]
    assert runs.runs_of([part + [b"x"] + part], 4, 6) == [runs_by_hand(part + [b"x"] + part, 4, 6)]


def test_long_text_takes_time_in_proportion():
    rnd = random.Random(9)
    words = [b"w%d" % rnd.randrange(5000) for _ in range(60_000)]
    words[30_000:] = words[30_000:35_000] * 6
    assert runs.runs_of([words, [b"a"] * 100_000], 4, 6) == [[(30_000, 30_000, 5000)], [(0, 100_000, 1)]]


def test_runs_table(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([" ", "\n", "  ", "\t\x0b "]).join(rnd.choice("ab é".split(" ")) for _ in range(rnd.randint(0, 60)))) for i in range(250)]
    rows += [(None, None), (None, "a " * 8), (5, ""), (10, " \t"), (7, "a " * 20_000), (7, "a " * 20_000), (1 << 60, "b b b b b b")]
    got = [tuple(r) for r in runs.runs_table(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    want = []
    for key, text in rows:
        w = [x for x in (text or "").encode().split()]
        if key is not None and crc(key) % 10 == 0 and w:
            g = crc(key) // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        found = runs_by_hand(w, 4, 6) if len(w) < 10_000 else [(0, len(w), 1)]
        gone = {i for s, n, p in found for i in range(s + p, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        want.append((key, len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, H(lines), H(b" ".join(x for i, x in enumerate(w) if i not in gone).decode())))
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[1] > 0 for r in want) > 20


def test_runs_with_clashing_columns_and_no_rows(spark):
    df = spark.createDataFrame([("a a a a a a z", 1)], "text string, Runs int")
    assert [r.asDict(True) for r in runs.detect_runs(df).collect()] == [{"text": "a a a a a a z", "runs": [{"start": 0, "length": 6, "period": 1}], "collapsed": "a z"}]
    assert runs.runs_table(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# top-k search


def best_by_hand(rows, k):
    ok = [(i, key, [math.floor(1024 * float(x)) for x in v]) for i, (key, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, key, q in ok:
        if key is not None and key % 100 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), other is not None, other or 0) for j, other, v in ok if j != i)
            out += [(key, r + 1, o if there else None, -s) for r, (s, there, o) in enumerate(found[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("case", ["plain", "copies", "few", "large", "one", "empty"])
def test_top_k_equals_brute_force(spark, case):
    rnd = random.Random(case)
    v = lambda n=8: [rnd.gauss(0, 1e5 if case == "large" else 0.2) for _ in range(n)]
    rows = [(i, v()) for i in range({"few": 6, "one": 1, "empty": 0}.get(case, 401))]
    if case == "copies":
        same = v()
        rows = [(i, same if i % 3 else x) for i, x in rows] + [(300, same), (300, same), (200, rows[200][1]), (None, same), (None, v())]
    if case == "plain":
        rows += [(500, None), (501, [1.0, None] * 4), (600, [float("nan")] * 8), (601, [float("inf")] * 8), (700, []), (701, v(3)), (800, v(3)), ((1 << 60) + 1, v())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert sorted(map(tuple, topk_search.nearest_table(df).collect()), key=str) == best_by_hand(rows, 10)


def test_query_blocks_and_lists(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(6)], i) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    want = sorted(map(tuple, topk_search.nearest_table(df).collect()))
    monkeypatch.setattr(topk_search, "BLOCK_QUERIES", 2)
    for lists in (1, 3, 50):
        assert sorted(map(tuple, topk_search.top_k(df, queries=F.col("vec_id") % 100 == 0, lists=lists).collect())) == want
