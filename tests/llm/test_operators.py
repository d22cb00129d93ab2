"""The training-data operators against brute force, and their edge cases."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import automaton, byte_bpe, chat_format, decontamination, exact_dedup, license_scan, ngram_join, perfect_hash, quality_rules, secret_scan, sharding, token_files

DOCS = "doc_id long, text string"
EDGES = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (5, "one two"), (6, "é ü　中"), (7, "word " * 30_000)]


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# secrets


BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def base_spans(text):
    return [(k, a, e) for a, i, e, k in sorted((m.start(), i, m.end(), k) for i, (k, r, ok) in enumerate(BASE) for m in r.finditer(text) if ok(m))]


def test_secret_spans_match_regular_expressions():
    rnd = random.Random(1)
    parts = ["token", "TOKEN", "apikey", "Api_Key", "passwd", "=", ":", " ", '"', "'", "abcdef", "ab", "AKIA", "A" * 8, "0123456789", "é", "\n", "deadbeef", "==", "x", "secret", "password:", "Z9", "."]
    for _ in range(4000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        got = [s for s in secret_scan.scan(t, secret_scan.BASE_RULES + secret_scan.MORE_RULES) if s[0] in ("assign", "access", "hex")]
        assert got == base_spans(t), t


def test_dropped_matches_still_consume():
    assert secret_scan.scan("token:token:abcdefg", secret_scan.BASE_RULES) == []


def test_automaton_is_minimal_and_longest():
    d = automaton.build([("ab|ab*c?", False)])
    assert automaton.longest(d, b"xabbbc", 1, 0) == 6 and automaton.longest(d, b"xabbbc", 0, 0) == -1
    assert len(automaton.build([("(a|b)*abb", False)]).rows) == 5  # four states, and one for other bytes


def test_secret_digest_edges(spark):
    got = secret_scan.secret_digest(docs(spark, EDGES)).collect()
    assert len(got) == len(EDGES) and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.spans == "" for r in got)
    clash = docs(spark, [(1, "token=abcdef1", "mine")], DOCS + ", secrets string")
    assert secret_scan.scan_secrets(clash).first().secrets[0].kind == "assign"
    assert secret_scan.redact(docs(spark, [(1, "é token=abcdef1 z"), (2, None)])).orderBy("doc_id").collect()[0].text == "é [assign] z"
    assert secret_scan.secret_digest(docs(spark, [])).count() == 0


# sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 1000, 4097])
def test_feistel_is_a_permutation(n):
    p = sharding.permute(np.arange(n), n, 5)
    assert sorted(p) == list(range(n)) and (sharding.unpermute(p, n, 5) == np.arange(n)).all()


def test_shards_are_even_and_computable(spark):
    rows = [(i, f"t{i}") for i in range(101)] + [(5, "t5"), (None, None)]
    got = sharding.shard_table(docs(spark, rows), shards=16).collect()
    n = Counter(r.shard for r in got)
    assert len(got) == 103 and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    assert sorted(r.row_number for r in got) == list(range(103))
    for r in got:
        assert sharding.locate(r.row_number, 103, 16, 17) == (r.shard, r.slot) and sharding.row_at(r.shard, r.slot, 103, 16, 17) == r.row_number
    assert next(r for r in got if r.doc_id == 7).text_crc32 == zlib.crc32(b"t7") and next(r for r in got if r.doc_id is None).size == 1
    assert sharding.shard_table(docs(spark, [])).count() == 0
    clash = sharding.shard_rows(docs(spark, [(1, "a", 9)], DOCS + ", shard int"), shards=2, order=["doc_id"])
    assert clash.columns.count("shard") == 1


# exact dedup


def brute_dedup(rows):
    groups = {}
    for k, t in rows:
        h = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
        groups.setdefault(h, []).append(k)
    return groups


@pytest.mark.parametrize("bits", [exact_dedup.MAX_FILTER_BITS, 0])
def test_exact_dedup(spark, bits):
    rows = EDGES + [(i, f"copy  {i % 7}\n") for i in range(20, 90)] + [(i, f"alone {i}") for i in range(100, 140)] + [(None, "copy 3 "), (None, "lost"), (None, "lost")]
    got = exact_dedup.dedup_digests(docs(spark, rows), max_filter_bits=bits).collect()
    groups = brute_dedup(rows)
    assert len(got) == len(rows)
    for r in got:
        g = groups[r.text_sha256]
        assert r.group_size == len(g) and r.keep_id == min((k for k in g if k is not None), default=None)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == Counter({h: 1 for h in groups})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_by_ranges_with_clashing_columns(spark):
    schema = DOCS + ", gk__ int, gn__ int, rn__ int, hash__ int, key__ int, TEXT_SHA256 string, keep_id int"
    df = docs(spark, [(i, f"t{i % 50}", 1, 2, 3, 4, 5, "x", 6) for i in range(90)] + [(7, "t7", 1, 2, 3, 4, 5, "x", 6), (None, None, *[None] * 7)], schema)
    for bits in (256, exact_dedup.MAX_FILTER_BITS):
        got = exact_dedup.exact_dedup(df, max_filter_bits=bits)
        assert sorted(got.columns) == sorted(["doc_id", "text", "gk__", "gn__", "rn__", "hash__", "key__", "text_sha256", "keep_id", "group_size", "kept"])
        got = got.collect()
        assert len(got) == 92 and sum(r.kept for r in got) == 51 and all((r.gk__, r.hash__) == (1, 4) for r in got if r.doc_id is not None)
        assert sorted(r.group_size for r in got if r.text == "t7") == [3, 3, 3]


def test_hash_ranges_cover_all_numbers():
    for n in (1, 2, 7, 1000):
        r = list(exact_dedup.hash_ranges(n))
        assert len(r) == n and r[0][0] == -(1 << 63) and r[-1][1] == (1 << 63) - 1 and all(a[1] + 1 == b[0] for a, b in zip(r, r[1:]))


def test_exact_dedup_keeps_columns(spark):
    df = docs(spark, [(1, "a", "x"), (2, "a", "y"), (3, "b", None)], DOCS + ", Kept string")
    out = exact_dedup.exact_dedup(df)
    assert out.where("kept").count() == 2 and [c.lower() for c in out.columns].count("kept") == 1
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


# quality


def test_rules_as_a_column_equal_rules_as_python(spark):
    rnd = random.Random(14)
    texts = [None, "", "A", "|| !! ##", *(" ".join(rnd.choice(["the", "CAT", "runs.", "x|y", "!!", "7", "é"]) for _ in range(rnd.randint(1, 80))) for _ in range(150))]
    rules = tuple((rnd.uniform(-2, 2), tuple((rnd.choice(quality_rules.STATS), rnd.uniform(0, 1.5), rnd.random() < 0.5) for _ in range(rnd.randint(1, 3)))) for _ in range(25))
    model = quality_rules.RuleModel(0.3, rules)
    for r in quality_rules.score_quality(docs(spark, list(enumerate(texts))), model).collect():
        stats = dict(zip(quality_rules.STATS, quality_rules.text_stats(r.text)))
        total = 0.3 + sum(w for w, cs in rules if all((stats[k] <= at) == most for k, at, most in cs))
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9 and r.predicted == int(r.score >= 0.3)


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_rules.quality_table(documents, labels).collect()}
    truth = [(r.quality, got[r.doc_id].score) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [s for q, s in truth if q == 1], [s for q, s in truth if q == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert len(truth) > 40 and auc > 0.85


def test_quality_keeps_a_column_of_its_own_name(spark):
    df = docs(spark, [(1, "some text", 7)], DOCS + ", stats__ int")
    assert quality_rules.score_quality(df, quality_rules.RuleModel(0.0)).first().stats__ == 7


def test_quality_learns_and_scores_all(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["the", "cat", "runs", "home."]) for _ in range(40)) if i % 3 else " | ".join(rnd.choice(["X!", "Y##", "$$"]) for _ in range(40))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(500)] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = quality_rules.quality_table(docs(spark, rows + EDGES), labels).collect()
    assert len(got) == len(rows) + len(EDGES) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 10]
    assert held and all(r.predicted == int(r.doc_id % 3 > 0) for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_rules.quality_table(docs(spark, EDGES), none).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1), (5, 1)], "doc_id long, quality int")
    assert all(r.score >= 0.5 for r in quality_rules.quality_table(docs(spark, EDGES), one).collect())


# decontamination


def brute_overlap(text, item):
    """Word by word: 13 words with at most 2 others, a shorter item with a fifth, under 8 words none, under 5 never."""
    a, b = (re.findall(r"\w+", t.lower()) for t in (text or "", item or ""))
    if len(b) < 5:
        return False
    w = min(13, len(b))
    e = 0 if len(b) < 8 else {8: 1, 9: 1, 10: 2, 11: 2, 12: 2, 13: 2}[w]
    return any(sum(x != y for x, y in zip(a[i:i + w], b[j:j + w])) <= e for i in range(len(a) - w + 1) for j in range(len(b) - w + 1))


def test_masks_lose_no_allowed_stretch():
    for n in range(decontamination.EXACT_BELOW, decontamination.WINDOW + 1):
        w, e = decontamination.allowed(n)
        for bad in itertools.combinations(range(w), e):
            assert any(not {o + i for i in m} & set(bad) for m in decontamination.seeds(n) for o in range(w - m[-1])), (n, bad)


def test_decontamination_matches_brute_force(spark, monkeypatch):
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(n))) for i, n in enumerate([3, 5, 6, 8, 10, 13, 20, 40, 40])] + [(None, "p q r s t u v w"), (8, None)]
    rows = []
    for i in range(400):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]
        it = (items[rnd.randrange(9)][1]).split()
        a = rnd.randrange(len(it))
        part = [rnd.choice(vocab) if rnd.random() < 0.15 else x for x in it[a:a + rnd.randint(3, 20)]]
        at = rnd.randint(0, len(w))
        rows.append((i, " ".join(w[:at] + part + w[at:])))
    rows += EDGES + [(900, "a P q, r s t u v w b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "SEED_PAIRS", 20)
    for most in (27, 16):
        monkeypatch.setattr(decontamination, "MOST_BITS", most)
        got = decontamination.mark_contaminated(docs(spark, rows), bench).collect()
        assert len(got) == len(rows)
        for r in got:
            hit = [i for i, t in items if brute_overlap(r.text, t or "")]
            assert r.contamination.contaminated == bool(hit), (r.doc_id, hit)
            assert list(r.contamination.item_ids) == sorted(i for i in hit if i is not None)
    empty = bench.where("false")
    assert decontamination.drop_contaminated(docs(spark, EDGES), empty).count() == len(EDGES)


def test_decontamination_of_repeated_words_and_clashing_columns(spark):
    bench = spark.createDataFrame([(1, "a " * 500), (2, "b " * 40 + "c")], "item_id long, text string")
    df = docs(spark, [(1, "a " * 8000, 1, 2, 3, 4), (2, "b " * 3000, 1, 2, 3, 4), (3, "a b " * 50, 1, 2, 3, 4)], DOCS + ", doc__ int, ids__ int, share__ int, contamination int")
    got = {r.doc_id: r.contamination.item_ids for r in decontamination.mark_contaminated(df, bench).collect()}
    assert got == {1: [1], 2: [2], 3: []}
    assert [r.doc_id for r in decontamination.drop_contaminated(df, bench).collect()] == [3]


# n-gram join


def word_sets(text, n):
    """Shingles as tuples of words, without the module's numbers."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[ \t-\r]+", low) if x]
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def brute_components(rows, n, percent):
    sets = [word_sets(t, n) for _, t in rows]
    parent = {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = root(rows[i][0]), root(rows[j][0])
            parent[max(a, b)] = min(a, b)
    return {(k, len(s), root(k)) for (k, _), s in zip(rows, sets)}


@pytest.mark.parametrize("n,percent,most", [(3, 90, None), (5, 80, None), (2, 70, 0), (2, 80, 16), (1, 60, 6)])
def test_components_match_brute_force(spark, monkeypatch, n, percent, most):
    monkeypatch.setattr(ngram_join, "FREQUENT", 5)
    rnd = random.Random(n * percent)
    rows = []
    for base in range(12):
        words = [f"b{base}w{i}" for i in range(rnd.choice([2, 4, 9, 14, 25, 60]))]
        for _ in range(rnd.randint(1, 9)):
            w = list(words)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(50)}"
            if rnd.random() < 0.4:
                w += [f"y{rnd.randrange(9)}" for _ in range(rnd.randint(1, 3))]
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(20))
    rows += [(500 + i, f"{passage} own{i} a{i} b{i} c{i}") for i in range(8)]
    rows += [(700, None), (701, ""), (702, " \n"), (703, "A b"), (704, "a B"), (705, "É b"), (706, "é b")]
    rnd.shuffle(rows)
    got = ngram_join.jaccard_components(docs(spark, rows), n=n, percent=percent, most=most).collect()
    assert {tuple(r) for r in got} == brute_components(rows, n, percent) and len(got) == len(rows)


def test_signatures_never_differ_in_more_bits_than_shingles():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        a = rnd.integers(-(1 << 62), 1 << 62, rnd.integers(1, 400))
        b = np.unique(np.concatenate([a[rnd.random(len(a)) < 0.9], rnd.integers(-(1 << 62), 1 << 62, rnd.integers(0, 30))]))
        bits = int(np.bitwise_count((ngram_join.signature(np.unique(a)) ^ ngram_join.signature(b)).view(np.uint64)).sum())
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))


def test_chains_need_few_rounds(spark, monkeypatch):
    from textloom.llm import components as C

    names = []
    plain = C.written
    monkeypatch.setattr(C, "written", lambda df, name: names.append(name) or plain(df, name))
    chain = [*range(2, 101), 1]
    got = C.components(spark.createDataFrame(list(zip(chain, chain[1:])), "a long, b long")).collect()
    assert {tuple(r) for r in got} == {(i, 1) for i in range(1, 101)} and names.count("grandparents") <= 8


def test_shared_sentences_make_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 20)
    rnd = random.Random(9)
    shared = [" ".join(f"s{i}w{j}" for j in range(12)) for i in range(60)]
    seen = []
    plain = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda docs_, sets, pairs, n, percent: seen.append(pairs.count()) or plain(docs_, sets, pairs, n, percent))
    rows = [(i, " ".join(rnd.sample(shared, 10))) for i in range(400)]
    got = ngram_join.jaccard_components(docs(spark, rows), n=3, percent=90).collect()
    assert {tuple(r) for r in got} == brute_components(rows, 3, 90)
    # two passes over pivots, with fewer pairs than entries; of all pairs of a list none is left
    assert len(seen) == 3 and max(seen) < 400 * 12 and seen[-1] == 0


def test_large_keys_beside_a_null_one(spark):
    big = 1 << 60
    rows = [(big + 1, "one two three four"), (big + 2, "five six seven eight"), (None, "nine ten eleven twelve")]
    got = ngram_join.jaccard_components(docs(spark, rows).coalesce(1), n=3, percent=90).collect()
    assert {tuple(r) for r in got} == {(big + 1, 2, big + 1), (big + 2, 2, big + 2), (None, 2, None)}


def test_keep_one_with_clashing_columns(spark):
    df = docs(spark, [(1, "a b c d e f g", 5), (2, "a b c d e f g", 6)], DOCS + ", gone__ int")
    assert [tuple(r) for r in ngram_join.keep_one(df).collect()] == [(1, "a b c d e f g", 5)]


def test_components_edges(spark):
    got = ngram_join.jaccard_components(docs(spark, EDGES + [(None, "one two"), (None, "lost words here")]), n=3, percent=90).collect()
    assert len(got) == len(EDGES) + 2
    assert sorted(r.component_id for r in got if r.n_shingles == 1 and r.component_id == 5) == [5, 5, 5]
    assert ngram_join.jaccard_components(docs(spark, []), n=3, percent=90).count() == 0
    kept = ngram_join.keep_one(docs(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "other"), (3, "other")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


# byte-level BPE


RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference_bpe():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_library(reference_bpe):
    rnd = random.Random(2)
    parts = ["a", "the ", "  ", "\n", "\t", "'s", "é", "x", "1", "²", "\x1c", "\xa0", "　", " ", "!?", "中", "🙂", "\r\n", "A" * 50, "don't", " \n ", "ǅ", "\x00"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(1500)] + ["a" * 3000, "xyz" * 900, "", "   ", "\n\n", " a", "a "]
    for t, (ids, decoded) in zip(texts, byte_bpe.encode_texts(texts, RANKS, P.PATTERN)):
        assert np.frombuffer(ids, "<u4").tolist() == reference_bpe.encode_ordinary(t), t
        assert decoded == t.encode()


def test_bpe_rows(spark, reference_bpe):
    got = byte_bpe.bpe_digest(docs(spark, EDGES), path=RANKS, pattern=P.PATTERN).collect()
    want = Counter((k, len(reference_bpe.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in EDGES)
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got) == want
    out = byte_bpe.encode(docs(spark, [(1, "hello", "x"), (2, None, "y")], DOCS + ", ids string"), path=RANKS, pattern=P.PATTERN).orderBy("doc_id").collect()
    assert out[0].ids == reference_bpe.encode_ordinary("hello") and bytes(out[0].decoded) == b"hello" and out[1].ids == []


def test_bpe_of_long_words(reference_bpe):
    rnd = random.Random(12)
    coder = byte_bpe.WordCoder(RANKS, P.PATTERN)
    words = ["a" * 3000, "ab" * 900, "".join(rnd.choice("etaoinshr") for _ in range(3000)), "".join(rnd.choice("中文字符编码测试") for _ in range(400)), "".join(rnd.choice("ab") for _ in range(700)), "é" * 300, "a" * 201, "=" * 999]
    for w, ids in zip(words, coder.words(words)):
        assert np.frombuffer(ids, "<u4").tolist() == reference_bpe._encode_single_piece(w)


def test_windows_agree_on_any_vocabulary(tmp_path, monkeypatch):
    rnd = random.Random(13)
    for case in range(6):
        tokens = {bytes([i]) for i in range(256)}
        while len(tokens) < 300:  # not trained: tokens of any order, with gaps between their parts
            tokens.add(bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 5))))
        order = sorted(tokens, key=lambda t: (len(t) > 1, rnd.random()))
        (path := tmp_path / f"{case}.tiktoken").write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(order)))
        enc = tiktoken.Encoding("x", pat_str="(?s:.+)", mergeable_ranks={t: i for i, t in enumerate(order)}, special_tokens={})
        words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 60))) for _ in range(60)]
        for window, step in ((64, 32), (16, 8), (6, 3)):
            monkeypatch.setattr(byte_bpe, "WINDOW", window)
            monkeypatch.setattr(byte_bpe, "STEP", step)
            for w, ids in zip(words, byte_bpe.WordCoder(str(path), "(?s:.+)").words(words)):
                assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(w), (window, w)


def test_large_vocabulary(tmp_path):
    order = [bytes([i]) for i in range(256)] + [bytes([97 + a, 97 + b]) for a in range(26) for b in range(26)] + [f"q{i:05d}".encode() for i in range(70_000)] + [b"zzz"]
    (path := tmp_path / "big.tiktoken").write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(order)))
    enc = tiktoken.Encoding("x", pat_str="(?s:.+)", mergeable_ranks={t: i for i, t in enumerate(order)}, special_tokens={})
    words = ["zzzz", "abzzzq", "q00001", "zq00001"]
    assert [np.frombuffer(i, "<u4").tolist() for i in byte_bpe.WordCoder(str(path), "(?s:.+)").words(words)] == [enc.encode_ordinary(w) for w in words]


def test_decode_is_an_operator(spark, reference_bpe):
    texts = [t for _, t in EDGES if t] + ["naïve 中 🙂", "x" * 500]
    df = docs(spark, list(enumerate(texts)))
    back = byte_bpe.decode(byte_bpe.encode(df, path=RANKS, pattern=P.PATTERN).drop("decoded"), path=RANKS, pattern=P.PATTERN)
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == dict(enumerate(texts))
    strange = spark.createDataFrame([(1, []), (2, None), (3, [0, None]), (4, [10**8]), (5, reference_bpe.encode_ordinary("hi you"))], "k int, ids array<int>")
    got = {r.k: r.decoded if r.decoded is None else bytes(r.decoded) for r in byte_bpe.decode(strange, path=RANKS, pattern=P.PATTERN).collect()}
    assert got == {1: b"", 2: None, 3: None, 4: None, 5: b"hi you"}


# token files


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64))
    index = perfect_hash.build(keys)
    assert sorted(perfect_hash.slots(index, keys)) == list(range(len(keys)))
    assert len(perfect_hash.slots(perfect_hash.build(np.zeros(0, np.uint64)), keys[:3])) == 3


def test_token_parts_match_the_whole_text():
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rnd = random.Random(5)
    parts = ["The", "don't", "IT'S", "we'LL", "''s", "'", "!", "?'", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x7f", "é", "e\u0301", "\u0301", "Σ", "ΑΣ", "İ", "12", "²", "中", "🙂", "\xa0", "x_y", "<|endoftext|>", "<|startoftext|", "</s>", "a.b", "\x00"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20))) for _ in range(3000)]
    for t, packed in zip(texts, token_files.token_bytes(texts, path, 2)):
        assert np.frombuffer(packed, "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids + [2], repr(t)


def test_token_files(spark):
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [(r[0], r[1]) for r in EDGES] + [(i, f"Some Words, 'tis № {i} don't! x\xa0y") for i in range(50, 20, -1)]
    files = token_files.write_tokens(docs(spark, rows), tokenizer=path, shard_bytes=2000)
    places = token_files.locate(files, token_files.keys_of(docs(spark, rows)))
    got = sorted(token_files.read_tokens(files, places).collect(), key=lambda r: r.start)
    encoded = lambda t: tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((k, encoded(t)) for k, t in rows)
    assert [r.doc_id for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids)
    assert len({(r.doc_id, r.copy) for r in got}) == len(rows)
    sums = {r.start: r.ids_crc32 for r in token_files.read_tokens(files, places, checksum_only=True).collect()}
    assert sums == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    strange = token_files.locate(files, spark.createDataFrame([(10**9, 0)], "doc_id long, copy long")).first()
    assert strange.n is None
    with pytest.raises(Exception, match="isn't in the index"):
        token_files.read_tokens(files, token_files.locate(files, spark.createDataFrame([(10**9, 0)], "doc_id long, copy long"))).collect()
    assert token_files.token_table(docs(spark, []), tokenizer=path).count() == 0


def test_one_key_fills_many_shards(spark):
    path = P.path("word_bpe_49k.json")
    rows = [(7, f"copy number {i}") for i in range(200)] + [(None, "none")] * 40 + [(1 << 60, "big"), ((1 << 60) + 1, "big")]
    files = token_files.write_tokens(docs(spark, rows), tokenizer=path, shard_bytes=200)
    got = token_files.read_tokens(files, token_files.locate(files, token_files.keys_of(docs(spark, rows), block=7))).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in rows)
    assert sorted(r.copy for r in got if r.doc_id == 7) == list(range(200)) and sorted(r.copy for r in got if r.doc_id is None) == list(range(40))
    assert len({r.shard for r in got if r.doc_id == 7}) > 2 and len({r.start for r in got}) == len(rows)


def test_large_token_keys_beside_a_null_one(spark):
    big = 1 << 60
    got = token_files.token_table(docs(spark, [(big + 1, "a"), (big + 2, "b"), (None, "c")]).coalesce(1), tokenizer=P.path("word_bpe_49k.json")).collect()
    assert {r.doc_id for r in got} == {big + 1, big + 2, None} and len(got) == 3


# chat


def turn_cost(state, role, label, merge=2, relabel=3, insert=4):
    """The automaton in words: cheapest way to go from a state to a message of ``label``."""
    allowed = {None: ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]}
    ways = [merge] if state == label and (state is not None) else []
    if label in allowed[state]:
        ways.append(0)
    for mid in allowed[state]:  # one empty message between
        if mid != "system" and label in allowed[mid]:
            ways.append(insert)
    return min(ways, default=10**9) + (relabel if role != label else 0)


def chat_cost(roles, labels):
    state, total = None, 0
    for r, t in zip(roles, labels):
        total, state = total + turn_cost(state, r, t), t
    return total + {None: 0, "system": 8, "user": 4, "assistant": 0}[state]


def test_chat_cost_by_brute_force(spark):
    rnd = random.Random(11)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "tool"]), "x") for c in range(60) for t in range(rnd.randint(1, 6))]
    got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for c in range(60):
        g = sorted((r for r in got if r.conv_id == c), key=lambda r: r.pos)
        roles = [r.role for r in g]
        best = min(chat_cost(roles, w) for w in itertools.product(["system", "user", "assistant"], repeat=len(g)))
        assert chat_cost(roles, [r.new_role for r in g]) == best == sum(r.cost for r in g)


def test_large_chat_keys_beside_a_null_one(spark):
    big = 1 << 60
    rows = [(big + 1, big + 1, "user", "a"), (big + 2, None, "user", "b"), (None, 0, "assistant", "c")]
    got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)).collect()
    assert {(r.conv_id, r.turn, r.rendered.count("<|im_end|>")) for r in got} == {(big + 1, big + 1, 2), (big + 2, None, 2), (None, 0, 2)}


def test_chat_repair_costs_least(spark):
    rnd = random.Random(3)
    costs = chat_format.Costs()
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "user", "tool"]), f"{c}.{t}") for c in range(40) for t in range(rnd.randint(1, 7 if c < 30 else 40))]
    df = spark.createDataFrame([*rows, (None, None, None, None), (1, 0, "user", "again")], "conv_id long, turn long, role string, text string")
    got = [r.asDict() for r in chat_format.format_chats(df, block=4).collect()]
    whole = [r.asDict() for r in chat_format.format_chats(df).collect()]
    key = lambda r: (r["conv_id"] is None, r["conv_id"], r["pos"])
    assert sorted(got, key=key) == sorted(whole, key=key) and len(got) == len(rows) + 2
    by = {}
    for r in sorted(got, key=key):
        by.setdefault(r["conv_id"], []).append(r)
    for c, g in by.items():
        labels = [chat_format.ROLES[r["new_role"]] for r in g]
        roles = [chat_format.ROLES.get(r["role"] or "", -1) for r in g]

        def cost(way):
            s = total = 0
            for role, t in zip(roles, way):
                total, s = total + costs.turn(s, role, t), t
            return total + costs.insert * len(costs.ending(s))

        if len(g) <= 7:
            assert cost(labels) == min(cost(w) for w in itertools.product((1, 2, 3), repeat=len(g))) == sum(r["cost"] for r in g)
        chat = "".join(r["rendered"] for r in g)
        turns = re.findall(r"<\|im_start\|>(\w+)\n", chat)
        if turns[0] == "system":
            turns = turns[1:]
        assert turns == ["user", "assistant"] * (len(turns) // 2)
    assert chat_format.format_chats(df.where("false")).count() == 0


# licenses


def test_license_scan(spark):
    rows = [(1, "Text here.\nReleased under the MIT License.\nMore."), (2, "Licensed under the Apache License, Version 2.0. And so on."), (3, "Licensed under CC BY-NC 4.0."), (4, "A licence to kill is in the film."),
            (5, "This work is licensed under the GNU General Public License version 3"), (6, "Permission is given to go.")] + EDGES
    got = {r.doc_id: r for r in license_scan.license_table(docs(spark, rows)).where("n_notices > 0").collect()}
    assert {k: r.licenses for k, r in got.items()} == {1: "MIT", 2: "Apache-2.0", 3: "CC-BY-NC-4.0", 5: "GPL-3.0"}
    spans = license_scan.scan_licenses(docs(spark, rows[:1])).first().licenses
    assert rows[0][1][spans[0].start:spans[0].end] == "Released under the MIT License."
    assert license_scan.license_table(docs(spark, [])).count() == 0


def test_wording_differences():
    t = license_scan.words("licensed under the apache license version 2.0")
    assert license_scan.wording(license_scan.words("it is licensed under apache licence version 2.0 now"), t)[3] == (("the", ""), ("license", "licence"))


WRAPPED = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal",
    "BSD": " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:",
    "MPL-2.0": "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy",
}


def test_wrapped_notices_are_found(spark):
    for name, text in WRAPPED.items():
        found = license_scan.scan_licenses(docs(spark, [(1, "İ Head line\n" + text + "\nint main;")])).first().licenses
        own = next(license_scan.words(t.text) for t in license_scan.TEMPLATES if t.license == name and 12 < len(license_scan.words(t.text)) < 30)
        assert [(f.license, f.similarity, f.differences) for f in found] == [(name, 1.0, "")]
        assert license_scan.words(("İ Head line\n" + text)[found[0].start:found[0].end]) == own
    both = "Released under the MIT License.\nSome parts:\nLicensed under CC BY-SA\n4.0."
    assert [f.license for f in license_scan.scan_licenses(docs(spark, [(1, both)])).first().licenses] == ["MIT", "CC-BY-SA-4.0"]


NOT_MISNAMED = {
    "Released under the ISC License.": "ISC", "Released under the BSD License.": "BSD", "Licensed under CC BY 3.0.": "CC-BY-3.0", "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0",
    "This work is licensed under the GNU General Public License, version 1.": "GPL-1.0", "Licensed under the Apache License, Version 1.1.": "Apache-1.1",
    "Licensed under the Apache License, Version 7.": "", "Released under the Frog License.": "", "This work is licensed under the GNU Lesser General Public License, version 3": "LGPL-3.0",
    "This work is not licensed under the GNU General Public License, version 3": "", "Distributed under the MIT licence": "MIT",
}


def test_names_versions_and_conditions_decide(spark):
    got = license_scan.license_table(docs(spark, list(enumerate(NOT_MISNAMED)))).collect()
    assert {list(NOT_MISNAMED)[r.doc_id]: r.licenses for r in got} == NOT_MISNAMED


def test_whole_paragraphs(spark):
    for t in license_scan.PARAGRAPHS:
        text = "x y z " * 90 + t.text.replace(", ", ",\n * ") + " and so on " + "q w " * 300
        found = license_scan.scan_licenses(docs(spark, [(1, text)])).first().licenses if t in license_scan.PARAGRAPHS[:2] else license_scan._scanner(license_scan.TEMPLATES).scan(text)
        assert [(f["license"], f["similarity"]) for f in found] == [(t.license, 1.0)], t


def test_scan_matches_brute_force():
    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rnd = random.Random(21)
    names = ["alpha", "beta", "gamma"]
    templates = tuple(license_scan.Template(n, f"this work may be used under the {n} license of the author for all ends") for n in ("MIT", "ISC", "BSD"))
    scanner = license_scan.Scanner(templates)
    for _ in range(300):
        name = rnd.choice(["mit", "isc", "bsd", "frog"])
        w = f"this work may be used under the {name} license of the author for all ends".split()
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(w))
            if rnd.random() < 0.5:
                w[k] = rnd.choice(names)
            elif rnd.random() < 0.5:
                del w[k]
            else:
                w.insert(k, rnd.choice(names))
        noise = [rnd.choice(["sun", "moon", "license", "tree"]) for _ in range(rnd.randint(0, 90))]
        at = rnd.randint(0, len(noise))
        all_ = noise[:at] + w + noise[at:]
        # a license is named where its words, name and all, stand within three edits (a fifth of 15), the name being among them
        want = set()
        for t in templates:
            own = license_scan.words(t.text)
            near = [(edit(all_[i:i + n], own), i, n) for i in range(len(all_)) for n in range(9, 20) if i + n <= len(all_)]
            if near and min(near)[0] <= 3 and t.license.lower() in w:
                want.add(t.license)
        assert {f["license"] for f in scanner.scan(" ".join(all_))} == want, " ".join(all_)


def test_edits_are_those_of_wording():
    rnd = random.Random(4)
    for _ in range(400):
        block, own = ([rnd.choice("abcd") for _ in range(rnd.randint(1, n))] for n in (30, 12))
        got = license_scan.edits(block, own)
        assert max(0.0, 1 - min(*got, len(own)) / len(own)) == license_scan.wording(block, own)[0]


@pytest.mark.parametrize("size", [0, 100, 300, 600, 2200, 50_000])
def test_notices_in_long_lines_are_found(spark, size):
    rnd = random.Random(size)
    half = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(size // 14))
    text = f"{half} Released under the MIT License {half}".strip()
    found = license_scan.scan_licenses(docs(spark, [(1, text)])).first().licenses
    assert [(f.license, f.similarity, text[f.start:f.end]) for f in found] == [("MIT", 1.0, "Released under the MIT License")]
    blob = "x" * size + '{"k":"' + "Released under the MIT License" + '"}' + "y" * size
    assert [f.license for f in license_scan.scan_licenses(docs(spark, [(1, blob)])).first().licenses] == ["MIT"]


@pytest.mark.parametrize("bits", [1 << 9, 1 << 12])
def test_filters_at_every_size(spark, bits):
    rows = [(i, f"copy {i % 7}") for i in range(60)] + [(i, f"alone {i}") for i in range(100, 400)]
    hashes = exact_dedup.digests(docs(spark, rows))
    found = exact_dedup.find_repeats(hashes, bits)
    assert len(found.filters) == -(-len(rows) * exact_dedup.LEAST_BITS_PER_ROW // bits)
    passed = 0
    for one in found.filters:
        assert one.bits <= max(bits, 1 << 9) and len(one.words.first().words) == one.bits // 64
        passed += hashes.where(one.within(F.col("hash__")) & one.possible(F.col("text_sha256"))).count()
    assert 60 <= passed < len(rows) * 0.4
    groups = brute_dedup(rows)
    for r in exact_dedup.dedup_digests(docs(spark, rows), max_filter_bits=bits).collect():
        assert r.group_size == len(groups[r.text_sha256]) and r.keep_id == min(groups[r.text_sha256]) and r.kept == (r.doc_id == r.keep_id)


def test_shortened_shingles_that_collide_rule_no_pair_out(spark):
    head = [5, 5 + (1 << 31), 9]
    sets = spark.createDataFrame([(1, 3, head), (2, 3, head), (3, 3, [6, 7, 8])], "doc long, n int, head array<long>").withColumn("sig", F.array_repeat(F.lit(0).cast("long"), 8))
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert [tuple(r) for r in ngram_join._plausible(sets, pairs, 100).collect()] == [(1, 2)]
