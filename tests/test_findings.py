"""Cases of the reviewers' findings: each failed before its query was changed."""

import duckdb

from textloom.plans import registry


def answers(spark, folder, name, **tables):
    """A query's rows over planted tables, and those of its SQL."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = registry.queries()[name](spark, str(folder))
    want = con.execute(registry.oracle_sql()[name]).df()[got.columns]
    return sorted(tuple(r) for r in got.collect()), sorted(want.itertuples(index=False, name=None))


def test_z_scores_are_compared_before_rounding(spark, tmp_path):
    from datetime import datetime, timedelta

    sd = 10 * (40 / 39) ** 0.5
    values = [40.0, 60.0] * 20 + [50 + 2.50002 * sd]
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=i), "click", v) for i, v in enumerate(values)]
    got, want = answers(spark, tmp_path, "anomaly_zscore", events=(rows, "event_id long, ts timestamp_ntz, event_type string, value double"))
    assert got == want == [(40, "click", 2.5)]


def _sets(n):
    """Documents of words, some frequent, with repeats, copies and one without words."""
    import random

    r = random.Random(5)
    sets = {i * 3: [f"w{min(int(r.expovariate(0.15)), 40)}" for _ in range(r.randrange(1, 30))] for i in range(n)}
    sets[51], sets[54] = sets[48], []
    return sets


def test_documents_are_compared_with_blocks_of_queries(spark):
    from textloom.functions.overlaps import common_with_queries

    sets = {d: sorted(set(ws)) for d, ws in _sets(60).items()}
    df = spark.createDataFrame(list(sets.items()), "doc_id long, words array<string>").repartition(3)
    asked = [d for d in sets if d % 4 == 0]
    want = []
    for a in asked:
        for b in sets:
            both = len(set(sets[a]) & set(sets[b]))
            if a != b and 10 * both > 3 * (len(sets[a]) + len(sets[b]) - both):
                want.append((a, b, len(sets[a]), len(sets[b]), both))
    for elements in (200,):
        got = common_with_queries(df, df.where("doc_id % 4 = 0"), 3, elements)
        assert sorted(map(tuple, got.collect())) == sorted(want) != []


def test_best_sources_stream_past_blocks_of_targets(spark):
    from textloom.functions.overlaps import best_sources

    sets = {d: set(ws) for d, ws in _sets(60).items()}
    df = spark.createDataFrame([(d, w) for d, ws in sets.items() for w in ws], "doc_id long, name string").repartition(3)
    want = []
    for b in sets:
        n = sorted((-len(sets[a] & sets[b]), a) for a in sets if a < b and sets[a] & sets[b])
        want += [(a, b, -c) for c, a in n[:5]]
    for targets, sources in ((20, 7),):
        assert sorted(map(tuple, best_sources(df, 5, targets, sources).collect())) == sorted(want)


def test_gap_distances_shuffle_no_terms(spark, tmp_path):
    import contextlib
    import io

    words = [f"w{i % 97} Alpha{i % 13} the" for i in range(400)]
    docs = [(1, " ".join(words)), (2, "a " * 600), (3, "short"), (4, None), (5, " ".join(words[:200] + words[:200]))]
    tables = {"documents": ([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")}
    got, want = answers(spark, tmp_path, "gap_semantic_distance", **tables)
    assert got == want and len(got) == 4 + 2 + 4
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        registry.queries()["gap_decision"](spark, str(tmp_path)).explain()
    assert "Join" not in plan.getvalue() and "Generate" in plan.getvalue() and plan.getvalue().count("Exchange") == 1


def test_postings_of_a_block_are_made_in_one_place():
    import pyarrow as pa

    from textloom.operators.keyword_index import _posted

    batch = lambda rows: pa.RecordBatch.from_pydict({"doc": [r[0] for r in rows], "block": [r[0] // 256 for r in rows], "ws": pa.array([r[1] for r in rows], pa.list_(pa.string()))})
    parts = [batch([(1, ["x", "y", "x"]), (3, [])]), batch([(7, ["y"]), (256, ["x"])]), batch([(600, [])])]
    got = [(r["block"], r["term"], [tuple(p.values()) for p in r["docs"]], r["n"], r["most"], r["least"]) for b in _posted(iter(parts)) for r in b.to_pylist()]
    assert got == [(0, "x", [(1, 2, 3, [0, 2])], 1, 2, 3), (0, "y", [(1, 1, 3, [1]), (7, 1, 1, [0])], 2, 1, 1), (1, "x", [(256, 1, 1, [0])], 1, 1, 1)]


def test_terms_are_counted_without_a_grouping(spark):
    from textloom.operators.retrieval import term_counts

    docs = [(1, "Alpha beta, alpha the"), (2, None), (3, ""), (4, "beta"), (None, "beta beta")]
    got = term_counts(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "alpha", 2), (1, "beta", 1), (4, "beta", 1), (None, "beta", 2)]))


def test_shared_pairs_are_counted_where_they_are_made(spark):
    import contextlib
    import io
    from collections import Counter
    from itertools import combinations

    from textloom.operators.graphs import shared_pairs

    edges = {(f"s{i}", f"p{i * k % 23}") for i in range(40) for k in range(1, 6)} | {(f"s{i}", "hub") for i in range(40)} | {("s1", "alone")}
    lists = {p: sorted(a for a, b in edges if b == p) for _, p in edges}
    want = Counter(x for names in lists.values() for x in combinations(names, 2))
    df = spark.createDataFrame([*edges, (None, "hub"), ("s2", None)], "a string, b string").repartition(3)
    for rows in (7, 10**6):
        out = shared_pairs(df, rows)
        assert sorted(map(tuple, out.collect())) == sorted((a, b, n) for (a, b), n in want.items() if n >= 2) != []
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        out.explain()
    made = plan.getvalue().split("explode(rest")[0]
    assert "HashAggregate(keys=[x" in made and "hashpartitioning(x" not in made[made.index("HashAggregate(keys=[x"):]


def test_buckets_follow_the_rows_and_each_is_one_tasks(spark, tmp_path):
    from textloom.sources.stored import StoredTable, buckets_for

    rows = spark.range(400).selectExpr("id AS k", "id % 7 AS v").repartition(3)
    assert (buckets_for(rows, 20), buckets_for(rows, 1000), buckets_for(rows.where("k < 0"), 20)) == (20, 8, 8)
    stored = StoredTable(spark, str(tmp_path), "k long, v long", ["k"], buckets_for(rows, 20))
    stored.merge(rows, 0, lambda df: df)
    tasks = {}
    for f in tmp_path.glob("data/batch=0/bucket=*/*.parquet"):
        tasks.setdefault(f.name.split("-")[1], set()).add(f.parent.name)
    assert len(tasks) == 20 and all(len(b) == 1 for b in tasks.values())
    assert stored.read().count() == 400


def test_content_types_take_one_search_of_the_text(spark):
    import contextlib
    import io
    import random
    import re

    from textloom.operators.texts import CONTENT_TYPES, content_type

    r = random.Random(3)
    said = [e for ps in CONTENT_TYPES.values() for p in ps for e in re.split(r"\|", p[8:-3].replace(r"\s+", "  "))]
    said += ["API", "Peer-Reviewed", "plant medicine medicine", "active\tingredient", "herbs", "law_suit", "health-care", "e", "élaw", "", "laws"]
    texts = [" ".join(r.choice(said) for _ in range(r.randrange(1, 9))) for _ in range(300)] + ["", None, "of " * 150 + "law"]

    def kind(t):
        if t is None:
            return None
        n = {k: sum(len(re.findall(p, t.lower())) for p in ps) for k, ps in CONTENT_TYPES.items()}
        top = max(n.values())
        return "general" if top / max(1, len(t.split())) < 0.01 else next(k for k in n if n[k] == top)

    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    out = df.select("i", content_type(df["text"]).alias("kind"))
    assert {x.i: x.kind for x in out.collect()} == {i: kind(t) for i, t in enumerate(texts)}
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        out.explain()
    assert plan.getvalue().count("regexp_extract_all") + plan.getvalue().count("regexp_count") <= 4


def _exchanges(df):
    import contextlib
    import io

    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        df.explain()
    return [x.split("Exchange ")[1] for x in plan.getvalue().splitlines() if "Exchange " in x and "Broadcast" not in x]


def test_bigrams_of_a_document_are_counted_in_its_task(spark, tmp_path):
    from textloom.operators.concepts import bigrams

    docs = [(1, "A b a b"), (2, "a b"), (2, "a b c"), (3, None), (4, "x"), (5, ""), (None, "b  c\nd"), (6, "q r s")]
    rows = [(i, t, "en", "s", 1) for i, t in docs]
    got, want = answers(spark, tmp_path, "bigram_cache", documents=(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert got == want == [("a b", 4, 2), ("b c", 2, 1)]
    out = bigrams(spark.createDataFrame(docs, "doc_id long, text string"), 5)
    dealt = _exchanges(out)
    assert sorted(map(tuple, out.collect())) == got
    assert len(dealt) == 2 and any("hashpartitioning(doc_id" in x for x in dealt) and any("hashpartitioning(bigram" in x for x in dealt)


def test_keywords_are_found_once_for_collocations(spark, tmp_path):
    docs = ["alpha beta", "alpha beta gamma", "gamma", "the", "", None, "delta alpha beta delta"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(docs)]
    from textloom.operators.texts import collocations

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = collocations(df, 2)
    assert [(r.a, r.b, r.n, r.c_a, r.c_b, r.t) for r in out.collect()] == [("alpha", "beta", 3, 3, 3, 6)]
    import contextlib
    import io

    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        out.explain()
    assert "split(" not in plan.getvalue()


def test_texts_that_no_rule_can_match_are_not_searched():
    import random
    import re

    from textloom.functions import text as T
    from textloom.operators.nested import MAY_MATCH

    r = random.Random(1)
    parts = ["a", "Z", "eyJ", "ey", ".", "-", "_", "/", "+", "api_key", "token", "secret", "password", "pwd", '"', " ", ":", "=", "@", "x.org", "1", "22", "123456789", "MRN", "MR#", "abcdefghijklmnopqrstuvwxyz", "AB", "é", "٣"]
    rules = [re.compile(p) for n, p, _ in T.REDACTIONS]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(20_000)]
    found = [t for t in texts if any(p.search(t) for p in rules)]
    assert found and all(MAY_MATCH.search(t) for t in found)
    assert not MAY_MATCH.search("3-MEDIUM"[1:]) and sum(not MAY_MATCH.search(t) for t in texts) > 100


def test_nested_changes_leave_python_as_columns(spark):
    from textloom.operators.nested import redact_json

    rows = [(1, '{"token":"a","n":["call 123-45-6789","F"]}'), (2, None), (3, "me@x.org"), (4, "[]"), (5, '{"a":{"email":0,"phone":"1"}}')]
    out = redact_json(spark.createDataFrame(rows, "i long, j string").coalesce(1), "j").orderBy("i")
    assert [(r.redacted, r.changes and [tuple(c) for c in r.changes]) for r in out.collect()] == [
        ('{"n":["call [SSN-REDACTED]","F"],"token":"[REDACTED]"}', [("$.token", "key"), ("$.n[0]", "ssn")]), (None, None), ('"[EMAIL-REDACTED]"', [("$", "email")]), ("[]", []), ('{"a":{"email":0,"phone":"[REDACTED]"}}', [("$.a.phone", "key")])]


def test_a_nested_document_is_walked_once(spark):
    import contextlib
    import io

    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        registry.queries()["redact_nested_summary"](spark, "/root/testdata/sf0.001").explain()
    assert plan.getvalue().count("ArrowEvalPython") == 1


def test_expansion_moves_no_keywords_of_all_documents(spark, tmp_path):
    docs = [(1, "red green blue white black grey"), (2, "red green gold"), (3, "white black gold"), (4, None), (5, "grey rose"), (6, "blue blue white")]
    tables = {"documents": ([(i, t, "en", "src1", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long"),
              "benchmark": ([(1, "red green blue"), (2, "gold lily"), (3, "nothing")], "item_id long, text string")}
    got, want = answers(spark, tmp_path, "expanded_search", **tables)
    assert got == want and {r[3] for r in got} == {"original", "expanded"}
    dealt = _exchanges(registry.queries()["expanded_search"](spark, str(tmp_path)))
    assert dealt and not any(x.startswith(("hashpartitioning(doc_id", "hashpartitioning(w#")) for x in dealt)


def test_edges_are_neither_grouped_nor_named_for_distances(spark, tmp_path, monkeypatch):
    import random

    from textloom.operators import networks

    r = random.Random(2)
    lines = [(r.randrange(-2, 12), r.randrange(-2, 30), float(r.randrange(1, 12))) for _ in range(90)]
    lines += [(3, 4, 9.0), (3, 4, 2.0), (5, 6, None), (100, 200, 1.0)]
    kept = {}
    monkeypatch.setattr(networks, "written", lambda df, name, keep=networks.written: kept.setdefault(name, df) is None or keep(df, name))
    for i, rows in enumerate((lines, lines + [(1 << 62, 4, 3.0), (1 << 62, 1 << 62, 1.0), (7, -(1 << 63), 2.0)], [])):
        kept.clear()
        (tmp_path / str(i)).mkdir()
        got, want = answers(spark, tmp_path / str(i), "weighted_distances", lineitem=(rows, "l_suppkey long, l_partkey long, l_quantity double"))
        assert got == want and len(got) == len({n for n, _ in got}) and (len(got) > 30) == bool(rows)
        assert not _exchanges(kept["light"]) and not _exchanges(kept["heavy"])
        assert {t for n, t in kept["heavy"].dtypes if n != "w"} == {"string" if i == 1 else "bigint"}


def test_an_index_shuffles_and_keeps_words_once(spark, tmp_path, monkeypatch):
    from textloom.operators import keyword_index as K

    made = []
    monkeypatch.setattr(K, "written", lambda df, name, keep=K.written: made.append(name) or keep(df, name))
    docs = spark.createDataFrame([(i, f"alpha word{i % 7} beta word{i % 7}" if i % 5 else "") for i in range(-300, 300)], "doc_id long, text string")
    index = K.Index(spark, K.build_index(docs, str(tmp_path / "i"), buckets=3))
    assert made == [] and sorted(index.docs().columns) == ["doc", "len", "segment"] and (index.n, index.words) == (600, 480 * 4)
    postings = spark.read.parquet(str(tmp_path / "i/postings"))
    assert "struct" not in str(postings.dtypes) and postings.where("term = 'beta'").count() == 4  # one row for each block
    assert {(r.n, tuple(r.places)) for r in postings.where("term = 'word0' AND block = 0 AND doc[0] = 7").collect()} == {(29, (1, 3) * 29)}


def test_a_block_is_scored_for_its_queries_without_dead_documents():
    import math

    import pyarrow as pa

    from textloom.operators.keyword_index import B, K1, _scores

    posts = pa.table({"block": [0, 0, 0], "term": ["x", "y", "x"], "segment": pa.array([0, 0, 1], pa.int32()), "doc": pa.array([[1, 2, 4], [2], [1]], pa.list_(pa.int64())), "tf": pa.array([[1, 2, 1], [1], [3]], pa.list_(pa.int32())), "len": pa.array([[3, 3, 3], [3], [3]], pa.list_(pa.int32()))})
    weighted = pa.table({"item": ["p", "p", "q", "r"], "term": ["x", "y", "y", "z"], "idf": [0.5, 2.0, 2.0, 1.0]})
    asked = pa.table({"block": [0, 0, 0], "item": ["p", "r", None], "gone": pa.array([None, None, 1], pa.int64()), "of": pa.array([None, None, 0], pa.int32())})
    part = lambda idf, tf: idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * 3 / 2.0))
    want = {1: part(0.5, 3), 2: part(0.5, 2) + part(2.0, 1), 4: part(0.5, 1)}
    for k in (5, 2):
        got = _scores(posts, asked, weighted, 2.0, "item", k).to_pylist()
        best = sorted(want, key=lambda d: -want[d])[:k]
        assert sorted(r["doc"] for r in got) == sorted(best) and all(r["item"] == "p" and math.isclose(r["score"], want[r["doc"]]) for r in got)


def test_what_an_update_takes_out_is_counted_in_the_rows_of_postings(spark, tmp_path, monkeypatch):
    from textloom.operators import keyword_index as K

    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    path = K.build_index(df([(i, f"common word{i % 3}") for i in range(-10, 600)]), str(tmp_path / "i"), buckets=2)
    with monkeypatch.context() as m:
        m.setattr(K, "MOST_GONE", 3)  # several rounds
        K.Index(spark, path).update(df([(i, "word1 new") for i in range(5)]), df([(i, None) for i in range(300, 306)] + [(9999, None)]))
    rows = spark.read.parquet(f"{path}/postings").where("segment = 1 AND n < 0")
    lost = {(r.term, r.block): r.n for r in rows.groupBy("term", "block").sum("n").toDF("term", "block", "n").collect()}
    assert lost == {("common", 0): -5, ("word0", 0): -2, ("word1", 0): -2, ("word2", 0): -1, ("common", 1): -6, ("word0", 1): -2, ("word1", 1): -2, ("word2", 1): -2}
    K.Index(spark, path).update(df([(2, "word2 again")]))  # of a later segment, so only that one's terms are lost
    rows = spark.read.parquet(f"{path}/postings").where("segment = 2 AND n < 0").select("term", "block", "n")
    assert sorted(map(tuple, rows.collect())) == [("new", 0, -1), ("word1", 0, -1)]


def test_sources_are_read_and_not_shuffled(spark):
    import contextlib
    import io

    from textloom.functions.overlaps import best_sources

    ids = [-(1 << 62), -5, 0, 7, 1 << 40, 1 << 62]
    rows = [(d, f"w{i % 4}") for i, d in enumerate(ids * 3)] + [(7, "alone")]
    found = best_sources(spark.createDataFrame(rows + rows, "doc_id long, name string"), 2, 2, 1)
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        found.explain()
    assert "Exchange" not in plan.getvalue() and found.rdd.getNumPartitions() == 3
    sets = {d: {n for x, n in rows if x == d} for d in ids}
    want = [(a, b, -c) for b in ids for c, a in sorted((-len(sets[a] & sets[b]), a) for a in ids if a < b and sets[a] & sets[b])[:2]]
    assert sorted(map(tuple, found.collect())) == sorted(want) != []


def test_the_most_common_places_keep_their_ties_in_order():
    import numpy as np

    from textloom.functions.overlaps import _most

    found, n = np.array([2, 3, 5, 8, 9, 11]), np.array([1, 2, 3, 2, 1, 2])
    assert [sorted(_most(found, n, k).tolist()) for k in (1, 2, 3, 4, 5, 6)] == [[5], [3, 5], [3, 5, 8], [3, 5, 8, 11], [2, 3, 5, 8, 11], found.tolist()]


def test_similar_sets_are_found_by_their_rare_elements():
    import random

    import numpy as np
    import pyarrow as pa

    from textloom.functions.overlaps import Queries

    r = random.Random(3)
    sets = [sorted({min(int(r.expovariate(0.02)), 300) for _ in range(r.choice((1, 2, 5, 12, 40, 120)))}) for _ in range(150)]
    sets += [s[: max(1, int(len(s) * q))] for s in sets[:60] for q in (0.3, 0.31, 0.5, 0.9)]
    some = sets[::2]
    for t in (1, 3, 10):
        asked = Queries(np.arange(len(some)) * 7, pa.array([[f"w{x}" for x in s] for s in some], pa.list_(pa.string())), t)
        assert len(asked.lists.docs) < 0.97 * len(asked.elements)  # the most frequent elements aren't counted
        place = {w: i for i, w in enumerate(asked.known.to_pylist())}
        for s in sets:
            found, both = asked.similar(np.array([place[f"w{x}"] for x in s if f"w{x}" in place], np.int32), len(s))
            want = {(7 * i, c) for i, q in enumerate(some) if 10 * (c := len(set(q) & set(s))) > t * (len(q) + len(s) - c)}
            assert set(zip(asked.ids[found].tolist(), both.tolist())) == want
            assert not asked.marked.any()
