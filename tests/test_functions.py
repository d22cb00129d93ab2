from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import graphs, reports, retrieval
from textloom.sources import knowledge


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_redaction_order(spark):
    s = "mail a.b@c.org, 123-45-6789, 4111 1111 1111 1111, 5551234567, 10.0.0.1"
    assert one(spark, T.redact(F.lit(s))) == "mail [EMAIL-REDACTED], [SSN-REDACTED], [CARD-REDACTED], [ACCOUNT-REDACTED], 10.0.0.1"


def test_fingerprint_and_error_pattern(spark):
    assert one(spark, T.sql_fingerprint(F.lit("select *  from t where a = 'x' and b = 12"))) == "SELECT * FROM T WHERE A = 'STRING' AND B = NUMBER"
    assert one(spark, T.error_pattern(F.lit("fail 12 at /a/b.py"))) == "fail <number> at <path>"


def test_jaccard_is_zero_where_empty(spark):
    a = F.array(F.lit("x"))
    assert one(spark, T.jaccard(a, F.filter(a, lambda v: v == "y"))) == 0.0
    assert one(spark, T.jaccard(a, a)) == 1.0


def test_cosine_without_length(spark):
    assert one(spark, retrieval.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_metadata_filter(spark):
    df = spark.createDataFrame([(1, "a"), (5, "b"), (9, "a")], "n int, k string")
    keep = lambda spec: [r.n for r in df.where(reports.metadata_filter(spec)).collect()]
    assert keep({"n": {"$gte": 5, "$lt": 9}}) == [5]
    assert keep({"k": ["a"], "_x": 1}) == [1, 9]
    assert keep({}) == [1, 5, 9]


def test_upsert_and_change_set(spark):
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "id int, v string"), spark.createDataFrame([(2, "n"), (3, "n")], "id int, v string")
    assert sorted(map(tuple, reports.upsert(old, new, ["id"]).collect())) == [(1, "o"), (2, "n"), (3, "n")]
    assert sorted(map(tuple, reports.upsert(old, new, ["id"], overwrite=False).collect())) == [(1, "o"), (2, "o"), (3, "n")]
    assert sorted(map(tuple, reports.change_set(old, new, "id").collect())) == [(1, "removed"), (2, "unchanged"), (3, "added")]


def test_expand_keeps_least_distance(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y")], "a string, b string")
    got = graphs.expand(e, spark.createDataFrame([("a",)], "node string"), 2)
    assert dict(map(tuple, got.collect())) == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_concept_readers(spark, tmp_path):
    line = lambda cui, lat, ts, stt, name: "|".join([cui, lat, ts, "L", stt, *["x"] * 6, "SNOMED", "PT", "c", name, "0", "N", ""])
    (tmp_path / "c.rrf").write_text("\n".join([line("C1", "ENG", "P", "PF", "Heart"), line("C1", "ENG", "S", "PF", "Cor"), line("C2", "FRE", "P", "PF", "Foie"), "bad|line"]))
    c = knowledge.read_concepts(spark, str(tmp_path / "c.rrf"))
    assert [tuple(r) for r in knowledge.preferred_names(c).collect()] == [("C1", "Heart", ["Cor"])]


def test_assertion_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text("/a/1\t/r/IsA\t/c/en/black_cat/n\t/c/en/animal\t{\"weight\": 2.5}\n/a/2\t/r/IsA\t/c/fr/chat\t/c/en/animal\t{}\n/a/3\t/r/PartOf\t/c/en/paw\t/c/en/cat\t{}\n")
    got = sorted(map(tuple, knowledge.read_assertions(spark, str(tmp_path / "a.csv")).collect()))
    assert got == [("IsA", "black cat", "animal", 2.5), ("PartOf", "paw", "cat", 1.0)]


def test_triple_reader(spark, tmp_path):
    (tmp_path / "y.ttl").write_text("@prefix x: <y> .\nyago:A\trdfs:label\t\"Ah\"@en .\nyago:A\trdfs:label\t\"Aha\"@fr .\nyago:A\trdf:type\tyago:T .\nyago:A\towl:sameAs\twd:Q12 .\n")
    r = knowledge.entities(knowledge.read_triples(spark, str(tmp_path / "y.ttl"))).first()
    assert (r.label, r.qid, r.entity_id, r.types) == ("Ah", "Q12", "Q12", ["yago:T"])


def test_log_reader(spark, tmp_path):
    (tmp_path / "l.log").write_text('{"ts": "t", "level": "ERROR", "message": "m", "service": "s"}\n2024-01-01 10:00:00 INFO started\nfree text\n')
    got = [tuple(r) for r in knowledge.read_log(spark, str(tmp_path / "l.log")).collect()]
    assert got == [("t", "ERROR", "m", "s"), ("2024-01-01 10:00:00", "INFO", "started", None), (None, "INFO", "free text", None)]


def test_budget_groups(spark):
    from textloom.operators.signals import budget_groups

    rows = [("a", i, n) for i, n in enumerate([300, 200, 1, 600, 10, 490, 1])] + [("b", 0, 5)]
    got = {(r.k, r.i): r.group for r in budget_groups(spark.createDataFrame(rows, "k string, i int, n int"), "k", "i", "n", 500).collect()}
    assert [got["a", i] for i in range(7)] == [0, 0, 1, 2, 3, 3, 4] and got["b", 0] == 0


def test_sentence_chunks():
    from textloom.operators.chunking import sentence_chunks

    text = " ".join(" ".join(f"w{i}" for i in range(n)) + "." for n in (100, 100, 100, 700, 30))
    got = sentence_chunks(text)
    assert [w for c in got for w in c] == text.split()
    assert [len(c) for c in got] == [200, 100, 256, 256, 218] and sentence_chunks(None) == sentence_chunks(" \n") == []


def test_common_names_make_edges(spark):
    from textloom.operators.chunking import name_edges

    rows = [(i, f"hot name only{i}") for i in range(30)] + [(30, "other words and hot name"), (31, "alone here"), (32, "hot"), (33, None), (34, "")]
    got = {(r.a, r.b): r.n for r in name_edges(spark.createDataFrame(rows, "doc_id long, text string"), block=4).collect()}
    assert got == {(a, b): 1 for b in range(31) for a in range(b)}


def test_similar_names_lose_none(spark):
    import random

    from textloom.operators.signals import similar_names

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rnd = random.Random(2)
    seeds = ["".join(rnd.choice("abc") for _ in range(n)) for n in (1, 4, 5, 6, 9, 10, 11, 16, 21, 30)]
    names = set(seeds) | {"", "é" * 6, "é" * 5 + "a"}
    for s in seeds * 12:
        t = list(s)
        for _ in range(rnd.randint(0, 6)):
            i = rnd.randrange(len(t) + 1)
            t[i:i + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "c"])
        names.add("".join(t))
    got = {frozenset((r.name, r.other)): r.similarity for r in similar_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    want = {frozenset((a, b)): 1 - distance(a, b) / max(len(a), len(b)) for a in names for b in names if a < b and 5 * distance(a, b) < max(len(a), len(b))}
    assert len(want) > 100 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_names_are_alike_across_brands(spark, tmp_path):
    from textloom.operators.signals import fuzzy_pairs

    rows = [(1, "blue steel", "A", "x", 1), (2, "blue steel", "B", "y", 2), (3, "blue steal", "C", "z", 3), (4, "red", "A", "x", 1), (5, None, "A", "x", 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.p_partkey, r.other): (r.similarity, r.n_other) for r in fuzzy_pairs(spark, str(tmp_path)).collect()}
    assert got == {(1, "blue steel"): (1.0, 2), (2, "blue steel"): (1.0, 2), (1, "blue steal"): (0.9, 1), (2, "blue steal"): (0.9, 1), (3, "blue steel"): (0.9, 2)}


def test_graphs_of_all_lines(spark, tmp_path):
    from textloom.plans.registry import queries

    rows = [(1, 1, 1.0), (1, 2, 5.0), (2, 2, 10.0), (2, 1, 3.0), (2, 3, 48.0), (3, 3, 2.0), (4, 4, 1.0), (1, 1, 50.0)]  # supplier, part, quantity
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    run = lambda name: sorted(map(tuple, queries()[name](spark, str(tmp_path)).collect()))
    two = [("p1", 1), ("p2", 1), ("s1", 0), ("s2", 2)]
    assert run("graph_two_hop") == two
    assert run("graph_shortest_path") == sorted(two + [("p3", 3), ("s3", 4)])
    assert run("ego_graph") == [("p1", "s1", 2), ("p2", "s1", 2), ("s1", "p1", 2), ("s1", "p2", 2)]
    assert run("degree_top") == [("p1", 2), ("p2", 2), ("p3", 2), ("p4", 1), ("s1", 2), ("s2", 3), ("s3", 1), ("s4", 1)]
    assert run("shared_concept_pairs") == [("s1", "s2", 2)]


def test_pairs_seen_twice_are_collocations(spark, tmp_path):
    from textloom.operators.texts import pmi_collocations

    # 64 words and 63 pairs: "aaa bbb" twice, all else once
    rest = [f"v{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    text = " ".join(["aaa", "bbb", *rest[:30], "aaa", "bbb", *rest[30:]])
    spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.a, r.b, r.n, r.pmi) for r in pmi_collocations(spark, str(tmp_path)).collect()] == [("aaa", "bbb", 2, 6.9773)]


def test_collocations_at_the_border(spark, tmp_path):
    from textloom.operators.texts import pmi_collocations

    # 32 pairs, "aaa bbb" twice, and both words twice: 2 * 32 >= 8 * 2 * c holds up to c = 4
    rest = [f"v{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    for extra, n in ((2, 1), (3, 0)):
        words = ["aaa", "bbb", rest[0], "aaa", "bbb"] + [x for i in range(extra) for x in (rest[1 + i], "bbb")]
        words += rest[10:10 + 33 - len(words)]
        path = f"{tmp_path}/{extra}"
        spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
        got = pmi_collocations(spark, path).where("a = 'aaa'").collect()
        assert [(r.n, r.pmi) for r in got] == [(2, 5.0)] * n


def test_content_upsert_keeps_all_contents_once(spark):
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, source string, text string, lang string, n_chars long")
    old = docs([(1, "s", "x", "en", 1), (5, "s", "x", "de", 1), (7, "t", "x", "en", 1), (None, "s", None, "en", 0), (11, "s", "", "fr", 0)])
    new = docs([(9, "s", "x", "en", 2), (3, "s", "y", "en", 1)])
    got = {(r.source, r.content_hash[:4], r.doc_id, r.lang, r.n_chars) for r in reports.content_upsert(old, new).collect()}
    assert got == {("s", "2d71", 9, "en", 2), ("t", "2d71", 7, "en", 1), ("s", "e3b0", 11, "fr", 0), ("s", "a1fc", 3, "en", 1)}


def test_late_events_miss_their_window(spark, tmp_path):
    import datetime as dt
    import time

    from textloom.streaming import events as E

    folder = str(tmp_path / "in")
    at = lambda *m: dt.datetime(2024, 1, 1, *m)
    batches = [[(1, at(0, 5))], [(2, at(3, 0))], [(4, at(3, 1))], [(3, at(0, 50))], [(5, at(9, 0))], [(6, at(20, 0))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, t, "view", 1.0) for k, t in rows], "event_id long, ts timestamp_ntz, event_type string, value double").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken by their times of change
    hours = E.stream_of(spark, folder, 1).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.hour("w.start").alias("h"), "n")
    # event 3 comes when the first hour has closed; the last window is still open
    assert sorted(map(tuple, E.run_to_end(hours).collect())) == [(0, 1), (3, 2), (9, 1)]


def test_folds_keep_null_keys_apart_and_state_small(spark):
    from textloom.functions.folds import fold

    rows = [(None, 1, 10), (None, 2, 11), (1 << 60, 1, 12), ((1 << 60) + 1, 1, 13)]

    def start():
        total = [0]

        def step(t):
            total[0] += t
            return (total[0],)

        return step

    got = fold(spark.createDataFrame(rows, "k long, t long, id long").coalesce(1), "k", ["t", "id"], ["t"], start, "total long")
    assert {r.id: (r.k, r.total) for r in got.collect()} == {10: (None, 1), 11: (None, 3), 12: (1 << 60, 1), 13: ((1 << 60) + 1, 1)}


def test_budget_groups_with_large_and_null_keys(spark):
    from textloom.operators.signals import budget_groups

    big = 1 << 60
    df = spark.createDataFrame([(None, 1, 3), (None, 2, 3), (None, 3, 3), (big + 1, 1, 9), (big + 2, 1, None)], "k long, t long, n int").coalesce(1)
    assert sorted(map(tuple, budget_groups(df, "k", "t", "n", 6).collect()), key=str) == sorted([(None, 1, 0), (None, 2, 0), (None, 3, 1), (big + 1, 1, 0), (big + 2, 1, 0)], key=str)


def test_scratch_is_freed(spark):
    import os

    from textloom import session as S

    with S.tidy(spark) as kept:
        a, b = S.scratch(spark, "a"), S.scratch(spark, "b")
        for p in (a, b):
            spark.range(1).write.parquet(p)
        kept.append(a)
    there = lambda p: os.path.exists(p.replace("file://", ""))
    assert there(a) and not there(b)


def test_running_sums_over_parts_of_a_key(spark):
    import random

    from textloom.functions.running import running

    rnd = random.Random(5)
    rows = [(None if k == 3 else k, i, rnd.randint(0, 9)) for i, k in enumerate(rnd.choice([1, 1, 1, 2, 3]) for _ in range(300))]
    got = {r.i: (r.rank, r.t) for r in running(spark.createDataFrame(rows, "k int, i int, v int"), "k", ["i"], t=F.col("v")).collect()}
    seen = {}
    for k, i, v in rows:
        n, t = seen.get(k, (0, 0))
        seen[k] = n + 1, t + v
        assert got[i] == seen[k]


def test_semantic_chunks_lose_no_word_and_keep_terms():
    import random

    from textloom.operators import boundaries as B

    rnd = random.Random(8)
    for _ in range(60):
        words = [rnd.choice(["alpha", "beta", "ends.", "so;", "knowledge", "graph", "However", "machine", "learning"]) for _ in range(rnd.randint(0, 900))]
        chunks = B.semantic_chunks(" ".join(words), 40, 80, 10)
        assert [w for c in chunks for w in c.words] == words and all(len(c.words) <= 80 for c in chunks)
        assert all(len(c.words) >= 10 or len(a.words) + len(c.words) > 80 for a, c in zip(chunks, chunks[1:]))
    words = ["w"] * 30 + ["knowledge", "graph"] + ["w"] * 30
    assert B.keep_terms(words, 31, 80) == (32, []) and B.keep_terms(words, 31, 31) == (30, []) and B.keep_terms(words, 30, 80) == (30, [])
    assert B.keep_terms(["machine", "learning", "x"], 1, 1) == (1, ["machine learning"])
    assert B.boundary("one two. three four. five six seven".split()) == 4 and B.boundary(["no", "end"]) == 0
    assert B.semantic_chunks(None) == B.semantic_chunks("  ") == []


def test_chunk_boundaries_over_a_table(spark, tmp_path):
    from textloom.plans import registry

    spark.createDataFrame([(1, "a b. " * 400), (None, None), ((1 << 60) + 1, "short")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["chunk_boundaries"](spark, str(tmp_path)).collect()
    assert sum(r.n_words for r in got if r.doc_id == 1) == 800 and [(r.chunk, r.n_words) for r in got if r.doc_id == (1 << 60) + 1] == [(0, 1)] and len({r.doc_id for r in got}) == 2


def test_folds_lose_no_row_and_change_no_number(spark):
    from textloom.operators.signals import sent_alerts
    from textloom.operators.timelines import rate_limited

    big = (1 << 60) + 1
    rows = [(7, None, big), (7, 0, None), (7, 5, big + 2), (7, 100, big + 3), (7, 109, big + 4), (None, 3, big + 5), (big, big, 1), (big, None, None)]
    df = spark.createDataFrame(rows, "k long, t long, id long").coalesce(1)
    sent = sent_alerts(df, "k", "t", "id", 10).collect()
    assert sorted(map(tuple, sent), key=str) == sorted([(7, 0, None), (7, 100, big + 3), (7, None, big), (None, 3, big + 5), (big, big, 1), (big, None, None)], key=str)
    told = {(r.k, r.t, r.id): r.reason for r in rate_limited(df, "k", "t", "id", (2, 1), (5, 1)).collect()}
    assert set(told) == set(rows)
    assert told[7, 0, None] == told[7, 5, big + 2] == "ok" and told[7, 100, big + 3] == told[7, 109, big + 4] == "limit" and told[7, None, big] is None and told[big, big, 1] == "ok"
