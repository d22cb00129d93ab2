"""The keyword index against a full scan, through updates and a broken one."""

import glob
import math
import random
from collections import Counter

import pytest

from textloom.operators import keyword_index as K

WORDS = [f"word{i}" for i in range(40)] + ["common"]


def prose(rnd, n):
    return " ".join("common" if rnd.random() < 0.3 else rnd.choice(WORDS) for _ in range(n))


def scan(docs, queries, k):
    split = {d: (t or "").split() for d, t in docs.items()}
    n, mean = len(split), sum(map(len, split.values())) / len(split)
    df = Counter(w for ws in split.values() for w in set(ws))
    out = []
    for item, text in queries:
        scores = []
        for d, ws in split.items():
            tf = Counter(ws)
            hit = [w for w in set((text or "").split()) if tf[w]]
            if hit:
                s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (K.K1 + 1) / (tf[w] + K.K1 * (1 - K.B + K.B * len(ws) / mean)) for w in hit)
                scores.append((-round(s, K.PLACES), d))
        out += [(item, d, r + 1) for r, (_, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def ranks(found):
    return sorted((r.item_id, r.doc, r.rank) for r in found.collect())


@pytest.fixture(scope="module")
def state(spark, tmp_path_factory):
    rnd = random.Random(1)
    docs = {i: prose(rnd, rnd.randint(0, 40)) for i in range(-20, 1500)} | {5000: None, 5001: "", 1 << 50: "word1 common"}
    path = str(tmp_path_factory.mktemp("index") / "i")
    K.build_index(spark.createDataFrame([*docs.items(), (None, "word2")], "doc_id long, text string"), path, buckets=4)
    queries = [(i, prose(rnd, 5)) for i in range(6)] + [(7, "common"), (8, None), (9, "nothing known"), (None, "word1")]
    return docs, path, spark.createDataFrame(queries, "item_id long, text string"), [q for q in queries if q[0] is not None]


def test_search_updates_and_resumes(spark, state, monkeypatch):
    docs, path, asked, queries = state
    opened = {}
    monkeypatch.setattr(K, "written", lambda df, name, keep=K.written: opened.setdefault(name, keep(df, name)) if name in ("bounds", "rest") else keep(df, name))
    index = K.Index(spark, path)
    assert ranks(index.search(asked, 5)) == scan(docs, queries, 5)
    assert opened["rest"].count() < 0.8 * opened["bounds"].count()  # blocks below the threshold stay closed
    monkeypatch.undo()

    before = {f: open(f, "rb").read() for f in glob.glob(f"{path}/postings/**/*.parquet", recursive=True)}
    changed = {3: "word1 word1 unheard", 4: None, 6000: "word7 common", 1 << 50: "word3"}
    gone = [10, 11, 999999]
    # a segment without a commit, as a lost driver leaves it, counts for nothing
    spark.createDataFrame([(3, 1, ["zzz"])], "doc long, len int, terms array<string>").write.parquet(f"{path}/docs/segment=1")
    index.update(spark.createDataFrame(list(changed.items()), "doc_id long, text string"), spark.createDataFrame([(g,) for g in gone], "doc_id long"))
    docs = {d: t for d, t in (docs | changed).items() if d not in gone}
    assert ranks(K.Index(spark, path).search(asked, 5)) == scan(docs, queries, 5)
    after = glob.glob(f"{path}/postings/**/*.parquet", recursive=True)
    assert set(before) < set(after) and all(open(f, "rb").read() == b for f, b in before.items())

    # a term that only the update has touches one bucket
    new = set(after)
    index.update(spark.createDataFrame([(7000, "zebra")], "doc_id long, text string"))
    assert len({f.split("bucket=")[1].split("/")[0] for f in set(glob.glob(f"{path}/postings/**/*.parquet", recursive=True)) - new}) == 1
    index.update(deleted=spark.createDataFrame([(7000,), (3,)], "doc_id long"))
    docs = {d: t for d, t in docs.items() if d != 3}
    assert ranks(index.search(asked, 5)) == scan(docs, queries, 5) and index.n == len(docs)

    texts = spark.createDataFrame(list(docs.items()) + [(3, "was deleted")], "doc_id long, text string")
    whole = K.Index(spark, K.compact(spark, path, path + "-compact", texts))
    assert whole.segments == [0] and ranks(whole.search(asked, 5)) == scan(docs, queries, 5)


def test_phrases(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox and the dog"), (2, "fox red dog"), (3, "red fox fox dog"), (4, None)], "doc_id long, text string")
    index = K.Index(spark, K.build_index(docs, str(tmp_path / "i"), buckets=2))
    asked = spark.createDataFrame([(1, ["red", "fox"]), (2, ["fox", "dog"]), (3, ["fox", "fox"]), (4, ["cat"]), (5, []), (6, None)], "item_id long, words array<string>")
    assert sorted(map(tuple, index.phrases(asked).collect())) == [(1, 1), (1, 3), (2, 1), (2, 3), (3, 3)]


def test_empty_index(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    index = K.Index(spark, K.build_index(empty, str(tmp_path / "i")))
    asked = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert index.search(asked, 3).count() == 0
    index.update(spark.createDataFrame([(1, "word word")], "doc_id long, text string"))
    assert [(r.doc, r.rank) for r in index.search(asked, 3).collect()] == [(1, 1)]
