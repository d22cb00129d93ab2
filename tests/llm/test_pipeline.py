"""The pipeline on a small folder of tables, stage by stage against plain rules."""

import random

import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rnd = random.Random(6)
    prose = lambda n: " ".join(rnd.choice(["green", "river", "stone", "walks", "under", "old", "bridge", "while", "birds", "sing"]) + str(rnd.randrange(300)) for _ in range(n))
    rows = [(i, prose(60)) for i in range(80)] + [(100 + i, " | ".join(["##!!", "$$", "X!!"] * 12) + str(i)) for i in range(40)]
    item = prose(20)
    rows += [(200, rows[3][1].replace(" ", "  ", 3)), (201, rows[4][1] + " tail"), (202, prose(30) + " " + item + " " + prose(10)), (203, None)]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(80), *range(100, 140)]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, folder)
        if name != "encode":
            assert out.columns == docs.columns
        docs = p.written(out, "test-stage")
        seen[name] = {r.doc_id for r in docs.collect()}
    clean = set(range(80))
    assert clean <= seen["quality"] and not seen["quality"] & set(range(100, 140))
    assert seen["quality"] - seen["exact"] == {200}
    assert seen["exact"] - seen["near"] == {201}
    assert seen["near"] - seen["decontaminate"] == {202}
    assert seen["encode"] == seen["decontaminate"]
    assert {r.doc_id for r in p.run(spark, folder).collect()} == seen["encode"]


def test_entry_registers_all_operators_and_the_pipeline():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(q.startswith(f"op{n}_") for q in names) == 1 for n in range(1, 14))
