"""Dumps and exports on small files and tables."""

from textloom.sources import graphdumps as G, knowledge


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_release_files(spark, tmp_path):
    for n in ("MRCONSO.RRF", "MRSTY.RRF", "MRDEF.RRF"):
        (tmp_path / n).write_text("")
    there, missing = G.validate_release(spark, str(tmp_path))
    assert sorted(there) == ["MRCONSO.RRF", "MRDEF.RRF", "MRSTY.RRF"] and missing == ["MRREL.RRF"]


def test_vocabulary_files(spark, tmp_path):
    (tmp_path / "rel").write_text("C1|a|b|RO|C2|c|d|treats|e|f|MSH|x\nshort|line\nC2|a|b|RB|C3|c|d||e|f|MSH\n")
    (tmp_path / "sty").write_text("C1|T047|x\nonly\n")
    (tmp_path / "def").write_text("C1|a|b|c|MSH|A pump|x\nC1|a|b|c|MSH||x\n")
    (tmp_path / "net").write_text("STY|T047|Disease|B2.2|A condition|x\nRL|T100|treats|R3|Applies|x\nXX|no|no|no|no\n")
    assert rows(knowledge.read_relations(spark, str(tmp_path / "rel"))) == [("C1", "RO", "C2", "treats", "MSH"), ("C2", "RB", "C3", None, "MSH")]
    assert rows(knowledge.read_semantic_types(spark, str(tmp_path / "sty"))) == [("C1", "T047")]
    assert rows(knowledge.read_definitions(spark, str(tmp_path / "def"))) == [("C1", "MSH", "A pump")]
    assert [r.tui for r in G.read_semantic_network(spark, str(tmp_path / "net")).orderBy("tui").collect()] == ["T047", "T100"]


def test_prefixes(spark, tmp_path):
    (tmp_path / "t.ttl").write_text("@prefix y: <http://y/> .\ny:A\ty:knows\ty:B .\ny:A\tz:k\t\"y:text\"@en .\n")
    path = str(tmp_path / "t.ttl")
    got = G.expanded(knowledge.read_triples(spark, path), G.read_prefixes(spark, path), "subject", "predicate")
    assert rows(got.select("subject", "predicate", "object")) == [("http://y/A", "http://y/knows", "y:B"), ("http://y/A", "z:k", "y:text")]


CONCEPTS = [("C1", "Heart", ["Cor", "heart"]), ("C2", "Cor", []), ("C3", "Valve", [])]


def concepts(spark):
    return spark.createDataFrame(CONCEPTS, "cui string, name string, synonyms array<string>")


def test_bridge_prefers_preferred_names(spark):
    names = spark.createDataFrame([("heart",), ("COR",), (None,), ("none",), ("heart",)], "name string")
    assert rows(G.bridge(names, concepts(spark))) == [("COR", "C1", "synonym"), ("COR", "C2", "preferred"), ("heart", "C1", "preferred")]


def test_edges_are_validated(spark):
    a = spark.createDataFrame([("PartOf", "valve", "heart", 1.0), ("PartOf", "Valve", "heart", 3.0), ("IsA", "valve", "thing", 1.0), (None, "heart", "valve", 1.0)], "relation string, start string, end string, weight double")
    names = spark.createDataFrame([("Heart",), ("valve",)], "name string")
    assert rows(G.validated_edges(a, names)) == [("heart", "RELATED_TO", "valve", 1.0), ("valve", "PART_OF", "heart", 3.0)]
    e = spark.createDataFrame([("x", "y"), ("x", "gone")], "a string, b string")
    assert rows(G.without_dead_ends(e, spark.createDataFrame([("x",), ("y",)], "entity_id string"))) == [("x", "y")]


def test_same_as_needs_separate_documents(spark):
    c = spark.createDataFrame([(1, "Q1", ["d1"]), (2, "Q1", ["d2"]), (3, "Q1", ["d1", "d3"]), (4, None, ["d9"]), (5, "Q2", None)], "concept_id int, qid string, docs array<string>")
    assert rows(G.same_as(c)) == [(1, 2, "Q1"), (2, 3, "Q1")]


def test_import_marks_what_is_gone(spark):
    old = spark.createDataFrame([("a", "A", False), ("b", "B", True), ("c", "C", False)], "entity_id string, label string, deleted boolean")
    new = spark.createDataFrame([("b", "B2"), ("b", "B2"), ("d", "D")], "entity_id string, label string")
    assert rows(G.import_entities(old, new)) == [("a", "A", True), ("b", "B2", False), ("c", "C", True), ("d", "D", False)]


def test_query_expansion(spark):
    rel = spark.createDataFrame([("C3", "C1")], "cui1 string, cui2 string")
    got = G.expand_query(spark.createDataFrame([("heart",), ("alone",)], "term string"), concepts(spark), rel)
    assert rows(got) == [("alone", "alone", 1.0), ("heart", "cor", 0.8), ("heart", "heart", 1.0), ("heart", "valve", 0.5)]


def test_instances_and_links(spark):
    e = spark.createDataFrame([("e1", "Rex", ["Dog"]), ("e2", "Tom", ["Cat"]), ("e3", "Oak", ["Tree"]), ("e4", None, None)], "entity_id string, label string, types array<string>")
    sub = spark.createDataFrame([("Dog", "Animal"), ("Cat", "Animal"), ("Animal", "Thing"), ("Thing", "Animal")], "sub string, super string")
    assert rows(G.instances_of(e, sub, "Animal")) == [("e1",), ("e2",)] and rows(G.instances_of(e, sub, "Plant")) == []
    c = spark.createDataFrame([(1, "Rex"), (2, "oak")], "concept_id int, name string")
    assert rows(G.entity_links(c, e)) == [(1, "e1", "INSTANCE_OF", "Dog", 1.0), (2, "e3", "INSTANCE_OF", "Tree", 0.8)]
    assert rows(G.entity_links(c, e, 0.9)) == [(1, "e1", "INSTANCE_OF", "Dog", 1.0)]


def test_pages_under_markers(spark):
    p = spark.createDataFrame([(1, 2, "Title\n17\ntext"), (1, 1, "no number 5"), (1, 3, None), (2, 1, "x")], "doc_id int, page int, text string")
    got = {r.doc_id: (r.text, r.failed) for r in G.page_text(p).collect()}
    assert got == {1: ("[Page 1]\nno number 5\n[Page 17]\nTitle\n17\ntext\n[Page 3: no text]", 1), 2: ("[Page 1]\nx", 0)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b"), (2, None)], "k int, v string")
    knowledge.write_jsonl(df, str(tmp_path / "j"))
    knowledge.write_csv(df, str(tmp_path / "c"))
    G.write_report(df, str(tmp_path / "t"), "rows")
    G.write_report(df, str(tmp_path / "h"), "rows", "html")
    assert rows(spark.read.schema("k int, v string").json(str(tmp_path / "j"))) == [(1, "a<b"), (2, None)] == rows(spark.read.schema("k int, v string").option("header", True).csv(str(tmp_path / "c")))
    assert rows(spark.read.text(str(tmp_path / "t"))) == [("1 | a<b",), ("2 | ",)]
    assert rows(spark.read.text(str(tmp_path / "h"))) == [('<li title="rows">1 | a&lt;b</li>',), ('<li title="rows">2 | </li>',)]


def test_names_in_order_of_their_lines(spark, tmp_path):
    line = lambda ts, stt, name: "|".join(["C1", "ENG", ts, "L", stt, *["x"] * 6, "MSH", "PT", "c", name, "0", "N", ""])
    (tmp_path / "c").write_text("\n".join([line("S", "PF", "Zeta"), line("P", "PF", "Pump"), line("P", "PF", "Heart"), line("S", "VO", "Alpha"), line("S", "VO", "Zeta")]))
    got = knowledge.preferred_names(knowledge.read_concepts(spark, str(tmp_path / "c"))).first()
    assert (got.name, got.synonyms) == ("Pump", ["Zeta", "Heart", "Alpha"])
