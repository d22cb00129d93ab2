"""Queries whose rules seldom or never fire on the given tables, on planted texts: against hand-written results and the SQL."""

import duckdb
import pytest
from test_queries import SF, TABLES, rows

from textloom.plans import registry

TECHNICAL = "The software module has a function and a class. The algorithm in the code uses an API and a database server. Neural Network (NN) models run in production.\n\nThe program calls a method of the interface with parameters and variables. "
MEDICAL = "The patient has a diagnosis and gets treatment in the hospital. The doctor notes a symptom of the disease. Aspirin is a medication. Chronic infection causes high fever. "
LEGAL = "The court heard the plaintiff and the defendant about the contract. The law and the statute of this jurisdiction bind the attorney under section 4 above. "
ACADEMIC = "The research and its methodology test a hypothesis in an experiment. See Section 3.1 and refer to figure 2, as mentioned in chapter 7. The literature review has a citation of a peer-reviewed journal. "
NARRATIVE = "The story has a character in a scene with dialogue. The novel has a plot, a protagonist and an antagonist, and its theme is a metaphor. "
DOCUMENTS = [
    (1, TECHNICAL * 3), (2, MEDICAL * 3), (3, LEGAL * 3), (4, "Section 3.1 Methods\n" + ACADEMIC * 3 + "\nFigure 2 shows it."), (5, NARRATIVE * 3), (6, "Nothing to see here at all."), (7, ""), (8, None),
    (9, "Application Programming Interface (API) and API (Application Programming Interface)."),
    (10, "Machine Learning is a Data Science\nDeep Learning is part of Machine Learning\nHeavy Rain causes Flash Flood\nBlue Whale is related to Sperm Whale"),
]
# long enough for chunks, with changes of the kind of text between them
DOCUMENTS += [(20 + i, (a * 14 + b * 14)) for i, (a, b) in enumerate([(TECHNICAL, MEDICAL), (MEDICAL, LEGAL), (LEGAL, ACADEMIC), (ACADEMIC, NARRATIVE), (NARRATIVE, TECHNICAL)])]
DOCUMENTS += [(30 + i, a * 30) for i, a in enumerate([TECHNICAL, MEDICAL, LEGAL, ACADEMIC, NARRATIVE])]
CONVERSATIONS = [
    (1, 1, "user", "My email is jo.doe@example.org and my SSN is 123-45-6789. The page is slow and shows an error, it is broken."), (1, 2, "assistant", "See [SRC0] and source: src1 and [unknown one]."),
    (1, 3, "user", "This is confusing, I can't find the button."), (2, 1, "user", "Thanks, great answer."), (2, 2, "assistant", ""),
]
ASKED = (
    "What did our team observe at Chelsea?", "How does smoking cause cancer, and why?", "Compare the findings of the two studies", "List what the engineers report", "hello there",
    "Which section is part of the whole?", "we discuss how they explain and show this analysis",
)
CONVERSATIONS += [(10, i, "user", q) for i, q in enumerate(ASKED, 1)]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("planted"))
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(200).write.parquet(f"{d}/{t}.parquet")
    put = lambda rows, schema, t: spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{d}/{t}.parquet")
    put([(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in DOCUMENTS], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    put(CONVERSATIONS, "conv_id long, turn long, role string, text string", "conversations")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    return d, con


def run(spark, planted, name):
    return registry.queries()[name](spark, planted[0]).collect()


FIRES = ("acronym_links", "reference_kinds", "reference_targets", "concept_relations", "relation_patterns", "content_type_classify", "sensitive_flags", "citation_sources", "issue_categories", "query_understanding", "gap_decision", "gap_references", "gap_domain", "orphan_anti_join")


@pytest.mark.parametrize("name", FIRES)
def test_fires_and_matches_sql(spark, planted, name):
    got = registry.queries()[name](spark, planted[0]).toPandas()
    assert len(got) and rows(got) == rows(planted[1].execute(registry.oracle_sql()[name]).df())


def test_content_types_by_hand(spark, planted):
    got = {r.doc_id: r.content_type for r in run(spark, planted, "content_type_classify")}
    assert {k: got[k] for k in range(1, 7)} == {1: "technical", 2: "medical", 3: "legal", 4: "academic", 5: "narrative", 6: "general"}


def test_references_by_hand(spark, planted):
    kinds = {(r.doc_id, r.reference, r.target_type, r.label): r.n for r in run(spark, planted, "reference_kinds") if r.doc_id < 20}
    assert kinds == {(4, "explicit", "section", "3.1"): 3, (4, "explicit", "figure", "2"): 3, (4, "backward", "chapter", "7"): 3, (3, "positional", "section", "4"): 3}
    found = {(r.doc_id, r.target_type, r.label): r.found for r in run(spark, planted, "reference_targets") if r.doc_id < 20}
    assert found == {(4, "section", "3.1"): True, (4, "figure", "2"): True, (4, "chapter", "7"): False, (3, "section", "4"): False}


def test_acronyms_by_hand(spark, planted):
    got = {(r.acronym, r.expansion): r.n_docs for r in run(spark, planted, "acronym_links")}
    assert got[("API", "Application Programming Interface")] == 1


def test_citations_and_secrets_by_hand(spark, planted):
    got = {(r.conv_id, r.turn, r.name): r.known for r in run(spark, planted, "citation_sources")}
    assert got == {(1, 2, "src0"): True, (1, 2, "src1"): True, (1, 2, "unknown one"): False}
    assert {(r.conv_id, r.turn) for r in run(spark, planted, "sensitive_flags") if r.sensitive} == {(1, 1)}


def test_chunks_of_all_kinds_have_gaps(spark, planted):
    got = run(spark, planted, "gap_decision")
    assert {r.kind for r in got} >= {"technical", "medical", "legal", "academic", "narrative"} and len({r.gap_type for r in got}) > 1
    assert any(r.domain_gap is not None for r in run(spark, planted, "gap_domain"))
    assert any(r.forward or r.backward for r in run(spark, planted, "gap_references"))


def test_queries_are_understood(spark, planted):
    got = {r.turn: r for r in run(spark, planted, "query_understanding") if r.conv_id == 10}
    assert got[1].subject == "our team" and got[1].actions == "observe" and got[1].intent == "factual" and got[1].n_content == 1  # chelsea
    assert got[2].relation == "CAUSES" and got[2].intent == "explanation" and got[3].intent == "comparison" and got[3].subject == "the findings"
    assert got[4].subject == "the engineers" and got[4].intent == "search" and got[6].relation == "PART_OF" and got[5].intent == "conversational"
    assert set(got[7].actions.split(",")) == {"discuss", "explain", "show"} and got[7].n_content == 1 and got[7].subject == "we"  # analysis
