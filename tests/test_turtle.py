"""Turtle statements, wherever a file is cut."""

from collections import Counter

import pytest

from textloom.sources import turtle as T

FILE = '''@prefix ex: <http://ex.org/v1.0/> . # a prefix. with stops
PREFIX y: <http://y/>
ex:a a ex:Thing ; ex:label "one. two"@en , 'zwei "Stück"'@de ;
   ex:note """A long literal. It has "quotes" .
# no comment here .
and ends.""" , \'\'\'it's
another .\'\'\'^^ex:text ; .
ex:b ex:size 1.5 , -3 , true ; ex:see <http://x/y.z> . ex:c ex:says "say \\"hi.\\" \\u00e9\\n" .
ex:d ex:has [ ex:k "v" ; ex:l [ a ex:Deep ] ] ; ex:list ( 1 "two" ex:three ) ; ex:none () .
ex:e.f ex:p ex:g.h .
ex:broken ex:p "no end"
'''


def test_statement():
    got = [t for s in _statements(FILE) for t in T.triples_of(s)]
    plain = [t for t in got if not any(str(x).startswith("_:") for x in t[:3])]
    assert plain == [
        ("ex:a", f"<{T.RDF}type>", "ex:Thing", None, None), ("ex:a", "ex:label", "one. two", "en", None), ("ex:a", "ex:label", 'zwei "Stück"', "de", None),
        ("ex:a", "ex:note", 'A long literal. It has "quotes" .\n# no comment here .\nand ends.', None, None), ("ex:a", "ex:note", "it's\nanother .", None, "ex:text"),
        ("ex:b", "ex:size", "1.5", None, None), ("ex:b", "ex:size", "-3", None, None), ("ex:b", "ex:size", "true", None, None), ("ex:b", "ex:see", "<http://x/y.z>", None, None),
        ("ex:c", "ex:says", 'say "hi." é\n', None, None), ("ex:d", "ex:none", f"<{T.RDF}nil>", None, None), ("ex:e.f", "ex:p", "ex:g.h", None, None),
    ]
    nested = [t for t in got if t not in plain]
    has = next(t for t in nested if t[1] == "ex:has")[2]
    deep = next(t for t in nested if t[0] == has and t[1] == "ex:l")[2]
    assert (has, "ex:k", "v", None, None) in nested and (deep, f"<{T.RDF}type>", "ex:Deep", None, None) in nested
    at, items = next(t for t in nested if t[1] == "ex:list")[2], []
    while at != f"<{T.RDF}nil>":
        items.append(next(t[2] for t in nested if t[:2] == (at, f"<{T.RDF}first>")))
        at = next(t[2] for t in nested if t[:2] == (at, f"<{T.RDF}rest>"))
    assert items == ["1", "two", "ex:three"]


def _statements(text):
    out, state, held = [], T.OUTSIDE, ""
    for line in text.splitlines():
        state, ends = T.ends_of(line, state)
        a = 0
        for e in ends:
            out.append(held + line[a:e])
            held, a = "", e
        held += line[a:] + "\n"
    return out


@pytest.mark.parametrize("size", [1, 150, 1 << 20])
def test_cuts_do_not_matter(spark, tmp_path, size):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.ttl").write_text(FILE)
    (tmp_path / "t" / "b.ttl").write_text(FILE.replace("ex:", "b:") * 2)
    want = Counter(t for text in (FILE, FILE.replace("ex:", "b:") * 2) for s in _statements(text) for t in T.triples_of(s))
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], max(size, 1))
        spark.conf.set(keys[1], 0)
        assert Counter(map(tuple, T.read_turtle(spark, str(tmp_path / "t")).collect())) == want
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)


def test_files_without_statements(spark, tmp_path):
    (tmp_path / "e.ttl").write_text("# nothing .\n")
    assert T.read_turtle(spark, str(tmp_path / "e.ttl")).count() == 0
