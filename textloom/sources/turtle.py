"""Turtle files of any layout: statements over several lines, ``;`` and ``,`` lists, long literals, nested nodes.

A file is cut into splits of whole lines.  At the start of a line a statement is either
outside of literals or within a long one (of two kinds), so a split is a map of three
states.  A first pass finds the maps, one row a split; put together they tell in which
state each split begins.  A second pass cuts the splits' lines into pieces of numbered
statements; a statement whose pieces lie in several splits is put together by its number.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.plans.registry import query
from textloom.session import scratch, ship, table

#: States at the start of a line: outside of literals, within a long one.
OUTSIDE, DOUBLE, SINGLE = 0, 1, 2
_CLOSE = {DOUBLE: re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""', re.S), SINGLE: re.compile(r"(?:[^'\\]|\\.|'(?!''))*'''", re.S)}
_SKIP = re.compile(r"""<[^>]*>|"(?!"")(?:[^"\\]|\\.)*"|'(?!'')(?:[^'\\]|\\.)*'|#.*|(?P<long>\"{3}|'{3})|(?P<end>\.(?=\s|$|#))|.""")
_TOKEN = re.compile(r"""\s+|#[^\n]*|(?P<token><[^>]*>|(?P<literal>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')(?:@(?P<lang>[A-Za-z0-9-]+)|\^\^(?P<type><[^>]*>|[^\s;,.\[\]()]+))?|[;,\[\]()]|\.(?=\s|$)|[^\s;,\[\]()<"']+?(?=[\s;,\[\]()]|\.?$|\.\s))""", re.S)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_ESCAPED = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}
TRIPLE = "subject string, predicate string, object string, lang string, type string"
#: Names of the standard's own vocabulary.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def ends_of(line: str, state: int) -> tuple[int, list[int]]:
    """State after a line, and the places behind the full stops that end statements in it."""
    at, ends = 0, []
    while True:
        if state != OUTSIDE:
            m = _CLOSE[state].match(line, at)
            if not m:
                return state, ends
            at, state = m.end(), OUTSIDE
        m = _SKIP.match(line, at)
        if not m:
            return state, ends
        at = m.end()
        if m["end"]:
            ends.append(at)
        elif m["long"]:
            state = DOUBLE if m["long"] == '"""' else SINGLE


def _text(literal: str) -> str:
    body = literal[3:-3] if literal[:3] in ('"""', "'''") and len(literal) >= 6 else literal[1:-1]
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPED.get(m[1], m[1]), body)


def triples_of(statement: str) -> list[tuple[str, str, str, str | None, str | None]]:
    """Triples of one statement; directives have none, and what is no Turtle gives those before it."""
    found = [m for m in _TOKEN.finditer(statement) if m["token"]]
    while found and (word := found[0]["token"].lower()) in ("prefix", "base"):  # these end without a full stop
        found = found[3 if word == "prefix" else 2 :]
    if not found or found[0]["token"] in ("@prefix", "@base", "."):
        return []
    out: list[tuple[str, str, str, str | None, str | None]] = []
    at, nodes = 0, 0
    mark = hashlib.md5(statement.strip().encode("utf-8", "surrogatepass")).hexdigest()[:12]

    def node() -> str:
        nonlocal nodes
        nodes += 1
        return f"_:{mark}n{nodes}"

    def peek() -> str:
        return found[at]["token"] if at < len(found) else "."

    def term() -> tuple[str, str | None, str | None]:
        nonlocal at
        m = found[at]
        at += 1
        if m["token"] == "[":
            name = node()
            pairs(name)
            at += peek() == "]"
            return name, None, None
        if m["token"] == "(":
            items = []
            while peek() not in (")", "."):
                items.append(term())
            at += peek() == ")"
            names = [node() for _ in items]
            for i, item in enumerate(items):
                out.append((names[i], f"<{RDF}first>", *item))
                out.append((names[i], f"<{RDF}rest>", names[i + 1] if i + 1 < len(items) else f"<{RDF}nil>", None, None))
            return names[0] if items else f"<{RDF}nil>", None, None
        return (_text(m["literal"]), m["lang"], m["type"]) if m["literal"] else (m["token"], None, None)

    def pairs(subject: str) -> None:
        nonlocal at
        while peek() not in (".", "]"):
            if peek() == ";":
                at += 1
                continue
            predicate = f"<{RDF}type>" if peek() == "a" else peek()
            at += 1
            while peek() not in (".", ";", "]"):
                out.append((subject, predicate, *term()))
                if peek() != ",":
                    break
                at += 1

    pairs(term()[0])
    return out


def _lines(spark: SparkSession, path: str) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.text(path).select(F.concat_ws(":", meta["file_path"], F.lpad(meta["file_block_start"].cast("string"), 15, "0")).alias("split"), meta["file_path"].alias("file"), F.col("value").alias("line"))


def statements(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``statement``, with its full stop, of every statement; text behind a file's last full stop is none."""
    ship(spark)
    lines = _lines(spark, path)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list] = {}
        for b in batches:  # a task's lines come in the order of its splits
            for split, file, line in zip(*(b[c].to_pylist() for c in ("split", "file", "line"))):
                m = seen.setdefault(split, [file, [0, 1, 2], [0, 0, 0]])
                told = {s: ends_of(line, s) for s in set(m[1])}
                m[2] = [n + len(told[s][1]) for n, s in zip(m[2], m[1])]
                m[1] = [told[s][0] for s in m[1]]
        rows = [(k, *m) for k, m in seen.items()]
        yield pa.RecordBatch.from_pydict({"split": [r[0] for r in rows], "file": [r[1] for r in rows], "to": [r[2] for r in rows], "n": [r[3] for r in rows]}, pa.schema([("split", pa.string()), ("file", pa.string()), ("to", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))]))

    begins: dict[str, tuple[int, int]] = {}
    state, number, last = OUTSIDE, 0, None
    for r in lines.mapInArrow(maps, "split string, file string, to array<long>, n array<long>").orderBy("split").toLocalIterator():  # one row a split
        if r.file != last:
            state, number, last = OUTSIDE, 0, r.file
        begins[r.split] = (state, number)
        state, number = r["to"][state], number + r["n"][state]
    sent = spark.sparkContext.broadcast(begins)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, state, number, place = None, OUTSIDE, 0, 0
        for b in batches:
            out = []
            for at, file, line in zip(*(b[c].to_pylist() for c in ("split", "file", "line"))):
                if at != split:
                    split, (state, number), place = at, sent.value[at], 0
                state, ends = ends_of(line, state)
                a = 0
                for e in [*ends, len(line) + 1]:
                    if a < e:
                        out.append((file, number, at, place, (line + "\n")[a:e], e <= len(line) and e in ends))
                        place += 1
                    a, number = e, number + (e in ends)
            yield pa.RecordBatch.from_pydict({k: [r[i] for r in out] for i, k in enumerate(("file", "number", "split", "place", "piece", "ends"))}, pa.schema([("file", pa.string()), ("number", pa.int64()), ("split", pa.string()), ("place", pa.int64()), ("piece", pa.string()), ("ends", pa.bool_())]))

    cut = lines.mapInArrow(pieces, "file string, number long, split string, place long, piece string, ends boolean")
    whole = cut.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("split", "place", "piece"))).alias("p"), F.bool_or("ends").alias("ends"))
    return whole.where("ends").select("file", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("statement"))


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Triples ``subject``, ``predicate``, ``object``, ``lang`` and ``type`` of all files at ``path``; names as they are written, literals without quotes and escapes.

    ``a`` becomes the full name of the type relation; ``[ ]`` and ``( )`` become nodes whose
    names follow from their statement's text.
    """

    @F.pandas_udf(f"array<struct<{', '.join(c.replace(' ', ':') for c in TRIPLE.split(', '))}>>")
    def parsed(texts: pd.Series) -> pd.Series:
        names = [c.split()[0] for c in TRIPLE.split(", ")]
        return pd.Series([[dict(zip(names, t)) for t in triples_of(s)] for s in texts])

    return statements(spark, path).select(F.explode(parsed("statement")).alias("t")).select("t.*")


@query("turtle_statements", f"""
SELECT 'ex:p' || p_partkey AS subject, unnest(['<{RDF}type>', 'ex:name', 'ex:name', 'ex:size', 'ex:maker']) AS predicate, unnest(['ex:Part', p_name, 'a "' || p_brand || '"' || chr(10) || 'of. sorts', p_size::VARCHAR, '_:m']) AS object,
  unnest(['', 'en', '', '', '']) AS lang FROM part
UNION ALL SELECT '_:m', 'ex:label', p_brand, '' FROM part""")
def turtle_statements(spark: SparkSession, d: str) -> DataFrame:
    """All parts, written as Turtle of several lines with lists, long literals and nested nodes, and read back; nested nodes are all called _:m."""
    p = table(spark, d, "part")
    text = F.concat(
        F.lit("# part. \nex:p"), "p_partkey", F.lit('\n  a ex:Part ;\n  ex:name "'), "p_name", F.lit('"@en ,\n    """a "'), "p_brand", F.lit('"\nof. sorts""" ;\n  ex:size '), "p_size",
        F.lit(' ;\n  ex:maker [ ex:label "'), "p_brand", F.lit('" ] .'))
    path = scratch(spark, "turtle")
    p.select(text.alias("value")).write.text(path)
    mask = lambda c: F.regexp_replace(c, "^_:.*", "_:m").alias(c)
    return read_turtle(spark, path).select(mask("subject"), "predicate", mask("object"), F.coalesce("lang", F.lit("")).alias("lang"))
