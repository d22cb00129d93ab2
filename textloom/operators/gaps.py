"""Gaps between neighbouring chunks: distance, overlap, references, continuity, and what to do about them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from textloom.functions import rules as R
from textloom.operators.texts import _CHUNKS, content_type
from textloom.plans.registry import oracle, query
from textloom.session import table

#: Words of a chunk.
CHUNK = 256
#: Pairs of neighbouring chunks with their document's content type.
_PAIRS = f"""{_CHUNKS}, types AS ({oracle('content_type_classify')}), pairs AS (
  SELECT doc_id, chunk, content AS c1, nxt AS c2, lower(content) AS l1, lower(nxt) AS l2, content_type AS kind FROM (SELECT *, lead(content) OVER (PARTITION BY doc_id ORDER BY chunk) AS nxt FROM chunks) JOIN types USING (doc_id) WHERE nxt IS NOT NULL)"""


def chunk_pairs(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id``, ``chunk``, both contents (``c1``, ``c2``, and in lower case ``l1``, ``l2``) and ``kind``, the document's content type."""
    # dealt by id: a small file is one task's split
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL").select("doc_id", "text").repartition("doc_id")
    w = docs.select("doc_id", F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda x: x != "").alias("w"), content_type(F.col("text")).alias("kind")).where(F.size("w") > CHUNK)
    # both chunks of a pair come from the document's own row, so no text is shuffled
    content = lambda i: F.array_join(F.slice("w", i * CHUNK + 1, F.lit(CHUNK)), " ")
    each = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / CHUNK).cast("int") - 1), lambda i: F.struct(i.cast("long").alias("chunk"), content(i).alias("c1"), content(i + 1).alias("c2")))
    return w.select("doc_id", "kind", F.explode(each).alias("p")).select("doc_id", "p.chunk", "p.c1", "p.c2", F.lower("p.c1").alias("l1"), F.lower("p.c2").alias("l2"), "kind")


def rule_query(name: str, outputs: dict[str, str], steps: tuple[dict[str, str], ...] = ()):
    """Register a query of scoring rules over chunk pairs: ``steps`` are columns that later rules use."""
    sql, at = f"WITH {_PAIRS}", "pairs"
    for i, step in enumerate(steps):
        sql += f", s{i} AS (SELECT *, " + ", ".join(f"{R.duck(r)} AS {k}" for k, r in step.items()) + f" FROM {at})"
        at = f"s{i}"
    sql += " SELECT doc_id, chunk, " + ", ".join(f"{R.duck(r)} AS {k}" for k, r in outputs.items()) + f" FROM {at}"

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = chunk_pairs(spark, d)
        for step in steps:
            rows = rows.selectExpr("*", *[f"{R.spark(r)} AS {k}" for k, r in step.items()])
        return rows.selectExpr("doc_id", "chunk", *[f"{R.spark(r)} AS {k}" for k, r in outputs.items()])

    query(name, sql)(run)
    return run


#: References between chunks.
REFERENCES = {
    "section_ref": r"(?i)(?:section|chapter|part)\s+[0-9]+", "figure_ref": r"(?i)(?:figure|fig|diagram)\s+[0-9]+", "table_ref": r"(?i)table\s+[0-9]+", "page_ref": r"(?i)page\s+[0-9]+",
    "above_below": r"(?i)\b(?:above|below|previously|later|aforementioned)\b", "see_ref": r"(?i)see\s+[^.!?]+", "as_mentioned": r"(?i)as\s+(?:mentioned|discussed|shown|described)", "citation": r"\([^)]*[0-9]{4}[^)]*\)",
}
_REF_COUNT = lambda c: " + ".join(f"@n(@all({c}, @'{p}', 0))" for p in REFERENCES.values())
_SHARED = " + ".join(f"@n(@inter(@dist(@all(c1, @'{p}', 0)), @dist(@all(c2, @'{p}', 0))))" for p in REFERENCES.values())
_N_WORDS = "(@n(@split(c1, ' ')) + @n(@split(c2, ' ')))"
_XREF = f"least(1.0, ({_REF_COUNT('c1')} + {_REF_COUNT('c2')}) * 100.0 / greatest(1, {_N_WORDS}))"

gap_references = rule_query("gap_references", {
    "forward": f"CAST({_REF_COUNT('c1')} AS BIGINT)", "backward": f"CAST({_REF_COUNT('c2')} AS BIGINT)", "shared": f"CAST({_SHARED} AS BIGINT)", "density": f"CAST(round({_XREF}, 6) AS @double)"})

#: Entities and words of a text: capitalised runs, words of four letters, and what topic phrases name.
_CONCEPTS = lambda c: (
    rf"@dist(@cat(@cat(@map(@all({c}, @'[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*', 0), @x lower(x)), @flt(@split(lower({c}), @'[^a-z]+'), @x length(x) >= 4)), "
    rf"@map(@all({c}, @'(?i)(?:about|regarding|concerning|related to|focuses on)\s+([^.!?]+)', 1), @x lower(trim(x)))))")
gap_concept_overlap = rule_query("gap_concept_overlap", {"n_first": "CAST(@n(k1) AS BIGINT)", "n_second": "CAST(@n(k2) AS BIGINT)", "overlap": f"CAST(round({R.jaccard('k1', 'k2')}, 6) AS @double)"},
                                 ({"k1": _CONCEPTS("c1"), "k2": _CONCEPTS("c2")},))

#: Parts of an academic text, and words of time.
ACADEMIC = ("abstract", "introduction", "methodology", "results", "discussion", "conclusion", "references")
TEMPORAL = ("then", "next", "after", "meanwhile", "suddenly", "later")
_ENDS = r"@rx(c1, @'[.!?:;]\s*$')"
_SENTENCE = rf"CASE WHEN {_ENDS} AND @rx(c2, @'^\s*\p{{Lu}}') THEN 1.0 ELSE 0.3 END"
_LAST = lambda c: "CASE " + " ".join(f"WHEN contains({c}, '{w}') THEN {i}" for i, w in reversed(list(enumerate(ACADEMIC)))) + " END"
_NUM = lambda c, p: f"nullif(regexp_extract({c}, @'{p}', 1), '')"
_SEC = r"(?:Section|Article)\s+([0-9]+)"
_CONTINUITY = rf"""CASE kind
 WHEN 'technical' THEN CASE WHEN @rx(c1, @'\b(?:def|class|function)\s+\w+') AND @rx(c2, @'^\s+') THEN 0.8 ELSE 0.5 END
 WHEN 'legal' THEN CASE WHEN CAST({_NUM('c2', _SEC)} AS DECIMAL(18, 0)) = CAST({_NUM('c1', _SEC)} AS DECIMAL(18, 0)) + 1 THEN 0.9
   WHEN ascii({_NUM('c2', '[(]([a-z])[)]')}) = ascii({_NUM('c1', '[(]([a-z])[)]')}) + 1 THEN 0.8 ELSE 0.6 END
 WHEN 'academic' THEN CASE WHEN {_LAST('l2')} = {_LAST('l1')} + 1 THEN 0.9 WHEN @rx(c1, @'[0-9]+[.][0-9]+') AND @rx(c2, @'[0-9]+[.][0-9]+') THEN 0.8 ELSE 0.6 END
 WHEN 'narrative' THEN CASE WHEN @rx(c1, @'"\s*$') AND @rx(c2, @'^\s*"') THEN 0.7 WHEN @rx(c1, @'\*\s*\*\s*\*|---|###') OR @rx(c2, @'\*\s*\*\s*\*|---|###') THEN 0.3
   WHEN {R.any_of('substr(l2, 1, 100)', TEMPORAL)} THEN 0.8 ELSE 0.6 END END"""
#: Windows of words have lost their line ends, so no chunk ends with a paragraph: 0.4.
_MEAN = f"CASE WHEN kind IN ('technical', 'legal', 'academic', 'narrative') THEN (sentence + 0.4 + own) / 3 ELSE (sentence + 0.4) / 2 END"
gap_continuity = rule_query("gap_continuity", {"kind": "kind", "sentence": "CAST(sentence AS @double)", "own": "CAST(own AS @double)", "continuity": f"round(CAST({_MEAN} AS @double), 6)"}, ({"sentence": _SENTENCE, "own": _CONTINUITY},))

#: Words of each domain's gap rules.
TERMS = {"technical": ("algorithm", "function", "variable", "class", "method", "api", "framework"), "medical": ("patient", "diagnosis", "treatment", "symptom", "medication", "clinical", "therapeutic")}
CLINICAL = ("symptoms", "diagnosis", "treatment", "prognosis", "contraindications")
SAFETY = ("contraindication", "side effect", "adverse", "warning", "caution", "risk")
STATUTORY = ("pursuant to", "in accordance with", "subject to", "provided that")
RESEARCH = ("hypothesis", "methodology", "results", "analysis", "discussion")
METHODS = ("method", "procedure", "protocol", "approach", "technique")
FLOW = ("then", "next", "meanwhile", "however", "suddenly", "later")


def _terms(kind: str) -> str:
    a, b = R.found_words("l1", TERMS[kind]), R.found_words("l2", TERMS[kind])
    return f"CASE WHEN @n({a}) = 0 AND @n({b}) = 0 THEN 0.5 ELSE 1.0 - @n(@inter({a}, {b})) * 1.0 / (@n({a}) + @n({b}) - @n(@inter({a}, {b}))) END"


_APIS = lambda c: rf"@dist(@cat(@cat(@all({c}, @'\w+\(\)', 0), @all({c}, @'\w+[.]\w+', 0)), @cat(@all({c}, @'class\s+\w+', 0), @all({c}, @'def\s+\w+', 0))))"
_CODE = lambda c: rf"@rx({c}, @'```')"
_CLIN = lambda c, f: f"{f}(@map({R.found_words(c, CLINICAL)}, @x CASE x " + " ".join(f"WHEN '{w}' THEN {i}" for i, w in enumerate(CLINICAL)) + " END))"
_SECS = lambda c: rf"@map(@all({c}, @'(?:Section|Article)\s+([0-9]+)', 1), @x CAST(x AS DECIMAL(18, 0)))"
_CASES = lambda c: rf"@dist(@all({c}, @'\w+\s+v[.]\s+\w+', 0))"
_CITED = lambda c: rf"@rx({c}, @'\([^)]*[0-9]{{4}}[^)]*\)|\[[0-9]+\]|\w+\s+et\s+al[.]')"
_NAMES = lambda c: rf"@dist(@flt(@split({c}, @'[^\p{{L}}]+'), @x @rx(x, @'^[A-Z][a-z]+$')))"
_BREAK = r"@rx({}, @'\*\s*\*\s*\*|---|###')"
#: Three gaps of each kind of content; general content has none.
DOMAIN = {
    "technical": (R.jaccard(_APIS("c1"), _APIS("c2"), "0.5").replace("ELSE @n", "ELSE 1.0 - @n"), f"CASE WHEN {_CODE('c1')} AND {_CODE('c2')} THEN 0.3 WHEN {_CODE('c1')} OR {_CODE('c2')} THEN 0.7 ELSE 0.5 END", _terms("technical")),
    "medical": (f"CASE WHEN @n({R.found_words('l1', CLINICAL)}) > 0 AND @n({R.found_words('l2', CLINICAL)}) > 0 THEN CASE WHEN {_CLIN('l2', '@min')} > {_CLIN('l1', '@max')} THEN 0.2 ELSE 0.6 END ELSE 0.5 END",
                f"CASE WHEN {R.any_of('l1', SAFETY)} AND NOT {R.any_of('l2', SAFETY)} THEN 0.8 WHEN {R.any_of('l1', SAFETY)} THEN 0.3 ELSE 0.5 END", _terms("medical")),
    "legal": (f"CASE WHEN @n({_SECS('c1')}) > 0 AND @n({_SECS('c2')}) > 0 THEN CASE WHEN @min({_SECS('c2')}) = @max({_SECS('c1')}) + 1 THEN 0.2 WHEN @min({_SECS('c2')}) > @max({_SECS('c1')}) THEN 0.4 ELSE 0.7 END ELSE 0.5 END",
              f"CASE WHEN {R.any_of('substr(l2, 1, 200)', STATUTORY)} THEN 0.3 ELSE 0.6 END",
              f"CASE WHEN @n(@inter({_CASES('c1')}, {_CASES('c2')})) > 0 THEN 0.2 WHEN @n({_CASES('c1')}) > 0 AND @n({_CASES('c2')}) > 0 THEN 0.5 ELSE 0.7 END"),
    "academic": (f"CASE WHEN {R.any_of('l1', RESEARCH)} AND {R.any_of('l2', RESEARCH)} THEN 0.3 ELSE 0.6 END", f"CASE WHEN {R.any_of('l1', METHODS)} AND {R.any_of('l2', METHODS)} THEN 0.3 ELSE 0.6 END",
                 f"CASE WHEN {_CITED('c1')} AND {_CITED('c2')} THEN 0.4 WHEN {_CITED('c1')} OR {_CITED('c2')} THEN 0.6 ELSE 0.5 END"),
    "narrative": (f"CASE WHEN {R.any_of('substr(l2, 1, 100)', FLOW)} THEN 0.3 ELSE 0.6 END", R.jaccard(_NAMES("c1"), _NAMES("c2"), "0.5").replace("ELSE @n", "ELSE 1.0 - @n"),
                  f"CASE WHEN {_BREAK.format('c1')} OR {_BREAK.format('c2')} THEN 0.8 ELSE 0.4 END"),
}
_DOMAIN = "CASE kind " + " ".join(f"WHEN '{k}' THEN CAST(({' + '.join(f'({r})' for r in rs)}) / 3 AS @double)" for k, rs in DOMAIN.items()) + " END"
gap_domain = rule_query("gap_domain", {"kind": "kind", "domain_gap": f"round({_DOMAIN}, 6)"})

#: Weights of distance, overlap, references and continuity for each kind of content.
WEIGHTS = {"technical": (0.30, 0.25, 0.20, 0.25), "medical": (0.35, 0.30, 0.15, 0.20), "legal": (0.25, 0.20, 0.35, 0.20), "academic": (0.30, 0.25, 0.25, 0.20), "narrative": (0.40, 0.20, 0.10, 0.30), "general": (0.30, 0.25, 0.20, 0.25)}
_W = [("CASE kind " + " ".join(f"WHEN '{k}' THEN {w[i]}" for k, w in WEIGHTS.items()) + " END") for i in range(4)]
#: Words that no comparison of terms counts.
ENGLISH = tuple("a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split())
_STOP = ", ".join(f"'{w}'" for w in ENGLISH)
_TERM_LIST = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 1 AND w NOT IN (" + _STOP + "))"
_DISTANCE = f"""t AS (SELECT doc_id, chunk, unnest(list_concat(w, list_transform(list_zip(w[:len(w) - 1], w[2:]), lambda p: p[1] || ' ' || p[2]))) AS term FROM (SELECT doc_id, chunk, {_TERM_LIST.format('content')} AS w FROM chunks)),
f AS (SELECT doc_id, chunk, term, count(*) AS n FROM t GROUP BY 1, 2, 3), idf AS (SELECT ln(1.5) + 1 AS one),
j AS (SELECT a.doc_id, a.chunk, sum(a.n * b.n) AS dot, sum(a.n * a.n) AS a2, sum(b.n * b.n) AS b2 FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.chunk = a.chunk + 1 AND a.term = b.term GROUP BY 1, 2),
q AS (SELECT doc_id, chunk, sum(n * n) AS s FROM f GROUP BY 1, 2),
dist AS (SELECT p.doc_id, p.chunk, CASE WHEN x.s IS NULL OR y.s IS NULL THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - coalesce(dot, 0) / (sqrt((x.s - coalesce(a2, 0)) * one * one + coalesce(a2, 0)) * sqrt((y.s - coalesce(b2, 0)) * one * one + coalesce(b2, 0))))) END AS distance
  FROM pairs p CROSS JOIN idf LEFT JOIN j USING (doc_id, chunk) LEFT JOIN q x ON x.doc_id = p.doc_id AND x.chunk = p.chunk LEFT JOIN q y ON y.doc_id = p.doc_id AND y.chunk = p.chunk + 1)"""


def semantic_distance(rows: DataFrame) -> DataFrame:
    """Pairs of chunks (``c1``, ``c2``) with ``distance``: 1 less the cosine of the TF-IDF of both, as of two documents.

    Terms are words of two letters or more and pairs of neighbours, without stop words.
    A term in both has an idf of 1, one in a single chunk ln(1.5) + 1.  Terms are counted
    within the rows of a batch: none is shuffled.
    """
    terms = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda x: (F.length(x) > 1) & ~x.isin(*ENGLISH))
    kept = [c for c in rows.columns if c not in ("c1", "c2", "l1", "l2")]
    sent = rows.select(*kept, terms("c1").alias("w1"), terms("c2").alias("w2"))
    counted = T.StructType([*sent.schema.fields[:-2], *(T.StructField(c, T.LongType()) for c in SUMS)])
    s = sent.mapInArrow(_common_terms, counted)
    one = F.log(F.lit(1.5)) + 1
    norm = lambda x, y: F.sqrt((F.col(x) - F.col(y)) * one * one + F.col(y))
    far = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("dot") / (norm("s1", "a2") * norm("s2", "b2"))))
    return s.withColumn("distance", F.when((F.col("s1") == 0) | (F.col("s2") == 0), 1.0).otherwise(far)).drop(*SUMS)


#: Sums over the terms of two chunks: of products, of squares of common terms, of all squares.
SUMS = ("dot", "a2", "b2", "s1", "s2")


def _common_terms(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        words = [pc.list_flatten(part[c]) for c in ("w1", "w2")]
        lens = [pc.list_value_length(part[c]).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("w1", "w2")]
        coded = pa.concat_arrays(words).dictionary_encode()
        codes, size = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
        both = []
        for w, n in ((codes[: len(words[0])], lens[0]), (codes[len(words[0]) :], lens[1])):
            row = np.repeat(np.arange(len(n)), n)
            next_to = row[1:] == row[:-1]
            # a word is a term, and so is each pair of neighbours of one row
            term, at = np.concatenate([w, size + w[:-1][next_to] * size + w[1:][next_to]]), np.concatenate([row, row[1:][next_to]])
            both.append((term, at))
        term, code = np.unique(np.concatenate([t for t, _ in both]), return_inverse=True)
        keys, n = zip(*(np.unique(at * max(1, len(term)) + c, return_counts=True) for (_, at), c in zip(both, np.split(code, [len(both[0][0])]))))
        _, i, j = np.intersect1d(*keys, assume_unique=True, return_indices=True)
        row = [k // max(1, len(term)) for k in keys]
        total = lambda at, v: pa.array(np.bincount(at, v, minlength=part.num_rows).astype(np.int64))  # noqa: E731, B023
        sums = [total(row[0][i], n[0][i] * n[1][j]), total(row[0][i], n[0][i] ** 2), total(row[0][i], n[1][j] ** 2), total(row[0], n[0] ** 2), total(row[1], n[1] ** 2)]
        yield pa.RecordBatch.from_arrays([*part.columns[:-2], *sums], [*part.schema.names[:-2], *SUMS])


@query("gap_semantic_distance", f"WITH {_PAIRS}, {_DISTANCE} SELECT doc_id, chunk, round(distance, 5) AS distance FROM dist")
def gap_semantic_distance(spark: SparkSession, d: str) -> DataFrame:
    return semantic_distance(chunk_pairs(spark, d)).select("doc_id", "chunk", F.round("distance", 5).alias("distance"))


_STEPS = ({"k1": _CONCEPTS("c1"), "k2": _CONCEPTS("c2"), "sentence": _SENTENCE, "own": _CONTINUITY, "refs": f"CAST({_XREF} AS @double)", "domain": f"coalesce({_DOMAIN}, 0.0)"},
          {"overlap": f"CAST({R.jaccard('k1', 'k2')} AS @double)", "continuity": f"CAST({_MEAN} AS @double)"})
_NEED = f"greatest(0.0, least(1.0, distance * {_W[0]} + (1 - overlap) * {_W[1]} + refs * {_W[2]} + (1 - continuity) * {_W[3]} + 0.2 * domain))"
_TYPE = "CASE WHEN round(refs, 9) > 0.3 THEN 'cross_reference' WHEN round(continuity, 9) < 0.4 THEN 'procedural' ELSE 'conceptual' END"
_BRIDGE = """CASE WHEN kind IN ('medical', 'legal') AND distance > 0.5 THEN 'llm' WHEN kind = 'narrative' AND distance < 0.7 THEN 'mechanical'
 WHEN distance > 0.8 OR overlap < 0.2 OR refs > 0.5 OR continuity < 0.3 THEN 'llm' WHEN distance > 0.6 THEN 'semantic_overlap' ELSE 'mechanical' END"""


def _decision_sql() -> str:
    at, ctes = "pairs", ""
    for i, step in enumerate(_STEPS):
        ctes += f", s{i} AS (SELECT *, " + ", ".join(f"{R.duck(r)} AS {k}" for k, r in step.items()) + f" FROM {at})"
        at = f"s{i}"
    return f"WITH {_PAIRS}, {_DISTANCE}{ctes} SELECT doc_id, chunk, kind, round({_NEED}, 4) AS necessity, {_TYPE} AS gap_type, {_BRIDGE} AS strategy FROM (SELECT * REPLACE (round(distance, 5) AS distance) FROM {at} JOIN dist USING (doc_id, chunk))"


@query("gap_decision", _decision_sql())
def gap_decision(spark: SparkSession, d: str) -> DataFrame:
    """How much a bridge between two chunks is needed, by the weights of their kind, what gap it is and how to bridge it."""
    rows = chunk_pairs(spark, d)
    for step in _STEPS:
        rows = rows.selectExpr("*", *[f"{R.spark(r)} AS {k}" for k, r in step.items()])
    rows = semantic_distance(rows.select("doc_id", "chunk", "kind", "overlap", "continuity", "refs", "domain", "c1", "c2")).withColumn("distance", F.round("distance", 5))
    return rows.selectExpr("doc_id", "chunk", "kind", f"round({_NEED}, 4) AS necessity", f"{_TYPE} AS gap_type", f"{_BRIDGE} AS strategy")


#: Words that join texts.
TRANSITIONS = ("however", "therefore", "furthermore", "moreover", "additionally", "consequently", "meanwhile", "similarly", "likewise", "in contrast")
FALLBACK_STOPS = tuple("the a an and or but in on at to for of with by is are was were".split())
_SET = lambda c: f"@flt(@dist(@split({c}, ' ')), @x x NOT IN ({', '.join(repr(w) for w in FALLBACK_STOPS)}))"
_FALL = ({"w1": _SET("l1"), "w2": _SET("l2"), "sentence": _SENTENCE},
         {"share": f"CAST({R.jaccard('w1', 'w2')} AS @double)", "boundary": "CAST((sentence + 0.5 + 0.7) / 3 AS @double)",
          "coherence": f"CAST(CASE WHEN {R.any_of('substr(l2, 1, 200)', TRANSITIONS)} THEN 0.32 ELSE 0.0 END + 0.6 * least(1.0, @n(@inter(w1, w2)) / 20.0) AS @double)"})
boundary_fallback = rule_query("boundary_fallback", {
    "overlap": "round(share, 6)", "boundary": "round(boundary, 6)", "coherence": "round(coherence, 6)",
    "strategy": "CASE WHEN share > 0.2 AND boundary > 0.7 THEN 'mechanical_overlap' WHEN boundary > 0.6 THEN 'sentence_boundary' WHEN coherence > 0.5 THEN 'semantic_transition' WHEN kind IN ('technical', 'medical', 'legal') THEN 'content_specific' ELSE 'minimal_bridge' END"}, _FALL)

#: Words that continue a text, and weights of a fallback's qualities.
CONTINUING = ("continuing", "following", "building on", "additionally", "furthermore", "moreover", "next", "then")
QUALITY = {"boundary_q": 0.25, "semantic_q": 0.25, "complete_q": 0.2, "readable_q": 0.15, "own_q": 0.15}
OWN_WORDS = {"technical": ("implementation", "function", "method", "system", "process", "algorithm"), "medical": ("clinical", "patient", "treatment", "diagnosis", "medical", "therapeutic"),
             "legal": ("accordance", "pursuant", "statutory", "provision", "regulation", "legal")}
_PROPER, _CLOSED = r"@rx(b, @'^\p{Lu}')", r"@rx(b, @'[.!?,]\s*$')"
_PER = "@n(@split(b, ' ')) * 1.0 / @n(@split(b, @'[.!?]+'))"
_FQ = ({"b": "@join(@slice(@split(c1, ' '), greatest(1, @n(@split(c1, ' ')) - 19), 100000), ' ') || ' ' || @join(@slice(@split(c2, ' '), 1, 20), ' ')"}, {"lb": "lower(b)", "wb": _SET("lower(b)"), "w1": _SET("l1"), "w2": _SET("l2")},
       {"boundary_q": rf"CASE WHEN @rx(b, @'[.!?]\s+[A-Z]') THEN 0.4 ELSE 0.0 END + CASE WHEN {_PROPER} THEN 0.3 ELSE 0.0 END + CASE WHEN {_CLOSED} THEN 0.3 ELSE 0.0 END",
        "semantic_q": f"CASE WHEN {R.any_of('lb', CONTINUING)} THEN 0.48 ELSE 0.0 END + 0.2 * (@n(@inter(wb, w1)) + @n(@inter(wb, w2))) / greatest(1, @n(wb))",
        "complete_q": "least(1.0, @n(@flt(@split(b, ' '), @x length(x) > 3 AND lower(x) NOT IN ('with', 'that', 'this', 'from'))) * 1.0 / @n(@split(b, ' ')) + CASE WHEN @n(@split(b, ' ')) BETWEEN 5 AND 20 THEN 0.2 ELSE 0.0 END)",
        "readable_q": f"least(1.0, CASE WHEN {_PER} BETWEEN 10 AND 20 THEN 1.0 WHEN {_PER} BETWEEN 5 AND 30 THEN 0.7 ELSE 0.4 END + CASE WHEN {_PROPER} AND {_CLOSED} THEN 0.2 ELSE 0.0 END)",
        "own_q": "CASE kind " + " ".join(f"WHEN '{k}' THEN CASE WHEN {R.any_of('lb', w)} THEN 0.8 ELSE 0.0 END" for k, w in OWN_WORDS.items()) + " ELSE 0.6 END"},
       {"quality": "CAST(" + " + ".join(f"{w} * {k}" for k, w in QUALITY.items()) + " AS @double)"})
fallback_quality = rule_query("fallback_quality", {
    "quality": "round(quality + 1e-9, 4)", "upgrade": "CASE WHEN round(quality + 1e-9, 4) > 0.7 THEN 0.3 WHEN round(quality + 1e-9, 4) > 0.5 THEN 0.6 ELSE 0.8 END", "n_words": "CAST(@n(@split(b, ' ')) AS BIGINT)"}, _FQ)
