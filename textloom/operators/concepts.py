"""Concepts of documents: extraction by patterns, predicates, links, relations and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.functions.overlaps import common_with_queries
from textloom.operators.texts import _KEYS, _TOKENS
from textloom.plans.registry import query
from textloom.session import table, written

#: Whole-word patterns of code terms and acronyms, and words that are no acronyms.
CODE = ("[a-z][a-z0-9]*(?:_[a-z0-9]+)+", "[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*", "[A-Z][a-z]+(?:[A-Z][a-z]+)+")
ACRONYM = "[A-Z]{2,6}"
NO_ACRONYM = tuple("IT IS OR AN AT IF IN ON TO UP DO GO NO SO BY HE ME WE US AM BE OF AS".split())
#: Assignments, calls and dotted names.
CODE_RUNS = (r"[a-zA-Z_][a-zA-Z0-9_]*=[A-Za-z0-9_]+", r"[a-zA-Z_][a-zA-Z0-9_]*\(\)", r"[a-z][a-z0-9]*(?:\.[a-z][a-z0-9_]*){1,4}")
#: Terms of several words.
TERMS = (
    "knowledge graph|vector database|natural language processing|machine learning|deep learning|neural network|information retrieval|semantic search|named entity recognition|"
    r"text embedding|content analysis|concept extraction|graph database|search engine|data model|chunk(?:ing)?\s+(?:strategy|framework|pipeline|size)|"
    r"retrieval\s+(?:quality|pipeline|service|augmented)|embedding\s+(?:model|dimension|space|vector)"
)
#: Confidence of each kind; each further occurrence adds 0.02, 0.1 at most.
CONFIDENCE = {"CODE_TERM": 0.7, "MULTI_WORD": 0.85, "ACRONYM": 0.6}

#: Characters of a name at most: no longer run is one.
LONGEST = 200
_CODE = "^(?:" + "|".join(f"(?:{p})" for p in CODE) + ")$"
_NO = ", ".join(f"'{w}'" for w in NO_ACRONYM)
_BASE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CONFIDENCE.items()) + " END"
#: What a run of a text may not have around its assignments, calls and dotted names.
_RUNS = "|".join(f"^(?:{p})$" for p in CODE_RUNS)
_CONCEPTS = rf"""r AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS name FROM documents),
k AS (SELECT doc_id, name, CASE WHEN regexp_matches(name, '{_CODE}') THEN 'CODE_TERM' WHEN regexp_matches(name, '^{ACRONYM}$') AND name NOT IN ({_NO}) THEN 'ACRONYM' END AS kind FROM r WHERE length(name) BETWEEN 3 AND {LONGEST}
  UNION ALL SELECT doc_id, name, 'CODE_TERM' FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_=().]+')) AS name FROM documents) WHERE length(name) BETWEEN 3 AND {LONGEST} AND regexp_matches(name, '{_RUNS}')
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TERMS}')), 'MULTI_WORD' FROM documents),
concepts AS (SELECT doc_id, kind, name, count(*) AS n, round({_BASE} + least(0.1, 0.02 * (count(*) - 1)), 6) AS confidence FROM k WHERE kind IS NOT NULL GROUP BY 1, 2, 3)"""


def concepts(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id``, ``kind``, ``name``, ``n``, ``confidence``: concepts that patterns find in whole texts, each text read once."""
    t = F.col("text")
    name = lambda kind, names: F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    words = F.filter(T.tokens(t), lambda w: F.length(w).between(3, LONGEST))
    runs = F.filter(F.split(t, r"[^\p{L}\p{N}_=().]+"), lambda w: F.length(w).between(3, LONGEST) & w.rlike(_RUNS))
    found = F.concat(name("CODE_TERM", F.filter(words, lambda w: w.rlike(_CODE))), name("ACRONYM", F.filter(words, lambda w: w.rlike(f"^{ACRONYM}$") & ~w.isin(*NO_ACRONYM))),
                     name("CODE_TERM", runs), name("MULTI_WORD", F.regexp_extract_all(F.lower(t), F.lit(f"({TERMS})"), F.lit(1))))
    c = table(spark, d, "documents").select("doc_id", F.explode(found).alias("c")).groupBy("doc_id", "c.kind", "c.name").agg(F.count("*").alias("n"))
    base = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in CONFIDENCE.items()])
    return c.withColumn("confidence", F.round(base + F.least(F.lit(0.1), 0.02 * (F.col("n") - 1)), 6))


@query("concept_extraction", f"WITH {_CONCEPTS} SELECT * FROM concepts")
def concept_extraction(spark: SparkSession, d: str) -> DataFrame:
    return concepts(spark, d)


@query("concept_mean_confidence", f"WITH {_CONCEPTS} SELECT kind, name, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n, round(avg(confidence), 6) AS mean_confidence, round(max(confidence), 6) AS best FROM concepts GROUP BY 1, 2")
def concept_mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    return concepts(spark, d).groupBy("kind", "name").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.max("confidence"), 6).alias("best"))


#: Words that a concept's key leaves out.
KEY_STOPS = ("the", "a", "an", "of", "in", "on", "at", "to", "for", "with")


def concept_key(name: Column) -> Column:
    """Lower-case words of a name without articles and prepositions, joined by underscores."""
    return F.array_join(F.filter(T.words(name), lambda w: ~w.isin(*KEY_STOPS)), "_")


_KEY = r"array_to_string(list_filter(list_filter(regexp_split_to_array(lower({}), '[ \t\n\r\f\x0B]+'), lambda w: w <> ''), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in KEY_STOPS) + ")), '_')"


@query("concept_keys", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT {_KEY.format('line')} AS key, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM l WHERE length(trim(line)) BETWEEN 1 AND 60 GROUP BY 1""")
def concept_keys(spark: SparkSession, d: str) -> DataFrame:
    """Short lines (headings, list entries) as names of concepts, by their keys."""
    l = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length(F.trim("line")).between(1, 60))
    return l.groupBy(concept_key(F.col("line")).alias("key")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


#: Phrases and patterns of names that are no concepts.
GARBAGE = ("less than", "more than", "more than two", "information about", "such as", "as well", "due to", "based on", "according to", "in order", "at least", "up to", "each of", "one of")
GARBAGE_PATTERNS = (
    "[?+=]", r"\w+- \w+", r"(?i)^(table|figure|fig)\s+[0-9]", "(?i)^[0-9]+\\s+(years?|days?|months?|weeks?|hours?|minutes?)$", r"(?i)^(stage|phase|step|grade|level|type)\s+[0-9]", r"(?i)\bet\s+al\.?$",
)


def is_garbage(name: Column) -> Column:
    """Whether a name is a filler phrase or an artefact; a null or empty name isn't."""
    hit = reduce(lambda c, p: c | name.rlike(p), GARBAGE_PATTERNS, F.lower(F.trim(name)).isin(*GARBAGE))
    return F.coalesce(hit & (name != ""), F.lit(False))


_GARBAGE = "(lower(trim({0})) IN (" + ", ".join(f"'{g}'" for g in GARBAGE) + ") OR " + " OR ".join(f"regexp_matches({{0}}, '{p}')" for p in GARBAGE_PATTERNS) + ")"


@query("garbage_names", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS name FROM documents) SELECT doc_id, count(*) AS n, count(*) FILTER ({_GARBAGE.format('name')}) AS n_garbage FROM l WHERE name <> '' GROUP BY 1""")
def garbage_names(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("name")).where("name <> ''")
    return l.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(is_garbage(F.col("name"))).alias("n_garbage"))


#: Entity types that are trusted for names of one word.
TRUSTED = ("ORG", "PERSON")


def is_domain_concept(kind: Column, name: Column) -> Column:
    return kind.isin(*TRUSTED) | F.trim(F.coalesce(name, F.lit(""))).contains(" ")


@query("domain_concepts", rf"""
WITH {_CONCEPTS} SELECT kind, contains(trim(name), ' ') AS domain, {_GARBAGE.format('name')} AS garbage, (length(name) <= 2 OR regexp_matches(name, '(?i)^(https?:|www\.)|[.](com|org|net)$') OR name = 'Page') AS hidden, count(*) AS n FROM concepts GROUP BY 1, 2, 3, 4""")
def domain_concepts(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("name")
    return concepts(spark, d).groupBy("kind", is_domain_concept(F.col("kind"), name).alias("domain"), is_garbage(name).alias("garbage"), is_hidden(name).alias("hidden")).agg(F.count("*").alias("n"))


def is_hidden(name: Column) -> Column:
    """Names that an overview leaves out: very short ones, addresses and page markers."""
    return (F.length(name) <= 2) | name.rlike(r"(?i)^(https?:|www\.)|[.](com|org|net)$") | (name == "Page")


@query("landing_view", rf"""
WITH {_CONCEPTS}, f AS (SELECT name, count(DISTINCT doc_id) AS n_docs, CAST(sum(n) AS BIGINT) AS n FROM concepts GROUP BY 1), t AS (SELECT * FROM f ORDER BY n_docs DESC, n DESC, name LIMIT 50)
SELECT * FROM t WHERE NOT (length(name) <= 2 OR regexp_matches(name, '(?i)^(https?:|www\.)|[.](com|org|net)$') OR name = 'Page') ORDER BY n_docs DESC, n DESC, name LIMIT 10""")
def landing_view(spark: SparkSession, d: str) -> DataFrame:
    """Ten concepts of most documents: fifty are taken, those hidden go, ten stay."""
    order = [F.desc("n_docs"), F.desc("n"), "name"]
    f = concepts(spark, d).groupBy("name").agg(F.countDistinct("doc_id").alias("n_docs"), F.sum("n").alias("n"))
    return f.orderBy(*order).limit(50).where(~is_hidden(F.col("name"))).orderBy(*order).limit(10)


@query("document_concepts", f"WITH {_CONCEPTS} SELECT doc_id, count(*) AS n_concepts, array_to_string(list(name ORDER BY name, kind), '|') AS names FROM concepts GROUP BY 1")
def document_concepts(spark: SparkSession, d: str) -> DataFrame:
    return concepts(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_concepts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "kind"))), lambda x: x["name"]), "|").alias("names"))


@query("similar_by_concepts", f"""
WITH {_CONCEPTS}, e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, sum(a.confidence * b.confidence) AS s FROM concepts a JOIN concepts b USING (kind, name) WHERE a.doc_id % 50 = 0 AND a.doc_id <> b.doc_id GROUP BY 1, 2),
m AS (SELECT *, s / max(s) OVER (PARTITION BY a) AS score, row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) AS i FROM e) SELECT a, b, shared, round(score, 6) AS score FROM m WHERE i <= 10""")
def similar_by_concepts(spark: SparkSession, d: str) -> DataFrame:
    """For every document whose id is divisible by 50 the ten that share most confidence of concepts, over its best."""
    c = written(concepts(spark, d).select("doc_id", "kind", "name", "confidence"), "concepts")
    ask = c.where("doc_id % 50 = 0").select("kind", "name", F.col("doc_id").alias("a"), F.col("confidence").alias("ca"))
    e = ask.join(c.withColumnRenamed("doc_id", "b"), ["kind", "name"]).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum(F.col("ca") * F.col("confidence")).alias("s"))
    w = Window.partitionBy("a")
    m = e.withColumn("i", F.row_number().over(w.orderBy(F.desc(F.round("s", 9)), "b"))).withColumn("score", F.col("s") / F.max("s").over(w))
    return m.where("i <= 10").select("a", "b", "shared", F.round("score", 6).alias("score"))


#: An expansion (words between white space) before its acronym, and after it.  One class
#: takes all of its words: a repeated group would need a stack as deep as a text is long.
EXPANSION_FIRST = r"([A-Z][a-z]+(?:\s[\sA-Za-z]*[A-Za-z])?)\s*\(([A-Z]{2,6})\)"
ACRONYM_FIRST = r"([A-Z]{2,6})\s*\(([A-Z][a-z]+(?:\s[\sA-Za-z]*[A-Za-z])?)\)"


def acronym_pairs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``acronym``, ``expansion`` and the documents that link them, in either order."""
    both = lambda p, a, e: F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(a)).alias("acronym"), F.regexp_extract_all("text", F.lit(p), F.lit(e)).alias("expansion"))
    pairs = docs.select(key, F.explode(F.concat(both(EXPANSION_FIRST, 2, 1), both(ACRONYM_FIRST, 1, 2))).alias("p")).select(key, "p.acronym", "p.expansion")
    return pairs.where(~F.col("acronym").isin(*NO_ACRONYM)).groupBy("acronym", "expansion").agg(F.countDistinct(key).alias("n_docs"))


@query("acronym_links", f"""
WITH p AS (SELECT doc_id, unnest(list_zip(regexp_extract_all(text, '{EXPANSION_FIRST}', 2), regexp_extract_all(text, '{EXPANSION_FIRST}', 1))) AS p FROM documents
  UNION ALL SELECT doc_id, unnest(list_zip(regexp_extract_all(text, '{ACRONYM_FIRST}', 1), regexp_extract_all(text, '{ACRONYM_FIRST}', 2))) FROM documents)
SELECT p[1] AS acronym, p[2] AS expansion, count(DISTINCT doc_id) AS n_docs FROM p WHERE p[1] NOT IN ({_NO}) GROUP BY 1, 2""")
def acronym_links(spark: SparkSession, d: str) -> DataFrame:
    return acronym_pairs(table(spark, d, "documents"))


#: References to a part of a text, with what they show.
REFERENCES = (
    (r"(?i)(?:see|refer\s+to)\s+(section|chapter|page|figure|table)\s+([0-9]+(?:\.[0-9]+)*)", "explicit"),
    (r"(?i)as\s+(?:mentioned|discussed|shown|described)\s+in\s+(section|chapter|page|figure|table)\s+([0-9]+(?:\.[0-9]+)*)", "backward"),
    (r"(?i)(section|chapter|page|figure|table)\s+([0-9]+(?:\.[0-9]+)*)\s+(?:above|below|earlier|later)", "positional"),
)
_REFS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS reference, unnest(list_zip(regexp_extract_all(text, '{p}', 1), regexp_extract_all(text, '{p}', 2))) AS p FROM documents" for p, k in REFERENCES)


def references(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``reference`` (its kind), ``target_type`` and ``label`` of every reference in a text."""
    one = lambda p, k: F.transform(F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("t"), F.regexp_extract_all("text", F.lit(p), F.lit(2)).alias("l")), lambda x: F.struct(F.lit(k).alias("k"), F.lower(x["t"]).alias("t"), x["l"].alias("l")))
    return docs.select("doc_id", F.explode(F.concat(*[one(p, k) for p, k in REFERENCES])).alias("r")).select("doc_id", F.col("r.k").alias("reference"), F.col("r.t").alias("target_type"), F.col("r.l").alias("label"))


@query("reference_kinds", f"WITH r AS ({_REFS}) SELECT doc_id, reference, lower(p[1]) AS target_type, p[2] AS label, count(*) AS n FROM r GROUP BY 1, 2, 3, 4")
def reference_kinds(spark: SparkSession, d: str) -> DataFrame:
    return references(table(spark, d, "documents")).groupBy("doc_id", "reference", "target_type", "label").agg(F.count("*").alias("n"))


_HEAD = r"(?im)^\s*(section|chapter|page|figure|table)\s+([0-9]+(?:\.[0-9]+)*)"


@query("reference_targets", f"""
WITH r AS ({_REFS}), h AS (SELECT DISTINCT doc_id, lower(p[1]) AS target_type, p[2] AS label FROM (SELECT doc_id, unnest(list_zip(regexp_extract_all(text, '{_HEAD}', 1), regexp_extract_all(text, '{_HEAD}', 2))) AS p FROM documents))
SELECT DISTINCT r.doc_id, lower(p[1]) AS target_type, p[2] AS label, h.label IS NOT NULL AS found FROM r LEFT JOIN h ON h.doc_id = r.doc_id AND h.target_type = lower(p[1]) AND h.label = p[2]""")
def reference_targets(spark: SparkSession, d: str) -> DataFrame:
    """References of each document, and whether one of its lines begins with what they name; all within the row."""
    docs = table(spark, d, "documents")
    found = lambda p: F.transform(F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("t"), F.regexp_extract_all("text", F.lit(p), F.lit(2)).alias("l")), lambda x: F.struct(F.lower(x["t"]).alias("target_type"), x["l"].alias("label")))
    both = docs.select("doc_id", F.array_distinct(F.concat(*[found(p) for p, _ in REFERENCES])).alias("refs"), found(_HEAD).alias("heads"))
    told = F.transform("refs", lambda r: F.struct(r["target_type"].alias("target_type"), r["label"].alias("label"), F.array_contains("heads", r).alias("found")))
    return both.select("doc_id", F.explode(told).alias("r")).select("doc_id", "r.*")


#: Patterns of relations, and what a relation is.
RELATIONS = (
    ("IS_A", r"(.+?)\s+is\s+(?:a|an)\s+(.+)"), ("IS_A", r"(.+?)\s+are\s+(.+)"), ("PART_OF", r"(.+?)\s+(?:is\s+)?part\s+of\s+(.+)"), ("PART_OF", r"(.+?)\s+belongs\s+to\s+(.+)"), ("PART_OF", r"(.+?)\s+contains\s+(.+)"),
    ("CAUSES", r"(.+?)\s+causes\s+(.+)"), ("CAUSES", r"(.+?)\s+leads\s+to\s+(.+)"), ("CAUSES", r"(.+?)\s+results\s+in\s+(.+)"), ("RELATED_TO", r"(.+?)\s+(?:is\s+)?related\s+to\s+(.+)"),
    ("RELATED_TO", r"(.+?)\s+(?:is\s+)?associated\s+with\s+(.+)"), ("RELATED_TO", r"(.+?)\s+(?:is\s+)?connected\s+to\s+(.+)"),
)
TYPES = {"CAUSES": "CAUSAL", "IS_A": "HIERARCHICAL", "PART_OF": "HIERARCHICAL", "RELATED_TO": "ASSOCIATIVE"}
_TYPE = "CASE predicate " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items()) + " ELSE 'ASSOCIATIVE' END"
_REL = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS predicate, lower(trim(regexp_extract(line, '(?i)^{p}', 1))) AS s, lower(trim(regexp_extract(line, '(?i)^{p}', 2))) AS o FROM l WHERE regexp_matches(line, '(?i)^{p}')" for k, p in RELATIONS)


@query("relation_patterns", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), r AS ({_REL})
SELECT doc_id, predicate, {_TYPE} AS relation_type, md5(s) AS subject, md5(o) AS object, 0.7 AS confidence, count(*) AS n FROM r GROUP BY ALL""")
def relation_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Relations that lines state (a pattern matches from a line's start, where any match begins), with what stands before and after the relation's words."""
    r = relations(table(spark, d, "documents"))
    kind = F.coalesce(*[F.when(F.col("predicate") == k, v) for k, v in TYPES.items()], F.lit("ASSOCIATIVE"))
    return r.groupBy("doc_id", "predicate", kind.alias("relation_type"), F.md5("s").alias("subject"), F.md5("o").alias("object"), F.lit(0.7).alias("confidence")).agg(F.count("*").alias("n"))


def relations(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``predicate``, ``s`` and ``o`` (lower case) for each line and pattern that match."""
    l = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    one = lambda k, p: F.when(F.col("line").rlike(f"(?i)^{p}"), F.struct(F.lit(k).alias("predicate"), F.lower(F.trim(F.regexp_extract("line", f"(?i)^{p}", 1))).alias("s"), F.lower(F.trim(F.regexp_extract("line", f"(?i)^{p}", 2))).alias("o")))
    return l.select("doc_id", F.explode(F.array_compact(F.array(*[one(k, p) for k, p in RELATIONS]))).alias("r")).select("doc_id", "r.predicate", "r.s", "r.o")


@query("concept_relations", f"""
WITH {_CONCEPTS}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), rel AS ({_REL}), c AS (SELECT DISTINCT doc_id, lower(name) AS name FROM concepts),
m AS (SELECT rel.doc_id, predicate, s, o, max(a.name) AS subject, max(b.name) AS object FROM rel JOIN c a ON a.doc_id = rel.doc_id AND contains(s, a.name) JOIN c b ON b.doc_id = rel.doc_id AND contains(o, b.name) GROUP BY 1, 2, 3, 4)
SELECT doc_id, subject, predicate, object, count(*) AS n FROM m WHERE subject <> object GROUP BY 1, 2, 3, 4""")
def concept_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations between a document's own concepts: of those that a side contains the last by name."""
    c = written(concepts(spark, d).select("doc_id", F.lower("name").alias("name")).distinct(), "concepts")
    r = relations(table(spark, d, "documents")).distinct()
    side = lambda df, col, to: df.join(c, "doc_id").where(F.col(col).contains(F.col("name"))).groupBy(*df.columns).agg(F.max("name").alias(to))
    m = side(side(r, "s", "subject"), "o", "object")
    return m.where("subject <> object").groupBy("doc_id", "subject", "predicate", "object").agg(F.count("*").alias("n"))


#: Words that say little on their own.
GENERIC = ("data", "type", "case", "time", "work", "part", "form", "list", "set", "name", "file", "item", "use", "way")


def specificity(name: Column, proper: Column, coverage: Column) -> Column:
    """How much a concept says, from 0 to 1."""
    low = F.lower(F.trim(name))
    s = 0.5 + F.when(proper, 0.3).otherwise(0.0) + F.when((F.size(F.split(F.trim(name), r"\s+")) > 1) | name.contains("-") | name.contains("_"), 0.2).otherwise(0.0) + F.when(F.length(name) >= 5, 0.1).otherwise(0.0)
    s = s - F.when((F.length(low) < 5) & low.isin(*GENERIC), 0.3).otherwise(0.0) - F.when(coverage < 0.5, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))


@query("concept_specificity", f"""
WITH {_CONCEPTS}, s AS (SELECT doc_id, name, least(1.0, greatest(0.0, 0.5 + CASE WHEN regexp_matches(name, '^[A-Z]') THEN 0.3 ELSE 0 END + CASE WHEN len(regexp_split_to_array(trim(name), '\\s+')) > 1 OR contains(name, '-') OR contains(name, '_') THEN 0.2 ELSE 0 END
  + CASE WHEN length(name) >= 5 THEN 0.1 ELSE 0 END - CASE WHEN length(trim(name)) < 5 AND lower(trim(name)) IN ({", ".join(f"'{g}'" for g in GENERIC)}) THEN 0.3 ELSE 0 END - CASE WHEN n < 2 THEN 0.1 ELSE 0 END)) AS s FROM concepts)
SELECT doc_id, count(*) AS n, round(avg(s), 6) AS average, count(*) FILTER (s >= 0.3) AS high, count(*) FILTER (s < 0.3) AS low, max(s) < 0.3 AS is_low FROM s GROUP BY 1""")
def concept_specificity(spark: SparkSession, d: str) -> DataFrame:
    """Specificity of a document's concepts; a concept that occurs once covers less."""
    c = concepts(spark, d).select("doc_id", specificity(F.col("name"), F.col("name").rlike("^[A-Z]"), F.when(F.col("n") < 2, 0.0).otherwise(1.0)).alias("s"))
    return c.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("average"), F.count_if(F.col("s") >= 0.3).alias("high"), F.count_if(F.col("s") < 0.3).alias("low"), (F.max("s") < 0.3).alias("is_low"))


#: Characters of the texts whose bigrams one task counts.
TASK_CHARS = 16_000_000


@query("bigram_cache", f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '') AS w FROM documents), b AS (SELECT doc_id, unnest(list_transform(list_zip(w[:len(w) - 1], w[2:]), lambda p: p[1] || ' ' || p[2])) AS bigram FROM w WHERE len(w) > 1)
SELECT bigram, count(*) AS frequency, count(DISTINCT doc_id) AS doc_count FROM b GROUP BY 1 HAVING count(*) >= 2""")
def bigram_cache(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of neighbouring words that occur twice or more, with their documents."""
    return bigrams(table(spark, d, "documents"))


def bigrams(documents: DataFrame, chars: int = TASK_CHARS) -> DataFrame:
    """``bigram``, ``frequency`` and ``doc_count`` (distinct ids) of those that occur twice or more.

    Texts are dealt by id, so a document's bigrams are counted in its task, which has about
    ``chars`` of text; of bigrams only a task's sums are shuffled.
    """
    docs = documents.select("doc_id", "text")
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    docs = docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // chars)), "doc_id")
    w = docs.select("doc_id", T.words(F.col("text")).alias("w"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))
    each = w.select("doc_id", F.explode(F.array_compact(pairs)).alias("bigram")).groupBy("doc_id", "bigram").agg(F.count("*").alias("n"))
    return each.groupBy("bigram").agg(F.sum("n").alias("frequency"), F.count("doc_id").alias("doc_count")).where("frequency >= 2")


#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "e.g.", "i.e.", "etc.", "vs.")


@query("sentence_split", "WITH p AS (SELECT doc_id, " + "".join("replace(" for _ in ABBREVIATIONS) + "text" + "".join(f", '{a}', '{a.replace('.', '<dot>')}')" for a in ABBREVIATIONS) + r""" AS t FROM documents),
s AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[.!?]+'), lambda x: regexp_matches(x, '\S')) AS s FROM p)
SELECT doc_id, len(s) AS sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM s""")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of a text; the full stops of abbreviations are protected."""
    t = reduce(lambda c, a: F.replace(c, F.lit(a), F.lit(a.replace(".", "<dot>"))), ABBREVIATIONS, F.col("text"))
    s = table(spark, d, "documents").select("doc_id", F.filter(F.split(t, "[.!?]+"), lambda x: x.rlike(r"\S")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("sentences"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"))


@query("page_markers", r"""
SELECT doc_id, CAST(nullif(regexp_extract(m, '\[Page ([0-9]+)', 1), '') AS BIGINT) AS page, md5(regexp_replace(m, '\[Page [0-9]+[^\]]*\]\s*', '', 'g')) AS digest FROM (SELECT doc_id, '[Page ' || (doc_id % 9 + 1) || '] ' || text AS m FROM documents)""")
def page_markers(spark: SparkSession, d: str) -> DataFrame:
    """Page of a marked text, and the text without its markers."""
    m = table(spark, d, "documents").select("doc_id", F.concat(F.lit("[Page "), F.col("doc_id") % 9 + 1, F.lit("] "), "text").alias("m"))
    return m.select("doc_id", F.nullif(F.regexp_extract("m", r"\[Page ([0-9]+)", 1), F.lit("")).cast("long").alias("page"), F.md5(F.regexp_replace("m", r"\[Page [0-9]+[^\]]*\]\s*", "")).alias("digest"))


@query("conversation_keywords", "WITH k AS (SELECT conv_id, unnest(" + _KEYS.format("text") + """) AS word FROM conversations), c AS (SELECT conv_id, word, count(*) AS n FROM k GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, word) AS i FROM c) SELECT conv_id, word, n FROM r WHERE i <= 10""")
def conversation_keywords(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent keywords of each conversation."""
    c = table(spark, d, "conversations").select("conv_id", F.explode(T.keywords(F.col("text"))).alias("word")).groupBy("conv_id", "word").agg(F.count("*").alias("n"))
    return c.withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "word"))).where("i <= 10").drop("i")


@query("similar_documents", "WITH k AS (SELECT DISTINCT doc_id, unnest(" + _KEYS.format("text") + """) AS w FROM documents), c AS (SELECT doc_id, count(*) AS n FROM k GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM k a JOIN k b USING (w) WHERE a.doc_id % 50 = 0 AND a.doc_id <> b.doc_id GROUP BY 1, 2)
SELECT a, b, round(p.c * 1.0 / (x.n + y.n - p.c), 6) AS similarity FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 10 * p.c > 3 * (x.n + y.n - p.c)""")
def similar_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose keyword sets have a Jaccard similarity over 0.3 with one whose id is divisible by 50."""
    k = table(spark, d, "documents").where("doc_id IS NOT NULL").select("doc_id", F.array_distinct(T.keywords(F.col("text"))).alias("words")).where(F.size("words") > 0)
    k = written(k, "keywords")
    p = common_with_queries(k, k.where("doc_id % 50 = 0"), 3)
    return p.select("a", "b", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6).alias("similarity"))
