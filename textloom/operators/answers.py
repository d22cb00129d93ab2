"""From search results to answers: floors, boosts, quotas, context, citations, confidence and query understanding.

Queries are the items of ``benchmark``; a document's score is the share of an item's
keywords that it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from textloom.functions import rules as R
from textloom.functions import text as T
from textloom.operators.texts import _KEYS, _TOKENS
from textloom.plans.registry import query
from textloom.session import table, written

_HITS = f"""k AS (SELECT DISTINCT doc_id, unnest({_KEYS.format('text')}) AS w FROM documents), q AS (SELECT DISTINCT item_id, unnest({_KEYS.format('text')}) AS w FROM benchmark),
qn AS (SELECT item_id, count(*) AS n_keys FROM q GROUP BY 1), dn AS (SELECT doc_id, count(*) AS n_words FROM k GROUP BY 1),
hits AS (SELECT item_id, doc_id, matched, n_keys, n_words, round(matched * 1.0 / n_keys, 9)::DOUBLE AS score, round(matched / sqrt(n_keys * n_words), 9) AS semantic, source, lang, n_chars
  FROM (SELECT item_id, doc_id, count(*) AS matched FROM q JOIN k USING (w) GROUP BY 1, 2) JOIN qn USING (item_id) JOIN dn USING (doc_id) JOIN (SELECT doc_id, source, lang, n_chars FROM documents) USING (doc_id))"""


def keyword_sets(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``ws``, the distinct keywords of a text."""
    return df.select(*columns, F.array_distinct(T.keywords(F.col("text"))).alias("ws"))


def hits(spark: SparkSession, d: str, sets: DataFrame | None = None) -> DataFrame:
    """``item_id``, ``doc_id``, ``matched`` keywords, ``score``, ``semantic`` (cosine of the keyword sets) and the document's columns.

    ``sets`` are the documents' columns and keywords where the caller has them.
    """
    sets = document_sets(spark, d) if sets is None else sets
    k = sets.withColumn("n_words", F.size("ws")).withColumn("w", F.explode("ws")).drop("ws")
    q = keyword_sets(table(spark, d, "benchmark"), "item_id").withColumn("n_keys", F.size("ws")).withColumn("w", F.explode("ws")).drop("ws")
    h = q.join(k, "w").groupBy("item_id", "doc_id", "n_keys", "n_words", "source", "lang", "n_chars").agg(F.count("*").alias("matched"))
    return written(h.withColumn("score", F.round(F.col("matched") / F.col("n_keys"), 9)).withColumn("semantic", F.round(F.col("matched") / F.sqrt(F.col("n_keys") * F.col("n_words")), 9)), "hits")


def document_sets(spark: SparkSession, d: str) -> DataFrame:
    return keyword_sets(table(spark, d, "documents"), "doc_id", "source", "lang", "n_chars")


def ranked(h: DataFrame, *order: Column | str, by: str = "item_id") -> DataFrame:
    return h.withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


_TOP = "row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)"

#: Least similarity of a result.
FLOOR = 0.35


@query("similarity_floor", f"WITH {_HITS} SELECT item_id, count(*) AS results, count(*) FILTER (source IN ('src0', 'src1', 'src2')) AS allowed, max(score) AS best FROM hits WHERE score >= {FLOOR} GROUP BY 1")
def similarity_floor(spark: SparkSession, d: str) -> DataFrame:
    """Results that reach the floor, and those of them from sources on the list."""
    h = hits(spark, d).where(F.col("score") >= FLOOR)
    return h.groupBy("item_id").agg(F.count("*").alias("results"), F.count_if(F.col("source").isin("src0", "src1", "src2")).alias("allowed"), F.max("score").alias("best"))


@query("ranked_then_kept", f"""
WITH {_HITS}, r AS (SELECT *, {_TOP} AS i FROM hits), f AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY i) AS place FROM r WHERE i <= 20 AND source LIKE 'src1%') SELECT * FROM f WHERE place <= 10""")
def ranked_then_kept(spark: SparkSession, d: str) -> DataFrame:
    """Ten of a section out of twice as many fetched: the section is tested after the cut."""
    r = ranked(hits(spark, d), F.desc("score"), "doc_id").where("i <= 20").where(F.col("source").startswith("src1"))
    return r.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy("i"))).where("place <= 10").select("item_id", "doc_id", "score", "place")


@query("expanded_search", f"""
WITH {_HITS}, best AS (SELECT item_id, doc_id FROM (SELECT *, {_TOP} AS i FROM hits) WHERE i = 1),
x AS (SELECT item_id, w FROM (SELECT b.item_id, k.w, row_number() OVER (PARTITION BY b.item_id ORDER BY k.w) AS i FROM best b JOIN k USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.item_id = b.item_id AND q.w = k.w)) WHERE i <= 5),
e AS (SELECT item_id, doc_id, count(*) / 5.0::DOUBLE * 0.9::DOUBLE AS score FROM x JOIN k USING (w) GROUP BY 1, 2),
m AS (SELECT item_id, doc_id, score, 'original' AS origin FROM hits WHERE score >= {FLOOR} UNION ALL SELECT item_id, doc_id, score, 'expanded' FROM e WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.item_id = e.item_id AND h.doc_id = e.doc_id AND h.score >= {FLOOR}))
SELECT item_id, doc_id, round(score, 9) AS score, origin FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, origin DESC, doc_id) AS i FROM m) WHERE i <= 10""")
def expanded_search(spark: SparkSession, d: str) -> DataFrame:
    """Ten results of each query and its expansion by five words of the best document; expanded scores count 0.9, originals win."""
    # keywords are found once and kept as sets; of the best documents alone they are made rows that move
    sets = written(document_sets(spark, d), "keyword-sets")
    h = hits(spark, d, sets)
    q = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(T.keywords(F.col("text")))).alias("w"))
    best = ranked(h, F.desc("score"), "doc_id").where("i = 1").select("item_id", "doc_id")
    own = sets.select("doc_id", "ws").join(F.broadcast(best), "doc_id").select("item_id", F.explode("ws").alias("w"))  # one row a query
    x = ranked(own.join(q, ["item_id", "w"], "left_anti"), "w").where("i <= 5").select("item_id", "w")
    k = sets.select("doc_id", F.explode("ws").alias("w"))
    e = k.join(F.broadcast(x), "w").groupBy("item_id", "doc_id").agg((F.count("*") / 5.0 * 0.9).alias("score"))  # five rows a query
    original = h.where(F.col("score") >= FLOOR).select("item_id", "doc_id", "score", F.lit("original").alias("origin"))
    m = original.union(e.join(original, ["item_id", "doc_id"], "left_anti").select("item_id", "doc_id", "score", F.lit("expanded")))
    return ranked(m.withColumn("score", F.round("score", 9)), F.desc("score"), F.desc("origin"), "doc_id").where("i <= 10").drop("i")


@query("strategy_dispatch", f"""
WITH t AS (SELECT item_id, text, len({_TOKENS.format('text')}) AS n, len(list_filter({_TOKENS.format('text')}, lambda w: regexp_matches(w, '^[A-Z][a-z]'))) AS proper FROM benchmark)
SELECT item_id, CASE WHEN regexp_matches(text, '(?i)\\b(related|connected|relationship|path between)\\b') THEN 'knowledge_graph' WHEN n <= 3 OR contains(text, '"') THEN 'keyword' WHEN proper >= 2 THEN 'hybrid' ELSE 'vector' END AS strategy FROM t""")
def strategy_dispatch(spark: SparkSession, d: str) -> DataFrame:
    t, w = F.col("text"), T.tokens(F.col("text"))
    proper = F.size(F.filter(w, lambda x: x.rlike("^[A-Z][a-z]")))
    s = F.when(t.rlike(r"(?i)\b(related|connected|relationship|path between)\b"), "knowledge_graph").when((F.size(w) <= 3) | t.contains('"'), "keyword").when(proper >= 2, "hybrid").otherwise("vector")
    return table(spark, d, "benchmark").select("item_id", s.alias("strategy"))


#: Results of a query, dealt to sources by weight.
MOST = 15


@query("weighted_quotas", f"""
WITH {_HITS}, f AS (SELECT * FROM hits WHERE score >= {FLOOR}), w AS (SELECT item_id, source, avg(score) AS w FROM f GROUP BY 1, 2), t AS (SELECT item_id, source, CAST(floor(round({MOST} * w / sum(w) OVER (PARTITION BY item_id), 9)) AS BIGINT) AS quota FROM w),
r AS (SELECT f.item_id, f.source, doc_id, score, quota, row_number() OVER (PARTITION BY f.item_id, f.source ORDER BY score DESC, doc_id) AS i FROM f JOIN t USING (item_id, source)) SELECT item_id, source, doc_id, score, quota FROM r WHERE i <= quota""")
def weighted_quotas(spark: SparkSession, d: str) -> DataFrame:
    """Each source's best results, as many as its share of the mean scores allows."""
    f = hits(spark, d).where(F.col("score") >= FLOOR)
    w = f.groupBy("item_id", "source").agg(F.avg("score").alias("w"))
    quota = F.floor(F.round(MOST * F.col("w") / F.sum("w").over(Window.partitionBy("item_id")), 9))
    r = f.join(w.select("item_id", "source", quota.alias("quota")), ["item_id", "source"])
    return r.withColumn("i", F.row_number().over(Window.partitionBy("item_id", "source").orderBy(F.desc("score"), "doc_id"))).where("i <= quota").select("item_id", "source", "doc_id", "score", "quota")


#: Fixed value: how much more the preferred sources count.
BOOST = 1.15


@query("source_boost", f"""
WITH {_HITS}, b AS (SELECT item_id, doc_id, lang = 'en' AS preferred, round(CASE WHEN lang = 'en' THEN least(1.0::DOUBLE, score * {BOOST}::DOUBLE) ELSE score END, 8) AS score FROM hits WHERE score >= {FLOOR})
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, preferred DESC, doc_id) AS place FROM b) WHERE place <= {MOST}""")
def source_boost(spark: SparkSession, d: str) -> DataFrame:
    """Preferred sources' scores rise by 15 %, 1 at most; both kinds are merged and sorted again."""
    h = hits(spark, d).where(F.col("score") >= FLOOR)
    preferred = F.col("lang") == "en"
    b = h.select("item_id", "doc_id", preferred.alias("preferred"), F.round(F.when(preferred, F.least(F.lit(1.0), F.col("score") * BOOST)).otherwise(F.col("score")), 8).alias("score"))
    return ranked(b, F.desc("score"), F.desc("preferred"), "doc_id").where(F.col("i") <= MOST).withColumnRenamed("i", "place")


@query("context_assembly", f"""
WITH {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS j FROM hits WHERE score >= {FLOOR}), c AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS i FROM r WHERE j <= 3),
l AS (SELECT *, sum(n_chars + 100) OVER (PARTITION BY item_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS used FROM c),
s AS (SELECT *, min(CASE WHEN used > 8000 THEN i END) OVER (PARTITION BY item_id) AS stop FROM l)
SELECT item_id, count(*) AS chunks, CAST(max(used) AS BIGINT) AS used, array_to_string(list('[' || i || '] ' || source || '/' || doc_id ORDER BY i), ' ') AS citations FROM s WHERE i < coalesce(stop, 1000000) GROUP BY 1""")
def context_assembly(spark: SparkSession, d: str) -> DataFrame:
    """What fits into a prompt: three results a source, the best first, until the budget is passed; each gets its citation number."""
    h = hits(spark, d).where(F.col("score") >= FLOOR)
    c = ranked(h.withColumn("j", F.row_number().over(Window.partitionBy("item_id", "source").orderBy(F.desc("score"), "doc_id"))).where("j <= 3"), F.desc("score"), "doc_id")
    l = c.withColumn("used", F.sum(F.col("n_chars") + 100).over(Window.partitionBy("item_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    s = l.withColumn("stop", F.min(F.when(F.col("used") > 8000, F.col("i"))).over(Window.partitionBy("item_id"))).where("stop IS NULL OR i < stop")
    one = F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] "), "source", F.lit("/"), F.col("doc_id").cast("string"))
    return s.groupBy("item_id").agg(F.count("*").alias("chunks"), F.max("used").alias("used"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", one.alias("c")))), lambda x: x["c"]), " ").alias("citations"))


@query("answer_confidence", f"""
WITH {_HITS}, r AS (SELECT item_id, score, semantic FROM (SELECT *, {_TOP} AS i FROM hits WHERE score >= {FLOOR}) WHERE i <= {MOST}),
a AS (SELECT b.item_id, count(r.score) AS n, avg(score) AS m, max(score) - min(score) AS spread, var_pop(score) AS v FROM benchmark b LEFT JOIN r USING (item_id) GROUP BY 1)
SELECT item_id, n, n >= 3 AND (spread < 0.05 OR v < 0.001) AS flat, round(CASE WHEN n = 0 THEN 0.3 ELSE greatest(0.1, least(1.0, (m + CASE WHEN n >= 3 THEN 0.1 WHEN n = 1 THEN -0.1 ELSE 0 END) * CASE WHEN n >= 3 AND (spread < 0.05 OR v < 0.001) THEN 0.8 ELSE 1.0 END)) END, 6) AS confidence FROM a""")
def answer_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Mean similarity, more for three results and less for one, times the factor of a flat score profile; 0.3 without results."""
    r = ranked(hits(spark, d).where(F.col("score") >= FLOOR), F.desc("score"), "doc_id").where(F.col("i") <= MOST).select("item_id", "score")
    a = table(spark, d, "benchmark").select("item_id").join(r, "item_id", "left").groupBy("item_id").agg(F.count("score").alias("n"), F.avg("score").alias("m"), (F.max("score") - F.min("score")).alias("spread"), F.var_pop("score").alias("v"))
    flat = F.coalesce((F.col("n") >= 3) & ((F.col("spread") < 0.05) | (F.col("v") < 0.001)), F.lit(False))
    c = (F.col("m") + F.when(F.col("n") >= 3, 0.1).when(F.col("n") == 1, -0.1).otherwise(0.0)) * F.when(flat, 0.8).otherwise(1.0)
    return a.select("item_id", "n", flat.alias("flat"), F.round(F.when(F.col("n") == 0, 0.3).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), c))), 6).alias("confidence"))


@query("citation_numbers", f"""
WITH {_HITS}, r AS (SELECT *, {_TOP} AS i FROM hits WHERE score >= {FLOOR}), f AS (SELECT item_id, source, min(i) AS first, count(*) AS uses FROM r WHERE i <= {MOST} GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY first) AS number FROM f)
SELECT item_id, source, number, uses, '[' || number || ']' AS inline_form, number || '. ' || source AS footnote, source || ' (cited ' || uses || ' times)' AS bibliography FROM n""")
def citation_numbers(spark: SparkSession, d: str) -> DataFrame:
    """One number a source, in order of first use, with its three forms."""
    r = ranked(hits(spark, d).where(F.col("score") >= FLOOR), F.desc("score"), "doc_id").where(F.col("i") <= MOST)
    f = r.groupBy("item_id", "source").agg(F.min("i").alias("first"), F.count("*").alias("uses"))
    n = f.withColumn("number", F.row_number().over(Window.partitionBy("item_id").orderBy("first")).cast("long"))
    s = lambda c: F.col(c).cast("string")
    return n.select("item_id", "source", "number", "uses", F.concat(F.lit("["), s("number"), F.lit("]")).alias("inline_form"), F.concat(s("number"), F.lit(". "), "source").alias("footnote"), F.concat("source", F.lit(" (cited "), s("uses"), F.lit(" times)")).alias("bibliography"))


@query("concept_scores", f"""
WITH {_HITS}, a AS (SELECT item_id, doc_id, least(1.0, greatest(0.1, matched / 10.0)) + CASE WHEN matched > 1 THEN 0.1 * log2(matched) ELSE 0 END AS direct, source FROM hits),
t AS (SELECT item_id, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY direct DESC, doc_id) AS i FROM a) WHERE i <= 3),
rel AS (SELECT t.item_id, x.doc_id, min(1) AS hop FROM t JOIN (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS j FROM documents) x ON x.source = t.source AND x.j <= 20 AND x.doc_id <> t.doc_id GROUP BY 1, 2),
u AS (SELECT item_id, doc_id, direct AS s, 'direct' AS via FROM a UNION ALL SELECT rel.item_id, rel.doc_id, 0.5, 'related' FROM rel)
SELECT item_id, doc_id, round(least(1.0, s), 6) AS score, via FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY via) AS i FROM u) WHERE i = 1 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(least(1.0, s), 6) DESC, via, doc_id) <= {MOST}""")
def concept_scores(spark: SparkSession, d: str) -> DataFrame:
    """Direct documents by clamped matches and the logarithm of their number; related ones, one hop off by source, at 0.5; the best of each."""
    h = hits(spark, d)
    m = F.col("matched")
    a = h.select("item_id", "doc_id", "source", (F.least(F.lit(1.0), F.greatest(F.lit(0.1), m / 10)) + F.when(m > 1, 0.1 * F.log2(m.cast("double"))).otherwise(0.0)).alias("direct"))
    top = ranked(a, F.desc("direct"), "doc_id").where("i <= 3").select("item_id", "source", F.col("doc_id").alias("from"))
    x = ranked(table(spark, d, "documents").select("doc_id", "source"), "doc_id", by="source").where("i <= 20").drop("i")
    rel = top.join(x, "source").where(F.col("doc_id") != F.col("from")).select("item_id", "doc_id").distinct()
    u = a.select("item_id", "doc_id", F.col("direct").alias("s"), F.lit("direct").alias("via")).union(rel.select("item_id", "doc_id", F.lit(0.5), F.lit("related")))
    one = u.groupBy("item_id", "doc_id").agg(F.min_by(F.struct("s", "via"), "via").alias("b")).select("item_id", "doc_id", F.round(F.least(F.lit(1.0), "b.s"), 6).alias("score"), "b.via")
    return ranked(one, F.desc("score"), "via", "doc_id").where(F.col("i") <= MOST).drop("i")


@query("augmented_retrieval", f"""
WITH {_HITS}, strong AS (SELECT item_id, doc_id, score, 'graph' AS origin FROM (SELECT *, {_TOP} AS i FROM hits WHERE score >= 0.6) WHERE i <= {MOST}), n AS (SELECT b.item_id, count(s.doc_id) AS n FROM benchmark b LEFT JOIN strong s USING (item_id) GROUP BY 1),
weak AS (SELECT item_id, doc_id, semantic AS score, 'semantic' AS origin FROM (SELECT h.*, n.n, row_number() OVER (PARTITION BY h.item_id ORDER BY semantic DESC, doc_id) AS i FROM hits h JOIN n USING (item_id) WHERE h.score < 0.6) WHERE n < 3 AND i <= {MOST} - n)
SELECT * FROM strong UNION ALL SELECT * FROM weak""")
def augmented_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Strong results; where a query has fewer than three, the nearest others fill up."""
    h = hits(spark, d)
    strong = ranked(h.where("score >= 0.6"), F.desc("score"), "doc_id").where(F.col("i") <= MOST).select("item_id", "doc_id", "score", F.lit("graph").alias("origin"))
    n = table(spark, d, "benchmark").select("item_id").join(strong, "item_id", "left").groupBy("item_id").agg(F.count("doc_id").alias("n"))
    weak = ranked(h.where("score < 0.6").join(n.where("n < 3"), "item_id"), F.desc("semantic"), "doc_id").where(F.col("i") <= MOST - F.col("n"))
    return strong.union(weak.select("item_id", "doc_id", F.col("semantic").alias("score"), F.lit("semantic")))


@query("rerank_blend", f"""
WITH {_HITS}, p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY (score >= 0.7) DESC, CASE WHEN score >= 0.7 THEN score END DESC NULLS LAST, doc_id) AS i, row_number() OVER (PARTITION BY item_id ORDER BY semantic DESC, doc_id) AS j FROM hits),
kept AS (SELECT * FROM p WHERE score >= 0.7 AND i <= {MOST}), rest AS (SELECT p.*, row_number() OVER (PARTITION BY p.item_id ORDER BY p.semantic DESC, p.doc_id) AS r, (SELECT count(*) FROM kept WHERE kept.item_id = p.item_id) AS used FROM p WHERE NOT (score >= 0.7 AND i <= {MOST})),
c AS (SELECT item_id, doc_id, score, semantic FROM kept UNION ALL SELECT item_id, doc_id, score, semantic FROM rest WHERE r <= 2 * {MOST} - used),
f AS (SELECT item_id, doc_id, round(pow(greatest(score, 1e-6), 0.7) * pow(greatest(semantic, 1e-6), 0.3), 8) AS final FROM c)
SELECT item_id, doc_id, final FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY final DESC, doc_id) AS i FROM f) WHERE i <= {MOST}""")
def rerank_blend(spark: SparkSession, d: str) -> DataFrame:
    """Candidates: up to half by a graph score of 0.7, the rest by cosine; ordered by kg^0.7 * sem^0.3."""
    h = hits(spark, d)
    kept = ranked(h.where("score >= 0.7"), F.desc("score"), "doc_id").where(F.col("i") <= MOST).drop("i")
    used = kept.groupBy("item_id").agg(F.count("*").alias("used"))
    rest = ranked(h.join(kept.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti").select(h.columns), F.desc("semantic"), "doc_id").join(used, "item_id", "left").where(F.col("i") <= 2 * MOST - F.coalesce("used", F.lit(0)))
    c = kept.select("item_id", "doc_id", "score", "semantic").union(rest.select("item_id", "doc_id", "score", "semantic"))
    f = c.select("item_id", "doc_id", F.round(F.pow(F.greatest("score", F.lit(1e-6)), 0.7) * F.pow(F.greatest("semantic", F.lit(1e-6)), 0.3), 8).alias("final"))
    return ranked(f, F.desc("final"), "doc_id").where(F.col("i") <= MOST).drop("i")


_NOUNS = r"list_distinct(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda w: regexp_matches(w, '^[A-Z][a-z]+$') AND length(w) > 3))"


@query("noun_coverage", f"""
WITH {_HITS}, p AS (SELECT item_id, {_NOUNS} AS nouns FROM benchmark), t AS (SELECT item_id, doc_id, score FROM (SELECT *, {_TOP} AS i FROM hits) WHERE i <= {MOST}),
c AS (SELECT t.item_id, t.doc_id, t.score, d.lang = 'en' AS library, CASE WHEN len(nouns) = 0 THEN 0.0 ELSE len(list_filter(nouns, lambda n: contains(d.text, n))) * 1.0 / len(nouns) END AS share, len(nouns) AS n FROM t JOIN p USING (item_id) JOIN documents d USING (doc_id)),
g AS (SELECT *, CASE WHEN n <= 2 THEN 1.0 ELSE greatest(0.7, 1 - 0.05 * (n - 2)) END AS threshold FROM c), s AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, share DESC, library DESC, doc_id) AS place FROM g)
SELECT item_id, doc_id, place, round(share, 6)::DOUBLE AS share, round(threshold, 6)::DOUBLE AS threshold, share >= threshold AS passed FROM s""")
def noun_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of a query's names in each of its best documents against the threshold for so many names; sorted by score, share, library."""
    nouns = F.array_distinct(F.filter(F.split("text", r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[A-Z][a-z]+$") & (F.length(w) > 3)))
    p = table(spark, d, "benchmark").select("item_id", nouns.alias("nouns"))
    t = ranked(hits(spark, d), F.desc("score"), "doc_id").where(F.col("i") <= MOST).select("item_id", "doc_id", "score")
    c = t.join(p, "item_id").join(table(spark, d, "documents").select("doc_id", "text", (F.col("lang") == "en").alias("library")), "doc_id")
    n = F.size("nouns")
    c = c.withColumn("share", F.when(n == 0, 0.0).otherwise(F.size(F.filter("nouns", lambda x: F.col("text").contains(x))) / n)).withColumn("threshold", F.when(n <= 2, 1.0).otherwise(F.greatest(F.lit(0.7), 1 - 0.05 * (n - 2))))
    s = ranked(c, F.desc("score"), F.desc("share"), F.desc("library"), "doc_id")
    return s.select("item_id", "doc_id", F.col("i").alias("place"), F.round("share", 6).alias("share"), F.round("threshold", 6).alias("threshold"), (F.col("share") >= F.col("threshold")).alias("passed"))


#: Words of queries.
ACTIONS = tuple("""observed found discovered noted reported identified analyzed concluded determined saw mentioned stated described explained discussed showed demonstrated revealed indicated suggested
confirmed verified documented recorded highlighted examined investigated explored studied reviewed assessed evaluated measured tested compared observe find discover note report identify analyze conclude determine see mention
state describe explain discuss show demonstrate reveal indicate suggest""".split())
SUBJECTS = ("our team", "the team", "we", "the system", "the author", "the researchers", "the study", "the analysis", "the report", "the paper", "the document", "the article", "the book", "the chapter", "the section", "the findings", "the results", "they",
            "the experts", "the scientists", "the engineers", "the developers", "the analysts", "the investigators", "our analysis", "our research", "our findings", "our study", "this research", "this study", "this analysis", "this report")
QUERY_STOPS = tuple("""what did our the a an is are was were at in on to for of with by from about how why when where who which that this these those it its they them their we us you your i me my he she him her his and or but
if then else so as be been being have has had do does done will would could should can may might must shall team observe observed""".split())
_IN = lambda ws: ", ".join(f"'{w}'" for w in ws)
#: What a query says, over columns ``t`` (its text), ``l`` (in lower case) and ``w`` (its words in lower case).
_UNDERSTOOD = {
    "actions": f"@join(@sort(@dist(@flt(w, @x x IN ({_IN(ACTIONS)})))), ',')",
    "subject": "CASE " + " ".join(rf"WHEN @rx(l, @'(^|[^a-z]){s}([^a-z]|$)') THEN '{s}'" for s in SUBJECTS) + " ELSE '' END",
    "n_content": f"CAST(@n(@flt(w, @x x NOT IN ({_IN((*QUERY_STOPS, *ACTIONS))}) AND length(x) > 2)) AS BIGINT)",
    "intent": """CASE WHEN @rx(l, @'^\\s*(how|why)([^a-z]|$)') THEN 'explanation' WHEN @rx(l, @'^\\s*(what|who|where|when|which)([^a-z]|$)') THEN 'factual' WHEN @rx(l, @'(compare|difference|versus)') THEN 'comparison'
 WHEN @rx(l, @'(list|show|find|search)([^a-z]|$)') THEN 'search' WHEN @rx(l, @'(hello|hi|thanks|thank you)([^a-z]|$)') THEN 'conversational' ELSE 'general' END""",
    "relation": """CASE WHEN @rx(l, @'(cause|lead|result)s?([^a-z]|$)') THEN 'CAUSES' WHEN @rx(l, @'part of|contains') THEN 'PART_OF' WHEN @rx(l, @'(related|connected|associated)') THEN 'RELATED_TO' ELSE '' END""",
    "complexity": "CASE WHEN @n(w) > 20 OR contains(l, ' and ') AND contains(l, '?') THEN 'complex' WHEN @n(w) > 8 THEN 'moderate' ELSE 'simple' END",
}


@query("query_understanding", "WITH q AS (SELECT conv_id, turn, text AS t, lower(text) AS l, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '') AS w FROM conversations WHERE role = 'user') SELECT conv_id, turn, " + ", ".join(f"{R.duck(r)} AS {k}" for k, r in _UNDERSTOOD.items()) + " FROM q")
def query_understanding(spark: SparkSession, d: str) -> DataFrame:
    """Actions, subject, content words, intent, relation and complexity of every user turn."""
    q = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("t"), F.lower("text").alias("l"), T.tokens(F.lower("text")).alias("w"))
    return q.selectExpr("conv_id", "turn", *[f"{R.spark(r)} AS {k}" for k, r in _UNDERSTOOD.items()])


@query("graph_boost", f"""
WITH {_HITS}, t AS (SELECT item_id, doc_id, score FROM (SELECT *, {_TOP} AS i FROM hits) WHERE i <= 3), rel AS (SELECT item_id, w, count(*) AS c FROM t JOIN k USING (doc_id) GROUP BY 1, 2), five AS (SELECT item_id, w FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY c DESC, w) AS i FROM rel) WHERE i <= 5),
b AS (SELECT h.item_id, h.doc_id, h.score, count(f.w) AS related FROM (SELECT * FROM hits WHERE score >= {FLOOR}) h LEFT JOIN (SELECT item_id, doc_id, w FROM five JOIN k USING (w)) f ON f.item_id = h.item_id AND f.doc_id = h.doc_id GROUP BY 1, 2, 3)
SELECT item_id, doc_id, related, round(least(1.0, score + 0.1 * related), 6) AS score FROM b""")
def graph_boost(spark: SparkSession, d: str) -> DataFrame:
    """Scores rise by 0.1 for each of five related words (those that the best three documents share most) that a document has."""
    h = hits(spark, d)
    k = written(table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.keywords(F.col("text")))).alias("w")), "keywords")
    t = ranked(h, F.desc("score"), "doc_id").where("i <= 3").select("item_id", "doc_id")
    five = ranked(t.join(k, "doc_id").groupBy("item_id", "w").agg(F.count("*").alias("c")), F.desc("c"), "w").where("i <= 5").select("item_id", "w")
    found = five.join(k, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("related"))
    b = h.where(F.col("score") >= FLOOR).join(found, ["item_id", "doc_id"], "left").withColumn("related", F.coalesce("related", F.lit(0).cast("long")))
    return b.select("item_id", "doc_id", "related", F.round(F.least(F.lit(1.0), F.col("score") + 0.1 * F.col("related")), 6).alias("score"))


@query("noun_filter_cascade", f"""
WITH {_HITS}, p AS (SELECT item_id, {_NOUNS} AS nouns FROM benchmark), t AS (SELECT item_id, doc_id FROM (SELECT *, {_TOP} AS i FROM hits) WHERE i <= {MOST}),
c AS (SELECT t.item_id, t.doc_id, len(nouns) AS n, len(list_filter(nouns, lambda x: contains(d.text, x))) AS found FROM t JOIN p USING (item_id) JOIN documents d USING (doc_id)),
g AS (SELECT *, CASE WHEN n = 0 THEN 0 WHEN found = n THEN 3 WHEN found >= n * CASE WHEN n <= 2 THEN 1.0 ELSE greatest(0.7, 1 - 0.05 * (n - 2)) END THEN 2 WHEN found > 0 THEN 1 ELSE 0 END AS level FROM c), m AS (SELECT *, max(level) OVER (PARTITION BY item_id) AS best FROM g)
SELECT item_id, doc_id, found, CASE best WHEN 3 THEN 'all' WHEN 2 THEN 'threshold' WHEN 1 THEN 'any' ELSE 'none' END AS filter FROM m WHERE level = best""")
def noun_filter_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Results with all of a query's names; if none has, those that reach the threshold, else any, else all results as they are."""
    nouns = F.array_distinct(F.filter(F.split("text", r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[A-Z][a-z]+$") & (F.length(w) > 3)))
    p = table(spark, d, "benchmark").select("item_id", nouns.alias("nouns"))
    t = ranked(hits(spark, d), F.desc("score"), "doc_id").where(F.col("i") <= MOST).select("item_id", "doc_id")
    c = t.join(p, "item_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    n = F.size("nouns")
    c = c.select("item_id", "doc_id", n.alias("n"), F.size(F.filter("nouns", lambda x: F.col("text").contains(x))).alias("found"))
    need = F.col("n") * F.when(F.col("n") <= 2, 1.0).otherwise(F.greatest(F.lit(0.7), 1 - 0.05 * (F.col("n") - 2)))
    level = F.when(F.col("n") == 0, 0).when(F.col("found") == F.col("n"), 3).when(F.col("found") >= need, 2).when(F.col("found") > 0, 1).otherwise(0)
    g = c.withColumn("level", level).withColumn("best", F.max("level").over(Window.partitionBy("item_id"))).where("level = best")
    return g.select("item_id", "doc_id", F.col("found").cast("long").alias("found"), F.when(F.col("best") == 3, "all").when(F.col("best") == 2, "threshold").when(F.col("best") == 1, "any").otherwise("none").alias("filter"))


@query("concept_order", """
WITH p AS (SELECT p_name AS name, count(*) AS n, regexp_matches(p_name, '^[A-Z]') AS proper FROM part GROUP BY 1, 3) SELECT name, n, row_number() OVER (ORDER BY n DESC, proper DESC, length(name), name) AS place FROM p ORDER BY place LIMIT 10""")
def concept_order(spark: SparkSession, d: str) -> DataFrame:
    """Ten concepts: by score, proper names first, then the shorter name."""
    p = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc(F.col("name").rlike("^[A-Z]")), F.length("name"), "name").limit(10)
    return p.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.desc(F.col("name").rlike("^[A-Z]")), F.length("name"), "name")).cast("long"))  # ten rows


@query("result_state", f"""
WITH {_HITS}, r AS (SELECT * FROM (SELECT *, {_TOP} AS i FROM hits WHERE score >= {FLOOR}) WHERE i <= {MOST}), a AS (SELECT b.item_id, count(r.doc_id) AS n, avg(r.score) AS m, max(r.score) AS best, count(DISTINCT source) AS sources FROM benchmark b LEFT JOIN r USING (item_id) GROUP BY 1)
SELECT item_id, n, CASE WHEN n = 0 THEN 'empty' WHEN n < 3 THEN 'thin' WHEN m < 0.4 THEN 'irrelevant' WHEN best < 0.5 THEN 'weak' ELSE 'good' END AS state, CASE WHEN n < 3 THEN 'web' WHEN m < 0.4 OR best < 0.5 THEN 'semantic' ELSE 'none' END AS supplement, sources FROM a""")
def result_state(spark: SparkSession, d: str) -> DataFrame:
    """What the results of a query are worth, and what should supplement them."""
    r = ranked(hits(spark, d).where(F.col("score") >= FLOOR), F.desc("score"), "doc_id").where(F.col("i") <= MOST).select("item_id", "doc_id", "score", "source")
    a = table(spark, d, "benchmark").select("item_id").join(r, "item_id", "left").groupBy("item_id").agg(F.count("doc_id").alias("n"), F.avg("score").alias("m"), F.max("score").alias("best"), F.countDistinct("source").alias("sources"))
    n, m, best = F.col("n"), F.col("m"), F.col("best")
    return a.select("item_id", "n", F.when(n == 0, "empty").when(n < 3, "thin").when(m < 0.4, "irrelevant").when(best < 0.5, "weak").otherwise("good").alias("state"), F.when(n < 3, "web").when((m < 0.4) | (best < 0.5), "semantic").otherwise("none").alias("supplement"), "sources")
