"""Knowledge joins: same-as links, lookups by priority, validation, merging, pruning, hierarchies and paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from textloom.operators.concepts import _CONCEPTS, concepts
from textloom.operators.graphs import _TRADE, trade
from textloom.plans.registry import query
from textloom.session import table, written


@query("same_as_links", """
WITH p AS (SELECT p_partkey, lower(p_name) || '|' || p_brand || '|' || p_type || '|' || p_size AS qid FROM part), s AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
SELECT a.p_partkey AS a, b.p_partkey AS b, a.qid FROM p a JOIN p b ON a.qid = b.qid AND a.p_partkey < b.p_partkey WHERE NOT EXISTS (SELECT 1 FROM s x JOIN s y ON x.l_suppkey = y.l_suppkey WHERE x.l_partkey = a.p_partkey AND y.l_partkey = b.p_partkey)""")
def same_as_links(spark: SparkSession, d: str) -> DataFrame:
    """Entities of one outer identity whose sources (suppliers) have nothing in common."""
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("|", F.lower("p_name"), "p_brand", "p_type", F.col("p_size").cast("string")).alias("qid"))
    many = p.groupBy("qid").count().where("count > 1").select("qid")
    p = written(p.join(many, "qid"), "identities")
    pairs = p.select("qid", F.col("p_partkey").alias("a")).join(p.select("qid", F.col("p_partkey").alias("b")), "qid").where("a < b")
    s = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    common = pairs.join(s.select(F.col("l_partkey").alias("a"), "l_suppkey"), "a").join(s.select(F.col("l_partkey").alias("b"), "l_suppkey"), ["b", "l_suppkey"]).select("a", "b").distinct()
    return pairs.join(common, ["a", "b"], "left_anti").select("a", "b", "qid")


@query("bridge_by_priority", """
WITH u AS (SELECT lower(p_name) AS name, p_partkey AS id, CASE WHEN p_size <= 25 THEN 0 ELSE 1 END AS synonym FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY synonym, id) AS i, count(DISTINCT id) OVER (PARTITION BY name) AS candidates FROM u)
SELECT name, id, CASE synonym WHEN 0 THEN 'preferred' ELSE 'synonym' END AS via, candidates FROM r WHERE i = 1""")
def bridge_by_priority(spark: SparkSession, d: str) -> DataFrame:
    """One entity a name: preferred names come before synonyms, then the smallest id."""
    u = table(spark, d, "part").select(F.lower("p_name").alias("name"), F.col("p_partkey").alias("id"), F.when(F.col("p_size") <= 25, 0).otherwise(1).alias("synonym"))
    best = u.groupBy("name").agg(F.min(F.struct("synonym", "id")).alias("b"), F.countDistinct("id").alias("candidates"))
    return best.select("name", "b.id", F.when(F.col("b.synonym") == 0, "preferred").otherwise("synonym").alias("via"), "candidates")


@query("name_union", "SELECT DISTINCT lower(p_name) AS name, 'preferred' AS via FROM part WHERE p_size <= 25 UNION SELECT DISTINCT lower(p_name), 'synonym' FROM part WHERE p_size > 25 UNION SELECT lower(n_name), 'preferred' FROM nation")
def name_union(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    one = lambda df, c, via: df.select(F.lower(c).alias("name"), F.lit(via).alias("via"))
    return one(p.where("p_size <= 25"), "p_name", "preferred").union(one(p.where("p_size > 25"), "p_name", "synonym")).union(one(table(spark, d, "nation"), "n_name", "preferred")).distinct()


@query("edge_validation", """
WITH s AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0), p AS (SELECT p_partkey FROM part WHERE p_size > 25)
SELECT l_suppkey AS s, l_partkey AS p, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM s) AND l_partkey IN (SELECT p_partkey FROM p) GROUP BY 1, 2""")
def edge_validation(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose both ends are in the set of known entities."""
    s = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    p = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    e = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(s, "l_suppkey", "left_semi").join(p, "l_partkey", "left_semi")
    return e.groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).agg(F.count("*").alias("n"))


def merge_concepts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Concepts of both by lower-case name: best confidence, number of documents together, occurrences together."""
    both = old.unionByName(new).withColumn("key", F.lower(F.trim("name")))
    return both.groupBy("key").agg(F.max("confidence").alias("confidence"), F.countDistinct("doc_id").alias("n_docs"), F.sum("n").alias("n"), F.countDistinct("name").alias("aliases"))


@query("incremental_merge", f"""
WITH {_CONCEPTS} SELECT lower(trim(name)) AS key, max(confidence)::DOUBLE AS confidence, count(DISTINCT doc_id) AS n_docs, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT name) AS aliases FROM concepts GROUP BY 1""")
def incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of English documents, then those of the others merged in: the same as all at once."""
    c = written(concepts(spark, d).join(table(spark, d, "documents").select("doc_id", (F.col("lang") == "en").alias("en")), "doc_id"), "concepts")
    part = lambda w: c.where(w).select("doc_id", "name", "n", "confidence")
    return merge_concepts(part("en"), part("NOT coalesce(en, false)"))


@query("orphan_pruning", f"""
WITH {_CONCEPTS}, c AS (SELECT kind, name, count(*) FILTER (source = 'src0') AS gone, count(*) AS n FROM concepts JOIN documents USING (doc_id) GROUP BY 1, 2)
SELECT kind, count(*) AS concepts, count(*) FILTER (gone > 0) AS touched, count(*) FILTER (gone = n) AS orphans FROM c GROUP BY 1""")
def orphan_pruning(spark: SparkSession, d: str) -> DataFrame:
    """What the deletion of a source's documents leaves of the concepts: those without a document go."""
    c = concepts(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("kind", "name").agg(F.count_if(F.col("source") == "src0").alias("gone"), F.count("*").alias("n"))
    return c.groupBy("kind").agg(F.count("*").alias("concepts"), F.count_if(F.col("gone") > 0).alias("touched"), F.count_if(F.col("gone") == F.col("n")).alias("orphans"))


@query("concept_hierarchy", """
WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS child, 'world' AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
h AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT h.node, e.parent, depth + 1 FROM h JOIN e ON e.child = h.ancestor WHERE depth < 5) SELECT ancestor, depth, count(*) AS n FROM h GROUP BY 1, 2""")
def concept_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Descendants of every node of a hierarchy by depth."""
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = table(spark, d, "region").select(s("r", "r_regionkey").alias("child"), F.lit("world").alias("parent"))
    e = e.union(table(spark, d, "nation").select(s("n", "n_nationkey"), s("r", "n_regionkey"))).union(table(spark, d, "supplier").select(s("s", "s_suppkey"), s("n", "s_nationkey")))
    e = written(e, "hierarchy")
    level = e.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"))
    levels = [level.withColumn("depth", F.lit(1))]
    for depth in range(2, 6):
        level = level.join(e, F.col("ancestor") == F.col("child")).select("node", F.col("parent").alias("ancestor"))
        levels.append(level.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.union, levels).groupBy("ancestor", "depth").agg(F.count("*").alias("n"))


@query("multi_hop_paths", f"""
WITH {_TRADE}, w AS (SELECT a, b, n * 1.0::DOUBLE / max(n) OVER () AS w FROM trade), p AS (SELECT a AS f, b AS t, w AS score, a || '>' || b AS path FROM w UNION ALL SELECT x.a, y.b, sqrt(x.w * y.w), x.a || '>' || x.b || '>' || y.b FROM w x JOIN w y ON x.b = y.a WHERE x.a <> y.b),
r AS (SELECT *, row_number() OVER (PARTITION BY f, t ORDER BY round(score, 9) DESC, path) AS i FROM p WHERE f < 3 AND t BETWEEN 3 AND 5) SELECT f, t, path, round(score, 6) AS score FROM r WHERE i <= 10""")
def multi_hop_paths(spark: SparkSession, d: str) -> DataFrame:
    """Ten paths of one or two hops between three starts and three ends, by the geometric mean of their edges."""
    t = written(trade(spark, d), "trade")
    w = t.crossJoin(F.broadcast(t.agg(F.max("n").alias("m")))).select("a", "b", (F.col("n") / F.col("m")).alias("w"))
    name = lambda *cs: F.concat_ws(">", *[F.col(c).cast("string") for c in cs])
    one = w.select(F.col("a").alias("f"), F.col("b").alias("t"), F.col("w").alias("score"), name("a", "b").alias("path"))
    y = w.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("w").alias("w2"))
    two = w.join(y, "b").where("a <> c").select(F.col("a").alias("f"), F.col("c").alias("t"), F.sqrt(F.col("w") * F.col("w2")).alias("score"), name("a", "b", "c").alias("path"))
    p = one.union(two).where("f < 3 AND t BETWEEN 3 AND 5")
    return p.withColumn("i", F.row_number().over(Window.partitionBy("f", "t").orderBy(F.desc(F.round("score", 9)), "path"))).where("i <= 10").select("f", "t", "path", F.round("score", 6).alias("score"))


@query("related_relevance", f"""
WITH {_TRADE}, w AS (SELECT a, b, n * 1.0::DOUBLE / max(n) OVER (PARTITION BY a) AS w FROM trade), h AS (SELECT a, b, w AS s FROM w UNION ALL SELECT x.a, y.b, 0.5::DOUBLE * x.w * y.w FROM w x JOIN w y ON x.b = y.a WHERE x.a <> y.b)
SELECT a, b, round(max(s), 6) AS relevance FROM h GROUP BY 1, 2 HAVING max(s) >= 0.1""")
def related_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Relevance of concepts one or two hops away: shares along the path, half for the second hop, 0.1 at least."""
    t = written(trade(spark, d), "trade")
    w = t.join(t.groupBy("a").agg(F.max("n").alias("m")), "a").select("a", "b", (F.col("n") / F.col("m")).alias("w"))
    y = w.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("w").alias("w2"))
    h = w.select("a", "b", F.col("w").alias("s")).union(w.join(y, "b").where("a <> c").select("a", F.col("c").alias("b"), 0.5 * F.col("w") * F.col("w2")))
    return h.groupBy("a", "b").agg(F.max("s").alias("s")).where("s >= 0.1").select("a", "b", F.round("s", 6).alias("relevance"))


@query("related_both_ways", f"""
WITH {_TRADE}, x AS (SELECT least(a, b) AS a, greatest(a, b) AS b, CAST(sum(n) AS BIGINT) AS edges, arg_max(a, n * 100 + a) AS best FROM trade GROUP BY 1, 2 HAVING sum(n) >= 5), k AS (SELECT node, CAST(sum(edges) AS BIGINT) AS total FROM (SELECT a AS node, edges FROM x UNION ALL SELECT b, edges FROM x) GROUP BY 1),
s AS (SELECT x.a, x.b, edges, best, 0.85::DOUBLE * edges / (SELECT max(edges) FROM x) + 0.15::DOUBLE * edges / sqrt(p.total * q.total) AS score FROM x JOIN k p ON p.node = x.a JOIN k q ON q.node = x.b)
SELECT a AS src, b AS dst, edges, best, round(score, 6) AS score FROM s UNION ALL SELECT b, a, edges, best, round(score, 6) FROM s""")
def related_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with five edges or more, scored by their number and density, written in both directions with their strongest side."""
    t = trade(spark, d)
    x = t.groupBy(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).agg(F.sum("n").alias("edges"), F.max_by("a", F.col("n") * 100 + F.col("a")).alias("best")).where("edges >= 5")
    x = written(x, "pairs")
    k = x.select(F.col("p").alias("node"), "edges").union(x.select("q", "edges")).groupBy("node").agg(F.sum("edges").alias("total"))
    s = x.join(k.select(F.col("node").alias("p"), F.col("total").alias("tp")), "p").join(k.select(F.col("node").alias("q"), F.col("total").alias("tq")), "q").crossJoin(F.broadcast(x.agg(F.max("edges").alias("most"))))
    score = F.round(0.85 * F.col("edges") / F.col("most") + 0.15 * F.col("edges") / F.sqrt(F.col("tp") * F.col("tq")), 6)
    one = lambda a, b: s.select(F.col(a).alias("src"), F.col(b).alias("dst"), "edges", "best", score.alias("score"))
    return one("p", "q").union(one("q", "p"))


@query("edge_scores", """
WITH v AS (SELECT vec_id, embedding, label, lead(embedding) OVER (ORDER BY vec_id) AS other, lead(label) OVER (ORDER BY vec_id) AS other_label, lead(vec_id) OVER (ORDER BY vec_id) AS other_id FROM embeddings),
s AS (SELECT vec_id, other_id, CASE WHEN label = other_label THEN 1.0 ELSE 0.3 END AS kind, list_cosine_similarity(embedding::DOUBLE[], other::DOUBLE[]) AS cos FROM v WHERE other_id = vec_id + 1)
SELECT vec_id AS a, other_id AS b, round(greatest(0.0, least(1.0, 0.4 * kind + 0.45 * cos + 0.15 * (kind = 1.0)::INT)), 6) AS score, 0.4 * kind + 0.45 * cos + 0.15 * (kind = 1.0)::INT >= 0.35 AND cos >= 0.4 AS kept FROM s""")
def edge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Edges between neighbouring ids: type, cosine and a shared label, 0.4, 0.45 and 0.15; kept from 0.35 and a cosine of 0.4."""
    from textloom.operators.retrieval import cosine

    v = table(spark, d, "embeddings")
    o = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("other"), F.col("label").alias("other_label"))
    s = v.join(o, "vec_id").select(F.col("vec_id").alias("a"), "b", (F.col("label") == F.col("other_label")).alias("same"), cosine(F.col("embedding").cast("array<double>"), F.col("other").cast("array<double>")).alias("cos"))
    score = 0.4 * F.when(F.col("same"), 1.0).otherwise(0.3) + 0.45 * F.col("cos") + 0.15 * F.col("same").cast("int")
    return s.select("a", "b", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("score"), ((score >= 0.35) & (F.col("cos") >= 0.4)).alias("kept"))


@query("incremental_import", """
WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00'), n AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY 1)
SELECT coalesce(o.k, n.k) AS id, CASE WHEN n.k IS NULL THEN 'soft_delete' WHEN o.k IS NULL THEN 'insert' ELSE 'update' END AS action, coalesce(n.n, 0) AS n FROM o FULL JOIN n ON o.k = n.k""")
def incremental_import(spark: SparkSession, d: str) -> DataFrame:
    """What a newer dump does to each entity: those that are not in it any more are marked, not removed."""
    first = F.col("o_orderdate") < F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")
    c = table(spark, d, "orders").where("o_orderdate IS NOT NULL").groupBy(F.col("o_custkey").alias("id")).agg(F.count_if(first).alias("old"), F.count_if(~first).alias("n"))
    return c.select("id", F.when(F.col("n") == 0, "soft_delete").when(F.col("old") == 0, "insert").otherwise("update").alias("action"), "n")


@query("concept_by_name", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'blue') ORDER BY length(p_name), p_name, p_partkey LIMIT 10")
def concept_by_name(spark: SparkSession, d: str) -> DataFrame:
    return by_name(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "blue", 10, "p_partkey")


def by_name(df: DataFrame, column: str, part: str, limit: int, id_: str) -> DataFrame:
    """Rows whose name contains a text, in any case: the shortest names first."""
    return df.where(F.lower(column).contains(part.lower())).orderBy(F.length(column), column, id_).limit(limit)


@query("synonym_expansion", """
WITH n AS (SELECT lower(p_name) AS name, count(*) AS c FROM part GROUP BY 1), w AS (SELECT name, string_split(name, ' ') AS ws, c FROM n), e AS (SELECT a.name, b.name AS term, CASE WHEN a.name = b.name THEN 1.0 ELSE 0.8 END AS weight, b.c FROM w a JOIN w b ON a.ws[1] = b.ws[1]),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY weight DESC, c DESC, term) AS i FROM e) SELECT name, term, weight::DOUBLE AS weight FROM r WHERE i <= 6""")
def synonym_expansion(spark: SparkSession, d: str) -> DataFrame:
    """A name itself (1.0) and five others of its first word (0.8), the most frequent first."""
    n = written(table(spark, d, "part").groupBy(F.lower("p_name").alias("name")).agg(F.count("*").alias("c")).withColumn("head", F.split("name", " ")[0]), "names")
    e = n.select("head", "name").join(n.select("head", F.col("name").alias("term"), "c"), "head").withColumn("weight", F.when(F.col("name") == F.col("term"), 1.0).otherwise(0.8))
    return e.withColumn("i", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("weight"), F.desc("c"), "term"))).where("i <= 6").select("name", "term", "weight")


@query("chunk_filters", """
SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('en', 'de') AND source NOT IN ('src3') AND n_chars BETWEEN 500 AND 5000 AND doc_id IN (SELECT doc_id FROM labels WHERE quality >= 1)""")
def chunk_filters(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of given kinds and sources, within a range of complexity, with a least reward."""
    docs = table(spark, d, "documents").where(F.col("lang").isin("en", "de") & ~F.col("source").isin("src3") & F.col("n_chars").between(500, 5000))
    return docs.join(table(spark, d, "labels").where("quality >= 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang", "source", "n_chars")


@query("validation_flags", """
SELECT source, count(*) AS n, count(*) FILTER (text IS NULL OR trim(text) = '') AS empty_text, count(*) FILTER (n_chars < 0 OR n_chars <> length(text)) AS wrong_size, count(*) FILTER (lang NOT IN ('en', 'de', 'fr', 'es') OR lang IS NULL) AS unknown_lang, count(*) FILTER (doc_id IS NULL OR doc_id < 0) AS bad_id FROM documents GROUP BY 1""")
def validation_flags(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each source that break a rule of the data model."""
    t, n = F.col("text"), F.count_if
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), n(t.isNull() | (F.trim(t) == "")).alias("empty_text"), n((F.col("n_chars") < 0) | (F.col("n_chars") != F.length(t))).alias("wrong_size"), n(~F.col("lang").isin("en", "de", "fr", "es") | F.col("lang").isNull()).alias("unknown_lang"), n(F.col("doc_id").isNull() | (F.col("doc_id") < 0)).alias("bad_id"))


@query("full_facets", """
SELECT 'source' AS facet, source AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'section', CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 5000 THEN 'middle' ELSE 'long' END, count(*) FROM documents GROUP BY 2
UNION ALL SELECT 'id', CAST(doc_id // 100 AS VARCHAR), count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'month', strftime(o_orderdate, '%Y-%m'), count(*) FROM orders GROUP BY 2""")
def full_facets(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all five facets; those of one table in one pass."""
    n = F.col("n_chars")
    docs = table(spark, d, "documents").select("source", "lang", F.when(n < 1000, "short").when(n < 5000, "middle").otherwise("long").alias("section"), F.expr("cast(doc_id div 100 as string)").alias("id"))
    pairs = docs.select(F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), F.col(k).alias("value")) for k in ("source", "lang", "section", "id")])).alias("p"))
    months = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("value")).agg(F.count("*").alias("n"))
    return pairs.groupBy("p.facet", "p.value").agg(F.count("*").alias("n")).unionByName(months.select(F.lit("month").alias("facet"), "value", "n"))


@query("citation_sources", r"""
WITH c AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '\[([A-Za-z0-9 ]+)\]', 1)) AS name FROM conversations UNION ALL SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?i)source: *([a-z0-9]+)', 1)) FROM conversations)
SELECT c.conv_id, c.turn, lower(c.name) AS name, d.source IS NOT NULL AS known FROM c LEFT JOIN (SELECT DISTINCT source FROM documents) d ON lower(d.source) = lower(c.name)""")
def citation_sources(spark: SparkSession, d: str) -> DataFrame:
    """Citations in messages, and whether their name is that of a source, in any case."""
    t = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(1))
    c = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.concat(t(r"\[([A-Za-z0-9 ]+)\]"), t("(?i)source: *([a-z0-9]+)"))).alias("name")).withColumn("name", F.lower("name"))
    s = table(spark, d, "documents").select(F.lower("source").alias("name")).distinct().withColumn("k", F.lit(True))
    return c.join(s, "name", "left").select("conv_id", "turn", "name", F.coalesce("k", F.lit(False)).alias("known"))


@query("before_after_joins", """
WITH y AS (SELECT o_custkey AS k, year(o_orderdate) AS y, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT a.k, a.y, a.n, coalesce(b.n, 0) AS n_before, coalesce(round((a.v - b.v) / greatest(b.v, 1e-6), 6), 0) AS gain FROM y a LEFT JOIN y b ON b.k = a.k AND b.y = a.y - 1""")
def before_after_joins(spark: SparkSession, d: str) -> DataFrame:
    """Each period beside the one before it; 0 where there is none."""
    y = written(table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v")), "periods")
    b = y.select("k", (F.col("y") + 1).alias("y"), F.col("n").alias("n_before"), F.col("v").alias("v_before"))
    return y.join(b, ["k", "y"], "left").select("k", "y", "n", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce(F.round((F.col("v") - F.col("v_before")) / F.greatest("v_before", F.lit(1e-6)), 6), F.lit(0.0)).alias("gain"))
