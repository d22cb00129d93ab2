"""Relational reports: filters, joins, grouped statistics, paging and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from textloom.functions.running import running
from textloom.plans.registry import query
from textloom.session import table


@query("entry_document_statistics", """
SELECT lang, source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS total_chars, round(avg(n_chars), 4) AS avg_chars, min(n_chars) AS min_chars, max(n_chars) AS max_chars
FROM documents GROUP BY lang, source""")
def entry_document_statistics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang", "source").agg(
        F.count("*").alias("n_docs"), F.sum("n_chars").alias("total_chars"), F.round(F.avg("n_chars"), 4).alias("avg_chars"),
        F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"))


@query("doc_statistics", """
SELECT count(*) AS n_docs, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS total_chars, round(coalesce(avg(n_chars), 0), 4) AS avg_chars, count(DISTINCT source) AS n_sources,
  count(*) FILTER (lang = 'en') AS n_english FROM documents""")
def doc_statistics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("total_chars"), F.round(F.coalesce(F.avg("n_chars"), F.lit(0.0)), 4).alias("avg_chars"),
        F.countDistinct("source").alias("n_sources"), F.count_if(F.col("lang") == "en").alias("n_english"))


def size_bucket(n: Column) -> Column:
    """Size class of a document; bounds are exclusive above."""
    return F.when(n < 1000, "small").when(n < 5000, "medium").when(n < 10000, "large").otherwise("very_large")


@query("doc_size_buckets", """
SELECT CASE WHEN n_chars < 1000 THEN 'small' WHEN n_chars < 5000 THEN 'medium' WHEN n_chars < 10000 THEN 'large' ELSE 'very_large' END AS bucket,
  count(*) AS n_docs FROM documents GROUP BY 1""")
def doc_size_buckets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(size_bucket(F.col("n_chars")).alias("bucket")).agg(F.count("*").alias("n_docs"))


@query("doc_daily_uploads", """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders
WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY GROUP BY 1""")
def doc_daily_uploads(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderdate")
    last = o.agg(F.max("o_orderdate").alias("last"))
    return o.join(F.broadcast(last), F.col("o_orderdate") > F.expr("last - INTERVAL 30 DAYS")).groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("status_filter_counts", """
SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS active, count(*) FILTER (o_orderstatus = 'F') AS completed,
  count(*) FILTER (o_orderstatus = 'P') AS failed, round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS mean_active FROM orders""")
def status_filter_counts(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").agg(
        F.count("*").alias("n"), F.count_if(s == "O").alias("active"), F.count_if(s == "F").alias("completed"), F.count_if(s == "P").alias("failed"),
        F.round(F.avg(F.when(s == "O", F.col("o_totalprice"))), 2).alias("mean_active"))


def metadata_filter(spec: dict) -> Column:
    """A filter from a dict: a scalar is equality, a list is IN, a dict has ``$gte $lte $gt $lt $eq``; keys from ``_`` on are ignored; all must hold."""
    ops = {"$gte": Column.__ge__, "$lte": Column.__le__, "$gt": Column.__gt__, "$lt": Column.__lt__, "$eq": Column.__eq__}
    found: list[Column] = []
    for key, want in spec.items():
        if key.startswith("_"):
            continue
        c = F.col(key)
        if isinstance(want, dict):
            found += [ops[op](c, value) for op, value in want.items()]
        else:
            found.append(c.isin(want) if isinstance(want, (list, tuple)) else c == want)
    return reduce(Column.__and__, found, F.lit(True))


@query("metadata_filter", """
SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('en', 'de') AND n_chars >= 500 AND n_chars < 2000 AND source <> ''""")
def metadata_filter_query(spark: SparkSession, d: str) -> DataFrame:
    spec = {"lang": ["en", "de"], "n_chars": {"$gte": 500, "$lt": 2000}, "_note": "ignored"}
    return table(spark, d, "documents").where(metadata_filter(spec)).where("source <> ''").select("doc_id", "lang", "source", "n_chars")


@query("doc_search_page", """
SELECT doc_id, source, n_chars, total FROM (
  SELECT doc_id, source, n_chars, count(*) OVER () AS total FROM documents WHERE text ILIKE '%license%') ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 5""")
def doc_search_page(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "documents").where(F.col("text").ilike("%license%")).select("doc_id", "source", "n_chars")
    total = hits.agg(F.count("*").alias("total"))
    return hits.orderBy(F.desc("n_chars"), "doc_id").offset(5).limit(20).join(F.broadcast(total))


@query("job_throughput_report", """
SELECT o.o_orderkey, coalesce(nullif(c.c_name, ''), 'Untitled') AS title, o.o_orderstatus, coalesce(l.n_lines, 0) AS n_lines
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey""")
def job_throughput_report(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        "o_orderkey", F.coalesce(F.nullif("c_name", F.lit("")), F.lit("Untitled")).alias("title"), "o_orderstatus", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query("documents_unified_full_join", """
SELECT coalesce(c.c_custkey, s.s_suppkey) AS id, coalesce(s.s_name, c.c_name) AS name, c.c_custkey IS NOT NULL AS in_customer, s.s_suppkey IS NOT NULL AS in_supplier
FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey""")
def documents_unified_full_join(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return c.join(s, c.c_custkey == s.s_suppkey, "full").select(
        F.coalesce("c_custkey", "s_suppkey").alias("id"), F.coalesce("s_name", "c_name").alias("name"), F.col("c_custkey").isNotNull().alias("in_customer"), F.col("s_suppkey").isNotNull().alias("in_supplier"))


@query("orphan_anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def orphan_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("active_semi_join", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def active_semi_join(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "orders").where("o_orderstatus = 'O'")
    return table(spark, d, "customer").join(live, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("content_hash_join", """
SELECT a.doc_id, b.first_id, a.h AS content_hash FROM (SELECT doc_id, sha256(text) AS h FROM documents) a
JOIN (SELECT sha256(text) AS h, min(doc_id) AS first_id FROM documents GROUP BY 1) b ON a.h = b.h AND a.doc_id <> b.first_id""")
def content_hash_join(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    first = h.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"))
    return h.join(first, "content_hash").where("doc_id <> first_id").select("doc_id", "first_id", "content_hash")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], overwrite: bool = True) -> DataFrame:
    """Rows of both by key: a new row replaces the old one (``overwrite``) or yields to it."""
    win, lose = (new, old) if overwrite else (old, new)
    return win.unionByName(lose.join(win.select(*keys), keys, "left_anti"))


@query("chunk_dedup_upsert", """
WITH v AS (SELECT 0 AS version, doc_id, source, text, lang, n_chars FROM documents UNION ALL SELECT 1, doc_id, source, text, lang, n_chars + 1 FROM documents WHERE doc_id % 3 = 0),
r AS (SELECT source, sha256(coalesce(text, '')) AS content_hash, doc_id, lang, n_chars, row_number() OVER (PARTITION BY source, sha256(coalesce(text, '')) ORDER BY version DESC, doc_id NULLS LAST) AS i FROM v) SELECT source, content_hash, doc_id, lang, n_chars FROM r WHERE i = 1""")
def chunk_dedup_upsert(spark: SparkSession, d: str) -> DataFrame:
    """All documents, and newer versions of every third one, as one row for each source and content."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text", "lang", "n_chars")
    return content_upsert(docs, docs.where("doc_id % 3 = 0").withColumn("n_chars", F.col("n_chars") + 1))


def content_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each ``source`` and hash of ``text``: of the new version where it has one, then of the least ``doc_id``.

    Null counts as the empty text.  This is one aggregate, so copies meet on the map
    side first.
    """
    v = old.withColumn("age", F.lit(1)).unionByName(new.withColumn("age", F.lit(0)))
    first = F.min(F.struct("age", F.col("doc_id").isNull().alias("lost"), "doc_id", "lang", "n_chars")).alias("r")
    r = v.groupBy("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash")).agg(first)
    return r.select("source", "content_hash", "r.doc_id", "r.lang", "r.n_chars")


@query("active_user_popular_events", """
SELECT event_type, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 5) GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3""")
def active_user_popular_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    active = e.groupBy("user_id").count().where("count > 5")
    return e.join(active, "user_id", "left_semi").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("quality_gate", """
SELECT d.doc_id, d.lang, round(0.7 * (1 - l.quality) + 0.3 * l.toxic, 6) AS fail_score,
  0.7 * (1 - l.quality) + 0.3 * l.toxic <= CASE d.lang WHEN 'en' THEN 0.15 WHEN 'de' THEN 0.10 WHEN 'fr' THEN 0.25 ELSE 0.20 END AS passed
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    limit = F.when(F.col("lang") == "en", 0.15).when(F.col("lang") == "de", 0.10).when(F.col("lang") == "fr", 0.25).otherwise(0.20)
    score = 0.7 * (1 - F.col("quality")) + 0.3 * F.col("toxic")
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", F.round(score, 6).alias("fail_score"), (score <= limit).alias("passed"))


@query("nulls_last_report", """
SELECT c_custkey, last_order FROM (SELECT c_custkey, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS last_order FROM customer)
ORDER BY last_order DESC NULLS LAST, c_custkey LIMIT 50""")
def nulls_last_report(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"))
    return table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "last_order").orderBy(F.desc_nulls_last("last_order"), "c_custkey").limit(50)


@query("status_mapping", """
SELECT o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 'processing' WHEN 'F' THEN 'completed' WHEN 'P' THEN 'pending' ELSE 'unknown' END AS status, count(*) AS n FROM orders GROUP BY 1, 2""")
def status_mapping(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("O", "processing", "F", "completed", "P", "pending")])
    return table(spark, d, "orders").groupBy("o_orderstatus", F.coalesce(names[F.col("o_orderstatus")], F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


@query("union_metric_rows", """
SELECT 'customers' AS metric, count(*) AS value FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lines', count(*) FROM lineitem
UNION ALL SELECT 'documents', count(*) FROM documents""")
def union_metric_rows(spark: SparkSession, d: str) -> DataFrame:
    names = {"customers": "customer", "orders": "orders", "lines": "lineitem", "documents": "documents"}
    return reduce(DataFrame.unionByName, [table(spark, d, t).agg(F.lit(k).alias("metric"), F.count("*").alias("value")).select("metric", "value") for k, t in names.items()])


def change_set(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Each key with ``added``, ``removed`` or ``unchanged``."""
    a, b = old.select(F.col(key).alias("o")).distinct(), new.select(F.col(key).alias("n")).distinct()
    state = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("unchanged")
    return a.join(b, F.col("o") == F.col("n"), "full").select(F.coalesce("o", "n").alias(key), state.alias("change"))


@query("chunk_change_set", """
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'unchanged' END AS change
FROM (SELECT doc_id FROM documents WHERE n_chars < 2000) a FULL JOIN (SELECT doc_id FROM documents WHERE n_chars > 1000) b ON a.doc_id = b.doc_id""")
def chunk_change_set(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return change_set(docs.where("n_chars < 2000"), docs.where("n_chars > 1000"), "doc_id")


@query("search_log_facets", """
SELECT coalesce(event_type, 'all') AS event_type, coalesce(date_part('hour', ts)::INT, -1) AS hour, count(*) AS n, round(avg(value), 6) AS avg_value, grouping(event_type, date_part('hour', ts)::INT)::BIGINT AS gid
FROM events GROUP BY GROUPING SETS ((event_type), (date_part('hour', ts)::INT), ())""")
def search_log_facets(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("hour", F.hour("ts"))
    return e.groupingSets([["event_type"], ["hour"], []], "event_type", "hour").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"), F.grouping_id("event_type", "hour").alias("gid")).select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("hour", F.lit(-1)).alias("hour"), "n", "avg_value", "gid")


@query("retention_orphans", """
SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars >= 300)) AS orphan_labels,
  (SELECT count(*) FROM documents WHERE n_chars < 300) AS expired, CASE WHEN (SELECT count(*) FROM documents WHERE n_chars < 300) > 1000 THEN 'cleanup_needed' ELSE 'ok' END AS status""")
def retention_orphans(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    orphans = table(spark, d, "labels").join(docs.where("n_chars >= 300"), "doc_id", "left_anti").agg(F.count("*").alias("orphan_labels"))
    expired = docs.where("n_chars < 300").agg(F.count("*").alias("expired"))
    return orphans.join(F.broadcast(expired)).withColumn("status", F.when(F.col("expired") > 1000, "cleanup_needed").otherwise("ok"))


@query("region_revenue_join", """
SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY 1, 2""")
def region_revenue_join(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"), F.count("*").alias("k"))
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name", "n_name")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("r_name", "n_name").agg(F.round(F.sum("rev"), 2).alias("revenue"), F.sum("k").alias("n_lines"))


@query("version_per_domain", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS version, count(*) OVER (PARTITION BY source) + 1 AS next_version FROM documents")
def version_per_domain(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    n = docs.groupBy("source").agg((F.count("*") + 1).alias("next_version"))
    return running(docs, "source", ["doc_id"]).join(n, "source").select("doc_id", "source", F.col("rank").alias("version"), "next_version")
