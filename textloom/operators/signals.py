"""Rules and scores: relevance verdicts, facets, boosts, alerts, sentiment and query classification."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.functions.folds import fold
from textloom.plans.registry import query
from textloom.session import table, written


@query("hybrid_facets", """
SELECT 'source' AS facet, source AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY 2
UNION ALL SELECT 'size', CASE WHEN n_chars < 1000 THEN 'small' ELSE 'large' END, count(*) FROM documents GROUP BY 2""")
def hybrid_facets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "lang", F.when(F.col("n_chars") < 1000, "small").otherwise("large").alias("size"))
    # one pass: each row gives one entry a facet, counted before the shuffle
    pairs = docs.select(F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), F.col(k).alias("value")) for k in ("source", "lang", "size")])).alias("p"))
    return pairs.groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


@query("boost_merge", """
WITH a AS (SELECT doc_id AS id, n_chars / 40000.0::DOUBLE AS score FROM documents WHERE lang = 'en'), b AS (SELECT doc_id AS id, least(1.0::DOUBLE, n_chars / 40000.0::DOUBLE * 1.15::DOUBLE) * 0.9::DOUBLE AS score FROM documents WHERE n_chars > 2000)
SELECT id, round(score, 10) AS score, origin FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY origin) AS i FROM (SELECT id, score, 'original' AS origin FROM a UNION ALL SELECT id, score, 'variant' FROM b)) WHERE i = 1""")
def boost_merge(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", (F.col("n_chars") / 40000).alias("score"), "n_chars")
    a = docs.where("lang = 'en'").select("id", "score", F.lit("original").alias("origin"))
    b = docs.where("n_chars > 2000").select("id", (F.least(F.lit(1.0), F.col("score") * 1.15) * 0.9).alias("score"), F.lit("variant").alias("origin"))
    both = a.unionByName(b).groupBy("id").agg(F.min_by(F.struct("score", "origin"), "origin").alias("s"))  # originals win
    return both.select("id", F.round("s.score", 10).alias("score"), "s.origin")


@query("relevance_verdict", """
WITH v AS (SELECT user_id, count(*) AS n, max(value) - min(value) AS spread, var_pop(value) AS variance, avg(value) AS m FROM events GROUP BY 1),
s AS (SELECT *, (n >= 3 AND (spread < 5 OR variance < 1))::INT AS flat, (m < 30)::INT AS low, (n < 3)::INT AS thin FROM v)
SELECT user_id, round(spread, 6) AS spread, round(variance, 6) AS variance, CASE WHEN flat + 2 * low + 2 * thin >= 3 THEN 0.3 WHEN flat + 2 * low + 2 * thin >= 1 THEN 0.8 ELSE 1.0 END AS factor FROM s""")
def relevance_verdict(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), (F.max("value") - F.min("value")).alias("spread"), F.var_pop("value").alias("variance"), F.avg("value").alias("m"))
    flag = lambda c: c.cast("int")
    points = flag((F.col("n") >= 3) & ((F.col("spread") < 5) | (F.col("variance") < 1))) + 2 * flag(F.col("m") < 30) + 2 * flag(F.col("n") < 3)
    return v.select("user_id", F.round("spread", 6).alias("spread"), F.round("variance", 6).alias("variance"), F.when(points >= 3, 0.3).when(points >= 1, 0.8).otherwise(1.0).alias("factor"))


@query("kg_prefilter", """
WITH s AS (SELECT event_id, user_id, value / 100 AS kg, (event_id % 97) / 97.0 AS sem FROM events), r AS (SELECT *, (kg >= 0.7)::INT AS strong, row_number() OVER (PARTITION BY user_id ORDER BY (kg >= 0.7)::INT DESC, CASE WHEN kg >= 0.7 THEN kg ELSE sem END DESC, event_id) AS i FROM s)
SELECT event_id, user_id, i AS place FROM r WHERE i <= 10""")
def kg_prefilter(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").select("event_id", "user_id", (F.col("value") / 100).alias("kg"), ((F.col("event_id") % 97) / 97).alias("sem"))
    strong = (F.col("kg") >= 0.7).cast("int")
    w = Window.partitionBy("user_id").orderBy(F.desc(strong), F.desc(F.when(strong == 1, F.col("kg")).otherwise(F.col("sem"))), "event_id")
    return s.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 10").select("event_id", "user_id", "place")


@query("filter_cascade", """
WITH f AS (SELECT doc_id, contains(lower(text), 'license')::INT + contains(lower(text), 'public')::INT + contains(lower(text), 'version')::INT AS hits FROM documents),
m AS (SELECT CASE WHEN max(hits) = 3 THEN 3 WHEN max(hits) >= 2 THEN 2 ELSE 1 END AS level FROM f) SELECT doc_id, hits, level FROM f, m WHERE hits >= level""")
def filter_cascade(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    f = table(spark, d, "documents").select("doc_id", sum((low.contains(w).cast("int") for w in ("public", "version")), low.contains("license").cast("int")).alias("hits"))
    level = f.agg(F.max("hits").alias("m")).select(F.when(F.col("m") == 3, 3).when(F.col("m") >= 2, 2).otherwise(1).alias("level"))
    return f.join(F.broadcast(level), F.col("hits") >= F.col("level"))


@query("sentiment_issues", """
WITH w AS (SELECT l.doc_id, l.toxic, regexp_split_to_array(lower(d.text), '[^a-z]+') AS w FROM labels l JOIN documents d USING (doc_id)),
s AS (SELECT *, len(list_filter(w, lambda x: x IN ('good', 'great', 'with', 'and'))) AS p, len(list_filter(w, lambda x: x IN ('idiot', 'pathetic', 'worthless', 'clown', 'stupid'))) AS n FROM w)
SELECT toxic, count(*) AS docs, CAST(sum(n) AS BIGINT) AS bad_words, round(avg(CASE WHEN p + n = 0 THEN 0 ELSE (p - n) * 1.0 / (p + n) END), 6) AS sentiment FROM s GROUP BY 1""")
def sentiment_issues(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("toxic", F.split(F.lower("text"), "[^a-z]+").alias("w"))
    n = lambda *ws: F.size(F.filter("w", lambda x: x.isin(*ws)))
    s = w.select("toxic", n("good", "great", "with", "and").alias("p"), n("idiot", "pathetic", "worthless", "clown", "stupid").alias("n"))
    score = F.when(F.col("p") + F.col("n") == 0, 0.0).otherwise((F.col("p") - F.col("n")) / (F.col("p") + F.col("n")))
    return s.groupBy("toxic").agg(F.count("*").alias("docs"), F.sum("n").alias("bad_words"), F.round(F.avg(score), 6).alias("sentiment"))


@query("query_complexity", r"""
WITH q AS (SELECT event_type, 'SELECT * FROM ' || event_type || CASE WHEN event_id % 3 = 0 THEN ' a JOIN b ON (a.x = b.x)' ELSE '' END || CASE WHEN event_id % 2 = 0 THEN ' WHERE (x IN (SELECT 1))' ELSE '' END AS q FROM events)
SELECT event_type, count(*) AS n, round(avg(least(10, 1 + 2 * len(regexp_extract_all(q, '\bJOIN\b')) + 1.5 * len(regexp_extract_all(q, '\(')) + len(regexp_extract_all(q, '\bWHERE\b')))), 6) AS complexity FROM q GROUP BY 1""")
def query_complexity(spark: SparkSession, d: str) -> DataFrame:
    q = F.concat(F.lit("SELECT * FROM "), "event_type", F.when(F.col("event_id") % 3 == 0, " a JOIN b ON (a.x = b.x)").otherwise(""), F.when(F.col("event_id") % 2 == 0, " WHERE (x IN (SELECT 1))").otherwise(""))
    n = lambda p: F.regexp_count("q", F.lit(p))
    score = F.least(F.lit(10.0), 1 + 2 * n(r"\bJOIN\b") + 1.5 * n(r"\(") + n(r"\bWHERE\b"))
    return table(spark, d, "events").select("event_type", q.alias("q")).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("complexity"))


@query("alert_rules", """
WITH w AS (SELECT date_trunc('day', ts) AS day, event_type, avg(value) AS m, count(*) AS n FROM events GROUP BY 1, 2)
SELECT day, event_type, CASE WHEN m > 60 THEN 'critical' WHEN m > 52 THEN 'warning' ELSE 'ok' END AS state, n FROM w""")
def alert_rules(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    return w.select("day", "event_type", F.when(F.col("m") > 60, "critical").when(F.col("m") > 52, "warning").otherwise("ok").alias("state"), "n")


@query("alert_cooldown", """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'error'),
s AS (SELECT user_id, event_id, us, i FROM e WHERE i = 1 UNION ALL
  SELECT n.user_id, n.event_id, n.us, n.i FROM (SELECT e.*, row_number() OVER (PARTITION BY e.user_id ORDER BY e.i) AS k FROM s JOIN e ON e.user_id = s.user_id AND e.i > s.i AND e.us - s.us >= 3600000000) n WHERE n.k = 1)
SELECT event_id, user_id FROM s""")
def alert_cooldown(spark: SparkSession, d: str) -> DataFrame:
    """Errors that raise an alert: no alert of the user in the hour before.  Errors that raised none don't count."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").where("event_type = 'error'").select("event_id", "user_id", us.alias("us"))
    return sent_alerts(e, "user_id", "us", "event_id", 3_600_000_000).select("event_id", "user_id")


def sent_alerts(df: DataFrame, key: str, at: str, id_: str, cooldown: int) -> DataFrame:
    """Rows, in order of ``at`` and ``id_`` per key, that come ``cooldown`` or more after the last such row.

    What was sent last decides, so this is a fold; a null key is a key of its own.  A row
    without a time can't be told to be within a cooldown: it is sent, and starts none.
    """

    def start():
        sent = None

        def step(t):
            nonlocal sent
            if sent is not None and t - sent < cooldown:
                return False
            sent = t
            return True

        return step

    told = fold(df, key, [at, id_], [at], start, "sent__ boolean")
    return told.where(F.coalesce("sent__", F.lit(True))).drop("sent__")


@query("cache_hit_rates", """
SELECT event_type, count(*) FILTER (event_id % 2 = 0) AS l1, count(*) FILTER (event_id % 2 = 1 AND event_id % 3 = 0) AS l2, round(100.0 * count(*) FILTER (event_id % 2 = 0 OR event_id % 3 = 0) / nullif(count(*), 0), 2) AS hit_rate FROM events GROUP BY 1""")
def cache_hit_rates(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(a).alias("l1"), F.count_if(~a & b).alias("l2"), F.round(100.0 * F.count_if(a | b) / F.nullif(F.count("*"), F.lit(0)), 2).alias("hit_rate"))


@query("error_classification", r"""
WITH m AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'connection refused by host' WHEN 1 THEN 'timeout after 30 s' WHEN 2 THEN 'out of memory' ELSE 'unknown failure' END AS m FROM events WHERE event_type = 'error')
SELECT CASE WHEN regexp_matches(m, 'connection|network') THEN 'network' WHEN regexp_matches(m, 'timeout') THEN 'timeout' WHEN regexp_matches(m, 'memory') THEN 'resource' ELSE 'other' END AS kind, md5(m) AS pattern, count(*) AS n FROM m GROUP BY 1, 2""")
def error_classification(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    m = table(spark, d, "events").where("event_type = 'error'").select(F.when(k == 0, "connection refused by host").when(k == 1, "timeout after 30 s").when(k == 2, "out of memory").otherwise("unknown failure").alias("m"))
    kind = F.when(F.col("m").rlike("connection|network"), "network").when(F.col("m").rlike("timeout"), "timeout").when(F.col("m").rlike("memory"), "resource").otherwise("other")
    return m.groupBy(kind.alias("kind"), F.md5("m").alias("pattern")).agg(F.count("*").alias("n"))


@query("lookup_priority", """
WITH want AS (SELECT DISTINCT lower(p_brand) AS name FROM part), pref AS (SELECT lower(p_brand) AS name, min(p_partkey) AS id FROM part WHERE p_size > 45 GROUP BY 1), syn AS (SELECT lower(p_brand) AS name, min(p_partkey) AS id FROM part GROUP BY 1)
SELECT want.name, coalesce(pref.id, syn.id) AS id, CASE WHEN pref.id IS NOT NULL THEN 'preferred' ELSE 'synonym' END AS via FROM want LEFT JOIN pref USING (name) LEFT JOIN syn USING (name)""")
def lookup_priority(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.lower("p_brand").alias("name"), "p_partkey", "p_size")
    first = p.groupBy("name").agg(F.min(F.when(F.col("p_size") > 45, F.col("p_partkey"))).alias("pref"), F.min("p_partkey").alias("syn"))
    return first.select("name", F.coalesce("pref", "syn").alias("id"), F.when(F.col("pref").isNotNull(), "preferred").otherwise("synonym").alias("via"))


@query("fuzzy_pairs", """
WITH n AS (SELECT p_name AS name, count(*) AS c FROM part WHERE p_name IS NOT NULL GROUP BY 1),
s AS (SELECT a.name, b.name AS other, b.c AS n_other, round(1 - levenshtein(a.name, b.name) * 1.0 / greatest(length(a.name), length(b.name)), 6) AS similarity FROM n a, n b
WHERE 5 * levenshtein(a.name, b.name) < greatest(length(a.name), length(b.name)) AND (a.name <> b.name OR a.c > 1)) SELECT p_partkey, name, other, similarity, n_other FROM part JOIN s ON p_name = name""")
def fuzzy_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each part with every name that is like its own, and how many parts bear that: whatever brand, type and size.

    A part's own name is among them if other parts bear it too.  Parts of a name aren't
    paired row by row: joining ``other`` to the parts' names gives those pairs.
    """
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name")).where("name IS NOT NULL")
    n = written(p.groupBy("name").agg(F.count("*").alias("c")), "names")
    near = similar_names(n.select("name"))
    both = near.union(near.select(F.col("other").alias("name"), F.col("name").alias("other"), "similarity"))
    same = n.where("c > 1").where(F.length("name") > 0).select("name", F.col("name").alias("other"), F.lit(1.0).alias("similarity"))
    s = both.union(same).join(n.select(F.col("name").alias("other"), F.col("c").alias("n_other")), "other")
    return p.join(s, "name").select("p_partkey", "name", "other", F.round("similarity", 6).alias("similarity"), "n_other")


def similar_names(names: DataFrame) -> DataFrame:
    """All pairs of distinct names with a similarity over 0.8, each once, the shorter (or lesser) as ``other``.

    Of a longer name of L characters at most ``k = (L - 1) // 5`` edits are allowed, so of
    its k + 1 segments one stands unchanged in the other name, moved by k at most: pairs
    meet in such a segment, and none is lost.
    """
    size = F.length("name")
    most = lambda l: F.floor((l - 1) / 5)
    cuts = names.where(size > 0).select("name", size.cast("int").alias("l"), most(size).cast("int").alias("k"))
    begin = "cast(floor(i * l / (k + 1)) AS int)"
    end = "cast(floor((i + 1) * l / (k + 1)) AS int)"
    long = cuts.withColumn("i", F.explode(F.expr("sequence(0, k)"))).select("name", "l", "i", F.expr(f"substring(name, {begin} + 1, {end} - {begin})").alias("part"))
    # lengths that a longer partner may have: L with L - l <= (L - 1) // 5
    short = names.where(size > 0).select(F.col("name").alias("other"), size.cast("int").alias("s"))
    short = short.withColumn("l", F.explode(F.expr("sequence(s, cast(s + s / 4 + 1 AS int))"))).withColumn("k", most(F.col("l")).cast("int")).where("l - s <= k")
    short = short.withColumn("i", F.explode(F.expr("sequence(0, k)"))).withColumn("from", F.expr(begin)).withColumn("n", F.expr(f"{end} - {begin}"))
    short = short.withColumn("at", F.explode(F.expr("sequence(greatest(0, from - k), least(greatest(s - n, greatest(0, from - k)), from + k))")))
    short = short.select("other", "s", "l", "i", F.expr("substring(other, at + 1, n)").alias("part")).distinct()
    pairs = long.join(short, ["l", "i", "part"]).where("l > s OR name > other").select("name", "other").distinct()
    edits, longer = F.levenshtein("name", "other"), F.greatest(F.length("name"), F.length("other"))
    return pairs.where(5 * edits < longer).select("name", "other", (1 - edits / longer).alias("similarity"))


@query("message_format", """
SELECT conv_id, turn, '[' || lpad(CAST(turn AS VARCHAR), 3, '0') || '] ' || upper(role) || ': ' || text AS line, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM conversations""")
def message_format(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("["), F.lpad(F.col("turn").cast("string"), 3, "0"), F.lit("] "), F.upper("role"), F.lit(": "), "text")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", line.alias("line"), F.sum(F.length("text")).over(w).alias("so_far"))


@query("domain_tags", """
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN contains(lower(text), 'the') THEN 'english' END, CASE WHEN contains(lower(text), 'ß') OR contains(lower(text), 'sch') THEN 'german' END, CASE WHEN length(text) > 200 THEN 'long' END], lambda x: x IS NOT NULL), ',') AS tags FROM conversations""")
def domain_tags(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    tags = F.array_compact(F.array(F.when(low.contains("the"), "english"), F.when(low.contains("ß") | low.contains("sch"), "german"), F.when(F.length("text") > 200, "long")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(tags, ",").alias("tags"))


@query("query_expansion", """
WITH q AS (SELECT item_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+'))) AS w FROM benchmark), s AS (SELECT unnest(['the', 'and', 'of']) AS w, unnest(['this', 'with', 'from']) AS x)
SELECT item_id, array_to_string(list_sort(list(x)), ' ') AS added FROM q JOIN s USING (w) GROUP BY 1""")
def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    syn = spark.createDataFrame([("the", "this"), ("and", "with"), ("of", "from")], "w string, x string")
    q = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("w"))
    return q.join(F.broadcast(syn), "w").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("x")), " ").alias("added"))


@query("ranked_then_filtered", """
SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, source FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50) WHERE source IN ('src0', 'src1', 'src2')""")
def ranked_then_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The filter comes after the cut: fewer than 50 rows are the defined result."""
    return table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(50).where(F.col("source").isin("src0", "src1", "src2")).select("doc_id", "n_chars")


@query("conversation_groups", None)
def conversation_groups(spark: SparkSession, d: str) -> DataFrame:
    """Turns in groups of at most 500 words: a turn that would exceed the budget starts the next group."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.size(T.words(F.col("text"))).alias("n"))
    return budget_groups(c, "conv_id", "turn", "n", 500)


def budget_groups(df: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """``group`` numbers per key: rows in order, a new group where the running size would pass the budget.

    The reset makes this a fold, so each partition's sorted rows stream through one
    small state; nothing of a key is held.  Keys and orders pass through as Arrow
    columns, so a null changes no large number; rows with a null key are one key's.  A
    row without a size counts 0.
    """

    def fold(parts):
        last, total, group = object(), 0, 0
        for part in parts:
            out = []
            for k, n in zip(part[key].to_pylist(), part[size].to_pylist()):
                n = n or 0
                if k != last:
                    last, total, group = k, 0, 0
                elif total + n > budget:
                    total, group = 0, group + 1
                total += n
                out.append(group)
            yield pa.RecordBatch.from_arrays([part[key], part[order], pa.array(out, pa.int64())], [key, order, "group"])

    kinds = dict(df.dtypes)
    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(fold, f"{key} {kinds[key]}, {order} {kinds[order]}, group long")


@query("kmeans_groups", None)
def kmeans_groups(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings in ten groups by k-means of Spark ML."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = table(spark, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    return KMeans(k=10, seed=3, maxIter=20).fit(v).transform(v).select("vec_id", F.col("prediction").alias("cluster"))
