"""Monitoring: summaries, trends, alerts over time, limits, breakers, queues and audits of the event log."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from textloom.functions.folds import fold
from textloom.operators.timelines import AS_OF
from textloom.plans.registry import query
from textloom.session import table, written

_US = "epoch_us(ts)"


def events(spark: SparkSession, d: str) -> DataFrame:
    """The event log with ``us``, microseconds of its time, and ``day``."""
    return table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))


def r6(c):
    return F.round(c, 6)


@query("metric_summary", """
WITH r AS (SELECT date_trunc('day', ts) AS day, event_type, value, row_number() OVER (PARTITION BY date_trunc('day', ts), event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY date_trunc('day', ts), event_type) AS n FROM events)
SELECT day, event_type, max(n) AS n, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(avg(value), 6) AS mean, round(median(value), 6) AS mid, round(coalesce(stddev_samp(value), 0), 6) AS sd,
  round(max(CASE WHEN i = least(floor(0.95 * n) + 1, n) THEN value END), 6) AS p95, round(max(CASE WHEN i = least(floor(0.99 * n) + 1, n) THEN value END), 6) AS p99 FROM r GROUP BY 1, 2""")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    """Every figure of each metric and day; percentiles by the index rule, over ranks."""
    w = Window.partitionBy("day", "event_type")
    r = events(spark, d).select("day", "event_type", "value", F.row_number().over(w.orderBy("value")).alias("i"), F.count("*").over(w).alias("n"))
    at = lambda p: r6(F.max(F.when(F.col("i") == F.least(F.floor(F.col("n") * p) + 1, F.col("n")), F.col("value"))))
    v = F.col("value")
    return r.groupBy("day", "event_type").agg(F.max("n").alias("n"), r6(F.min(v)).alias("lo"), r6(F.max(v)).alias("hi"), r6(F.avg(v)).alias("mean"), r6(F.median(v)).alias("mid"), r6(F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("sd"), at(0.95).alias("p95"), at(0.99).alias("p99"))


@query("summary_rollup", """
WITH h AS (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, min(value) AS lo, max(value) AS hi, avg(value) AS mean FROM events GROUP BY 1, 2)
SELECT date_trunc('day', hour) AS day, event_type, CAST(sum(n) AS BIGINT) AS n, round(min(lo), 6) AS lo, round(max(hi), 6) AS hi, round(avg(mean), 6) AS mean_of_means FROM h GROUP BY 1, 2""")
def summary_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Days from hours that were summarised before: counts add up, means are averaged as they are."""
    h = events(spark, d).groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"))
    return h.groupBy(F.date_trunc("day", "hour").cast("timestamp_ntz").alias("day"), "event_type").agg(F.sum("n").alias("n"), r6(F.min("lo")).alias("lo"), r6(F.max("hi")).alias("hi"), r6(F.avg("mean")).alias("mean_of_means"))


_SCORE = "(value - 50) / 50"


@query("feedback_summary", f"SELECT event_type, CASE WHEN {_SCORE} > 0.1 THEN 'positive' WHEN {_SCORE} < -0.1 THEN 'negative' ELSE 'neutral' END AS sign, count(*) AS n, round(avg({_SCORE}), 6) AS mean FROM events GROUP BY 1, 2")
def feedback_summary(spark: SparkSession, d: str) -> DataFrame:
    """Feedback from -1 to 1 by type and sign, with a neutral band of 0.1."""
    s = (F.col("value") - 50) / 50
    return events(spark, d).groupBy("event_type", F.when(s > 0.1, "positive").when(s < -0.1, "negative").otherwise("neutral").alias("sign")).agg(F.count("*").alias("n"), r6(F.avg(s)).alias("mean"))


@query("feedback_histogram", f"SELECT CASE WHEN {_SCORE} <= -0.6 THEN 'very_negative' WHEN {_SCORE} <= -0.2 THEN 'negative' WHEN {_SCORE} <= 0.2 THEN 'neutral' WHEN {_SCORE} <= 0.6 THEN 'positive' ELSE 'very_positive' END AS bucket, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def feedback_histogram(spark: SparkSession, d: str) -> DataFrame:
    s = (F.col("value") - 50) / 50
    b = F.when(s <= -0.6, "very_negative").when(s <= -0.2, "negative").when(s <= 0.2, "neutral").when(s <= 0.6, "positive").otherwise("very_positive")
    return events(spark, d).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("query_performance", """
WITH p AS (SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1 HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (ORDER BY mean DESC, user_id) AS best, row_number() OVER (ORDER BY mean, user_id) AS worst FROM p)
SELECT user_id, n, mean, CASE WHEN best <= 10 THEN 'top' ELSE 'bottom' END AS list FROM r WHERE best <= 10 OR worst <= 10""")
def query_performance(spark: SparkSession, d: str) -> DataFrame:
    """The ten best and the ten worst of those with two interactions or more; who is in both is in the top list."""
    p = written(events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean")).where("n >= 2"), "performance")
    top = p.orderBy(F.desc("mean"), "user_id").limit(10).withColumn("list", F.lit("top"))
    bottom = p.orderBy("mean", "user_id").limit(10).join(top.select("user_id"), "user_id", "left_anti").select("user_id", "n", "mean").withColumn("list", F.lit("bottom"))
    return top.union(bottom)


@query("search_metrics", """
WITH h AS (SELECT hour(ts) AS hour, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT count(*) FILTER (event_type = 'view') AS queries, count(DISTINCT user_id) AS users, round(count(*) FILTER (event_type = 'click') * 1.0 / nullif(count(*) FILTER (event_type = 'view'), 0), 6) AS ctr,
  round(count(*) FILTER (event_type <> 'error') * 1.0 / count(*), 6) AS success_rate, round(avg(value) FILTER (event_type = 'purchase'), 6) AS avg_rating,
  (SELECT array_to_string(list(hour ORDER BY n DESC, hour), ',') FROM (SELECT * FROM h ORDER BY n DESC, hour LIMIT 3)) AS peak_hours FROM events""")
def search_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    k = lambda t: F.count_if(F.col("event_type") == t)
    one = e.agg(k("view").alias("queries"), F.countDistinct("user_id").alias("users"), r6(k("click") / F.nullif(k("view"), F.lit(0))).alias("ctr"), r6(F.count_if(F.col("event_type") != "error") / F.count("*")).alias("success_rate"), r6(F.avg(F.when(F.col("event_type") == "purchase", F.col("value")))).alias("avg_rating"))
    h = e.where("event_type = 'view'").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hour").limit(3)
    peak = h.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "hour"))), lambda x: x["hour"].cast("string")), ",").alias("peak_hours"))
    return one.crossJoin(F.broadcast(peak))  # one row each


@query("source_samples", """
SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, array_to_string(list(doc_id ORDER BY n_chars DESC, doc_id)[:5], ',') AS sample FROM documents GROUP BY 1, 2""")
def source_samples(spark: SparkSession, d: str) -> DataFrame:
    """Counts by source and language, with the five longest documents of each: the sample is ranked, no group is gathered."""
    docs = table(spark, d, "documents").select("source", "lang", "doc_id", "n_chars")
    n = docs.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    five = docs.withColumn("i", F.row_number().over(Window.partitionBy("source", "lang").orderBy(F.desc("n_chars"), "doc_id"))).where("i <= 5")
    s = five.groupBy("source", "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("sample"))
    return n.join(s, ["source", "lang"])


@query("hourly_success", """
SELECT date_trunc('hour', ts) AS hour, count(*) AS n, count(*) FILTER (event_type <> 'error') AS ok, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean_ok, round(quantile_cont(value, 0.95) FILTER (event_type <> 'error'), 6) AS p95_ok,
  round(count(*) FILTER (event_type = 'click') * 1.0 / count(*), 6) AS click_rate FROM events GROUP BY 1""")
def hourly_success(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("event_type") != "error"
    return events(spark, d).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"), r6(F.avg(F.when(ok, F.col("value")))).alias("mean_ok"), r6(F.percentile(F.when(ok, F.col("value")), 0.95)).alias("p95_ok"), r6(F.count_if(F.col("event_type") == "click") / F.count("*")).alias("click_rate"))


@query("recent_performance", f"""
WITH w AS (SELECT *, CAST(floor((epoch(TIMESTAMP '{AS_OF}') - epoch(ts)) / 86400) AS BIGINT) AS age FROM events WHERE ts < TIMESTAMP '{AS_OF}')
SELECT age, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS mean, count(DISTINCT date_trunc('minute', ts)) AS busy_minutes, round(count(*) / 1440.0, 6) AS per_minute FROM w WHERE age < 7 GROUP BY 1""")
def recent_performance(spark: SparkSession, d: str) -> DataFrame:
    """The last seven days before the fixed now, day by day."""
    age = F.floor((F.unix_timestamp(F.lit(AS_OF)) - F.col("us") / 1_000_000) / 86400)
    w = events(spark, d).where(F.col("ts") < F.lit(AS_OF).cast("timestamp_ntz")).withColumn("age", age).where("age < 7")
    return w.groupBy("age").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), r6(F.avg("value")).alias("mean"), F.countDistinct(F.date_trunc("minute", "ts")).alias("busy_minutes"), r6(F.count("*") / 1440.0).alias("per_minute"))


@query("bottlenecks", """
WITH t AS (SELECT event_type, count(*) AS n, sum(value) AS total, avg(value) AS mean FROM events GROUP BY 1), a AS (SELECT sum(total) AS total, sum(total) / sum(n) AS mean FROM t)
SELECT event_type, round(t.total / a.total, 6) AS share, round(t.mean, 6) AS mean, t.mean > 1.5 * a.mean AS slow, t.mean > 2 * (SELECT min(o.mean) FROM t o WHERE o.event_type <> t.event_type) AS worse_than_best FROM t, a""")
def bottlenecks(spark: SparkSession, d: str) -> DataFrame:
    """Share of the whole time, means over 1.5 of the overall one, and over twice the best other's."""
    t = events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    # one row a type: the best of the others is the least mean, or the second least for the best itself
    w = Window.orderBy("mean", "event_type")
    t = t.withColumn("i", F.row_number().over(w)).withColumn("lead", F.lead("mean").over(w))
    a = t.agg(F.sum("total").alias("all"), (F.sum("total") / F.sum("n")).alias("overall"), F.min("mean").alias("best"))
    return t.crossJoin(F.broadcast(a)).select("event_type", r6(F.col("total") / F.col("all")).alias("share"), r6("mean").alias("mean"), (F.col("mean") > 1.5 * F.col("overall")).alias("slow"), (F.col("mean") > 2 * F.when(F.col("i") == 1, F.col("lead")).otherwise(F.col("best"))).alias("worse_than_best"))


@query("log_aggregations", """
SELECT CASE WHEN GROUPING(event_type) = 0 THEN 'type' WHEN GROUPING(user_id) = 0 THEN 'user' WHEN GROUPING(hour) = 0 THEN 'hour' ELSE 'all' END AS facet, coalesce(event_type, CAST(user_id AS VARCHAR), CAST(hour AS VARCHAR), '') AS value, count(*) AS n,
  round(avg(v), 6) AS mean, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(count(*) FILTER (bad) * 1.0 / count(*), 6) AS error_rate
FROM (SELECT event_type, user_id, hour(ts) AS hour, value AS v, event_type = 'error' AS bad FROM events) GROUP BY GROUPING SETS ((event_type), (user_id), (hour), ())""")
def log_aggregations(spark: SparkSession, d: str) -> DataFrame:
    """Facets of the log in one pass: each row counts once for every facet, combined before the shuffle."""
    e = events(spark, d).select("event_type", "user_id", F.hour("ts").alias("hour"), F.col("value").alias("v"), (F.col("event_type") == "error").alias("bad"))
    facets = F.array(*[F.struct(F.lit(k).alias("facet"), c.cast("string").alias("value")) for k, c in (("type", F.col("event_type")), ("user", F.col("user_id")), ("hour", F.col("hour")), ("all", F.lit("")))])
    return e.withColumn("f", F.explode(facets)).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"), r6(F.avg("v")).alias("mean"), r6(F.min("v")).alias("lo"), r6(F.max("v")).alias("hi"), r6(F.count_if("bad") / F.count("*")).alias("error_rate"))


@query("session_analytics", f"""
WITH g AS (SELECT *, coalesce({_US} - epoch_us(lag(ts) OVER w) > 1800000000, false)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g),
x AS (SELECT user_id, session, min({_US}) AS a, max({_US}) AS b, count(*) AS n FROM s GROUP BY 1, 2), m AS (SELECT max({_US}) AS now FROM events)
SELECT user_id, count(*) AS sessions, round(avg((b - a) / 1000000.0), 4) AS mean_seconds, max(n) AS longest, count(*) FILTER (now - b <= 1800000000) AS active FROM x, m GROUP BY 1""")
def session_analytics(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user: how long, how many events, and which are active at the last event of the log."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(spark, d)
    s = e.withColumn("session", F.sum(F.coalesce(F.col("us") - F.lag("us").over(w) > 1_800_000_000, F.lit(False)).cast("int")).over(w))
    x = s.groupBy("user_id", "session").agg(F.min("us").alias("a"), F.max("us").alias("b"), F.count("*").alias("n"))
    now = e.agg(F.max("us").alias("now"))
    return x.crossJoin(F.broadcast(now)).groupBy("user_id").agg(F.count("*").alias("sessions"), F.round(F.avg((F.col("b") - F.col("a")) / 1_000_000), 4).alias("mean_seconds"), F.max("n").alias("longest"), F.count_if(F.col("now") - F.col("b") <= 1_800_000_000).alias("active"))


@query("ux_outcomes", """
WITH u AS (SELECT user_id, list(DISTINCT event_type) AS kinds, count(*) FILTER (event_type = 'purchase') > 0 AS done, count(*) FILTER (event_type = 'error') AS errors, avg(value) AS wait FROM events GROUP BY 1)
SELECT CASE WHEN done THEN 'success' WHEN errors > 0 THEN 'failed' ELSE 'abandoned' END AS outcome, count(*) AS users, round(avg(wait), 6) AS mean_wait, round(median(wait), 6) AS median_wait, round(quantile_cont(wait, 0.95), 6) AS p95_wait,
  CAST(sum(len(list_filter(['view', 'click', 'purchase', 'signup'], lambda k: NOT list_contains(kinds, k)))) AS BIGINT) AS missing_kinds FROM u GROUP BY 1""")
def ux_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of users, their waits, and how many kinds of action they never used."""
    k = lambda t: F.count_if(F.col("event_type") == t)
    u = events(spark, d).groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"), (k("purchase") > 0).alias("done"), k("error").alias("errors"), F.avg("value").alias("wait"))
    missing = F.size(F.array_except(F.array(*[F.lit(x) for x in ("view", "click", "purchase", "signup")]), "kinds"))
    return u.groupBy(F.when(F.col("done"), "success").when(F.col("errors") > 0, "failed").otherwise("abandoned").alias("outcome")).agg(F.count("*").alias("users"), r6(F.avg("wait")).alias("mean_wait"), r6(F.median("wait")).alias("median_wait"), r6(F.percentile("wait", 0.95)).alias("p95_wait"), F.sum(missing).alias("missing_kinds"))


@query("capability_gaps", """
WITH u AS (SELECT user_id, list(DISTINCT event_type) AS kinds FROM events GROUP BY 1), g AS (SELECT unnest(list_filter(['view', 'click', 'purchase', 'signup', 'error'], lambda k: NOT list_contains(kinds, k))) AS missing FROM u) SELECT missing, count(*) AS users FROM g GROUP BY 1""")
def capability_gaps(spark: SparkSession, d: str) -> DataFrame:
    u = events(spark, d).groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    want = F.array(*[F.lit(x) for x in ("view", "click", "purchase", "signup", "error")])
    return u.select(F.explode(F.array_except(want, "kinds")).alias("missing")).groupBy("missing").agg(F.count("*").alias("users"))


@query("journeys", """
WITH e AS (SELECT *, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT coalesce(before, 'start') AS step_from, event_type AS step_to, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (after IS NULL) AS abandoned, round(avg(value), 6) AS satisfaction FROM e GROUP BY 1, 2""")
def journeys(spark: SparkSession, d: str) -> DataFrame:
    """Steps between kinds of events, and how many journeys end there."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(spark, d).select("user_id", "event_type", "value", F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"))
    return e.groupBy(F.coalesce("before", F.lit("start")).alias("step_from"), F.col("event_type").alias("step_to")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("after").isNull()).alias("abandoned"), r6(F.avg("value")).alias("satisfaction"))


@query("busy_latency", """
WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1), m AS (SELECT avg(n) AS m FROM h)
SELECT event_type, round(avg(value) FILTER (n > m), 6) AS busy, round(avg(value) FILTER (n <= m), 6) AS idle, round(avg(value) FILTER (n > m) / avg(value) FILTER (n <= m), 6) AS ratio FROM events JOIN h ON date_trunc('hour', ts) = hour, m GROUP BY 1""")
def busy_latency(spark: SparkSession, d: str) -> DataFrame:
    """Means in hours busier than the average, and in the others."""
    e = events(spark, d).withColumn("hour", F.date_trunc("hour", "ts"))
    h = e.groupBy("hour").agg(F.count("*").alias("n"))
    h = h.crossJoin(F.broadcast(h.agg(F.avg("n").alias("m")))).select("hour", (F.col("n") > F.col("m")).alias("busy"))
    busy, idle = F.avg(F.when(F.col("busy"), F.col("value"))), F.avg(F.when(~F.col("busy"), F.col("value")))
    return e.join(h, "hour").groupBy("event_type").agg(r6(busy).alias("busy"), r6(idle).alias("idle"), r6(busy / idle).alias("ratio"))


def log_filter(df: DataFrame, **spec) -> DataFrame:
    """Rows of the log that meet every filter that is given: types, users, since, until, least, most, key, key_in, text, wildcard, not_types, hours, limit."""
    t = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("long")
    tests = {
        "types": lambda v: t.isin(*v), "not_types": lambda v: ~t.isin(*v), "users": lambda v: F.col("user_id").isin(*v), "since": lambda v: F.col("ts") >= F.lit(v).cast("timestamp_ntz"), "until": lambda v: F.col("ts") < F.lit(v).cast("timestamp_ntz"),
        "least": lambda v: F.col("value") >= v, "most": lambda v: F.col("value") <= v, "key": lambda v: k == v, "key_in": lambda v: k.isin(*v), "text": lambda v: F.lower("props").contains(v.lower()), "wildcard": lambda v: matches(t, v), "hours": lambda v: F.hour("ts").between(*v),
    }
    unknown = set(spec) - set(tests) - {"limit"}
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    out = reduce(lambda x, c: x.where(c), [tests[n](v) for n, v in spec.items() if n in tests and v is not None], df)
    return out.orderBy(F.desc("ts"), "event_id").limit(spec["limit"]) if spec.get("limit") else out


def matches(c, pattern: str):
    """Whether a column fits a pattern, where ``*`` stands for any run of characters."""
    return c.rlike("^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$")


@query("log_search", """
SELECT event_id, ts, event_type FROM events WHERE event_type IN ('view', 'error', 'click') AND event_type <> 'view' AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-25 00:00:00' AND value BETWEEN 10 AND 90
AND CAST(json_extract_string(props, '$.k') AS BIGINT) IN (1, 2, 3, 4, 5) AND hour(ts) BETWEEN 6 AND 20 AND event_type LIKE '%r%r' ORDER BY ts DESC, event_id LIMIT 50""")
def log_search(spark: SparkSession, d: str) -> DataFrame:
    return log_filter(events(spark, d), types=["view", "error", "click"], not_types=["view"], since="2024-01-05 00:00:00", until="2024-01-25 00:00:00", least=10, most=90, key_in=[1, 2, 3, 4, 5], hours=(6, 20), wildcard="*r*r", limit=50).select("event_id", "ts", "event_type")


@query("smoothed_progress", f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), s AS (SELECT event_id, user_id, i, value AS s FROM e WHERE i = 1 UNION ALL
  SELECT e.event_id, e.user_id, e.i, 0.3::DOUBLE * e.value + 0.7::DOUBLE * s.s FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1) SELECT event_id, user_id, round(s, 6) AS smoothed FROM s""")
def smoothed_progress(spark: SparkSession, d: str) -> DataFrame:
    """Exponentially smoothed values of each user, 0.3 of the new and 0.7 of what was."""

    def start():
        state = []

        def step(v):
            state[:] = [v if not state else 0.3 * v + 0.7 * state[0]]
            return (state[0],)

        return step

    return fold(events(spark, d), "user_id", ["us", "event_id"], ["value"], start, "smoothed double").select("event_id", "user_id", r6("smoothed").alias("smoothed"))


#: Tokens of a bucket, tokens a day, failures that open a breaker, and seconds until it tries again.
BUCKET, A_DAY, FAILURES, WAIT = 2.0, 1.0, 2, 2 * 86_400


@query("token_bucket", f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, {_US} AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT event_id, user_id, us, i, {BUCKET - 1}::DOUBLE AS tokens, true AS allowed FROM e WHERE i = 1 UNION ALL
  SELECT e.event_id, e.user_id, e.us, e.i, r.have - CASE WHEN r.have >= 1 THEN 1 ELSE 0 END, r.have >= 1 FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1, LATERAL (SELECT least({BUCKET}::DOUBLE, s.tokens + (e.us - s.us) / 1000000 / 86400.0::DOUBLE * {A_DAY}::DOUBLE) AS have) r)
SELECT event_id, user_id, allowed FROM s""")
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Calls that a bucket of two tokens lets pass, which refills by one a day; a rejected call takes none."""

    def start():
        have, at = BUCKET, None

        def step(us):
            nonlocal have, at
            if at is not None:
                have = min(BUCKET, have + (us - at) / 1_000_000 / 86_400 * A_DAY)
            at = us
            passed = have >= 1
            have -= passed
            return (bool(passed),)

        return step

    return fold(events(spark, d), "user_id", ["us", "event_id"], ["us"], start, "allowed boolean").select("event_id", "user_id", "allowed")


@query("circuit_breaker", f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, {_US} AS us, event_type IN ('error', 'signup') AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT event_id, user_id, i, CASE WHEN bad THEN 1 ELSE 0 END AS failures, CASE WHEN bad AND {FAILURES} <= 1 THEN us END AS opened, 'closed' AS state FROM e WHERE i = 1 UNION ALL
  SELECT e.event_id, e.user_id, e.i,
    CASE WHEN s.opened IS NOT NULL AND e.us - s.opened < {WAIT}000000 THEN s.failures WHEN e.bad THEN s.failures + 1 ELSE 0 END,
    CASE WHEN s.opened IS NOT NULL AND e.us - s.opened < {WAIT}000000 THEN s.opened WHEN e.bad AND (s.opened IS NOT NULL OR s.failures + 1 >= {FAILURES}) THEN e.us END,
    CASE WHEN s.opened IS NULL THEN 'closed' WHEN e.us - s.opened < {WAIT}000000 THEN 'open' ELSE 'half_open' END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT event_id, user_id, state FROM s""")
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    """State of each user's breaker at every call: two failures in a row open it, after two days one call may try, and a failure opens it again."""

    def start():
        failures, opened = 0, None

        def step(us, bad):
            nonlocal failures, opened
            state = "closed" if opened is None else "open" if us - opened < WAIT * 1_000_000 else "half_open"
            if state != "open":
                failures = failures + 1 if bad else 0
                opened = us if bad and (state == "half_open" or failures >= FAILURES) else None
            return (state,)

        return step

    e = events(spark, d).withColumn("bad", F.col("event_type").isin("error", "signup"))
    return fold(e, "user_id", ["us", "event_id"], ["us", "bad"], start, "state string").select("event_id", "user_id", "state")


@query("alert_escalation", f"""
WITH a AS (SELECT event_id, user_id, {_US} AS us, epoch_us(lead(ts) OVER w) AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), e AS (SELECT a.*, (coalesce(next, epoch_us(TIMESTAMP '{AS_OF}')) - us) / 3600000000.0 AS open FROM a JOIN events USING (event_id) WHERE event_type = 'error')
SELECT event_id, user_id, CASE WHEN open >= 72 THEN 3 WHEN open >= 24 THEN 2 WHEN open >= 6 THEN 1 ELSE 0 END AS level, next IS NULL AS unresolved FROM e""")
def alert_escalation(spark: SparkSession, d: str) -> DataFrame:
    """How far an error was escalated until the user's next event (or the fixed now): after 6, 24 and 72 hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    a = events(spark, d).select("event_id", "user_id", "event_type", "us", F.lead("us").over(w).alias("next")).where("event_type = 'error'")
    hours = (F.coalesce("next", F.unix_timestamp(F.lit(AS_OF)) * 1_000_000) - F.col("us")) / 3_600_000_000
    return a.select("event_id", "user_id", F.when(hours >= 72, 3).when(hours >= 24, 2).when(hours >= 6, 1).otherwise(0).alias("level"), F.col("next").isNull().alias("unresolved"))


@query("alert_suppression", f"""
WITH a AS (SELECT event_id, event_type, {_US} AS us, CASE WHEN value > 90 THEN 'critical' WHEN value > 70 THEN 'high' WHEN value > 40 THEN 'medium' ELSE 'low' END AS severity FROM events WHERE event_type IN ('error', 'signup')),
b AS (SELECT *, us // 300000000 AS bucket FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY bucket, event_type ORDER BY severity DESC, us, event_id) AS i, count(*) OVER (PARTITION BY bucket, event_type) AS n FROM b)
SELECT event_id, severity, i = 1 AS root, i > 1 AS suppressed, n FROM r""")
def alert_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of one kind in five minutes: the root has the last severity by name, as the surveyed application compares them; the others are suppressed."""
    v = F.col("value")
    a = events(spark, d).where(F.col("event_type").isin("error", "signup")).select("event_id", "event_type", "us", F.when(v > 90, "critical").when(v > 70, "high").when(v > 40, "medium").otherwise("low").alias("severity"), F.expr("us div 300000000").alias("bucket"))
    w = Window.partitionBy("bucket", "event_type")
    r = a.withColumn("i", F.row_number().over(w.orderBy(F.desc("severity"), "us", "event_id"))).withColumn("n", F.count("*").over(w))
    return r.select("event_id", "severity", (F.col("i") == 1).alias("root"), (F.col("i") > 1).alias("suppressed"), "n")


@query("retention_plan", f"""
SELECT event_type, count(*) AS n, count(*) FILTER (ts < TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY) AS expired, count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY) AS kept, min(ts) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY) AS oldest_kept FROM events GROUP BY 1""")
def retention_plan(spark: SparkSession, d: str) -> DataFrame:
    old = F.col("ts") < F.expr(f"cast('{AS_OF}' as timestamp_ntz) - interval 20 days")
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(old).alias("expired"), F.count_if(~old).alias("kept"), F.min(F.when(~old, F.col("ts"))).alias("oldest_kept"))


@query("improvement_features", """
WITH h AS (SELECT event_type, ts < TIMESTAMP '2024-01-16 00:00:00' AS before, avg(value) AS mean, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2), p AS (SELECT b.event_type, b.mean AS m0, a.mean AS m1, b.n AS n0, a.n AS n1, b.users AS u0, a.users AS u1 FROM h b JOIN h a ON a.event_type = b.event_type AND b.before AND NOT a.before)
SELECT event_type, round((m1 - m0) / greatest(m0, 1e-6), 6) AS value_gain, round((n1 - n0) * 1.0 / greatest(n0, 1), 6) AS count_gain, round((u1 - u0) * 1.0 / greatest(u0, 1), 6) AS user_gain, CASE WHEN (m1 - m0) / greatest(m0, 1e-6) > 0.05 THEN 'keep' WHEN (m1 - m0) / greatest(m0, 1e-6) < -0.05 THEN 'revert' ELSE 'watch' END AS advice FROM p""")
def improvement_features(spark: SparkSession, d: str) -> DataFrame:
    """Relative change of each metric from the first half of the log to the second, and what follows from it."""
    first = F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    half = lambda c, f: f(F.when(c, F.col("value")))
    p = events(spark, d).groupBy("event_type").agg(half(first, F.avg).alias("m0"), half(~first, F.avg).alias("m1"), F.count_if(first).alias("n0"), F.count_if(~first).alias("n1"), F.countDistinct(F.when(first, F.col("user_id"))).alias("u0"), F.countDistinct(F.when(~first, F.col("user_id"))).alias("u1")).where("n0 > 0 AND n1 > 0")
    gain = lambda a, b, e: (F.col(b) - F.col(a)) / F.greatest(F.col(a), F.lit(e))
    g = gain("m0", "m1", 1e-6)
    return p.select("event_type", r6(g).alias("value_gain"), r6(gain("n0", "n1", 1)).alias("count_gain"), r6(gain("u0", "u1", 1)).alias("user_gain"), F.when(g > 0.05, "keep").when(g < -0.05, "revert").otherwise("watch").alias("advice"))


@query("priority_queue", """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS i FROM orders WHERE o_orderstatus <> 'F')
SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS place FROM o WHERE i = 1""")
def priority_queue(spark: SparkSession, d: str) -> DataFrame:
    """Open jobs, one for each owner and priority (the first), in the order in which an owner's are worked off."""
    o = table(spark, d, "orders").where("o_orderstatus <> 'F'")
    o = o.withColumn("i", F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey"))).where("i = 1")
    return o.select("o_orderkey", "o_custkey", "o_orderpriority", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderdate", "o_orderkey")).alias("place"))


@query("audit_report", """
SELECT date_trunc('day', ts) AS day, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'notice' ELSE 'info' END AS level, event_type, count(*) AS n, md5(CAST(min(event_id) AS VARCHAR) || ':' || CAST(max(event_id) AS VARCHAR)) AS seal FROM events GROUP BY 1, 2, 3""")
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "notice").otherwise("info")
    return events(spark, d).groupBy("day", level.alias("level"), "event_type").agg(F.count("*").alias("n"), F.md5(F.concat_ws(":", F.min("event_id").cast("string"), F.max("event_id").cast("string"))).alias("seal"))


@query("user_export", """
SELECT sha256('salt:' || user_id) AS user_hash, count(*) AS n, count(DISTINCT event_type) AS kinds, min(ts) AS first_seen, max(ts) AS last_seen, round(sum(value), 4) AS total FROM events GROUP BY user_id""")
def user_export(spark: SparkSession, d: str) -> DataFrame:
    """What is stored about each user, under a salted digest in place of the id."""
    e = events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.sha2(F.concat(F.lit("salt:"), F.col("user_id").cast("string")), 256).alias("user_hash"), "n", "kinds", "first_seen", "last_seen", "total")


@query("delete_cascade", """
WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)), p AS (SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM l))
SELECT 'customer' AS store, (SELECT count(*) FROM customer) - (SELECT count(*) FROM gone) AS kept, (SELECT count(*) FROM gone) AS deleted UNION ALL SELECT 'orders', (SELECT count(*) FROM o), (SELECT count(*) FROM orders) - (SELECT count(*) FROM o)
UNION ALL SELECT 'lineitem', (SELECT count(*) FROM l), (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM l) UNION ALL SELECT 'part', (SELECT count(*) FROM p), (SELECT count(*) FROM part) - (SELECT count(*) FROM p)""")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Owners go, with what they own, what belongs to that, and what nothing refers to any more."""
    t = lambda n: table(spark, d, n)
    gone = t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    o = t("orders").join(gone, "o_custkey", "left_anti")
    l = t("lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    p = t("part").join(l.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n")
    kept = n(t("customer").where("NOT coalesce(c_acctbal < 0, false)"), "customer").union(n(o, "orders")).union(n(l, "lineitem")).union(n(p, "part"))
    total = reduce(DataFrame.union, [n(t(x), x) for x in ("customer", "orders", "lineitem", "part")])
    return total.withColumnRenamed("n", "total").join(F.broadcast(kept), "store").select("store", F.col("n").alias("kept"), (F.col("total") - F.col("n")).alias("deleted"))


@query("job_completion", """
WITH s AS (SELECT l_orderkey, count(*) AS lines, count(*) FILTER (l_linestatus = 'F') AS done, min(l_shipdate) AS started, max(l_shipdate) FILTER (l_linestatus = 'F') AS last FROM lineitem GROUP BY 1)
SELECT l_orderkey, lines, done, CASE WHEN done = 0 OR done = lines THEN NULL ELSE round((epoch(last) - epoch(started)) / 86400.0 / done * (lines - done), 4) END AS days_left FROM s""")
def job_completion(spark: SparkSession, d: str) -> DataFrame:
    """Days that a job still takes if it goes on as it did; none for jobs that are done or not begun."""
    f = F.col("l_linestatus") == "F"
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count_if(f).alias("done"), F.min("l_shipdate").alias("started"), F.max(F.when(f, F.col("l_shipdate"))).alias("last"))
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000
    left = F.when((F.col("done") > 0) & (F.col("done") < F.col("lines")), F.round((sec("last") - sec("started")) / 86400.0 / F.col("done") * (F.col("lines") - F.col("done")), 4))
    return s.select("l_orderkey", "lines", "done", left.alias("days_left"))


@query("related_turns", """
WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, length(text) AS n FROM conversations)
SELECT conv_id, CAST(i // 5 AS BIGINT) AS chunk, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS turns, array_to_string(list(turn ORDER BY turn), ',') AS ids, CAST(sum(n) AS BIGINT) AS chars FROM c GROUP BY 1, 2""")
def related_turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations in chunks of five turns, with the range and the ids of their messages."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"), F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1").alias("i"))
    return c.groupBy("conv_id", F.expr("cast(i div 5 as bigint)").alias("chunk")).agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda x: x.cast("string")), ",").alias("ids"), F.sum("n").alias("chars"))


#: What the issues of a feedback are about.
ISSUES = {"retrieval": "search|find|result|missing", "quality": "wrong|error|incorrect|bad", "speed": "slow|wait|timeout|long", "clarity": "unclear|confus|understand|explain"}


@query("issue_categories", "WITH i AS (" + " UNION ALL ".join(f"SELECT conv_id, turn, role, '{k}' AS issue FROM conversations WHERE regexp_matches(lower(text), '{p}')" for k, p in ISSUES.items()) + ") SELECT issue, role, count(*) AS turns, count(DISTINCT conv_id) AS conversations FROM i GROUP BY 1, 2")
def issue_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories of issues, each once for a turn."""
    low = F.lower("text")
    i = table(spark, d, "conversations").select("conv_id", "role", F.explode(F.array_compact(F.array(*[F.when(low.rlike(p), k) for k, p in ISSUES.items()]))).alias("issue"))
    return i.groupBy("issue", "role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"))
