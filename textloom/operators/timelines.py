"""Event statistics and windows: percentiles, trends, anomalies, sessions, limits and feedback scores."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from textloom.functions.folds import fold
from textloom.functions.running import running
from textloom.plans.registry import query
from textloom.session import table, written

#: Fixed "now" of the event log: everything that asks for the last hours takes it as a parameter.
AS_OF = "2024-01-31 00:00:00"


def percentile_index(values: Column, p: float) -> Column:
    """The value at place ``int(p * n)`` of the sorted values, the last at most."""
    n = F.size(values)
    return F.element_at(F.array_sort(values), F.least((F.floor(n * p) + 1).cast("int"), n))


@query("latency_percentiles_idx", """
WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, round(max(CASE WHEN i = least(floor(0.95 * n) + 1, n) THEN value END), 6) AS p95, round(max(CASE WHEN i = least(floor(0.99 * n) + 1, n) THEN value END), 6) AS p99,
  round(max(CASE WHEN i = n // 2 + 1 THEN value END), 6) AS upper_median FROM s GROUP BY 1""")
def latency_percentiles_idx(spark: SparkSession, d: str) -> DataFrame:
    # ranks over parts of a type, so no type is one task's
    e = table(spark, d, "events").select("event_type", "value", "event_id")
    n = e.groupBy("event_type").agg(F.count("*").alias("n"))
    s = running(e, "event_type", ["value", "event_id"]).withColumnRenamed("rank", "i").join(n, "event_type")
    at = lambda place: F.round(F.max(F.when(F.col("i") == place, F.col("value"))), 6)
    place = lambda p: F.least(F.floor(F.col("n") * p) + 1, F.col("n"))
    return s.groupBy("event_type").agg(F.max("n").alias("n"), at(place(0.95)).alias("p95"), at(place(0.99)).alias("p99"), at(F.floor(F.col("n") / 2) + 1).alias("upper_median"))


@query("latency_percentiles_lin", """
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def latency_percentiles_lin(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(*[F.round(F.percentile("value", p), 6).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)])


@query("hourly_trends", """
SELECT date_trunc('hour', ts) AS hour, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value, round(coalesce(stddev_samp(value), 0), 6) AS sd_value,
  round(count(*) FILTER (event_type = 'error') * 1.0 / count(*), 6) AS error_rate FROM events GROUP BY 1""")
def hourly_trends(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("sd_value"),
        F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 6).alias("error_rate"))


@query("metric_trend", """
WITH h AS (SELECT date_trunc('day', ts) AS day, avg(value) AS v FROM events GROUP BY 1), i AS (SELECT v, row_number() OVER (ORDER BY day) - 1 AS x FROM h)
SELECT round(regr_slope(v, x), 6) AS slope, round(regr_r2(v, x), 6) AS r2, count(*) AS n, round(least(1, 10 * abs(regr_slope(v, x))), 6) AS strength FROM i""")
def metric_trend(spark: SparkSession, d: str) -> DataFrame:
    daily = table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("v"))
    # one row a day: the ordering window has as many rows as the log has days
    i = daily.select("v", (F.row_number().over(Window.orderBy("day")) - 1).alias("x"))
    slope = F.regr_slope("v", "x")
    return i.agg(F.round(slope, 6).alias("slope"), F.round(F.regr_r2("v", "x"), 6).alias("r2"), F.count("*").alias("n"), F.round(F.least(F.lit(1.0), 10 * F.abs(slope)), 6).alias("strength"))


@query("anomaly_zscore", """
WITH w AS (SELECT event_id, event_type, value, avg(value) OVER p AS m, stddev_samp(value) OVER p AS sd, count(*) OVER p AS n FROM events
  WINDOW p AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, event_type, round(abs(value - m) / sd, 4) AS z FROM w WHERE n >= 20 AND sd > 0 AND abs(value - m) / sd > 2.5""")
def anomaly_zscore(spark: SparkSession, d: str) -> DataFrame:
    # sums about 50, which keeps the squares small; a row's own value is taken off again
    v = F.col("value") - 50
    r = running(table(spark, d, "events").select("event_id", "event_type", "value", "ts"), "event_type", ["ts", "event_id"], s=v, q=v * v)
    n, s, q = F.col("rank") - 1, F.col("s") - v, F.col("q") - v * v
    w = r.select("event_id", "event_type", "value", n.alias("n"), s.alias("s"), q.alias("q")).where("n >= 20").withColumn("m", F.col("s") / F.greatest("n", F.lit(1)) + 50)
    w = w.withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / F.greatest("n", F.lit(1))) / F.greatest(F.col("n") - 1, F.lit(1)))))
    z = F.abs(F.col("value") - F.col("m")) / F.nullif("sd", F.lit(0.0))
    return w.where("n >= 20 AND sd > 0").withColumn("z", z).where("z > 2.5").select("event_id", "event_type", F.round("z", 4).alias("z"))


@query("ab_test", """
WITH g AS (SELECT avg(value) FILTER (user_id % 2 = 0) AS ma, avg(value) FILTER (user_id % 2 = 1) AS mb, var_samp(value) FILTER (user_id % 2 = 0) AS va,
  var_samp(value) FILTER (user_id % 2 = 1) AS vb, count(*) FILTER (user_id % 2 = 0) AS na, count(*) FILTER (user_id % 2 = 1) AS nb FROM events WHERE event_type = 'purchase')
SELECT round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, na, nb, round((mb - ma) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS cohens_d,
  round((mb - ma) / (sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) * sqrt(1.0 / na + 1.0 / nb)), 6) AS t FROM g""")
def ab_test(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("user_id") % 2 == 0
    v = F.col("value")
    g = table(spark, d, "events").where("event_type = 'purchase'").agg(
        *[f(F.when(side, v)).alias(n) for n, f, side in (("ma", F.avg, a), ("mb", F.avg, ~a), ("va", F.var_samp, a), ("vb", F.var_samp, ~a), ("na", F.count, a), ("nb", F.count, ~a))])
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    diff = F.col("mb") - F.col("ma")
    return g.select(F.round("ma", 6).alias("mean_a"), F.round("mb", 6).alias("mean_b"), "na", "nb", F.round(diff / pooled, 6).alias("cohens_d"),
                    F.round(diff / (pooled * F.sqrt(1 / F.col("na") + 1 / F.col("nb"))), 6).alias("t"))


def sessions(events: DataFrame, gap_s: int = 1800) -> DataFrame:
    """Events with a session number per user: a new one after ``gap_s`` seconds without an event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gone = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) > gap_s * 1_000_000
    return events.withColumn("session", F.sum(F.coalesce(gone, F.lit(False)).cast("int")).over(w))


@query("session_windows", """
WITH g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000, false)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM s GROUP BY 1, 2""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "events")).groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def _seconds(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000


@query("retry_window", """
SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 300000000 PRECEDING AND 1 PRECEDING) AS retries FROM events""")
def retry_window(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("us").rangeBetween(-300_000_000, -1)
    return table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).select("event_id", F.count("*").over(w).alias("retries"))


#: Calls that a user has in a window, and in a burst: (calls, seconds).
LIMIT, BURST = (3, 86_400), (2, 3_600)


@query("rate_limit_window", f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT event_id, user_id, us, i, true AS allowed, 'ok' AS reason, [us] AS past FROM e WHERE i = 1 UNION ALL
  SELECT e.event_id, e.user_id, e.us, e.i, r.reason = 'ok', r.reason, CASE WHEN r.reason = 'ok' THEN list_append(r.live, e.us) ELSE r.live END
  FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1,
  LATERAL (SELECT list_filter(f.past, lambda x: x > e.us - {LIMIT[1]}000000) AS live, CASE WHEN len(list_filter(f.past, lambda x: x > e.us - {LIMIT[1]}000000)) >= {LIMIT[0]} THEN 'limit'
    WHEN len(list_filter(f.past, lambda x: x > e.us - {BURST[1]}000000)) >= {BURST[0]} THEN 'burst' ELSE 'ok' END AS reason) r)
SELECT event_id, user_id, allowed, reason FROM f""")
def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    """Each call with its decision: a call passes if fewer passed in the window, and in the burst's; rejected calls don't count."""
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rate_limited(e, "user_id", "us", "event_id", LIMIT, BURST).select("event_id", "user_id", (F.col("reason") == "ok").alias("allowed"), "reason")


def rate_limited(df: DataFrame, key: str, at: str, id_: str, limit: tuple[int, int], burst: tuple[int, int]) -> DataFrame:
    """``df`` with ``reason``: ok, limit or burst.  The state of a key is the times of at most ``limit[0]`` calls that passed.

    A call without a time passes by no rule and counts in no window: its reason is null.
    """

    def start():
        past = deque()

        def step(t):
            while past and past[0] <= t - limit[1] * 1_000_000:
                past.popleft()
            near = sum(x > t - burst[1] * 1_000_000 for x in past)
            reason = "limit" if len(past) >= limit[0] else "burst" if near >= burst[0] else "ok"
            if reason == "ok":
                past.append(t)
            return reason

        return step

    return fold(df, key, [at, id_], [at], start, "reason string")


@query("alert_correlation", """
WITH b AS (SELECT event_id, event_type, value, CAST(floor(epoch(ts) / 300) AS BIGINT) AS bucket FROM events WHERE event_type IN ('error', 'signup'))
SELECT event_id, event_type, bucket, row_number() OVER (PARTITION BY bucket, event_type ORDER BY value DESC, event_id) = 1 AS root, count(*) OVER (PARTITION BY bucket, event_type) AS n FROM b""")
def alert_correlation(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "events").where(F.col("event_type").isin("error", "signup")).withColumn("bucket", F.floor(_seconds() / 300))
    w = Window.partitionBy("bucket", "event_type")
    return b.select("event_id", "event_type", "bucket", (F.row_number().over(w.orderBy(F.desc("value"), "event_id")) == 1).alias("root"), F.count("*").over(w).alias("n"))


@query("failure_islands", """
WITH r AS (SELECT user_id, ts, event_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS island FROM events)
SELECT user_id, min(ts) AS started, count(*) AS n FROM r WHERE bad GROUP BY user_id, island HAVING count(*) >= 2""")
def failure_islands(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("bad", F.col("event_type") == "error")
    rn = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("ts", "event_id"))
    r = e.withColumn("island", rn("user_id") - rn("user_id", "bad"))
    return r.where("bad").groupBy("user_id", "island").agg(F.min("ts").alias("started"), F.count("*").alias("n")).where("n >= 2").select("user_id", "started", "n")


@query("search_ctr", """
SELECT count(*) FILTER (event_type = 'view') AS n_queries, count(*) FILTER (event_type = 'click') AS n_clicks,
  round(count(*) FILTER (event_type = 'click') * 1.0 / nullif(count(*) FILTER (event_type = 'view'), 0), 6) AS ctr, round(avg(value) FILTER (event_type = 'purchase'), 6) AS avg_rating FROM events""")
def search_ctr(spark: SparkSession, d: str) -> DataFrame:
    k = lambda t: F.count_if(F.col("event_type") == t)
    return table(spark, d, "events").agg(k("view").alias("n_queries"), k("click").alias("n_clicks"), F.round(k("click") / F.nullif(k("view"), F.lit(0)), 6).alias("ctr"),
                                         F.round(F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))), 6).alias("avg_rating"))


@query("click_asof_query", """
SELECT c.event_id AS click_id, q.event_id AS query_id FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) q ON c.user_id = q.user_id AND c.ts >= q.ts""")
def click_asof_query(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where(F.col("event_type").isin("view", "click"))
    # queries of the same time come before the click, so they count
    w = Window.partitionBy("user_id").orderBy("ts", F.desc("event_type"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return e.select("event_type", F.col("event_id").alias("click_id"), at.alias("query_id")).where("event_type = 'click' AND query_id IS NOT NULL").drop("event_type")


@query("search_ndcg", """
WITH k AS (SELECT user_id, ts, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS position FROM events WHERE event_type = 'click'),
c AS (SELECT user_id, 1.0::DOUBLE / position AS gain, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY user_id ORDER BY position, event_id) AS j FROM k WHERE position > 0),
s AS (SELECT user_id, sum(gain / log2(i + 1)) / sum(gain / log2(j + 1)) AS ndcg FROM c WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'click' GROUP BY 1 HAVING count(*) > 1) GROUP BY 1)
SELECT count(*) AS sessions, round(avg(ndcg), 6) AS mean_ndcg, round(min(ndcg), 6) AS least FROM s""")
def search_ndcg(spark: SparkSession, d: str) -> DataFrame:
    """Mean NDCG of the sessions with more than one click: a click gains 1 over its position; clicks without one gain nothing."""
    w = Window.partitionBy("user_id")
    k = table(spark, d, "events").where("event_type = 'click'").select("user_id", "ts", "event_id", F.get_json_object("props", "$.k").cast("long").alias("position"), F.count("*").over(w).alias("n"))
    c = k.where("position > 0 AND n > 1").select("user_id", (1 / F.col("position")).alias("gain"), F.row_number().over(w.orderBy("ts", "event_id")).alias("i"), F.row_number().over(w.orderBy("position", "event_id")).alias("j"))
    total = lambda r: F.sum(F.col("gain") / F.log2(F.col(r) + 1))
    s = c.groupBy("user_id").agg((total("i") / total("j")).alias("ndcg"))
    return s.agg(F.count("*").alias("sessions"), F.round(F.avg("ndcg"), 6).alias("mean_ndcg"), F.round(F.min("ndcg"), 6).alias("least"))


@query("reward_signal", """
WITH w AS (SELECT user_id, value, CASE event_type WHEN 'view' THEN 0.1 WHEN 'click' THEN 0.5 WHEN 'purchase' THEN 0.7 ELSE 1.0 END
  * greatest(0.1, 1 - (epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(ts)) / 86400.0 / 30) AS w FROM events)
SELECT user_id, round(sum(w * value) / sum(w), 6) AS reward, count(*) AS n FROM w GROUP BY 1""")
def reward_signal(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    weight = F.when(kind == "view", 0.1).when(kind == "click", 0.5).when(kind == "purchase", 0.7).otherwise(1.0)
    age = (F.unix_timestamp(F.lit(AS_OF)) - _seconds()) / 86400
    w = table(spark, d, "events").withColumn("w", weight * F.greatest(F.lit(0.1), 1 - age / 30))
    return w.groupBy("user_id").agg(F.round(F.sum(F.col("w") * F.col("value")) / F.sum("w"), 6).alias("reward"), F.count("*").alias("n"))


@query("feedback_confidence", """
WITH f AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'error' THEN -1.0 ELSE 0.0 END AS score, greatest(0.1, 1 - floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(ts)) / 86400) / 30) AS w FROM events)
SELECT user_id, round(least(1, greatest(0, 0.5 + 0.2 * sum(score * w) / sum(w))), 6) AS confidence FROM f GROUP BY 1""")
def feedback_confidence(spark: SparkSession, d: str) -> DataFrame:
    score = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "error", -1.0).otherwise(0.0)
    days = F.floor((F.unix_timestamp(F.lit(AS_OF)) - _seconds()) / 86400)
    f = table(spark, d, "events").select("user_id", score.alias("score"), F.greatest(F.lit(0.1), 1 - days / 30).alias("w"))
    mean = F.sum(F.col("score") * F.col("w")) / F.sum("w")
    return f.groupBy("user_id").agg(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + 0.2 * mean)), 6).alias("confidence"))


@query("reward_distribution", """
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(median(value), 6) AS mid FROM events GROUP BY 1""")
def reward_distribution(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), *[F.round(f(v), 6).alias(n) for n, f in (("mean", F.avg), ("sd", F.stddev_pop), ("lo", F.min), ("hi", F.max), ("mid", F.median))])


@query("score_histogram", """
SELECT CASE WHEN v <= 20 THEN '0-20' WHEN v <= 40 THEN '21-40' WHEN v <= 60 THEN '41-60' WHEN v <= 80 THEN '61-80' ELSE '81-100' END AS bucket, count(*) AS n
FROM (SELECT least(100, greatest(0, value)) AS v FROM events) GROUP BY 1""")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    v = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("value")))
    b = F.when(v <= 20, "0-20").when(v <= 40, "21-40").when(v <= 60, "41-60").when(v <= 80, "61-80").otherwise("81-100")
    return table(spark, d, "events").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("bottleneck_types", """
WITH t AS (SELECT event_type, avg(value) AS m, count(*) AS n FROM events GROUP BY 1), o AS (SELECT avg(value) AS m FROM events)
SELECT t.event_type, round(t.m, 6) AS mean_value, n, t.m > 1.5 * o.m AS slow FROM t, o""")
def bottleneck_types(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    overall = e.agg(F.avg("value").alias("all"))
    return e.groupBy("event_type").agg(F.avg("value").alias("m"), F.count("*").alias("n")).join(F.broadcast(overall)).select("event_type", F.round("m", 6).alias("mean_value"), "n", (F.col("m") > 1.5 * F.col("all")).alias("slow"))


@query("json_property_counts", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_property_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("eta_from_history", """
SELECT event_id, round(avg(value) OVER w + 1.28 * coalesce(stddev_samp(value) OVER w, 0), 6) AS eta FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def eta_from_history(spark: SparkSession, d: str) -> DataFrame:
    """Mean and spread of the last twenty values of a type: each row's running sums less those twenty rows before it."""
    v = F.col("value") - 50
    r = written(running(table(spark, d, "events").select("event_id", "event_type", "value", "ts"), "event_type", ["ts", "event_id"], s=v, q=v * v).select("event_id", "event_type", "rank", "s", "q"), "running")
    past = r.select("event_type", (F.col("rank") + 20).alias("rank"), F.col("s").alias("s0"), F.col("q").alias("q0"))
    x = r.join(past, ["event_type", "rank"], "left").select("event_id", F.least("rank", F.lit(20)).alias("n"), (F.col("s") - F.coalesce("s0", F.lit(0.0))).alias("s"), (F.col("q") - F.coalesce("q0", F.lit(0.0))).alias("q"))
    sd = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)))).otherwise(0.0)
    return x.select("event_id", F.round(F.col("s") / F.col("n") + 50 + 1.28 * sd, 6).alias("eta"))


@query("user_behaviour", """
WITH u AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS buys FROM events GROUP BY 1)
SELECT user_id, n, CASE WHEN errors * 2 > n THEN 'frustrated' WHEN buys > 0 AND kinds >= 4 THEN 'power' WHEN kinds >= 3 THEN 'explorer' ELSE 'casual' END AS behaviour FROM u""")
def user_behaviour(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("buys"))
    kind = F.when(F.col("errors") * 2 > F.col("n"), "frustrated").when((F.col("buys") > 0) & (F.col("kinds") >= 4), "power").when(F.col("kinds") >= 3, "explorer").otherwise("casual")
    return u.select("user_id", "n", kind.alias("behaviour"))
