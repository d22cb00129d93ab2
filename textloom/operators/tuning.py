"""Tuning and profiles: structure of texts, caches, alerts with comparators, tests, patterns of change and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from textloom.functions import rules as R
from textloom.functions import text as T
from textloom.functions.folds import fold
from textloom.operators.answers import _HITS, _TOP, FLOOR, MOST, hits, ranked
from textloom.operators.concepts import _CONCEPTS, concepts
from textloom.operators.gaps import gap_decision
from textloom.operators.monitor import _US, events, r6
from textloom.operators.texts import _KEYS, _WORDS
from textloom.plans.registry import oracle, query
from textloom.session import table, written

#: What may divide a text, with how strongly it does.
DELIMITERS = {"paragraph": r"\n\s*\n", "heading": r"(?m)^#{1,6} ", "numbered": r"(?m)^\s*[0-9]+[.)] ", "bullet": r"(?m)^\s*[-*] ", "rule": r"(?m)^(?:---|\*\*\*)", "sentence": r"[.!?]\s"}


@query("delimiter_counts", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {k}" for k, p in DELIMITERS.items()) + " FROM documents")
def delimiter_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *[F.regexp_count("text", F.lit(p)).cast("long").alias(k) for k, p in DELIMITERS.items()])


@query("section_profile", rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents), h AS (SELECT *, regexp_matches(line, '^(?:#{{1,6}} |[0-9]+[.)] |(?i:chapter|section) )') AS head FROM l),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS section FROM h), n AS (SELECT doc_id, section, sum(len({_WORDS.format('line')})) AS words, max(CASE WHEN contains(line, '|') THEN 1 ELSE 0 END) AS tables FROM s GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN words >= 100 THEN CASE WHEN tables = 1 THEN 'table' ELSE 'prose' END END AS own FROM n)
SELECT doc_id, CAST(section AS BIGINT) AS section, CAST(words AS BIGINT) AS words, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section ROWS UNBOUNDED PRECEDING), 'general') AS kind FROM c""")
def section_profile(spark: SparkSession, d: str) -> DataFrame:
    """Sections from one heading to the next; those of under 100 words take the kind of the last that had more."""
    l = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    head = F.col("line").rlike("^(?:#{1,6} |[0-9]+[.)] |(?i:chapter|section) )").cast("int")
    w = Window.partitionBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    s = l.withColumn("section", F.sum(head).over(w.orderBy("i")))
    n = s.groupBy("doc_id", "section").agg(F.sum(F.size(T.words(F.col("line")))).alias("words"), F.max(F.col("line").contains("|")).alias("tables"))
    own = F.when(F.col("words") >= 100, F.when(F.col("tables"), "table").otherwise("prose"))
    return n.select("doc_id", "section", "words", F.coalesce(F.last(own, ignorenulls=True).over(w.orderBy("section")), F.lit("general")).alias("kind"))


@query("conceptual_density", f"""
WITH {_CONCEPTS}, c AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS entities, count(DISTINCT kind) AS kinds, count(*) AS names FROM concepts GROUP BY 1), w AS (SELECT doc_id, len({_WORDS.format('text')}) AS words FROM documents)
SELECT w.doc_id, round(coalesce(least(1.0, (0.4 * entities * 100.0 / greatest(words, 1) + 0.3 * kinds / entities + 0.3 * names / entities) / 10), 0), 6) AS density FROM w LEFT JOIN c USING (doc_id)""")
def conceptual_density(spark: SparkSession, d: str) -> DataFrame:
    """Concepts a hundred words, and how many kinds and names there are among them, 0.4, 0.3 and 0.3."""
    c = concepts(spark, d).groupBy("doc_id").agg(F.sum("n").alias("entities"), F.countDistinct("kind").alias("kinds"), F.count("*").alias("names"))
    w = table(spark, d, "documents").select("doc_id", F.size(T.words(F.col("text"))).alias("words")).join(c, "doc_id", "left")
    x = (0.4 * F.col("entities") * 100 / F.greatest("words", F.lit(1)) + 0.3 * F.col("kinds") / F.col("entities") + 0.3 * F.col("names") / F.col("entities")) / 10
    return w.select("doc_id", F.round(F.coalesce(F.least(F.lit(1.0), x), F.lit(0.0)), 6).alias("density"))


#: Words of each domain of a conversation.
DOMAINS = {"technology": ("software", "code", "api", "data"), "science": ("research", "study", "experiment"), "business": ("market", "customer", "company"), "health": ("patient", "medical", "health"), "law": ("legal", "contract", "court")}
_TAGS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {R.duck(R.any_of('t', ws))} THEN '{k}' END" for k, ws in DOMAINS.items()) + "], lambda x: x IS NOT NULL)[:3], ',')"


@query("conversation_profile", f"""
WITH c AS (SELECT conv_id, lower(string_agg(text, ' ' ORDER BY turn)) AS t, count(*) AS turns, avg(length(text)) AS mean FROM conversations GROUP BY 1), k AS (SELECT *, {_KEYS.format('t')} AS k FROM c)
SELECT conv_id, {_TAGS} AS tags, round(least(1.0, turns / 20.0) * 0.4 + least(1.0, mean / 500) * 0.3 + CASE WHEN len(k) = 0 THEN 0 ELSE len(list_distinct(k)) * 0.3 / len(k) END, 6) AS complexity FROM k""")
def conversation_profile(spark: SparkSession, d: str) -> DataFrame:
    """Up to three domains of a conversation, and its complexity by turns, length and vocabulary."""
    c = table(spark, d, "conversations")
    tag = c.select("conv_id", *[F.when(F.expr(R.spark(R.any_of("lower(text)", ws))), k).alias(k) for k, ws in DOMAINS.items()], F.length("text").alias("n"))
    t = tag.groupBy("conv_id").agg(*[F.max(k).alias(k) for k in DOMAINS], F.count("*").alias("turns"), F.avg("n").alias("mean"))
    words = T.each_keyword(c, "conv_id").groupBy("conv_id", "word").agg(F.count("*").alias("n")).groupBy("conv_id").agg(F.count("*").alias("kinds"), F.sum("n").alias("all"))
    x = F.least(F.lit(1.0), F.col("turns") / 20) * 0.4 + F.least(F.lit(1.0), F.col("mean") / 500) * 0.3 + F.coalesce(F.col("kinds") * 0.3 / F.col("all"), F.lit(0.0))
    return t.join(words, "conv_id", "left").select("conv_id", F.array_join(F.slice(F.array_compact(F.array(*DOMAINS)), 1, 3), ",").alias("tags"), F.round(x, 6).alias("complexity"))


@query("redaction_summary", "WITH r AS (" + " UNION ALL ".join(f"SELECT doc_id, source, '{n}' AS rule, len(regexp_extract_all(text, '{p}')) AS n FROM documents" for n, p, _ in T.REDACTIONS if n not in T.OFF) + ") SELECT rule, count(*) FILTER (n > 0) AS docs, CAST(sum(n) AS BIGINT) AS places, count(DISTINCT source) FILTER (n > 0) AS sources FROM r GROUP BY 1")
def redaction_summary(spark: SparkSession, d: str) -> DataFrame:
    """What each rule finds in the texts as they are."""
    on = [(n, p) for n, p, _ in T.REDACTIONS if n not in T.OFF]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.regexp_count("text", F.lit(p)).alias("n")) for n, p in on]))
    r = table(spark, d, "documents").select("source", each.alias("r")).select("source", "r.rule", "r.n")
    return r.groupBy("rule").agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("places"), F.countDistinct(F.when(F.col("n") > 0, F.col("source"))).alias("sources"))


@query("bridges_per_source", f"SELECT source, strategy, count(*) AS bridges, count(DISTINCT doc_id) AS docs FROM ({oracle('gap_decision')}) JOIN documents USING (doc_id) GROUP BY 1, 2")
def bridges_per_source(spark: SparkSession, d: str) -> DataFrame:
    g = gap_decision(spark, d).select("doc_id", "strategy").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return g.groupBy("source", "strategy").agg(F.count("*").alias("bridges"), F.countDistinct("doc_id").alias("docs"))


@query("id_and_hash_join", """
WITH stored AS (SELECT doc_id, sha256(CASE WHEN lang = 'fr' THEN upper(text) ELSE text END) AS content_hash FROM documents)
SELECT d.doc_id, d.source, s.content_hash FROM documents d JOIN stored s ON s.doc_id = d.doc_id AND s.content_hash = sha256(d.text)""")
def id_and_hash_join(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose stored digest is still that of their content: joined by id and digest (of French ones another text was stored)."""
    docs = table(spark, d, "documents")
    stored = docs.select("doc_id", F.sha2(F.when(F.col("lang") == "fr", F.upper("text")).otherwise(F.col("text")), 256).alias("content_hash"))
    now = docs.select("doc_id", "source", F.sha2("text", 256).alias("content_hash"))
    return now.join(stored, ["doc_id", "content_hash"]).select("doc_id", "source", "content_hash")


@query("query_log_report", """
SELECT event_type, count(*) AS n, round(100.0 * count(*) FILTER (value > 90) / count(*), 4) AS slow_share, mode(split_part(props, ':', 1)) AS prefix, array_to_string(list_filter([CASE WHEN avg(value) > 45 THEN 'optimise' END, CASE WHEN count(*) FILTER (value > 90) * 20 > count(*) THEN 'index' END, CASE WHEN count(*) > 1000 THEN 'cache' END], lambda x: x IS NOT NULL), ',') AS suggestions FROM events GROUP BY 1""")
def query_log_report(spark: SparkSession, d: str) -> DataFrame:
    """Calls by kind: share of slow ones, the most common beginning of what they carry, and suggestions."""
    slow = F.count_if(F.col("value") > 90)
    tips = F.array_compact(F.array(F.when(F.avg("value") > 45, "optimise"), F.when(slow * 20 > F.count("*"), "index"), F.when(F.count("*") > 1000, "cache")))
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(100.0 * slow / F.count("*"), 4).alias("slow_share"), F.mode(F.split_part("props", F.lit(":"), F.lit(1))).alias("prefix"), F.array_join(tips, ",").alias("suggestions"))


@query("cache_levels", f"""
WITH g AS (SELECT event_type, ({_US} - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id))) / 3600000000.0 AS gap FROM events)
SELECT event_type, count(*) FILTER (gap <= 1) AS l1, count(*) FILTER (gap > 1 AND gap <= 24) AS l2, count(*) FILTER (gap > 24 AND gap <= 168) AS l3, count(*) FILTER (gap IS NULL OR gap > 168) AS missed, round(100.0 * count(*) FILTER (gap <= 168) / nullif(count(*), 0), 2) AS hit_rate FROM g GROUP BY 1""")
def cache_levels(spark: SparkSession, d: str) -> DataFrame:
    """Which of three caches would still hold what a user asks for again: an hour, a day, a week."""
    gap = (F.col("us") - F.lag("us").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))) / 3_600_000_000
    g = events(spark, d).select("event_type", gap.alias("gap"))
    x = F.col("gap")
    return g.groupBy("event_type").agg(F.count_if(x <= 1).alias("l1"), F.count_if((x > 1) & (x <= 24)).alias("l2"), F.count_if((x > 24) & (x <= 168)).alias("l3"), F.count_if(x.isNull() | (x > 168)).alias("missed"), F.round(100.0 * F.count_if(x <= 168) / F.count("*"), 2).alias("hit_rate"))


@query("ab_decision", """
WITH g AS (SELECT avg(value) FILTER (user_id % 2 = 0) AS ma, avg(value) FILTER (user_id % 2 = 1) AS mb, var_samp(value) FILTER (user_id % 2 = 0) AS va, var_samp(value) FILTER (user_id % 2 = 1) AS vb, count(*) FILTER (user_id % 2 = 0) AS na, count(*) FILTER (user_id % 2 = 1) AS nb, event_type FROM events GROUP BY event_type),
s AS (SELECT *, mb - ma AS diff, sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS pooled FROM g), t AS (SELECT *, pooled * sqrt(1.0 / na + 1.0 / nb) AS se FROM s)
SELECT event_type, round(diff, 6) AS diff, round(diff - 1.96 * se, 6) AS low, round(diff + 1.96 * se, 6) AS high, CAST(ceil(2 * pow((1.96 + 0.84) * pooled / 5, 2)) AS BIGINT) AS needed, least(na, nb) >= 30 AND abs(diff) > 1.96 * se AS decided FROM t""")
def ab_decision(spark: SparkSession, d: str) -> DataFrame:
    """Difference of two variants with its interval, rows needed a side to see a difference of 5 with a power of 0.8, and whether the test may stop."""
    a, v = F.col("user_id") % 2 == 0, F.col("value")
    g = events(spark, d).groupBy("event_type").agg(*[f(F.when(side, v)).alias(n) for n, f, side in (("ma", F.avg, a), ("mb", F.avg, ~a), ("va", F.var_samp, a), ("vb", F.var_samp, ~a), ("na", F.count, a), ("nb", F.count, ~a))])
    s = g.withColumn("diff", F.col("mb") - F.col("ma")).withColumn("pooled", F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))).withColumn("se", F.col("pooled") * F.sqrt(1 / F.col("na") + 1 / F.col("nb")))
    return s.select("event_type", r6("diff").alias("diff"), r6(F.col("diff") - 1.96 * F.col("se")).alias("low"), r6(F.col("diff") + 1.96 * F.col("se")).alias("high"), F.ceil(2 * F.pow((1.96 + 0.84) * F.col("pooled") / 5, 2)).alias("needed"), ((F.least("na", "nb") >= 30) & (F.abs("diff") > 1.96 * F.col("se"))).alias("decided"))


@query("change_patterns", """
WITH m AS (SELECT date_trunc('day', ts) AS day, event_type, avg(value) AS v FROM events GROUP BY 1, 2), c AS (SELECT event_type, (v - lag(v) OVER w) / greatest(lag(v) OVER w, 1e-6) AS gain FROM m WINDOW w AS (PARTITION BY event_type ORDER BY day)),
p AS (SELECT event_type, CASE WHEN gain > 0.05 THEN 'rise' WHEN gain < -0.05 THEN 'fall' ELSE 'steady' END AS pattern, gain FROM c WHERE gain IS NOT NULL), g AS (SELECT event_type, pattern, count(*) AS n, round(avg(abs(gain)), 6) AS effect, round(least(1.0, count(*) / 10.0), 6)::DOUBLE AS confidence FROM p GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT *, row_number() OVER (ORDER BY round(confidence * effect, 6) DESC, event_type, pattern) AS place FROM g""")
def change_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of day-to-day change seen twice or more, ranked by confidence and effect."""
    m = events(spark, d).groupBy("day", "event_type").agg(F.avg("value").alias("v"))
    before = F.lag("v").over(Window.partitionBy("event_type").orderBy("day"))
    c = m.select("event_type", ((F.col("v") - before) / F.greatest(before, F.lit(1e-6))).alias("gain")).where("gain IS NOT NULL")
    g = c.groupBy("event_type", F.when(F.col("gain") > 0.05, "rise").when(F.col("gain") < -0.05, "fall").otherwise("steady").alias("pattern")).agg(F.count("*").alias("n"), r6(F.avg(F.abs("gain"))).alias("effect"), r6(F.least(F.lit(1.0), F.count("*") / 10)).alias("confidence")).where("n >= 2")
    # a few rows: kinds of events by patterns
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("confidence") * F.col("effect"), 6)), "event_type", "pattern")).cast("long"))


_RULES = (("slow", "mean > 50", "cache results", 0.3), ("uneven", "sd > 28", "balance load", 0.2), ("errors", "n > 150", "add retries", 0.25), ("few_users", "users < 10", "widen rollout", 0.1))


@query("strategy_rules", "WITH m AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS sd, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1), r AS (" + " UNION ALL ".join(f"SELECT event_type, '{k}' AS rule, '{a}' AS action, {g}::DOUBLE AS gain FROM m WHERE {c}" for k, c, a, g in _RULES) + ") SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY gain DESC) AS place FROM r")
def strategy_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules that a kind of event breaks, with what to do, the greatest expected gain first."""
    m = events(spark, d).groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    rules = F.array_compact(F.array(*[F.when(F.expr(c), F.struct(F.lit(k).alias("rule"), F.lit(a).alias("action"), F.lit(g).alias("gain"))) for k, c, a, g in _RULES]))
    r = m.select("event_type", F.explode(rules).alias("r")).select("event_type", "r.*")
    return r.withColumn("place", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("gain"))).cast("long"))


#: Words of praise and of complaint.
PRAISE = ("good", "great", "excellent", "helpful", "clear", "useful", "perfect", "accurate")
COMPLAINT = ("bad", "poor", "wrong", "confusing", "unclear", "useless", "incorrect", "missing")


@query("feedback_sentiment", "WITH w AS (SELECT conv_id, " + " + ".join(f"contains(lower(text), '{w}')::INT" for w in PRAISE) + " AS p, " + " + ".join(f"contains(lower(text), '{w}')::INT" for w in COMPLAINT) + " AS n, least(5, greatest(1, length(text) // 100 + 1)) AS rating FROM conversations) SELECT conv_id, round(avg(((CASE WHEN p + n = 0 THEN 0 ELSE (p - n) * 1.0 / (p + n) END) + (rating - 3) / 2.0) / 2), 6) AS sentiment FROM w GROUP BY 1")
def feedback_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Mean of what the words say and what the rating (here by length) says."""
    low = F.lower("text")
    n = lambda ws: sum((low.contains(w).cast("int") for w in ws), F.lit(0))
    w = table(spark, d, "conversations").select("conv_id", n(PRAISE).alias("p"), n(COMPLAINT).alias("n"), F.least(F.lit(5), F.greatest(F.lit(1), F.expr("length(text) div 100 + 1"))).alias("rating"))
    words = F.when(F.col("p") + F.col("n") == 0, 0.0).otherwise((F.col("p") - F.col("n")) / F.greatest(F.col("p") + F.col("n"), F.lit(1)))
    return w.groupBy("conv_id").agg(r6(F.avg((words + (F.col("rating") - 3) / 2) / 2)).alias("sentiment"))


@query("retrieval_explanation", f"""
WITH {_HITS}, t AS (SELECT * FROM (SELECT *, {_TOP} AS i FROM hits WHERE score >= {FLOOR}) WHERE i <= {MOST}), s AS (SELECT item_id, source, count(*) AS n, max(score) AS best FROM t GROUP BY 1, 2)
SELECT item_id, CAST(sum(n) AS BIGINT) AS results, 'Found ' || sum(n) || ' results in ' || count(*) || ' sources; best: ' || arg_min(source, (-best, source)) AS explanation FROM s GROUP BY 1""")
def retrieval_explanation(spark: SparkSession, d: str) -> DataFrame:
    """How many results a query has, from how many sources, and the source of the best."""
    t = ranked(hits(spark, d).where(F.col("score") >= FLOOR), F.desc("score"), "doc_id").where(F.col("i") <= MOST)
    s = t.groupBy("item_id", "source").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    g = s.groupBy("item_id").agg(F.sum("n").alias("results"), F.count("*").alias("sources"), F.min_by("source", F.struct(-F.col("best"), "source")).alias("top"))
    return g.select("item_id", "results", F.concat(F.lit("Found "), F.col("results").cast("string"), F.lit(" results in "), F.col("sources").cast("string"), F.lit(" sources; best: "), "top").alias("explanation"))


@query("service_fallback", f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, event_type IN ('error', 'signup') AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT event_id, user_id, i, bad::INT AS fails, (NOT bad)::INT AS oks, false AS fallback FROM e WHERE i = 1 UNION ALL
  SELECT e.event_id, e.user_id, e.i, CASE WHEN e.bad THEN s.fails + 1 ELSE 0 END, CASE WHEN e.bad THEN 0 ELSE s.oks + 1 END, CASE WHEN e.bad AND s.fails + 1 >= 2 THEN true WHEN NOT e.bad AND s.oks + 1 >= 3 THEN false ELSE s.fallback END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT event_id, user_id, fallback FROM s""")
def service_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Whether the fallback serves: two failures in a row switch to it, three successes back."""

    def start():
        fails = oks = 0
        on = False

        def step(bad):
            nonlocal fails, oks, on
            fails, oks = (fails + 1, 0) if bad else (0, oks + 1)
            on = True if bad and fails >= 2 else False if not bad and oks >= 3 else on
            return (on,)

        return step

    e = events(spark, d).withColumn("bad", F.col("event_type").isin("error", "signup"))
    return fold(e, "user_id", ["us", "event_id"], ["bad"], start, "fallback boolean").select("event_id", "user_id", "fallback")


@query("aligned_periods", """
WITH p AS (SELECT 'minute' AS period, date_trunc('minute', ts) AS started, value FROM events UNION ALL SELECT 'hour', date_trunc('hour', ts), value FROM events UNION ALL SELECT 'day', date_trunc('day', ts), value FROM events UNION ALL SELECT 'week', date_trunc('week', ts), value FROM events),
g AS (SELECT period, started, count(*) AS n, round(avg(value), 6) AS mean FROM p GROUP BY 1, 2) SELECT period, count(*) AS periods, max(n) AS most, max(started) AS last_period, round(max(mean), 6) AS best FROM g GROUP BY 1""")
def aligned_periods(spark: SparkSession, d: str) -> DataFrame:
    """Minutes, hours, days and weeks (from Monday) with events."""
    e = events(spark, d)
    p = e.select(F.explode(F.array(*[F.struct(F.lit(k).alias("period"), F.date_trunc(k, "ts").cast("timestamp_ntz").alias("started")) for k in ("minute", "hour", "day", "week")])).alias("p"), "value")
    g = p.groupBy("p.period", "p.started").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))
    return g.groupBy("period").agg(F.count("*").alias("periods"), F.max("n").alias("most"), F.max("started").alias("last_period"), r6(F.max("mean")).alias("best"))


#: Alert rules: name, metric, comparator and threshold; equality has a tolerance of 0.001.
ALERTS = (("high_mean", "m", ">", 55.0), ("low_mean", "m", "<", 45.0), ("busy", "n", ">=", 12.0), ("idle", "n", "<=", 1.0), ("exact", "n", "==", 5.0), ("other", "n", "!=", 6.0))
_HOLDS = lambda m, c, t: f"abs({m} - {t}) < 0.001" if c == "==" else f"abs({m} - {t}) >= 0.001" if c == "!=" else f"{m} {c} {t}"


@query("alert_states", "WITH w AS (SELECT date_trunc('day', ts) AS day, event_type, avg(value) AS m, count(*) AS n FROM events GROUP BY 1, 2), a AS (" + " UNION ALL ".join(f"SELECT event_type, '{k}' AS rule, day, {_HOLDS(m, c, t)} AS fired FROM w" for k, m, c, t in ALERTS) + """),
s AS (SELECT *, coalesce(lag(fired) OVER (PARTITION BY event_type, rule ORDER BY day), false) AS before FROM a) SELECT event_type, rule, count(*) FILTER (fired) AS fired, count(*) FILTER (fired AND NOT before) AS raised, count(*) FILTER (before AND NOT fired) AS resolved FROM s GROUP BY 1, 2""")
def alert_states(spark: SparkSession, d: str) -> DataFrame:
    """Six rules over daily means and counts: how often each held, was raised and was resolved."""
    w = events(spark, d).groupBy("day", "event_type").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    a = w.select("event_type", "day", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.expr(_HOLDS(m, c, t)).alias("fired")) for k, m, c, t in ALERTS])).alias("r")).select("event_type", "day", "r.*")
    s = a.withColumn("before", F.coalesce(F.lag("fired").over(Window.partitionBy("event_type", "rule").orderBy("day")), F.lit(False)))
    return s.groupBy("event_type", "rule").agg(F.count_if("fired").alias("fired"), F.count_if(F.col("fired") & ~F.col("before")).alias("raised"), F.count_if(F.col("before") & ~F.col("fired")).alias("resolved"))


@query("direct_chunks", f"""
WITH {_CONCEPTS}, q AS (SELECT DISTINCT kind, name FROM concepts WHERE doc_id % 50 = 0), h AS (SELECT c.name, c.doc_id, c.confidence, row_number() OVER (PARTITION BY c.kind, c.name ORDER BY c.confidence DESC, c.doc_id) AS i FROM concepts c JOIN q USING (kind, name))
SELECT doc_id, count(*) AS concepts, round(least(1.0, greatest(0.1, max(confidence))) + CASE WHEN count(DISTINCT name) > 1 THEN 0.1 * log2(count(DISTINCT name)) ELSE 0 END, 6) AS score FROM h WHERE i <= 20 GROUP BY 1""")
def direct_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the concepts of the queries (documents whose id is divisible by 50), twenty a concept: best confidence, more for several names."""
    c = written(concepts(spark, d), "concepts")
    q = c.where("doc_id % 50 = 0").select("kind", "name").distinct()
    h = c.join(q, ["kind", "name"]).withColumn("i", F.row_number().over(Window.partitionBy("kind", "name").orderBy(F.desc("confidence"), "doc_id"))).where("i <= 20")
    names = F.countDistinct("name")
    return h.groupBy("doc_id").agg(F.count("*").alias("concepts"), r6(F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.max("confidence"))) + F.when(names > 1, 0.1 * F.log2(names.cast("double"))).otherwise(0.0)).alias("score"))
