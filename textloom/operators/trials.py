"""Sequential tests of two arms: Student's p-values as columns, and alpha that is spent over the looks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from textloom.plans.registry import query
from textloom.session import table

#: Lanczos' coefficients (g = 7, n = 9) of the gamma function.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Steps of the continued fraction: enough for eight decimals at a million degrees of freedom.
STEPS = 400
TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x of a half or more."""
    y = x - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (y + i)
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.ln(t) - t + F.ln(total)


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function for x up to (a + 1) / (a + b + 2), by Lentz' continued fraction."""
    away = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / away(1 + even * s["d"])
        c = away(1 + even / s["c"])
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        e = 1 / away(1 + odd * d)
        f = away(1 + odd / c)
        return state(f, e, s["h"] * d * c * e * f)

    first = 1 / away(1 - (a + b) * x / (a + 1))
    steps = F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda m: m.cast("double"))
    fraction = F.aggregate(steps, state(F.lit(1.0), first, first), step)["h"]
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    return F.when(x <= 0, F.lit(0.0)).otherwise(front * fraction / a)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t with ``df`` (1 or more) degrees of freedom; null where either is."""
    a, b, x = df / 2, F.lit(0.5), df / (df + t * t)
    # the fraction converges on its own side of the mean; the other is its complement
    near = x < (a + 1) / (a + b + 2)
    low = incomplete_beta(F.when(near, x), a, b)
    high = 1 - incomplete_beta(F.when(~near, 1 - x), b, a)
    return F.when(t == 0, F.lit(1.0)).when(near, low).otherwise(high)


def spent(share: Column, alpha: float) -> Column:
    """Alpha that may be spent when a share of the planned events is in (Pocock's spending function of Lan and DeMets)."""
    return alpha * F.ln(1 + (math.e - 1) * F.least(share, F.lit(1.0)))


def sequential_test(rows: DataFrame, look: str, arm: str, value: str, *, planned: int, alpha: float = 0.05) -> DataFrame:
    """One row for each ``look``: events and means of both arms so far, t, degrees of freedom, p, the alpha of the look and what to do.

    ``arm`` is true for the treatment; rows with a null look, arm or value are left out.  The
    t statistic is that of equal variances.  A look spends what the spending function gives
    for its share of ``planned`` events beyond the look before it.  ``decision`` is ``stop`` from the
    first look on whose p is below its alpha, ``end`` when all planned events are in, else
    ``continue``.  Sums of each look and arm are made before the windows, so these see one
    row a look.
    """
    v = F.col(value).cast("double")
    kept = rows.where(F.col(look).isNotNull() & F.col(arm).isNotNull() & v.isNotNull())
    pick = lambda a, c: F.coalesce(F.sum(F.when(F.col(arm) == a, c)), F.lit(0.0))
    sums = kept.groupBy(look).agg(*[pick(a, c).alias(f"{k}{int(a)}") for a in (False, True) for k, c in (("n", F.lit(1.0)), ("s", v), ("q", v * v))])
    so_far = Window.orderBy(look).rowsBetween(Window.unboundedPreceding, 0)
    names = [f"{k}{a}" for a in (0, 1) for k in "nsq"]
    r = sums.withColumns({c: F.sum(c).over(so_far) for c in names})
    r = r.withColumns({f"m{a}": F.col(f"s{a}") / F.nullif(F.col(f"n{a}"), F.lit(0.0)) for a in (0, 1)})
    within = sum((F.col(f"q{a}") - F.col(f"s{a}") * F.col(f"m{a}") for a in (0, 1)), F.lit(0.0))
    df = F.col("n0") + F.col("n1") - 2
    r = r.withColumn("df", F.when((df >= 1) & (F.col("n0") > 0) & (F.col("n1") > 0), df)).withColumn("se", F.sqrt(F.greatest(within, F.lit(0.0)) / F.col("df") * (1 / F.col("n0") + 1 / F.col("n1"))))
    r = r.withColumn("t", F.when(F.col("se") > 0, (F.col("m1") - F.col("m0")) / F.col("se"))).withColumn("p", student_p(F.col("t"), F.col("df")))
    order = Window.orderBy(look)
    share = (F.col("n0") + F.col("n1")) / planned
    r = r.withColumn("share", share).withColumn("total", spent(F.col("share"), alpha)).withColumn("look_alpha", F.col("total") - F.coalesce(F.lag("total").over(order), F.lit(0.0)))
    stopped = F.max(F.coalesce(F.col("p") < F.col("look_alpha"), F.lit(False)).cast("int")).over(so_far) == 1
    r = r.withColumn("decision", F.when(stopped, "stop").when(F.col("share") >= 1, "end").otherwise("continue"))
    return r.select(look, F.col("n0").cast("long").alias("n_control"), F.col("n1").cast("long").alias("n_treated"), F.col("m0").alias("mean_control"), F.col("m1").alias("mean_treated"), "t", F.col("df").cast("long").alias("df"), "p", "look_alpha", "decision")


@query("ab_sequential", """
WITH e AS (SELECT CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) // 3 AS INTEGER) AS look, user_id % 2 = 1 AS treated, value AS v FROM events WHERE event_type <> 'error'),
g AS (SELECT look, sum((NOT treated)::INT) AS n0, sum(treated::INT) AS n1, sum(CASE WHEN NOT treated THEN v ELSE 0 END) AS s0, sum(CASE WHEN treated THEN v ELSE 0 END) AS s1, sum(CASE WHEN NOT treated THEN v * v ELSE 0 END) AS q0, sum(CASE WHEN treated THEN v * v ELSE 0 END) AS q1 FROM e GROUP BY 1),
c AS (SELECT look, sum(n0) OVER w AS n0, sum(n1) OVER w AS n1, sum(s0) OVER w AS s0, sum(s1) OVER w AS s1, sum(q0) OVER w AS q0, sum(q1) OVER w AS q1, (SELECT count(*) FROM e) AS planned FROM g WINDOW w AS (ORDER BY look)),
m AS (SELECT *, s0 / n0 AS m0, s1 / n1 AS m1, (n0 + n1 - 2)::DOUBLE AS df, sqrt((q0 - s0 * s0 / n0 + q1 - s1 * s1 / n1) / (n0 + n1 - 2) * (1.0::DOUBLE / n0 + 1.0::DOUBLE / n1)) AS se FROM c),
t AS (SELECT *, (m1 - m0) / se AS t, 0.05 * ln(1 + (exp(1) - 1) * least(1, (n0 + n1)::DOUBLE / planned)) AS total FROM m),
p AS (SELECT *, total - coalesce(lag(total) OVER (ORDER BY look), 0) AS look_alpha, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * abs(t) / 6000 *
  list_sum(list_transform(range(2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(t * i / 2000, 2) / df, -(df + 1) / 2))) AS p FROM t)
SELECT look, n0::BIGINT AS n_control, n1::BIGINT AS n_treated, round(t, 6) AS t, round(p, 6) AS p, round(look_alpha, 6) AS look_alpha,
  CASE WHEN max((p < look_alpha)::INT) OVER (ORDER BY look) = 1 THEN 'stop' WHEN n0 + n1 >= planned THEN 'end' ELSE 'continue' END AS decision FROM p""")
def ab_sequential(spark: SparkSession, d: str) -> DataFrame:
    """Values of users with odd and even ids, looked at every third day."""
    e = table(spark, d, "events").where("event_type <> 'error'")
    e = e.select(F.expr("cast(datediff(ts, date'2024-01-01') div 3 as int)").alias("look"), (F.col("user_id") % 2 == 1).alias("treated"), "value")
    r = sequential_test(e, "look", "treated", "value", planned=e.count())
    return r.select("look", "n_control", "n_treated", *[F.round(c, 6).alias(c) for c in ("t", "p", "look_alpha")], "decision")
