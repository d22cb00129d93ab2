"""p-values against tabled values, and tests that stop early."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import trials as T

#: Quantiles of Student's t by degrees of freedom, for a two-sided p of 0.05, 0.01 and 0.001.
TABLED = {1: (12.7062047, 63.6567412, 636.6192488), 2: (4.3026527, 9.9248432, 31.5990546), 5: (2.5705818, 4.0321430, 6.8688266), 10: (2.2281389, 3.1692727, 4.5868939), 30: (2.0422725, 2.7499957, 3.6459586), 120: (1.9799304, 2.6174211, 3.3734544)}


def test_p_values_equal_tables(spark):
    rows = [(t, float(df), p) for df, ts in TABLED.items() for t, p in zip(ts, (0.05, 0.01, 0.001))] + [(1.9599640, 1e6, 0.05), (0.0, 7.0, 1.0), (1e-6, 3.0, 1.0), (1.0, 1.0, 0.5), (-1.0, 1.0, 0.5)]
    got = spark.createDataFrame(rows, "t double, df double, p double").withColumn("got", T.student_p(F.col("t"), F.col("df"))).collect()
    assert all(abs(r.got - r.p) < 1e-6 for r in got), [r for r in got if abs(r.got - r.p) >= 1e-6]
    assert spark.createDataFrame([(None, 1.0)], "t double, df double").select(T.student_p(F.col("t"), F.col("df")).alias("p")).first().p is None


@pytest.mark.parametrize("effect,want", [(0.0, "end"), (1.0, "stop")])
def test_looks_spend_alpha(spark, effect, want):
    rnd = random.Random(11)
    rows = [(i // 50, i % 2 == 1, rnd.gauss(effect * (i % 2), 1)) for i in range(500)] + [(None, True, 99.0), (1, None, 99.0), (1, True, None)]
    df = spark.createDataFrame(rows, "look long, arm boolean, v double")
    got = T.sequential_test(df, "look", "arm", "v", planned=500).orderBy("look").collect()
    assert len(got) == 10 and got[-1].decision == want and got[0].n_control == 25 and abs(sum(r.look_alpha for r in got) - 0.05) < 1e-12
    assert [r.decision for r in got].index(want) == (9 if want == "end" else [r.p < r.look_alpha for r in got].index(True))


def test_one_arm_or_no_spread_decides_nothing(spark):
    one = spark.createDataFrame([(1, True, 1.0), (2, True, 2.0)], "look long, arm boolean, v double")
    flat = spark.createDataFrame([(1, True, 1.0), (1, False, 1.0), (1, False, 1.0)], "look long, arm boolean, v double")
    for df in (one, flat):
        assert all(r.t is None and r.p is None and r.decision == "continue" for r in T.sequential_test(df, "look", "arm", "v", planned=9).collect())
    assert T.sequential_test(one.limit(0), "look", "arm", "v", planned=9).count() == 0
