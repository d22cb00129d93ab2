"""Running sums and ranks within keys of any size: no task has all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from textloom.session import written


def running(df: DataFrame, key: str, order: list[Column | str], **sums: Column) -> DataFrame:
    """``df`` with ``rank`` (from 1) and running sums, each row's own included, per ``key`` in ``order``.

    Rows are range-partitioned by key and order, so a large key fills many parts, and
    written once.  A part's totals (one row a part and key) give what comes before it;
    within a part the sums are taken by windows over its own rows.  ``order`` must not
    tie.  Rows with a null key are one key's.
    """
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = {"rank": F.lit(1).cast("long"), **sums}
    placed = df.withColumns({f"v_{k}__": v for k, v in sums.items()}).repartitionByRange(parts, F.col(key), *cols).withColumn("part__", F.spark_partition_id())
    placed = written(placed, "placed")
    total = placed.groupBy("part__", key).agg(*[F.sum(f"v_{k}__").alias(f"t_{k}__") for k in sums])
    w = Window.partitionBy(key).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    before = total.select(F.col("part__").alias("p__"), F.col(key).alias("k__"), *[zero(F.sum(f"t_{k}__").over(w)).alias(f"b_{k}__") for k in sums])
    own = Window.partitionBy("part__", key).orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({f"s_{k}__": F.sum(f"v_{k}__").over(own) for k in sums})
    out = local.join(before, (F.col("part__") == F.col("p__")) & F.col(key).eqNullSafe(F.col("k__")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"s_{k}__") + F.col(f"b_{k}__")).alias(k) for k in sums])
