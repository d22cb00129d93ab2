"""A stored table of mergeable rows: batches rewrite their own buckets, once each, and can be resumed.

Below the path, ``data/batch=N/bucket=M`` holds what batch N made of bucket M, and
``manifest/batch=N`` names the buckets that it wrote.  A bucket's rows are those of its last
batch in the manifest, so files without a manifest, which a failed batch leaves behind, count
for nothing and are written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import IntegerType, StructField, StructType

from textloom.session import delete

#: Rows that a bucket is to have.
BUCKET_ROWS = 1_000_000


def buckets_for(rows: DataFrame, each: int = BUCKET_ROWS, least: int = 8) -> int:
    """Buckets for a table of at most ``rows``, so that what a task holds of it doesn't grow with the table."""
    return max(least, -(-rows.count() // each))


class StoredTable:
    """Rows with one or more ``key`` columns in ``buckets`` by their hash."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: list[str], buckets: int = 32):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _manifest(self) -> list:
        """Rows (``batch``, ``bucket``, ``rows``), at most ``buckets`` a batch."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return []
        return self.spark.read.schema("bucket int, rows long, batch int").parquet(f"{self.path}/manifest").collect()

    def batches(self) -> list[int]:
        return sorted({r.batch for r in self._manifest()})

    def current(self) -> dict[int, int]:
        """The batch whose files hold each bucket that has rows."""
        last: dict[int, tuple[int, int]] = {}
        for r in self._manifest():
            if r.bucket >= 0:
                last[r.bucket] = max(last.get(r.bucket, (-1, 0)), (r.batch, r.rows))
        return {b: batch for b, (batch, rows) in last.items() if rows}

    def read(self, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        paths = [f"{self.path}/data/batch={n}/bucket={b}" for b, n in sorted(self.current().items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in self.key]), F.lit(self.buckets)).cast("int"))

    def merge(self, delta: DataFrame, batch: int, combine: Callable[[DataFrame], DataFrame]) -> bool:
        """Make ``combine(stored rows and delta)`` of the buckets that ``delta`` touches; False if the batch was merged before."""
        if batch in self.batches():
            return False
        placed = self.bucketed(delta)
        touched = sorted(r.bucket for r in placed.select("bucket").distinct().collect())  # at most ``buckets``
        both = self.read(touched).unionByName(delta.select(self.schema.names))
        self._commit(batch, touched, combine(both))
        return True

    def remove(self, keys: DataFrame, batch: int) -> bool:
        """Take the rows with these keys out; buckets that have none of them stay as they are."""
        if batch in self.batches():
            return False
        held = self.bucketed(keys.select(*self.key).distinct())
        touched = sorted(r.bucket for r in held.select("bucket").distinct().collect())
        same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in self.key]
        rows = self.read(touched)
        self._commit(batch, touched, rows.join(held, same(rows, held), "left_anti"))
        return True

    def _commit(self, batch: int, touched: list[int], rows: DataFrame) -> None:
        path = f"{self.path}/data/batch={batch}"
        delete(self.spark, path)  # of a run that did not get to its manifest
        placed = self.bucketed(rows.select(self.schema.names))
        # a task for each bucket: a hash of the number would put several in one
        placed.repartitionById(max(touched, default=0) + 1, "bucket").write.partitionBy("bucket").parquet(path)
        whole = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        counts = self.spark.read.schema(whole).parquet(path).groupBy("bucket").agg(F.count("*").alias("rows")).collect() if touched else []
        known = {r.bucket: r.rows for r in counts}
        lines = [(b, known.get(b, 0)) for b in touched] or [(-1, 0)]
        self.spark.createDataFrame(lines, "bucket int, rows long").coalesce(1).write.parquet(f"{self.path}/manifest/batch={batch}")


def latest(key: list[str], order: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Of rows with equal keys the last in ``order``; nulls come before all else."""

    def combine(rows: DataFrame) -> DataFrame:
        best = F.max_by(F.struct(*rows.columns), F.struct(*[F.struct(F.col(c).isNotNull().alias("there"), F.col(c)) for c in order]))
        return rows.groupBy(*key).agg(best.alias("row")).select("row.*")

    return combine


def import_into(stream: DataFrame, stored: StoredTable, checkpoint: str, combine: Callable[[DataFrame], DataFrame]) -> DataStreamWriter:
    """A writer that merges each micro-batch of a stream into a stored table.

    The stream's checkpoint says what a batch reads, the table's manifest whether it was
    merged.  A batch that failed between the two is merged when the stream is started again,
    and one that was merged isn't merged twice.
    """

    def merge(rows: DataFrame, batch: int) -> None:
        stored.merge(rows, batch, combine)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)
