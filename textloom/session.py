"""What every operator needs from the session: tables, a shared scratch folder, shipped code."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch between the JVM and Python; every task holds a few of them, and texts may be long.
BATCH_KEY, BATCH_DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"
_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}
_SCOPES: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as ``--py-files`` would.

    Arrow batches are made smaller where their size is still Spark's default.
    """
    if spark.conf.get(BATCH_KEY) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="textloom")) / "textloom_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, str(Path(here.name) / f.relative_to(here)))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode and where that is unset (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="textloom-shared")
    return _LOCAL[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below this application's part of the shared folder."""
    path = f"{shared_dir(spark)}/textloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def delete(spark: SparkSession, where: str) -> None:
    """Delete a path and all below it, where it exists."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the scratch of what runs inside, at its end; paths that are appended to the list stay."""
    made: list[str] = []
    kept: list[str] = []
    _SCOPES.append(made)
    try:
        yield kept
    finally:
        _SCOPES.pop()
        for path in made:
            if path not in kept:
                delete(spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; call it when its results have been stored."""
    delete(spark, f"{shared_dir(spark)}/textloom/{spark.sparkContext.applicationId}")


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write to the shared folder and read back: this cuts lineage, and any executor may be lost afterwards."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    return spark.read.schema(df.schema).parquet(path)


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores in front until no column has it (Spark compares without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name

