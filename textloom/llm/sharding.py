"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Row numbers 0..n-1 (in key order) are permuted by a keyed Feistel network; values
outside the range are sent through again until they fall inside.  Place p of the
permutation goes to shard ``p % shards``, slot ``p // shards``, so anyone who has
the seed can compute where a row lies, and back, without a table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from textloom.session import free_name, scratch, ship, written

ROUNDS = 6
#: Odd multipliers of the round function (fixed values of a public 64-bit mixer).
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _round(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return [int(k) for k in rng.integers(0, 1 << 62, ROUNDS, dtype=np.int64)]


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _walk(x: np.ndarray, n: int, keys: list[int], undo: bool) -> np.ndarray:
    half = _half_bits(n)
    h, mask = np.uint64(half), np.uint64((1 << half) - 1)
    x = x.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):  # cycle walking: the orbit of a number below n returns below n
        left, right = x[todo] >> h, x[todo] & mask
        for k in reversed(keys) if undo else keys:
            left, right = (right ^ (_round(left, k) & mask), left) if undo else (right, left ^ (_round(right, k) & mask))
        x[todo] = left << h | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Places of the row numbers ``rows`` (all below ``n``) in the shuffle."""
    return _walk(np.asarray(rows), n, _keys(seed), False)


def unpermute(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The inverse of ``permute``."""
    return _walk(np.asarray(places), n, _keys(seed), True)


def locate(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of one row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number that lies at a shard's slot."""
    return int(unpermute(np.array([slot * shards + shard]), n, seed)[0])


def numbered(df: DataFrame, order: list[str], name: str = "row__") -> DataFrame:
    """``df`` with gapless global row numbers in the given order, without one sorting task.

    Rows are range-partitioned and sorted, written once, and each part's number of
    rows (one small row a part) gives the offsets.  The range partitioner samples its
    input first: give it a written table or a plain scan, not a costly plan.
    """
    pid, at, off = (free_name(df.columns, x) for x in ("pid__", "at__", "off__"))
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(f"`{c}`") for c in order]
    placed = df.repartitionByRange(parts, *cols).sortWithinPartitions(*cols).withColumn(at, F.monotonically_increasing_id())
    # the upper bits of that id are the part, the lower 33 the place within it
    placed = placed.withColumn(pid, F.shiftright(at, 33).cast("int")).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    placed = written(placed, "numbered")
    counts = sorted((r[0], r[1]) for r in placed.groupBy(pid).count().collect())  # one row a part
    start, offsets = 0, []
    for p, c in counts:
        offsets.append((p, start))
        start += c
    offs = spark.createDataFrame(offsets, f"{pid} int, {off} long")
    return placed.join(F.broadcast(offs), pid).withColumn(name, F.col(at) + F.col(off)).drop(pid, at, off)


def shard_rows(df: DataFrame, *, shards: int, seed: int = 17, order: list[str], row: str = "row__") -> DataFrame:
    """``df`` with ``row`` (global number in ``order``), ``shard`` and ``slot``.

    The law is ``rows``: shard sizes differ by at most one and slots have no gaps.
    Rows that tie in ``order`` are equal in it, so which of them comes first changes
    nothing that ``order`` shows.  Nulls sort first.  Columns named like a result
    are replaced.  An empty table gives an empty result.
    """
    ship(df.sparkSession)
    keep = [c for c in df.columns if c.lower() not in ("shard", "slot", row.lower())]
    rows = numbered(df.select(*[F.col(f"`{c}`") for c in keep]), order, row)
    n = rows.count()

    @F.pandas_udf("long")
    def place(r: pd.Series) -> pd.Series:
        return pd.Series(permute(r.to_numpy(), n, seed))

    p = free_name(rows.columns, "place__")
    return rows.withColumn(p, place(F.col(row))).withColumn("shard", F.pmod(p, F.lit(shards)).cast("int")).withColumn("slot", F.expr(f"`{p}` div {shards}")).drop(p)


def write_shards(df: DataFrame, path: str | None = None) -> str:
    """Write sharded rows as one folder a shard, each file in slot order; returns the path."""
    path = path or scratch(df.sparkSession, "shards")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path


def shard_table(df: DataFrame, *, shards: int = 16, seed: int = 17, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Placement of documents: key, size, checksum, law, shard and slot; the texts themselves are not shuffled.

    ``size`` is the text's UTF-8 bytes plus 1, ``text_crc32`` its unsigned CRC-32; a
    null text has no bytes.  Rows are numbered by key, then size and checksum.
    ``grown_shard`` is null: it belongs to another law.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    slim = df.select(F.col(f"`{key}`").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    out = shard_rows(written(slim, "sizes"), shards=shards, seed=seed, order=["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("row__").alias("row_number"))
