"""Exact top-k search by inner product: a three-phase uniform threshold.

The components of the vectors are cut into ``lists`` lists; a vector's score is the sum
of its local scores, one a list (TPUT, with a list for each part of the components).

1.  Every task gathers, for each query and list, the ``k`` vectors with the highest local
    scores, and their sums.  The ``k``-th best sum over all tasks is a cutoff: the result
    has no lower score.
2.  The cutoffs are broadcast.  A vector whose local scores all lie below ``cutoff / lists``
    can't reach the cutoff; the entries that do are collected, from any list.
3.  The scores of those vectors are resolved exactly.  What is below the cutoff goes, and
    the ``k`` best of each task are put together.

A row holds all lists of its vector, so phases 2 and 3 are one pass and only results are
shuffled.  Queries are taken in blocks of a bounded number of components, one after the
other, each against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from textloom.llm.sharding import numbered
from textloom.session import scratch, ship, written

#: Components of the queries of one block (in doubles: 16 MB), and its queries.
BLOCK_COMPONENTS, BLOCK_QUERIES = 1 << 21, 4096
#: Scores that a task holds at once.
SCORES = 1 << 20
RESULT = "q__ long, row__ long, id__ long, score__ long"


def scaled(vector: Column, scale: int) -> Column:
    """Whole numbers of a vector; null if it is null or has a null or non-finite component."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    odd = F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~odd, F.transform(numbers, lambda x: F.floor(x * scale)))


def _matrix(lists: pa.Array, width: int, exact: bool) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros.  Doubles where no sum leaves their whole numbers, else Python's integers."""
    values, offsets = np.asarray(lists.flatten()), np.asarray(lists.offsets)
    size = np.diff(offsets)
    kind = object if exact else np.float64
    if (size == width).all():
        return values.astype(kind).reshape(len(lists), width)
    out = np.zeros((len(lists), width), kind)
    at = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(lists)), size), at] = values
    return out


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest of each column (all, if fewer)."""
    n, m = score.shape
    if n <= k:
        rows = np.broadcast_to(np.arange(n)[:, None], (n, m))
    elif score.dtype == object:
        rows = np.argsort(-score, axis=0, kind="stable")[:k]
    else:
        rows = np.argpartition(score, n - k, axis=0)[n - k :]
    return rows.ravel(), np.broadcast_to(np.arange(m), rows.shape).ravel()


class _Queries:
    """A block of queries as tasks use it."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, lists: int, exact: bool):
        self.rows, self.vectors, self.exact, self.width = rows, vectors, exact, vectors.shape[1]
        cuts = np.linspace(0, self.width, lists + 1).astype(int)
        self.parts = [slice(a, b) for a, b in zip(cuts, cuts[1:])]

    def chunks(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[np.ndarray]]]:
        """Parts of a batch with their row numbers and the local scores, list by list."""
        step = max(1, SCORES // len(self.rows))
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            m = _matrix(part.column("v__"), self.width, self.exact)
            yield part, np.asarray(part.column("row__")), [m[:, p] @ self.vectors[:, p].T for p in self.parts]


def _batch(q: np.ndarray, row: np.ndarray, ids: pa.Array, score: np.ndarray) -> pa.RecordBatch:
    most = 1 << 63
    if score.dtype == object and any(not -most <= s < most for s in score):
        raise OverflowError("a score doesn't fit into 64 bits")
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(row, pa.int64()), ids, pa.array(score.astype(np.int64))], ["q__", "row__", "id__", "score__"])


class _Kept:
    """The best entries of a task so far: query, row, id and score."""

    def __init__(self, k: int):
        self.k, self.parts, self.size, self.limit = k, [], 0, 1 << 18

    def add(self, q: np.ndarray, row: np.ndarray, ids: pa.Array, score: np.ndarray) -> None:
        self.parts.append((q, row, ids, score))
        self.size += len(q)
        if self.size > self.limit:
            self.limit = max(self.limit, 2 * self.cut())

    def cut(self) -> int:
        """Keep ``k`` entries a query, the highest scores, of equal ones the first rows; an entry counts once."""
        if self.parts:
            q, row, score = (np.concatenate([p[c] for p in self.parts]) for c in (0, 1, 3))
            order = np.lexsort((row, -score, q))
            q, row = q[order], row[order]
            once = np.ones(len(q), bool)
            once[1:] = (np.diff(q) != 0) | (np.diff(row) != 0)
            order, q, row = order[once], q[once], row[once]
            first = np.flatnonzero(np.diff(q, prepend=-1))
            place = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q)))
            order, q, row = order[place < self.k], q[place < self.k], row[place < self.k]
            self.parts = [(q, row, pa.concat_arrays([p[2] for p in self.parts]).take(pa.array(order)), score[order])]
        self.size = sum(len(p[0]) for p in self.parts)
        return self.size

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.cut()
        for p in self.parts:
            yield _batch(*p)


def _block(rows: DataFrame, block: _Queries, k: int) -> DataFrame:
    """The ``k`` best rows for each query of a block, all three phases."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(block)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kept = sent.value, _Kept(k)
        for batch in batches:
            for part, numbers, local in own.chunks(batch):
                total = sum(local)
                for scores in local:
                    i, j = _best(scores, k + 1)  # one may be the query itself
                    other = numbers[i] != own.rows[j]
                    i, j = i[other], j[other]
                    kept.add(own.rows[j], numbers[i], part.column("id__").take(pa.array(i)), total[i, j])
        yield from kept.batches()

    ranked = Window.partitionBy("q__").orderBy(F.desc("score__"), "row__")
    gathered = rows.mapInArrow(gather, RESULT).withColumn("rank__", F.row_number().over(ranked)).where(F.col("rank__") == k)
    cutoff = {r.q__: r.score__ for r in gathered.select("q__", "score__").collect()}  # one row a query of the block
    low = np.array([cutoff.get(q, -(1 << 62)) for q in block.rows.tolist()], object)
    cutoffs = spark.sparkContext.broadcast(low if block.exact else low.astype(np.float64))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, least, kept = sent.value, cutoffs.value, _Kept(k)
        for batch in batches:
            for part, numbers, local in own.chunks(batch):
                some = np.zeros(local[0].shape, bool)
                for scores in local:
                    some |= (scores * len(local) >= least).astype(bool)
                i, j = np.nonzero(some)
                score = sum(scores[i, j] for scores in local)
                ok = ((score >= least[j]) & (numbers[i] != own.rows[j])).astype(bool)
                i, j = i[ok], j[ok]
                kept.add(own.rows[j], numbers[i], part.column("id__").take(pa.array(i)), score[ok])
        yield from kept.batches()

    best = rows.mapInArrow(resolve, RESULT)
    return best.withColumn("rank__", F.row_number().over(ranked)).where(F.col("rank__") <= k)


def top_k(df: DataFrame, *, queries: Column, k: int = 10, lists: int = 2, scale: int = 1024, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` highest scores (all, if fewer) of each query.

    ``queries`` says which rows of ``df`` are queries (null: isn't one); every other row with a
    vector is a candidate.  Components are multiplied by ``scale`` and rounded down; a score is
    the inner product of those whole numbers.  Ties go to the smaller ``key``, a null key
    first.  Vectors that are null, or hold a null or non-finite component, take no part, as
    queries or candidates; a shorter vector counts as ending in zeros, an empty one as all
    zeros.  Rows that tie in key and vector are rows of their own: each is a query, and a
    candidate for the others.  An empty table gives an empty result.  A score beyond 64 bits
    is an error.
    """
    spark = df.sparkSession
    ship(spark)
    source = df.select(F.col(f"`{key}`").cast("long").alias("id__"), F.coalesce(queries, F.lit(False)).alias("query__"), scaled(F.col(f"`{vector}`"), scale).alias("v__"))
    rows = written(numbered(written(source.where("v__ IS NOT NULL"), "vectors"), ["id__", "v__"], "row__"), "vectors")
    width, most = rows.agg(F.max(F.size("v__")), F.max(F.array_max(F.transform("v__", lambda x: F.abs(x))))).first()
    path = scratch(spark, "best")
    width = width or 0
    exact = width * (most or 0) ** 2 >= 1 << 52
    size = max(1, min(BLOCK_QUERIES, BLOCK_COMPONENTS // max(1, width)))
    asked = written(numbered(rows.where("query__").select("row__", "id__", "v__"), ["row__"], "nth__"), "queries")
    n = asked.count()
    slim = rows.select("row__", "id__", "v__")
    empty = slim.select(F.col("row__").alias("q__"), "row__", "id__", F.lit(0).cast("long").alias("score__"), F.lit(0).alias("rank__")).limit(0)
    empty.write.parquet(path)
    for first in range(0, n, size):
        part = asked.where((F.col("nth__") >= first) & (F.col("nth__") < first + size)).toArrow()  # a bounded block
        block = _Queries(np.asarray(part["row__"]), _matrix(part["v__"].combine_chunks(), width, exact), max(1, min(lists, width)), exact)
        _block(slim, block, k).select(empty.columns).write.mode("append").parquet(path)
    best = spark.read.schema(empty.schema).parquet(path)
    names = asked.select(F.col("row__").alias("q__"), F.col("id__").alias("query_id"))
    return best.join(names, "q__").select("query_id", F.col("rank__").alias("rank"), F.col("id__").alias("vec_id"), F.col("score__").alias("score"))


def nearest_table(df: DataFrame) -> DataFrame:
    """The ten best of all rows of ``embeddings`` for every row whose ``vec_id`` 100 divides; see ``top_k``."""
    return top_k(df, queries=F.col("vec_id") % 100 == 0)
