"""A keyword index in Parquet that is kept and updated: BM25 with block maxima, phrases, appends and deletions.

Folders below the index's path:

``buckets``   the number of buckets that terms are dealt to by their hash;
``postings``  one row for each segment, term and block of ``SPAN`` consecutive documents: the
              documents with counts and lengths, the places of one after the other, how many
              documents they are, and the block's greatest count and least length, which bound
              every score in it;
``docs``      each segment's documents and their lengths;
``dead``      documents of earlier segments that a later one replaces or deletes;
``commits``   one row for each finished segment: documents and words that it adds.

An update writes one more segment: postings in the buckets of its own terms, and rows
with negative counts for the terms of what it removes.  No file is written again, and a
segment counts once its commit is there.  ``compact`` puts all into one segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.operators.texts import _KEYS
from textloom.plans.registry import query
from textloom.session import delete, scratch, table, written

#: Documents of a block by id, buckets of terms, and the usual constants of BM25.
SPAN, BUCKETS = 256, 32
K1, B = 1.2, 0.75
#: Blocks of a query that set its threshold, and query terms that are sent to every task.
FIRST_BLOCKS, MOST_TERMS = 4, 100_000
#: Documents that leave the index and are sent to every task at once.
MOST_GONE = 2_000_000
#: Scores are compared to so many places.
PLACES = 6
_POSTINGS = "term string, block long, doc array<long>, tf array<int>, len array<int>, places array<int>, n long, most int, least int, bucket int, segment int"
_BLOCKS = _POSTINGS.removesuffix(", bucket int, segment int")
_META = ["bucket", "term", "block", "segment", "n", "most", "least"]
#: The index is read a few times and may be as large as the texts.
CODEC = "zstd"


def _block(doc: Column) -> Column:
    return F.shiftright(doc, SPAN.bit_length() - 1)


def _words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc``, ``block`` and ``ws``, the keywords of a text in their order."""
    words = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), T.keywords(F.coalesce(F.col(text), F.lit(""))).alias("ws"))
    return words.select("doc", _block(F.col("doc")).alias("block"), "ws")


def _blocks(words: DataFrame) -> DataFrame:
    """A row for each term and block of documents; a block is one task's, so only the words are shuffled, once and as one string a document."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = words.select("doc", "block", F.array_join("ws", " ").alias("ws"))
    return joined.repartition(parts, "block").sortWithinPartitions("block", "doc").mapInArrow(_split_and_posted, _BLOCKS)


def _split_and_posted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return map(_flat, _posted(part.set_column(part.schema.get_field_index("ws"), "ws", _split(part["ws"])) for part in parts))


def _flat(part: pa.RecordBatch) -> pa.RecordBatch:
    """Lists of numbers in place of ``docs``: Spark reads and writes them faster than lists of structs, and one without the others."""
    docs, at = part["docs"].values, part["docs"].offsets
    doc, tf, size, places = docs.flatten()
    lists = [pa.ListArray.from_arrays(at, c) for c in (doc, tf, size)] + [pa.ListArray.from_arrays(places.offsets.take(at), places.values)]
    return pa.RecordBatch.from_arrays([part["term"], part["block"], *lists, *(part[c] for c in ("n", "most", "least"))], ["term", "block", "doc", "tf", "len", "places", "n", "most", "least"])


def _split(joined: pa.Array) -> pa.Array:
    """Lists of the words that one space joins; an empty string has none."""
    lists = pc.split_pattern(joined, " ")
    lens = np.where(pc.equal(joined, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(lists)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), flat.filter(pc.not_equal(flat, "")))


def _posted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for part in parts:
        blocks = part["block"].to_numpy()
        ends = [*(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for at, end in zip([0, *ends], ends):
            if held and held[0]["block"][0].as_py() != blocks[at]:
                yield _postings(held)
                held = []
            if end > at:
                held.append(part.slice(at, end - at))
    if held:
        yield _postings(held)


def _postings(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The postings of one block of documents, which come in the order of their ids."""
    lists = pa.concat_arrays([h["ws"] for h in held])
    docs = np.concatenate([h["doc"].to_numpy() for h in held])
    lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int32)
    coded = pc.list_flatten(lists).dictionary_encode()
    code, row = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(docs)), lens)
    places = (np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.int32)
    order = np.argsort(code, kind="stable")
    code, row, places = code[order], row[order], places[order]
    starts = lambda new: np.flatnonzero(np.concatenate([[True], new])[: len(new) + 1]) if len(code) else np.zeros(0, np.int64)
    one = starts((code[1:] != code[:-1]) | (row[1:] != row[:-1]))  # the first place of a term in a document
    tf, at, of = np.diff([*one, len(code)]).astype(np.int32), row[one], code[one]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else one
    listed = lambda offsets, end, values: pa.ListArray.from_arrays(pa.array([*offsets, end], pa.int32()), values)
    posts = pa.StructArray.from_arrays([pa.array(docs[at]), pa.array(tf), pa.array(lens[at]), listed(one, len(code), pa.array(places))], ["doc", "tf", "len", "places"])
    most, least = (np.maximum.reduceat(tf, first), np.minimum.reduceat(lens[at], first)) if len(of) else (tf, tf)
    terms = coded.dictionary.take(pa.array(of[first], pa.int64()))
    block = pa.array(np.full(len(first), held[0]["block"][0].as_py(), np.int64))
    n = pa.array(np.diff([*first, len(of)]).astype(np.int64))
    return pa.RecordBatch.from_arrays([terms, block, listed(first, len(of), posts), n, pa.array(most), pa.array(least)], ["term", "block", "docs", "n", "most", "least"])


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _buckets(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/buckets").first().buckets


def _losing(gone: DataFrame) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts, below zero, of what each row of postings loses by ``gone`` (``doc``, ``segment``; bounded): a block's postings of a term are one row, so no task's counts need others."""
    rows = gone.select("segment", "doc").toArrow()
    of, ids = rows["segment"].to_numpy(), rows["doc"].to_numpy()
    held = gone.sparkSession.sparkContext.broadcast({int(s): np.sort(ids[of == s]) for s in np.unique(of)})

    def lost(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n = pc.list_value_length(part["doc"]).to_numpy(zero_copy_only=False)
            doc, segment = pc.list_flatten(part["doc"]).to_numpy(), np.repeat(part["segment"].to_numpy(), n)
            hit = np.zeros(len(doc), bool)
            for s, ids in held.value.items():
                own = np.flatnonzero(segment == s)
                hit[own] = ids[np.minimum(np.searchsorted(ids, doc[own]), len(ids) - 1)] == doc[own]
            counts = np.bincount(np.repeat(np.arange(len(n)), n)[hit], minlength=len(n))
            some = pa.array(np.flatnonzero(counts))
            yield pa.RecordBatch.from_arrays([part["term"].take(some), part["block"].take(some), pa.array(-counts[counts > 0], pa.int64())], ["term", "block", "n"])

    return lost


def _segment(spark: SparkSession, path: str, number: int, words: DataFrame, gone: DataFrame | None) -> None:
    """Postings go to their files from the task that makes them, a file for each task and bucket, in the order of terms."""
    blocks, buckets = _blocks(words), _buckets(spark, path)
    if gone is not None:
        many = -(-gone.count() // MOST_GONE)
        old = spark.read.schema(_POSTINGS).parquet(f"{path}/postings").where(F.col("segment") < number).where("n > 0").select("term", "block", "segment", "doc")
        minus = [old.mapInArrow(_losing(gone.where(F.pmod(F.xxhash64("doc"), F.lit(many)) == i)), "term string, block long, n long") for i in range(many)]
        blocks = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), minus, blocks)
    rows = blocks.withColumn("bucket", _bucket(F.col("term"), buckets)).withColumn("segment", F.lit(number))
    rows.sortWithinPartitions("bucket", "term", "block").write.mode("append").option("compression", CODEC).partitionBy("bucket", "segment").parquet(f"{path}/postings")
    words.select("doc", F.size("ws").alias("len")).write.mode("append").parquet(f"{path}/docs/segment={number}")
    if gone is not None:
        gone.select("doc", F.col("segment").alias("replaced"), "len").write.mode("append").parquet(f"{path}/dead/segment={number}")
    added = spark.read.parquet(f"{path}/docs/segment={number}").agg(F.count("*").alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("words"))
    if gone is not None:
        lost = spark.read.parquet(f"{path}/dead/segment={number}").agg(F.count("*").alias("d"), F.coalesce(F.sum("len"), F.lit(0)).alias("w"))
        added = added.join(F.broadcast(lost)).select((F.col("docs") - F.col("d")).alias("docs"), (F.col("words") - F.col("w")).alias("words"))
    added.coalesce(1).write.parquet(f"{path}/commits/segment={number}")


def build_index(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> str:
    """Index ``docs`` (one row for each ``key``, a number) below ``path``, a new folder; a null key isn't indexed, a null text has no words."""
    spark = docs.sparkSession
    spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/buckets")
    _segment(spark, path, 0, _words(docs, key, text), None)
    return path


def _scores(posts: pa.Table, asked: pa.Table, weighted: pa.Table, mean: float, item: str, k: int) -> pa.Table:
    """``item``, ``doc`` and ``score`` of one block's best ``k`` live documents (and what may tie with the last) for each query of ``asked`` (null: a dead document)."""
    empty = pa.table({item: pa.array([], weighted[item].type), "doc": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    wanted = asked.filter(pc.is_valid(asked[item]))[item].combine_chunks()
    if not len(posts) or not len(wanted):
        return empty  # nothing is asked of this block
    # of the block's queries, their terms with postings here
    query = pc.index_in(weighted[item].combine_chunks(), wanted)
    terms = pc.unique(posts["term"].combine_chunks())
    term = pc.index_in(weighted["term"].combine_chunks(), terms)
    both = pc.and_(pc.is_valid(query), pc.is_valid(term)).to_numpy(zero_copy_only=False)
    query, term, idf = (c.to_numpy(zero_copy_only=False)[both] for c in (query, term, weighted["idf"].combine_chunks()))
    query, term = query.astype(np.int64), term.astype(np.int64)
    lens = pc.list_value_length(posts["doc"].combine_chunks()).to_numpy(zero_copy_only=False)
    of = np.repeat(pc.index_in(posts["term"].combine_chunks(), terms).to_numpy(), lens)
    doc, tf, size = (pc.list_flatten(posts[c].combine_chunks()).to_numpy().astype(np.int64) for c in ("doc", "tf", "len"))
    if len(asked) > len(wanted):
        gone = asked.filter(pc.is_null(asked[item]))
        dead = set(zip(gone["gone"].to_pylist(), gone["of"].to_pylist()))
        segment = np.repeat(posts["segment"].to_numpy(), lens)
        live = np.array([x not in dead for x in zip(doc.tolist(), segment.tolist())], bool)
        of, doc, tf, size = of[live], doc[live], tf[live], size[live]
    docs, at = np.unique(doc, return_inverse=True)
    each = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / max(mean, 1e-9)))
    weight = np.bincount(of * len(docs) + at, each, len(terms) * len(docs)).reshape(len(terms), len(docs))
    order = np.argsort(query, kind="stable")
    query, term, idf = query[order], term[order], idf[order]
    ends = [*(np.flatnonzero(query[1:] != query[:-1]) + 1).tolist(), len(query)]
    out = []
    for a, b in zip([0, *ends], ends):
        sums = idf[a:b] @ weight[term[a:b]]
        least = np.partition(sums, -k)[-k] - 10.0**-PLACES if len(sums) > k else 0
        found = np.flatnonzero((sums > 0) & (sums >= least))
        out.append((np.full(len(found), query[a] if b > a else 0), docs[found], sums[found]))
    q, d, sums = (np.concatenate(c) for c in zip(*out))
    return pa.table({item: wanted.take(pa.array(q, pa.int64())), "doc": pa.array(d, pa.int64()), "score": pa.array(sums, pa.float64())})


def _each_place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``term``, ``segment``, ``doc`` and ``place``, a row for each place."""
    for part in parts:
        tf = pc.list_flatten(part["tf"]).to_numpy()
        row = pa.array(np.repeat(np.arange(part.num_rows), pc.list_value_length(part["places"]).to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays([part["term"].take(row), part["segment"].take(row), pa.array(np.repeat(pc.list_flatten(part["doc"]).to_numpy(), tf)), pc.list_flatten(part["places"])], ["term", "segment", "doc", "place"])


def _commits(spark: SparkSession, path: str) -> list:
    return spark.read.parquet(f"{path}/commits").collect()  # one row for each segment


class Index:
    """The finished segments of an index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        commits = _commits(spark, path)
        self.segments = sorted(r.segment for r in commits)
        self.n, self.words = sum(r.docs for r in commits), sum(r.words for r in commits)
        self.buckets = _buckets(spark, path)

    def _read(self, what: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{what}").parquet(*[f"{self.path}/{what}/segment={s}" for s in self.segments])

    def dead(self) -> DataFrame | None:
        """Documents (``doc``, ``segment``) that a later segment has replaced."""
        later = [s for s in self.segments if s > 0]
        if not later:
            return None
        return self.spark.read.option("basePath", f"{self.path}/dead").parquet(*[f"{self.path}/dead/segment={s}" for s in later]).select("doc", F.col("replaced").alias("segment"))

    def docs(self) -> DataFrame:
        """Live documents with ``segment`` and ``len``."""
        rows, dead = self._read("docs"), self.dead()
        return rows if dead is None else rows.join(dead, ["doc", "segment"], "left_anti")

    def postings(self, terms: DataFrame) -> DataFrame:
        """Rows of the index for ``terms`` (``term``, distinct): only their buckets' files are opened."""
        known = terms.select("term", _bucket(F.col("term"), self.buckets).alias("bucket"))
        buckets = sorted(r.bucket for r in known.select("bucket").distinct().collect())  # a few
        rows = self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings").where(F.col("bucket").isin(buckets) & F.col("segment").isin(self.segments))
        asked = terms.limit(MOST_TERMS + 1).count()
        return rows.join(F.broadcast(terms) if asked <= MOST_TERMS else terms, "term")

    def update(self, docs: DataFrame | None = None, deleted: DataFrame | None = None, *, key: str = "doc_id", text: str = "text") -> None:
        """Put ``docs`` in (again, where their keys are known) and take ``deleted`` (``key``) out, as one segment."""
        spark = self.spark
        number = max(self.segments) + 1
        for left in ("docs", "dead"):  # of an update that did not end
            delete(spark, f"{self.path}/{left}/segment={number}")
        for b in range(self.buckets):
            delete(spark, f"{self.path}/postings/bucket={b}/segment={number}")
        docs = docs if docs is not None else spark.createDataFrame([], f"{key} long, {text} string")
        keys = docs.select(F.col(key).cast("long").alias("doc"))
        if deleted is not None:
            keys = keys.union(deleted.select(F.col(key).cast("long")))
        gone = written(self.docs().join(keys.distinct(), "doc", "left_semi"), "gone")
        _segment(spark, self.path, number, _words(docs, key, text), gone)
        self.__init__(spark, self.path)

    def bound(self, idf: Column, most: Column, least: Column) -> Column:
        """Greatest score that a term can give in a block; with a document's own count and length: its score."""
        return idf * most * (K1 + 1) / (most + K1 * (1 - B + B * least / max(self.words / max(self.n, 1), 1e-9)))

    def search(self, queries: DataFrame, k: int, *, item: str = "item_id", text: str = "text") -> DataFrame:
        """``item``, ``doc``, ``score`` and ``rank`` of the ``k`` best documents by BM25 for each query, ties to the smaller document.

        The best blocks of each query, by the sums of their bounds, give a threshold; of the
        other blocks only those are opened whose bound reaches it.
        """
        asked = written(T.each_keyword(queries.where(F.col(item).isNotNull()), item, text=text, name="term").distinct(), "asked")
        meta = written(self.postings(asked.select("term").distinct()).select(*_META), "meta")
        df = meta.groupBy("term").agg(F.sum("n").alias("df")).where("df > 0").withColumn("idf", F.ln(1 + (self.n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        df = written(df, "idf")
        blocks = meta.where("n > 0").groupBy("term", "bucket", "block").agg(F.max("most").alias("most"), F.min("least").alias("least")).join(df, "term")
        blocks = blocks.withColumn("b", self.bound(F.col("idf"), F.col("most"), F.col("least")))
        bounds = written(asked.join(blocks, "term").groupBy(item, "block").agg(F.sum("b").alias("bound")), "bounds")
        best = Window.partitionBy(item).orderBy(F.desc("bound"), "block")
        first = bounds.withColumn("i", F.row_number().over(best)).where(F.col("i") <= FIRST_BLOCKS).select(item, "block")
        weighted = written(asked.join(df, "term").select(item, "term", "idf"), "weighted")
        found = written(self._scored(weighted, first, k, item), "first")
        least = found.where(F.col("rank") == k).select(item, F.col("score").alias("threshold"))
        rest = bounds.join(first, [item, "block"], "left_anti").join(least, item, "left").where(F.col("bound") >= F.coalesce("threshold", F.lit(0.0)) - 10.0**-PLACES)
        both = found.unionByName(self._scored(weighted, written(rest.select(item, "block"), "rest"), k, item)).drop("rank")
        order = Window.partitionBy(item).orderBy(F.desc("score"), "doc")
        return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(item, "doc", "score", "rank")

    def _scored(self, weighted: DataFrame, chosen: DataFrame, k: int, item: str) -> DataFrame:
        """``item``, ``doc``, ``score`` and ``rank`` of the ``k`` best of the chosen blocks (``item``, ``block``) of each query.

        A block is scored for all its queries by one task, to which its postings are dealt without their
        places.  Queries go to every task, at most ``MOST_TERMS`` of their terms (``weighted``) at once.
        """
        many = max(1, -(-weighted.count() // MOST_TERMS))
        part = lambda of: F.pmod(F.xxhash64(item), F.lit(many)) == of
        out = [self._scored_part(weighted.where(part(i)), chosen.where(part(i)), k, item) for i in range(many)]
        sums = reduce(DataFrame.unionByName, out).withColumn("score", F.round("score", PLACES))
        return sums.withColumn("rank", F.row_number().over(Window.partitionBy(item).orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k)

    def _scored_part(self, weighted: DataFrame, chosen: DataFrame, k: int, item: str) -> DataFrame:
        held = self.spark.sparkContext.broadcast(weighted.toArrow().combine_chunks())
        mean = self.words / max(self.n, 1)
        kind = StructType([StructField(item, weighted.schema[item].dataType), StructField("doc", LongType()), StructField("score", DoubleType())])

        def score(posts: pa.Table, asked: pa.Table) -> pa.Table:
            return _scores(posts, asked, held.value, mean, item, k)

        rows = self.postings(weighted.select("term").distinct()).where("n > 0").select("block", "term", "segment", "doc", "tf", "len")
        rows = rows.join(chosen.select("block").distinct(), "block", "left_semi")
        to = chosen.select("block", F.col(item), F.lit(None).cast("long").alias("gone"), F.lit(None).cast("int").alias("of"))
        if (dead := self.dead()) is not None:
            to = to.unionByName(dead.select(_block(F.col("doc")).alias("block"), F.lit(None).cast(weighted.schema[item].dataType).alias(item), F.col("doc").alias("gone"), F.col("segment").cast("int").alias("of")))
        return rows.groupBy("block").cogroup(to.groupBy("block")).applyInArrow(score, kind)

    def phrases(self, queries: DataFrame, *, item: str = "item_id", words: str = "words") -> DataFrame:
        """``item`` and ``doc`` for each document that has a query's ``words`` (an array of keywords) in a row: no other keyword stands between them."""
        words = queries.where(F.col(item).isNotNull()).select(item, F.col(words).alias("ws")).where(F.size("ws") > 0)
        asked = written(words.select(item, F.size("ws").alias("size"), F.posexplode("ws").alias("i", "term")), "asked")
        rows = self.postings(asked.select("term").distinct()).where("n > 0").select("term", "segment", "doc", "tf", "places").mapInArrow(_each_place, "term string, segment int, doc long, place int")
        dead = self.dead()
        if dead is not None:
            rows = rows.join(dead, ["doc", "segment"], "left_anti")
        starts = rows.join(asked, "term").select(item, "doc", "size", (F.col("place") - F.col("i")).alias("start"))
        return starts.groupBy(item, "doc", "size", "start").agg(F.count("*").alias("n")).where("n = size").select(item, "doc").distinct()


def compact(spark: SparkSession, path: str, to: str, texts: DataFrame, *, key: str = "doc_id", text: str = "text") -> str:
    """The live documents of an index as one segment of a new one at ``to``, from the ``texts`` that it was made of."""
    live = Index(spark, path).docs().select(F.col("doc").alias(key))
    return build_index(texts.join(live, key, "left_semi"), to, key=key, text=text)


_BM25 = f"""d AS (SELECT doc_id, {_KEYS.format("coalesce(text, '')")} AS ws FROM $DOCS), n AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS mean FROM d),
tf AS (SELECT doc_id, len(ws) AS len, w, count(*) AS tf FROM (SELECT doc_id, ws, unnest(ws) AS w FROM d) GROUP BY ALL), idf AS (SELECT w, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, n GROUP BY w, n),
q AS (SELECT DISTINCT item_id, unnest({_KEYS.format('text')}) AS w FROM benchmark),
s AS (SELECT item_id, doc_id, round(sum(idf * tf * ({K1} + 1) / (tf + {K1} * (1 - {B} + {B} * len / mean))), {PLACES}) AS score FROM q JOIN tf USING (w) JOIN idf USING (w), n GROUP BY 1, 2)
SELECT item_id, doc_id AS doc, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= 10"""


@query("bm25_index_search", "WITH " + _BM25.replace("$DOCS", "documents"))
def bm25_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents for each item of ``benchmark``, from a new index of all documents."""
    path = build_index(table(spark, d, "documents"), scratch(spark, "index"))
    return Index(spark, path).search(table(spark, d, "benchmark"), 10)


#: The table as it is after the update: the texts of one kind of documents go, those of another are replaced.
_UPDATED = "(SELECT doc_id, CASE WHEN lang = 'fr' THEN text || ' ' || reverse(text) ELSE text END AS text FROM documents WHERE lang <> 'es')"


@query("bm25_index_update", "WITH " + _BM25.replace("$DOCS", _UPDATED))
def bm25_index_update(spark: SparkSession, d: str) -> DataFrame:
    """The same after a segment that replaces all French documents and takes the Spanish ones out."""
    docs = table(spark, d, "documents")
    index = Index(spark, build_index(docs, scratch(spark, "index")))
    index.update(docs.where("lang = 'fr'").select("doc_id", F.concat("text", F.lit(" "), F.reverse("text")).alias("text")), docs.where("lang = 'es'").select("doc_id"))
    return index.search(table(spark, d, "benchmark"), 10)


@query("phrase_index_search", f"""
WITH d AS (SELECT doc_id, ' ' || array_to_string({_KEYS.format('text')}, ' ') || ' ' AS t FROM documents), q AS (SELECT item_id, array_to_string(list_slice({_KEYS.format('text')}, 3, 6), ' ') AS p FROM benchmark)
SELECT item_id, doc_id AS doc FROM q JOIN d ON contains(t, ' ' || p || ' ') WHERE p <> ''""")
def phrase_index_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have the third to sixth keyword of a benchmark item next to each other, by the places in the index."""
    index = Index(spark, build_index(table(spark, d, "documents"), scratch(spark, "index")))
    parts = table(spark, d, "benchmark").select("item_id", F.slice(T.keywords(F.col("text")), 3, 4).alias("words"))
    return index.phrases(parts)
