"""Exact dedup: two-pass Bloom filtering, in DataFrame functions only.

Pass one reads the hashes of the normalised texts.  Every hash hits several slots of
a bit array; the tasks' slots are packed into arrays, one a task and bucket of slots,
so no row of the table is shuffled.  Slots hit more than once make the filter.  Pass
two tests each hash against it.  A hash with a slot that was hit once is certainly
unique, so its row passes straight through; only the rest, the possible repeats,
shuffle.

A filter has a fixed size.  Of more rows than it serves well the hashes are cut into
ranges, each with a filter of its own, which are handled in turn from tables that are
sorted by hash within their parts, so that a range reads its own pages only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from textloom.session import free_name, scratch, written

#: The bit array that goes to every task is never larger (2^27 bits: 16 MB).
MAX_FILTER_BITS = 1 << 27
#: Bits a row that a filter has if it may, and has at least: beyond that the hashes are cut into ranges.
BITS_PER_ROW, LEAST_BITS_PER_ROW = 16, 4
#: Slots that a hash hits.
HASHES = 2
#: Buckets of slots: a task packs its slots into so many arrays at most.
BUCKETS = 64
RESULTS = ("text_sha256", "keep_id", "group_size", "kept")


def normalized(text: Column) -> Column:
    """Null counts as empty; every run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key__``, ``text_sha256`` and its number ``hash__`` of every row, written out: the texts are read once."""
    rows = df.select(F.col(f"`{key}`").alias("key__"), F.sha2(normalized(F.col(f"`{text}`")), 256).alias("text_sha256"))
    return written(rows.withColumn("hash__", F.xxhash64("text_sha256")).sortWithinPartitions("hash__"), "digests")


@dataclass(frozen=True)
class Filter:
    """The bits of one range of hashes, ``low`` to ``high``; ``words`` is one row."""

    low: int
    high: int
    bits: int
    words: DataFrame

    def within(self, number: Column) -> Column:
        return number.between(self.low, self.high)

    def possible(self, sha: Column) -> Column:
        """False only for a digest that certainly occurs once."""
        hit = lambda slot: F.getbit(F.element_at(self.words.scalar(), F.shiftright(slot, 6).cast("int") + 1), F.pmod(slot, F.lit(64)).cast("int")) == 1
        out = F.lit(True)
        for slot in _slots(sha, self.bits):
            out = out & hit(slot)
        return out


@dataclass
class Repeats:
    """What pass one found: the filters, the groups with repeats, and whether rows tie in key and text."""

    filters: list[Filter] = field(default_factory=list)
    groups: DataFrame | None = None
    ties: bool = False


def _slots(sha: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(sha, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def _repeated(slots: str) -> Column:
    """Of a sorted array the values that stand in it more than once."""
    return F.filter(slots, lambda x, i: (i > 0) & (x == F.get(F.col(slots), F.greatest(i - 1, F.lit(0)))))


def _filter_words(hashes: DataFrame, bits: int) -> DataFrame:
    """The bit array of one range as one row, ``words``: slots hit more than once."""
    size = max(64, bits // BUCKETS)
    hits = hashes.select(F.spark_partition_id().alias("part"), F.explode(F.array(*_slots(F.col("text_sha256"), bits))).alias("slot"))
    hits = hits.select("part", F.expr(f"cast(slot div {size} as int)").alias("bucket"), F.expr(f"cast(slot % {size} as int)").alias("at"))
    # a task's slots: one record for each of its buckets; a text that it has many times becomes one entry of each array
    packed = hits.groupBy("part", "bucket").agg(F.array_sort(F.collect_list("at")).alias("s"))
    packed = packed.select("bucket", F.array_distinct("s").alias("seen"), F.array_distinct(_repeated("s")).alias("again"))
    merged = packed.groupBy("bucket").agg(F.array_sort(F.flatten(F.collect_list("seen"))).alias("s"), F.flatten(F.collect_list("again")).alias("again"))
    slots = merged.select("bucket", F.explode(F.array_union(_repeated("s"), "again")).alias("at")).select((F.col("bucket").cast("long") * size + F.col("at")).alias("slot"))
    set_bits = slots.select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bits"))
    empty = hashes.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    dense = set_bits.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    # one row: the filter itself, of at most max_filter_bits
    return written(dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words")), "bloom")


def hash_ranges(n: int) -> Iterator[tuple[int, int]]:
    """All 64-bit numbers in ``n`` ranges of equal width, lowest and highest of each."""
    for r in range(n):
        yield -(1 << 63) + (r << 64) // n, -(1 << 63) + ((r + 1 << 64) // n) - 1


def find_repeats(hashes: DataFrame, max_filter_bits: int = MAX_FILTER_BITS) -> Repeats:
    """Pass one over ``digests(...)``."""
    spark = hashes.sparkSession
    n = hashes.count()
    most = 1 << max(6, max_filter_bits.bit_length() - 1)
    ranges = max(1, -(-n * LEAST_BITS_PER_ROW // most))
    bits = min(max(1 << 12, 1 << (n // ranges * BITS_PER_ROW).bit_length()), most)
    found, path = Repeats(), scratch(spark, "repeats")
    for low, high in hash_ranges(ranges):
        own = hashes.where(F.col("hash__").between(low, high)) if ranges > 1 else hashes
        found.filters.append(Filter(low, high, bits, _filter_words(own, bits)))
        pairs = own.where(found.filters[-1].possible(F.col("text_sha256"))).groupBy("text_sha256", "key__").count()
        groups = pairs.groupBy("text_sha256").agg(F.min("key__").alias("keep_id"), F.sum("count").alias("group_size"), F.max("count").alias("ties"))
        groups.where("group_size > 1").write.mode("append").parquet(path)
    found.groups = spark.read.schema(groups.schema).parquet(path)
    found.ties = bool(found.groups.where("ties > 1").head(1))
    return found


def _marked(rows: DataFrame, found: Repeats, one: Filter, key: Column) -> DataFrame:
    sha = F.col("text_sha256")
    through = rows.where(~one.possible(sha)).select("*", key.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    first = F.lit(True)
    again = rows.where(one.possible(sha))
    gk, gn = free_name(rows.columns, "gk__"), free_name(rows.columns, "gn__")
    if found.ties:  # rows equal in key and text: one of them stays
        rn = free_name(rows.columns, "rn__")
        again = again.withColumn(rn, F.row_number().over(Window.partitionBy(sha, key).orderBy(key)))
        first = F.col(rn) == 1
    again = again.join(found.groups.select("text_sha256", F.col("keep_id").alias(gk), F.col("group_size").alias(gn)), "text_sha256", "left")
    # a null key is the smallest only in a group that has no other
    kept = first & (F.col(gn).isNull() | key.eqNullSafe(F.col(gk)))
    again = again.select(*[F.col(f"`{c}`") for c in rows.columns], F.when(F.col(gn).isNull(), key).otherwise(F.col(gk)).alias("keep_id"), F.coalesce(gn, F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"))
    return through.unionByName(again)


def mark(rows: DataFrame, found: Repeats, key: Column, number: str = "hash__") -> DataFrame:
    """Pass two: ``keep_id``, ``group_size`` and ``kept`` beside each row that has a ``text_sha256`` and its ``number``."""
    if len(found.filters) == 1:
        return _marked(rows, found, found.filters[0], key)
    path = scratch(rows.sparkSession, "marked")
    for one in found.filters:
        out = _marked(rows.where(one.within(F.col(number))), found, one, key)
        out.write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(out.schema).parquet(path)


def exact_dedup(df: DataFrame, *, text: str = "text", key: str = "doc_id", max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """Every row of ``df`` with ``text_sha256``, ``keep_id``, ``group_size`` and ``kept``.

    Of rows with equal normalised text the one with the smallest ``key`` is kept;
    a null key sorts last, and of rows that tie in key and text exactly one is
    kept.  ``keep_id`` is null only where no row of the group has a key.  A null
    text is the empty text.  Columns of ``df`` named like a result are replaced
    (the key and text columns are read before that).  An empty table gives an
    empty result.

    A filter has 16 bits a row, 4 at least, and at most ``max_filter_bits`` (a larger
    one suits larger executors).  Of more rows the hashes are handled in ranges, and
    ``df`` is written once, sorted by hash within its parts.
    """
    found = find_repeats(digests(df, text, key), max_filter_bits)
    k = free_name(df.columns, "key__")
    h = free_name(df.columns, "hash__")
    rest = [c for c in df.columns if c.lower() not in RESULTS]
    rows = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{key}`").alias(k), F.sha2(normalized(F.col(f"`{text}`")), 256).alias("text_sha256"))
    if len(found.filters) > 1:
        rows = written(rows.withColumn(h, F.xxhash64("text_sha256")).sortWithinPartitions(h), "by-hash")
    return mark(rows, found, F.col(k), h).drop(k, h)


def dedup_digests(df: DataFrame, *, text: str = "text", key: str = "doc_id", max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """The same decisions without the rows' other columns: pass two reads the written digests, not the texts."""
    hashes = digests(df, text, key)
    out = mark(hashes, find_repeats(hashes, max_filter_bits), F.col("key__"))
    return out.select(F.col("key__").alias("doc_id" if key == "doc_id" else key), *[F.col(c) for c in ("keep_id", "group_size", "kept", "text_sha256")])
