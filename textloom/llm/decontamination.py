"""Benchmark decontamination: spaced-seed hashes and substitution-tolerant overlaps.

Fixed masks pick some token positions of a stretch and ignore the others, so a
stretch with substituted words still has a hash in common with the original.  A bit
array of bounded size tells which of a document's hashes may be the benchmark's; those
are joined with the benchmark's hashes, seeds of many pairs dealt over several keys.
Around each hit the two texts are aligned without gaps and compared token by token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from textloom.llm.chunks import slices, turn
from textloom.session import free_name, ship, written

#: An overlap is a stretch of so many tokens (or a whole shorter item) ...
WINDOW = 13
#: ... of which this percentage agree.
PERCENT = 80
#: Items of fewer tokens than this must occur exactly ...
EXACT_BELOW = 8
#: ... and items of fewer than this are no evidence of anything and are ignored.
LEAST = 5
#: Every way to substitute two of 13 tokens leaves a place where one of these masks fits.
MASKS = ("111101101", "110101000111", "1100110111")
#: Bits of the array that goes to every task: 64 for each seed of the benchmark, in these bounds (16 MB at most).
LEAST_BITS, MOST_BITS = 16, 27
#: Bits that a seed sets, and bits of one chunk of the array.
PROBES, CHUNK = 4, 19
#: Pairs that one join key may give; a seed of more is dealt over several.
SEED_PAIRS = 200_000
#: Odd multipliers, one a probe.
_ODD = (0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)
_WORD = re.compile(r"\w+")


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@cache
def _ids() -> _Ids:
    return _Ids()


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's words (letters, digits and underscores), without case."""
    memo = _ids()
    turn("seeds", memo.clear)
    if len(memo) > 200_000:
        memo.clear()
    return np.array([memo[w] for w in _WORD.findall((text or "").lower())], np.uint64)


def allowed(n: int) -> tuple[int, int]:
    """Length of the stretch to compare for an item of ``n`` tokens, and the substitutions it may have."""
    w = min(WINDOW, n)
    return w, 0 if n < EXACT_BELOW else w * (100 - PERCENT) // 100


def seeds(n: int) -> list[tuple[int, ...]]:
    """Masks (as picked offsets) of which one fits every allowed stretch of an item of ``n`` tokens."""
    if n >= WINDOW:
        return [tuple(i for i, c in enumerate(m) if c == "1") for m in MASKS]
    _, errors = allowed(n)
    size = n // (errors + 1)  # of so many equal blocks one is untouched
    return [tuple(range(size))]


def _hash(toks: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the picked tokens at each place where the mask fits; masks differ in it."""
    m = len(toks) - mask[-1]
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(m, sum(31 ** i * (o + 1) for i, o in enumerate(mask)) % 2**64, np.uint64)
    for k, off in enumerate(mask):
        acc += toks[off:off + m] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 3)) % 2**64 | 1)
    return (acc ^ (acc >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _runs(h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(hash, first, last place) of hashes that stand unchanged at places next to each other."""
    if len(h):
        cut = np.flatnonzero((h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(h)]]) - 1
        yield from zip(h[first].view(np.int64).tolist(), at[first].tolist(), at[last].tolist())


def _slots(h: np.ndarray, bits: int, probe: int) -> np.ndarray:
    # mixed twice: multiples of one product would have their upper bits in common
    x = (h ^ (h >> np.uint64(32))) * np.uint64(_ODD[probe])
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """``seed``, ``mask``, ``item`` (a text's digest), ``first``, ``last`` for each run of places of the items that count."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for item, text in zip(part["item"], part["text"]):
                t = tokens(text)
                for mask in seeds(len(t)) if len(t) >= LEAST else ():
                    h = _hash(t, mask)
                    rows += [(x, ",".join(map(str, mask)), item, a, b) for x, a, b in _runs(h, np.arange(len(h)))]
            yield pd.DataFrame(rows, columns=["seed", "mask", "item", "first", "last"])

    return benchmark.mapInPandas(run, "seed long, mask string, item string, first int, last int")


def seed_bits(found: DataFrame, n_seeds: int) -> np.ndarray:
    """The bit array of all seeds, gathered in chunks of a fixed size: 16 MB at most, whatever the benchmark's size."""
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * n_seeds).bit_length()))
    width = min(bits, CHUNK)

    @F.pandas_udf("array<long>")
    def slots(x: pd.Series) -> pd.Series:
        h = x.to_numpy().view(np.uint64)
        return pd.Series(np.stack([_slots(h, bits, k) for k in range(PROBES)], axis=1).tolist() if len(h) else [], dtype=object)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << width, bool)
        own[part["slot"].to_numpy() & ((1 << width) - 1)] = True
        return pd.DataFrame({"chunk": part["chunk"].iloc[:1], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    # distinct slots: a chunk has no more of them than bits
    each = found.select("seed").distinct().select(F.explode(slots("seed")).alias("slot")).distinct()
    chunks = each.withColumn("chunk", F.shiftright("slot", width)).groupBy("chunk").applyInPandas(pack, "chunk long, bits binary")
    out = np.zeros((1 << bits - width, (1 << width) // 8), np.uint8)
    for r in chunks.collect():
        out[r.chunk] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _test(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be seeds: each probe looks at those that the ones before left."""
    width = (len(bits) * 8).bit_length() - 1
    p = np.arange(len(h))
    for k in range(PROBES):
        s = _slots(h[p], width, k)
        p = p[(bits[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool)]
    return p


def text_hits(texts: list[str], masks: list[tuple[int, ...]], bits: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each whole text its possible seeds: (seed, first and last place of a run)."""
    docs = [tokens(t) for t in texts]
    sizes = np.array([len(d) for d in docs], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *docs])
    owner, first = np.repeat(np.arange(len(docs)), sizes), np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for mask in masks:
        h = _hash(flat, mask)
        p = _test(bits, h)
        p = p[owner[p] == owner[p + mask[-1]]] if len(p) else p
        for d in np.unique(owner[p]).tolist():
            at = p[np.searchsorted(owner[p], d):np.searchsorted(owner[p], d, "right")]
            out[d] += _runs(h[at], at - first[d])
    return out


def _agreement(doc: np.ndarray, item: np.ndarray, shift: int) -> float:
    """Share of the item's tokens that agree with the document at this alignment, or 0 where no stretch suffices."""
    w, errors = allowed(len(item))
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    if high - low < w:
        return 0.0
    same = np.concatenate([[0], np.cumsum(doc[low + shift:high + shift] == item[low:high])])
    if (same[w:] - same[:-w]).max() < w - errors:
        return 0.0
    return float(same[-1] / len(item))


def best_agreement(doc: np.ndarray, item: np.ndarray, shifts: list[tuple[int, int]]) -> float:
    """The best agreement over alignments, given as ranges of shifts; nothing is better than 1."""
    best, done = 0.0, -(1 << 62)
    for low, high in sorted(shifts):
        for shift in range(max(low, done), high + 1):
            best = max(best, _agreement(doc, item, shift))
            if best == 1.0:
                return best
        done = max(done, high + 1)
    return best


def _dealt(left: DataFrame, right: DataFrame) -> DataFrame:
    """The join of both on ``seed``; a seed with very many pairs is dealt over several keys by its documents."""
    per = right.groupBy("seed").count().withColumnRenamed("count", "r").join(left.groupBy("seed").count().withColumnRenamed("count", "l"), "seed")
    hot = written(per.select("seed", F.ceil(F.col("l") * F.col("r") / SEED_PAIRS).cast("int").alias("keys")).where("keys > 1"), "hot-seeds")
    keys = F.coalesce("keys", F.lit(1))
    left = left.join(hot, "seed", "left").withColumn("key", F.pmod(F.xxhash64("doc"), keys).cast("int")).drop("keys")
    right = right.join(hot, "seed", "left").withColumn("key", F.explode(F.sequence(F.lit(0), keys - 1))).drop("keys")
    return left.join(right, ["seed", "key"])


def overlaps(df: DataFrame, benchmark: DataFrame, *, text: str = "text") -> DataFrame | None:
    """``doc`` (SHA-256 of a text), ``item`` (of an item's text) and ``share`` for each pair that overlaps; None without items."""
    ship(df.sparkSession)
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    items = written(benchmark.select(digest(F.col("text")).alias("item"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["item"]), "items")
    known = written(item_seeds(items), "item-seeds")
    n_seeds = known.count()
    if not n_seeds:
        return None
    masks = sorted(tuple(map(int, r[0].split(","))) for r in known.select("mask").distinct().collect())  # one a kind of length
    held = df.sparkSession.sparkContext.broadcast(seed_bits(known, n_seeds))

    @F.pandas_udf("array<struct<seed:long,first:int,last:int>>")
    def search(texts: pd.Series) -> pd.Series:
        found = [h for part in slices(texts) for h in text_hits(part, masks, held.value)]
        return pd.Series([[{"seed": x, "first": a, "last": b} for x, a, b in f] for f in found], dtype=object)

    body = F.col(f"`{text}`")
    scanned = df.select(body.alias("text"), search(body).alias("hits")).where(F.size("hits") > 0)
    scanned = written(scanned.select(digest(F.col("text")).alias("doc"), F.monotonically_increasing_id().alias("id"), "text", "hits"), "hits")
    # of equal texts one stands for all
    one = scanned.groupBy("doc").agg(F.min("id").alias("id"))
    places = scanned.select("doc", F.explode("hits").alias("h")).select("doc", "h.seed", F.col("h.first").alias("a"), F.col("h.last").alias("b")).distinct()
    pairs = _dealt(written(places, "places"), known.select("seed", "item", "first", "last"))
    shifts = pairs.groupBy("doc", "item").agg(F.collect_set(F.struct((F.col("a") - F.col("last")).alias("low"), (F.col("b") - F.col("first")).alias("high"))).alias("shifts"))
    pairs = written(shifts.join(one, "doc"), "pairs")

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held_tokens = None, None
        for part in parts:
            shares = []
            for doc, a, b, s in zip(part["doc"], part["text"], part["item_text"], part["shifts"]):
                if doc != last:
                    last, held_tokens = doc, tokens(a)
                shares.append(best_agreement(held_tokens, tokens(b), [(int(r["low"]), int(r["high"])) for r in s]))
            part = part[["doc", "item"]].assign(share=shares)
            yield part[part["share"] > 0]

    rows = pairs.join(scanned.select("id", "text"), "id").join(items.select("item", F.col("text").alias("item_text")), "item")
    return written(rows.select("doc", "item", "text", "item_text", "shifts").mapInPandas(verify, "doc string, item string, share double"), "overlaps")


def _found(df: DataFrame, benchmark: DataFrame, text: str) -> DataFrame | None:
    """``doc``, ``ids`` and ``share`` of every distinct text that overlaps with an item."""
    pairs = overlaps(df, benchmark.select("item_id", "text"), text=text)
    if pairs is None:
        return None
    named = benchmark.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("item"), "item_id")
    return written(pairs.join(named, "item").groupBy("doc").agg(F.array_sort(F.collect_set("item_id")).alias("ids"), F.max("share").alias("share")), "contaminated")


def mark_contaminated(df: DataFrame, benchmark: DataFrame, *, text: str = "text", into: str = "contamination") -> DataFrame:
    """``df`` with a struct ``into``: ``contaminated``, ``item_ids`` (sorted), ``best_share``.

    ``benchmark`` has ``item_id`` and ``text``.  A document is contaminated where a
    stretch of 13 tokens, or all of a shorter item, agrees with an item in at least
    80 % of its tokens at the same distances; items of 5 to 7 tokens must occur
    exactly and shorter ones are ignored.  Whole texts are searched; null and empty
    ones are clean.  An item without an id counts but isn't listed; of a repeated item
    each id is listed.  An empty benchmark leaves all documents clean.  Equal texts
    are verified once.  A column named ``into`` is replaced.
    """
    found = _found(df, benchmark, text)
    ids = dict(benchmark.dtypes)["item_id"]
    result = lambda share, listed: F.struct(share.isNotNull().alias("contaminated"), F.coalesce(listed, F.array().cast(f"array<{ids}>")).alias("item_ids"), F.coalesce(share, F.lit(0.0)).alias("best_share"))
    if found is None:
        return df.withColumn(into, result(F.lit(None).cast("double"), F.lit(None).cast(f"array<{ids}>")))
    d, i, s = (free_name(df.columns, c) for c in ("doc__", "ids__", "share__"))
    rows = df.withColumn(d, F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)).join(found.toDF(d, i, s), d, "left")
    return rows.withColumn(into, result(F.col(s), F.col(i))).drop(d, i, s)


def contamination_table(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``contaminated``, ``n_items``, ``item_ids`` and ``best_share`` of every document; see ``mark_contaminated``."""
    out = mark_contaminated(documents.select("doc_id", "text"), benchmark, into="c")
    return out.select("doc_id", "c.contaminated", F.size("c.item_ids").cast("long").alias("n_items"), "c.item_ids", "c.best_share")


def drop_contaminated(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``df``, with its columns, whose ``text`` overlaps with no item; null and empty texts stay."""
    found = _found(df, benchmark, "text")
    if found is None:
        return df
    d = free_name(df.columns, "doc__")
    return df.withColumn(d, F.sha2(F.coalesce("text", F.lit("")), 256)).join(found.select(F.col("doc").alias(d)), d, "left_anti").drop(d)
