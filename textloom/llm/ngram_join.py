"""N-gram Jaccard join: size-aware heavy-light join, and the components of its links.

Small sets are joined by enumerating their subsets of the overlap that a pair of
their sizes needs: sets that share such a subset are linked, so a bucket needs no
pairs, only a link from each member to one other.  Large sets are joined by scanning
inverted lists over prefixes: each set's rarest shingles come first, and two linked
sets share one of them.  The boundary is where enumeration begins to cost more.

In a list every set is first compared with one pivot; only sets that this leaves in
different components are compared further, in bands of like sizes and in blocks where a
list is long.  A pair is made only where bit arrays of the whole sets allow the link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.chunks import turn
from textloom.llm.components import components
from textloom.session import free_name, ship, written

#: Whole sets of up to this size are kept beside the prefixes, so the boundary can be chosen up to it.
SMALL_MAX = 24
#: A shingle in more prefixes than this is frequent and goes behind all others in the order.
FREQUENT = 100
FREQUENT_MOST = 500_000
#: Shingles that are counted at once.
COUNTED_AT_ONCE = 1_000_000
#: A shingle seen once in a batch counts with this weight for one of so many: else it is left out.
SINGLE_WEIGHT = 16
#: 64-bit words of a set's parity bits; comparisons of one block of a long list.
SIG_WORDS = 8
BLOCK_PAIRS = 1_000_000
#: Keys (8 bytes each) that are broadcast at most.
SENT_KEYS = 1_000_000
#: Cost of comparing two sets against that of shuffling a row.
COMPARE_COST = 20.0


class _WordHashes(dict):
    """Hash of each word, kept for words seen of late; cleared when large."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@cache
def _memo() -> _WordHashes:
    return _WordHashes()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Distinct shingles of a text as sorted numbers, longer shingles first.

    Only A-Z are lower-cased; words end at ASCII white space.  A text of fewer than
    ``n`` words has one shingle, all of it; one without words has none.  The upper
    bits hold the length in bytes (a long shingle is rarely frequent), 56 bits a hash.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    memo = _memo()
    turn("ngrams", memo.clear)
    if len(memo) > 200_000:
        memo.clear()
    h = np.array([memo[w] for w in words], np.uint64)
    size = np.array([len(w) for w in words], np.int64)
    k = min(n, len(words))
    m = len(words) - k + 1
    acc, length = np.full(m, k, np.uint64), np.zeros(m, np.int64)
    for i in range(k):
        acc = (acc ^ h[i:i + m]) * np.uint64(0x9FB21C651E98DF25)
        acc ^= acc >> np.uint64(29)
        length += size[i:i + m]
    acc = (acc ^ (acc >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(((127 - np.minimum(length, 127)) << 56) | (acc >> np.uint64(8)).astype(np.int64))


def overlap(a: int, b: int, percent: int) -> int:
    """Least common shingles of linked sets of these sizes: 100 * both >= percent * (a + b - both)."""
    return -(-percent * (a + b) // (100 + percent))


def overlap_col(a: Column, b: Column, percent: int) -> Column:
    return F.ceil((a + b) * percent / (100 + percent) - 1e-9)


def prefix_length(n: int, percent: int) -> int:
    """A linked partner of a set of ``n`` has one of its first so many shingles."""
    return n - -(-percent * n // 100) + 1


def partner_sizes(n: int, percent: int, most: int) -> list[tuple[int, int]]:
    """Sizes up to ``most`` that can be linked with ``n``, each with the overlap needed."""
    out = []
    for m in range(-(-percent * n // 100), min(most, 100 * n // percent) + 1):
        c = overlap(n, m, percent)
        if c <= min(n, m):
            out.append((m, c))
    return out


def boundary(percent: int, partners: float, most: int = SMALL_MAX) -> int:
    """Largest size up to which enumerating subsets costs no more than scanning lists.

    ``partners`` is the mean number of other sets in a prefix shingle's list.
    """
    best = 0
    for n in range(1, most + 1):
        enumerate_rows = sum(comb(n, c) for _, c in partner_sizes(n, percent, most))
        if enumerate_rows > prefix_length(n, percent) * (1 + partners * COMPARE_COST):
            break
        best = n
    return best


def _mixed(tokens: np.ndarray) -> tuple[list[int], list[int]]:
    x = tokens.astype(np.uint64)
    a = (x ^ (x >> np.uint64(31))) * np.uint64(0xA24BAED4963EE407)
    b = (x ^ (x >> np.uint64(27))) * np.uint64(0x9E6F63C7B5A1D7C9)
    return (a ^ (a >> np.uint64(32))).tolist(), (b ^ (b >> np.uint64(29))).tolist()


def subset_rows(doc: int, tokens: np.ndarray, percent: int, most: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(two hash sums, sizes low and high, own size, doc) for each subset that a linked partner would share."""
    n = len(tokens)
    u, v = _mixed(tokens)
    su, sv, top = sum(u), sum(v), 1 << 64
    for m, c in partner_sizes(n, percent, most):
        for out in combinations(range(n), n - c):
            yield (su - sum(u[i] for i in out)) % top - (top >> 1), (sv - sum(v[i] for i in out)) % top - (top >> 1), min(n, m), max(n, m), n, doc


def _frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents have, sorted, with their ranks from the least frequent up; at most FREQUENT_MOST.

    They only decide the order in which a set's shingles are looked at, so any choice
    gives the same links.  Batches count what they see; of shingles seen once in a batch
    a fixed share stands for all, so one that is rare everywhere in a batch but common
    in the corpus is found too.
    """

    def counted(sets: list[np.ndarray]) -> pd.DataFrame:
        toks, counts = np.unique(np.concatenate(sets), return_counts=True)
        once = toks[counts == 1].view(np.uint64)
        drawn = (((once ^ once.sum(dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(SINGLE_WEIGHT) == 0
        counts[counts == 1] = drawn * SINGLE_WEIGHT
        return pd.DataFrame({"tok": toks[counts > 0], "c": counts[counts > 0]})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            held, size = [], 0
            for t in part["text"]:
                held.append(shingles(t, n))
                size += len(held[-1])
                if size >= COUNTED_AT_ONCE:
                    yield counted(held)
                    held, size = [], 0
            if size:
                yield counted(held)

    seen = docs.select("text").mapInPandas(run, "tok long, c long").groupBy("tok").agg(F.sum("c").alias("c")).where(F.col("c") > FREQUENT)
    found = np.array([r[0] for r in seen.orderBy(F.desc("c"), "tok").limit(FREQUENT_MOST).collect()], np.int64)
    order = np.argsort(found)
    return found[order], (len(found) - order).astype(np.int32)


def ordered(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A set's shingles in the global order: as numbered, then the frequent ones from the least frequent up."""
    known, ranks = frequent
    if not len(known) or not len(tokens):
        return tokens
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    often = known[at] == tokens
    last = tokens[often][np.argsort(ranks[at[often]], kind="stable")]
    return np.concatenate([tokens[~often], last])


def signature(tokens: np.ndarray) -> np.ndarray:
    """Parity bits of a set: each shingle turns one over, so two sets differ in at least as many shingles as bits."""
    at = ((tokens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - (64 * SIG_WORDS - 1).bit_length())).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=64 * SIG_WORDS).astype(np.uint8) & 1).view(np.int64)


def _bits_allow(percent: int, a: tuple[str, str], b: tuple[str, str]) -> Column:
    """False only where the signatures of two sets (columns of size and bits) differ too much for a link."""
    differ = sum((F.bit_count(F.get(a[1], F.lit(i)).bitwiseXOR(F.get(b[1], F.lit(i)))) for i in range(SIG_WORDS)), F.lit(0))
    na, nb = F.col(a[0]), F.col(b[0])
    return differ <= na + nb - 2 * overlap_col(na, nb, percent)


def _scan(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Size, fingerprint of the set, its prefix (small sets: the set) and its signature for every row; keys stay with Spark."""
    held = docs.sparkSession.sparkContext.broadcast(_frequent(docs, n))

    @F.pandas_udf("n long, fp binary, head array<long>, sig array<long>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = shingles(t, n)
            rows.append((len(s), hashlib.md5(s.tobytes(), usedforsecurity=False).digest(), ordered(s, held.value)[:max(SMALL_MAX, prefix_length(len(s), percent))].copy(), signature(s)))
        return pd.DataFrame(rows, columns=["n", "fp", "head", "sig"])

    return docs.select("doc_id", scan("text").alias("s")).select("doc_id", "s.n", "s.fp", "s.head", "s.sig")


def _small_links(sets: DataFrame, percent: int, most: int) -> DataFrame:
    """Links between sets of up to ``most`` shingles; a member of a bucket is linked with one of each other size."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [r for d, s in zip(part["doc"], part["head"]) for r in subset_rows(int(d), np.asarray(s, np.int64), percent, most)]
            yield pd.DataFrame(rows, columns=["u", "v", "low", "high", "size", "doc"])

    key = ["u", "v", "low", "high"]
    rows = written(sets.where(F.col("n") <= most).select("doc", "head").mapInPandas(run, "u long, v long, low long, high long, size long, doc long"), "subsets")
    least = lambda side: F.min(F.when(F.col("size") == F.col(side), F.col("doc")))
    # both sides have the subset in common, so any member of one size is linked with any of the other
    tops = rows.groupBy(*key).agg(least("low").alias("low_doc"), least("high").alias("high_doc"), F.count("*").alias("c")).where("c > 1 AND low_doc IS NOT NULL AND high_doc IS NOT NULL").drop("c")
    return rows.join(tops, key).select(F.col("doc").alias("a"), F.when(F.col("size") == F.col("low"), F.col("high_doc")).otherwise(F.col("low_doc")).alias("b")).where("a <> b").distinct()


def _prefixes(sets: DataFrame, percent: int, least: int) -> DataFrame:
    """``tok``, ``doc``, ``n``, ``pos`` of every prefix of the sets of at least ``least`` shingles."""
    head = F.slice("head", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1).cast("int"))
    return sets.where(F.col("n") >= least).select("doc", "n", F.posexplode(head).alias("pos", "tok"))


def _can_link(percent: int, a: str = "", b: str = "o_") -> Column:
    """Size and position bounds for two entries of one list."""
    na, nb, pa, pb = (F.col(x) for x in (f"{a}n", f"{b}n", f"{a}pos", f"{b}pos"))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (F.least(na - pa, nb - pb) >= overlap_col(na, nb, percent))


def _sent(keys: DataFrame) -> DataFrame:
    """A table of distinct keys, sent to all executors where it has been counted to be small, else left to a shuffle join."""
    return F.broadcast(keys) if keys.count() <= SENT_KEYS else keys


def _docs_of(pairs: DataFrame) -> DataFrame:
    return written(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "ids")


def _plausible(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs that their heads don't rule out.

    Of two heads one ends first in the order; whatever it has that the other lacks is
    in that set alone.  The looser of the two bounds this gives on the common shingles
    holds in any case, also where shortened shingles collide.
    """
    short = F.transform("head", lambda x: F.pmod(x, F.lit(1 << 31)).cast("int"))
    pairs = written(pairs, "candidates")
    heads = sets.join(_sent(_docs_of(pairs)), "doc", "left_semi").select("doc", "n", short.alias("h"), "sig")
    of = lambda side: heads.select(F.col("doc").alias(side), F.col("n").alias(f"n{side}"), F.col("h").alias(f"h{side}"), F.col("sig").alias(f"s{side}"))
    # array_except counts those that collide within a head once, which only loosens the bounds
    most = F.greatest(F.col("na") - F.size(F.array_except("ha", "hb")), F.col("nb") - F.size(F.array_except("hb", "ha")))
    both = pairs.join(of("a"), "a").join(of("b"), "b").where(_bits_allow(percent, ("na", "sa"), ("nb", "sb")))
    return both.where(most >= overlap_col(F.col("na"), F.col("nb"), percent)).select("a", "b").distinct()


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose whole sets reach the threshold."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for part in parts:
            good = []
            for ta, tb in zip(part["ta"], part["tb"]):
                if held is None or ta != last:  # rows of one pivot come together
                    last, held = ta, shingles(ta, n)
                other = shingles(tb, n)
                both = len(np.intersect1d(held, other, assume_unique=True))
                good.append(bool(len(held)) and 100 * both >= percent * (len(held) + len(other) - both))
            yield part.loc[good, ["a", "b"]]

    pairs = written(_plausible(sets, pairs, percent), "pairs")
    texts = written(docs.join(_sent(_docs_of(pairs)), "doc", "left_semi"), "texts")
    rows = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a")
    return written(rows.mapInPandas(run, "a long, b long").distinct(), "links")


def _large_links(docs: DataFrame, sets: DataFrame, small: DataFrame, n: int, percent: int, most: int) -> DataFrame:
    """Links with at least one set above ``most``, enough of them for the components."""
    lists = _prefixes(sets, percent, -(-percent * (most + 1) // 100))
    first = F.min(F.struct("pos", "doc", "n"))
    opened = lambda df: df.select("tok", "doc", "n", "pos", F.col("pivot.doc").alias("o_doc"), F.col("pivot.n").alias("o_n"), F.col("pivot.pos").alias("o_pos"))
    large = (F.col("n") > most) | (F.col("o_n") > most)
    named = lambda df: df.select(F.col("o_doc").alias("a"), F.col("doc").alias("b"))
    # lists of one are done with
    shared = lists.groupBy("tok").agg(first.alias("pivot"), F.count("*").alias("c")).where("c > 1").drop("c")
    listed = written(opened(lists.join(shared, "tok")), "lists")
    pairs = named(listed.where((F.col("doc") != F.col("o_doc")) & large & _can_link(percent))).distinct()
    links = _verified(docs, sets, pairs, n, percent)
    open_lists = listed.select("tok", "doc", "n", "pos")
    for last in (False, True):
        comp = components(links.union(small))
        at = open_lists.join(comp.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
        # lists that are within one component are done with; so is an entry that no size in its list could be linked with
        state = at.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least_n"), F.min(F.struct("pos", "doc", "n", "comp")).alias("main")).where("lo <> hi")
        fewest = F.greatest(F.col("least_n"), F.ceil(F.col("n") * percent / 100 - 1e-9))
        alive = at.join(state, "tok").where(F.col("n") - F.col("pos") >= overlap_col(F.col("n"), fewest, percent))
        alive = written(alive.select("tok", "doc", "n", "pos", "comp", F.col("main.comp").alias("main")), "alive")
        open_lists = alive.select("tok", "doc", "n", "pos")
        rest = alive.where("comp <> main")
        if not last:  # a second pivot among those that the first has not reached
            second = rest.groupBy("tok").agg(first.alias("pivot"), F.min_by("comp", F.struct("pos", "doc")).alias("o_comp"))
            pairs = named(_with_pivot(alive.join(second, "tok")).where((F.col("comp") != F.col("o_comp")) & large & _can_link(percent))).distinct()
        else:
            pairs = named(_left_pairs(sets, alive, percent).where(large & _can_link(percent))).distinct()
        links = written(links.union(_verified(docs, sets, pairs, n, percent)).distinct(), "links")
    return links


def _left_pairs(sets: DataFrame, alive: DataFrame, percent: int) -> DataFrame:
    """Pairs of entries of one list whose components differ and whose signatures allow a link.

    Linked sets are in the same or neighbouring bands of size.  A long list is dealt
    over a grid of blocks, so no task has all of it.
    """
    per = alive.groupBy("tok").agg(F.greatest(F.lit(1), F.ceil(F.sqrt(F.count("*") * F.count_if(F.col("comp") != F.col("main")) / BLOCK_PAIRS)).cast("int")).alias("blocks"))
    bits = sets.join(_sent(written(alive.select("doc").distinct(), "ids")), "doc", "left_semi").select("doc", "sig")
    # a little wider than the ratio of linked sizes, so rounding can't move one a band further
    band = (F.floor(F.log("n") / F.log(F.lit(100.1 / percent))) if percent < 100 else F.col("n")).cast("long")
    entries = alive.join(per, "tok").join(bits, "doc").withColumn("band", band)
    own, each = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"), F.explode(F.expr("sequence(0, blocks - 1)"))
    rest = entries.where("comp <> main").withColumn("i", own).withColumn("j", each).withColumn("near", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])))
    rest = rest.select("tok", "i", "j", "near", "doc", "n", "pos", "comp", "main", "sig")
    other = entries.withColumn("j", own).withColumn("i", each).select("tok", "i", "j", F.col("band").alias("near"), *[F.col(c).alias(f"o_{c}") for c in ("doc", "n", "pos", "comp", "sig")])
    once = (F.col("o_comp") == F.col("main")) | (F.col("o_doc") < F.col("doc"))
    return rest.join(other, ["tok", "i", "j", "near"]).where((F.col("comp") != F.col("o_comp")) & once & _bits_allow(percent, ("n", "sig"), ("o_n", "o_sig")))


def _with_pivot(df: DataFrame) -> DataFrame:
    return df.select("tok", "doc", "n", "pos", "comp", "o_comp", F.col("pivot.doc").alias("o_doc"), F.col("pivot.n").alias("o_n"), F.col("pivot.pos").alias("o_pos"))


def jaccard_components(df: DataFrame, *, n: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", most: int | None = None) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``df``.

    Two texts are linked when 100 * common >= ``percent`` * united shingles; a
    component has the smallest key reachable by links.  Texts with equal sets are one
    class, and only classes are joined.  A text without words (null, empty, blank) has
    size 0 and stands alone.  Rows without a key share the component of equal sets but
    form no other links; it is null where no such row has a key.  Rows that share a
    key count as one document.  ``most`` sets the boundary; by default cost does.
    """
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    scanned = written(_scan(docs, n, percent), "sets")
    keyed = docs.where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "doc")
    classes = written(scanned.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc")), "classes")
    sets = scanned.join(classes.withColumnRenamed("doc", "doc_id"), ["fp", "doc_id"]).select(F.col("doc_id").alias("doc"), "n", "head", "sig")
    if most is None:
        # other sets in a list, over the shingles of the small sets: their number and their lists'
        spread = sets.where(F.col("n") <= SMALL_MAX).select(F.explode("head").alias("tok")).groupBy("tok").count()
        mean = spread.agg(F.sum(F.col("count") * (F.least("count", F.lit(FREQUENT)) - 1)) / F.sum("count")).first()[0] or 0.0
        most = boundary(percent, float(mean))
    small = written(_small_links(sets, percent, most), "small-links")
    comp = components(_large_links(keyed, sets, small, n, percent, most).union(small))
    named = classes.join(comp.withColumnRenamed("node", "doc"), "doc", "left").select("fp", F.coalesce("comp", "doc").alias("component"))
    out = scanned.where("n > 0").join(named, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.unionByName(scanned.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(df: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` whose key is their component's; of rows that repeat that key one stays.

    Rows without a key stay only where no row with an equal set has one.
    """
    names = jaccard_components(df, n=n, percent=percent)
    id_ = free_name(df.columns, "gone__")
    gone = names.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(id_)).distinct()
    left = df.join(gone, F.col("doc_id").eqNullSafe(F.col(id_)), "left_anti")
    again = names.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    return left.dropDuplicates(["doc_id"]) if again.head(1) else left
