"""Runs of words: suffix array, longest previous factors, Main's extensions, copying.

A run is a maximal stretch of words with a smallest period.  Texts are taken in slices
and all steps but two work on whole numpy arrays of a slice:

1.  Words become numbers.  A run of ``exponent`` periods has each of its words that often,
    so words that are rarer within a stretch cut it, until none is left: a run and the
    words next to it lie within one stretch, or the neighbour is no part of any run.
2.  Prefix doubling names all blocks of 1, 2, 4, ... words.  The last names are the
    suffix array; the names give the longest common prefix, or suffix, of any two places
    by halving steps, and so the LCP array.
3.  Two stack passes over suffix and LCP array give the longest previous factor (LPF) of
    each place and where it occurs before; following it gives the LZ blocks.
4.  Every run touches the start of a block, or is the inner part of one (Main; Kolpakov and
    Kucherov).  Of those that touch a start ``b`` all but the first period is shorter than
    the blocks on both sides; they are found by extending to the left and right the
    places ``b`` and ``b + p``, or ``b - p`` and ``b``, for all periods ``p`` that leaves.
5.  Inner runs are copied from the block's earlier occurrence, in the order of their
    starts from buckets of runs by start.

No step sees two texts at once, and a row's work depends on its text alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DataType

from textloom.session import free_name, ship

#: Words of one slice, and pairs of places that are extended at once (a longer text is a slice of its own).
SLICE_WORDS, PAIRS = 200_000, 400_000
RUNS = "array<struct<start:long,length:long,period:long>>"
Run = tuple[int, int, int]


def stretches(words: np.ndarray, text: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose words may be part of a run, and the number of their stretch.

    ``words`` are numbers, -1 for a word that is no part of a run; ``text`` ascends.
    A stretch has ``least`` words or more, and each of its words ``exponent`` times.
    """
    at = np.flatnonzero(words >= 0)
    while True:
        if not len(at):
            return at, at
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(at) > 1) | (np.diff(text[at]) > 0)
        stretch = np.cumsum(fresh) - 1
        keys = stretch * (words.max() + 1) + words[at]
        order = np.argsort(keys, kind="stable")
        edges = np.flatnonzero(np.diff(keys[order], prepend=-1))
        often = np.empty(len(at), np.int64)
        often[order] = np.repeat(np.diff(edges, append=len(at)), np.diff(edges, append=len(at)))
        ok = (often >= exponent) & (np.bincount(stretch)[stretch] >= least)
        if ok.all():
            return at, stretch
        at = at[ok]


def block_names(words: np.ndarray, stretch: np.ndarray) -> list[np.ndarray]:
    """Names of the blocks of 1, 2, 4, ... words at each place: equal names are equal blocks of one stretch.

    A name is the place of the first such block in sorted order, so the last names, which
    are all different, are the ranks of the suffixes.  A block that the stretch's end
    cuts short has a name of its own.
    """
    n = len(words)
    end = np.flatnonzero(np.diff(stretch, append=-1))[stretch] + 1  # end of each place's stretch
    first = stretch * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(first, kind="stable")
    heads = np.flatnonzero(np.diff(first[order], prepend=-1))
    name = np.empty(n, np.int32)
    name[order] = np.repeat(heads, np.diff(heads, append=n))
    names, size = [name], 1
    while True:
        count = np.bincount(name, minlength=n)
        open_ = np.flatnonzero(count[name] > 1)
        if not len(open_):
            return names
        after = np.full(len(open_), -1, np.int64)
        inside = open_ + size < end[open_]
        after[inside] = name[open_[inside] + size]
        old = name[open_].astype(np.int64)
        keys = old * (n + 1) + after + 1
        order = np.argsort(keys, kind="stable")
        group = np.flatnonzero(np.diff(old[order], prepend=-1))
        head = np.diff(keys[order], prepend=-1) != 0
        place = np.arange(len(order)) - np.repeat(group, np.diff(group, append=len(order)))
        at = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
        name = name.copy()
        name[open_[order]] = old[order] + place[at]
        names.append(name)
        size *= 2


def common_prefix(names: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Words that the suffixes at different places ``x`` and ``y`` have in common; a place at the end has none."""
    n, out = len(names[0]), np.zeros(len(x), np.int64)
    for k in range(len(names) - 1, -1, -1):
        a, b = x + out, y + out
        inside = (a < n) & (b < n)
        same = np.zeros(len(x), bool)
        same[inside] = names[k][a[inside]] == names[k][b[inside]]
        out[same] += 1 << k
    return out


def common_suffix(names: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Words in common before different places ``x`` and ``y``."""
    out = np.zeros(len(x), np.int64)
    for k in range(len(names) - 1, -1, -1):
        a, b = x - out - (1 << k), y - out - (1 << k)
        inside = (a >= 0) & (b >= 0)
        same = np.zeros(len(x), bool)
        same[inside] = names[k][a[inside]] == names[k][b[inside]]
        out[same] += 1 << k
    return out


def previous_factors(suffixes: np.ndarray, lcp: np.ndarray) -> tuple[list[int], list[int]]:
    """The longest factor at each place that also begins at an earlier place, and such a place (-1: none)."""
    n = len(suffixes)
    length, source = [0] * n, [-1] * n
    places, shared = suffixes.tolist(), lcp.tolist()
    for order, common in ((range(n), shared), (range(n - 1, -1, -1), [*shared[1:], 0])):
        # a stack of places that ascend, each with what it has in common with the one below it
        stack: list[tuple[int, int]] = []
        for r in order:
            p, least = places[r], common[r]
            while stack and stack[-1][0] > p:
                least = min(least, stack.pop()[1])
            if stack and least > length[p]:
                length[p], source[p] = least, stack[-1][0]
            stack.append((p, least))
    return length, source


def blocks(length: list[int], ends: np.ndarray) -> list[int]:
    """Starts of the LZ blocks of all stretches, and the end of the last; stretches end at ``ends``."""
    starts, b, n = [], 0, int(ends[-1])
    while b < n:  # a factor never crosses a stretch's end
        starts.append(b)
        b += length[b] or 1
    return [*starts, n]


def find_runs(words: np.ndarray, text: np.ndarray, exponent: int, least: int) -> list[tuple[int, Run]]:
    """All runs of ``exponent`` periods and ``least`` words or more: text, and start (place in the slice), length, period."""
    at, stretch = stretches(words, text, exponent, least)
    if not len(at):
        return []
    words, n = words[at], len(at)
    names = block_names(words, stretch)
    suffixes = np.empty(n, np.int64)
    suffixes[names[-1]] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    lcp[1:] = common_prefix(names, suffixes[:-1], suffixes[1:])
    length, source = previous_factors(suffixes, lcp)
    ends = np.flatnonzero(np.diff(stretch, append=-1)) + 1
    starts = blocks(length, ends)
    found: list[dict[int, int] | None] = [None] * n  # by start: smallest period of each end
    for s, e, p in _touching(names, np.array(starts), stretch, exponent, least):
        here = found[s] = found[s] or {}
        here[e] = min(p, here.get(e, p))
    for b, e in zip(starts, starts[1:]):
        if e - b > least:
            back = b - source[b]
            for s in range(b + 1, e):
                if from_ := found[s - back]:
                    for t, p in from_.items():
                        if t + back < e:
                            here = found[s] = found[s] or {}
                            here[t + back] = min(p, here.get(t + back, p))
    return [(int(text[at[s]]), (int(at[s]), e - s, p)) for s, of in enumerate(found) if of for e, p in of.items()]


def _touching(names: list[np.ndarray], starts: np.ndarray, stretch: np.ndarray, exponent: int, least: int) -> Iterator[Run]:
    """Start, end and period of the runs that touch the start of a block, or the end of the last one; periods may be multiples."""
    n, size = len(stretch), np.diff(starts)
    last = np.append(size, 0)  # length of the block at each boundary
    before = np.insert(size, 0, 0)  # and of the one before it
    # such a run ends in the block behind the boundary, and from its second period on it lies behind the start of the block before
    longest = (before + last) // (exponent - 1)
    for side, most in ((1, np.minimum(longest, last)), (-1, np.minimum(longest, starts))):
        bounds = np.cumsum(most)
        k = 0
        while k < len(starts):
            done = bounds[k - 1] if k else 0
            to = max(k + 1, int(np.searchsorted(bounds, done + PAIRS, side="right")))
            many = most[k:to]
            b = np.repeat(starts[k:to], many)
            p = np.arange(len(b)) - np.repeat(np.cumsum(many) - many, many) + 1
            other = b + side * p
            inside = (other < n) if side > 0 else (other >= 0)
            b, p, other = b[inside], p[inside], other[inside]
            # names tell stretches apart, but for what ends at a boundary between two
            right, left = common_prefix(names, b, other), common_suffix(names, b, other)
            s, e = np.minimum(b, other) - left, np.maximum(b, other) + right
            ok = e - s >= np.maximum(least, exponent * p)
            yield from zip(s[ok].tolist(), e[ok].tolist(), p[ok].tolist())
            k = to


def runs_of(texts: list[list[bytes]], exponent: int, least: int) -> list[list[Run]]:
    """Runs of each text, a list of words: start, length and period, by start, then period."""
    out: list[list[Run]] = [[] for _ in texts]
    offsets = np.cumsum([0, *map(len, texts)])
    numbers = np.full(offsets[-1], -1, np.int64)
    for k, words in enumerate(texts):
        if len(words) >= least:
            often = {w: i for i, w in enumerate(w for w, c in Counter(words).items() if c >= exponent)}
            if often:
                numbers[offsets[k] : offsets[k + 1]] = np.fromiter(map(often.get, words, repeat(-1)), np.int64, len(words))
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    for k, (s, n, p) in find_runs(numbers, text, exponent, least):
        out[k].append((s - int(offsets[k]), n, p))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words without those that repeat: of each run its first period stays, unless another run drops it."""
    if not found:
        return words
    gone = bytearray(len(words))
    for s, n, p in found:
        gone[s + p : s + n] = b"\1" * (n - p)
    return [w for w, g in zip(words, gone) if not g]


def planted(words: list[bytes], h: int | None) -> list[bytes]:
    """Words of a row with the checksum ``h``: of every tenth row the end repeats a part of it."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _slices(rows: Iterator[tuple[bytes | None, int | None]]) -> Iterator[list[list[bytes]]]:
    held, n = [], 0
    for text, h in rows:
        held.append(planted((text or b"").split(), h))  # splits at ASCII white space
        n += len(held[-1])
        if n >= SLICE_WORDS:
            yield held
            held, n = [], 0
    if held:
        yield held


def detect_runs(df: DataFrame, *, text: str = "text", exponent: int = 4, least: int = 6, plant: str | None = None) -> DataFrame:
    """``df`` with ``runs`` (array of start, length, period: words, from 0, by start, then period) and ``collapsed``.

    Words are separated by ASCII white space.  A run is a stretch of at least ``least``
    words and ``exponent`` (2 or more) smallest periods that no neighbouring word extends.
    ``collapsed`` has the words joined by one space, of each run its first period only.
    A null or empty text has no runs and collapses to the empty text.  ``plant``: a column of
    checksums by which ``planted`` changes the words first.  Rows are not moved; columns
    named like a result are replaced.
    """
    if exponent < 2:
        raise ValueError("a run has two periods or more")
    ship(df.sparkSession)
    keep = [c for c in df.columns if c.lower() not in ("runs", "collapsed")]
    t, h = free_name(df.columns, "text__"), free_name(df.columns, "plant__")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            rows = zip((x.as_py() for x in batch.column(t)), (x.as_py() for x in batch.column(h)))
            found, short = [], []
            for part in _slices(rows):
                for words, runs in zip(part, runs_of(part, exponent, least)):
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                    short.append(b" ".join(collapse(words, runs)))
            kept = [batch.column(c) for c in keep]
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, kind), pa.array(short, pa.binary())], [*keep, "runs", "collapsed"])

    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias(t), (F.col(f"`{plant}`").cast("long") if plant else F.lit(None).cast("long")).alias(h))
    schema = source.drop(t, h).schema.add("runs", DataType.fromDDL(RUNS)).add("collapsed", "binary")
    return source.mapInArrow(batches, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def runs_table(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, number of runs, the longest one and digests of the runs and of the collapsed text, for every row.

    Rows are changed by ``planted`` before, with the checksum of the key in decimal; a null
    key has none.  Of longest runs the first is shown, of those the one with the smallest
    period; without a run its columns are null.
    """
    rows = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.crc32(F.col(f"`{key}`").cast("string").cast("binary")).alias("h"))
    found = detect_runs(rows, plant="h")
    # of structs the greatest: longest, then first, then smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
