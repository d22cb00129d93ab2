"""Byte-level BPE: DuckDB recursive queries per partition.

Each distinct word of a slice of texts becomes rows (word, position, token).  A
recursive query joins neighbouring rows with the merge table and contracts each
word's leftmost pair of the smallest rank until no pair is left; an ordered
aggregation over the surviving rows gives the ids.  Decoding knows ids only: they are
joined with the vocabulary and put together by another ordered aggregation.

A long word is cut into overlapping windows, which are words of the same query.  Two
windows are put together at a token that both have at the same place.  A sequence of
tokens is a word's encoding if each two neighbours are the encoding of their own bytes:
the first merge that crossed a border between tokens would cross it there, too.  Here
all neighbours come from one window's encoding, so the whole is exact, and its cost
grows with the word's length.  Windows that share no token are widened.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from textloom.llm.chunks import ChunkCache, slices, turn
from textloom.session import free_name, ship

#: Bytes of a word that is taken whole; longer ones become windows of so many bytes, a step apart.
WINDOW, STEP = 64, 32
#: Rows of all rounds, and words, that one query has at most; ids that one query decodes.
ROWS_A_QUERY, WORDS_A_QUERY, IDS_A_QUERY = 1_000_000, 10_000, 50_000
#: Words whose ids a worker keeps, in each of two generations (about 200 bytes each), and as many whose bytes it keeps.
KEEP = 800_000
SLICE_CHARS = 2_000_000
DATABASE = "150MB"

#: x and y are 256 * word + position, of a token and of the one behind it.  The smallest k of
#: a word names its pair: rank of the merge, both positions and the one behind, 8 bits each.
_ENCODE = """
WITH RECURSIVE step(x, y, t, round) AS (
  SELECT x::INTEGER, (x + 1)::INTEGER, t::INTEGER, 0::INTEGER FROM bytes
  UNION ALL
  (WITH best AS (
     SELECT a.x >> 8 AS w, min((m.id::BIGINT << 24) + ((a.x & 255) << 16) + ((b.x & 255) << 8) + (b.y & 255)) AS k
     FROM step a JOIN step b ON a.y = b.x JOIN merges m ON m.pair = (a.t::BIGINT << 32) + b.t GROUP BY w)
   SELECT s.x, (CASE WHEN s.x & 255 = (k >> 16) & 255 THEN (w << 8) + (k & 255) ELSE s.y END)::INTEGER, (CASE WHEN s.x & 255 = (k >> 16) & 255 THEN k >> 24 ELSE s.t END)::INTEGER, s.round + 1
   FROM step s JOIN best ON s.x >> 8 = w WHERE s.x & 255 <> (k >> 8) & 255)
), last AS (SELECT x >> 8 AS w, max(round) AS round FROM step GROUP BY w)
SELECT l.w, string_agg(v.id_hex, '' ORDER BY s.x) AS ids
FROM step s JOIN last l ON s.x >> 8 = l.w AND s.round = l.round JOIN vocab v ON v.id = s.t
GROUP BY l.w ORDER BY l.w
"""

#: The same for one wide window, of which only the last state is kept: a row is replaced by
#: its place, and a token that was merged into the one before it has t = -1.
_ENCODE_WIDE = """
WITH RECURSIVE step(x, y, t) USING KEY (x) AS (
  SELECT x::BIGINT, (x + 1)::BIGINT, t::BIGINT FROM bytes
  UNION
  (WITH live AS (SELECT * FROM recurring.step WHERE t >= 0),
   best AS (
     SELECT a.x, b.x AS mid, b.y AS past, m.id FROM live a JOIN live b ON a.y = b.x JOIN merges m ON m.pair = (a.t << 32) + b.t ORDER BY m.id, a.x LIMIT 1)
   SELECT x, past, id FROM best UNION ALL SELECT mid, past, -1 FROM best))
SELECT string_agg(v.id_hex, '' ORDER BY x) AS ids FROM step JOIN vocab v ON v.id = t
"""

_DECODE = """
SELECT d, string_agg(v.hex, '' ORDER BY p) AS decoded, count(v.id) = count(*) AS known FROM pieces LEFT JOIN vocab v ON v.id = pieces.id GROUP BY d ORDER BY d
"""


class WordCoder:
    """Encoder and decoder of words for one vocabulary file of ranks."""

    def __init__(self, path: str, pattern: str, keep: int = KEEP):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.known = ChunkCache(self.words, keep)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.size = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.size[list(self.ranks.values())] = list(map(len, self.ranks))
        self.bytes_of = ChunkCache(self._decoded, keep)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": DATABASE, "temp_directory": "", "preserve_insertion_order": False})
        pairs = np.array([(self.ranks[a], self.ranks[b], i) for t, i in self.ranks.items() for c in range(1, len(t)) if (a := t[:c]) in self.ranks and (b := t[c:]) in self.ranks], np.int64).reshape(-1, 3)
        known = pa.table({"id": pa.array(self.ranks.values(), pa.int64()), "hex": [t.hex() for t in self.ranks], "id_hex": [i.to_bytes(4, "little").hex() for i in self.ranks.values()]})
        merges = pa.table({"pair": (pairs[:, 0] << 32) + pairs[:, 1], "id": pairs[:, 2]})
        for name, rows, columns in (("merges", merges, "pair"), ("vocab", known, "hex, id_hex")):
            self.con.register("rows", rows)
            self.con.execute(f"CREATE TABLE {name} AS SELECT id::INTEGER AS id, {columns} FROM rows")
            self.con.unregister("rows")

    def _run(self, query: str, name: str, rows: pa.Table) -> pa.Table:
        self.con.register(name, rows)
        try:
            return self.con.sql(query).to_arrow_table()
        finally:
            self.con.unregister(name)

    def words(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits each) of each word."""
        words = list(map(str.encode, words))
        # a word that is a token is that token, whether or not merges lead to it
        out = {w: i.to_bytes(4, "little") for w in words if (i := self.ranks.get(w)) is not None}
        rest = {w for w in words if w not in out}
        out.update(self._whole(w for w in rest if len(w) <= WINDOW))
        for w in rest:
            if w not in out:
                out[w] = self._long(w)
        return [out[w] for w in words]

    def _whole(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids that merges make of words of at most ``WINDOW`` bytes."""
        out: dict[bytes, bytes] = {}
        todo = sorted(words, key=len)
        for part in _portions(todo, ROWS_A_QUERY, lambda w: max(len(w) * (len(w) + 1) // 2, ROWS_A_QUERY // WORDS_A_QUERY)):
            lengths = np.array([len(w) for w in part])
            word = np.repeat(np.arange(len(part)), lengths)
            place = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            got = self._run(_ENCODE, "bytes", pa.table({"x": (word << 8) + place, "t": self.byte_ids[np.frombuffer(b"".join(part), np.uint8)]}))
            out.update(zip(part, map(bytes.fromhex, got["ids"].to_pylist())))
        return out

    def _wide(self, window: bytes) -> bytes:
        """Ids of a window of any size."""
        rows = pa.table({"x": np.arange(len(window)), "t": self.byte_ids[np.frombuffer(window, np.uint8)]})
        return bytes.fromhex(self._run(_ENCODE_WIDE, "bytes", rows)["ids"][0].as_py())

    def _tokens(self, ids: bytes, start: int) -> list[tuple[int, int]]:
        """Place and id of each token of a window that begins at ``start``."""
        ids = np.frombuffer(ids, "<u4")
        size = self.size[ids]
        return list(zip((np.cumsum(size) - size + start).tolist(), ids.tolist()))

    def _long(self, word: bytes) -> bytes:
        """Ids of a word of more than ``WINDOW`` bytes, from windows put together at tokens that they share."""
        starts = range(0, len(word) - WINDOW + STEP, STEP)
        coded = self._whole({word[s : s + WINDOW] for s in starts})
        wide: dict[bytes, bytes] = {}  # a word that repeats itself has few different windows
        out, now, k = [], self._tokens(coded[word[:WINDOW]], 0), 1
        while k < len(starts):
            s = starts[k]
            if (joined := _joined(now, self._tokens(coded[word[s : s + WINDOW]], s), k + 1 == len(starts))) is not None:
                done, now = joined
                out += done
                k += 1
                continue
            # no token in common: a wider window from the middle of what is known
            first, size = now[len(now) // 2][0], WINDOW
            while True:
                size *= 4
                window = word[first : first + size]
                if window not in wide:
                    wide[window] = self._wide(window)
                last = first + size >= len(word)
                joined = _joined(now, self._tokens(wide[window], first), last)
                if joined is not None and (last or joined[1][-1][0] > s + STEP):
                    break
                if last:
                    return self._wide(word)
            done, now = joined
            out += done
            k = len(starts) if last else max(k, (now[-1][0] - STEP) // STEP)
        return np.array([i for _, i in out + now], "<u4").tobytes()

    def decode(self, sequences: list[np.ndarray | None]) -> list[bytes | None]:
        """Bytes of each sequence of ids; None where it is None or has an id that isn't in the vocabulary."""
        cut = [(k, s[i : i + IDS_A_QUERY]) for k, s in enumerate(sequences) if s is not None for i in range(0, len(s), IDS_A_QUERY)]
        out: list[list[bytes] | None] = [None if s is None else [] for s in sequences]
        for part in _portions(cut, IDS_A_QUERY, lambda p: len(p[1])):
            ids = np.concatenate([np.asarray(p[1], np.int64) for p in part])
            got = self._run(_DECODE, "pieces", pa.table({"d": np.repeat(np.arange(len(part)), [len(p[1]) for p in part]), "p": np.arange(len(ids)), "id": ids}))
            for (k, _), text, known in zip(part, got["decoded"].to_pylist(), got["known"].to_pylist()):
                if not known:
                    out[k] = None
                elif out[k] is not None:
                    out[k].append(bytes.fromhex(text))
        return [None if x is None else b"".join(x) for x in out]

    def _decoded(self, words: list[bytes]) -> list[bytes]:
        """Bytes of the ids of whole words."""
        out: list[bytes] = []
        for part in _portions(words, 4 * IDS_A_QUERY, len):
            if len(part) == 1:  # perhaps a long one
                out += self.decode([np.frombuffer(part[0], "<u4")])
                continue
            ids = np.frombuffer(b"".join(part), "<u4")
            got = self._run(_DECODE, "pieces", pa.table({"d": np.repeat(np.arange(len(part)), np.fromiter(map(len, part), np.int64, len(part)) // 4), "p": np.arange(len(ids)), "id": ids}))
            out += map(bytes.fromhex, got["decoded"].to_pylist())
        return out

    def coded(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of each whole text, and the bytes decoded from them word by word."""
        split = list(map(self.pattern.findall, texts))
        distinct = set().union(*split)
        long = {w for w in distinct if len(w) > WINDOW}  # those aren't kept
        known = self.known.need(distinct - long)
        back = self.bytes_of.need(map(known.__getitem__, distinct - long))
        for words in split:
            if long and not long.isdisjoint(words):
                ids = [known[w] if w not in long else self.words([w])[0] for w in words]
                yield b"".join(ids), b"".join(back[i] if w not in long else self._decoded([i])[0] for w, i in zip(words, ids))
            else:
                ids = list(map(known.__getitem__, words))
                yield b"".join(ids), b"".join(map(back.__getitem__, ids))


def _joined(now: list[tuple[int, int]], then: list[tuple[int, int]], last: bool) -> tuple[list[tuple[int, int]], list[tuple[int, int]]] | None:
    """Two windows' tokens put together at the first that they share: what comes up to it, and what is behind it in the second."""
    place = {token: i for i, token in enumerate(now)}
    for j, token in enumerate(then):
        if (i := place.get(token)) is not None and (last or j + 1 < len(then)):
            return now[: i + 1], then[j + 1 :]
    return None


def _portions(items: list, limit: int, size: Callable) -> Iterator[list]:
    """Runs of items of at most ``limit`` in all (or one item of more)."""
    held, n = [], 0
    for x in items:
        if held and n + size(x) > limit:
            yield held
            held, n = [], 0
        held.append(x)
        n += size(x)
    if held:
        yield held


@cache
def _worker(path: str, pattern: str, keep: int = KEEP) -> WordCoder:
    return WordCoder(path, pattern, keep)


def encode_texts(texts: list[str], path: str, pattern: str, keep: int = KEEP) -> Iterator[tuple[bytes, bytes]]:
    """Ids of each whole text, and the bytes decoded from them word by word; None counts as empty."""
    worker = _worker(path, pattern, keep)
    turn("words", _worker.cache_clear)  # the coder with its database goes, too
    for part in slices(texts, SLICE_CHARS):
        yield from worker.coded(part)


def encode(df: DataFrame, *, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep: int = KEEP) -> DataFrame:
    """``df`` with ``ids`` (array of ints) and ``decoded``, the bytes decoded from them again.

    ``path`` is a file of base64 tokens and ranks that every executor can open.  A
    null or empty text has no ids and decodes to no bytes.  Rows are not moved, so
    keys may be null or repeat.  Columns named like the results are replaced.
    """
    ship(df.sparkSession)

    @F.pandas_udf("ids array<int>, decoded binary")
    def coded(texts: pd.Series) -> pd.DataFrame:
        both = list(encode_texts(texts, path, pattern, keep))
        return pd.DataFrame({"ids": [np.frombuffer(i, "<u4").astype(np.int32) for i, _ in both], "decoded": [d for _, d in both]})

    tmp = free_name(df.columns, "bpe__")
    return df.withColumn(tmp, coded(F.col(f"`{text}`"))).withColumns({ids: F.col(f"{tmp}.ids"), decoded: F.col(f"{tmp}.decoded")}).drop(tmp)


def decode(df: DataFrame, *, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with ``decoded``, the bytes of its array ``ids``, whoever made them.

    No ids give no bytes.  Null, and an array with a null or with an id that isn't in
    the vocabulary, give null.  Rows are not moved.  A column named like the result is
    replaced.
    """
    ship(df.sparkSession)

    @F.pandas_udf("binary")
    def whole(arrays: pd.Series) -> pd.Series:
        return pd.Series(_worker(path, pattern).decode([None if a is None else np.asarray(a, np.int64) for a in arrays]), dtype=object)

    numbers = F.transform(F.col(f"`{ids}`").cast("array<long>"), lambda x: F.coalesce(x, F.lit(-1).cast("long")))
    return df.withColumn(decoded, whole(numbers))


def bpe_digest(df: DataFrame, *, path: str, pattern: str, text: str = "text", key: str = "doc_id", keep: int = KEEP) -> DataFrame:
    """``doc_id``, number of ids, digest of the ids and of the bytes decoded from them, for every row; see ``encode``.

    ``keep``: words that a worker keeps the ids of; it changes memory and time, never a result.
    """
    ship(df.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        rows = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(d).hexdigest()) for i, d in encode_texts(texts, path, pattern, keep)]
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    out = df.select(F.col(f"`{key}`").alias("doc_id"), digest(F.col(f"`{text}`")).alias("d"))
    return out.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
