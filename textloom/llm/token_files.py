"""Token-id output: raw id payloads and a minimal-perfect-hash index over document keys.

A shard file holds a 16-byte header and the ids of its documents, one after the
other in key order, little-endian.  An index file covers one bucket of keys: a
perfect hash gives the slot of a record with a fingerprint, shard, offset and length,
so a document is found in constant time without a list of keys: the hash's bits, one
record and the document's ids are read, whatever the size of the files.

Keys pass through Python as Arrow columns only, so a null beside a large number
changes neither.
"""

from __future__ import annotations

import io
import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from tokenizers import Tokenizer

from textloom.llm import perfect_hash
from textloom.llm.chunks import ChunkCache, slices, turn, word_parts
from textloom.session import scratch, ship, written

MAGIC = b"TLIDS001"
HEADER = 16
SHARD_BYTES = 32 << 20
KEYS_A_BUCKET = 50_000
#: A record of the index; bytes between two documents that are read over, and bytes read at once for several documents.
RECORD = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u4")])
GAP, READ_AT_ONCE = 1 << 16, 4 << 20


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI in the shared folder."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _publish(path: str, name: str, pieces: Iterator[bytes]) -> None:
    """Write a file under a name of this attempt, then rename: a task that is run again replaces it whole."""
    store, root = _store(path)
    store.create_dir(root, recursive=True)
    task = TaskContext.get()
    tmp = f"{root}/.{name}.{task.taskAttemptId() if task else os.getpid()}"
    with store.open_output_stream(tmp) as out:
        for p in pieces:
            out.write(p)
    store.move(tmp, f"{root}/{name}")


#: The steps before the model of the tokenizers whose parts ``word_parts`` knows.
KNOWN_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "truncation": None, "padding": None,
}


def by_parts(t: Tokenizer) -> bool:
    """Whether a tokenizer treats the parts of ``word_parts`` one by one; any other one gets whole texts."""
    steps = json.loads(t.to_str())
    return all(steps[k] == v for k, v in KNOWN_STEPS.items()) and sys.byteorder == "little"


@cache
def _encoder(path: str) -> tuple[ChunkCache | None, np.dtype, Tokenizer, re.Pattern]:
    """Encoder of parts (None: whole texts only), width of an id, the tokenizer and a pattern of the added tokens, which it finds anywhere in a text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    added = re.compile("|".join(re.escape(a.content) for a in t.get_added_tokens_decoder().values()) or r"(?!)")
    dtype = np.dtype("<u2" if t.get_vocab_size() <= 1 << 16 else "<u4")
    return ChunkCache(lambda parts: _encoded(t, dtype, parts), 400_000) if by_parts(t) else None, dtype, t, added


def _encoded(t: Tokenizer, dtype: np.dtype, parts: list[str], at_once: int = 2_000) -> list[bytes]:
    """Packed ids of each part.

    Words of ASCII letters go to the tokenizer's model in lower case, as the steps before
    it do no more to them; of the rest many go to the tokenizer as the words of one text,
    which it keeps apart.
    """
    model = t.model
    kind = "H" if dtype.itemsize == 2 else "I"
    out = {p: array(kind, [x.id for x in model.tokenize(p.lower())]).tobytes() for p in parts if p.isascii() and p.isalpha()}
    rest = [p for p in parts if p not in out]
    for k in range(0, len(rest), at_once):
        some = rest[k:k + at_once]
        got = t.encode(some, is_pretokenized=True, add_special_tokens=False)
        packed = np.array(got.ids, dtype).tobytes()
        cuts = (np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(some) + 1)) * dtype.itemsize).tolist()
        out.update((p, packed[a:b]) for p, a, b in zip(some, cuts, cuts[1:]))
    return [out[p] for p in parts]


def token_bytes(texts: list[str | None], tokenizer: str, end_id: int) -> Iterator[bytes]:
    """Packed ids of each whole text and the end id; None counts as empty.

    Texts are encoded by their distinct parts, see ``word_parts``; a text that spells
    an added token, and any text for a tokenizer of another kind, goes to it whole.
    """
    cache_, dtype, whole, added = _encoder(tokenizer)
    end = np.array([end_id], dtype).tobytes()
    if cache_ is None:
        for t in texts:
            yield np.array(whole.encode(t or "", add_special_tokens=False).ids, dtype).tobytes() + end
        return
    turn("parts", cache_.clear)
    for part in slices(texts):
        cut = [None if added.search(t) else word_parts(t) for t in part]
        known = cache_.need(chain.from_iterable(cs for cs in cut if cs))
        for t, cs in zip(part, cut):
            if cs is None:
                yield np.array(whole.encode(t, add_special_tokens=False).ids, dtype).tobytes() + end
            else:
                yield b"".join([*map(known.__getitem__, cs), end])


@dataclass
class TokenFiles:
    """A written set: ``path`` has the shards and the index, ``shards`` a row with the first id's place for each shard."""

    path: str
    width: int
    buckets: int
    shards: DataFrame


def _key_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("copy"))


def _key_type(df: DataFrame, key: str) -> str:
    return df.select(F.col(f"`{key}`")).dtypes[0][1]


def write_tokens(df: DataFrame, *, tokenizer: str, end_id: int = 2, text: str = "text", key: str = "doc_id", path: str | None = None, shard_bytes: int = SHARD_BYTES) -> TokenFiles:
    """Encode every row and write shards in ascending key order, then the index.

    A null key sorts first.  Rows that share a key are told apart by ``copy`` (0, 1,
    ...) in order of a hash of their texts; they may fill many shards, so one key with
    a third of all rows is no task's alone.  A null text has only the end id.  An empty
    table gives no files.  Other columns are left out.
    """
    spark = df.sparkSession
    ship(spark)
    path = path or scratch(spark, "tokens")
    dtype = _encoder(tokenizer)[1]
    rows = df.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        placed: list[pa.RecordBatch] = []

        def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
            yield MAGIC + np.array([dtype.itemsize, end_id], "<u4").tobytes()
            at, last, copy = 0, object(), 0
            for part in parts:
                lengths, copies = [], []
                for k, packed in zip(part["doc_id"].to_pylist(), token_bytes(part["text"].to_pylist(), tokenizer, end_id)):
                    copy = copy + 1 if k == last else 0
                    last = k
                    copies.append(copy)
                    lengths.append(len(packed) // dtype.itemsize)
                    yield packed
                ends = at + np.cumsum(lengths, dtype=np.int64)
                cols = [part["doc_id"], pa.array(copies, pa.int64()), pa.array([shard] * len(copies), pa.int32()), pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64())]
                placed.append(pa.RecordBatch.from_arrays(cols, ["doc_id", "copy", "shard", "offset", "n"]))
                at = int(ends[-1]) if len(ends) else at

        first = next((p for p in parts if p.num_rows), None)
        if first is None:
            return
        _publish(f"{path}/shards", f"{shard:06d}.ids", pieces(chain([first], parts)))
        yield from placed

    n_shards = max(1, -(-int(total) // shard_bytes))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(n_shards, *order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    kind = _key_type(df, key)
    placed = written(ordered.mapInArrow(write, f"doc_id {kind}, copy long, shard int, offset long, n long"), "places")
    ends = lambda f: f(F.struct("doc_id", "copy"), F.col("offset"))
    sizes = sorted(placed.groupBy("shard").agg(F.sum("n").alias("ids"), F.count("*").alias("rows"), ends(F.min_by).alias("head"), ends(F.max_by).alias("tail")).collect(), key=lambda r: r.shard)  # one row a shard
    starts = np.cumsum([0, *[r.ids for r in sizes]]).tolist()
    shards = spark.createDataFrame([(r.shard, starts[i]) for i, r in enumerate(sizes)], "shard int, first long")
    # a key that goes on from the shard before counts its copies on
    carried, more = 0, []
    for before, now in zip(sizes, sizes[1:]):
        carried = before.tail.copy + 1 + (carried if before.head.doc_id == before.tail.doc_id else 0) if before.tail.doc_id == now.head.doc_id else 0
        if carried:
            more.append((now.shard, now.head.doc_id, carried))
    if more:  # at most a row a shard
        placed = placed.join(F.broadcast(spark.createDataFrame(more, f"shard int, head {kind}, carried long")), "shard", "left")
        placed = placed.withColumn("copy", F.col("copy") + F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.coalesce("carried", F.lit(0))).otherwise(0)).drop("head", "carried")
    buckets = max(1, -(-sum(r.rows for r in sizes) // KEYS_A_BUCKET))

    def index(part: pd.DataFrame) -> pd.DataFrame:
        keys = part["h"].to_numpy().view(np.uint64)
        mph = perfect_hash.build(keys)
        slot = perfect_hash.slots(mph, keys)
        if len(np.unique(slot)) != len(keys):
            raise ValueError("two keys of a bucket have the same hash")
        records = np.zeros(len(keys), RECORD)
        for c in ("shard", "offset", "n"):
            records[c][slot] = part[c].to_numpy()
        records["print"][slot] = perfect_hash.fingerprints(keys)
        buf = io.BytesIO()
        np.savez(buf, **mph)
        b = int(part["bucket"].iloc[0])
        _publish(f"{path}/index", f"{b:08d}.idx", iter([len(buf.getvalue()).to_bytes(8, "little"), buf.getvalue(), records.tobytes()]))
        return pd.DataFrame({"bucket": [b], "keys": [len(part)], "bits": [len(mph["bits"]) * 8]})

    # hashes of distinct keys: buckets are even, of about KEYS_A_BUCKET rows; the keys themselves stay behind
    bucketed = placed.select(_key_hash(0).alias("h"), F.pmod(_key_hash(1), F.lit(buckets)).alias("bucket"), "shard", "offset", "n")
    built = bucketed.groupBy("bucket").applyInPandas(index, "bucket long, keys long, bits long")
    written(built, "index-buckets")
    return TokenFiles(path, dtype.itemsize, buckets, shards)


def _records(store: pafs.FileSystem, name: str, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records of these hashes in one index file, and which of them were found: the few that are wanted are read one by one."""
    with store.open_input_file(name) as f:
        size = int.from_bytes(f.read(8), "little")
        s = perfect_hash.slots(dict(np.load(io.BytesIO(f.read(size)))), hashes)
        known = (f.size() - 8 - size) // RECORD.itemsize
        at = np.clip(s, 0, max(0, known - 1))
        if not known:
            return np.zeros(len(hashes), RECORD), np.zeros(len(hashes), bool)
        if len(hashes) * 64 > known:
            f.seek(8 + size)
            got = np.frombuffer(f.read(), RECORD)[at]
        else:
            got = np.concatenate([np.frombuffer(f.read_at(RECORD.itemsize, 8 + size + int(i) * RECORD.itemsize), RECORD) for i in at])
    return got, (s >= 0) & (got["print"] == perfect_hash.fingerprints(hashes))


def locate(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """``doc_id``, ``copy``, ``shard``, ``offset``, ``n`` of each key by the index; a key that isn't there has nulls.

    Each key costs one hash and one probe; a key that was never written is taken for
    another with a chance of 2^-32.
    """
    path = files.path

    def look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(f"{path}/index")
        for part in parts:
            bucket, h = part["bucket"].to_numpy(), part["h"].to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                got, there = _records(store, f"{root}/{bucket[a]:08d}.idx", h[a:b])
                cols = [pa.array(got[c].astype(t), mask=~there) for c, t in (("shard", np.int32), ("offset", np.int64), ("n", np.int64))]
                yield pa.RecordBatch.from_arrays([part["doc_id"].slice(a, b - a), part["copy"].slice(a, b - a), *cols], ["doc_id", "copy", "shard", "offset", "n"])

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = keys.select("doc_id", "copy").withColumn("h", _key_hash(0)).withColumn("bucket", F.pmod(_key_hash(1), F.lit(files.buckets)))
    placed = placed.repartition(min(parts, files.buckets), "bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(look, f"doc_id {_key_type(keys, 'doc_id')}, copy long, shard int, offset long, n long")


def _payloads(store: pafs.FileSystem, root: str, dtype: np.dtype, places: list[tuple[int, int, int]]) -> Iterator[np.ndarray]:
    """The ids at places (shard, offset, n): neighbours of one shard in one read, others each with a seek."""
    i, f, held = 0, None, None
    try:
        while i < len(places):
            shard, at, n = places[i]
            if n is None:
                raise KeyError("a key that isn't in the index")
            if shard != held:
                if f:
                    f.close()
                f, held = store.open_input_file(f"{root}/{shard:06d}.ids"), shard
                head = f.read(HEADER)
                if head[:8] != MAGIC or int.from_bytes(head[8:12], "little") != dtype.itemsize:
                    raise ValueError(f"not a token file: {root}/{shard:06d}.ids")
            j, end = i + 1, at + n
            while j < len(places) and places[j][0] == shard and places[j][2] is not None and 0 <= (places[j][1] - end) * dtype.itemsize <= GAP and (places[j][1] + places[j][2] - at) * dtype.itemsize <= READ_AT_ONCE:
                end = places[j][1] + places[j][2]
                j += 1
            ids = np.frombuffer(f.read_at((end - at) * dtype.itemsize, HEADER + at * dtype.itemsize), dtype)
            for _, a, k in places[i:j]:
                yield ids[a - at:a - at + k]
            i = j
    finally:
        if f:
            f.close()


def read_tokens(files: TokenFiles, places: DataFrame, *, checksum_only: bool = False) -> DataFrame:
    """The ids (array of ints), or the CRC-32 of them as 32-bit numbers, at places that ``locate`` gave, with ``start``.

    A place without a length, of a key that ``locate`` didn't find, is an error.
    """
    path, dtype = files.path, np.dtype(f"<u{files.width}")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(f"{path}/shards")
        for part in parts:
            got = [x.astype("<u4") for x in _payloads(store, root, dtype, list(zip(*(part[c].to_pylist() for c in ("shard", "offset", "n")))))]
            made = pa.array([zlib.crc32(x.tobytes()) for x in got], pa.int64()) if checksum_only else pa.array([x.astype(np.int32) for x in got], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(part[c] for c in ("doc_id", "copy", "shard", "offset", "n")), made], ["doc_id", "copy", "shard", "offset", "n", "got"])

    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = places.repartition(parts, "shard").sortWithinPartitions("shard", "offset")
    kind = "long" if checksum_only else "array<int>"
    got = spread.mapInArrow(read, f"doc_id {_key_type(places, 'doc_id')}, copy long, shard int, offset long, n long, got {kind}")
    out = got.join(F.broadcast(files.shards), "shard")  # one row a shard
    return out.select("doc_id", "copy", (F.col("first") + F.col("offset")).alias("start"), F.col("n").alias("n_tokens"), F.col("got").alias("ids_crc32" if checksum_only else "ids"), "shard", "offset")


def keys_of(df: DataFrame, key: str = "doc_id", block: int = 10_000) -> DataFrame:
    """Every key that occurs, with one row for each of its copies (numbered block by block: no row holds a hot key's copies)."""
    counted = df.groupBy(F.col(f"`{key}`").alias("doc_id")).count()
    blocks = counted.select("doc_id", "count", F.explode(F.expr(f"sequence(0L, (count - 1) div {block})")).alias("b"))
    return blocks.select("doc_id", F.explode(F.expr(f"sequence(b * {block}, least(count, (b + 1) * {block}) - 1)")).alias("copy"))


def token_table(df: DataFrame, *, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write all documents, look every key up in the index and checksum what the files hold."""
    files = write_tokens(df, tokenizer=tokenizer, end_id=end_id)
    return read_tokens(files, locate(files, keys_of(df.select("doc_id"))), checksum_only=True)
