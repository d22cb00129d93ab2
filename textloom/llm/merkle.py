"""Merkle dataset manifest: contiguous numpy digest matrices over aligned blocks.

A leaf is the digest of a row's columns.  The leaves of a group, in the order of their
keys, are cut into aligned blocks of ``FANOUT ** LEVELS``.  A block's hex digests are one
matrix of 64 bytes a row; reshaped by the fanout, each of its rows is the text of one
run, and the digests of the runs are the matrix of the next level.  What a block comes
to is a leaf of the tree above it, which is handled in the same way until one digest a
group is left; those are the leaves of a last tree, whose top is the root.

Going down again, a node's siblings are found by index arithmetic: at level ``l`` leaf
``i`` lies in run ``i // FANOUT ** (l + 1)``, as its member ``i // FANOUT ** l % FANOUT``.
Blocks are the unit of work, so a group that holds most rows is many tasks' work.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType

from textloom.llm.sharding import numbered
from textloom.session import ship, written

FANOUT = 8
HEX = 64
#: Levels within a block: 4,096 leaves, a matrix of 256 KB.
LEVELS = 4
#: Groups (languages, for instance) whose first rows and sizes go to every task; of more they are joined by a shuffle.
MOST_BROADCAST = 100_000
RESULTS = ("index", "subroot", "root", "proof")
PROOF = "array<struct<before:string,after:string>>"
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaf(*columns: Column) -> Column:
    """Digest of columns: each is ``-`` if null, else its length in UTF-8 bytes, a colon and its text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(proof: Column, digest: Column) -> Column:
    """The root that a leaf's digest and its proof come to."""
    return F.aggregate(proof, digest, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def siblings_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, level by level from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def height(n: int, levels: int) -> int:
    """Levels that a block of a tree with ``n`` leaves goes up: to its top, or to the block's."""
    h = 0
    while n > 1 and h < levels:
        n, h = -(-n // FANOUT), h + 1
    return h


def matrix(digests: pa.ChunkedArray) -> np.ndarray:
    """Hex digests as one row of 64 bytes each."""
    return np.frombuffer("".join(digests.to_pylist()).encode(), np.uint8).reshape(-1, HEX)


def parents(level: np.ndarray) -> np.ndarray:
    """Digests of the runs of a level; the last run may be shorter."""
    text, run = level.tobytes(), FANOUT * HEX
    return np.frombuffer("".join(sha256(text[k : k + run]).hexdigest() for k in range(0, len(text), run)).encode(), np.uint8).reshape(-1, HEX)


def climb(leaves: np.ndarray, h: int) -> list[np.ndarray]:
    """The leaves and the ``h`` levels above them."""
    levels = [leaves]
    for _ in range(h):
        levels.append(parents(levels[-1]))
    return levels


def sides(levels: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Texts of the siblings before and after each leaf, of all levels but the last, leaf by leaf."""
    n, h = len(levels[0]), len(levels) - 1
    runs = np.zeros((n, h, FANOUT, HEX), np.uint8)
    before, after = np.zeros((n, h, FANOUT), bool), np.zeros((n, h, FANOUT), bool)
    slot = np.arange(FANOUT)
    for k, level in enumerate(levels[:-1]):
        node = np.arange(n) // FANOUT**k
        run, place = node // FANOUT, (node % FANOUT)[:, None]
        padded = np.zeros((-(-len(level) // FANOUT) * FANOUT, HEX), np.uint8)
        padded[: len(level)] = level
        runs[:, k] = padded.reshape(-1, FANOUT, HEX)[run]
        before[:, k] = slot < place
        after[:, k] = (slot > place) & (run[:, None] * FANOUT + slot < len(level))
    return _texts(runs, before), _texts(runs, after)


def _texts(runs: np.ndarray, taken: np.ndarray) -> pa.Array:
    ends = np.cumsum(taken.sum(axis=2).ravel() * HEX)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(runs[taken].tobytes()))


def _ordered(nodes: pa.Table) -> pa.Table:
    return nodes.take(np.argsort(nodes["i__"].to_numpy(), kind="stable"))


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """One node for each block of nodes (tree ``t__``, place ``i__`` of ``n__``, ``digest__``)."""
    size = FANOUT**levels

    def top(block: pa.Table) -> pa.Table:
        n, i = block["n__"][0].as_py(), block["i__"][0].as_py()
        digest = climb(matrix(_ordered(block)["digest__"]), height(n, levels))[-1].tobytes().decode()
        return pa.table({"t__": block["t__"][:1], "i__": [i // size], "n__": [-(-n // size)], "digest__": [digest]})

    slim = nodes.select("t__", "i__", "n__", "digest__", F.expr(f"i__ div {size}").alias("b__"))
    return slim.groupBy("t__", "b__").applyInArrow(top, "t__ long, i__ long, n__ long, digest__ string")


def _proofs(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """``nodes`` with ``proof__``, and what ``above`` (tree, place of the block, ``proof__``) says of their block besides."""
    said = [c for c in above.columns if c not in ("t__", "i__", "proof__")]
    own = [c for c in nodes.columns if c not in said]

    def down(block: pa.Table, upper: pa.Table) -> pa.Table:
        block, n = _ordered(block), len(block)
        parts = list(sides(climb(matrix(block["digest__"]), height(block["n__"][0].as_py(), levels))))
        h = len(parts[0]) // n
        over = upper["proof__"].combine_chunks().flatten()
        at = np.concatenate([np.arange(n * h).reshape(n, h), np.broadcast_to(n * h + np.arange(len(over)), (n, len(over)))], axis=1)
        both = [pa.concat_arrays([p, over.field(k).cast(pa.string())]).take(pa.array(at.ravel())) for k, p in enumerate(parts)]
        proof = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * at.shape[1], pa.StructArray.from_arrays(both, ["before", "after"]))
        first = pa.array(np.zeros(n, np.int64))
        return pa.table({c: block[c] for c in own} | {c: upper[c].take(first) for c in said} | {"proof__": proof})

    # the schema of a table that Spark itself has made, names in quotes
    schema = nodes.select(*[F.col(f"`{c}`") for c in own]).schema
    for c in said:
        schema = schema.add(above.schema[c])
    blocks = nodes.withColumn("b__", F.expr(f"i__ div {FANOUT**levels}")).groupBy("t__", "b__")
    return blocks.cogroup(above.withColumnRenamed("i__", "b__").groupBy("t__", "b__")).applyInArrow(down, schema.add("proof__", DataType.fromDDL(PROOF)))


def _stages(nodes: DataFrame, most: int, levels: int, name: str) -> list[DataFrame]:
    """The nodes, and the tops of their blocks, until each tree has one; ``most``: nodes of the largest tree."""
    out = [nodes]
    while most > 1:
        out.append(written(_tops(out[-1], levels), name))
        most = -(-most // FANOUT**levels)
    return out


def manifest(df: DataFrame, *, key: str, group: str, digest: str, levels: int = LEVELS) -> DataFrame:
    """Every row of ``df`` with ``index`` (place in its group), ``subroot``, ``root`` and ``proof``.

    ``digest`` names a column of lowercase hex digests, the leaves.  Groups ascend by
    name, null first, strings by their bytes; within a group leaves ascend by ``key``
    (null first), leaves with equal keys by digest; rows that tie in both are equal
    leaves, and which comes first only shows in columns beside them.  ``proof`` has an
    entry for each level, with the texts of the siblings before and after the node;
    ``fold`` gives the root.  Columns named like a result are replaced.  An empty table
    gives an empty result.

    No group is gathered: leaves are numbered by range, blocks of ``FANOUT ** levels``
    (4,096) are hashed by themselves, and what is above them is a 4,096th of the rows.
    """
    spark = df.sparkSession
    ship(spark)
    names = {c: f"c{k}__" for k, c in enumerate(c for c in df.columns if c.lower() not in RESULTS or c in (key, group, digest))}
    plain = written(df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), "leaves")
    k, g, d = names[key], names[group], names[digest]
    rows = numbered(plain, [g, k, d], "row__")
    groups = written(rows.groupBy(F.col(g).alias("g__")).agg(F.min("row__").alias("first__"), F.count("*").alias("n__")), "groups")
    size, most = groups.agg(F.count("*"), F.max("n__")).first()
    if not size:
        return _named(rows, names, F.col("row__"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast(PROOF))
    groups = written(numbered(groups, ["g__"], "t__"), "groups")
    if size <= MOST_BROADCAST:
        groups = F.broadcast(groups)
    nodes = rows.join(groups, rows[g].eqNullSafe(groups["g__"])).select("t__", (F.col("row__") - F.col("first__")).alias("i__"), "n__", F.col(d).alias("digest__"), *names.values())
    trees = _stages(nodes, most, levels, "nodes")
    subroots = trees[-1] if most > 1 else trees[-1].select("t__", "i__", "n__", "digest__")
    crown = _stages(subroots.select(F.lit(0).cast("long").alias("t__"), F.col("t__").alias("i__"), F.lit(size).cast("long").alias("n__"), "digest__"), size, levels, "crown")

    above = crown[-1].select("t__", F.lit(0).cast("long").alias("i__"), F.array().cast(PROOF).alias("proof__"), F.col("digest__").alias("root__"))
    for stage in reversed(crown[:-1]):
        above = _proofs(stage, above, levels).select("t__", "i__", "proof__", "root__", F.col("digest__").alias("subroot__"))
    if len(crown) == 1:  # one group: its subroot is the root
        above = above.withColumn("subroot__", F.col("root__"))
    above = written(above.select(F.col("i__").alias("t__"), F.lit(0).cast("long").alias("i__"), "proof__", "root__", "subroot__"), "proofs")
    for stage in reversed(trees[1:-1]):
        above = written(_proofs(stage, above, levels).select("t__", "i__", "proof__", "root__", "subroot__"), "proofs")
    out = _proofs(nodes, above, levels)
    return _named(out, names, F.col("i__"), F.col("subroot__"), F.col("root__"), F.col("proof__"))


def _named(rows: DataFrame, names: dict[str, str], index: Column, subroot: Column, root: Column, proof: Column) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for c, n in names.items() if c.lower() not in RESULTS], index.alias("index"), subroot.alias("subroot"), root.alias("root"), proof.alias("proof"))


def tampered(text: Column) -> Column:
    """A change of a text that should be found: its A-Z in lower case."""
    return F.translate(text, *LOWER)


def manifest_table(df: DataFrame) -> DataFrame:
    """Leaf, subroot, root, digest of the proof, and the root after tampering, of every row of ``documents``.

    Leaves are digests of ``doc_id``, ``source``, ``lang``, ``n_chars`` and ``text``; groups
    are the values of ``lang``.  Tampered are the rows whose ``doc_id`` in decimal has a
    checksum that 3 divides; a null ``doc_id`` has none.  ``verified`` is false where the
    change was found.
    """
    c = {x: F.col(f"`{x}`") for x in ("doc_id", "source", "lang", "n_chars", "text")}
    picked = F.crc32(c["doc_id"].cast("string").cast("binary")) % 3 == 0
    changed = F.when(picked & c["text"].isNotNull(), leaf(c["doc_id"], c["source"], c["lang"], c["n_chars"], tampered(c["text"])))
    rows = manifest(df.select("doc_id", "lang", leaf(*c.values()).alias("leaf"), changed.alias("changed")), key="doc_id", group="lang", digest="leaf")
    folded = rows.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"), fold(F.col("proof"), F.coalesce("changed", "leaf")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
