"""The subpackage's queries for ``__spark_entry__.py``: thin calls with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from textloom.llm.byte_bpe import bpe_digest
from textloom.llm.chat_format import format_chats
from textloom.llm.decontamination import contamination_table
from textloom.llm.exact_dedup import dedup_digests
from textloom.llm.license_scan import license_table
from textloom.llm.merkle import manifest_table
from textloom.llm.ngram_join import jaccard_components
from textloom.llm.quality_rules import quality_table
from textloom.llm.runs import runs_table
from textloom.llm.secret_scan import secret_digest
from textloom.llm.sharding import shard_table
from textloom.llm.token_files import token_table
from textloom.llm.topk_search import nearest_table
from textloom.session import table


def op1_chat_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of ``conversations`` with its repaired role and rendered piece; see ``format_chats``."""
    return format_chats(table(spark, sf_dir, "conversations"))


def op2_automaton_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of secrets in every text of ``documents``; see ``secret_digest``."""
    return secret_digest(table(spark, sf_dir, "documents"))


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of ``documents`` in 16 shards by the law ``rows``; see ``shard_table``."""
    return shard_table(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)


def op4_perfect_hash_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of the ids of every row of ``documents``, read back from the files by the index; see ``token_table``."""
    return token_table(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op5_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision of every row of ``documents`` by rules fitted to ``labels``; see ``quality_table``."""
    return quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows of ``documents`` overlap with items of ``benchmark``; see ``mark_contaminated``."""
    return contamination_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_heavy_light_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every row of ``documents``: three words, 90 %; see ``jaccard_components``."""
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op8_duckdb_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the ids, and digest of the decoded bytes, of every row of ``documents``; see ``bpe_digest``."""
    return bpe_digest(table(spark, sf_dir, "documents"), path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def op9_compression_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every text of ``documents``; see ``scan_licenses``."""
    return license_table(table(spark, sf_dir, "documents"))


def op10_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, keeper and digest of every row of ``documents``; see ``exact_dedup``."""
    return dedup_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_numpy_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and roots of every row of ``documents``, before and after tampering; see ``manifest_table``."""
    return manifest_table(table(spark, sf_dir, "documents"))


def op12_lpf_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in every text of ``documents``, and the texts without what repeats; see ``runs_table``."""
    return runs_table(table(spark, sf_dir, "documents"))


def op13_uniform_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all rows of ``embeddings`` for each of its queries; see ``nearest_table``."""
    return nearest_table(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_chat_role_repair, op2_automaton_secrets, op3_feistel_sharding, op4_perfect_hash_tokens, op5_rule_quality, op6_spaced_seed_decontamination,
        op7_heavy_light_jaccard, op8_duckdb_byte_bpe, op9_compression_licenses, op10_bloom_exact_dedup, op11_numpy_merkle, op12_lpf_runs,
        op13_uniform_threshold_topk,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op10_bloom_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM t""",
        "op11_numpy_merkle": r"""
WITH RECURSIVE keyed AS (
  SELECT *, doc_id::VARCHAR AS k, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head FROM documents),
picked AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, range(8 * length(k))),
    lambda c, b: xor(xor(c, CASE WHEN b % 8 = 0 THEN ascii(k[b // 8 + 1]) ELSE 0 END) >> 1, xor(c, CASE WHEN b % 8 = 0 THEN ascii(k[b // 8 + 1]) ELSE 0 END) % 2 * 3988292384)), 4294967295) % 3 = 0 AS hit FROM keyed),
digests AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN hit AND text IS NOT NULL THEN sha256(head || strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) END AS changed FROM picked),
leaves AS (
  SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM digests),
tree AS (
  SELECT lang, 0 AS level, i, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT lang, level + 1, i >> 3, (n + 7) >> 3, sha256(string_agg(digest, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lang, level, n, i >> 3),
subroots AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (
  SELECT 0 AS level, i, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, i >> 3, (n + 7) >> 3, sha256(string_agg(digest, '' ORDER BY i)) FROM crown WHERE n > 1 GROUP BY level, n, i >> 3),
low AS (
  SELECT l.r, t.level, coalesce(string_agg(t.digest, '' ORDER BY t.i) FILTER (t.i < l.i >> (3 * t.level)), '') AS before, coalesce(string_agg(t.digest, '' ORDER BY t.i) FILTER (t.i > l.i >> (3 * t.level)), '') AS after
  FROM leaves l JOIN tree t ON l.lang IS NOT DISTINCT FROM t.lang AND t.n > 1 AND t.i >> 3 = l.i >> (3 * t.level + 3) GROUP BY l.r, t.level),
high AS (
  SELECT s.lang, c.level, coalesce(string_agg(c.digest, '' ORDER BY c.i) FILTER (c.i < s.i >> (3 * c.level)), '') AS before, coalesce(string_agg(c.digest, '' ORDER BY c.i) FILTER (c.i > s.i >> (3 * c.level)), '') AS after
  FROM subroots s JOIN crown c ON c.n > 1 AND c.i >> 3 = s.i >> (3 * c.level + 3) GROUP BY s.lang, c.level),
steps AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY up, level) AS k, before, after
  FROM (SELECT r, 0 AS up, level, before, after FROM low UNION ALL SELECT l.r, 1, h.level, h.before, h.after FROM leaves l JOIN high h ON l.lang IS NOT DISTINCT FROM h.lang)),
folds AS (
  SELECT r, 0::BIGINT AS k, coalesce(changed, leaf) AS h FROM leaves
  UNION ALL
  SELECT f.r, s.k, sha256(s.before || f.h || s.after) FROM folds f JOIN steps s ON s.r = f.r AND s.k = f.k + 1),
ends AS (SELECT r, arg_max(h, k) AS folded_root FROM folds GROUP BY r),
proofs AS (SELECT l.r, sha256(coalesce(string_agg(before || after, '' ORDER BY k), '')) AS proof_sha256 FROM leaves l LEFT JOIN steps s ON s.r = l.r GROUP BY l.r)
SELECT l.doc_id, l.leaf, s.digest AS subroot, (SELECT digest FROM crown WHERE n = 1) AS root, p.proof_sha256, e.folded_root, e.folded_root = (SELECT digest FROM crown WHERE n = 1) AS verified
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN proofs p ON p.r = l.r JOIN ends e ON e.r = l.r""",
        "op13_uniform_threshold_topk": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    }
