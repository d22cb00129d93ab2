"""Chunks that end at semantic boundaries and keep terms of several words whole."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.operators.concepts import TERMS
from textloom.plans.registry import query
from textloom.session import table

#: Delimiters of general texts, the strongest first.
DELIMITERS = (r"[.!?]\s+(?=(?:However|Therefore|Moreover|Finally|In conclusion)\b)", r"[.!?]\s+", r";\s+")
_TERM = re.compile(rf"\b(?:{TERMS})\b")


@dataclass
class Chunk:
    words: list[str]
    #: Words by which its end was moved to keep a term whole, and terms that couldn't be kept.
    moved: int = 0
    cut: list[str] = field(default_factory=list)


def boundary(words: Sequence[str], delimiters: Sequence[str] = DELIMITERS) -> int:
    """How many words stand before the strongest delimiter's match nearest the middle; else before the middle sentence's end; else 0."""
    text = " ".join(words)
    for pattern in delimiters:
        ends = [m.end() for m in re.finditer(pattern, text) if m.end() < len(text)]
        if ends:
            return len(text[:min(ends, key=lambda e: (abs(2 * e - len(text)), e))].split())
    sentences = text.split(".")
    return len(".".join(sentences[:len(sentences) // 2]).split()) if len(sentences) > 1 else 0


def keep_terms(words: Sequence[str], at: int, most: int, window: int = 20) -> tuple[int, list[str]]:
    """``at``, moved behind a term that spans it if the chunk stays within ``most`` words, else before it; and terms that neither could keep."""
    low = [w.lower().strip(".,;:!?()") for w in words[max(0, at - window):at + window]]
    here = min(at, window)
    spans, place = [], 0
    starts = []
    for w in low:
        starts.append(place)
        place += len(w) + 1
    joined = " ".join(low)
    for m in _TERM.finditer(joined):
        a, b = starts.index(m.start()) if m.start() in starts else -1, sum(s < m.end() for s in starts)
        if 0 <= a < here < b:
            spans.append((b - a, a, b, m[0]))
    if not spans:
        return at, []
    _, a, b, term = max(spans)
    rest = [s[3] for s in spans if s[3] != term]
    if at + b - here <= most:
        return at + b - here, rest
    if at - (here - a) > 0:
        return at - (here - a), rest
    return at, [term, *rest]


def semantic_chunks(text: str | None, preferred: int = 256, most: int = 512, least: int = 64) -> list[Chunk]:
    """A text's words in chunks.

    When ``preferred`` words are held they are divided at their boundary, and what
    stands behind it goes on; without a boundary all of them are a chunk.  A chunk of
    over ``most`` words is cut every ``preferred``; one of under ``least`` joins the one
    before it if both have ``most`` words at the most.  No text, no chunks.
    """
    chunks: list[Chunk] = []
    held: list[str] = []
    for word in (text or "").split():
        held.append(word)
        if len(held) >= preferred:
            at = boundary(held)
            if not 0 < at < len(held):
                chunks.append(Chunk(held))
                held = []
                continue
            to, cut = keep_terms(held, at, most)
            to = min(to, len(held))
            chunks.append(Chunk(held[:to], to - at, cut))
            held = held[to:]
    if held:
        chunks.append(Chunk(held))
    out: list[Chunk] = []
    for c in chunks:
        parts = [c] if len(c.words) <= most else [Chunk(c.words[i:i + preferred], c.moved, c.cut) for i in range(0, len(c.words), preferred)]
        for p in parts:
            if out and len(p.words) < least and len(out[-1].words) + len(p.words) <= most:
                out[-1] = Chunk(out[-1].words + p.words, out[-1].moved, out[-1].cut + p.cut)
            else:
                out.append(p)
    return out


@query("chunk_boundaries", None)
def chunk_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every text, with their sizes, digests, how far their ends were moved and how many terms are cut; keys stay with Spark."""

    @F.pandas_udf("array<struct<n_words:long,moved:long,n_cut:long,digest:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        one = lambda c: {"n_words": len(c.words), "moved": c.moved, "n_cut": len(c.cut), "digest": hashlib.sha256(" ".join(c.words).encode()).hexdigest()}
        return pd.Series([[one(c) for c in semantic_chunks(t)] for t in texts], dtype=object)

    chunks = table(spark, d, "documents").select("doc_id", F.posexplode(cut("text")).alias("chunk", "c"))
    return chunks.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "c.*")
