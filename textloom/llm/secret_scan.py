"""Secret scans: all rules in one byte pass of a combined deterministic automaton.

The pass runs over the reversed text and marks every place where a rule's match
begins; from those few places a forward automaton finds the longest match.  A
match consumes its text even where it is then dropped as too short.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from textloom.llm.automaton import Dfa, build, longest, match_starts
from textloom.session import ship

SPANS = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``find`` are taken leftmost and without overlap; those that ``keep`` doesn't match in full are dropped."""

    kind: str
    find: str
    keep: str
    ignore_case: bool = False


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""
BASE_RULES = (
    Rule("assign", _ASSIGN + "+", _ASSIGN + "{6,}", True),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16,}"),
    # a run of hexadecimal digits is one match however it is cut, so short runs need no marks
    Rule("hex", "[0-9a-f]{24,}", "[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]+", "AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


@cache
def compiled(rules: tuple[Rule, ...]) -> tuple[Dfa, Dfa, Dfa]:
    """The marking pass, the longest-match automaton and the one that decides what stays."""
    find = [(r.find, r.ignore_case) for r in rules]
    return build(find, backward=True, search=True), build(find), build([(r.keep, r.ignore_case) for r in rules])


def scan(text: str, rules: tuple[Rule, ...], automata: tuple[Dfa, Dfa, Dfa] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then in the order of the rules."""
    marks, find, keep = automata or compiled(rules)
    data = text.encode("utf-8", "surrogatepass")
    free = [0] * len(rules)
    spans = []
    for at, mask in match_starts(marks, data):
        for k in range(len(rules)):
            if mask >> k & 1 and at >= free[k]:
                free[k] = end = longest(find, data, at, k)
                if longest(keep, data, at, k) == end:
                    spans.append((at, k, end))
    if len(data) == len(text):
        return [(rules[k].kind, a, e) for a, k, e in spans]
    chars = lambda n: len(data[:n].decode("utf-8", "surrogatepass"))
    return [(rules[k].kind, chars(a), chars(e)) for a, k, e in spans]


def scan_secrets(df: DataFrame, *, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text: str = "text", into: str = "secrets") -> DataFrame:
    """``df`` with an array ``into`` of kind, start and end (code points, end exclusive).

    Whole texts are scanned; a null or empty text has no spans.  Spans of different
    kinds may overlap, those of one kind don't.  Rows are neither moved nor joined,
    so repeated rows and null keys stay as they are.  A column named ``into`` is
    replaced.
    """
    ship(df.sparkSession)
    automata = compiled(rules)

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": e} for k, a, e in scan(t, rules, automata)] if t else [] for t in texts], dtype=object)

    return df.withColumn(into, spans(F.col(f"`{text}`")))


def redact(df: DataFrame, *, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text: str = "text", mask: str = "[{}]") -> DataFrame:
    """``df`` with each found span of its text replaced by its kind; of overlapping spans the first is named."""
    ship(df.sparkSession)
    automata = compiled(rules)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        def one(t):
            out, done = [], 0
            for kind, a, e in scan(t, rules, automata):
                if a >= done:
                    out += [t[done:a], mask.format(kind)]
                done = max(done, e)
            return "".join([*out, t[done:]])

        return texts.map(one, na_action="ignore")

    return df.withColumn(text, masked(F.col(f"`{text}`")))


def secret_digest(df: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as text."""
    found = scan_secrets(df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), into="s").drop("text")
    base = [r.kind for r in BASE_RULES]
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda *kinds: F.filter("s", lambda x: x["kind"].isin(*kinds))
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base], F.sha2(joined(of(*base)), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"), F.size("s").cast("long").alias("n_spans"))
