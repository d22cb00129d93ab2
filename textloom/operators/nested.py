"""JSON of unknown shape: redaction by key and by value, and arrays in the answers of language models.

A document is walked within its row, in Arrow batches: what it holds never leaves the row.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.functions import text as T
from textloom.plans.registry import query
from textloom.session import ship, table

#: Parts of key names whose values are replaced.
SENSITIVE_KEYS = tuple(
    "password passwd pwd secret token key api_key access_token refresh_token jwt ssn social_security credit_card card_number email phone address zip postal_code".split())
REPLACED = "[REDACTED]"
#: A text without any of these has no match of a redaction rule, all of which need a digit or one of these signs.
MAY_MATCH = re.compile(r"[0-9@:=]|eyJ")
RESULT = "redacted string, changes array<struct<path:string,rule:string>>, digest string"


def redact_value(value: Any, keys: tuple[str, ...], strict: bool, path: str, changes: list[tuple[str, str]]) -> Any:
    """A copy of a JSON value; ``changes`` gets the path and rule of each replacement."""
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            at = f"{path}.{k}"
            if not any(s in k.lower() for s in keys):
                out[k] = redact_value(v, keys, strict, at, changes)
            elif isinstance(v, (dict, list)):
                out[k] = _emptied(v, at, changes) if strict else v
            elif v:
                out[k] = REPLACED
                changes.append((at, "key"))
            else:
                out[k] = v
        return out
    if isinstance(value, list):
        return [redact_value(v, keys, strict, f"{path}[{i}]", changes) for i, v in enumerate(value)]
    if not isinstance(value, str):
        return value
    if not MAY_MATCH.search(value):
        return value
    for name, pattern, replacement in _rules():
        changed = pattern.sub(replacement, value)
        if changed != value:
            changes.append((path, name))
            value = changed
    return value


def _emptied(value: Any, path: str, changes: list[tuple[str, str]]) -> Any:
    """All scalars below a sensitive key, replaced."""
    if isinstance(value, dict):
        return {k: _emptied(v, f"{path}.{k}", changes) for k, v in value.items()}
    if isinstance(value, list):
        return [_emptied(v, f"{path}[{i}]", changes) for i, v in enumerate(value)]
    if value:
        changes.append((path, "key"))
        return REPLACED
    return value


@cache
def _rules() -> list[tuple[str, re.Pattern, str]]:
    return [(n, re.compile(p), r.replace("$1", r"\1")) for n, p, r in T.REDACTIONS if n not in T.OFF]


def canonical(value: Any) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def redact_json(df: DataFrame, column: str, *, keys: tuple[str, ...] = SENSITIVE_KEYS, strict: bool = False) -> DataFrame:
    """``df`` with ``redacted`` (JSON with sorted keys), ``changes`` (path and rule of each) and ``digest`` of the original, for the audit.

    The value of a key whose name has one of ``keys`` in it is replaced if it is a text or
    number other than empty or zero; an object or array there stays as it is, or has all its
    values replaced if ``strict``.  Other texts go through the ordered redaction rules.  What
    isn't JSON is a text.  Null has no redacted form, changes or digest.  Columns named like a
    result are replaced.
    """
    ship(df.sparkSession)

    @F.arrow_udf(RESULT)
    def walked(texts: pa.Array) -> pa.Array:
        done, paths, rules, ends, digests = [], [], [], [0], []
        for t in texts.to_pylist():
            if t is None:
                done.append(None)
                digests.append(None)
                ends.append(len(paths))
                continue
            try:
                value = json.loads(t)
            except (ValueError, RecursionError):
                value = t
            changes: list[tuple[str, str]] = []
            done.append(canonical(redact_value(value, keys, strict, "$", changes)))
            for p, r in changes:
                paths.append(p)
                rules.append(r)
            ends.append(len(paths))
            digests.append(hashlib.sha256(canonical(value).encode()).hexdigest())
        # columns are built as they are: rows of lists of dictionaries took most of the time
        each = pa.StructArray.from_arrays([pa.array(paths, pa.string()), pa.array(rules, pa.string())], ["path", "rule"])
        return pa.StructArray.from_arrays([pa.array(done, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each), pa.array(digests, pa.string())], ["redacted", "changes", "digest"])

    # not deterministic for Spark, which else walks every document once more for a filter on what comes out
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("redacted", "changes", "digest")]
    return df.select(*kept, walked.asNondeterministic()(F.col(f"`{column}`")).alias("done__")).select(*kept, *[F.when(F.col(f"`{column}`").isNotNull(), F.col(f"done__.{c}")).alias(c) for c in ("redacted", "changes", "digest")])


def order_notes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as nested JSON: a buyer, notes with an address and a number, flags."""
    o = table(spark, d, "orders")
    digits = F.lpad(F.col("o_orderkey").cast("string"), 9, "0")
    number = F.concat_ws("-", F.substring(digits, 1, 3), F.substring(digits, 4, 2), F.substring(digits, 6, 4))
    buyer = F.struct(F.struct(F.col("o_custkey").alias("user_key"), F.lit(True).alias("active")).alias("account"), F.struct(F.lit("x").alias("street")).alias("address"))
    notes = F.array(F.concat(F.lit("mail to c"), "o_custkey", F.lit("@example.org today")), F.concat(F.lit("number "), number), F.col("o_orderpriority"))
    return o.select("o_orderkey", F.to_json(F.struct(buyer.alias("buyer"), notes.alias("notes"), F.col("o_orderstatus").alias("status"))).alias("j"))


_NOTES = """n AS (SELECT o_orderkey, CASE WHEN o_custkey = 0 THEN '0' ELSE '"[REDACTED]"' END AS account, o_custkey <> 0 AS named, o_orderpriority AS p, o_orderstatus AS s, o_custkey AS c, lpad(o_orderkey::VARCHAR, 9, '0') AS g FROM orders),
r AS (SELECT *, '{"buyer":{"account":{"active":true,"user_key":' || account || '},"address":{"street":"x"}},"notes":["mail to [EMAIL-REDACTED] today","number [SSN-REDACTED]","' || p || '"],"status":"' || s || '"}' AS redacted,
  '{"buyer":{"account":{"active":true,"user_key":' || c || '},"address":{"street":"x"}},"notes":["mail to c' || c || '@example.org today","number ' || g[1:3] || '-' || g[4:5] || '-' || g[6:9] || '","' || p || '"],"status":"' || s || '"}' AS was FROM n)"""


@query("redact_nested", f"WITH {_NOTES} SELECT o_orderkey, redacted, sha256(was) AS digest, (2 + named::INT)::INTEGER AS n_changes FROM r")
def redact_nested(spark: SparkSession, d: str) -> DataFrame:
    """Every order's JSON without keys, addresses and numbers, and the digest of what it was."""
    return redact_json(order_notes(spark, d), "j").select("o_orderkey", "redacted", "digest", F.size("changes").alias("n_changes"))


@query("redact_nested_summary", f"""
WITH {_NOTES}, c AS (SELECT unnest([CASE WHEN named THEN '$.buyer.account.user_key key' END, '$.notes[0] email', '$.notes[1] ssn']) AS c FROM r) SELECT split_part(c, ' ', 1) AS path, split_part(c, ' ', 2) AS rule, count(*) AS n FROM c WHERE c IS NOT NULL GROUP BY 1, 2""")
def redact_nested_summary(spark: SparkSession, d: str) -> DataFrame:
    """How often each rule changed each path."""
    changes = redact_json(order_notes(spark, d), "j").select(F.explode("changes").alias("c"))
    return changes.groupBy("c.path", "c.rule").agg(F.count("*").alias("n"))


# answers of language models


def array_in(answer: str) -> list[dict]:
    """The objects of the first JSON array in a text: within a fence or prose, after trailing commas, or cut off at the end."""
    for start in (m.start() for m in re.finditer(r"\[", answer)):
        decoder, at, found = json.JSONDecoder(), start + 1, []
        while True:
            at = re.compile(r"[\s,]*").match(answer, at).end()
            if at >= len(answer) or answer[at] == "]":
                break
            try:
                value, at = decoder.raw_decode(answer, at)
            except ValueError:  # cut off, or no array of JSON
                break
            found.append(value)
        if objects := [v for v in found if isinstance(v, dict)]:
            return objects
    return []


def least_distance(quote: str, text: str) -> tuple[int, int]:
    """Least edits between ``quote`` and any stretch of ``text``, and where the first such stretch ends (semi-global; bit-parallel after Myers)."""
    m = len(quote)
    if not m:
        return 0, 0
    masks: dict[str, int] = {}
    for i, c in enumerate(quote):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        more, less = down | ~(x | up) & full, up & x
        score += bool(more & top) - bool(less & top)
        more, less = more << 1 & full, less << 1 & full  # a stretch may begin anywhere: nothing is carried in
        up, down = less | ~((eq | down) | more) & full, more & (eq | down)
        if score < best:
            best, end = score, j + 1
    return best, end


def grounded(df: DataFrame, answer: str, text: str, *, edits: float = 0.0, name: str = "name", quote: str = "rationale") -> DataFrame:
    """``df`` with ``concepts``: the objects of a model's ``answer`` whose quote stands in ``text``, without regard to case.

    Each has its name, distance (edits to the nearest stretch) and end (characters up to that
    stretch's end).  At most ``edits`` of a quote's length may differ.  Objects without a quote
    go; a null answer or text grounds nothing.
    """
    ship(df.sparkSession)

    @F.pandas_udf("array<struct<name:string,distance:int,end:int>>")
    def kept(answers: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([list(_kept(a, t, edits, name, quote)) for a, t in zip(answers, texts)])

    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() != "concepts"]
    return df.select(*rest, kept(F.col(f"`{answer}`"), F.col(f"`{text}`")).alias("concepts"))


def _kept(answer: str | None, text: str | None, edits: float, name: str, quote: str) -> Iterator[dict]:
    if not answer or not text:
        return
    low = text.lower()
    for c in array_in(answer):
        q = c.get(quote)
        if not isinstance(q, str) or not q.strip():
            continue
        q = q.lower()
        if (at := low.find(q)) >= 0:
            yield {"name": str(c.get(name)), "distance": 0, "end": at + len(q)}
        elif edits and (found := least_distance(q, low))[0] <= edits * len(q):
            yield {"name": str(c.get(name)), "distance": found[0], "end": found[1]}


def _answers(text: Column) -> Column:
    """What a model may say of a text: quotes from it in other case, with an edit, from elsewhere and none."""
    clean = F.regexp_replace(text, r'[^A-Za-z0-9 ]', " ")
    one = lambda n, q: F.concat(F.lit(f'{{"name": "{n}", "rationale": "'), q, F.lit('"}'))
    quote = F.regexp_extract(text, "[A-Za-z ]{12,}", 0)
    return F.concat(F.lit("Here you are:\n```json\n["), F.concat_ws(", ", one("exact", F.upper(quote)), one("other", F.concat(F.lit("unheard of "), F.substring(clean, 1, 20))), one("none", F.lit("")), F.lit("7")), F.lit(",]\n```\nDone."))


@query("rationale_grounding", r"""
WITH q AS (SELECT doc_id, text, regexp_extract(text, '[A-Za-z ]{12,}', 0) AS q, 'unheard of ' || substring(regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g'), 1, 20) AS o FROM documents)
SELECT doc_id, CASE WHEN trim(q) <> '' THEN 'exact' ELSE '' END || CASE WHEN contains(lower(text), lower(o)) THEN '|other' ELSE '' END AS names,
  CASE WHEN trim(q) <> '' THEN position(lower(q) IN lower(text)) - 1 + length(q) ELSE -1 END AS stretch_end FROM q""")
def rationale_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of a model's answer to each document that their quotes bear out."""
    docs = table(spark, d, "documents").select("doc_id", "text", _answers(F.col("text")).alias("answer"))
    g = grounded(docs, "answer", "text")
    first = F.filter("concepts", lambda c: c["name"] == "exact")
    return g.select("doc_id", F.array_join(F.transform("concepts", lambda c: c["name"]), "|").alias("names"), F.coalesce(F.get(first, 0)["end"].cast("long"), F.lit(-1).cast("long")).alias("stretch_end"))
