"""Text columns: words, keywords, patterns, redaction and fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Words that carry no topic.
STOP_WORDS = tuple("the a an and or but in on at to for of with by is are was were be been being have has had do does did will would could should".split())
#: Characters that are stripped from a word's ends.
STRIPPED = r'[.,!?;:"()\[\]{}]+'
ENDS = '.,!?;:"()[]{}'


def words(text: Column) -> Column:
    """Lower-case words between ASCII white space."""
    return F.filter(F.split(F.lower(text), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def keywords(text: Column) -> Column:
    """Words of three letters or more that aren't stop words; punctuation goes after that test."""
    kept = F.filter(F.split(F.lower(text), r"[ \t\n\r\f\x0B]+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    return F.filter(F.transform(kept, lambda w: F.btrim(w, F.lit(ENDS))), lambda w: w != "")


def each_keyword(df: DataFrame, *keep: str, text: str = "text", name: str = "word") -> DataFrame:
    """``keep`` and one row for each of a text's ``keywords``: tests on rows are compiled, those in arrays are not."""
    w = df.select(*keep, F.explode(F.split(F.lower(text), r"[ \t\n\r\f\x0B]+")).alias(name)).where((F.length(name) > 2) & ~F.col(name).isin(*STOP_WORDS))
    return w.withColumn(name, F.btrim(name, F.lit(ENDS))).where(F.col(name) != "")


def jaccard(a: Column, b: Column) -> Column:
    """Common over united elements; 0 where either is empty."""
    both, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / union)


#: Ordered redaction rules (name, pattern, replacement).
REDACTIONS = (
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "[SSN-REDACTED]"),
    ("ssn_no_dash", r"\b[0-9]{9}\b", "[SSN-REDACTED]"),
    ("credit_card", r"\b[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}\b", "[CARD-REDACTED]"),
    ("bank_account", r"\b[0-9]{8,17}\b", "[ACCOUNT-REDACTED]"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL-REDACTED]"),
    ("phone", r"\b[0-9]{3}[- ]?[0-9]{3}[- ]?[0-9]{4}\b", "[PHONE-REDACTED]"),
    ("phone_international", r"\+[0-9]{1,3}[- ]?[0-9]{3,14}", "[PHONE-REDACTED]"),
    ("zip_code", r"\b[0-9]{5}(?:-[0-9]{4})?\b", "[ZIP-REDACTED]"),
    ("jwt_token", r"eyJ[A-Za-z0-9_=-]+\.[A-Za-z0-9_=-]+\.?[A-Za-z0-9_.+/=-]*", "[JWT-REDACTED]"),
    ("api_key", r'(?i)(api[_-]?key|token|secret)["\s]*[:=]["\s]*[A-Za-z0-9+/=]{20,}', "$1: [API-KEY-REDACTED]"),
    ("password", r'(?i)(password|passwd|pwd)["\s]*[:=]["\s]*[^\s"]{6,}', "$1: [PASSWORD-REDACTED]"),
    ("ipv4", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "[IP-REDACTED]"),
    ("medical_record", r"\b(MRN|MR#|Medical Record)[:\s]*[0-9]+", "[MEDICAL-RECORD-REDACTED]"),
    ("passport", r"\b[A-Z]{1,2}[0-9]{6,9}\b", "[PASSPORT-REDACTED]"),
    ("drivers_license", r"\b[A-Z]{1,2}[0-9]{6,8}\b", "[LICENSE-REDACTED]"),
)
#: Rules that are off unless asked for.
OFF = ("ipv4",)


def redact(text: Column, rules=REDACTIONS, off: tuple[str, ...] = OFF) -> Column:
    """All rules that are on, one after the other in their order; a null text stays null."""
    return reduce(lambda c, r: F.regexp_replace(c, r[1], r[2]), [r for r in rules if r[0] not in off], text)


def is_sensitive(text: Column, rules=REDACTIONS, off: tuple[str, ...] = OFF) -> Column:
    """Whether any rule that is on matches."""
    return reduce(lambda c, r: c | text.rlike(r[1]), [r for r in rules if r[0] not in off], F.lit(False))


#: Ordered steps that reduce an error message to its pattern.
ERROR_STEPS = (
    (r"/[^\s]+", "<path>"), (r"\b[0-9]+\b", "<number>"), (r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T\s][0-9]{2}:[0-9]{2}:[0-9]{2}", "<timestamp>"),
    (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"),
)


def error_pattern(message: Column) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, *r), ERROR_STEPS, message)


#: Ordered steps of a query's fingerprint.
SQL_STEPS = (
    (r"\s+", " "), (r"\$[0-9]+", "\\$PARAM"), (r":\w+", ":PARAM"), (r"\?", "?PARAM"), (r"'[^']*'", "'STRING'"), (r'"[^"]*"', '"STRING"'), (r"\b[0-9]+\b", "NUMBER"),
    (r"\b[0-9]+\.[0-9]+\b", "DECIMAL"),
)


def sql_fingerprint(statement: Column) -> Column:
    return F.upper(reduce(lambda c, r: F.regexp_replace(c, *r), SQL_STEPS, F.trim(statement)))


def chunk_id(doc_id: Column, content: Column) -> Column:
    """Deterministic id of a chunk: 16 bytes of a digest, written as a UUID of version 4 and the standard variant."""
    h = F.substring(F.sha2(F.concat_ws(":", doc_id.cast("string"), content), 256), 1, 32)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
