"""Scoring rules that are written once, as expressions, and read by Spark and by the oracle.

Both engines have the same scalar functions under slightly other names; ``spark`` and
``duck`` put those in.  Joins, windows and groupings are not written this way.
"""

from __future__ import annotations

_WORDS = (
    ("@rx(", "regexp_like(", "regexp_matches("), ("@'", "r'", "'"), ("@n(", "size(", "len("), ("@inter(", "array_intersect(", "list_intersect("), ("@dist(", "array_distinct(", "list_distinct("),
    ("@cat(", "concat(", "list_concat("), ("@flt(", "filter(", "list_filter("), ("@map(", "transform(", "list_transform("), ("@x", "x ->", "lambda x:"), ("@slice(", "slice(", "list_slice("), ("@join(", "array_join(", "array_to_string("), ("@split(", "split(", "regexp_split_to_array("),
    ("@max(", "array_max(", "list_max("), ("@min(", "array_min(", "list_min("), ("@double", "double", "DOUBLE"), ("@sort(", "array_sort(", "list_sort("), ("@all(", "regexp_extract_all(", "regexp_extract_all("),
)


def spark(rule: str) -> str:
    for mark, name, _ in _WORDS:
        rule = rule.replace(mark, name)
    return rule


def duck(rule: str) -> str:
    for mark, _, name in _WORDS:
        rule = rule.replace(mark, name)
    return rule


def any_of(column: str, words: tuple[str, ...]) -> str:
    """Whether a column contains one of the words."""
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def jaccard(a: str, b: str, empty: str = "0.0") -> str:
    """Common over united elements of two arrays without repeats; ``empty`` where either is empty."""
    return f"CASE WHEN @n({a}) = 0 OR @n({b}) = 0 THEN {empty} ELSE @n(@inter({a}, {b})) * 1.0 / (@n({a}) + @n({b}) - @n(@inter({a}, {b}))) END"


def found_words(column: str, words: tuple[str, ...]) -> str:
    """Those of the words that a column contains, as an array."""
    return "@flt(" + f"{_array(words)}, @x contains({column}, x))"


def _array(words: tuple[str, ...]) -> str:
    # both engines split a text into the same list
    return "@split('" + "|".join(words) + "', @'\\|')"
