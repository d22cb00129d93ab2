"""Redaction of nested JSON, and grounding of quotes, against brute force."""

import hashlib
import json
import random

from textloom.operators import nested as N


def test_redaction_by_key_and_value(spark):
    value = {
        "User": {"Email": "a@b.org", "pwd": "", "tokens": 0, "apiKeys": {"deep": "s3cret"}, "note": "call 555-123-4567"},
        "list": [["ssn 123-45-6789", {"ZIP": 12345, "x": None}], True, 1.5],
        "plain": "nothing to see",
    }
    rows = [(1, json.dumps(value)), (2, None), (3, "not json: a@b.org"), (4, "[]"), (5, '"x"'), (6, "[" * 20_000)]
    df = spark.createDataFrame([(k, j, "old") for k, j in rows], "id long, j string, Digest string")
    got = {r.id: r for r in N.redact_json(df, "j").collect()}
    one = json.loads(got[1].redacted)
    assert one == {
        "User": {"Email": "[REDACTED]", "pwd": "", "tokens": 0, "apiKeys": {"deep": "s3cret"}, "note": "call [PHONE-REDACTED]"},
        "list": [["ssn [SSN-REDACTED]", {"ZIP": "[REDACTED]", "x": None}], True, 1.5],
        "plain": "nothing to see",
    }
    assert [(c.path, c.rule) for c in got[1].changes] == [("$.User.Email", "key"), ("$.User.note", "phone"), ("$.list[0][0]", "ssn"), ("$.list[0][1].ZIP", "key")]
    assert got[1].digest == hashlib.sha256(N.canonical(value).encode()).hexdigest()
    assert (got[2].redacted, got[2].changes, got[2].digest) == (None, None, None)
    assert json.loads(got[3].redacted) == "not json: [EMAIL-REDACTED]" and got[4].redacted == "[]" and got[4].changes == [] and got[6].changes == []
    strict = {r.id: r for r in N.redact_json(df, "j", strict=True).collect()}
    assert json.loads(strict[1].redacted)["User"]["apiKeys"] == {"deep": "[REDACTED]"}


def test_arrays_in_answers():
    assert N.array_in('x ```json\n[{"a": 1}, {"b": [2]},]\n``` y [{"c": 3}]') == [{"a": 1}, {"b": [2]}]
    assert N.array_in('see [1] and [{"a": "]"}, {"b": "cut') == [{"a": "]"}]
    assert N.array_in("no array") == N.array_in("") == N.array_in("[[") == []


def distance_by_hand(q, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(q, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row), row.index(min(row))


def test_least_distance_equals_dynamic_programming():
    rnd = random.Random(3)
    for _ in range(2000):
        q = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12)))
        t = "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 30)))
        assert N.least_distance(q, t) == distance_by_hand(q, t), (q, t)


def test_grounding_with_edits(spark):
    text = "The river Rhône rises in a glacier. " * 50 + "It ends in the sea."
    answer = '[{"name": "a", "rationale": "RIVER rhône"}, {"name": "b", "rationale": "it emds in thesea"}, {"name": "c", "rationale": "volcano eruptions"}, {"name": "d"}, {"rationale": 7}, {"name": "e", "rationale": " "}]'
    df = spark.createDataFrame([(1, answer, text), (2, None, text), (3, answer, None)], "id long, answer string, text string")
    got = {r.id: [(c.name, c.distance) for c in r.concepts] for r in N.grounded(df, "answer", "text", edits=0.2).collect()}
    assert got == {1: [("a", 0), ("b", 2)], 2: [], 3: []}
    assert [c.name for c in N.grounded(df.where("id = 1"), "answer", "text").first().concepts] == ["a"]
