"""Words of megabytes, windows that share no token, tokenizers of other kinds, and notices of many forms."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer, models, pre_tokenizers

from textloom.llm import byte_bpe, license_scan, token_files

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.WordCoder(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def ids(coder, word):
    return np.frombuffer(coder.words([word])[0], "<u4").tolist()


def test_words_of_all_lengths_equal_the_library(coder, library):
    rnd = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for n in (63, 64, 65, 95, 96, 97, 128, 129, 1000, 5000):
        for word in ("".join(rnd.choices(letters, k=n)), "a" * n, ("thetion" * n)[:n], "".join(rnd.choices("ab", k=n)), "".join(rnd.choices("éñ中ا", k=n)), " " * n, "-" * n, "=" * n):
            assert ids(coder, word) == library.encode_ordinary(word), word[:80]


def test_words_of_megabytes(spark, coder, library):
    words = {1: "a" * 3_000_000, 2: "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyz", k=150_000)), 3: "x " + "ab" * 400_000 + " y"}
    df = spark.createDataFrame(list(words.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in byte_bpe.encode(df, path=PATH, pattern=P.PATTERN).collect()}
    for k, text in words.items():
        assert got[k].ids == library.encode_ordinary(text) and bytes(got[k].decoded) == text.encode()


def test_windows_without_a_common_token_are_widened(coder, library, monkeypatch):
    # windows smaller than the vocabulary's longest tokens
    monkeypatch.setattr(byte_bpe, "WINDOW", 8)
    monkeypatch.setattr(byte_bpe, "STEP", 4)
    wide = []
    monkeypatch.setattr(coder, "_wide", lambda w, keep=coder._wide: wide.append(len(w)) or keep(w))
    rnd = random.Random(3)
    vocab = sorted(t.decode() for t in coder.ranks if t.isalpha() and t.isascii() and len(t) > 7)
    for n in (10, 100, 400):
        for word in (" " * n, "-" * n, "".join(rnd.choice(vocab) for _ in range(n // 5)), "a" * n):
            assert ids(coder, word) == library.encode_ordinary(word), word
    assert wide


def test_cost_grows_with_the_length(coder, monkeypatch):
    queries = []
    monkeypatch.setattr(coder, "_run", lambda q, name, rows, keep=coder._run: queries.append(rows.num_rows) or keep(q, name, rows))
    rows = []
    for n in (20_000, 40_000):
        queries.clear()
        coder.words(["".join(random.Random(n).choices("abcdefghijklmnopqrstuvwxyz", k=n))])
        rows.append(sum(queries))
    assert rows[1] < 2.1 * rows[0]


def test_a_tokenizer_of_another_kind_gets_whole_texts(spark, tmp_path):
    letters = sorted(pre_tokenizers.ByteLevel.alphabet())
    merges = [("Ġ", "t"), ("h", "e"), ("Ġt", "he"), ("a", "t")]
    t = Tokenizer(models.BPE({c: i for i, c in enumerate([*letters, *(a + b for a, b in merges)])}, merges))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    path = str(tmp_path / "other.json")
    t.save(path)
    assert token_files.by_parts(Tokenizer.from_file(P.path("word_bpe_49k.json"))) and not token_files.by_parts(t)
    text = "the cat sat on the mat"
    want = t.encode(text).ids
    got = [np.frombuffer(b, "<u2").tolist() for b in token_files.token_bytes([text, None, ""], path, 9)]
    assert got == [[*want, 9], [9], [9]]


GPL = "This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version {} of the License, or\n * (at your option) any later version."


@pytest.mark.parametrize("text,want", [
    (GPL.format(2), ["GPL-2.0-or-later"]), (GPL.format(3), ["GPL-3.0-or-later"]), ("Licensed under the GPLv2", ["GPL-2.0"]), ("GNU GPL v3 or later", ["GPL-3.0-or-later"]),
    ("// SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]), ("It is MIT licensed.", ["MIT"]), ("Creative Commons Attribution-ShareAlike 4.0 International License", ["CC-BY-SA-4.0"]),
    ("Released under the Expat License", ["MIT"]), ("Released under the BSD 3-Clause Clear License.", []), ("Released under the BSD 3-Clause License. Clear skies.", ["BSD-3-Clause"]),
    ("SPDX-License-Identifier: BSD-3-Clause-Clear", ["BSD-3-Clause-Clear"]), ("Creative Commons Attribution-NonCommercial 4.0 International License", ["CC-BY-NC-4.0"]), ("not Released under the MIT License", []),
])
def test_notices_of_many_forms(text, want):
    scanner = license_scan._scanner(license_scan.TEMPLATES)
    assert [f["license"] for f in scanner.scan(f"Words before it. {text}\nAnd words after.")] == want
