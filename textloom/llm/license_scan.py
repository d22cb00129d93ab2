"""License scans by conditional compression.

The words around each trigger word are cut into blocks that overlap by the longest
template's length.  A block is compressed on its own and again with each template that
it could hold as the raw zstandard dictionary; templates are taken in order of the
bytes that they save.  A winner is confirmed by its wording: most of its words must
stand there in order, and no difference may touch a word that tells licenses apart, as
names, versions and conditions do.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from textloom.session import ship

FOUND = "array<struct<license:string,start:int,end:int,saved:double,similarity:double,differences:string>>"
#: Least share of a template's words that a place has in order.
SIMILARITY = 0.8


@dataclass(frozen=True)
class Template:
    license: str
    text: str


#: Paragraphs of public licenses.
PARAGRAPHS = (
    Template("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"""),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"""),
    Template("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"""),
    Template("Zlib", """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"""),
    Template("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("BSD-3-Clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"""),
    Template("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    Template("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License"""),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    Template("Unlicense", "This is free and unencumbered software released into the public domain"),
    Template("CC0-1.0", "Released into the public domain under CC0 1.0."),
)
#: The notices that the GNU licenses ask for, by program, license, version.
GNU = tuple(
    Template(f"{k}-{v if '.' in v else v + '.0'}-or-later", f"""This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version.""")
    for k, name, what, versions in (("GPL", "General Public License", "program", "123"), ("LGPL", "Lesser General Public License", "library", ("2.1", "3")), ("AGPL", "Affero General Public License", "program", "3")) for v in versions)
#: Ways to name a license in a short notice.
FORMS = ("Released under the {}.", "Licensed under the {}.", "Distributed under the {}.", "This work is licensed under the {}.", "This library is licensed under the {}.", "Available under the terms of the {}.")
#: Names of licenses as short notices have them.
NAMES = {
    "MIT": ("MIT License", "Expat License"), "ISC": ("ISC License",), "BSD": ("BSD License",), "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",), "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License, Version 1.0",), **{f"Apache-{v}": (f"Apache License, Version {v}",) for v in ("1.0", "1.1", "2.0")},
    **{f"GPL-{v}.0": (f"GNU General Public License, version {v}", f"GNU GPL version {v}") for v in (1, 2, 3)},
    **{f"LGPL-{v}": (f"GNU Lesser General Public License, version {n}",) for v, n in (("2.1", "2.1"), ("3.0", "3"))}, "LGPL-2.0": ("GNU Library General Public License, version 2",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",), **{f"MPL-{v}": (f"Mozilla Public License, version {v}",) for v in ("1.1", "2.0")}, "EPL-2.0": ("Eclipse Public License, version 2.0",),
}
#: Names that need no form around them.
BARE = {
    **{f"{g}-{v}.0{end}": tuple(f"{a} {w}{v}{told}" for a in (f"GNU {g}", g) for w in ("v", "version ")) + (f"{g}v{v}{told}",) for g, vs in (("GPL", "123"), ("LGPL", "23"), ("AGPL", "3")) for v in vs for end, told in (("", ""), ("-or-later", " or later"))},
    "MIT": ("MIT licensed",), "BSD": ("BSD licensed",), "ISC": ("ISC licensed",), "Apache-2.0": ("Apache 2.0 licensed", "Apache-2.0 licensed"),
}
#: Identifiers as files declare them.
SPDX = tuple("""MIT ISC Zlib BSL-1.0 BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause Apache-1.1 Apache-2.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 Unlicense CC0-1.0 GPL-1.0 GPL-2.0 GPL-3.0 GPL-2.0-only GPL-2.0-or-later
GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-3.0 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later""".split())
#: The conditions of the Creative Commons licenses in words.
CONDITIONS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
#: Conditions and versions of the Creative Commons licenses.
CC = tuple((c, v) for c in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("2.0", "2.5", "3.0", "4.0"))
TEMPLATES = (
    *PARAGRAPHS, *GNU, *(Template(k, form.format(n)) for k, ns in NAMES.items() for n in ns for form in FORMS),
    *(Template(f"CC-{c}-{v}", text) for c, v in CC for text in (f"Licensed under CC {c} {v}.", f"Released under the CC {c} {v} license.", f"Creative Commons {'-'.join(CONDITIONS[x] for x in c.split('-'))} {v} {'International' if v == '4.0' else 'Unported'} License")),
    *(Template(k, n) for k, ns in BARE.items() for n in ns), *(Template(k, f"SPDX-License-Identifier: {k}") for k in SPDX),
)
#: Words that tell licenses apart; a difference in one of them, or in a version, refuses a template.
TELLING = frozenset("""mit isc bsd zlib boost apache gnu gpl lgpl agpl general lesser library affero mozilla mpl eclipse epl public domain cc cc0 creative commons attribution
noncommercial noderivatives sharealike by by-sa by-nc by-nd by-nc-sa by-nc-nd by-nd-nc x11 expat artistic proprietary clear not no""".split())
_VERSION = re.compile(r"(l?gpl|agpl|mpl|epl)?v?[0-9]+(\.[0-9]+)*\+?(-clause)?")
#: Words of which at least one stands in each template.
TRIGGER = r"(?i)licen[sc]|gpl|permission|redistribution|cc0|advertising|public domain"
#: Templates of so many words at most are sought in short blocks, longer ones in long blocks before them.
SHORT = 24
_TRIGGER, _WORD = re.compile(TRIGGER), re.compile(r"[A-Za-z0-9]+(?:[.+-][A-Za-z0-9]+)*")
_SPACE, _GAP = re.compile(r"\s+"), re.compile(r"[ \t]*\r?\n?[ \t]*")


def stretches(text: str, reach: int) -> Iterator[list[tuple[str, int, int]]]:
    """Words, with their spans, that have a trigger word among the ``reach`` words before or after them."""
    found = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
    starts = [w[1] for w in found]
    a = e = 0
    for m in _TRIGGER.finditer(text):
        i = max(0, bisect_right(starts, m.start()) - 1)
        if i - reach > e:
            yield found[a:e]
            a = i - reach
        e = i + reach + 1
    yield found[a:e]


def normal(text: str) -> str:
    return _SPACE.sub(" ", text.lower()).strip()


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def edits(block: list[str], template: list[str]) -> list[int]:
    """The least edits with which a template's words end at each word of a block, column by column in bits (Myers)."""
    m = len(template)
    top, full = 1 << m - 1, (1 << m) - 1
    at: dict[str, int] = {}
    for i, w in enumerate(template):
        at[w] = at.get(w, 0) | 1 << i
    more, less, score, out = full, 0, m, []
    for w in block:
        eq = at.get(w, 0)
        down = eq | less
        across = ((eq & more) + more ^ more) | eq
        up, low = less | full & ~(across | more), more & across
        score += bool(up & top) - bool(low & top)
        up, low = up << 1 & full, low << 1 & full
        more, less = low | full & ~(down | up), up & down
        out.append(score)
    return out


def wording(block: Sequence[str], template: Sequence[str]) -> tuple[float, int, int, tuple[tuple[str, str], ...]]:
    """Best place of a template's words in a block: similarity, first and last word, and the differences.

    An edit is one word left out, put in or replaced; what stands before and after
    the place is free.  A difference is (template's word, block's word), either empty.
    """
    n, m = len(block), len(template)
    at: dict[str, list[int]] = {}
    for j, w in enumerate(block):
        at.setdefault(w, []).append(j)
    cost = np.zeros((m + 1, n + 1), np.int32)
    steps = np.arange(n + 1, dtype=np.int32)
    for i in range(1, m + 1):
        row = cost[i]
        row[0] = i
        row[1:] = cost[i - 1, :-1] + 1
        if template[i - 1] in at:
            j = np.array(at[template[i - 1]])
            row[j + 1] -= 1
        np.minimum(row[1:], cost[i - 1, 1:] + 1, out=row[1:])
        # words put in: the least so far, one more a step
        row[:] = np.minimum.accumulate(row - steps) + steps
    end = j = int(cost[m].argmin())
    i, diffs = m, []
    while i:
        here = cost[i, j]
        if j and here == cost[i - 1, j - 1] + (block[j - 1] != template[i - 1]):
            if block[j - 1] != template[i - 1]:
                diffs.append((template[i - 1], block[j - 1]))
            i, j = i - 1, j - 1
        elif here == cost[i - 1, j] + 1:
            diffs.append((template[i - 1], ""))
            i -= 1
        else:
            diffs.append(("", block[j - 1]))
            j -= 1
    return max(0.0, 1 - int(cost[m, end]) / max(1, m)), j, end, tuple(reversed(diffs))


def told(differences: Sequence[tuple[str, str]]) -> str:
    return " ".join(f"{a}>{b}" if a and b else f"-{a}" if a else f"+{b}" for a, b in differences)


def tells(word: str) -> bool:
    """Whether a word, or a part of it between hyphens, is a name, a condition or a version (a year is none)."""
    return any(w in TELLING for w in (word, *word.split("-"))) or bool(_VERSION.fullmatch(word)) and not (word.isdigit() and len(word) == 4)


def refused(differences: Sequence[tuple[str, str]]) -> bool:
    """Whether a difference touches a telling word."""
    return any(tells(w) for pair in differences for w in pair if w)


@dataclass(frozen=True)
class Prepared:
    """A template's words, what it may differ in, and the compressor that has it as its dictionary."""

    template: Template
    own: tuple[str, ...]
    distinct: frozenset[str]
    most: int
    given: zstandard.ZstdCompressor


class Scanner:
    def __init__(self, templates: tuple[Template, ...]):
        params = zstandard.ZstdCompressionParameters.from_level(3, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.alone = zstandard.ZstdCompressor(compression_params=params)
        prepared = []
        for t in templates:
            own = tuple(words(t.text))
            if own:
                most = next(e for e in range(len(own), -1, -1) if 1 - e / len(own) >= SIMILARITY)
                given = zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(normal(t.text).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
                prepared.append(Prepared(t, own, frozenset(own), most, given))
        longest = lambda ts: max((len(t.own) + t.most for t in ts), default=0)
        # long templates first: a short notice may be the beginning of a paragraph
        kinds = [[t for t in prepared if len(t.own) > SHORT], [t for t in prepared if len(t.own) <= SHORT]]
        self.kinds = [(ts, longest(ts)) for ts in kinds if ts]
        self.reach = longest(prepared)
        self.wording = lru_cache(1 << 12)(wording)

    def ranked(self, block: str, having: set[str], templates: list[Prepared]) -> list[tuple[int, int, Prepared]]:
        """Templates that a block could hold, by the bytes that they save of it, and its size with them."""
        possible = [t for t in templates if len(t.distinct & having) >= len(t.distinct) - t.most]  # an edit takes one word at most
        if not possible:
            return []
        data = normal(block).encode("utf-8", "surrogatepass")
        size = len(self.alone.compress(data))
        sizes = [(len(t.given.compress(data)), t) for t in possible]
        return sorted(((size - s, s, t) for s, t in sizes), key=lambda r: (-r[0], -len(r[2].own), r[2].template.license))

    def places(self, body: list[str], t: Prepared) -> Iterator[tuple[float, int, int, tuple]]:
        """Places of a block that agree with a template, the closest first."""
        cost = edits(body, list(t.own))
        ends = [j for j, c in enumerate(cost) if c <= t.most and c <= min(cost[max(0, j - 1) : j + 2])]
        for j in sorted(ends, key=lambda j: (cost[j], j)):
            from_ = max(0, j + 1 - len(t.own) - t.most)
            similarity, i, n, differences = self.wording(tuple(body[from_ : j + 1]), t.own)
            yield similarity, from_ + i, from_ + n, differences

    def goes_on(self, text: str, stretch: list[tuple[str, int, int]], after: int) -> bool:
        """Whether a name goes on behind a place: the next word, with nothing but white space before it, is a telling one."""
        if after >= len(stretch):
            return False
        word, start, _ = stretch[after]
        return tells(word) and _GAP.fullmatch(text, stretch[after - 1][2], start) is not None

    def scan(self, text: str) -> list[dict]:
        out = []
        for stretch in stretches(text, self.reach):
            body = [w for w, _, _ in stretch]
            free = [True] * len(body)
            for templates, reach in self.kinds:
                # a block is answerable for places that begin in its first ``reach`` words, and sees ``reach`` words more
                for a in range(0, len(body), reach):
                    part = body[a : a + 2 * reach]
                    block = text[stretch[a][1] : stretch[a + len(part) - 1][2]]
                    for saved, given, t in self.ranked(block, set(part), templates):
                        for similarity, i, n, differences in self.places(part, t):
                            if i >= reach or not all(free[a + i : a + n]) or refused(differences) or body[a + i - 1 : a + i] == ["not"] or self.goes_on(text, stretch, a + n):
                                continue
                            free[a + i : a + n] = [False] * (n - i)
                            first, end = stretch[a + i][1], stretch[a + n - 1][2]
                            end += text[end : end + 1] in (".", "!", "?")
                            out.append({"license": t.template.license, "start": first, "end": end, "saved": saved / max(1, saved + given), "similarity": similarity, "differences": told(differences)})
        return sorted(out, key=lambda f: f["start"])


@cache
def _scanner(templates: tuple[Template, ...]) -> Scanner:
    return Scanner(templates)


def scan_licenses(df: DataFrame, *, templates: tuple[Template, ...] = TEMPLATES, text: str = "text", into: str = "licenses") -> DataFrame:
    """``df`` with an array ``into``: license, span of the place in code points, saving, similarity and differences.

    Searched are the words of whole texts that have a trigger word at most one
    template's length before or after them, across line ends.  ``saved`` is the share
    of the block's compressed size that the template as a dictionary takes off; of
    templates that claim the same words the one that saves most is named, if 80 % of
    its words stand there in order, no telling word differs or follows and no "not" stands
    before them, else the next.  Saving
    orders and never rejects, so what stands around a notice doesn't matter.  Texts
    that are null, empty or without a trigger word have none and skip the Python
    step's work.  Rows aren't moved.  A column named ``into`` is replaced.
    """
    ship(df.sparkSession)

    @F.pandas_udf(FOUND)
    def scan(texts: pd.Series) -> pd.Series:
        s = _scanner(templates)
        return pd.Series([s.scan(t) if isinstance(t, str) else [] for t in texts], dtype=object)

    body = F.col(f"`{text}`")
    return df.withColumn(into, scan(F.when(body.rlike(TRIGGER), body)))


def license_table(df: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Number of notices, their licenses and their spans for every row."""
    out = scan_licenses(df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), into="found").drop("text")
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"])))
    spans = F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"], F.round(x["similarity"], 3), x["differences"]))
    return out.select("doc_id", F.size("found").cast("long").alias("n_notices"), F.array_join(names, ",").alias("licenses"), F.array_join(spans, ",").alias("notices"))
