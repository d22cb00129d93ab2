"""Byte automata: rule patterns to minimal transition arrays by subset construction.

The patterns use literals, ``\\x20``-like escapes, classes, groups, ``|`` and the
repetitions ``? * + {m} {m,} {m,n}``.  Matching is leftmost and longest.
"""

from __future__ import annotations

from dataclasses import dataclass

ALL = frozenset(range(256))


class _Parser:
    """Pattern to a tree: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, low, high)."""

    def __init__(self, pattern: str, ignore_case: bool):
        self.p, self.i, self.fold = pattern, 0, ignore_case

    def parse(self):
        tree = self._alt()
        if self.i != len(self.p):
            raise ValueError(f"unbalanced pattern at {self.i}: {self.p}")
        return tree

    def _peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def _take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def _alt(self):
        parts = [self._cat()]
        while self._peek() == "|":
            self._take()
            parts.append(self._cat())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def _cat(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            part = self._atom()
            while self._peek() and self._peek() in "?*+{":
                part = ("rep", part, *self._count())
            parts.append(part)
        return ("cat", parts)

    def _count(self):
        c = self._take()
        if c != "{":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        end = self.p.index("}", self.i)
        low, comma, high = self.p[self.i:end].partition(",")
        self.i = end + 1
        return int(low), (int(high) if high else None) if comma else int(low)

    def _atom(self):
        c = self._take()
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            inner = self._alt()
            if self._peek() != ")":
                raise ValueError(f"missing ) in {self.p}")
            self._take()
            return inner
        if c == "[":
            return ("set", self._class())
        if c == ".":
            return ("set", ALL - {10})
        raw = self._escape() if c == "\\" else c.encode()
        return ("cat", [("set", self._cased({b})) for b in raw])

    def _escape(self) -> bytes:
        c = self._take()
        if c == "x":
            self.i += 2
            return bytes([int(self.p[self.i - 2:self.i], 16)])
        return {"n": b"\n", "t": b"\t", "r": b"\r"}.get(c, c.encode())

    def _class(self) -> frozenset[int]:
        negate = self._peek() == "^"
        if negate:
            self._take()
        found: set[int] = set()
        while self._peek() != "]":
            low = self._class_byte()
            if self._peek() == "-" and self.p[self.i + 1] != "]":
                self._take()
                found |= set(range(low, self._class_byte() + 1))
            else:
                found.add(low)
        self._take()
        return ALL - self._cased(found) if negate else self._cased(found)

    def _class_byte(self) -> int:
        c = self._take()
        raw = self._escape() if c == "\\" else c.encode()
        if len(raw) != 1:
            raise ValueError(f"classes hold single bytes only: {self.p}")
        return raw[0]

    def _cased(self, found) -> frozenset[int]:
        """Letters in either case are ASCII letters; others have one form."""
        if not self.fold:
            return frozenset(found)
        return frozenset(x for b in found for x in (bytes([b]).lower()[0], bytes([b]).upper()[0]))


def _reversed(tree):
    kind = tree[0]
    if kind == "cat":
        return ("cat", [_reversed(t) for t in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [_reversed(t) for t in tree[1]])
    return ("rep", _reversed(tree[1]), *tree[2:]) if kind == "rep" else tree


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Add a tree behind ``start``; returns its end."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for t in tree[1]:
                start = self.add(t, start)
            return start
        if kind == "alt":
            end = self.state()
            for t in tree[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(t, first)].append(end)
            return end
        _, part, low, high = tree
        for _ in range(low):
            start = self.add(part, start)
        if high is None:
            loop, end = self.state(), self.state()
            self.empty[start] += [loop, end]
            self.empty[self.add(part, loop)] += [loop, end]
            return end
        end = self.state()
        self.empty[start].append(end)
        for _ in range(high - low):
            start = self.add(part, start)
            self.empty[start].append(end)
        return end

    def closed(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Dfa:
    """``rows[state][byte]`` is the next state; ``accepts[state]`` has a bit for each rule.

    States that accept come last, from ``first_accept`` on.  State ``dead`` (or -1)
    is never left again.
    """

    rows: list[list[int]]
    accepts: list[int]
    start: int
    first_accept: int
    dead: int


def build(patterns: list[tuple[str, bool]], *, backward: bool = False, search: bool = False) -> Dfa:
    """One minimal automaton for all patterns (pattern, ignore case).

    ``backward`` reads the text from its end.  ``search`` lets a match begin at any
    place of the reading, so one pass sees every rule's matches.
    """
    nfa = _Nfa()
    starts, ends = [], {}
    for k, (pattern, fold) in enumerate(patterns):
        tree = _Parser(pattern, fold).parse()
        s = nfa.state()
        starts.append(s)
        ends[nfa.add(_reversed(tree) if backward else tree, s)] = 1 << k
    first = nfa.closed(starts)
    # bytes that no pattern tells apart share a column
    sets = sorted({m[0] for moves in nfa.moves for m in moves}, key=sorted)
    kinds: dict[tuple, int] = {}
    column = [kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)]
    sample = [column.index(c) for c in range(len(kinds))]
    number, table, todo = {first: 0}, [], [first]
    for now in todo:  # subset construction
        out = []
        for b in sample:
            to = {t for s in now for chars, t in nfa.moves[s] if b in chars}
            nxt = nfa.closed(to) | (first if search else frozenset())
            if nxt not in number:
                number[nxt] = len(number)
                todo.append(nxt)
            out.append(number[nxt])
        table.append(out)
    accepts = [sum({ends[s] for s in now if s in ends}) for now in todo]
    group = accepts
    while True:  # minimisation: split groups until all members of one go to the same groups
        names: dict[tuple, int] = {}
        finer = [names.setdefault((group[s], *(group[t] for t in table[s])), len(names)) for s in range(len(table))]
        if len(names) == len(set(group)):
            break
        group = finer
    members = {g: s for s, g in reversed(list(enumerate(finer)))}
    order = sorted(members, key=lambda g: (accepts[members[g]] != 0, members[g]))
    renumber = {g: i for i, g in enumerate(order)}
    rows = [[renumber[finer[table[members[g]][c]]] for c in column] for g in order]
    masks = [accepts[members[g]] for g in order]
    dead = next((i for i, r in enumerate(rows) if not masks[i] and set(r) == {i}), -1)
    return Dfa(rows, masks, renumber[finer[0]], next((i for i, m in enumerate(masks) if m), len(masks)), dead)


def match_starts(dfa: Dfa, data: bytes) -> list[tuple[int, int]]:
    """(place, rules) for each place where a match begins, by one pass from the end; ``dfa``: backward and search."""
    rows, accepting, s, at = dfa.rows, dfa.first_accept, dfa.start, len(data)
    found = []
    for b in reversed(data):
        s = rows[s][b]
        at -= 1
        if s >= accepting:
            found.append((at, dfa.accepts[s]))
    found.reverse()
    return found


def longest(dfa: Dfa, data: bytes, at: int, rule: int) -> int:
    """End of the longest match of one rule at a place, or -1; ``dfa``: forward, not search."""
    rows, s, end, bit = dfa.rows, dfa.start, -1, 1 << rule
    for i in range(at, len(data)):
        s = rows[s][data[i]]
        if dfa.accepts[s] & bit:
            end = i + 1
        elif s == dfa.dead:
            break
    return end
