"""Chat formatting: minimum-cost role repair by dynamic programming over legal turns.

A legal conversation has at most one system message, first, then user and assistant
in turn, and ends with the assistant.  Each turn is kept or relabelled and either
starts a message (after empty ones, where the automaton needs them) or is merged with
the one before; the cheapest choice for the whole conversation is rendered.

A conversation is cut into blocks of a bounded number of turns.  A block's costs from
each state to each other compose like matrices, so conversations of any length are
solved in parallel, with the same result as in one piece.  Only row numbers and role
codes go to Python; keys and texts stay in columns, and the pieces are rendered there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from textloom.llm.sharding import numbered
from textloom.session import ship, written

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = {v: k for k, v in ROLES.items()}
INF = 1 << 40
BLOCK = 4096


@dataclass(frozen=True)
class Costs:
    merge: int = 2
    relabel: int = 3
    insert: int = 4
    steps: tuple = field(init=False)

    def __post_init__(self):
        """steps[state][label]: (cost, merged, roles of empty messages put before)."""
        free, merged = (0, False, ()), (self.merge, True, ())
        put = lambda *roles: (self.insert * len(roles), False, roles)
        # of merging and inserting the cheaper; merging where they tie
        same = lambda other: min(merged, put(other), key=lambda s: s[0])
        never = (INF, False, ())
        object.__setattr__(self, "steps", (
            (never, free, free, put(USER)),
            (never, merged, free, put(USER)),
            (never, never, same(ASSISTANT), free),
            (never, never, free, same(USER)),
        ))

    def ending(self, state: int) -> tuple[int, ...]:
        """Roles of the empty messages that a conversation still needs."""
        return {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}[state]

    def turn(self, state: int, role: int, label: int) -> int:
        return self.steps[state][label][0] + (self.relabel if role != label else 0)


def forward(roles: list[int], entry: list[int], costs: Costs) -> list[list[int]]:
    """Least cost of being in each state before the first and after each turn."""
    rows = [entry]
    for r in roles:
        now = rows[-1]
        rows.append([INF, *[min(INF, min(now[s] + costs.turn(s, r, t) for s in range(4))) for t in (SYSTEM, USER, ASSISTANT)]])
    return rows


def backward(roles: list[int], rows: list[list[int]], exit_state: int, costs: Costs) -> list[int]:
    """States before the first and after each turn on the best way to ``exit_state``; of equal ways back the lowest state."""
    states = [exit_state]
    for i in range(len(roles) - 1, -1, -1):
        t = states[-1]
        states.append(min(range(4), key=lambda s: (rows[i][s] + costs.turn(s, roles[i], t), s)))
    return states[::-1]


def best_exit(last: list[int], costs: Costs) -> int:
    return min(range(4), key=lambda s: (last[s] + costs.insert * len(costs.ending(s)), s))


AT_START = [0, INF, INF, INF]


def repair_states(codes: Sequence[int], costs: Costs) -> list[int]:
    """States before the first and after each turn of one whole conversation."""
    rows = forward(codes, AT_START, costs)
    return backward(codes, rows, best_exit(rows[-1], costs), costs)


def repair(roles: list[str | None], costs: Costs = Costs()) -> list[int]:
    """Labels of one whole conversation."""
    return repair_states([ROLES.get(r or "", -1) for r in roles], costs)[1:]


def _groups(parts: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of each block together, over the borders of the batches; a block has at most BLOCK rows."""
    held = None
    for part in parts:
        part = pd.concat([held, part], ignore_index=True) if held is not None else part
        if not len(part):
            continue
        # keys are row numbers: never null, so never turned into floats
        k = part[keys].to_numpy()
        cuts = (np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist()
        for a, b in zip([0, *cuts], cuts):
            yield part.iloc[a:b]
        held = part.iloc[cuts[-1]:] if cuts else part
    if held is not None and len(held):
        yield held


def _solved(rows: DataFrame, costs: Costs, block: int) -> DataFrame:
    """``row``, state before and state after of every turn of ``rows`` (chat, block, row, code, n)."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda x, *more: x.repartition(parts, "chat", "block").sortWithinPartitions("chat", "block", *more)
    keys = ["chat", "block"]
    long = rows.where(F.col("n") > block)
    turns = rows.select(*keys, "row", "code")
    known = turns.withColumns({"entry": F.lit(None).cast("array<long>"), "leave": F.lit(None).cast("int")})
    if long.head(1):

        def matrices(frames):
            for g in _groups(frames, keys):
                roles = g["code"].tolist()
                m = [forward(roles, [0 if s == k else INF for s in range(4)], costs)[-1] for k in range(4)]
                yield pd.DataFrame({"chat": g["chat"].iloc[:1], "block": g["block"].iloc[:1], "m": [[x for row in m for x in row]]})

        def entries(frames):  # blocks of a chat in order: only the costs so far are held
            chat, now = None, AT_START
            for part in frames:
                out = []
                for c, m in zip(part["chat"], part["m"]):
                    now = AT_START if c != chat else now
                    chat = c
                    out.append(list(now))
                    now = [min(INF, min(now[s] + int(m[4 * s + t]) for s in range(4))) for t in range(4)]
                yield part[keys].assign(entry=out)

        def ways(frames):
            for g in _groups(frames, keys):
                roles = g["code"].tolist()
                f = forward(roles, [int(x) for x in g["entry"].iloc[0]], costs)
                yield pd.DataFrame({"chat": g["chat"].iloc[:1], "block": g["block"].iloc[:1], "entry": [f[0]], "back": [[backward(roles, f, t, costs)[0] for t in range(4)]], "best": [best_exit(f[-1], costs)]})

        def exits(frames):  # from the last block back
            chat, state = None, START
            for part in frames:
                out = []
                for c, back, best in zip(part["chat"], part["back"], part["best"]):
                    state = int(best) if c != chat else state
                    chat = c
                    out.append(state)
                    state = int(back[state])
                yield part[[*keys, "entry"]].assign(leave=out)

        slim = long.select(*keys, "row", "code")
        m = written(dealt(slim, "row").mapInPandas(matrices, "chat long, block long, m array<long>"), "matrices")
        e = m.repartition(parts, "chat").sortWithinPartitions("chat", "block").mapInPandas(entries, "chat long, block long, entry array<long>")
        w = written(dealt(slim.join(written(e, "entries"), keys), "row").mapInPandas(ways, "chat long, block long, entry array<long>, back array<int>, best int"), "ways")
        ends = written(w.repartition(parts, "chat").sortWithinPartitions("chat", F.desc("block")).mapInPandas(exits, "chat long, block long, entry array<long>, leave int"), "exits")
        known = turns.join(ends, keys, "left")

    def states(frames):
        solve = lru_cache(1 << 16)(lambda roles: repair_states(roles, costs))  # short conversations have few orders of roles
        for part in _joined(_groups(frames, keys)):
            out = []
            for g in part:
                roles, first = g["code"].tolist(), g["entry"].iloc[0]
                if first is None:
                    s = solve(tuple(roles)) if len(roles) <= 64 else repair_states(roles, costs)
                else:
                    s = backward(roles, forward(roles, [int(x) for x in first], costs), int(g["leave"].iloc[0]), costs)
                out.append(pd.DataFrame({"row": g["row"].to_numpy(), "before": s[:-1], "after": s[1:]}))
            yield pd.concat(out, ignore_index=True)

    return dealt(known, "row").mapInPandas(states, "row long, before int, after int")


def _joined(groups: Iterator[pd.DataFrame], rows: int = 10_000) -> Iterator[list[pd.DataFrame]]:
    held, n = [], 0
    for g in groups:
        held.append(g)
        n += len(g)
        if n >= rows:
            yield held
            held, n = [], 0
    if held:
        yield held


def format_chats(df: DataFrame, *, costs: Costs = Costs(), opening: str = "<|im_start|>{}\n", closing: str = "<|im_end|>\n", joiner: str = "\n", block: int = BLOCK) -> DataFrame:
    """One row per turn with its repair and its piece of the rendered conversation.

    ``df`` has ``conv_id``, ``turn``, ``role`` and ``text``; other columns are left out.
    The result has ``conv_id``, ``turn``, ``pos`` (gapless from 0 in order of turn, then
    role and text; nulls first), ``role``, ``new_role``, ``merged`` (joined to the message
    before), ``inserted`` (roles of empty messages before it), ``cost`` (the last turn's
    holds that of what is added at the end) and ``rendered``: the pieces of a conversation,
    joined by ``pos``, are the formatted chat.  A role that is null or unknown fits no
    label, so it is relabelled.  A null text is empty.  Rows with a null ``conv_id`` are
    one conversation.  No group is held in one task, however long a conversation is.
    Keys keep their type and value, whatever nulls are beside them.
    """
    ship(df.sparkSession)
    rows = numbered(df.select("conv_id", "turn", "role", "text"), ["conv_id", "turn", "role", "text"], "row")
    code = F.coalesce(*[F.when(F.col("role") == r, F.lit(c)) for r, c in ROLES.items()], F.lit(-1))
    whole = rows.groupBy("conv_id").agg(F.min("row").alias("chat"), F.count("*").alias("n")).withColumnRenamed("conv_id", "c__")
    slim = rows.select("conv_id", "row", code.alias("code"))
    slim = slim.join(whole, slim["conv_id"].eqNullSafe(whole["c__"])).select("chat", "n", "row", "code").withColumn("block", F.expr(f"(row - chat) div {block}"))
    slim = written(slim, "turns")
    solved = _solved(slim, costs, block).join(slim.select("row", "chat", "n", "code"), "row")
    label = lambda table: F.element_at(F.array(*[F.element_at(F.array(*row), F.col("after") + 1) for row in table]), F.col("before") + 1)
    names = lambda roles: F.array(*[F.lit(NAMES[r]) for r in roles]).cast("array<string>")
    empties = lambda roles: F.lit("".join(opening.format(NAMES[r]) + closing for r in roles))
    steps = [[costs.steps[s][max(t, 0)] if t else (0, False, ()) for t in range(4)] for s in range(4)]
    of = lambda f: label([[f(x) for x in row] for row in steps])
    ending = lambda f: F.element_at(F.array(*[f(costs.ending(s)) for s in range(4)]), F.col("after") + 1)
    last = F.col("pos") == F.col("n") - 1
    out = solved.withColumn("pos", F.col("row") - F.col("chat")).select(
        "row", "pos", F.element_at(F.array(*[F.lit(NAMES.get(t, "")) for t in range(4)]), F.col("after") + 1).alias("new_role"),
        of(lambda x: F.lit(x[1])).alias("merged"), of(lambda x: names(x[2])).alias("inserted"),
        (of(lambda x: F.lit(x[0]).cast("long")) + F.when(F.col("code") != F.col("after"), costs.relabel).otherwise(0) + F.when(last, ending(lambda e: F.lit(costs.insert * len(e)))).otherwise(0)).alias("cost"),
        of(lambda x: empties(x[2])).alias("empties"), F.when(last, F.concat(F.lit(closing), ending(empties))).otherwise("").alias("tail"))
    start = F.concat(F.when(F.col("pos") > 0, closing).otherwise(""), "empties", F.element_at(F.array(*[F.lit(opening.format(NAMES.get(t, ""))) for t in range(4)]), F.array_position(F.array(*[F.lit(NAMES.get(t, "")) for t in range(4)]), F.col("new_role")).cast("int")))
    piece = F.concat(F.when(F.col("merged"), joiner).otherwise(start), F.coalesce("text", F.lit("")), "tail")
    return rows.join(out, "row").select("conv_id", "turn", "pos", "role", "new_role", "merged", "inserted", "cost", piece.alias("rendered"))
