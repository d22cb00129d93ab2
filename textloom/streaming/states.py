"""Streams that keep a state for each user, and imports that can be resumed."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.plans.registry import query
from textloom.session import scratch, table, written
from textloom.sources.stored import StoredTable, buckets_for, import_into, latest
from textloom.streaming.events import _folder, run_to_end, stream_of

#: Idle seconds that end a user's session, and those over which errors are counted.
IDLE, RECENT = 1800, 600
_SESSION = "user_id long, started timestamp, ended timestamp, n long, errors long, peak long"
#: Events that may still be overtaken (microseconds * 2 + error), the open session, its errors
#: of late, the most of those at once, and the time up to which all is decided.
_STATE = "pending array<long>, started long, ended long, n long, errors long, recent array<long>, peak long, done long"


class Session:
    """The open session of one user."""

    def __init__(self, started: int = 0, ended: int = 0, n: int = 0, errors: int = 0, recent: list[int] = (), peak: int = 0):
        self.started, self.ended, self.n, self.errors, self.recent, self.peak = started, ended, n, errors, list(recent), peak

    def add(self, us: int, bad: bool) -> tuple | None:
        """Take one more event, in order of time; gives the session that it ended, if any."""
        closed = self.close(us)
        if not self.n:
            self.started = us
        self.ended, self.n, self.errors = us, self.n + 1, self.errors + bad
        if bad:
            self.recent.append(us)
        self.recent = self.recent[bisect_right(self.recent, us - RECENT * 1_000_000) :]
        self.peak = max(self.peak, len(self.recent))
        return closed

    def close(self, us: int) -> tuple | None:
        """End the session if it is idle at this time."""
        if not self.n or us - self.ended < IDLE * 1_000_000:
            return None
        out = (self.started, self.ended, self.n, self.errors, self.peak)
        self.__init__()
        return out


def user_states(events: DataFrame) -> DataFrame:
    """Sessions of each user as they end: start, end, events, errors, and the most errors within ten minutes.

    An event waits until the watermark has passed it, so events that come late, but within the
    watermark's delay, are taken in their order; what is later still is left out.  A user's
    state is a few numbers, the events of the delay and the errors of ten minutes, and goes
    when the session has ended: by a timer if nothing else comes.  Rows without a time are no
    events; a null user is a user.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, started, ended, n, errors, recent, peak, done = state.get if state.exists else ([], 0, 0, 0, 0, [], 0, 0)
        session, pending, out = Session(started, ended, n, errors, recent, peak), list(pending), []
        for part in parts:  # empty when a timer has run out
            pending += [int(us) * 2 + int(bad) for us, bad in zip(part["us"], part["bad"]) if us >= done]
        now = state.getCurrentWatermarkMs() * 1000
        pending.sort()
        ready = bisect_right(pending, 2 * now - 1)
        for code in pending[:ready]:
            out.append(session.add(code // 2, bool(code % 2)))
        out.append(session.close(now))
        pending = pending[ready:]
        if session.n or pending:
            state.update((pending, session.started, session.ended, session.n, session.errors, session.recent, session.peak, max(done, now)))
            # the next time at which something can be decided
            ends = [pending[0] // 2] if pending else []
            ends += [session.ended + IDLE * 1_000_000] if session.n else []
            state.setTimeoutTimestamp(max(min(ends) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        rows = [(key[0], pd.Timestamp(s, unit="us"), pd.Timestamp(e, unit="us"), n, bad, most) for s, e, n, bad, most in filter(None, out)]
        yield pd.DataFrame(rows, columns=["user_id", "started", "ended", "n", "errors", "peak"]).astype({"user_id": "Int64", "started": "datetime64[us]", "ended": "datetime64[us]"})

    slim = events.where("ts IS NOT NULL").select("ts", F.col("user_id").cast("long"), F.unix_micros("ts").alias("us"), (F.col("event_type") == "error").alias("bad"))
    slim = slim.withColumn("bad", F.coalesce("bad", F.lit(False)))
    return slim.groupBy("user_id").applyInPandasWithState(step, _SESSION, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


@query("stream_user_states", f"""
WITH t AS (SELECT user_id, event_id, epoch_us(ts) AS us, ts, event_type = 'error' AS bad FROM events),
g AS (SELECT *, coalesce(us - lag(us) OVER w >= {IDLE}000000, false)::INT AS fresh FROM t WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM g),
r AS (SELECT *, count(*) FILTER (bad) OVER (PARTITION BY user_id, session ORDER BY us RANGE BETWEEN {RECENT}000000 - 1 PRECEDING AND CURRENT ROW) AS recent FROM s)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n, count(*) FILTER (bad) AS errors, max(recent) AS peak FROM r GROUP BY user_id, session
HAVING max(us) + {IDLE}000000 <= (SELECT (max(epoch_us(ts)) // 1000 - 600000) * 1000 FROM events)""")
def stream_user_states(spark: SparkSession, d: str) -> DataFrame:
    """Ended sessions of every user, from a stream with a state for each."""
    done = run_to_end(user_states(stream_of(spark, _folder(spark, d))))
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


@query("restartable_import", """
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1""")
def restartable_import(spark: SparkSession, d: str) -> DataFrame:
    """The last event of every user: a stream of files, merged batch by batch into a stored table."""
    folder = scratch(spark, "event-files")
    table(spark, d, "events").repartitionByRange(4, "event_id").write.parquet(folder)
    stream = stream_of(spark, folder, 2).select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type")
    stored = StoredTable(spark, scratch(spark, "stored"), stream.schema, ["user_id"], buckets_for(table(spark, d, "events")))
    import_into(stream, stored, scratch(spark, "import-state"), latest(["user_id"], ["ts", "event_id"])).start().awaitTermination()
    return stored.read()


#: What is kept of an edge: mergeable, so that deltas can come in any order.
_EDGE = "supplier long, part long, mentions long, confidence double, kinds array<string>"


def merged_edges(rows: DataFrame) -> DataFrame:
    kinds = F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds"))))
    return rows.groupBy("supplier", "part").agg(F.sum("mentions").alias("mentions"), F.max("confidence").alias("confidence"), kinds.alias("kinds"))


def edge_rows(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part")).agg(F.count("*").alias("mentions"), F.max("l_discount").alias("confidence"), F.array_sort(F.collect_set("l_returnflag")).alias("kinds"))


@query("stored_graph_merge", """
WITH gone AS (SELECT p_partkey FROM part WHERE p_type = (SELECT min(p_type) FROM part))
SELECT l_suppkey AS supplier, l_partkey AS part, count(*) AS mentions, max(l_discount) AS confidence, array_to_string(list_sort(list(DISTINCT l_returnflag)), '|') AS kinds FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM gone) GROUP BY 1, 2""")
def stored_graph_merge(spark: SparkSession, d: str) -> DataFrame:
    """The edges of a stored graph after a delta for each kind of line, one of them sent twice, and the removal of one type's parts."""
    lines, parts = table(spark, d, "lineitem"), table(spark, d, "part")
    stored = StoredTable(spark, scratch(spark, "graph"), _EDGE, ["supplier", "part"], buckets_for(lines))
    for batch, flag in ((0, "A"), (1, "N"), (1, "N"), (2, "R")):
        stored.merge(edge_rows(lines.where(F.col("l_returnflag") == flag)), batch, merged_edges)
    kind = parts.join(F.broadcast(parts.agg(F.min("p_type").alias("p_type"))), "p_type").select(F.col("p_partkey").alias("part"))
    stored.remove(written(stored.read().join(kind, "part", "left_semi"), "gone"), 3)
    return stored.read().withColumn("kinds", F.array_join("kinds", "|"))
