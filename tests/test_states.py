"""State for each user in a stream, stored tables, and imports that break and go on."""

import glob
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textloom.sources import stored as S
from textloom.streaming import events as E
from textloom.streaming import states

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string"
DAY = datetime(2024, 1, 1)


def sessions_by_hand(rows, watermark):
    out = []
    for user in {u for _, _, u, _ in rows}:
        mine, session = sorted((t, k == "error") for _, t, u, k in rows if u == user and t is not None), []
        for t, bad in [*mine, (None, False)]:
            if session and (t is None or t - session[-1][0] >= timedelta(seconds=1800)):
                if session[-1][0] + timedelta(seconds=1800) <= watermark:
                    errors = [x for x, b in session if b]
                    peak = max(sum(x - timedelta(seconds=600) < y <= x for y in errors) for x, _ in session)
                    out.append((user, session[0][0], session[-1][0], len(session), len(errors), peak))
                session = []
            session.append((t, bad))
    return sorted(out, key=str)


def test_replay_in_batches_with_late_rows_equals_one_pass(spark, tmp_path):
    rnd = random.Random(4)
    rows, t = [], DAY
    for i in range(400):
        t += timedelta(seconds=rnd.choice([5, 60, 200, 400, 2500]))
        rows.append((i, t, rnd.choice([1, 2, None, 1 << 60]), rnd.choice(["error", "view", None])))
    end = (1000, t + timedelta(hours=3), 3, "view")  # moves the watermark past all of them
    # three batches, each shuffled, with rows of the batch before that are less than ten minutes late
    cut = [rows[:150], rows[150:300], rows[300:]]
    for a, b in zip(cut, cut[1:]):
        late = [r for r in a if a[-1][1] - r[1] < timedelta(minutes=9)][:-1]
        for r in late[::2]:
            a.remove(r)
            b.append(r)
    too_late = (2000, DAY, 1, "error")
    folder = str(tmp_path / "in")
    for k, part in enumerate([*cut, [end, too_late, (3000, None, 1, "error")]]):
        rnd.shuffle(part)
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(folder)
    got = E.run_to_end(states.user_states(E.stream_of(spark, folder, 1)))
    have = sorted(((r.user_id, r.started, r.ended, r.n, r.errors, r.peak) for r in got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")}).collect()), key=str)
    assert have == sessions_by_hand(rows, end[1]) and len(have) > 20


def test_a_users_state_stays_small():
    s, sizes = states.Session(), []
    for i in range(20_000):
        s.add(i * 1_000_000, True)
        sizes.append(len(s.recent))
    assert max(sizes) == 600 == s.peak and s.n == 20_000
    assert s.close(19_999 * 1_000_000 + 1_800_000_000) is not None and s.n == 0 and s.recent == []


def test_import_goes_on_after_a_failed_batch(spark, tmp_path):
    folder, path, state = (str(tmp_path / x) for x in ("in", "stored", "state"))
    batches = [[(1, DAY, 1, "a"), (2, DAY, 2, "a")], [(3, DAY + timedelta(1), 1, "b"), (4, None, 2, "lost")], [(5, DAY + timedelta(2), 3, "c"), (6, DAY, None, "d")]]
    for part in batches:
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: E.stream_of(spark, folder, 1).select("user_id", "event_id", "event_type")
    table = S.StoredTable(spark, path, "user_id long, event_id long, event_type string", ["user_id"], 4)
    calls = []

    def breaks(rows):
        calls.append(1)
        if len(calls) == 2:
            # files of the batch are there, its manifest is not
            rows.write.mode("overwrite").parquet(f"{path}/data/batch=1/bucket=0")
            raise RuntimeError("lost")
        return S.latest(["user_id"], ["event_id"])(rows)

    with pytest.raises(Exception, match="lost"):
        S.import_into(stream(), table, state, breaks).start().awaitTermination()
    assert table.batches() == [0] and table.read().count() == 2
    S.import_into(stream(), table, state, S.latest(["user_id"], ["event_id"])).start().awaitTermination()
    want = [(1, 3, "b"), (2, 4, "lost"), (3, 5, "c"), (None, 6, "d")]
    assert sorted(map(tuple, table.read().collect()), key=str) == sorted(want, key=str) and table.batches() == [0, 1, 2]
    S.import_into(stream(), table, state, breaks).start().awaitTermination()  # nothing is left
    assert not table.merge(table.read(), 2, breaks) and len(calls) == 2


def test_deltas_equal_the_whole_and_leave_other_buckets_alone(spark, tmp_path):
    rnd = random.Random(2)
    lines = [(rnd.choice([1, 2, 3, None]), rnd.randrange(30), rnd.random(), rnd.choice("AB")) for _ in range(500)]
    df = spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_discount double, l_returnflag string")
    table = S.StoredTable(spark, str(tmp_path / "t"), states._EDGE, ["supplier", "part"], 16)
    for k in range(5):
        part = spark.createDataFrame(lines[k::5], df.schema)
        assert table.merge(states.edge_rows(part), k, states.merged_edges)
    whole = {tuple(r)[:2]: (r.mentions, r.confidence, r.kinds) for r in states.edge_rows(df).collect()}
    assert {tuple(r)[:2]: (r.mentions, r.confidence, r.kinds) for r in table.read().collect()} == whole

    before = {b: glob.glob(f"{tmp_path}/t/data/batch={n}/bucket={b}/*.parquet") for b, n in table.current().items()}
    gone = spark.createDataFrame([(None, 7), (1, 999)], "supplier long, part long")
    touched = {r.bucket for r in table.bucketed(gone).collect()}
    assert table.remove(gone, 5) and (None, 7) in whole
    after = {b: glob.glob(f"{tmp_path}/t/data/batch={n}/bucket={b}/*.parquet") for b, n in table.current().items()}
    assert all((before[b] == after.get(b)) != (b in touched) for b in before)
    del whole[None, 7]
    assert {tuple(r)[:2]: (r.mentions, r.confidence, r.kinds) for r in table.read().collect()} == whole


def test_empty_deltas_and_emptied_buckets(spark, tmp_path):
    table = S.StoredTable(spark, str(tmp_path / "t"), "k long, v long", ["k"], 2)
    assert table.read().count() == 0
    keep = lambda rows: rows.distinct()
    assert table.merge(spark.createDataFrame([], "k long, v long"), 0, keep) and table.batches() == [0]
    assert table.merge(spark.createDataFrame([(1, 1)], "k long, v long"), 1, keep) and table.read().count() == 1
    assert table.remove(spark.createDataFrame([(1,)], "k long"), 2) and table.read().count() == 0
