"""Streams with list and map state, over files in any order, against loops."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from quillmill.plans.roundtrips import KEYED, far, streamed
from quillmill.streaming import keyed, reviewlog

DAY = 86_400_000_000


def rows_of(seed, n=160):
    """(key, event, ts in seconds): ties in time, a hot key and a null one, out of order."""
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "a", None]), i, 1_700_000_000 + rng.randrange(0, 400) * 30) for i in range(n)]


def table(spark, rows, key):
    df = spark.createDataFrame(rows, f"{key} string, event long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    return df.repartition(5)


def by_key(rows):
    out = {}
    for key, event, s in sorted(rows, key=lambda r: (r[2], r[1])):
        out.setdefault(key, []).append((event, s * 1_000_000))
    return out


def test_rings_hold_the_last_rows(spark):
    rows = rows_of(1)
    df = table(spark, rows, "context")
    got = {(r.context, r.event): (r.held, r.evicted) for r in streamed(df, "ring", lambda s: keyed.ring_stream(s, 7, delay="800 days"), far(df), **KEYED).collect()}
    expected = {}
    for key, own in by_key(rows).items():
        ring = deque(maxlen=7)
        for event, _ in own:
            old = ring[0] if len(ring) == 7 else None
            ring.append(event)
            expected[key, event] = (len(ring), old)
    assert got == expected


def test_sessions_end_by_timer(spark):
    rows = rows_of(2)
    df = table(spark, rows, "client")
    out = streamed(df, "sessions", lambda s: keyed.session_stream(s, 1800, delay="800 days"), far(df), **KEYED).collect()
    expected, ended = {}, set()
    for key, own in by_key(rows).items():
        created = None
        for event, at in own:
            new = created is None or at - created > 1800 * 1_000_000
            created = at if new else created
            expected[key, event] = (created, "opened" if new else "live")
            ended.add((key, created))
    assert {(r.client, r.event): (r.created, r.state) for r in out if r.event is not None} == expected
    # each session ends once, by the next request or by the timer of an idle client
    closed = [(r.client, r.created) for r in out if r.event is None]
    assert len(closed) == len(set(closed)) and set(closed) == ended and {r.state for r in out if r.event is None} == {"expired"}


def test_rejected_requests_stay_out_of_the_stream(spark):
    rows = rows_of(3)
    df = table(spark, rows, "client").withColumn("bucket", F.lit("b"))
    out = streamed(df, "limits", lambda s: keyed.admitted_stream(s, {"b": 3}, 9, 900, delay="800 days"), far(df), **KEYED)
    expected = {}
    for own in by_key(rows).values():
        times = []
        for event, at in own:
            times = [t for t in times if t > at - 900_000_000]
            expected[event] = len(times) < 3
            times += [at] * expected[event]
    assert {r.event: r.admitted for r in out.collect()} == expected and not all(expected.values())


def test_rows_within_the_delay_wait_their_turn(spark):
    """Two runs from one checkpoint: what came before the watermark passed is put in order with what came later."""
    early = [("k", 2, 1_700_000_600), ("k", 3, 1_700_000_700)]
    late = [("k", 1, 1_700_000_500), ("other", 9, 1_700_900_000)]
    out = streamed(table(spark, early, "context"), "late", lambda s: keyed.ring_stream(s, 2, delay="1 hour"), table(spark, late, "context"), **KEYED)
    assert sorted((r.event, r.held, r.evicted) for r in out.filter("context = 'k'").collect()) == [(1, 1, None), (2, 2, None), (3, 2, 1)]


@pytest.mark.parametrize("seed", [4, 5])
def test_reviews_keep_a_stack_of_entries(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), rng.choice("qr"), e, rng.choice(["review", "review", "rollback"]), rng.choice(["approve", "reject"]), rng.choice([None, None, -1, e - 1]), 1_700_000_000 + e) for e in range(1, 150)]
    df = spark.createDataFrame(rows, f"{reviewlog.ACTIONS}, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s").repartition(4)
    stream = streamed(df, "reviews", lambda s: keyed.replay_stream(s, delay="800 days"), far(df), **KEYED)
    found, expected = ({r.event: (r.outcome, r.active) for r in x.collect()} for x in (stream, reviewlog.replay(df)))
    assert found == expected and {"accepted", "conflict", "replay", "rolled_back"} == {o for o, _ in found.values()}
