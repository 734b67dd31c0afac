"""Session streams over several micro-batches: one file each, in order."""

from __future__ import annotations

import datetime as dt
import itertools
import os

import pytest

from quillmill.streaming import sessions

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "user_id long, event_id long, ts timestamp, kind string"


@pytest.fixture
def feed(spark, tmp_path):
    """Batches of (user, event, hour, kind), a file each, read one by one."""
    def make(batches, name="in"):
        for k, rows in enumerate(batches):
            path = tmp_path / name / f"f{k}"
            spark.createDataFrame([(u, e, START + dt.timedelta(hours=h), x) for u, e, h, x in rows], SCHEMA).coalesce(1).write.parquet(str(path))
            for f in path.glob("*.parquet"):
                os.utime(f, (1_700_000_000 + k * 100,) * 2)
        return sessions.read_stream(spark, str(tmp_path / name / "f"), SCHEMA, 1)

    return make


def run(spark, stream, tmp_path, name="out"):
    return sessions.run_available(stream, spark, f"file://{tmp_path}/{name}")


def to_end(spark, stream, build, tmp_path, name="out"):
    return sessions.run_to_end(stream, build, spark, f"file://{tmp_path}/{name}")


def test_an_expired_session_stays_expired(spark, feed, tmp_path):
    s = feed([[(1, 1, 0, "a")], [(2, 2, 72, "a")], [(2, 3, 73, "a")], [(1, 4, 80, "a")], [(3, 5, 200, "a")], [(1, 6, 190, "a")]])
    got = {(r.user_id, r.event_id): r.outcome for r in to_end(spark, s, sessions.expire, tmp_path).collect()}
    assert got[1, 1] == "live" and got[2, 2] == got[2, 3] == "live" and got[3, 5] == "live"
    assert got[1, 4] == got[1, 6] == "expired" and got[1, None] == "session_expired"


def test_tombstones_end_too(spark, feed, tmp_path):
    hours = [0, 80, 90, 400, 410, 420]
    s = feed([[(2 if 0 < k < 5 else 1, k, h, "a")] for k, h in enumerate(hours)])
    got = {r.event_id: r.outcome for r in to_end(spark, s, lambda e: sessions.expire(e, retain=48), tmp_path).filter("user_id = 1").collect()}
    assert got == {0: "live", None: "session_expired", 5: "live"}


def test_a_key_lives_from_its_first_use(spark, feed, tmp_path):
    s = feed([[(1, 1, 0, "a"), (1, 2, 5, "a")], [(1, 3, 23, "b"), (2, 4, 23, "a")], [(1, 5, 25, "b")], [(2, 6, 90, "a")], [(1, 7, 95, "c"), (1, 8, 96, "c")]])
    got = {r.event_id: r.outcome for r in to_end(spark, s, lambda e: sessions.replay(e, "user_id", "kind"), tmp_path).collect()}
    assert got == {1: "first", 2: "replay", 3: "conflict", 4: "first", 5: "first", 6: "first", 7: "first", 8: "replay"}


HOURS = (0, 5, 11, 20)
DEALS = [[[order[0]], [order[1]], [order[2], order[3]]] for order in itertools.permutations(range(4))] + [[[0, 1, 2, 3], [], []], [[], [3, 1], [2, 0]]]


def test_outcomes_do_not_depend_on_the_deal(spark, feed, tmp_path):
    """Every order of four events of a session over micro-batches, one user a deal; the last batch moves the watermark on."""
    kinds = "abab"
    batches = [[(100 + k, e, HOURS[e], kinds[e]) for k, deal in enumerate(DEALS) for e in deal[b]] for b in range(3)] + [[(1, 9, 60, "a")]]
    s = feed(batches)
    told = to_end(spark, s, lambda e: sessions.expire(e, hours=10, retain=1), tmp_path, "expire").collect()
    keys = to_end(spark, s, lambda e: sessions.replay(e, "user_id", "kind", hours=10), tmp_path, "replay").collect()
    for k in range(len(DEALS)):
        own = sorted((r.ts.replace(tzinfo=dt.timezone.utc), -1 if r.event_id is None else r.event_id, r.outcome) for r in told if r.user_id == 100 + k)
        # the session ends at 10 and is forgotten at 11, where the next one begins and ends at 21
        hour = lambda h: START + dt.timedelta(hours=h)
        assert own == [(hour(0), 0, "live"), (hour(5), 1, "live"), (hour(10), -1, "session_expired"), (hour(11), 2, "live"), (hour(20), 3, "live"), (hour(21), -1, "session_expired")]
        assert {r.event_id: r.outcome for r in keys if r.user_id == 100 + k} == {0: "first", 1: "conflict", 2: "first", 3: "conflict"}


def test_an_event_out_of_order_counts_from_the_earliest(spark, feed, tmp_path):
    rows = [(1, 1, 10, "a"), (1, 2, 0, "a"), (1, 3, 30, "a")]
    for name, batches in (("one", [rows]), ("three", [[r] for r in rows])):
        got = to_end(spark, feed(batches, name), sessions.expire, tmp_path, f"out-{name}").filter("event_id is not null").collect()
        assert {r.event_id: r.outcome for r in got} == {1: "live", 2: "live", 3: "expired"}


def test_content_tags(spark, tmp_path):
    rows = [(1, 0, -1, "t0", ""), (1, 1, 0, "t1", "t0"), (1, 2, 1, "t2", "t0"), (1, 3, 1, "t3", None), (2, 0, -1, "u0", '"0"'), (2, 1, 0, "u1", '"0"'), (3, 0, -1, "x", "y")]
    df = spark.createDataFrame(rows, "k long, v long, p long, tag string, seen string")
    df.coalesce(1).write.parquet(f"{tmp_path}/v")
    s = sessions.read_stream(spark, f"{tmp_path}/v", df.schema)
    got = run(spark, sessions.versions(s, "k", "v", "p", tag="tag", match="seen"), tmp_path)
    assert {(r.k, r.v): r.outcome for r in got.collect()} == {(1, 0): "accepted", (1, 1): "accepted", (1, 2): "tag_conflict", (1, 3): "accepted", (2, 0): "accepted", (2, 1): "tag_conflict", (3, 0): "tag_conflict"}


def test_versions_over_batches(spark, feed, tmp_path):
    s = feed([[(1, 0, 0, "-1")], [(1, 1, 1, "0"), (2, 0, 1, "3")], [(1, 2, 2, "0")], [(1, 3, 3, "1")]])
    got = {(r.user_id, r.event_id): r.outcome for r in run(spark, sessions.versions(s, "user_id", "event_id", "kind"), tmp_path).collect()}
    assert got == {(1, 0): "accepted", (1, 1): "accepted", (2, 0): "conflict", (1, 2): "conflict", (1, 3): "accepted"}


def test_live_deletion(spark, feed, tmp_path):
    batches = [[(1, 1, 0, "a"), (2, 2, 0, "a")], [(1, 3, 5, "delete")], [(1, 4, 6, "a"), (1, 5, 4, "a")], [(2, 6, 100, "a")], [(1, 7, 101, "a")]]
    s = feed([[r for r in b if r[3] != "delete"] for b in batches])
    d = feed([[r for r in b if r[3] == "delete"] for b in batches], "gone")
    told = run(spark, sessions.deletions_live(s, d, "user_id"), tmp_path)
    rows = {(r.user_id, r.event_id): r for r in sessions.purge(told, "user_id").collect()}
    assert {k: r.outcome for k, r in rows.items()} == {(2, 2): "kept", (2, 6): "kept", (1, None): "tombstone", (1, 4): "rejected", (1, 7): "rejected"}
    assert len(rows[1, None].hash) == 64 and rows[2, 2].hash is None
