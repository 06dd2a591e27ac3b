import random

import pytest
from brute import by_session, close_buffers
from conftest import as_dicts, at, event, random_events
from pyspark.sql import functions as F

from sessionlens.operators import sessions
from sessionlens.functions.expressions import time_bucket
from sessionlens.operators import ordered
from sessionlens.operators.ordered import BLOCK, CHUNK, ordered_scan


def naive(moment):
    return moment.replace(tzinfo=None)


@pytest.mark.parametrize("chunk, block", [(0.5, 1), (0.5, 3), (60, 4), (60, 4096), (10**6, 4096)])
def test_ordered_scan_matches_sorting(make_events, monkeypatch, chunk, block):
    monkeypatch.setattr(ordered, "BLOCK_SLOTS", block)
    rows = random_events(random.Random(1))
    scanned = ordered_scan(
        make_events(rows), "session_id", chunk_seconds=chunk, carry={"kind": F.col("event_type")}
    )
    got = {r["event_id"]: r for r in scanned.collect()}
    assert len(got) == len(rows)
    for events in by_session(as_dicts(rows)).values():
        for i, e in enumerate(events):
            row = got[e["event_id"]]
            before = events[i - 1] if i else None
            assert row["row_number"] == i + 1
            assert row["key_rows"] == len(events)
            assert row["prev_timestamp"] == (naive(before["timestamp"]) if before else None)
            assert row["prev_kind"] == (before["event_type"] if before else None)


def test_rows_at_one_instant_are_ordered_by_id(make_events):
    rows = [event(i, "click", 0) for i in range(50)]
    got = sessions.session_order(make_events(rows)).orderBy("event_number").collect()
    assert [r["event_id"] for r in got] == [r[0] for r in rows]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("chunk, block", [(7, 2), (7, 50), (60, 4096), (10**6, 4096)])
def test_closure_matches_a_buffer(make_events, monkeypatch, seed, chunk, block):
    monkeypatch.setattr(ordered, "BLOCK_SLOTS", block)
    rows = random_events(random.Random(seed), rows=300)
    closed = sessions.close_sessions(
        make_events(rows), idle_seconds=40, max_events=5, chunk_seconds=chunk
    )
    got = sorted(
        (r["session_id"], r["event_count"], r["opened_at"], r["last_seen"], r["close_reason"])
        for r in closed.collect()
    )
    expected = [
        (s, n, naive(a), naive(b), reason)
        for s, n, a, b, reason in close_buffers(as_dicts(rows), 40, 5)
    ]
    assert got == sorted(expected)


def test_closure_at_the_default_cap(make_events):
    rows = [event(i, "click", i * 0.1) for i in range(1203)]
    closed = sessions.close_sessions(make_events(rows)).orderBy("opened_at").collect()
    assert [(r["event_count"], r["close_reason"]) for r in closed] == [
        (500, "cap"), (500, "cap"), (203, "flush"),
    ]


def test_idle_limit_is_strict(make_events):
    rows = [event(1, "click", 0), event(2, "click", 40), event(3, "click", 80.000001)]
    got = sessions.close_sessions(make_events(rows)).orderBy("opened_at").collect()
    assert [(r["event_count"], r["close_reason"]) for r in got] == [(2, "idle"), (1, "flush")]


def test_exit_is_a_page_view_matter(make_events):
    rows = [event(1, "click", 0, url="/exit"), event(2, "pageview", 1, url="/shop/exit"), event(3, "click", 2)]
    got = sessions.close_sessions(make_events(rows)).orderBy("opened_at").collect()
    assert [(r["event_count"], r["close_reason"]) for r in got] == [(2, "exit"), (1, "flush")]


def test_closure_as_of_a_given_time(make_events):
    rows = [event(1, "click", 0)]
    late = sessions.close_sessions(make_events(rows), as_of=F.lit(at(41)))
    assert late.first()["close_reason"] == "idle"


@pytest.mark.parametrize("gap", [0.7, 40, 500])
def test_gap_segments_match_sorting(make_events, gap):
    rows = random_events(random.Random(3))
    got = {
        r["event_id"]: r["segment"]
        for r in sessions.sessionize_gap(make_events(rows), "session_id", gap_seconds=gap).collect()
    }
    assert len(got) == len(rows)
    for events in by_session(as_dicts(rows)).values():
        segment = 0
        for before, e in zip([None, *events], events):
            if before and (e["timestamp"] - before["timestamp"]).total_seconds() > gap:
                segment += 1
            assert got[e["event_id"]] == segment


def test_gap_segments_hold_one_row_per_slot_not_per_event(spark):
    busy = spark.range(50000).select(
        F.lit("hot").alias("user"), F.timestamp_micros(F.col("id") * 1000).alias("timestamp")
    )
    assert sessions.gap_segments(busy, "user", gap_seconds=40).count() == 2


def test_gaps_and_first_last(make_events):
    rows = [event(2, "click", 5.25), event(1, "pageview", 0, url="/"), event(3, "payment", 5.25)]
    gaps = sessions.event_gaps(make_events(rows)).orderBy("event_id").collect()
    assert [r["gap_seconds"] for r in gaps] == [None, 5.25, 0.0]
    ends = sessions.session_first_last(make_events(rows)).first()
    assert (ends["first_event_type"], ends["last_event_id"]) == ("pageview", "e000003")


def test_missed_and_coverage(make_events):
    events = make_events([event(1, "click", 0, "a"), event(2, "click", 0, "b"), event(3, "click", 0, "b")])
    stored = events.where("session_id = 'a'")
    assert [r[0] for r in sessions.missed_sessions(events, stored).collect()] == ["b"]
    assert tuple(sessions.coverage_counts(events, stored).first()) == (2, 1, 1)


def test_running_total_of_new_sessions(make_events):
    rows = [event(1, "click", 0, "a"), event(2, "click", 90, "a"), event(3, "click", 100, "b")]
    got = sessions.sessions_seen_per_slot(make_events(rows), 60).orderBy("slot").collect()
    assert [(r["new_sessions"], r["seen_sessions"]) for r in got] == [(1, 1), (1, 2)]


def test_late_events(make_events):
    rows = [event(1, "click", 0), event(2, "click", 1000), event(3, "click", 10), event(4, "click", 995)]
    arrived = make_events(rows).withColumn("batch", F.col("arrival_seq"))
    late = sessions.late_events(arrived, "batch", 60)
    assert [r["event_id"] for r in late.collect()] == ["e000003"]
    for policy in ("keep", "drop", "side"):
        with pytest.raises(ValueError):
            sessions.late_events(arrived, "batch", 60, f"{policy}s")


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_late_policies_do_not_depend_on_blocks(make_events, block):
    rng = random.Random(9)
    moments = [rng.randrange(1000) for _ in range(60)]
    arrived = make_events([event(i, "click", t) for i, t in enumerate(moments)]).withColumn(
        "batch", F.floor(F.col("arrival_seq") / 4)
    )
    late = {
        f"e{i:06d}"
        for i, t in enumerate(moments)
        if i >= 4 and t < max(moments[: i // 4 * 4]) - 100
    }
    kept, dropped, aside = (
        sessions.late_events(arrived, "batch", 100, policy, block).collect()
        for policy in ("keep", "drop", "side")
    )
    assert {r["event_id"] for r in kept if r["late"]} == late and len(kept) == 60
    assert {r["event_id"] for r in aside} == late
    assert len(dropped) == 60 - len(late) and not {r["event_id"] for r in dropped} & late


def test_no_task_gets_more_than_a_slot_a_block_or_the_blocks_of_a_hot_key(make_events, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_SLOTS", 32)
    rng = random.Random(3)
    rows = [event(i, "click", rng.random() * 20_000, "hot" if i % 20 else f"s{i}") for i in range(4000)]
    slots = make_events(rows).groupBy("session_id", time_bucket(F.col("timestamp"), 10.0).alias(CHUNK)).count()
    blocks = ordered.blocked(slots).groupBy("session_id", BLOCK).count()
    assert slots.agg(F.max("count")).first()[0] <= 20  # rows of a slot, of the 3,800 of the key
    assert blocks.agg(F.max("count")).first()[0] <= 32  # slots of a block, of some 1,700
    assert blocks.groupBy("session_id").count().agg(F.max("count")).first()[0] <= 64  # blocks of the key
    scanned = ordered_scan(make_events(rows), "session_id", chunk_seconds=10.0)
    # Every window over rows or slots is parted by more than the key.
    plan = scanned._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    by_key = [line for line in windows if "_chunk" not in line and "_block" not in line]
    assert windows and all("sum(_n" in line for line in by_key)  # the total over a key's blocks
    numbers = {r["event_id"]: r["row_number"] for r in scanned.where("session_id = 'hot'").collect()}
    ordered_ids = sorted((e for e in as_dicts(rows) if e["session_id"] == "hot"), key=lambda e: (e["timestamp"], e["event_id"]))
    assert [numbers[e["event_id"]] for e in ordered_ids] == list(range(1, len(ordered_ids) + 1))
