"""Mergeable live states against exact counts, in any split and order."""

import random

import pytest
from conftest import EVENT_SCHEMA, event, random_events
from pyspark.sql import functions as F

from sessionlens.operators import live, sketches
from sessionlens.streaming import sinks


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def states_in_parts(events, parts, seed):
    part = F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(parts))
    return sketches.event_states(events.withColumn("part", part), ["session_id", "part"])


def test_any_split_gives_the_aggregates_of_one_pass(make_events):
    events = make_events(random_events(random.Random(1), rows=600))
    once = rows_of(sketches.state_aggregates(sketches.event_states(events)))
    for parts, seed in ((2, 1), (7, 2), (600, 3)):
        assert rows_of(sketches.state_aggregates(states_in_parts(events, parts, seed))) == once
    columns = [c for c in live.AGGREGATE_COLUMNS if c not in sketches.SKETCHES]
    exact = live.live_aggregate(events).select("session_id", *columns)
    merged = sketches.state_aggregates(sketches.event_states(events))
    assert rows_of(merged.select("session_id", *columns)) == rows_of(exact)


def test_many_urls_stay_within_four_standard_errors(spark, make_events):
    """Beyond the short lists: estimates of unions equal those of a single pass."""
    events = make_events([event(0, "pageview", 0)]).drop("url", "event_id").crossJoin(
        spark.range(60_000).selectExpr("concat('/p', id % 20000) AS url", "concat('e', id) AS event_id")
    )
    once = sketches.state_aggregates(sketches.event_states(events)).first()
    split = sketches.state_aggregates(states_in_parts(events, 9, 5)).first()
    assert once == split
    assert abs(once.unique_pages_visited - 20_000) <= 4 * 0.0163 * 20_000
    assert once.event_count == 60_000 and once.event_type_diversity == 1


def test_states_of_finer_keys_serve_coarser_ones(make_events):
    events = make_events(random_events(random.Random(2))).withColumn("day", F.to_date("timestamp"))
    states = sketches.event_states(events, ["session_id", "day"])
    total = sketches.state_aggregates(sketches.merge_states(states, ["day"]), ["day"])
    assert rows_of(total) == rows_of(sketches.state_aggregates(states, ["day"]))
    assert total.agg(F.sum("event_count")).first()[0] == events.count()


def test_sessions_without_urls_types_or_events(spark, make_events):
    events = make_events([event(0, "click", 0), event(1, None, 5, "s2"), event(2, "click", 9, None)])
    got = {r.session_id: r for r in sketches.sketch_features(sketches.event_states(events)).collect()}
    assert got["s1"].unique_pages_visited == 0 and got["s1"].page_revisit_ratio == 0.0
    assert got["s2"].event_type_diversity == 0 and got["s2"].event_count == 1
    assert got[None].event_count == 1
    empty = spark.createDataFrame([], EVENT_SCHEMA)
    assert sketches.sketch_features(sketches.event_states(empty)).count() == 0


@pytest.mark.parametrize("replayed", [False, True])
def test_log_of_states_takes_replays_and_late_batches(spark, make_events, tmp_path, replayed):
    rows = random_events(random.Random(3))
    events = make_events(rows)
    path, short = str(tmp_path / "states"), str(tmp_path / "short")
    write = sinks.state_sink(path, "r0")
    late_first = [rows[300:], rows[:100], rows[100:300], []]
    for batch_id, part in enumerate(late_first):
        write(make_events(part) if part else events.limit(0), batch_id)
        if replayed:
            write(make_events(part) if part else events.limit(0), batch_id)
    want = rows_of(sketches.sketch_features(sketches.event_states(events)))
    assert rows_of(sketches.sketch_features(sinks.read_states(spark, path))) == want
    sinks.compact_states(spark, path, short, "r1")
    compact = sinks.read_states(spark, short)
    assert compact.count() == len(want)
    assert rows_of(sketches.sketch_features(compact)) == want


def test_states_are_reduced_before_the_only_shuffle(make_events):
    events = make_events(random_events(random.Random(4)))
    plan = sketches.event_states(events)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_hll_sketch_agg" in plan.replace("partial_hllsketchagg", "partial_hll_sketch_agg")
