import json
import os
import random
from pathlib import Path

import pytest
from brute import close_buffers, by_session
from conftest import as_dicts, at, event, random_events
from pyarrow import parquet
from pyspark.sql import functions as F

from sessionlens.operators.decode import decode_checked, publish_events
from sessionlens.operators.live import live_session_features
from sessionlens.operators.validate import quarantine_events
from sessionlens.plans import pipeline
from sessionlens.session import shared_dir
from sessionlens.sources import topic
from sessionlens.sources.offline import scan_offline
from sessionlens.streaming import closer, jobs, sinks


def to_line(e):
    keep = ("event_id", "event_type", "session_id", "user_id", "url", "product_id", "status")
    body = {k: e[k] for k in keep if e[k] is not None}
    body["timestamp"] = e["timestamp"].strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    body["properties"] = {"ip": e["ip"], "agent_type": e["agent_type"]}
    return json.dumps(body)


class Inbox:
    """A watched folder; a slice appears by rename, so no half file is ever seen."""

    def __init__(self, root):
        self.path, self.temp, self.n = root / "in", root / "part", 0
        self.path.mkdir()

    def put(self, lines):
        self.temp.write_text("\n".join(lines) + "\n")
        os.rename(self.temp, self.path / f"slice-{self.n:04d}.json")
        self.n += 1


@pytest.fixture
def inbox(tmp_path):
    return Inbox(tmp_path)


def slices(rows, n, rng=None):
    ordered = sorted(as_dicts(rows), key=lambda e: (e["timestamp"], e["event_id"]))
    size = -(-len(ordered) // n)
    parts = [ordered[i : i + size] for i in range(0, len(ordered), size)]
    if rng:
        for part in parts:
            rng.shuffle(part)
    return [[to_line(e) for e in part] for part in parts]


def run_live(spark, inbox, tmp_path, write):
    stream = jobs.stream_live_features(topic.read_json_lines(spark, str(inbox.path)))
    return jobs.drain(stream, str(tmp_path / "cp"), write, "update", timeout=120)


@pytest.mark.parametrize("shuffled", [False, True])
def test_live_stream_ends_at_the_batch_result(spark, make_events, inbox, tmp_path, shuffled):
    rows = random_events(random.Random(2), rows=150)
    path = str(tmp_path / "online")
    for part in slices(rows, 3, random.Random(1) if shuffled else None):
        inbox.put(part)
        run_live(spark, inbox, tmp_path, sinks.online_sink(path, "r"))
    expected = live_session_features(make_events(rows))
    columns = [c for c in expected.columns]
    got = sinks.read_online(spark, path).select(columns)
    assert sorted(got.collect(), key=str) == sorted(expected.collect(), key=str)


def test_late_row_still_updates_its_session(spark, inbox, tmp_path):
    path = str(tmp_path / "online")
    inbox.put([to_line(e) for e in as_dicts([event(1, "click", 0), event(2, "click", 6 * 3600, "s2")])])
    run_live(spark, inbox, tmp_path, sinks.online_sink(path, "r"))
    inbox.put([to_line(e) for e in as_dicts([event(3, "click", 1)])])
    run_live(spark, inbox, tmp_path, sinks.online_sink(path, "r"))
    got = {r["session_id"]: r["event_count"] for r in sinks.read_online(spark, path).collect()}
    assert got == {"s1": 2, "s2": 1}


def test_corrupt_lines_form_no_session_and_can_be_quarantined(spark, inbox, tmp_path):
    inbox.put(["not json", to_line(as_dicts([event(1, "click", 0)])[0]), '{"event_type": "click"}'])
    path = str(tmp_path / "online")
    run_live(spark, inbox, tmp_path, sinks.online_sink(path, "r"))
    assert [r["session_id"] for r in sinks.read_online(spark, path).collect()] == ["s1"]
    bad = quarantine_events(decode_checked(topic.read_json_lines(spark, str(inbox.path))))
    kept = str(tmp_path / "bad")
    jobs.drain_to_files(bad, str(tmp_path / "cp2"), kept, timeout=120)
    assert spark.read.parquet(kept).count() == 3  # the click lacks its element


def test_fan_out_writes_both_sinks_and_skips_empty_batches(spark, inbox, tmp_path):
    off, on, log = (str(tmp_path / n) for n in ("off", "on", "log"))
    inbox.put([to_line(e) for e in as_dicts([event(1, "click", 0), event(2, "click", 5, "s2")])])
    query = run_live(spark, inbox, tmp_path, sinks.fan_out(off, on, log, "r"))
    assert len(jobs.batch_metrics(query)) > 1  # the closing batch had no rows
    assert scan_offline(spark, off).count() == 2
    assert sinks.read_online(spark, on).count() == 2
    logged = spark.read.parquet(log).collect()
    assert [r["rows"] for r in logged] == [2] and logged[0]["seconds"] > 0


def test_offline_sink_keeps_every_snapshot(spark, inbox, tmp_path):
    path = str(tmp_path / "off")
    for i in range(2):
        inbox.put([to_line(e) for e in as_dicts([event(i, "click", i)])])
        run_live(spark, inbox, tmp_path, sinks.offline_sink(path, "r"))
    assert sorted(r["event_count"] for r in scan_offline(spark, path).collect()) == [1, 2]


def test_new_sessions_and_unique_events(spark, inbox, tmp_path):
    rows = as_dicts([event(1, "click", 0), event(1, "click", 0), event(2, "click", 1), event(3, "click", 2, "s2")])
    inbox.put([to_line(e) for e in rows])
    source = topic.read_json_lines(spark, str(inbox.path))
    first, unique = str(tmp_path / "first"), str(tmp_path / "unique")
    jobs.drain_to_files(jobs.stream_new_sessions(source), str(tmp_path / "c1"), first, timeout=120)
    jobs.drain_to_files(jobs.stream_unique_events(source), str(tmp_path / "c2"), unique, timeout=120)
    assert sorted(r["session_id"] for r in spark.read.parquet(first).collect()) == ["s1", "s2"]
    assert sorted(r["event_id"] for r in spark.read.parquet(unique).collect()) == ["e000001", "e000002", "e000003"]


def end_line():
    stamp = jobs.END_TIME.strftime("%Y-%m-%dT%H:%M:%S.000000Z")
    return json.dumps({"event_id": "end", "session_id": jobs.END_SESSION, "user_id": "-", "timestamp": stamp})


def test_idle_windows_of_a_stream(spark, inbox, tmp_path):
    rows = random_events(random.Random(8), rows=120, span=3000)
    out = str(tmp_path / "out")
    for part in [*slices(rows, 3), [end_line()]]:
        inbox.put(part)
        events = jobs.events_from(topic.read_json_lines(spark, str(inbox.path)))
        stream = jobs.stream_session_window(events, "session_id")
        jobs.drain_to_files(stream, str(tmp_path / "cp"), out, timeout=120)
    got = sorted((r["session_id"], r["event_count"]) for r in spark.read.parquet(out).collect())
    expected = []
    for session, events in by_session(as_dicts(rows)).items():
        counts = [0]
        for before, e in zip([None, *events], events):
            if before and (e["timestamp"] - before["timestamp"]).total_seconds() >= 40:
                counts.append(0)
            counts[-1] += 1
        expected += [(session, n) for n in counts]
    assert got == sorted(expected)


def close_slices(spark, inbox, tmp_path, closing, parts):
    for part in parts:
        inbox.put(part)
        events = jobs.events_from(topic.read_json_lines(spark, str(inbox.path)))
        jobs.drain(closer.stream_close_sessions(events), str(tmp_path / "cp"), closing.write, "append", 200)


def found(rows):
    return sorted((r["session_id"], r["event_count"], r["opened_at"], r["last_seen"], r["close_reason"]) for r in rows.collect())


def expected_buffers(rows, *limits):
    return sorted(
        (s, n, a.replace(tzinfo=None), b.replace(tzinfo=None), reason)
        for s, n, a, b, reason in close_buffers(as_dicts(rows), *limits)
    )


@pytest.mark.parametrize("order", ["sorted", "shuffled", "across"])
def test_stream_closure_matches_a_buffer(spark, inbox, tmp_path, order):
    rows = random_events(random.Random(11), rows=160, span=2500)
    parts, delay = slices(rows, 2, random.Random(1) if order == "shuffled" else None), 0
    if order == "across":
        # Neighbouring slices hold each other's rows; the delay allows for that.
        lines, delay = sum(slices(rows, 1), []), 1500
        parts = [[x for i, x in enumerate(lines) if i * 3 // len(lines) + (i % 7 == 0) == k] for k in range(4)]
    closing = closer.SessionCloser(str(tmp_path / "out"), 40, 5, delay, slot_seconds=30)
    close_slices(spark, inbox, tmp_path, closing, parts)
    closing.flush(spark)
    assert found(closing.closed(spark)) == expected_buffers(rows, 40, 5)
    assert closing.late(spark).count() == 0
    closing.flush(spark)  # a second flush finds nothing
    assert found(closing.closed(spark)) == expected_buffers(rows, 40, 5)


def test_late_rows_change_no_buffer_and_are_kept(spark, inbox, tmp_path):
    closing = closer.SessionCloser(str(tmp_path / "out"), 40, 500, delay_seconds=10)
    first = [event(1, "click", 0), event(2, "pageview", 5, url="/exit"), event(3, "click", 100, "s2")]
    # One row is older than the clock (90 s) and one is not, though older than the newest row.
    second = [event(4, "click", 3), event(5, "click", 95, "s2"), event(6, "click", 130, "s2")]
    close_slices(spark, inbox, tmp_path, closing, [[to_line(e) for e in as_dicts(part)] for part in (first, second)])
    closing.flush(spark)
    assert [(s, n, r) for s, n, _, _, r in found(closing.closed(spark))] == [("s1", 2, "exit"), ("s2", 3, "flush")]
    assert [(r["event_id"], r["batch_id"]) for r in closing.late(spark).collect()] == [("e000004", 1)]


def test_a_flushed_checkpoint_goes_on_with_later_events(spark, inbox, tmp_path):
    closing = closer.SessionCloser(str(tmp_path / "out"), 40, 500, delay_seconds=0)
    one = [event(1, "click", 0), event(2, "click", 10)]
    two = [event(3, "click", 20), event(4, "click", 30)]
    close_slices(spark, inbox, tmp_path, closing, [[to_line(e) for e in as_dicts(one)]])
    closing.flush(spark)
    assert [(n, r) for _, n, _, _, r in found(closing.closed(spark))] == [(2, "flush")]
    close_slices(spark, inbox, tmp_path, closing, [[to_line(e) for e in as_dicts(two)]])
    closing.flush(spark)
    assert [(n, r) for _, n, _, _, r in found(closing.closed(spark))] == [(2, "flush"), (2, "flush")]


def test_a_batch_that_failed_after_its_write_is_replayed_once(spark, inbox, tmp_path):
    rows = random_events(random.Random(4), rows=90, span=1500)
    closing = closer.SessionCloser(str(tmp_path / "out"), 40, 5, 0)
    failed = []

    def fail_once(batch, batch_id):
        closing.write(batch, batch_id)
        if batch_id not in failed:
            failed.append(batch_id)
            closing.flush(batch.sparkSession)  # even a flush between goes with the replay
            raise RuntimeError("lost after the write")

    for part in slices(rows, 3):
        inbox.put(part)
        stream = closer.stream_close_sessions(jobs.events_from(topic.read_json_lines(spark, str(inbox.path))))
        with pytest.raises(Exception, match="lost after the write"):
            jobs.drain(stream, str(tmp_path / "cp"), fail_once, "append", 200)
        jobs.drain(stream, str(tmp_path / "cp"), fail_once, "append", 200)
    closing.flush(spark)
    assert failed == [0, 1, 2]
    assert found(closing.closed(spark)) == expected_buffers(rows, 40, 5)


def test_topic_options():
    options = topic.topic_options("b:9092", starting="earliest", maxOffsetsPerTrigger="1000")
    assert options["subscribe"] == "shop-events" and options["startingOffsets"] == "earliest"
    assert options["maxOffsetsPerTrigger"] == "1000"
    with pytest.raises(ValueError):
        topic.topic_options("b:9092", starting="now")


def test_published_files_keep_time_order_and_spread_a_busy_user(spark, make_events, tmp_path):
    rows = [event(i, "click", (i * 7919) % 1000, f"s{i % 3}") for i in range(1000)]
    events = make_events(rows)
    messages = publish_events(events).withColumn("timestamp", F.get_json_object("value", "$.timestamp"))
    path = str(tmp_path / "out")
    topic.publish_to_files(messages, path, 4, ["timestamp"])
    spans = []
    for name in sorted(f for f in os.listdir(path) if f.endswith(".parquet")):
        stamps = [json.loads(r["value"])["timestamp"] for r in spark.read.parquet(f"{path}/{name}").collect()]
        assert stamps == sorted(stamps)
        spans.append((stamps[0], stamps[-1], len(stamps)))
    assert len(spans) == 4 and max(n for *_, n in spans) < 400
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def messages_of(spark, rows):
    lines = [(e["user_id"], to_line(e), e["timestamp"]) for e in as_dicts(rows)]
    made = spark.createDataFrame(lines, "key string, value string, timestamp timestamp")
    return made.withColumn("value", F.col("value").cast("binary"))


def test_waves_read_their_own_slice_and_keep_a_store_a_core(spark):
    rows = random_events(random.Random(5), rows=120)
    root = Path(shared_dir(spark))
    before = set(root.iterdir())
    cores, held = spark.sparkContext.defaultParallelism, spark.conf.get(jobs.SHUFFLE_PARTITIONS)
    spark.conf.set(jobs.SHUFFLE_PARTITIONS, cores + 5)
    try:
        pipeline.drain_in_waves(
            messages_of(spark, rows), jobs.stream_live_features,
            lambda batch, batch_id: batch.count(), "update", waves=3,
        )
        assert spark.conf.get(jobs.SHUFFLE_PARTITIONS) == str(cores + 5)
    finally:
        spark.conf.set(jobs.SHUFFLE_PARTITIONS, held)
    made = set(root.iterdir()) - before
    dealt = {f.name: f for d in made for f in d.glob("wave=*")}
    assert sorted(dealt) == ["wave=0", "wave=1", "wave=2"]
    assert sum(spark.read.parquet(str(f)).count() for f in dealt.values()) == 120
    stores = [s for d in made for s in d.glob("state/0/[0-9]*")]
    assert len(stores) == cores


def state_files(checkpoint):
    return {f.suffix for f in Path(checkpoint).glob("state/0/[0-9]*/*") if not f.name.startswith(".")}


def test_waves_that_lose_every_batch_keep_their_state_on_disk(spark, make_events, tmp_path):
    rows, path = random_events(random.Random(6), rows=120), str(tmp_path / "off")
    root = Path(shared_dir(spark))
    before = set(root.iterdir())
    assert spark.conf.get(jobs.STATE_PROVIDER, None) is None
    write = jobs.FailOnce(sinks.offline_sink(path, "r"))
    pipeline.drain_in_waves(
        messages_of(spark, rows), jobs.stream_live_features, write, "update", waves=3, may_fail=True
    )
    assert len(write.lost) >= 3
    assert spark.conf.get(jobs.STATE_PROVIDER, None) is None and spark.conf.get(jobs.UNLOAD, None) is None
    (checkpoint,) = [d for d in set(root.iterdir()) - before if d.name.startswith("checkpoint")]
    assert ".zip" in state_files(checkpoint) and ".delta" not in state_files(checkpoint)
    # A session's newest snapshot is its state over all waves.
    newest = {}
    for r in scan_offline(spark, path).collect():
        newest[r["session_id"]] = max(newest.get(r["session_id"], 0), r["event_count"])
    expected = live_session_features(make_events(rows)).collect()
    assert newest == {r["session_id"]: r["event_count"] for r in expected}


def test_a_checkpoint_begun_in_memory_goes_on_in_memory(spark, inbox, tmp_path):
    path = str(tmp_path / "online")
    for i, on_disk in enumerate((False, True)):
        inbox.put([to_line(e) for e in as_dicts([event(i, "click", i)])])
        stream = jobs.stream_live_features(topic.read_json_lines(spark, str(inbox.path)))
        jobs.drain(stream, str(tmp_path / "cp"), sinks.online_sink(path, "r"), "update", 120, on_disk=on_disk)
    assert [r["event_count"] for r in sinks.read_online(spark, path).collect()] == [2]
    assert ".zip" not in state_files(tmp_path / "cp")


def test_a_large_published_file_can_be_shared_out(spark, tmp_path):
    body = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{i}")), 512) for i in range(120)])
    made = spark.range(2000).select(
        F.lit("u").alias("key"), F.unhex(body).alias("value"), F.timestamp_seconds("id").alias("timestamp")
    )
    topic.publish_to_files(made, str(tmp_path / "in"), 1, ["timestamp"])
    (file,) = (tmp_path / "in").glob("*.parquet")
    assert parquet.ParquetFile(file).metadata.num_rows == 2000
    assert parquet.ParquetFile(file).metadata.num_row_groups > 1
