import random
from datetime import timedelta

import pytest
from conftest import at
from pyspark.sql import functions as F

from sessionlens.operators import quality, rules, store
from sessionlens.schema import FEATURE_COLUMNS, SESSION_FEATURES
from sessionlens.sources.offline import append_batch, compact_history, scan_offline, vacuum_history
from sessionlens.streaming import sinks

ROW = "session_id string, event_timestamp timestamp, v long"


def naive(moment):
    return moment.replace(tzinfo=None) if moment else None


def feature_row(spark, **changes):
    values = {
        "session_id": "s", "event_timestamp": at(0), "events_per_minute": 1.0,
        "unique_pages_visited": 2.0, "avg_time_between_events": 3.0,
        "cart_to_purchase_ratio": 0.5, "session_duration_seconds": 60.0,
        "event_type_diversity": 3, "has_payment": 0, "signup_to_purchase_speed": 0.0,
        "page_revisit_ratio": 0.1, **changes,
    }
    types = {c: t.simpleString() for c, t in SESSION_FEATURES.fields.items()}
    schema = ", ".join(f"{c} {types.get(c, 'string')}" for c in values)
    schema = schema.replace("event_timestamp string", "event_timestamp timestamp")
    return spark.createDataFrame([tuple(values.values())], schema)


def test_runs_go_by_number_not_by_name(spark, tmp_path):
    path = str(tmp_path / "online")
    for run, value in (("r10", 3), ("r9", 2), ("r", 1)):
        sinks.online_sink(path, run)(spark.createDataFrame([("a", at(0), value)], ROW), 0)
    kept = sinks.read_online(spark, path)
    assert kept.columns == spark.createDataFrame([], ROW).columns
    assert [tuple(r)[2] for r in kept.collect()] == [3]


def test_contract_casts_and_rejects(spark):
    row = feature_row(spark).withColumn("has_payment", F.lit(1).cast("int")).withColumn("junk", F.lit(1))
    kept = store.enforce_contract(row)
    assert kept.columns == ["session_id", "event_timestamp", *FEATURE_COLUMNS]
    assert dict(kept.dtypes)["has_payment"] == "bigint"
    with pytest.raises(ValueError, match="page_revisit_ratio"):
        store.enforce_contract(row.drop("page_revisit_ratio"))


def test_latest_row_wins_and_ties_are_stable(spark):
    rows = [("a", at(0), 1), ("a", at(5), 2), ("b", at(1), 3), ("a", at(5), 4)]
    df = spark.createDataFrame(rows, ROW)
    first = {r["session_id"]: r["v"] for r in store.latest_per_session(df).collect()}
    again = {r["session_id"]: r["v"] for r in store.latest_per_session(df.repartition(7)).collect()}
    assert first == again and first["b"] == 3 and first["a"] in (2, 4)


def test_expired_rows_serve_nulls(spark):
    df = spark.createDataFrame([("a", at(0), 1), ("b", at(100), 2)], ROW)
    got = store.online_lookup_ttl(df, F.lit(at(3601)), timedelta(hours=1)).collect()
    assert {r["session_id"]: (r["fresh"], r["v"]) for r in got} == {"a": (False, None), "b": (True, 2)}


@pytest.mark.parametrize("slot", [3.0, 60.0, 10**6])
def test_point_in_time_read_matches_brute_force(spark, slot):
    rng = random.Random(5)
    history = [(rng.choice("aab"), at(t), t) for t in rng.sample(range(500), 120)]
    asks = [(i, rng.choice("aabc"), at(rng.randrange(-10, 600))) for i in range(150)]
    got = store.asof_feature_join(
        spark.createDataFrame(asks, "request_id long, session_id string, asked_at timestamp"),
        spark.createDataFrame(history, ROW),
        ["v"],
        slot_seconds=slot,
        ttl=timedelta(seconds=90),
    ).collect()
    assert len(got) == len(asks)
    found = {r["request_id"]: (r["event_timestamp"], r["v"]) for r in got}
    for i, key, moment in asks:
        seen = [(t, v) for k, t, v in history if k == key and t <= moment]
        best = max(seen) if seen else (None, None)
        if seen and (moment - best[0]).total_seconds() > 90:
            best = (None, None)
        assert found[i] == (naive(best[0]), best[1])


def test_replayed_batch_does_not_duplicate(spark, tmp_path):
    df = spark.createDataFrame([("a", at(0), 1), ("b", at(86400), 2)], ROW)
    for _ in range(2):
        append_batch(df, str(tmp_path / "h"), "r", 0)
    append_batch(df, str(tmp_path / "h"), "r", 1)
    history = scan_offline(spark, str(tmp_path / "h"))
    assert history.count() == 4
    assert history.select("event_date").distinct().count() == 2


def test_online_log_read_lookup_and_compaction(spark, tmp_path):
    path, compact = str(tmp_path / "log"), str(tmp_path / "compact")
    write = sinks.online_sink(path, "r")
    write(spark.createDataFrame([("a", at(0), 1), ("b", at(0), 1)], ROW), 0)
    write(spark.createDataFrame([("a", at(10), 2), ("a", at(10), 2), ("c", at(-7200), 5)], ROW), 1)
    write(spark.createDataFrame([("a", at(10), 3)], ROW), 2)

    def values(df):
        return {r["session_id"]: r["v"] for r in df.collect()}

    assert values(sinks.read_online(spark, path)) == {"a": 3, "b": 1, "c": 5}
    assert values(sinks.lookup_online(spark, path, F.lit(at(20)))) == {"a": 3, "b": 1}
    sinks.compact_online(spark, path, compact, "c")
    assert values(sinks.read_online(spark, compact)) == {"a": 3, "b": 1, "c": 5}


def test_a_later_run_wins_over_a_larger_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.online_sink(path, "r0")(spark.createDataFrame([("a", at(0), 1)], ROW), 5)
    sinks.online_sink(path, "r1")(spark.createDataFrame([("a", at(0), 2)], ROW), 0)
    sinks.online_sink(path, "r1")(spark.createDataFrame([], ROW), 1)
    assert [r["v"] for r in sinks.read_online(spark, path).collect()] == [2]
    assert [r["v"] for r in sinks.lookup_online(spark, path, F.lit(at(1))).collect()] == [2]


def test_lookup_prunes_old_dates(spark, tmp_path):
    path = str(tmp_path / "log")
    append_batch(spark.createDataFrame([("a", at(0), 1), ("b", at(-9 * 86400), 2)], ROW), path, "r", 0)
    looked = sinks.lookup_online(spark, path, F.lit(at(20)))
    plan = looked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_quality_rules_count_every_break(spark):
    bad = feature_row(spark, session_id=None, events_per_minute=60000.0, page_revisit_ratio=-0.5, event_type_diversity=9)
    empty = feature_row(spark, cart_to_purchase_ratio=None, events_per_minute=None)
    edge = feature_row(spark, cart_to_purchase_ratio=1.001, events_per_minute=10000.0)
    got = {r["rule"]: r for r in quality.scorecard(bad.unionByName(empty).unionByName(edge)).collect()}
    assert len(got) == 11
    failed = {n for n, r in got.items() if not r["passed"]}
    assert failed == {
        "overall", "session_id not null", "events_per_minute between",
        "page_revisit_ratio between", "event_type_diversity between",
    }
    assert got["events_per_minute between"]["rows_checked"] == 2
    assert got["overall"]["unexpected"] == 4


def test_quality_of_nothing_passes(spark):
    got = quality.scorecard(feature_row(spark).limit(0)).collect()
    assert all(r["passed"] for r in got) and {r["rows_checked"] for r in got} == {0}


def test_rule_bands(spark):
    calm = rules.rule_flags(feature_row(spark)).first()
    assert calm["flags"] == 0
    wild = rules.rule_flags(
        feature_row(
            spark, events_per_minute=201.0, unique_pages_visited=101.0, avg_time_between_events=0.5,
            cart_to_purchase_ratio=1.0, session_duration_seconds=15.0, event_type_diversity=1,
            has_payment=1, signup_to_purchase_speed=5.0,
        )
    ).first()
    assert wild["flags"] == 9
    nulls = rules.rule_flags(feature_row(spark, cart_to_purchase_ratio=None)).first()
    assert nulls["full_cart"] == 0


def test_requests_without_key_or_time_are_misses(spark):
    history = spark.createDataFrame([("a", at(0), 1), (None, at(0), 2), ("a", None, 3)], ROW)
    asks = [(1, "a", at(5)), (2, None, at(5)), (3, "a", None)]
    got = store.asof_feature_join(
        spark.createDataFrame(asks, "request_id long, session_id string, asked_at timestamp"),
        history,
        ["v"],
        slot_seconds=60.0,
    ).collect()
    assert {r["request_id"]: r["v"] for r in got} == {1: 1, 2: None, 3: None}


def test_a_batch_leaves_one_file_for_each_small_date(spark, tmp_path):
    rows = [(f"s{i}", at(86400 * (i % 3)), i) for i in range(300)]
    append_batch(spark.createDataFrame(rows, ROW).repartition(8), str(tmp_path / "h"), "r", 0)
    assert len(list((tmp_path / "h").rglob("*.parquet"))) == 3
    assert scan_offline(spark, str(tmp_path / "h")).count() == 300


def parts(path):
    return sorted({p.name for p in path.glob("*/*/part=*")})


def history_rows(spark, path, **which):
    return sorted((r["run"], r["batch_id"], r["session_id"], r["v"]) for r in scan_offline(spark, str(path), **which).collect())


def test_one_date_or_key_lists_its_own_folders(spark, tmp_path):
    path = tmp_path / "h"
    for batch in range(3):
        rows = [(f"s{i}", at(86400 * (i % 3)), i) for i in range(60)]
        append_batch(spark.createDataFrame(rows, ROW), str(path), "r", batch)
    day = at(86400).date()
    one = scan_offline(spark, str(path), dates=[day])
    assert one.count() == 60 and one.inputFiles() and all(f"event_date={day}/" in f for f in one.inputFiles())
    assert [r["v"] for r in scan_offline(spark, str(path), keys=["s7"]).collect()] == [7, 7, 7]
    compact_history(spark, str(path), [at(86400 * d).date() for d in range(3)], ended=["r"])
    vacuum_history(spark, str(path), [at(86400 * d).date() for d in range(3)])
    mine = scan_offline(spark, str(path), keys=["s7"])
    assert [r["v"] for r in mine.collect()] == [7, 7, 7]
    assert len({f.split("key_bucket=")[1].split("/")[0] for f in mine.inputFiles() if "/h/" in f}) == 1
    assert scan_offline(spark, str(path), dates=[day], keys=["s7", "s4", "s0"]).count() == 6
    assert scan_offline(spark, str(path), dates=[at(-86400).date()]).count() == 0
    assert scan_offline(spark, str(path), dates=[]).count() == 0
    assert scan_offline(spark, str(path), keys=["absent"]).count() == 0


def test_compaction_keeps_every_row_once(spark, tmp_path):
    path = tmp_path / "h"

    def batch(run, number):
        rows = [(f"s{i}", at(86400 * (i % 2)), 100 * number + i) for i in range(20)] + [(None, at(0), -1), ("x", None, -2)]
        append_batch(spark.createDataFrame(rows, ROW), str(path), run, number)

    for number in range(4):
        batch("r9", number)
    batch("r10", 0)
    key = lambda row: tuple((v is None, v) for v in row)
    read = lambda: sorted(
        ((r["run"], r["batch_id"], r["session_id"], r["v"]) for r in scan_offline(spark, str(path)).collect()), key=key
    )
    before, dates = read(), [at(0).date(), at(86400).date()]
    compact_history(spark, str(path), dates)
    assert read() == before  # merged and old parts lie side by side
    batch("r9", 1)  # a merged batch is replayed
    assert read() == before
    assert vacuum_history(spark, str(path), dates) > 0
    assert read() == before
    dated = [p for p in parts(path) if "_" not in p]
    assert "part=m-1" in dated and not [p for p in path.glob(f"event_date={dates[0]}/*/part=b-r9-0")]
    batch("r9", 4)  # the job goes on
    after = read()
    assert len(after) == len(before) + 22
    compact_history(spark, str(path), dates, ended=["r9", "r10"])
    vacuum_history(spark, str(path), dates)
    assert read() == after
    for day in dates:
        assert {p.name for p in path.glob(f"event_date={day}/*/part=*")} == {"part=m-2"}
    assert len(scan_offline(spark, str(path), dates=dates[:1]).collect()) == sum(r[2] is None or (r[3] >= 0 and r[3] % 2 == 0) for r in after)


def test_a_compaction_cut_short_changes_nothing(spark, tmp_path, monkeypatch):
    from sessionlens.sources import offline

    path, dates = tmp_path / "h", [at(0).date()]
    for number in range(3):
        append_batch(spark.createDataFrame([("a", at(number), number), ("b", at(0), number)], ROW), str(path), "r", number)
    before, read = history_rows(spark, path), offline._read

    def lost(spark, where, folders):
        if (tmp_path / "h").glob("*/*/part=m-1") and list(path.glob("*/*/part=m-1")):
            raise RuntimeError("lost before the manifest")
        return read(spark, where, folders)

    monkeypatch.setattr(offline, "_read", lost)
    with pytest.raises(RuntimeError):
        compact_history(spark, str(path), dates, ended=["r"])
    monkeypatch.setattr(offline, "_read", read)
    assert "part=m-1" in parts(path) and history_rows(spark, path) == before
    compact_history(spark, str(path), dates, ended=["r"])
    vacuum_history(spark, str(path), dates)
    assert parts(path) == ["part=m-1"] and history_rows(spark, path) == before
