"""Shuffles and scans of the core operators over a stored event table."""

import random

import pytest
from conftest import random_events
from pyspark.sql import functions as F

from sessionlens.operators import features, sessions
from sessionlens.session import fresh_dir, shared_dir


@pytest.fixture(scope="module")
def table(spark, make_events, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("table") / "events")
    make_events(random_events(random.Random(0))).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_without_pages_takes_one_hash_shuffle(table):
    text = plan(features.session_features(table, ["events_per_minute", "event_type_diversity"]))
    assert text.count("Exchange hash") == 1 and "SortAggregate" not in text
    read = text[text.index("ReadSchema"):]
    assert "url" not in read and "user_id" not in read


def test_all_features_take_two_shuffles_and_one_scan(table):
    text = plan(features.session_features(table))
    assert text.count("Exchange hash") == 2 and text.count("FileScan") == 1
    assert "Expand" not in text and "SortAggregate" not in text


def test_ordered_scan_shuffles_the_events_once(table, no_broadcast):
    text = plan(sessions.event_gaps(table, 60.0))
    assert "SortMergeJoin" in text
    # Whole events are read, exchanged and sorted once; the rest moves rows of the summary.
    events = [line for line in text.splitlines() if "Window [row_number" in line and "event_id" in line]
    assert len(events) == 1
    assert sum("event_id" in line for line in text.splitlines() if "FileScan" in line) == 1
    assert "partial_max(timestamp" in text


def test_filter_reaches_the_scan(table):
    text = plan(table.where(F.col("event_type") == "pageview").select("user_id", "url"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,pageview)]" in text


def test_shared_folder_is_the_configured_one(spark):
    assert fresh_dir(spark, "x").startswith(shared_dir(spark))
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
