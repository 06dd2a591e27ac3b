import random

import pytest
from brute import by_session, features
from conftest import as_dicts, at, event, random_events
from pyspark.sql import functions as F

from sessionlens.operators.features import buffer_features, feature_drift, feature_rows, session_features
from sessionlens.operators.live import live_session_features
from sessionlens.schema import FEATURE_COLUMNS


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


GOLDEN = {
    "g1": (
        [event(1, "pageview", 0, url="/"), event(2, "pageview", 30, url="/")],
        {"events_per_minute": 4.0},
    ),
    "g2": (
        [event(i, "pageview", 0, url=u) for i, u in enumerate(["/home", "/home", "/cart"])],
        {"unique_pages_visited": 2.0, "page_revisit_ratio": pytest.approx(0.333, abs=1e-3)},
    ),
    "g3": (
        [event(1, "add_to_cart", 0, product_id="p1"), event(2, "payment", 0, status="success")],
        {"cart_to_purchase_ratio": 1.0},
    ),
    "g4": (
        [event(i, "pageview", 10 * i, url="/") for i in range(3)],
        {"session_duration_seconds": 20.0, "avg_time_between_events": 10.0},
    ),
    "g5": (
        [event(1, "pageview", 0, url="/"), event(2, "payment", 0, status="success")],
        {"event_type_diversity": 2, "has_payment": 1},
    ),
    "g6": (
        [event(1, "user_signup", 0), event(2, "payment", 5, status="success")],
        {"signup_to_purchase_speed": 5.0},
    ),
    "single event": (
        [event(1, "pageview", 0, url="/")],
        {"events_per_minute": 0.0, "session_duration_seconds": 0.0, "avg_time_between_events": 0.0},
    ),
    "one instant": (
        [event(i, "click", 0) for i in range(5)],
        {"events_per_minute": 5.0, "session_duration_seconds": 0.0},
    ),
    "cart without payment": ([event(1, "add_to_cart", 0, product_id="p")], {"cart_to_purchase_ratio": 0.0}),
    "payment without cart": (
        [event(1, "payment", 0, status="success")],
        {"cart_to_purchase_ratio": 0.0, "has_payment": 1},
    ),
    "failed payment only": ([event(1, "payment", 0, status="failed")], {"has_payment": 0}),
    "payment before signup": (
        [event(1, "payment", 0, status="success"), event(2, "user_signup", 7.5)],
        {"signup_to_purchase_speed": -7.5},
    ),
    "last seen in arrival order wins": (
        [
            event(3, "user_signup", 0),
            event(2, "user_signup", 4),
            event(1, "payment", 10, status="success"),
            event(4, "payment", 6, status="success"),
        ],
        {"signup_to_purchase_speed": 6.0},
    ),
    "url equal to a product id counts once": (
        [event(1, "pageview", 0, url="p1"), event(2, "product_view", 1, product_id="p1")],
        {"unique_pages_visited": 1.0, "page_revisit_ratio": 0.0},
    ),
    "carts are no pages": ([event(1, "add_to_cart", 0, product_id="p")], {"unique_pages_visited": 0.0}),
    "sub-second session": (
        [event(1, "click", 0.1), event(2, "click", 1.9)],
        {"session_duration_seconds": 1.8},
    ),
    "payment without status": ([event(1, "payment", 0)], {"has_payment": 0}),
}


@pytest.mark.parametrize("case", GOLDEN)
def test_golden_sessions(make_events, case):
    rows, expected = GOLDEN[case]
    got = one(session_features(make_events(rows), arrival="arrival_seq"))
    assert {k: got[k] for k in expected} == expected


@pytest.mark.parametrize("seed", range(3))
def test_features_match_brute_force(make_events, seed):
    rows = random_events(random.Random(seed))
    got = {
        r["session_id"]: r.asDict()
        for r in session_features(make_events(rows), arrival="arrival_seq").collect()
    }
    groups = by_session(as_dicts(rows))
    assert set(got) == set(groups)
    for session, events in groups.items():
        expected = features(events)
        assert {f: got[session][f] for f in FEATURE_COLUMNS} == pytest.approx(expected)


def test_single_features_equal_the_full_row(make_events):
    events = make_events(random_events(random.Random(9)))
    full = {r["session_id"]: r for r in session_features(events).collect()}
    for feature in FEATURE_COLUMNS:
        for row in session_features(events, [feature]).collect():
            assert row[feature] == full[row["session_id"]][feature]


def test_without_arrival_column_event_time_decides(make_events):
    rows = [event(9, "user_signup", 0), event(1, "user_signup", 3), event(5, "payment", 10, status="success")]
    assert one(session_features(make_events(rows)))["signup_to_purchase_speed"] == 7.0


def test_feature_rows_and_buffer_names(make_events):
    events = make_events([event(1, "click", 0, agent_type="normal"), event(2, "click", 4, agent_type="bot")])
    row = one(feature_rows(events))
    assert row["agent_type"] == "bot"
    assert set(row) == {"session_id", "event_timestamp", "agent_type", *FEATURE_COLUMNS}
    stored = one(buffer_features(events))
    assert stored["event_count"] == 2 and stored["avg_gap"] == 4.0


def test_live_formulas(make_events):
    rows = [
        event(1, "pageview", 0.9, url="/a"),
        event(2, "add_to_cart", 10.2, product_id="p"),
        event(3, "payment", 20.1, status="failed"),
        event(4, "payment", 30.0, status="failed"),
    ]
    got = one(live_session_features(make_events(rows)))
    assert got["session_duration_seconds"] == 30
    assert got["events_per_minute"] == 4 / ((30 + 0.001) / 60)
    assert got["avg_time_between_events"] == 30 / (4 - 1 + 0.001)
    assert got["cart_to_purchase_ratio"] == 2 / 1 + 0.001
    assert got["has_payment"] == 1
    assert got["signup_to_purchase_speed"] == 0.0
    assert got["page_revisit_ratio"] == 0.0
    assert got["event_timestamp"] == at(30.0).replace(tzinfo=None)


def test_live_ratio_is_null_without_carts_and_one_event_rate_is_huge(make_events):
    got = one(live_session_features(make_events([event(1, "payment", 0, status="success")])))
    assert got["cart_to_purchase_ratio"] is None
    assert got["events_per_minute"] == pytest.approx(60000.0)
    assert got["page_revisit_ratio"] == 0.0


def test_live_speed_uses_earliest_times(make_events):
    rows = [
        event(1, "user_signup", 5),
        event(2, "user_signup", 50),
        event(3, "payment", 8, status="success"),
        event(4, "payment", 90, status="success"),
    ]
    assert one(live_session_features(make_events(rows)))["signup_to_purchase_speed"] == 3.0


def test_drift_is_live_minus_exact(make_events):
    events = make_events([event(1, "click", 0.1), event(2, "click", 1.9)])
    row = one(feature_drift(session_features(events), live_session_features(events)))
    assert row["session_duration_seconds_drift"] == pytest.approx(1 - 1.8)


def test_approximate_counts_stay_near_exact(spark):
    many = spark.range(20000).select(
        (F.col("id") % 3).cast("string").alias("session_id"),
        F.concat(F.lit("/p"), F.col("id").cast("string")).alias("url"),
    )
    from sessionlens.operators.aggregates import approx_unique_pages

    for row in approx_unique_pages(many).collect():
        assert abs(row["unique_pages_visited"] - 6667) < 0.2 * 6667


def test_omitted_url_counts_as_the_default_page(make_events):
    rows = [event(1, "pageview", 0), event(2, "pageview", 5), event(3, "pageview", 9, url="https://example.com")]
    got = session_features(make_events(rows)).first()
    assert got["unique_pages_visited"] == 1.0
    assert got["page_revisit_ratio"] == pytest.approx(2 / 3)
