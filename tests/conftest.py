import os
import sys
from datetime import datetime, timedelta, timezone

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(__file__)), os.path.dirname(__file__)]

from sessionlens.session import build_session  # noqa: E402

T0 = datetime(2024, 5, 1, 12, 0, 0, tzinfo=timezone.utc)

EVENT_SCHEMA = (
    "event_id string, event_type string, timestamp timestamp, session_id string, "
    "user_id string, url string, product_id string, status string, ip string, "
    "agent_type string, arrival_seq long"
)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        app="tests",
        master="local[8]",
        shuffle_partitions=8,
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def event(seq: int, kind: str, seconds: float, session: str = "s1", **fields) -> tuple:
    row = {
        "event_id": f"e{seq:06d}",
        "event_type": kind,
        "timestamp": at(seconds),
        "session_id": session,
        "user_id": "u1",
        "url": None,
        "product_id": None,
        "status": None,
        "ip": "10.0.0.1",
        "agent_type": "normal",
        "arrival_seq": seq,
        **fields,
    }
    return tuple(row.values())


@pytest.fixture(scope="session")
def make_events(spark):
    def make(rows):
        return spark.createDataFrame(rows, EVENT_SCHEMA)

    return make


NAMES = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]


def as_dicts(rows):
    return [dict(zip(NAMES, r)) for r in rows]


def random_events(rng, sessions=12, rows=400, hot_share=0.4, span=5000.0):
    """Random sessions, one of which holds ``hot_share`` of all events."""
    kinds = ["pageview", "product_view", "add_to_cart", "payment", "user_signup", "click"]
    out = []
    for seq in range(rows):
        hot = rng.random() < hot_share
        session = "hot" if hot else f"s{rng.randrange(sessions)}"
        kind = rng.choice(kinds)
        fields = {}
        if kind == "pageview":
            fields["url"] = rng.choice(["/a", "/b", "/c", "/exit", "p1"])
        if kind in ("product_view", "add_to_cart"):
            fields["product_id"] = rng.choice(["p1", "p2", "p3"])
        if kind == "payment":
            fields["status"] = rng.choice(["success", "failed"])
        moment = round(rng.random() * span, rng.choice([0, 1, 6]))
        out.append(event(seq, kind, moment, session, **fields))
    return out
