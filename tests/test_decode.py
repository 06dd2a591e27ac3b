import json

import pytest
from conftest import at
from pyspark.sql import functions as F

from sessionlens.operators import decode, validate
from sessionlens.schema import ENVELOPE, FULL_EVENT
from sessionlens.sources import driver_tables

STAMP = "2024-05-01T12:00:00.123456Z"


def message(**fields):
    return json.dumps(
        {"event_id": "1", "event_type": "click", "timestamp": STAMP, "session_id": "s",
         "user_id": "u", "element_id": "b", **fields}
    )


@pytest.fixture(scope="module")
def topic(spark):
    def make(*values):
        rows = [(i, v.encode() if v is not None else None) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "seq int, value binary")

    return make


def test_decode_reads_bytes_and_drops_other_keys(topic):
    row = decode.decode_events(
        topic(message(properties={"ip": "1.2.3.4", "agent_type": "bot", "other": 1}, extra=3))
    ).first()
    assert row["timestamp"] == at(0.123456).replace(tzinfo=None)
    assert row["properties"].asDict() == {"ip": "1.2.3.4", "agent_type": "bot"}
    assert row.__fields__ == ENVELOPE.names


def test_unreadable_value_gives_a_null_row_and_is_found_corrupt(topic):
    raw = topic("not json", message(), None)
    assert decode.decode_events(raw).where(F.col("session_id").isNull()).count() == 2
    bad = decode.corrupt_events(raw, keep=("seq",)).collect()
    assert [(r["seq"], r["raw_value"]) for r in bad] == [(0, "not json")]


def test_bad_timestamp_spoils_only_its_field(topic):
    row = decode.decode_checked(topic(message(timestamp="yesterday"))).first()
    assert row["timestamp"] is None and row["user_id"] == "u"
    assert row["_corrupt_record"] is not None


def test_tombstones_are_skipped(topic):
    assert decode.drop_tombstones(topic(None, message(), None)).count() == 1


ERRORS = [
    (message(), []),
    (message(user_id=None), ["missing user_id"]),
    (message(session_id=None, user_id=None), ["missing session_id", "missing user_id"]),
    (message(event_type="hover"), ["unknown event_type"]),
    (message(event_type=None), ["missing event_type"]),
    (message(event_type="search"), ["missing query"]),
    (message(event_type="checkout", cart_total=2.5), ["missing item_count"]),
    (message(event_type="payment", amount=1.0), ["missing status", "missing payment_method"]),
    (message(event_type="user_signup"), ["missing email"]),
    (message(event_type="product_view"), ["missing product_id"]),
    (message(event_type="add_to_cart"), ["missing product_id"]),
    (message(event_type="pageview"), []),
    ("{", ["malformed", "missing event_type", "missing session_id", "missing user_id"]),
]


def test_validation_names_every_broken_rule(topic):
    checked = decode.decode_checked(topic(*[m for m, _ in ERRORS]), keep=("seq",))
    got = {r["seq"]: r["errors"] for r in validate.validate_events(checked).collect()}
    assert got == {i: errors for i, (_, errors) in enumerate(ERRORS)}
    assert validate.valid_events(checked).count() == 2
    assert validate.quarantine_events(checked).count() == len(ERRORS) - 2


def test_a_message_is_written_and_parsed_once_whatever_the_rules(spark, tmp_path):
    events = spark.range(30).selectExpr(
        "id AS event_id",
        "timestamp '2024-05-01 12:00:00' AS ts",
        "1L AS user_id",
        "'view' AS event_type",
        "1.0D AS value",
        """'{"k": 3}' AS props""",
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    raw = driver_tables.raw_topic(spark, str(tmp_path))
    bad = validate.quarantine_events(decode.decode_checked(raw, keep=("seq",)))
    plan = bad._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    # One mention for cut messages and one for whole ones.
    assert plan.count("StructsToJsonEvaluator(") == 2
    got = {r["seq"]: r["errors"][0] for r in bad.collect()}
    assert got == {13: "malformed", 21: "unknown event_type", 29: "missing user_id"}


def test_dispatch_fills_one_struct_and_quarantines_unknown_types(topic):
    raw = topic(message(), message(event_type="hover"), message(event_type="search", query="shoes"))
    rows = validate.dispatch_by_type(decode.decode_checked(raw, keep=("seq",))).collect()
    routes = sorted(r["route"] for r in rows)
    assert routes == ["click", "quarantine", "search"]
    for r in rows:
        filled = [c for c in ("click", "search", "payment") if r[c] is not None]
        assert filled == ([] if r["route"] == "quarantine" else [r["route"]])


def test_defaults_apply_to_their_own_type_only(topic):
    raw = topic(
        message(event_type="pageview", event_id=None, timestamp=None),
        message(event_type="add_to_cart", product_id="p"),
        message(event_type="user_signup", email="a@b"),
        message(event_type="pageview", url="/x", properties={"source": "email"}),
    )
    rows = decode.apply_event_defaults(decode.decode_events(raw, FULL_EVENT, ("seq",)))
    got = {r["seq"]: r for r in rows.collect()}
    assert got[0]["url"] == "https://example.com" and got[0]["event_id"] and got[0]["timestamp"]
    assert got[0]["properties"] == {} and got[0]["quantity"] is None
    assert got[1]["quantity"] == 1 and got[1]["url"] is None
    assert got[2]["method"] == "email"
    assert got[3]["url"] == "/x" and got[3]["properties"] == {"source": "email"}


def test_generated_ids_differ(topic):
    raw = topic(*[message(event_id=None)] * 20)
    filled = decode.apply_event_defaults(decode.decode_events(raw))
    assert filled.select("event_id").distinct().count() == 20


def test_round_trip_keeps_every_field(topic):
    raw = topic(
        message(event_type="checkout", cart_total=12.25, item_count=3),
        message(event_type="pageview", url="/ä\"\\x", properties={"z": "1", "a": "2"}),
    )
    events = decode.decode_events(raw, FULL_EVENT)
    assert [r["intact"] for r in decode.event_roundtrip(events).collect()] == [True, True]


def test_published_message_decodes_to_the_event(topic):
    events = decode.decode_events(topic(message(properties={"ip": "1.1.1.1"})), FULL_EVENT)
    sent = decode.publish_events(events)
    assert sent.first()["key"] == "u"
    assert decode.decode_events(sent, FULL_EVENT).collect() == events.collect()


def test_pageview_tap(topic):
    raw = topic(message(), message(event_type="pageview", url="/a"))
    assert [tuple(r) for r in decode.tap_pageviews(decode.decode_events(raw)).collect()] == [
        ("pageview", "u", "/a")
    ]


def test_duplicate_ids(topic):
    events = decode.decode_events(topic(message(), message(), message(event_id="2")))
    assert [tuple(r) for r in validate.duplicate_event_ids(events).collect()] == [("1", 2)]


def test_kv_json(spark):
    rows = spark.createDataFrame([("abc", 1.5, 3)], "session_id string, avg_gap double, event_count long")
    kv = decode.features_to_kv_json(rows, ["avg_gap", "event_count"]).first()
    assert kv["key"] == "session:abc" and json.loads(kv["value"]) == {"avg_gap": 1.5, "event_count": 3}
