from conftest import event

from sessionlens.operators import checks


def test_session_shape(make_events):
    rows = [
        event(1, "pageview", 0, "good", url="/"), event(2, "pageview", 9, "good", url="/exit"),
        event(3, "click", 0, "bad"), event(4, "click", 1, "bad"),
    ]
    got = {r["session_id"]: r for r in checks.session_shape(make_events(rows), max_events=2).collect()}
    assert (got["good"]["landing_ok"], got["good"]["ended_with_exit"], got["good"]["length_ok"]) == (True, True, False)
    assert (got["bad"]["landing_ok"], got["bad"]["ended_with_exit"]) == (False, False)


def test_funnel_order(make_events):
    rows = [
        event(1, "checkout", 0, "a"), event(2, "payment", 5, "a"),
        event(3, "payment", 0, "b"), event(4, "checkout", 5, "b"),
        event(5, "payment", 0, "c"), event(6, "click", 0, "d"),
    ]
    got = {r["session_id"]: r["in_order"] for r in checks.funnel_order(make_events(rows)).collect()}
    assert got == {"a": True, "b": False, "c": False}


def ring(size, subnet, product="watch"):
    out = []
    for i in range(size):
        base = dict(session=f"{subnet}-{i}", ip=f"{subnet}.{i + 1}", agent_type="fraud")
        out.append(event(100 * i, "product_view", i, product_id=product, **base))
        out.append(event(100 * i + 1, "payment", i + 9, status="success", **base))
    return out


def test_ring_candidates_and_conversion(make_events):
    lone = [event(900, "click", 0, "x", ip="9.9.9.1"), event(901, "click", 1, "y", ip="9.9.9.1")]
    events = make_events(ring(5, "45.12.88") + ring(2, "7.7.7", "ring") + lone)
    got = {r["subnet"]: (r["sessions"], r["addresses"]) for r in checks.ring_candidates(events).collect()}
    assert got == {"45.12.88": (5, 5), "7.7.7": (2, 2)}
    by_product = checks.ring_candidates(events, min_sessions=3, by_product=True).collect()
    assert [(r["subnet"], r["product_id"]) for r in by_product] == [("45.12.88", "watch")]
    wins = {r["subnet"]: (r["successful_payments"], r["full_conversion"]) for r in checks.ring_conversion(events).collect()}
    assert wins == {"45.12.88": (5, True), "7.7.7": (2, True)}


def test_engagement_decay(make_events):
    rows = [event(i, "click", i, "first") for i in range(3)] + [event(9, "click", 99, "second")]
    rows += [event(20, "click", 0, "only", user_id="u2")]
    rows += [event(30, "click", 0, "x1", user_id="u3"), event(31, "click", 9, "x2", user_id="u3"),
             event(32, "click", 10, "x2", user_id="u3")]
    got = {r["user_id"]: r["decays"] for r in checks.engagement_decay(make_events(rows)).collect()}
    assert got == {"u1": True, "u2": False, "u3": False}


def test_gap_bounds(make_events):
    rows = [event(i, "click", t, "h") for i, t in enumerate([0, 5, 35, 36])]
    rows += [event(10 + i, "click", t, "b", agent_type="bot") for i, t in enumerate([0, 0.5, 1.7, 3.0])]
    got = {r["agent_type"]: (r["gaps"], r["outside"]) for r in checks.gap_bounds(make_events(rows)).collect()}
    assert got == {"normal": (3, 1), "bot": (3, 1)}
