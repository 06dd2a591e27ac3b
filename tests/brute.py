"""Plain Python versions of the session computations, for small fixtures."""

from collections import defaultdict


def by_session(events):
    groups = defaultdict(list)
    for e in sorted(events, key=lambda e: (e["timestamp"], e["event_id"])):
        groups[e["session_id"]].append(e)
    return groups


def features(events):
    """Exact features of one session; ``events`` in any order."""
    times = sorted(e["timestamp"] for e in events)
    n, span = len(events), (times[-1] - times[0]).total_seconds()
    views = [e["url"] for e in events if e["event_type"] == "pageview"]
    products = [e["product_id"] for e in events if e["event_type"] == "product_view"]
    adds = sum(e["event_type"] == "add_to_cart" for e in events)
    wins = [e for e in events if e["event_type"] == "payment" and e["status"] == "success"]
    signups = [e for e in events if e["event_type"] == "user_signup"]
    speed = 0.0
    if wins and signups:
        win, signup = (max(x, key=lambda e: e["arrival_seq"]) for x in (wins, signups))
        speed = (win["timestamp"] - signup["timestamp"]).total_seconds()
    return {
        "events_per_minute": 0.0 if n < 2 else float(n) if span <= 0 else n / span * 60,
        "unique_pages_visited": float(len(set(views) | set(products))),
        "avg_time_between_events": span / (n - 1) if n > 1 else 0.0,
        "cart_to_purchase_ratio": len(wins) / adds if adds else 0.0,
        "session_duration_seconds": span if n > 1 else 0.0,
        "event_type_diversity": len({e["event_type"] for e in events}),
        "has_payment": int(bool(wins)),
        "signup_to_purchase_speed": speed,
        "page_revisit_ratio": 1 - len(set(views)) / len(views) if views else 0.0,
    }


def close_buffers(events, idle, cap, as_of=None):
    """Feed the events of every session through a buffer; list the closings."""
    as_of = as_of or max(e["timestamp"] for e in events)
    closed = []
    for session, rows in by_session(events).items():
        buffer = []

        def close(reason):
            closed.append(
                (session, len(buffer), buffer[0]["timestamp"], buffer[-1]["timestamp"], reason)
            )
            buffer.clear()

        for e in rows:
            if buffer and (e["timestamp"] - buffer[-1]["timestamp"]).total_seconds() > idle:
                close("idle")
            buffer.append(e)
            if e["event_type"] == "pageview" and "exit" in e["url"]:
                close("exit")
            elif len(buffer) >= cap:
                close("cap")
        if buffer:
            left = (as_of - buffer[-1]["timestamp"]).total_seconds()
            close("idle" if left > idle else "flush")
    return sorted(closed)
