"""The same queries as SQL over the test tables, for checking results."""

from __future__ import annotations

from sessionlens.plans.catalog import (
    ARRIVAL_BATCH,
    BACKLOG_FILES,
    IDLE_SECONDS,
    LATE_SECONDS,
    MAX_EVENTS,
    SCORE,
    SHARE,
    TTL_HOURS,
)
from sessionlens.plans.pipeline import WAVE_ROWS
from sessionlens.schema import EVENT_TYPES, FEATURE_COLUMNS

IDLE_MICROS = IDLE_SECONDS * 1_000_000

# The events table as typed shop events with 24 h sessions.
_EVENTS = """
typed AS (
  SELECT event_id AS eid, ts, user_id AS uid, event_type AS kind, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
marked AS (
  SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY uid ORDER BY ts, eid)
                      > 86400000000 THEN 1 ELSE 0 END AS brk
  FROM typed),
cut AS (
  SELECT *, CAST(sum(brk) OVER (PARTITION BY uid ORDER BY ts, eid
                                ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment
  FROM marked),
named AS (
  SELECT *, CASE kind
    WHEN 'view' THEN CASE WHEN k < 50 THEN 'pageview' ELSE 'product_view' END
    WHEN 'click' THEN CASE WHEN k < 40 THEN 'add_to_cart' WHEN k < 60 THEN 'checkout'
                           WHEN k < 80 THEN 'search' ELSE 'click' END
    WHEN 'purchase' THEN 'payment'
    WHEN 'signup' THEN 'user_signup'
    WHEN 'error' THEN CASE WHEN k < 50 THEN 'payment' ELSE 'pageview' END END AS event_type
  FROM cut),
ev AS (
  SELECT CAST(eid AS VARCHAR) AS event_id, event_type, ts AS "timestamp",
    uid || '-' || segment AS session_id, CAST(uid AS VARCHAR) AS user_id,
    CASE WHEN kind = 'view' AND k < 50 THEN '/p/' || (k % 10)
         WHEN kind = 'error' AND k >= 50 THEN '/exit' END AS url,
    CASE WHEN event_type IN ('product_view', 'add_to_cart')
         THEN 'prod_' || lpad(CAST(k % 50 + 1 AS VARCHAR), 3, '0') END AS product_id,
    CASE WHEN kind = 'purchase' THEN 'success'
         WHEN kind = 'error' AND k < 50 THEN 'failed' END AS status,
    '45.12.' || ((uid // 5) % 256) || '.' || (eid % 254 + 1) AS ip,
    CASE uid % 10 WHEN 0 THEN 'bot' WHEN 1 THEN 'fraud' WHEN 2 THEN 'churning'
                  ELSE 'normal' END AS agent_type,
    CASE WHEN event_type = 'search' THEN 'q' || k END AS query,
    CASE WHEN event_type = 'add_to_cart' THEN k % 3 + 1 END AS quantity,
    CASE WHEN event_type = 'checkout' THEN value END AS cart_total,
    CASE WHEN event_type = 'checkout' THEN k % 5 + 1 END AS item_count,
    CASE WHEN event_type = 'payment' THEN value END AS amount,
    CASE WHEN event_type = 'payment' THEN 'card' END AS payment_method,
    CASE WHEN event_type = 'user_signup' THEN 'u' || uid || '@example.com' END AS email,
    CASE WHEN event_type = 'click' THEN 'el_' || k END AS element_id,
    CASE WHEN event_type = 'product_view' THEN value END AS price,
    eid AS arrival_seq,
    coalesce(event_type = 'pageview' AND kind = 'error', false) AS is_exit
  FROM named)"""

_GAPS = """
gaps AS (
  SELECT *, epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER w AS gap_us,
         row_number() OVER w AS rn, count(*) OVER (PARTITION BY session_id) AS key_rows,
         lag(is_exit) OVER w AS prev_exit
  FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY "timestamp", arrival_seq))"""

# Feature formulas over one group of ``gaps`` rows.
_FEATURE_SQL = {
    "events_per_minute": """CASE WHEN count(*) < 2 THEN 0.0
        WHEN max("timestamp") = min("timestamp") THEN CAST(count(*) AS DOUBLE)
        ELSE count(*) / (date_diff('microsecond', min("timestamp"), max("timestamp"))
                         / 1e6) * 60 END""",
    "unique_pages_visited": """CAST(count(DISTINCT CASE event_type WHEN 'pageview' THEN url
        WHEN 'product_view' THEN product_id END) AS DOUBLE)""",
    "avg_time_between_events": """CASE WHEN count(*) < 2 THEN 0.0
        ELSE {gap_sum} / 1e6 / (count(*) - 1) END""",
    "cart_to_purchase_ratio": """coalesce(
        count(*) FILTER (event_type = 'payment' AND status = 'success')
        / nullif(count(*) FILTER (event_type = 'add_to_cart'), 0), 0.0)""",
    "session_duration_seconds": """CASE WHEN count(*) < 2 THEN 0.0
        ELSE date_diff('microsecond', min("timestamp"), max("timestamp")) / 1e6 END""",
    "event_type_diversity": "count(DISTINCT event_type)",
    "has_payment": """CAST(coalesce(bool_or(event_type = 'payment' AND status = 'success'),
        false) AS BIGINT)""",
    "signup_to_purchase_speed": """coalesce(date_diff('microsecond',
        arg_max("timestamp", arrival_seq) FILTER (event_type = 'user_signup'),
        arg_max("timestamp", arrival_seq) FILTER (event_type = 'payment'
                                                  AND status = 'success')) / 1e6, 0.0)""",
    "page_revisit_ratio": """coalesce(1.0 - count(DISTINCT url) FILTER (event_type = 'pageview')
        / nullif(count(*) FILTER (event_type = 'pageview'), 0), 0.0)""",
}
_SESSION_GAP_SUM = "CAST(sum(gap_us) AS DOUBLE)"
_BUFFER_GAP_SUM = "CAST(sum(CASE WHEN brow > 1 THEN gap_us END) AS DOUBLE)"


def _formula(feature: str, gap_sum: str = _SESSION_GAP_SUM) -> str:
    return _FEATURE_SQL[feature].replace("{gap_sum}", gap_sum)


_FEATURES = f"""
features AS (
  SELECT session_id, max("timestamp") AS event_timestamp, min(agent_type) AS agent_type,
    {", ".join(f"{_formula(f)} AS {f}" for f in FEATURE_COLUMNS)}
  FROM gaps GROUP BY session_id)"""

_WHOLE = "CAST(epoch(date_trunc('second', {0})) AS BIGINT)"

_LIVE = f"""
live_base AS (
  SELECT session_id, count(event_id) AS event_count,
    min("timestamp") AS session_start, max("timestamp") AS session_end,
    count(*) FILTER (event_type = 'payment') AS payment_count,
    count(*) FILTER (event_type = 'add_to_cart') AS cart_count,
    min("timestamp") FILTER (event_type = 'user_signup') AS signup_time,
    min("timestamp") FILTER (event_type = 'payment' AND status = 'success') AS purchase_time,
    count(*) FILTER (event_type = 'pageview') AS pageview_count,
    min(agent_type) AS agent_type
  FROM ev GROUP BY session_id),
live_timed AS (
  SELECT *, {_WHOLE.format("session_end")} - {_WHOLE.format("session_start")} AS dur,
    {_WHOLE.format("purchase_time")} - {_WHOLE.format("signup_time")} AS speed
  FROM live_base),
live AS (
  SELECT * EXCLUDE (dur, speed), dur AS session_duration_seconds,
    event_count / ((dur + 1e-3) / 60) AS events_per_minute,
    dur / (event_count - 1 + 1e-3) AS avg_time_between_events,
    payment_count / nullif(cart_count, 0) + 1e-3 AS cart_to_purchase_ratio,
    CAST(payment_count > 0 AS INTEGER) AS has_payment,
    coalesce(CAST(speed AS DOUBLE), 0.0) AS signup_to_purchase_speed,
    session_end AS event_timestamp
  FROM live_timed)"""

_BUFFERS = f"""
opened AS (
  SELECT *, CASE WHEN rn > 1 AND (prev_exit OR gap_us > {IDLE_MICROS})
                 THEN 1 ELSE 0 END AS opens
  FROM gaps),
runs AS (
  SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY rn
                             ROWS UNBOUNDED PRECEDING) AS run
  FROM opened),
parted AS (
  SELECT *, (row_number() OVER (PARTITION BY session_id, run ORDER BY rn) - 1)
            // {MAX_EVENTS} AS part
  FROM runs),
buffered AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, run, part ORDER BY rn) AS brow
  FROM parted),
buffers AS (
  SELECT session_id, run, part, count(*) AS event_count, min("timestamp") AS opened_at,
    max("timestamp") AS last_seen, arg_max(is_exit, rn) AS ended_exit,
    bool_or(rn = key_rows) AS final, min(agent_type) AS agent_type,
    {", ".join(f"{_formula(f, _BUFFER_GAP_SUM)} AS {f}" for f in FEATURE_COLUMNS)}
  FROM buffered GROUP BY session_id, run, part),
closed AS (
  SELECT *, CASE WHEN ended_exit THEN 'exit' WHEN event_count >= {MAX_EVENTS} THEN 'cap'
      WHEN final AND date_diff('microsecond', last_seen, (SELECT max("timestamp") FROM ev))
                     <= {IDLE_MICROS} THEN 'flush'
      ELSE 'idle' END AS close_reason
  FROM buffers)"""

_ERRORS = """
errors AS (
  SELECT session_id, f.agent_type,
    ((f.session_duration_seconds - l.session_duration_seconds)
       * (f.session_duration_seconds - l.session_duration_seconds)
     + (f.cart_to_purchase_ratio - coalesce(l.cart_to_purchase_ratio, 0))
       * (f.cart_to_purchase_ratio - coalesce(l.cart_to_purchase_ratio, 0))
     + (f.has_payment - l.has_payment) * (f.has_payment - l.has_payment)) / 3 AS error
  FROM features f JOIN live l USING (session_id))"""

_FLAGGED = f"""
flagged AS (
  SELECT session_id, agent_type, CAST(agent_type IN ('bot', 'fraud') AS INTEGER) AS label,
    CAST({SCORE} > (SELECT quantile_cont({SCORE}, {1 - SHARE}) FROM features) AS INTEGER)
      AS prediction
  FROM features),
cells AS (
  SELECT count(*) FILTER (label = 0 AND prediction = 0) AS tn,
         count(*) FILTER (label = 0 AND prediction = 1) AS fp,
         count(*) FILTER (label = 1 AND prediction = 0) AS fn,
         count(*) FILTER (label = 1 AND prediction = 1) AS tp
  FROM flagged),
classes AS (
  SELECT '0' AS class, coalesce(tn / nullif(tn + fn, 0), 0) AS precision,
    coalesce(tn / nullif(tn + fp, 0), 0) AS recall,
    coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f1, tn + fp AS support FROM cells
  UNION ALL
  SELECT '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0),
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), tp + fn FROM cells)"""

_AGENTS = """
agents AS (
  SELECT agent_type, count(*) AS total, count(*) FILTER (prediction = 1) AS caught,
    count(*) FILTER (prediction = 0) AS missed,
    count(*) FILTER (prediction = 1) / count(*) AS recall
  FROM flagged GROUP BY agent_type)"""

# Messages with one of five faults in each fifty consecutive events.
_DAMAGED = """
damaged AS (
  SELECT *, arrival_seq % 50 AS rule FROM ev),
received AS (
  SELECT rule, arrival_seq AS seq,
    rule = 13 AS broken,
    CASE WHEN rule <> 13 THEN event_id END AS event_id,
    CASE WHEN rule = 21 THEN 'hover' WHEN rule <> 13 THEN event_type END AS event_type,
    CASE WHEN rule NOT IN (13, 29) THEN user_id END AS user_id,
    CASE WHEN rule <> 13 THEN session_id END AS session_id,
    CASE WHEN rule <> 13 THEN url END AS url,
    CASE WHEN rule NOT IN (13, 37) THEN query END AS query,
    CASE WHEN rule NOT IN (13, 37) THEN product_id END AS product_id,
    CASE WHEN rule NOT IN (13, 37) THEN status END AS status,
    CASE WHEN rule NOT IN (13, 37) THEN item_count END AS item_count,
    CASE WHEN rule NOT IN (13, 37) THEN email END AS email,
    CASE WHEN rule NOT IN (13, 37) THEN element_id END AS element_id,
    CASE WHEN rule <> 13 THEN quantity END AS quantity,
    CASE WHEN rule <> 13 THEN cart_total END AS cart_total,
    CASE WHEN rule <> 13 THEN amount END AS amount,
    CASE WHEN rule <> 13 THEN payment_method END AS payment_method,
    CASE WHEN rule <> 13 THEN price END AS price
  FROM damaged WHERE rule <> 7)"""

_KNOWN = ", ".join(f"'{t}'" for t in EVENT_TYPES)
_MISSING = ", ".join(
    f"CASE WHEN event_type = '{t}' AND {c} IS NULL THEN 'missing {c}' END"
    for t, c in [
        ("search", "query"),
        ("add_to_cart", "product_id"),
        ("checkout", "cart_total"),
        ("checkout", "item_count"),
        ("payment", "amount"),
        ("payment", "status"),
        ("payment", "payment_method"),
        ("user_signup", "email"),
        ("click", "element_id"),
        ("product_view", "product_id"),
    ]
)
_VALIDATED = f"""
validated AS (
  SELECT *, concat_ws(', ', CASE WHEN broken THEN 'malformed' END,
    CASE WHEN event_type IS NULL THEN 'missing event_type' END,
    CASE WHEN session_id IS NULL THEN 'missing session_id' END,
    CASE WHEN user_id IS NULL THEN 'missing user_id' END,
    CASE WHEN event_type NOT IN ({_KNOWN}) THEN 'unknown event_type' END,
    {_MISSING}) AS errors
  FROM received)"""


def _with(body: str, *parts: str) -> str:
    return f"WITH {', '.join((_EVENTS, *parts))} {body}"


def _ev(body: str) -> str:
    return _with(body)


def _feat(body: str) -> str:
    return _with(body, _GAPS, _FEATURES)


def _live(body: str) -> str:
    return _with(body, _LIVE)


def _buf(body: str) -> str:
    return _with(body, _GAPS, _BUFFERS)


def _flag(body: str) -> str:
    return _with(body, _GAPS, _FEATURES, _FLAGGED, _AGENTS)


def _bad(body: str) -> str:
    return _with(body, _DAMAGED, _VALIDATED)


def _per_session(value: str, where: str = "") -> str:
    return _ev(f"SELECT session_id, {value} FROM ev {where} GROUP BY session_id")


_LIVE_COLUMNS = """session_id, event_count, session_start, session_end, payment_count,
  cart_count, signup_time, purchase_time, pageview_count, agent_type,
  session_duration_seconds, events_per_minute, avg_time_between_events,
  cart_to_purchase_ratio, has_payment, signup_to_purchase_speed, event_timestamp"""

_FLAT = """event_id, event_type, "timestamp", session_id, user_id, url, product_id,
  status, ip, agent_type"""

_TEST_ROWS = """
normals AS (
  SELECT session_id, min(agent_type) AS agent_type,
    row_number() OVER (ORDER BY md5(session_id || '#42')) AS place, count(*) OVER () AS n
  FROM ev WHERE agent_type NOT IN ('bot', 'fraud') GROUP BY session_id),
split AS (SELECT *, place <= ceil(0.3 * n) AS held_out FROM normals)"""

_SUBNET = "regexp_extract(ip, '^(\\d+\\.\\d+\\.\\d+)\\.', 1)"


def _rings(extra: str = "") -> str:
    keys = f"subnet{extra}"
    where = "WHERE product_id IS NOT NULL" if extra else ""
    return f"""
rings AS (
  SELECT {keys}, count(DISTINCT session_id) AS sessions, count(DISTINCT ip) AS addresses,
    count(*) FILTER (event_type = 'payment' AND status = 'success') AS successful_payments
  FROM (SELECT *, {_SUBNET} AS subnet FROM ev) {where} GROUP BY {keys}
  HAVING count(DISTINCT session_id) >= 2 AND count(DISTINCT ip) > 1)"""


_RANGES = {
    "dq_epm": ("events_per_minute", 0, 10000),
    "dq_pages": ("unique_pages_visited", 0, 500),
    "dq_gap": ("avg_time_between_events", 0, 3600),
    "dq_cart": ("cart_to_purchase_ratio", 0, 1.001),
    "dq_duration": ("session_duration_seconds", 0, 86400),
    "dq_diversity": ("event_type_diversity", 1, 8),
    "dq_payment": ("has_payment", 0, 1),
    "dq_signup": ("signup_to_purchase_speed", 0, 86400),
    "dq_revisit": ("page_revisit_ratio", 0, 1),
}


def _range_check(column: str, low: float, high: float) -> str:
    outside = f"{column} < {low} OR {column} > CAST({high} AS DOUBLE)"
    return f"""SELECT '{column} between' AS rule, count({column}) AS rows_checked,
      count(*) FILTER ({outside}) AS unexpected,
      count(*) FILTER ({outside}) = 0 AS passed FROM features"""


_NULL_CHECK = """SELECT 'session_id not null' AS rule, count(*) AS rows_checked,
  count(*) FILTER (session_id IS NULL) AS unexpected,
  count(*) FILTER (session_id IS NULL) = 0 AS passed FROM features"""
_ALL_CHECKS = " UNION ALL ".join([_NULL_CHECK, *[_range_check(*r) for r in _RANGES.values()]])


def build() -> dict[str, str]:
    q: dict[str, str] = {}

    # sources, sinks, connectors
    q["src_event_stream"] = _ev(
        'SELECT event_id, event_type, "timestamp", session_id, user_id FROM ev'
    )
    q["decode_events"] = _ev(f"SELECT {_FLAT} FROM ev")
    q["scan_offline"] = _feat(
        f"SELECT session_id, event_timestamp, agent_type, {', '.join(FEATURE_COLUMNS)} FROM features"
    )
    # A snapshot of a session for each time slice that holds events of it.
    q["sink_offline"] = _ev(
        f"""SELECT session_id, max(newest) OVER upto AS event_timestamp,
          {", ".join(f"CAST(sum({c}) OVER upto AS BIGINT) AS {c}"
                     for c in ("event_count", "payment_count", "pageview_count"))}
          FROM (SELECT session_id, wave, max("timestamp") AS newest, count(*) AS event_count,
                  count(*) FILTER (event_type = 'payment') AS payment_count,
                  count(*) FILTER (event_type = 'pageview') AS pageview_count
                FROM (SELECT *, (epoch_us("timestamp") - lo) // ((hi - lo) // waves + 1) AS wave
                      FROM ev, (SELECT min(epoch_us("timestamp")) AS lo,
                                  max(epoch_us("timestamp")) AS hi,
                                  greatest(2, (count(*) + {WAVE_ROWS} - 1) // {WAVE_ROWS}) AS waves
                                FROM ev))
                GROUP BY session_id, wave)
          WINDOW upto AS (PARTITION BY session_id ORDER BY wave)"""
    )
    q["compact_history"] = q["sink_offline"]
    q["read_history_date"] = f"""WITH history AS ({q["sink_offline"]}) SELECT * FROM history
      WHERE CAST(event_timestamp AS DATE) = (SELECT max(CAST(event_timestamp AS DATE)) FROM history)"""
    q["sink_online_latest"] = _live(
        "SELECT session_id, event_timestamp, event_count, payment_count, agent_type FROM live"
    )
    stored = """events_per_minute, unique_pages_visited AS unique_pages,
      avg_time_between_events AS avg_gap, cart_to_purchase_ratio AS cart_ratio,
      (SELECT count(*) FROM ev WHERE ev.session_id = features.session_id) AS event_count"""
    q["features_to_kv_json"] = _feat(
        f"SELECT 'session:' || session_id AS key, {stored} FROM features"
    )
    q["sink_fanout"] = _ev(
        "SELECT true AS log_matches, count(DISTINCT session_id) AS sessions, "
        "count(DISTINCT session_id) AS online_keys FROM ev"
    )
    q["publish_events"] = _ev(
        "SELECT user_id AS key, * EXCLUDE (arrival_seq, is_exit) FROM ev"
    )
    q["tap_pageviews"] = _ev(
        "SELECT event_type, user_id, url FROM ev WHERE event_type = 'pageview'"
    )
    q["drop_tombstones"] = _ev(
        "SELECT user_id AS key, arrival_seq AS seq FROM ev WHERE arrival_seq % 50 <> 7"
    )
    q["log_run"] = _flag(
        """SELECT 'baseline' AS run, m.key, round(m.value, 6) AS value FROM (
          SELECT 'precision_anomaly' AS key, precision AS value FROM classes WHERE class = '1'
          UNION ALL SELECT 'recall_anomaly', recall FROM classes WHERE class = '1'
          UNION ALL SELECT 'f1_anomaly', f1 FROM classes WHERE class = '1'
          UNION ALL SELECT agent_type || '_recall', recall FROM agents
          WHERE agent_type IN ('bot', 'fraud')) m"""
    )

    # event typing and validation
    q["event_envelope"] = q["decode_events"]
    q["apply_event_defaults"] = _ev(
        """SELECT event_id, event_type,
          CASE WHEN url = '/p/0' THEN 'https://example.com' ELSE url END AS url,
          CASE WHEN quantity = 2 THEN 1 ELSE quantity END AS quantity,
          CASE WHEN event_type = 'user_signup' THEN 'email' END AS method FROM ev"""
    )

    def when(event_type: str, column: str, name: str) -> str:
        return f"CASE WHEN event_type = '{event_type}' THEN {column} END AS {name}"

    q["dispatch_by_type"] = _bad(
        f"""SELECT event_id,
          CASE WHEN event_type IN ({_KNOWN}) THEN event_type ELSE 'quarantine' END AS route,
          {when("pageview", "url", "page_url")}, {when("search", "query", "search_query")},
          {when("add_to_cart", "product_id", "cart_product")},
          {when("add_to_cart", "quantity", "cart_quantity")},
          {when("checkout", "cart_total", "checkout_total")},
          {when("checkout", "item_count", "checkout_items")},
          {when("payment", "amount", "payment_amount")},
          {when("payment", "status", "payment_status")},
          {when("user_signup", "email", "signup_email")},
          {when("click", "element_id", "click_element")},
          {when("product_view", "product_id", "viewed_product")},
          {when("product_view", "price", "viewed_price")} FROM received"""
    )
    q["validate_events"] = _bad(
        """SELECT seq, CAST(CASE WHEN errors = '' THEN 0
          ELSE len(string_split(errors, ', ')) END AS INTEGER) AS n_errors, errors
          FROM validated"""
    )
    q["quarantine_events"] = _bad(
        "SELECT seq, event_id, errors FROM validated WHERE errors <> ''"
    )
    q["event_roundtrip"] = _ev("SELECT event_id, true AS intact FROM ev")
    q["corrupt_events"] = _ev(
        """SELECT arrival_seq AS seq,
          substr('{"event_id":"' || event_id || '","event_type":"', 1, 20) AS raw_value
          FROM ev WHERE arrival_seq % 50 = 13"""
    )
    q["duplicate_event_ids"] = _ev(
        "SELECT event_id, CAST(2 AS BIGINT) AS copies FROM ev WHERE event_type = 'payment'"
    )

    # projections, filters, scalar expressions
    q["flatten_struct"] = _ev("SELECT event_id, session_id, ip, agent_type FROM ev")
    label = "CAST(min(agent_type) IN ('bot', 'fraud') AS INTEGER) AS label"
    q["label_agents"] = _per_session(f"min(agent_type) AS agent_type, {label}")
    q["exit_events"] = _ev("SELECT event_id, session_id, url FROM ev WHERE url LIKE '%exit%'")
    q["split_normal_anomaly"] = _per_session(
        "CASE WHEN min(agent_type) IN ('bot', 'fraud') THEN 'anomaly' ELSE 'normal' END AS part"
    )
    q["duration_whole_seconds"] = _live(
        "SELECT session_id, session_duration_seconds AS seconds FROM live"
    )
    q["duration_exact_seconds"] = _per_session(
        """date_diff('microsecond', min("timestamp"), max("timestamp")) / 1e6 AS seconds"""
    )
    q["fill_features"] = _live(
        "SELECT session_id, coalesce(cart_to_purchase_ratio, 0) AS cart_to_purchase_ratio, "
        "signup_to_purchase_speed FROM live"
    )
    q["ip_subnet"] = _ev(f"SELECT event_id, ip, {_SUBNET} AS subnet FROM ev")

    # aggregates
    q["agg_event_count"] = _per_session("count(event_id) AS event_count")
    q["agg_session_bounds"] = _per_session(
        'min("timestamp") AS session_start, max("timestamp") AS session_end'
    )
    for name, kind in (
        ("payment_count", "payment"),
        ("cart_count", "add_to_cart"),
        ("pageview_count", "pageview"),
    ):
        q[f"agg_{name}"] = _per_session(f"count(*) FILTER (event_type = '{kind}') AS {name}")
    q["agg_signup_time"] = _per_session(
        "min(\"timestamp\") FILTER (event_type = 'user_signup') AS signup_time"
    )
    q["agg_purchase_time"] = _per_session(
        "min(\"timestamp\") FILTER (event_type = 'payment' AND status = 'success') AS purchase_time"
    )
    q["agg_exact_unique_pages"] = _per_session(
        """count(DISTINCT CASE event_type WHEN 'pageview' THEN url
          WHEN 'product_view' THEN product_id END) AS unique_pages"""
    )
    q["agg_agent_type"] = _per_session("min(agent_type) AS agent_type")
    q["agg_success_counts"] = _per_session(
        """count(*) FILTER (event_type = 'payment' AND status = 'success') AS success_count,
          count(*) FILTER (event_type = 'add_to_cart') AS cart_count"""
    )
    q["agg_exact_type_diversity"] = _per_session(
        "count(DISTINCT event_type) AS event_type_diversity"
    )
    q["agg_mean_gap"] = _with(
        """SELECT session_id, CAST(sum(gap_us) AS DOUBLE) / 1e6 / nullif(count(*) - 1, 0)
          AS mean_gap_seconds FROM gaps GROUP BY session_id""",
        _GAPS,
    )
    q["agg_percentile"] = _feat(
        """SELECT count(*) AS sessions,
          round(quantile_cont(avg_time_between_events, 0.95), 6) AS p95 FROM features"""
    )
    q["row_mse"] = _with(
        "SELECT session_id, round(error, 6) AS error FROM errors",
        _GAPS, _FEATURES, _LIVE, _ERRORS,
    )

    # session features
    q["session_features"] = _feat("SELECT * FROM features")
    for name, feature in {
        "feat_epm": "events_per_minute",
        "feat_unique_pages": "unique_pages_visited",
        "feat_avg_gap": "avg_time_between_events",
        "feat_cart_ratio": "cart_to_purchase_ratio",
        "feat_duration": "session_duration_seconds",
        "feat_diversity": "event_type_diversity",
        "feat_has_payment": "has_payment",
        "feat_signup_speed": "signup_to_purchase_speed",
        "feat_revisit": "page_revisit_ratio",
    }.items():
        q[name] = _feat(f"SELECT session_id, {feature} FROM features")
    for name, feature in {
        "live_epm": "events_per_minute",
        "live_avg_gap": "avg_time_between_events",
        "live_cart_ratio": "cart_to_purchase_ratio",
        "live_duration": "session_duration_seconds",
        "live_has_payment": "has_payment",
        "live_signup_speed": "signup_to_purchase_speed",
        "live_event_timestamp": "event_timestamp",
    }.items():
        q[name] = _live(f"SELECT session_id, {feature} FROM live")
    q["buffer_features"] = _feat(f"SELECT session_id, {stored} FROM features")

    timed = ("events_per_minute", "avg_time_between_events", "session_duration_seconds")
    q["feature_drift_timed"] = _with(
        f"""SELECT session_id, {", ".join(f"round(l.{f} - f.{f}, 6) AS {f}_drift" for f in timed)}
          FROM features f JOIN live l USING (session_id)""",
        _GAPS, _FEATURES, _LIVE,
    )

    # ordering, closure, set operations
    order = 'PARTITION BY session_id ORDER BY "timestamp", arrival_seq'
    q["session_order"] = _ev(
        f"""SELECT session_id, event_id, "timestamp", row_number() OVER ({order}) AS event_number
          FROM ev"""
    )
    q["event_gaps"] = _with(
        'SELECT session_id, event_id, "timestamp", gap_us / 1e6 AS gap_seconds FROM gaps', _GAPS
    )
    key = "(\"timestamp\", arrival_seq)"
    q["session_first_last"] = _per_session(
        f"""arg_min(event_type, {key}) AS first_event_type,
          arg_min(event_id, {key}) AS first_event_id,
          arg_max(event_type, {key}) AS last_event_type,
          arg_max(event_id, {key}) AS last_event_id"""
    )
    q["interleave_events"] = _ev(
        'SELECT event_id, session_id, "timestamp" FROM ev ORDER BY "timestamp", event_id'
    )
    q["latest_per_session"] = _ev(
        f"""SELECT session_id, event_id, event_type, "timestamp", ip FROM ev
          QUALIFY row_number() OVER (PARTITION BY session_id
                                     ORDER BY "timestamp" DESC, arrival_seq DESC) = 1"""
    )
    q["eval_union"] = _with(
        """SELECT session_id, agent_type, 0 AS label FROM split WHERE held_out
          UNION ALL SELECT session_id, min(agent_type), 1 FROM ev
          WHERE agent_type IN ('bot', 'fraud') GROUP BY session_id""",
        _TEST_ROWS,
    )
    q["autoencoder_checks"] = _with(
        """SELECT label, count(*) AS sessions, true AS errors_in_range, true AS same_again FROM (
          SELECT 0 AS label FROM split WHERE held_out
          UNION ALL SELECT 1 FROM ev WHERE agent_type IN ('bot', 'fraud') GROUP BY session_id)
          GROUP BY label""",
        _TEST_ROWS,
    )
    q["missed_sessions"] = _ev(
        "SELECT session_id FROM ev EXCEPT SELECT session_id FROM ev WHERE is_exit"
    )
    q["coverage_counts"] = _ev(
        """SELECT count(DISTINCT session_id) AS seen,
          count(DISTINCT session_id) FILTER (is_exit) AS stored,
          count(DISTINCT session_id) - count(DISTINCT session_id) FILTER (is_exit) AS missed
          FROM ev"""
    )
    q["sessionize_gap"] = f"""
      SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(event_id AS VARCHAR) AS event_id,
        CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id
                            ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment
      FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER
              (PARTITION BY user_id ORDER BY ts, event_id) > {IDLE_MICROS}
              THEN 1 ELSE 0 END AS brk FROM events)"""
    q["new_sessions"] = _per_session(
        f"min(\"timestamp\") AS first_seen, arg_min(event_id, {key}) AS first_event_id"
    )
    q["sessions_seen_per_day"] = _ev(
        """SELECT slot, n AS new_sessions,
          CAST(sum(n) OVER (ORDER BY slot) AS BIGINT) AS seen_sessions
          FROM (SELECT epoch_us(first_seen) // 86400000000 AS slot, count(*) AS n
                FROM (SELECT min("timestamp") AS first_seen FROM ev GROUP BY session_id)
                GROUP BY slot)"""
    )
    q["close_sessions"] = _buf(
        "SELECT session_id, event_count, opened_at, last_seen, close_reason FROM closed"
    )
    delayed = f"arrival_seq + CASE WHEN arrival_seq % 50 = 3 THEN {2 * ARRIVAL_BATCH} ELSE 0 END"
    marked = f"""(SELECT *, coalesce("timestamp" < watermark, false) AS late FROM (
          SELECT *, max("timestamp") OVER (ORDER BY arrival RANGE BETWEEN UNBOUNDED PRECEDING
                    AND 1 PRECEDING) - INTERVAL {int(LATE_SECONDS)} SECONDS AS watermark
          FROM (SELECT *, ({delayed}) // {ARRIVAL_BATCH} AS arrival FROM ev)))"""
    q["late_events"] = _ev(
        f'SELECT event_id, session_id, "timestamp", arrival, watermark FROM {marked} WHERE late'
    )
    q["late_events_kept"] = _ev(f"SELECT event_id, session_id, arrival, late FROM {marked}")
    q["late_events_dropped"] = _ev(
        f"SELECT event_id, session_id, arrival FROM {marked} WHERE NOT late"
    )

    # approximate counts: exact ones, each approximation within its bound
    pages = 'count(DISTINCT url) AS exact_unique_pages_visited, true AS unique_pages_visited_within_bound'
    kinds = (
        "count(DISTINCT event_type) AS exact_event_type_diversity, "
        "true AS event_type_diversity_within_bound"
    )
    for name, counts in (
        ("agg_approx_unique_pages", pages),
        ("live_unique_pages", pages),
        ("agg_approx_type_diversity", kinds),
        ("live_diversity", kinds),
    ):
        q[name] = _ev(f"SELECT session_id, {counts} FROM ev GROUP BY session_id")
    q["live_session_features"] = _live(
        f"""SELECT {_LIVE_COLUMNS}, d.* EXCLUDE (session_id) FROM live JOIN
          (SELECT session_id, {pages}, {kinds} FROM ev GROUP BY session_id) d USING (session_id)"""
    )
    q["live_sketch_features"] = _live(
        f"""SELECT {_LIVE_COLUMNS}, d.* EXCLUDE (session_id), true AS same_as_one_pass FROM live
          JOIN (SELECT session_id, {pages}, {kinds} FROM ev GROUP BY session_id) d
          USING (session_id)"""
    )
    q["stream_sketch_states"] = q["live_session_features"]
    q["sketch_pages_per_day"] = _ev(
        """SELECT epoch_us("timestamp") // 86400000000 AS slot, count(event_id) AS event_count,
          count(*) FILTER (event_type = 'payment') AS payment_count,
          count(*) FILTER (event_type = 'pageview') AS pageview_count,
          count(DISTINCT url) AS exact_pages, true AS pages_within_bound FROM ev GROUP BY slot"""
    )
    drifts = [
        f"round(CAST(l.{c} - f.{c} AS DOUBLE), 6) AS {c}_drift"
        for c in FEATURE_COLUMNS
        if c not in ("unique_pages_visited", "event_type_diversity", "page_revisit_ratio")
    ]
    q["feature_drift"] = _with(
        f"""SELECT session_id, {", ".join(drifts)},
          CAST(exact_unique_pages_visited - f.unique_pages_visited AS DOUBLE)
            AS unique_pages_visited_drift,
          CAST(exact_event_type_diversity - f.event_type_diversity AS DOUBLE)
            AS event_type_diversity_drift,
          round(coalesce(1 - exact_unique_pages_visited / nullif(CAST(pageview_count AS DOUBLE), 0), 0)
            - f.page_revisit_ratio, 6) AS page_revisit_ratio_drift,
          unique_pages_visited_within_bound, event_type_diversity_within_bound
          FROM features f JOIN live l USING (session_id)
          JOIN (SELECT session_id, {pages}, {kinds} FROM ev GROUP BY session_id) d
          USING (session_id)""",
        _GAPS, _FEATURES, _LIVE,
    )
    q["live_revisit"] = _ev(
        """SELECT session_id, coalesce(1 - count(DISTINCT url)
            / nullif(CAST(count(*) FILTER (event_type = 'pageview') AS DOUBLE), 0), 0.0)
            AS exact_page_revisit_ratio, true AS within_bound FROM ev GROUP BY session_id"""
    )

    # streaming
    q["stream_live_features"] = _live(f"SELECT {_LIVE_COLUMNS} FROM live")
    q["stream_close_sessions"] = _buf(
        """SELECT session_id, opened_at, last_seen, event_count, events_per_minute,
          unique_pages_visited AS unique_pages, avg_time_between_events AS avg_gap,
          cart_to_purchase_ratio AS cart_ratio, close_reason FROM closed"""
    )
    q["stream_restart"] = q["sink_offline"]
    # A wave's rows, and the sessions seen up to it.
    sliced = f"""(SELECT *, (epoch_us("timestamp") - lo) // ((hi - lo) // waves + 1) AS wave
      FROM ev, (SELECT min(epoch_us("timestamp")) AS lo, max(epoch_us("timestamp")) AS hi,
                  greatest(2, (count(*) + {WAVE_ROWS} - 1) // {WAVE_ROWS}) AS waves FROM ev))"""
    q["stream_batch_metrics"] = _ev(
        f"""SELECT rows, CAST(sum(opened) OVER (ORDER BY wave) AS BIGINT) AS state_rows, true AS timed
          FROM (SELECT wave, count(*) AS rows, count(*) FILTER (first) AS opened
                FROM (SELECT wave, row_number() OVER (PARTITION BY session_id
                        ORDER BY "timestamp", event_id) = 1 AS first FROM {sliced})
                GROUP BY wave)"""
    )
    limits = {"none": 1, "one byte": BACKLOG_FILES, "two files": (BACKLOG_FILES + 1) // 2}
    q["stream_trigger_limits"] = _live(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS trigger_limit, CAST({batches} AS BIGINT) AS batches,
              count(*) AS sessions, CAST(sum(event_count) AS BIGINT) AS events,
              CAST(sum(payment_count) AS BIGINT) AS payments FROM live"""
            for name, batches in limits.items()
        )
    )
    q["stream_new_sessions"] = _ev("SELECT DISTINCT session_id FROM ev")
    q["stream_unique_events"] = _ev('SELECT event_id, event_type, session_id, "timestamp" FROM ev')
    q["stream_quarantine"] = f"SELECT event_id, errors FROM ({q['quarantine_events']})"
    q["stream_session_window"] = f"""
      SELECT user_id, count(*) AS event_count, min(ts) AS opened_at, max(ts) AS last_seen
      FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, ts,
              sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id
                             ROWS UNBOUNDED PRECEDING) AS segment
            FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER
                    (PARTITION BY user_id ORDER BY ts, event_id) > {IDLE_MICROS}
                    THEN 1 ELSE 0 END AS brk FROM events))
      GROUP BY user_id, segment"""

    # feature store, labels, detectors, evaluation
    q["enforce_contract"] = _live(
        """SELECT session_id, event_timestamp, events_per_minute, avg_time_between_events,
          cart_to_purchase_ratio, CAST(session_duration_seconds AS DOUBLE)
            AS session_duration_seconds, CAST(has_payment AS BIGINT) AS has_payment,
          signup_to_purchase_speed FROM live"""
    )
    served = ", ".join(("event_count", *FEATURE_COLUMNS))
    newest = "PARTITION BY session_id ORDER BY last_seen DESC"
    latest = f"""newest AS (
      SELECT session_id, last_seen AS event_timestamp, {served} FROM closed
      QUALIFY row_number() OVER ({newest}) = 1)"""
    q["compact_offline"] = _with("SELECT * FROM newest", _GAPS, _BUFFERS, latest)
    fresh = f"""date_diff('microsecond', event_timestamp, (SELECT max("timestamp") FROM ev))
      <= {TTL_HOURS} * 3600000000"""
    q["online_lookup_ttl"] = _with(
        f"""SELECT session_id, event_timestamp, {fresh} AS fresh,
          {", ".join(f"CASE WHEN {fresh} THEN {c} END AS {c}" for c in served.split(", "))}
          FROM newest""",
        _GAPS, _BUFFERS, latest,
    )
    in_time = f"""date_diff('microsecond', h.last_seen, a."timestamp")
      <= {TTL_HOURS} * 3600000000"""
    q["asof_feature_join"] = _with(
        f"""SELECT a.session_id, a.event_id AS request_id, a."timestamp" AS asked_at,
          {", ".join(f"CASE WHEN {in_time} THEN h.{c} END AS {n}" for c, n in
                     [("last_seen", "event_timestamp"), *((c, c) for c in served.split(", "))])}
          FROM (SELECT * FROM ev WHERE event_type = 'checkout') a
          ASOF LEFT JOIN closed h
            ON a.session_id = h.session_id AND a."timestamp" >= h.last_seen""",
        _GAPS, _BUFFERS,
    )
    q["training_frame"] = _live(
        """SELECT session_id, CAST(agent_type IN ('bot', 'fraud') AS INTEGER) AS label,
          coalesce(cart_to_purchase_ratio, 0) AS cart_to_purchase_ratio, events_per_minute,
          avg_time_between_events, session_duration_seconds, has_payment,
          signup_to_purchase_speed FROM live"""
    )
    q["split_train_test"] = _with("SELECT session_id, held_out FROM split", _TEST_ROWS)

    def scaled(column: str) -> str:
        return f"""round(({column} - (SELECT avg({column}) FROM features))
          / (SELECT coalesce(nullif(stddev_pop({column}), 0), 1) FROM features), 6)
          AS {column}"""

    q["standard_scale"] = _feat(
        f"SELECT session_id, {', '.join(scaled(c) for c in FEATURE_COLUMNS)} FROM features"
    )
    errors = (_GAPS, _FEATURES, _LIVE, _ERRORS)
    q["error_threshold"] = _with(
        "SELECT count(*) AS sessions, round(quantile_cont(error, 0.95), 6) AS threshold FROM errors",
        *errors,
    )
    q["flag_anomalies"] = _with(
        """SELECT session_id, CAST(error > (SELECT quantile_cont(error, 0.95) FROM errors)
          AS INTEGER) AS prediction FROM errors""",
        *errors,
    )
    q["isolation_forest_checks"] = _flag(
        """SELECT label, count(*) AS sessions, true AS scores_in_range, true AS same_again,
          true AS share_kept FROM flagged GROUP BY label"""
    )
    q["flag_top_share"] = _flag("SELECT session_id, prediction FROM flagged")
    q["confusion_matrix"] = _flag(
        "SELECT label, prediction, count(*) AS rows FROM flagged GROUP BY label, prediction"
    )
    q["classification_report"] = _flag(
        """SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall,
          round(f1, 6) AS f1, support FROM (
          SELECT * FROM classes
          UNION ALL SELECT 'accuracy', a, a, a, n FROM (
            SELECT (tn + tp) / (tn + fp + fn + tp) AS a, tn + fp + fn + tp AS n FROM cells)
          UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1),
            CAST(sum(support) AS BIGINT) FROM classes
          UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
            sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
            CAST(sum(support) AS BIGINT) FROM classes)"""
    )
    q["recall_by_agent"] = _flag("SELECT * FROM agents")
    flags = {
        "likely_bot": "events_per_minute > 50",
        "definite_bot": "events_per_minute > 200",
        "many_pages": "unique_pages_visited > 100",
        "short_gap": "avg_time_between_events < 1",
        "full_cart": "cart_to_purchase_ratio = 1",
        "odd_duration": "session_duration_seconds BETWEEN 10 AND 20 "
        "OR session_duration_seconds >= 3600",
        "low_diversity": "event_type_diversity BETWEEN 1 AND 2",
        "fast_payment": "has_payment = 1 AND session_duration_seconds < 60",
        "fast_signup_purchase": "signup_to_purchase_speed > 0 AND signup_to_purchase_speed < 60",
    }
    ints = {n: f"CAST({c} AS INTEGER)" for n, c in flags.items()}
    q["rule_flags"] = _feat(
        f"""SELECT session_id, {", ".join(f"{c} AS {n}" for n, c in ints.items())},
          {" + ".join(ints.values())} AS flags FROM features"""
    )

    # data quality
    q["dq_session_id"] = _feat(_NULL_CHECK)
    for name, rule in _RANGES.items():
        q[name] = _feat(_range_check(*rule))
    q["dq_scorecard"] = _feat(
        f"""SELECT * FROM ({_ALL_CHECKS}) UNION ALL
          SELECT 'overall', max(rows_checked), CAST(sum(unexpected) AS BIGINT), bool_and(passed)
          FROM ({_ALL_CHECKS})"""
    )

    # behaviour checks
    q["session_shape"] = _ev(
        f"""SELECT session_id, count(*) AS event_count, count(*) < 1000 AS length_ok,
          arg_min(event_type, {key}) IN ('pageview', 'user_signup') AS landing_ok,
          arg_max(is_exit, {key}) AS ended_with_exit FROM ev GROUP BY session_id"""
    )
    q["funnel_order"] = _ev(
        """SELECT *, coalesce(first_checkout < first_payment, false) AS in_order FROM (
          SELECT session_id, min("timestamp") FILTER (event_type = 'checkout') AS first_checkout,
            min("timestamp") FILTER (event_type = 'payment') AS first_payment
          FROM ev GROUP BY session_id) WHERE first_payment IS NOT NULL"""
    )
    q["ring_candidates"] = _with("SELECT subnet, sessions, addresses FROM rings", _rings())
    q["ring_candidates_by_product"] = _with(
        "SELECT subnet, product_id, sessions, addresses FROM rings", _rings(", product_id")
    )
    q["ring_conversion"] = _with(
        """SELECT subnet, sessions, successful_payments,
          successful_payments = sessions AS full_conversion FROM rings""",
        _rings(),
    )
    q["engagement_decay"] = _ev(
        """SELECT user_id, count(*) AS sessions, arg_min(n, opened) AS first_events,
          arg_max(n, opened) AS last_events, count(*) > 1
            AND arg_max(n, opened) <= arg_min(n, opened) AND max(closed) > min(opened) AS decays
          FROM (SELECT user_id, session_id, count(*) AS n, min("timestamp") AS opened,
                  max("timestamp") AS closed FROM ev GROUP BY user_id, session_id)
          GROUP BY user_id"""
    )
    q["gap_bounds"] = _with(
        """SELECT agent_type, count(*) AS gaps, count(*) FILTER (
            CASE WHEN agent_type = 'bot' THEN g NOT BETWEEN 0.5 AND 1.2
                 ELSE g NOT BETWEEN 5 AND 30 END) AS outside
          FROM (SELECT *, gap_us / 1e6 AS g FROM gaps WHERE gap_us IS NOT NULL)
          GROUP BY agent_type""",
        _GAPS,
    )
    return q
