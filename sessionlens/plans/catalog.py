"""Every operator as a named query over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlens.functions.expressions import exact_seconds, ip_subnet, is_exit, whole_seconds
from sessionlens.ml import evaluate, frame
from sessionlens.ml.quantile import exact_quantile
from sessionlens.ml.scaler import StandardScaler
from sessionlens.operators import (
    aggregates,
    checks,
    decode,
    features,
    live,
    quality,
    rules,
    sessions,
    sketches,
    store,
    validate,
)
from sessionlens.plans import pipeline
from sessionlens.schema import ENVELOPE, FEATURE_COLUMNS
from sessionlens.session import configure, fresh_dir
from sessionlens.sources import driver_tables as tables
from sessionlens.sources import offline, topic
from sessionlens.streaming import closer, jobs, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters that fit the test tables, whose sessions last days, not minutes.
IDLE_SECONDS = 12 * 3600
MAX_EVENTS = 6
LATE_SECONDS = 3600.0
ARRIVAL_BATCH = 500
TTL_HOURS = 48
BACKLOG_FILES = 4
TRIGGER_LIMITS = {
    "none": {},
    "one byte": {"bytes_per_trigger": 1},
    "two files": {"files_per_trigger": 2},
}
SCORE = "events_per_minute"
SHARE = 0.2


def _plain_times(df: DataFrame) -> DataFrame:
    """Show instants as UTC wall-clock times, whatever the reader's zone."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _register(name: str, build: Query) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return _plain_times(build(spark, sf_dir))

    QUERIES[name] = run


def query(build: Query) -> Query:
    """Register a function under its own name."""
    _register(build.__name__, build)
    return build


_events = tables.session_events


# --- sources, sinks, connectors -------------------------------------------------


@query
def src_event_stream(spark, sf_dir):
    out = fresh_dir(spark, "decoded")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    pipeline.drain_in_waves(
        tables.raw_topic(spark, sf_dir, faults=False), jobs.events_from, write, "append"
    )
    read = spark.read.parquet(out)
    return read.select("event_id", "event_type", "timestamp", "session_id", "user_id")


@query
def decode_events(spark, sf_dir):
    raw = tables.raw_topic(spark, sf_dir, faults=False)
    return decode.flatten_properties(decode.decode_events(raw))


@query
def scan_offline(spark, sf_dir):
    path = fresh_dir(spark, "history")
    offline.append_batch(features.feature_rows(_events(spark, sf_dir)), path, "r0", 0)
    rows = offline.scan_offline(spark, path)
    return rows.select("session_id", "event_timestamp", "agent_type", *FEATURE_COLUMNS)


_LIVE_EXACT = (
    "session_id",
    "event_count",
    "session_start",
    "session_end",
    "payment_count",
    "cart_count",
    "signup_time",
    "purchase_time",
    "pageview_count",
    "agent_type",
    "session_duration_seconds",
    "events_per_minute",
    "avg_time_between_events",
    "cart_to_purchase_ratio",
    "has_payment",
    "signup_to_purchase_speed",
    "event_timestamp",
)


def _drain_live(spark, sf_dir, writer):
    pipeline.drain_in_waves(
        tables.raw_topic(spark, sf_dir, faults=False),
        jobs.stream_live_features,
        writer,
        "update",
    )


@query
def sink_offline(spark, sf_dir):
    path = fresh_dir(spark, "history")
    _drain_live(spark, sf_dir, sinks.offline_sink(path, "r0"))
    # Every snapshot of every micro-batch, in which the history differs from the log.
    return offline.scan_offline(spark, path).select(
        "session_id", "event_timestamp", "event_count", "payment_count", "pageview_count"
    )


def _dates_of(rows):
    """A date for each folder of a history; few, whatever the rows."""
    return [r[0] for r in rows.select("event_date").distinct().where("event_date is not null").collect()]


_SNAPSHOT = ("session_id", "event_timestamp", "event_count", "payment_count", "pageview_count")


@query
def compact_history(spark, sf_dir):
    """The history after its batches were merged, a merged batch was replayed, and old parts went."""
    path = fresh_dir(spark, "history")
    batches = []

    def write(batch, batch_id):
        sinks.offline_sink(path, "r0")(batch, batch_id)
        batches.append(batch_id)

    _drain_live(spark, sf_dir, write)
    dates = _dates_of(offline.scan_offline(spark, path))
    replayed = offline.scan_offline(spark, path).where(F.col("batch_id") == batches[0])
    kept = pipeline.stored(replayed.drop("run", "batch_id", "event_date"))
    offline.compact_history(spark, path, dates, ended=["r0"])
    offline.append_batch(kept, path, "r0", batches[0])
    offline.vacuum_history(spark, path, dates)
    return offline.scan_offline(spark, path).select(*_SNAPSHOT)


@query
def read_history_date(spark, sf_dir):
    """Rows of the newest event date, from the folders of that date alone."""
    path = fresh_dir(spark, "history")
    _drain_live(spark, sf_dir, sinks.offline_sink(path, "r0"))
    newest = max(_dates_of(offline.scan_offline(spark, path)), default=None)
    return offline.scan_offline(spark, path, dates=[newest] if newest else []).select(*_SNAPSHOT)


@query
def sink_online_latest(spark, sf_dir):
    path = fresh_dir(spark, "online")
    _drain_live(spark, sf_dir, sinks.online_sink(path, "r0"))
    return sinks.read_online(spark, path).select(
        "session_id", "event_timestamp", "event_count", "payment_count", "agent_type"
    )


@query
def features_to_kv_json(spark, sf_dir):
    stored = features.buffer_features(_events(spark, sf_dir))
    columns = [c for c in stored.columns if c != "session_id"]
    kv = decode.features_to_kv_json(stored, columns)
    schema = (
        "events_per_minute double, unique_pages double, avg_gap double, "
        "cart_ratio double, event_count long"
    )
    return kv.select("key", F.from_json("value", schema).alias("v")).select("key", "v.*")


@query
def sink_fanout(spark, sf_dir):
    off, on, log = (fresh_dir(spark, n) for n in ("history", "online", "log"))
    _drain_live(spark, sf_dir, sinks.fan_out(off, on, log, "r0"))
    logged = spark.read.parquet(log).agg(F.sum("rows").alias("logged_rows"))
    counts = offline.scan_offline(spark, off).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("session_id").alias("sessions")
    )
    keys = sinks.read_online(spark, on).agg(F.count(F.lit(1)).alias("keys"))
    return counts.select(
        (F.col("rows") == logged.scalar()).alias("log_matches"),
        "sessions",
        keys.scalar().alias("online_keys"),
    )


@query
def publish_events(spark, sf_dir):
    events = tables.full_events(spark, sf_dir)
    messages = decode.publish_events(events)
    value = F.col("value")
    plain = [f for f in events.schema.fields if f.name != "properties"]
    return messages.select(
        "key",
        *[F.get_json_object(value, f"$.{f.name}").cast(f.dataType).alias(f.name) for f in plain],
        F.get_json_object(value, "$.properties.ip").alias("ip"),
        F.get_json_object(value, "$.properties.agent_type").alias("agent_type"),
    )


@query
def tap_pageviews(spark, sf_dir):
    return decode.tap_pageviews(tables.user_events(spark, sf_dir))


@query
def drop_tombstones(spark, sf_dir):
    return decode.drop_tombstones(tables.raw_topic(spark, sf_dir)).select("key", "seq")


def _predictions(spark, sf_dir):
    rows = pipeline.stored(
        frame.training_frame(features.feature_rows(_events(spark, sf_dir)))
    )
    return evaluate.flag_top_share(rows, SCORE, SHARE)


@query
def log_run(spark, sf_dir):
    path = fresh_dir(spark, "runs")
    flagged = _predictions(spark, sf_dir)
    rows = evaluate.run_rows(
        spark,
        "baseline",
        {"model": "top share", "n_features": len(FEATURE_COLUMNS)},
        evaluate.classification_report(flagged),
        evaluate.recall_by_agent(flagged),
    )
    evaluate.log_run(rows, path)
    logged = spark.read.parquet(path).where(F.col("kind") == "metric")
    return logged.select(
        "run", "key", F.round(F.col("value").cast("double"), 6).alias("value")
    )


# --- event typing and validation ------------------------------------------------


@query
def event_envelope(spark, sf_dir):
    return decode.flatten_properties(tables.envelope_events(spark, sf_dir).to(ENVELOPE))


@query
def apply_event_defaults(spark, sf_dir):
    events = tables.full_events(spark, sf_dir)
    sparse = events.withColumns(
        {
            "url": F.nullif(F.col("url"), F.lit("/p/0")),
            "quantity": F.nullif(F.col("quantity"), F.lit(2)),
            "method": F.lit(None).cast("string"),
        }
    )
    filled = decode.apply_event_defaults(sparse)
    return filled.select("event_id", "event_type", "url", "quantity", "method")


def _checked(spark, sf_dir):
    return decode.decode_checked(tables.raw_topic(spark, sf_dir), keep=("seq",))


@query
def dispatch_by_type(spark, sf_dir):
    routed = validate.dispatch_by_type(_checked(spark, sf_dir))
    return routed.select(
        "event_id",
        "route",
        F.col("pageview.url").alias("page_url"),
        F.col("search.query").alias("search_query"),
        F.col("add_to_cart.product_id").alias("cart_product"),
        F.col("add_to_cart.quantity").alias("cart_quantity"),
        F.col("checkout.cart_total").alias("checkout_total"),
        F.col("checkout.item_count").alias("checkout_items"),
        F.col("payment.amount").alias("payment_amount"),
        F.col("payment.status").alias("payment_status"),
        F.col("user_signup.email").alias("signup_email"),
        F.col("click.element_id").alias("click_element"),
        F.col("product_view.product_id").alias("viewed_product"),
        F.col("product_view.price").alias("viewed_price"),
    )


@query
def validate_events(spark, sf_dir):
    checked = validate.validate_events(_checked(spark, sf_dir))
    return checked.select(
        "seq", F.size("errors").alias("n_errors"), F.concat_ws(", ", "errors").alias("errors")
    )


@query
def quarantine_events(spark, sf_dir):
    bad = validate.quarantine_events(_checked(spark, sf_dir))
    return bad.select("seq", "event_id", F.concat_ws(", ", "errors").alias("errors"))


@query
def event_roundtrip(spark, sf_dir):
    return decode.event_roundtrip(tables.full_events(spark, sf_dir))


@query
def corrupt_events(spark, sf_dir):
    return decode.corrupt_events(tables.raw_topic(spark, sf_dir), keep=("seq",))


@query
def duplicate_event_ids(spark, sf_dir):
    events = tables.user_events(spark, sf_dir)
    redelivered = events.where(F.col("event_type") == "payment")
    return validate.duplicate_event_ids(events.unionByName(redelivered))


# --- projections, filters, scalar expressions -----------------------------------


@query
def flatten_struct(spark, sf_dir):
    flat = decode.flatten_properties(tables.envelope_events(spark, sf_dir))
    return flat.select("event_id", "session_id", "ip", "agent_type")


def _profile(spark, sf_dir, *wanted):
    return aggregates.session_profile(_events(spark, sf_dir), wanted)


def _labelled(spark, sf_dir):
    return frame.label_agents(_profile(spark, sf_dir, "event_count", "agent_type"))


@query
def label_agents(spark, sf_dir):
    return _labelled(spark, sf_dir).select("session_id", "agent_type", "label")


@query
def exit_events(spark, sf_dir):
    return _events(spark, sf_dir).where(is_exit()).select("event_id", "session_id", "url")


@query
def split_normal_anomaly(spark, sf_dir):
    normal, anomalies = frame.split_normal_anomaly(_labelled(spark, sf_dir))
    return normal.select("session_id", F.lit("normal").alias("part")).unionByName(
        anomalies.select("session_id", F.lit("anomaly").alias("part"))
    )


def _bounds(spark, sf_dir):
    return _profile(spark, sf_dir, "session_start", "session_end")


@query
def duration_whole_seconds(spark, sf_dir):
    seconds = whole_seconds(F.col("session_start"), F.col("session_end"))
    return _bounds(spark, sf_dir).select("session_id", seconds.alias("seconds"))


@query
def duration_exact_seconds(spark, sf_dir):
    seconds = exact_seconds(F.col("session_start"), F.col("session_end"))
    return _bounds(spark, sf_dir).select("session_id", seconds.alias("seconds"))


def _live(spark, sf_dir):
    return live.live_session_features(_events(spark, sf_dir))


@query
def fill_features(spark, sf_dir):
    return frame.fill_features(_live(spark, sf_dir)).select(
        "session_id", "cart_to_purchase_ratio", "signup_to_purchase_speed"
    )


@query
def ip_subnet_of(spark, sf_dir):
    events = tables.user_events(spark, sf_dir)
    return events.select("event_id", "ip", ip_subnet(F.col("ip")).alias("subnet"))


QUERIES["ip_subnet"] = QUERIES.pop("ip_subnet_of")


# --- aggregates -----------------------------------------------------------------


def _profile_query(name: str, *wanted: str) -> None:
    _register(name, lambda spark, sf_dir: _profile(spark, sf_dir, *wanted))


_profile_query("agg_event_count", "event_count")
_profile_query("agg_session_bounds", "session_start", "session_end")
_profile_query("agg_payment_count", "payment_count")
_profile_query("agg_cart_count", "cart_count")
_profile_query("agg_pageview_count", "pageview_count")
_profile_query("agg_signup_time", "signup_time")
_profile_query("agg_purchase_time", "purchase_time")
_profile_query("agg_exact_unique_pages", "unique_pages")
_profile_query("agg_agent_type", "agent_type")
_profile_query("agg_success_counts", "success_count", "cart_count")


@query
def agg_exact_type_diversity(spark, sf_dir):
    return _profile(spark, sf_dir, "type_bits").select(
        "session_id", aggregates.event_type_diversity().alias("event_type_diversity")
    )


# Four standard errors of an approximate distinct count, and one for the rounding.
BOUND_SHARE, BOUND_LEAST = 0.2, 1


def _bounded(approximate, events, name, counted):
    """Rows of approximate counts, the exact ones and whether they are within the bound."""
    exact = events.groupBy("session_id").agg(F.count_distinct(counted).alias(f"exact_{name}"))
    bound = BOUND_SHARE * F.col(f"exact_{name}") + BOUND_LEAST
    return approximate.join(exact, "session_id").withColumn(
        f"{name}_within_bound", F.abs(F.col(name) - F.col(f"exact_{name}")) <= bound
    )


def _approximate_query(name: str, column: str, counted: str, build: Callable) -> None:
    """Register exact counts with a flag: the approximate ones have no twin."""

    def run(spark, sf_dir):
        events = _events(spark, sf_dir)
        rows = _bounded(build(events), events, column, counted)
        return rows.select("session_id", f"exact_{column}", f"{column}_within_bound")

    _register(name, run)


for _name, _column, _counted, _build in (
    ("agg_approx_unique_pages", "unique_pages_visited", "url", aggregates.approx_unique_pages),
    (
        "agg_approx_type_diversity",
        "event_type_diversity",
        "event_type",
        aggregates.approx_type_diversity,
    ),
    ("live_unique_pages", "unique_pages_visited", "url", live.live_session_features),
    ("live_diversity", "event_type_diversity", "event_type", live.live_session_features),
):
    _approximate_query(_name, _column, _counted, _build)


@query
def agg_mean_gap(spark, sf_dir):
    return aggregates.mean_gap(_events(spark, sf_dir))


@query
def agg_percentile(spark, sf_dir):
    rows = pipeline.stored(
        features.session_features(_events(spark, sf_dir), ["avg_time_between_events"])
    )
    value = exact_quantile(rows, "avg_time_between_events", 0.95)
    counted = rows.agg(F.count("avg_time_between_events").alias("sessions"))
    return counted.withColumn("p95", F.round(F.lit(value), 6))


_COMPARED = ("session_duration_seconds", "cart_to_purchase_ratio", "has_payment")


def _error_rows(spark, sf_dir):
    """Squared distance of exact and live values: a repeatable score per session."""
    events = _events(spark, sf_dir)
    exact = features.session_features(
        events, _COMPARED, keep=("agent_type",)
    ).select(
        "session_id",
        "agent_type",
        F.array(*[F.col(c).cast("double") for c in _COMPARED]).alias("exact"),
    )
    lived = frame.fill_features(live.live_session_features(events)).select(
        "session_id", F.array(*[F.col(c).cast("double") for c in _COMPARED]).alias("live")
    )
    return aggregates.row_mse(exact.join(lived, "session_id"), "exact", "live")


@query
def row_mse(spark, sf_dir):
    return _error_rows(spark, sf_dir).select("session_id", F.round("error", 6).alias("error"))


# --- session features -----------------------------------------------------------


@query
def session_features(spark, sf_dir):
    return features.feature_rows(_events(spark, sf_dir), arrival="arrival_seq")


@query
def live_session_features(spark, sf_dir):
    events = _events(spark, sf_dir)
    rows = live.live_session_features(events)
    for column, counted in (("unique_pages_visited", "url"), ("event_type_diversity", "event_type")):
        rows = _bounded(rows, events, column, counted)
    return rows.select(
        *_LIVE_EXACT,
        *[
            f"{p}{s}"
            for c in ("unique_pages_visited", "event_type_diversity")
            for p, s in (("exact_", c), (c, "_within_bound"))
        ],
    )


def _with_bounds(rows, events):
    """Live rows with exact distinct counts and flags in place of the approximate ones."""
    for column, counted in (("unique_pages_visited", "url"), ("event_type_diversity", "event_type")):
        rows = _bounded(rows, events, column, counted)
    flags = [
        f"{p}{s}"
        for c in ("unique_pages_visited", "event_type_diversity")
        for p, s in (("exact_", c), (c, "_within_bound"))
    ]
    return rows.select(*_LIVE_EXACT, *flags, *[c for c in rows.columns if c.startswith("same_")])


@query
def live_sketch_features(spark, sf_dir):
    """Live features merged from the states of four waves, against those of a single pass."""
    events = _events(spark, sf_dir)
    wave = F.pmod(F.xxhash64("event_id"), F.lit(4))
    waves = sketches.event_states(events.withColumn("wave", wave), ["session_id", "wave"])
    merged = sketches.sketch_features(waves)
    once = sketches.sketch_features(sketches.event_states(events)).select(
        "session_id", *[F.col(c).alias(f"once_{c}") for c in sketches.SKETCHES]
    )
    same = reduce(
        lambda a, b: a & b, [F.col(c) == F.col(f"once_{c}") for c in sketches.SKETCHES]
    )
    joined = merged.join(once, "session_id").withColumn("same_as_one_pass", same)
    return _with_bounds(joined, events)


@query
def sketch_pages_per_day(spark, sf_dir):
    """Distinct urls of a day over all sessions, from the states of its sessions."""
    events = _events(spark, sf_dir).withColumn("slot", _day_number())
    states = sketches.event_states(events, ["session_id", "slot"])
    days = sketches.state_aggregates(states, ["slot"])
    exact = events.groupBy("slot").agg(F.count_distinct("url").alias("exact_pages"))
    bound = BOUND_SHARE * F.col("exact_pages") + BOUND_LEAST
    within = F.abs(F.col("unique_pages_visited") - F.col("exact_pages")) <= bound
    return days.join(exact, "slot").select(
        "slot",
        "event_count",
        "payment_count",
        "pageview_count",
        "exact_pages",
        within.alias("pages_within_bound"),
    )


def _day_number():
    return F.call_function("div", F.unix_micros("timestamp"), F.lit(86_400_000_000))


@query
def live_revisit(spark, sf_dir):
    """The ratio from exact counts, and whether the live one is what its counts allow."""
    events = _events(spark, sf_dir)
    rows = _bounded(live.live_session_features(events), events, "unique_pages_visited", "url")
    views = F.nullif(F.col("pageview_count"), F.lit(0))
    exact = F.coalesce(1 - F.col("exact_unique_pages_visited") / views, F.lit(0.0))
    allowed = (BOUND_SHARE * F.col("exact_unique_pages_visited") + BOUND_LEAST) / views
    near = F.abs(F.col("page_revisit_ratio") - exact) <= F.coalesce(allowed, F.lit(0.0)) + 1e-9
    return rows.select(
        "session_id", exact.alias("exact_page_revisit_ratio"), near.alias("within_bound")
    )


def _feature_query(name: str, feature: str) -> None:
    _register(
        name,
        lambda spark, sf_dir: features.session_features(
            _events(spark, sf_dir), [feature], arrival="arrival_seq"
        ),
    )


for _name, _feature in {
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
    _feature_query(_name, _feature)


def _live_query(name: str, feature: str) -> None:
    _register(name, lambda spark, sf_dir: _live(spark, sf_dir).select("session_id", feature))


for _name, _feature in {
    "live_epm": "events_per_minute",
    "live_avg_gap": "avg_time_between_events",
    "live_cart_ratio": "cart_to_purchase_ratio",
    "live_duration": "session_duration_seconds",
    "live_has_payment": "has_payment",
    "live_signup_speed": "signup_to_purchase_speed",
    "live_event_timestamp": "event_timestamp",
}.items():
    _live_query(_name, _feature)


@query
def buffer_features(spark, sf_dir):
    return features.buffer_features(_events(spark, sf_dir))


@query
def feature_drift(spark, sf_dir):
    """Drift of all features; where the live one rests on an approximate distinct count, the
    drift that the exact count would give, and whether the approximation is within its bound.
    """
    events = _events(spark, sf_dir)
    exact = features.session_features(events)
    rows = live.live_session_features(events)
    for column, counted in (("unique_pages_visited", "url"), ("event_type_diversity", "event_type")):
        rows = _bounded(rows, events, column, counted)
    counted_rows = rows.withColumns(
        {
            "unique_pages_visited": F.col("exact_unique_pages_visited"),
            "event_type_diversity": F.col("exact_event_type_diversity"),
            "page_revisit_ratio": F.coalesce(
                1 - F.try_divide("exact_unique_pages_visited", "pageview_count"), F.lit(0.0)
            ),
        }
    )
    flags = rows.select(
        "session_id", "unique_pages_visited_within_bound", "event_type_diversity_within_bound"
    )
    drift = features.feature_drift(exact, counted_rows)
    return drift.select(
        "session_id", *[F.round(F.col(f"{f}_drift").cast("double"), 6).alias(f"{f}_drift") for f in FEATURE_COLUMNS]
    ).join(flags, "session_id")


@query
def feature_drift_timed(spark, sf_dir):
    """Drift of the features that do not rest on approximate counts."""
    events = _events(spark, sf_dir)
    drift = features.feature_drift(
        features.session_features(events), live.live_session_features(events)
    )
    timed = ("events_per_minute", "avg_time_between_events", "session_duration_seconds")
    return drift.select("session_id", *[F.round(f"{f}_drift", 6).alias(f"{f}_drift") for f in timed])


# --- ordering, closure, set operations ------------------------------------------


@query
def session_order(spark, sf_dir):
    return sessions.session_order(_events(spark, sf_dir))


@query
def event_gaps(spark, sf_dir):
    gaps = sessions.event_gaps(_events(spark, sf_dir))
    return gaps.drop("agent_type")


@query
def session_first_last(spark, sf_dir):
    return sessions.session_first_last(_events(spark, sf_dir))


@query
def interleave_events(spark, sf_dir):
    events = sessions.interleave_events(_events(spark, sf_dir))
    return events.select("event_id", "session_id", "timestamp")


@query
def latest_per_session(spark, sf_dir):
    events = _events(spark, sf_dir).select(
        "session_id", "event_id", "event_type", "timestamp", "ip"
    )
    return store.latest_per_session(events, order=("timestamp", "event_id"))


@query
def eval_union(spark, sf_dir):
    _, evaluation = pipeline.held_out_split(features.feature_rows(_events(spark, sf_dir)))
    return evaluation.select("session_id", "agent_type", "label")


def _exited(spark, sf_dir):
    return _events(spark, sf_dir).where(is_exit())


@query
def missed_sessions(spark, sf_dir):
    return sessions.missed_sessions(_events(spark, sf_dir), _exited(spark, sf_dir))


@query
def coverage_counts(spark, sf_dir):
    return sessions.coverage_counts(_events(spark, sf_dir), _exited(spark, sf_dir))


@query
def sessionize_gap(spark, sf_dir):
    cut = sessions.sessionize_gap(
        tables.user_events(spark, sf_dir), "user_id", gap_seconds=IDLE_SECONDS
    )
    return cut.select("user_id", "event_id", "segment")


@query
def new_sessions(spark, sf_dir):
    return sessions.new_sessions(_events(spark, sf_dir))


@query
def sessions_seen_per_day(spark, sf_dir):
    return sessions.sessions_seen_per_slot(_events(spark, sf_dir), 86400)


@query
def close_sessions(spark, sf_dir):
    closed = sessions.close_sessions(
        _events(spark, sf_dir),
        idle_seconds=IDLE_SECONDS,
        max_events=MAX_EVENTS,
        as_of=tables.user_events(spark, sf_dir).agg(F.max("timestamp")).scalar(),
    )
    return closed.drop("run", "part")


def _late(spark, sf_dir, policy):
    seq = F.col("arrival_seq")
    delayed = seq + F.when(seq % 50 == 3, 2 * ARRIVAL_BATCH).otherwise(0)
    arrived = _events(spark, sf_dir).withColumn(
        "arrival", F.call_function("div", delayed, F.lit(ARRIVAL_BATCH))
    )
    return sessions.late_events(arrived, "arrival", LATE_SECONDS, policy)


@query
def late_events(spark, sf_dir):
    late = _late(spark, sf_dir, "side")
    return late.select("event_id", "session_id", "timestamp", "arrival", "watermark")


@query
def late_events_kept(spark, sf_dir):
    return _late(spark, sf_dir, "keep").select("event_id", "session_id", "arrival", "late")


@query
def late_events_dropped(spark, sf_dir):
    return _late(spark, sf_dir, "drop").select("event_id", "session_id", "arrival")


# --- streaming ------------------------------------------------------------------


@query
def stream_live_features(spark, sf_dir):
    path = fresh_dir(spark, "online")
    _drain_live(spark, sf_dir, sinks.online_sink(path, "r0"))
    return sinks.read_online(spark, path).select(*_LIVE_EXACT)


@query
def stream_close_sessions(spark, sf_dir):
    """Closed in waves, then flushed as at the end of the input."""
    closing = closer.SessionCloser(
        fresh_dir(spark, "closed"), IDLE_SECONDS, MAX_EVENTS, delay_seconds=3600
    )
    pipeline.drain_in_waves(
        tables.raw_topic(spark, sf_dir, faults=False),
        lambda messages: closer.stream_close_sessions(jobs.events_from(messages)),
        closing.write,
        "append",
    )
    closing.flush(spark)
    return closing.closed(spark)


@query
def stream_sketch_states(spark, sf_dir):
    """Live features from a stream without state, every batch of which is lost once."""
    path, compacted = fresh_dir(spark, "states"), fresh_dir(spark, "compacted")
    pipeline.drain_in_waves(
        tables.raw_topic(spark, sf_dir, faults=False),
        jobs.events_from,
        jobs.FailOnce(sinks.state_sink(path, "r0")),
        "append",
        may_fail=True,
    )
    sinks.compact_states(spark, path, compacted, "r1")
    rows = sketches.sketch_features(sinks.read_states(spark, compacted))
    return _with_bounds(rows, _events(spark, sf_dir))


@query
def stream_batch_metrics(spark, sf_dir):
    """Rows and state rows of each micro-batch, as recorded while the live job drained."""
    table = fresh_dir(spark, "metrics")
    pipeline.drain_in_waves(
        tables.raw_topic(spark, sf_dir, faults=False),
        jobs.stream_live_features,
        sinks.online_sink(fresh_dir(spark, "online"), "r0"),
        "update",
        metrics=table,
    )
    recorded = jobs.read_metrics(spark, table).where("rows > 0")
    return recorded.select("rows", "state_rows", (F.col("seconds") > 0).alias("timed"))


@query
def stream_restart(spark, sf_dir):
    """History of the live job when every batch is lost once between write and commit."""
    path = fresh_dir(spark, "history")
    pipeline.drain_in_waves(
        tables.raw_topic(spark, sf_dir, faults=False),
        jobs.stream_live_features,
        jobs.FailOnce(sinks.offline_sink(path, "r0")),
        "update",
        may_fail=True,
    )
    return offline.scan_offline(spark, path).select(
        "session_id", "event_timestamp", "event_count", "payment_count", "pageview_count"
    )


@query
def stream_trigger_limits(spark, sf_dir):
    """One backlog drained under different limits: batches taken, and what came of them."""
    inbox = fresh_dir(spark, "inbox")
    messages = pipeline.staged(tables.raw_topic(spark, sf_dir, faults=False))
    topic.publish_to_files(messages, inbox, BACKLOG_FILES, ["timestamp"])
    drained = []
    for name, limit in TRIGGER_LIMITS.items():
        path, table = fresh_dir(spark, "online"), fresh_dir(spark, "metrics")
        query = jobs.drain(
            jobs.stream_live_features(topic.read_message_files(spark, inbox, **limit)),
            fresh_dir(spark, "checkpoint"),
            sinks.online_sink(path, "r0"),
            stores=jobs.state_stores(spark),
        )
        jobs.record_metrics(query, table)
        batches = jobs.read_metrics(spark, table).where("rows > 0").agg(F.count(F.lit(1)))
        drained.append(
            sinks.read_online(spark, path).agg(
                F.lit(name).alias("trigger_limit"),
                batches.scalar().alias("batches"),
                F.count(F.lit(1)).alias("sessions"),
                F.sum("event_count").alias("events"),
                F.sum("payment_count").alias("payments"),
            )
        )
    return reduce(DataFrame.unionByName, drained)


def _drain_rows(spark, messages, build):
    out = fresh_dir(spark, "drained")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    pipeline.drain_in_waves(messages, build, write, "append")
    return spark.read.parquet(out).drop("batch_id")


@query
def stream_new_sessions(spark, sf_dir):
    messages = tables.raw_topic(spark, sf_dir, faults=False)
    return _drain_rows(spark, messages, jobs.stream_new_sessions).select("session_id")


@query
def stream_unique_events(spark, sf_dir):
    """One message in ten is delivered twice."""
    messages = tables.raw_topic(spark, sf_dir, faults=False)
    redelivered = messages.unionByName(messages.where(F.col("seq") % 10 == 3))
    rows = _drain_rows(spark, redelivered, jobs.stream_unique_events)
    return rows.select("event_id", "event_type", "session_id", "timestamp")


@query
def stream_quarantine(spark, sf_dir):
    rows = _drain_rows(spark, tables.raw_topic(spark, sf_dir), jobs.stream_quarantine)
    return rows.select("event_id", F.concat_ws(", ", "errors").alias("errors"))


@query
def stream_session_window(spark, sf_dir):
    out = fresh_dir(spark, "windows")

    def build(messages):
        return jobs.stream_session_window(
            jobs.events_from(messages), "user_id", f"{IDLE_SECONDS} seconds", "1 hour"
        )

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    pipeline.drain_in_waves(
        tables.raw_topic(spark, sf_dir, faults=False),
        build,
        write,
        "append",
        last=pipeline.end_marker(spark, jobs.END_SESSION, jobs.END_TIME),
    )
    return spark.read.parquet(out).select("user_id", "event_count", "opened_at", "last_seen")


# --- feature store, labels, detectors, evaluation -------------------------------


# Live features that rest on approximate distinct counts.
_APPROXIMATE = {"unique_pages_visited", "event_type_diversity", "page_revisit_ratio"}


@query
def enforce_contract(spark, sf_dir):
    live_rows = _live(spark, sf_dir)
    kept = [c for c in FEATURE_COLUMNS if c not in _APPROXIMATE]
    return store.enforce_contract(live_rows).select("session_id", "event_timestamp", *kept)


def _history(spark, sf_dir):
    return pipeline.closed_history(_events(spark, sf_dir), IDLE_SECONDS, MAX_EVENTS)


_SERVED = ("event_count", *FEATURE_COLUMNS)


@query
def compact_offline(spark, sf_dir):
    return store.compact_offline(_history(spark, sf_dir)).select(
        "session_id", "event_timestamp", *_SERVED
    )


@query
def online_lookup_ttl(spark, sf_dir):
    history = _history(spark, sf_dir).select("session_id", "event_timestamp", *_SERVED)
    now = tables.user_events(spark, sf_dir).agg(F.max("timestamp")).scalar()
    return store.online_lookup_ttl(history, now, timedelta(hours=TTL_HOURS))


@query
def asof_feature_join(spark, sf_dir):
    events = _events(spark, sf_dir)
    requests = events.where(F.col("event_type") == "checkout").select(
        "session_id",
        F.col("event_id").alias("request_id"),
        F.col("timestamp").alias("asked_at"),
    )
    history = pipeline.stored(_history(spark, sf_dir))
    return store.asof_feature_join(
        requests,
        history,
        list(_SERVED),
        ttl=timedelta(hours=TTL_HOURS),
    )


@query
def training_frame(spark, sf_dir):
    rows = frame.training_frame(_live(spark, sf_dir))
    return rows.select("session_id", "label", *[c for c in FEATURE_COLUMNS if c not in _APPROXIMATE])


@query
def split_train_test(spark, sf_dir):
    rows = pipeline.stored(_labelled(spark, sf_dir).where(F.col("label") == 0))
    return frame.split_train_test(rows).select("session_id", "held_out")


@query
def standard_scale(spark, sf_dir):
    columns = list(FEATURE_COLUMNS)
    rows = pipeline.stored(features.session_features(_events(spark, sf_dir), columns))
    scaled = StandardScaler.fit(rows, columns).transform(rows)
    return scaled.select("session_id", *[F.round(c, 6).alias(c) for c in columns])


@query
def isolation_forest_score(spark, sf_dir):
    flagged = pipeline.isolation_forest_run(features.feature_rows(_events(spark, sf_dir)))
    return flagged.select("session_id", "agent_type", "label", "score", "prediction")


@query
def isolation_forest_checks(spark, sf_dir):
    """By label: sessions scored, scores inside (0, 1), and as many flagged as the share allows,
    the same in a second run.
    """
    rows = features.feature_rows(_events(spark, sf_dir))
    first = pipeline.isolation_forest_run(rows)
    again = pipeline.isolation_forest_run(rows).select(
        "session_id", F.col("score").alias("score_again"), F.col("prediction").alias("flag_again")
    )
    total = first.agg(F.count(F.lit(1))).scalar()
    flagged = first.agg(F.sum("prediction")).scalar()
    equal = (F.col("score") == F.col("score_again")) & (F.col("prediction") == F.col("flag_again"))
    return (
        first.join(again, "session_id")
        .groupBy("label")
        .agg(
            F.count("score").alias("sessions"),
            F.bool_and((F.col("score") > 0) & (F.col("score") < 1)).alias("scores_in_range"),
            F.bool_and(equal).alias("same_again"),
        )
        .withColumn("share_kept", flagged <= F.ceil(total * F.lit(pipeline.CONTAMINATION)))
    )


@query
def autoencoder_checks(spark, sf_dir):
    """By label: evaluation rows, errors finite and not negative, flags as the second run's."""
    rows = features.feature_rows(_events(spark, sf_dir))
    first = pipeline.autoencoder_run(rows)
    again = pipeline.autoencoder_run(rows).select(
        "session_id", F.col("error").alias("error_again"), F.col("prediction").alias("flag_again")
    )
    close = F.abs(F.col("error") - F.col("error_again")) <= 1e-9 * (1 + F.col("error"))
    finite = (F.col("error") >= 0) & (F.col("error") < float("inf"))
    return (
        first.join(again, "session_id")
        .groupBy("label")
        .agg(
            F.count("error").alias("sessions"),
            F.bool_and(finite).alias("errors_in_range"),
            F.bool_and(close & (F.col("prediction") == F.col("flag_again"))).alias("same_again"),
        )
    )


@query
def autoencoder_errors(spark, sf_dir):
    flagged = pipeline.autoencoder_run(features.feature_rows(_events(spark, sf_dir)))
    return flagged.select("session_id", "agent_type", "label", "error", "prediction")


def _threshold(spark, sf_dir):
    rows = pipeline.stored(_error_rows(spark, sf_dir))
    return rows, exact_quantile(rows, "error", pipeline.ERROR_QUANTILE)


@query
def error_threshold(spark, sf_dir):
    rows, threshold = _threshold(spark, sf_dir)
    return rows.agg(F.count("error").alias("sessions")).withColumn(
        "threshold", F.round(F.lit(threshold), 6)
    )


@query
def flag_anomalies(spark, sf_dir):
    rows, threshold = _threshold(spark, sf_dir)
    return evaluate.flag_above(rows, "error", threshold).select("session_id", "prediction")


@query
def flag_top_share(spark, sf_dir):
    return _predictions(spark, sf_dir).select("session_id", "prediction")


@query
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(_predictions(spark, sf_dir))


@query
def classification_report(spark, sf_dir):
    report = evaluate.classification_report(_predictions(spark, sf_dir))
    return report.select(
        "class",
        *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")],
        "support",
    )


@query
def recall_by_agent(spark, sf_dir):
    return evaluate.recall_by_agent(_predictions(spark, sf_dir))


@query
def rule_flags(spark, sf_dir):
    return rules.rule_flags(features.session_features(_events(spark, sf_dir)))


# --- data quality ---------------------------------------------------------------


def _quality_query(name: str, rule: quality.Rule) -> None:
    def build(spark, sf_dir):
        wanted = [rule.column] if rule.column in FEATURE_COLUMNS else ["has_payment"]
        rows = features.session_features(_events(spark, sf_dir), wanted)
        return quality.check_rules(rows, [rule])

    _register(name, build)


for _name, _rule in quality.RULES.items():
    _quality_query(_name, _rule)


@query
def dq_scorecard(spark, sf_dir):
    return quality.scorecard(features.session_features(_events(spark, sf_dir)))


@query
def dq_live_scorecard(spark, sf_dir):
    return quality.scorecard(_live(spark, sf_dir))


# --- behaviour checks -----------------------------------------------------------


@query
def session_shape(spark, sf_dir):
    return checks.session_shape(_events(spark, sf_dir))


@query
def funnel_order(spark, sf_dir):
    return checks.funnel_order(_events(spark, sf_dir))


@query
def ring_candidates(spark, sf_dir):
    return checks.ring_candidates(_events(spark, sf_dir))


@query
def ring_candidates_by_product(spark, sf_dir):
    return checks.ring_candidates(_events(spark, sf_dir), by_product=True)


@query
def ring_conversion(spark, sf_dir):
    return checks.ring_conversion(_events(spark, sf_dir))


@query
def engagement_decay(spark, sf_dir):
    return checks.engagement_decay(_events(spark, sf_dir))


@query
def gap_bounds(spark, sf_dir):
    return checks.gap_bounds(_events(spark, sf_dir))
