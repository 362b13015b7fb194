"""Every operator as a query over an events table, with the SQL that must agree.

Operators on messages run on the messages derived from the table; operators on stored
events run on a store that the ingest filled with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventledger.functions import fields
from eventledger.operators import envelopes, filters, metrics, paging, patterns, uniqueness
from eventledger.plans.ingest import stamp
from eventledger.plans.store import EventStore
from eventledger.plans.workspace import (
    filled_store,
    message_stream,
    messages,
    new_store,
)
from eventledger.schema import NORMALIZED_COLUMNS
from eventledger.session import prepare, shared_dir
from eventledger.streaming import ingest as streaming
from eventledger.streaming import live

Query = Callable[[SparkSession, str], DataFrame]

START = "2024-01-05T00:00:00"
END = "2024-01-20T12:00:00+00:00"
CUTOFF = "2024-01-15"
SESSION = "s7"
EVENT_TYPE = "click"
SOURCE = "svc1"
TARGET = "svc2"
EVENT_ID = "505"
CORRELATION = "c50"


def _plain_times(df: DataFrame) -> DataFrame:
    """Instants as UTC wall-clock values, as SQL without time zones shows them."""
    instants = [name for name, kind in df.dtypes if kind == "timestamp"]
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in instants})


def _on_messages(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: _plain_times(build(messages(spark, sf_dir)))


def _on_normalized(build: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_messages(lambda raw: build(envelopes.normalize_envelope(raw)))


def _on_good(build: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_normalized(lambda rows: build(rows.where("error_type IS NULL")))


def _on_store(build: Callable[[EventStore], DataFrame]) -> Query:
    return lambda spark, sf_dir: _plain_times(build(filled_store(spark, sf_dir)))


def _on_events(build: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_store(lambda store: build(store.events()))


def _events(build: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_events(lambda events: paging.event_projection(build(events)))


def _drained(rows: DataFrame) -> DataFrame:
    """Everything a stream has to say now, as a static table."""
    spark = rows.sparkSession
    path = shared_dir(spark, "stream")
    streaming.append_stream(rows, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def _ingested(
    spark: SparkSession, sf_dir: str, runs: int = 1, max_files: int | None = None
) -> EventStore:
    store = new_store(spark, "ingest")
    for _ in range(runs):
        streaming.ingest_stream(
            message_stream(spark, sf_dir, max_files),
            store,
            shared_dir(spark, "checkpoint"),
            stored_at="processed_at",
        ).awaitTermination()
    return store


# --- sources, sinks, tables ---


def _raw_message_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _drained(message_stream(prepare(spark), sf_dir))
    return _plain_times(
        rows.select("arrival_seq", "routing_key", "received_at", (F.length("body") > 0).alias("has_body"))
    )


def _init_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = new_store(prepare(spark), "init")
    store.append_events(filled_store(spark, sf_dir).events())
    store.init()
    return _plain_times(paging.event_projection(store.events()))


def _append_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = envelopes.normalize_envelope(messages(spark, sf_dir)).where("error_type IS NULL")
    store = new_store(spark, "append")
    store.append_events(stamp(uniqueness.unique_by_id(rows), "processed_at"))
    return _plain_times(paging.event_projection(store.events()))


def _events_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of a store that was filled in parts and merged since."""
    store, events = new_store(prepare(spark), "scan"), filled_store(spark, sf_dir).events()
    for part in range(3):
        store.append_events(events.where(F.pmod(F.xxhash64("id"), F.lit(3)) == part))
    store.compact("2024-01-06")
    return _plain_times(paging.event_projection(store.events()))


def _archive_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = new_store(prepare(spark), "archive")
    store.append_events(filled_store(spark, sf_dir).events())
    store.archive_before(CUTOFF)
    live_rows = store.events().select("id", "timestamp", F.lit("live").alias("place"))
    old_rows = store.archive().select("id", "timestamp", F.lit("archive").alias("place"))
    return _plain_times(live_rows.union(old_rows))


# --- streams ---


def _ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _ingested(prepare(spark), sf_dir)
    return _plain_times(paging.event_projection(store.events()))


def _replay_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _ingested(prepare(spark), sf_dir, runs=2)
    return _plain_times(paging.event_projection(store.events()))


def _ingest_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _ingested(prepare(spark), sf_dir, max_files=3)
    return _plain_times(paging.event_projection(store.events()))


def _dedup_stream_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streaming.dedup_stream_bounded(message_stream(prepare(spark), sf_dir, 3), "10 minutes")
    return _drained(rows.select("id"))


def _dedup_stream_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streaming.dedup_stream_settled(message_stream(prepare(spark), sf_dir), "10 minutes")
    return _drained(rows.select("id", "arrival_seq"))


def _live_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = filled_store(spark, sf_dir)
    counters = {
        "received": live.live_received(message_stream(spark, sf_dir)),
        "stored": live.live_stored(store),
        "failed": live.live_failed(store),
    }
    published = []
    for name, counter in counters.items():
        path = shared_dir(spark, name)
        live.publish_counters(counter, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
        rows = live.read_counters(store, f"{path}/rows")
        label = {"received": "source", "failed": "error_type"}.get(name)
        published.append(
            rows.select(
                F.lit(name).alias("counter"),
                "event_type",
                (F.col(label) if label else F.lit(None).cast("string")).alias("label"),
                "total",
            )
        )
    return published[0].union(published[1]).union(published[2])


def _event_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replayed as messages and read back: the events must come out unchanged."""
    store = filled_store(spark, sf_dir)
    again = patterns.replay_messages(store.events(), start_time=START, end_time=END)
    return _plain_times(
        envelopes.normalize_envelope(again)
        .where("error_type IS NULL")
        .select("arrival_seq", *NORMALIZED_COLUMNS, "routing_key")
    )


def queries() -> dict[str, Query]:
    """One query per operator."""
    with_seq = lambda *names: lambda rows: rows.select("arrival_seq", *names)
    decoded = lambda raw: envelopes.read_fields(envelopes.decode_body(raw))
    checked = lambda test: lambda raw: decoded(raw).select(
        "arrival_seq", F.expr(f"coalesce({test()}, FALSE)").alias("valid")
    )
    window = {"start_time": START, "end_time": END}
    return {
        # sources, sinks, tables
        "raw_message_source": _raw_message_source,
        "init_store": _init_store,
        "append_events": _append_events,
        "events_scan": _events_scan,
        "quarantine_sink": _on_store(
            lambda store: store.quarantine().select(
                "arrival_seq", "routing_key", "event_type", "error_type", "received_at"
            )
        ),
        "persisted_feed": lambda spark, sf_dir: _plain_times(
            _drained(patterns.persisted_feed(filled_store(spark, sf_dir).tail()))
        ),
        "archive_before": _archive_before,
        # decode, validate, normalise
        "decode_body": _on_messages(
            lambda raw: envelopes.decode_body(raw).select("arrival_seq", "is_json")
        ),
        "validate_v2": _on_messages(checked(envelopes.valid_v2)),
        "validate_v1": _on_messages(checked(envelopes.valid_v1)),
        "normalize_envelope": _on_good(with_seq(*NORMALIZED_COLUMNS)),
        "format_source": _on_good(with_seq("source")),
        "first_correlation_id": _on_good(with_seq("correlation_id")),
        "default_routing_key": _on_messages(
            lambda raw: raw.select(
                "arrival_seq", F.expr(fields.default_routing_key()).alias("routing_key")
            )
        ),
        "to_utc": _on_good(with_seq("timestamp")),
        "resolve_event_id": _on_normalized(
            lambda rows: envelopes.received(rows).select("arrival_seq", "id")
        ),
        "stamp_stored_at": _on_good(
            lambda rows: stamp(rows).select(
                "arrival_seq", (F.col("stored_at") >= F.col("received_at")).alias("stamped")
            )
        ),
        "storage_latency": _on_messages(
            lambda raw: stamp(raw, "processed_at").select(
                "arrival_seq",
                "storage_latency_ms",
                F.round("storage_latency_ms", 2).alias("logged_ms"),
            )
        ),
        "event_projection": _events(lambda events: events),
        "payload_roundtrip": _on_events(
            lambda events: events.select("id", "payload", filters.payload_field("k").alias("k"))
        ),
        # filters
        "filter_session": _events(lambda e: filters.filter_session(e, SESSION)),
        "filter_event_type": _events(lambda e: filters.filter_event_type(e, EVENT_TYPE)),
        "filter_source": _events(lambda e: filters.filter_source(e, SOURCE)),
        "filter_target": _events(lambda e: filters.filter_target(e, TARGET)),
        "filter_start_time": _events(lambda e: filters.filter_start_time(e, START)),
        "filter_end_time": _events(lambda e: filters.filter_end_time(e, END)),
        "filter_combined": _events(
            lambda e: filters.filter_events(
                e, event_type=EVENT_TYPE, source=SOURCE, target="", session_id=None, **window
            )
        ),
        "get_event_by_id": _on_store(lambda store: paging.event_projection(store.get_event(EVENT_ID))),
        "validate_page_args": _on_events(lambda e: paging.query_page(e, limit=1000, offset=0)),
        # order and pages
        "newest_first": _on_events(lambda e: paging.newest_first(paging.event_projection(e))),
        "limit_events": _events(lambda e: paging.limit_events(e, 75)),
        "offset_events": _events(lambda e: paging.offset_events(e, 250, 120)),
        "query_page": _on_store(
            lambda store: store.query_page(event_type=EVENT_TYPE, limit=100, offset=20, **window)
        ),
        "page_info": _on_store(
            lambda store: store.page_info(event_type=EVENT_TYPE, limit=100, offset=20, **window)
        ),
        # aggregations
        "total_count": _on_store(lambda store: store.total_count(event_type=EVENT_TYPE, **window)),
        "events_received_total": _on_store(EventStore.received_total),
        "events_stored_total": _on_store(EventStore.stored_total),
        "events_failed_total": _on_store(EventStore.failed_total),
        "storage_latency_histogram": _on_events(metrics.storage_latency_histogram),
        "latest_storage_latency": _on_events(metrics.latest_storage_latency),
        # streams and state
        "ingest_stream": _ingest_stream,
        "unique_by_id": _on_good(
            lambda rows: uniqueness.unique_by_id(rows).select("arrival_seq", "id", "payload")
        ),
        "duplicate_rejects": _on_good(
            lambda rows: uniqueness.duplicate_rejects(rows).select("arrival_seq", "id", "event_type")
        ),
        "dedup_stream_bounded": _dedup_stream_bounded,
        "dedup_stream_settled": _dedup_stream_settled,
        "replay_idempotent": _replay_idempotent,
        "ingest_rate_limit": _ingest_rate_limit,
        "live_counters": _live_counters,
        # retrieval patterns
        "session_history": _on_events(lambda e: patterns.session_history(e, SESSION)),
        "conversation_context": _on_events(
            lambda e: patterns.conversation_context(e, SESSION, EVENT_TYPE)
        ),
        "audit_trail": _on_events(lambda e: patterns.audit_trail(e, CORRELATION)),
        "recent_events": _on_events(patterns.recent_events),
        "event_replay": _event_replay,
        "tail_store": lambda spark, sf_dir: _plain_times(
            paging.event_projection(
                _drained(filled_store(spark, sf_dir).tail(event_type="purchase"))
            )
        ),
        "recent_failures": _on_store(
            lambda store: patterns.recent_failures(store.quarantine(), 40).select(
                "arrival_seq", "event_type", "error_type", "received_at"
            )
        ),
    }
