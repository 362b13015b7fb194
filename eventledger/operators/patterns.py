"""Named compositions users run, and the projections that leave the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventledger.operators.filters import Moment, filter_correlation, filter_events
from eventledger.operators.numbering import number_rows
from eventledger.operators.paging import event_projection, newest_first, oldest_first, query_page

RECENT_EVENTS = 50


def _history(events: DataFrame, limit: int | None, offset: int, **wanted: Moment | None) -> DataFrame:
    if limit is not None:
        return query_page(events, limit=limit, offset=offset, **wanted)
    if offset:
        raise ValueError("an offset needs a limit")
    return event_projection(newest_first(filter_events(events, **wanted)))


def session_history(
    events: DataFrame, session_id: str, limit: int | None = None, offset: int = 0
) -> DataFrame:
    """All events of one session, newest first, or one page of them.

    Only legacy envelopes carry a session id.
    """
    return _history(events, limit, offset, session_id=session_id)


def conversation_context(
    events: DataFrame, session_id: str, event_type: str, limit: int | None = None, offset: int = 0
) -> DataFrame:
    """The events of one type in one session, or one page of them."""
    return _history(events, limit, offset, session_id=session_id, event_type=event_type)


def audit_trail(events: DataFrame, correlation_id: str) -> DataFrame:
    """Every event of one correlation id, oldest first; not paged."""
    return event_projection(oldest_first(filter_correlation(events, correlation_id)))


def recent_events(events: DataFrame, limit: int = RECENT_EVENTS) -> DataFrame:
    return query_page(events, limit=limit)


def recent_failures(quarantine: DataFrame, limit: int = RECENT_EVENTS) -> DataFrame:
    """The latest rejects."""
    newest = quarantine.orderBy(F.desc("received_at"), F.desc("arrival_seq"))
    return newest.limit(limit)


def persisted_feed(events: DataFrame) -> DataFrame:
    """One notice per stored event; ``events`` may be a stream."""
    return events.selectExpr(
        "id AS original_event_id",
        "event_type AS original_event_type",
        "routing_key AS original_routing_key",
        "stored_at",
        "storage_latency_ms",
    )


def event_replay(events: DataFrame, **wanted: Moment | None) -> DataFrame:
    """Stored events again, oldest first."""
    return event_projection(oldest_first(filter_events(events, **wanted)))


def replay_messages(events: DataFrame, **wanted: Moment | None) -> DataFrame:
    """Stored events as raw messages in their old order: ``arrival_seq`` is 0, 1, 2 … from the
    oldest event on, without gaps, so a store that takes them in any batches has the same
    first writes. No task sees more than its stretch of time."""
    kept = event_projection(filter_events(events, **wanted))
    return to_messages(number_rows(kept, ["timestamp", "id"], name="arrival_seq"))


def to_messages(events: DataFrame) -> DataFrame:
    """Events as raw messages with legacy envelopes, ready for a folder or a topic. An
    ``arrival_seq`` that they have stays.

    The envelope is the one of the two that keeps target and session. The payload text
    is put in as it is; only the other members pass through ``to_json``.
    """
    members = """to_json(named_struct(
        'id', id,
        'ts', date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        'event_type', event_type, 'source', source, 'target', target,
        'correlation_id', correlation_id, 'session_id', session_id)) AS members"""
    return events.selectExpr("*", members).selectExpr(
        """concat(left(members, length(members) - 1), ',"data":', payload, '}') AS body""",
        "routing_key",
        "stored_at AS received_at",
        "arrival_seq" if "arrival_seq" in events.columns else "CAST(NULL AS BIGINT) AS arrival_seq",
    )
