"""The SQL each query must agree with, over the plain ``events`` table.

It states the expected result directly from the table's columns and never looks at a
message body.
"""

from __future__ import annotations

from eventledger.plans import catalog as c
from eventledger.schema import STORAGE_LATENCY_BUCKETS
from eventledger.sources.sample import DUPLICATE_SEQ_SHIFT

# Every message: each event once, those of kind 5 a second time.
_MESSAGES = f"""
sent AS (
  SELECT *, FALSE AS again FROM events
  UNION ALL
  SELECT *, TRUE AS again FROM events WHERE event_id % 97 = 5
),
messages AS (
  SELECT
    event_id + CASE WHEN again THEN {DUPLICATE_SEQ_SHIFT} ELSE 0 END AS arrival_seq,
    event_id % 97 AS kind,
    event_id % 2 = 0 AS is_current,
    again,
    ts AS received_at,
    CASE WHEN event_id % 50 = 0 THEN '' ELSE event_type END AS sent_key,
    CASE WHEN event_id % 97 = 4 THEN '' ELSE CAST(event_id AS VARCHAR) END AS event_id,
    event_type,
    CASE
      WHEN event_id % 6 = 0 THEN 'unknown@host' || CAST(user_id % 3 AS VARCHAR)
      WHEN event_id % 2 = 0
        THEN 'app' || CAST(user_id % 5 AS VARCHAR) || '@host' || CAST(user_id % 3 AS VARCHAR)
      ELSE 'svc' || CAST(user_id % 5 AS VARCHAR)
    END AS source,
    CASE WHEN event_id % 4 = 1 THEN 'svc' || CAST(user_id % 4 AS VARCHAR) END AS target,
    CASE WHEN event_id % 50 = 0 THEN 'unknown' ELSE event_type END AS routing_key,
    ts AS "timestamp",
    ts + to_microseconds(CAST(round(value * 1000) AS BIGINT)) AS stored_at,
    CASE WHEN again THEN '{{"dup":true}}' ELSE replace(props, ': ', ':') END AS payload,
    CASE WHEN event_id % 2 = 1 THEN 's' || CAST(user_id AS VARCHAR) END AS session_id,
    CASE WHEN event_id % 14 <> 0 THEN 'c' || CAST(event_id // 10 AS VARCHAR) END AS correlation_id,
    value + 0.0 AS storage_latency_ms
  FROM sent
)"""

_EVENT = (
    'id, event_type, source, target, routing_key, "timestamp", stored_at, payload, '
    "session_id, correlation_id, storage_latency_ms"
)
_NORMALIZED = (
    'event_id, event_type, "timestamp", source, target, correlation_id, session_id, payload'
)

_WITH = f"""WITH {_MESSAGES},
good AS (SELECT * FROM messages WHERE kind NOT IN (1, 2, 3, 4)),
se AS (
  SELECT event_id AS id, * EXCLUDE (event_id) FROM good WHERE NOT again
),
rejects AS (
  SELECT
    arrival_seq, routing_key, received_at,
    CASE WHEN kind IN (1, 2, 3) THEN 'unknown' ELSE event_type END AS event_type,
    CASE kind WHEN 1 THEN 'JSONDecodeError' WHEN 4 THEN 'ValueError'
      WHEN 5 THEN 'IntegrityError' ELSE 'validation_error' END AS error_type
  FROM messages WHERE kind IN (1, 2, 3, 4) OR again
)
"""


def _events(where: str = "TRUE", tail: str = "") -> str:
    return f"{_WITH} SELECT {_EVENT} FROM se WHERE {where} {tail}"


def _from(table: str, columns: str, where: str = "TRUE", tail: str = "") -> str:
    return f"{_WITH} SELECT {columns} FROM {table} WHERE {where} {tail}"


def _histogram() -> str:
    total = "CAST(sum(CAST(storage_latency_ms / 1000 AS DECIMAL(28, 9))) AS DOUBLE)"
    rows = [
        f"SELECT '{float(bound)}' AS le, "
        f"count(*) FILTER (WHERE storage_latency_ms / 1000 <= {bound}) AS bucket_count, "
        f"{total} AS observed_sum, count(*) AS observed_count FROM se"
        for bound in STORAGE_LATENCY_BUCKETS
    ]
    rows.append(
        f"SELECT '+Inf', count(*), {total}, count(*) FROM se"
    )
    return _WITH + " UNION ALL ".join(rows)


def oracle_sql() -> dict[str, str]:
    newest = 'ORDER BY "timestamp" DESC, id'
    start, end = "TIMESTAMP '2024-01-05 00:00:00'", "TIMESTAMP '2024-01-20 12:00:00'"
    window = f'"timestamp" >= {start} AND "timestamp" <= {end}'
    of_type = f"event_type = '{c.EVENT_TYPE}'"
    of_session = f"session_id = '{c.SESSION}'"
    return {
        "raw_message_source": _from(
            "messages", "arrival_seq, sent_key AS routing_key, received_at, TRUE AS has_body"
        ),
        "init_store": _events(),
        "append_events": _events(),
        "events_scan": _events(),
        "quarantine_sink": _from(
            "rejects", "arrival_seq, routing_key, event_type, error_type, received_at"
        ),
        "persisted_feed": _from(
            "se",
            "id AS original_event_id, event_type AS original_event_type, "
            "routing_key AS original_routing_key, stored_at, storage_latency_ms",
        ),
        "archive_before": _from(
            "se",
            f"id, \"timestamp\", CASE WHEN \"timestamp\" < TIMESTAMP '{c.CUTOFF} 00:00:00' "
            "THEN 'archive' ELSE 'live' END AS place",
        ),
        "decode_body": _from("messages", "arrival_seq, kind <> 1 AS is_json"),
        "validate_v2": _from(
            "messages", "arrival_seq, is_current AND kind NOT IN (1, 2, 3) AS valid"
        ),
        "validate_v1": _from(
            "messages", "arrival_seq, NOT is_current AND kind NOT IN (1, 2, 3) AS valid"
        ),
        "normalize_envelope": _from("good", f"arrival_seq, {_NORMALIZED}"),
        "format_source": _from("good", "arrival_seq, source"),
        "first_correlation_id": _from("good", "arrival_seq, correlation_id"),
        "default_routing_key": _from("messages", "arrival_seq, routing_key"),
        "to_utc": _from("good", 'arrival_seq, "timestamp"'),
        "resolve_event_id": _from(
            "messages", "arrival_seq, nullif(event_id, '') AS id", "kind NOT IN (1, 2, 3)"
        ),
        "stamp_stored_at": _from("good", "arrival_seq, TRUE AS stamped"),
        "storage_latency": _from(
            "messages",
            "arrival_seq, storage_latency_ms, round(storage_latency_ms, 2) AS logged_ms",
        ),
        "event_projection": _events(),
        "payload_roundtrip": _from("se", "id, payload, json_extract_string(payload, '$.k') AS k"),
        "filter_session": _events(of_session),
        "filter_event_type": _events(of_type),
        "filter_source": _events(f"source = '{c.SOURCE}'"),
        "filter_target": _events(f"target = '{c.TARGET}'"),
        "filter_start_time": _events(f'"timestamp" >= {start}'),
        "filter_end_time": _events(f'"timestamp" <= {end}'),
        "filter_combined": _events(f"{of_type} AND source = '{c.SOURCE}' AND {window}"),
        "get_event_by_id": _events(f"id = '{c.EVENT_ID}'"),
        "validate_page_args": _events(tail=f"{newest} LIMIT 1000"),
        "newest_first": _events(tail=newest),
        "limit_events": _events(tail=f"{newest} LIMIT 75"),
        "offset_events": _events(tail=f"{newest} LIMIT 120 OFFSET 250"),
        "query_page": _events(f"{of_type} AND {window}", f"{newest} LIMIT 100 OFFSET 20"),
        "page_info": _from(
            "se",
            'count(*) AS total, CAST(100 AS BIGINT) AS "limit", CAST(20 AS BIGINT) AS "offset", '
            "120 < count(*) AS has_more",
            f"{of_type} AND {window}",
        ),
        "total_count": _from("se", "count(*) AS total", f"{of_type} AND {window}"),
        "events_received_total": _from(
            "messages",
            "event_type, source, count(*) AS total",
            "kind NOT IN (1, 2, 3)",
            "GROUP BY event_type, source",
        ),
        "events_stored_total": _from(
            "se", "event_type, count(*) AS total", tail="GROUP BY event_type"
        ),
        "events_failed_total": _from(
            "rejects",
            "event_type, error_type, count(*) AS total",
            tail="GROUP BY event_type, error_type",
        ),
        "storage_latency_histogram": _histogram(),
        "latest_storage_latency": _from(
            "se", "storage_latency_ms", tail="ORDER BY stored_at DESC, id DESC LIMIT 1"
        ),
        "ingest_stream": _events(),
        "unique_by_id": _from(
            "good",
            "arrival_seq, event_id AS id, payload",
            tail="QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival_seq) = 1",
        ),
        "duplicate_rejects": _from(
            "good",
            "arrival_seq, event_id AS id, event_type",
            tail="QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival_seq) > 1",
        ),
        "dedup_stream_bounded": _from("good", "DISTINCT event_id AS id"),
        "dedup_stream_settled": f"""{_WITH}
            SELECT event_id AS id, min(arrival_seq) AS arrival_seq FROM good GROUP BY event_id
            HAVING max(received_at) + INTERVAL 20 MINUTE <= (SELECT max(received_at) FROM good)""",
        "replay_idempotent": _events(),
        "ingest_rate_limit": _events(),
        "live_counters": f"""{_WITH}
            SELECT 'received' AS counter, event_type, source AS label, count(*) AS total
            FROM messages WHERE kind NOT IN (1, 2, 3) GROUP BY event_type, source
            UNION ALL
            SELECT 'stored', event_type, NULL, count(*) FROM se GROUP BY event_type
            UNION ALL
            SELECT 'failed', event_type, error_type, count(*)
            FROM rejects GROUP BY event_type, error_type""",
        "session_history": _events(of_session, newest),
        "conversation_context": _events(f"{of_session} AND {of_type}", newest),
        "audit_trail": _events(
            f"correlation_id = '{c.CORRELATION}'", 'ORDER BY "timestamp", id'
        ),
        "recent_events": _events(tail=f"{newest} LIMIT 50"),
        "event_replay": _from(
            "se",
            'row_number() OVER (ORDER BY "timestamp", id) - 1 AS arrival_seq, '
            'id AS event_id, event_type, "timestamp", source, target, correlation_id, '
            "session_id, payload, routing_key",
            window,
        ),
        "tail_store": _events("event_type = 'purchase'"),
        "recent_failures": _from(
            "rejects",
            "arrival_seq, event_type, error_type, received_at",
            tail="ORDER BY received_at DESC, arrival_seq DESC LIMIT 40",
        ),
    }
