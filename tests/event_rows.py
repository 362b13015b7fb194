"""Literal events and messages that several test modules build."""

from datetime import datetime, timezone
from uuid import uuid4

from eventledger.operators.paging import event_projection
from eventledger.schema import EVENT_SCHEMA, RAW_SCHEMA


def utc(*parts: int) -> datetime:
    return datetime(*parts, tzinfo=timezone.utc)


def event(**changes) -> tuple:
    row = {
        "id": str(uuid4()),
        "event_type": "order.placed",
        "source": "shop",
        "target": "stock",
        "routing_key": "orders.eu",
        "timestamp": utc(2024, 5, 1, 12),
        "stored_at": utc(2024, 5, 1, 12, 0, 1),
        "payload": '{"lines":[1,2],"paid":false,"by":{"name":"Ada"}}',
        "session_id": str(uuid4()),
        "correlation_id": str(uuid4()),
        "storage_latency_ms": 7.5,
    } | changes
    return tuple(row[name] for name in EVENT_SCHEMA.fieldNames())


def events(spark, *rows: tuple):
    return spark.createDataFrame(list(rows), EVENT_SCHEMA)


def raw(spark, *bodies: str, key: str = "k", start: int = 0):
    at = utc(2024, 5, 1)
    rows = [(body, key, at, start + n) for n, body in enumerate(bodies)]
    return spark.createDataFrame(rows, RAW_SCHEMA)


def rows_of(df):
    return sorted(map(tuple, event_projection(df).collect()))
