"""Table schemas and fixed values."""

from pyspark.sql import types as T

# --- fixed values ---------------------------------------------------------
DEFAULT_LIMIT = 100
MAX_LIMIT = 1000
UNKNOWN = "unknown"
JSON_ERROR = "JSONDecodeError"
VALIDATION_ERROR = "validation_error"
VALUE_ERROR = "ValueError"
INTEGRITY_ERROR = "IntegrityError"
LENGTH_ERROR = "DataError"
SIZE_ERROR = "BodySizeError"
LARGEST_JSON_TEXT = 20_000_000  # characters of one string that the JSON parser reads
STORAGE_LATENCY_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 1.0)
REQUEST_DURATION_BUCKETS = (0.01, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0)
COLUMN_LENGTHS = {
    "id": 36,
    "event_type": 255,
    "source": 255,
    "target": 255,
    "routing_key": 255,
    "session_id": 36,
    "correlation_id": 36,
}
# --------------------------------------------------------------------------

# Routing key under which the store announces what it has stored.
FEED_ROUTING_KEY = "ledger.event.persisted"

RAW_SCHEMA = T.StructType(
    [
        T.StructField("body", T.StringType()),
        T.StructField("routing_key", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("arrival_seq", T.LongType()),
    ]
)

NORMALIZED_COLUMNS = (
    "event_id",
    "event_type",
    "timestamp",
    "source",
    "target",
    "correlation_id",
    "session_id",
    "payload",
)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("target", T.StringType()),
        T.StructField("routing_key", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("stored_at", T.TimestampType(), False),
        T.StructField("payload", T.StringType(), False),
        T.StructField("session_id", T.StringType()),
        T.StructField("correlation_id", T.StringType()),
        T.StructField("storage_latency_ms", T.DoubleType()),
    ]
)
EVENT_COLUMNS = tuple(EVENT_SCHEMA.fieldNames())

# What the table holds on disk: the event, who wrote it, and its partition.
STORED_SCHEMA = T.StructType(
    EVENT_SCHEMA.fields
    + [
        T.StructField("writer", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("commit_seq", T.LongType()),
        T.StructField("event_date", T.DateType()),
    ]
)

# Counts that each change adds, by day and label.
COUNT_SCHEMA = T.StructType(
    [
        T.StructField("event_date", T.DateType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)

QUARANTINE_SCHEMA = T.StructType(
    [
        T.StructField("body", T.StringType()),
        T.StructField("routing_key", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("arrival_seq", T.LongType()),
        T.StructField("writer", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
QUARANTINE_COLUMNS = tuple(QUARANTINE_SCHEMA.fieldNames()[:-2])
