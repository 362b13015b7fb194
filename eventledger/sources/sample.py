"""Messages derived from an ``events`` table, as producers would have sent them.

``events`` has ``event_id, ts, user_id, event_type, value, props``. Even ids become
current envelopes, odd ids legacy ones; a fixed share is malformed or sent twice.
``processed_at`` says when a message was stored, so results can be compared with SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventledger.session import estimated_bytes

DUPLICATE_SEQ_SHIFT = 1_000_000_000
SPLIT_BYTES = 128 << 20


_EVENT_ID = """CASE
  WHEN event_id % 97 = 4 THEN '""'
  WHEN event_id % 97 = 2 AND event_id % 4 < 2 THEN string(event_id)
  WHEN event_id % 97 <> 2 THEN concat('"', event_id, '"')
END"""

_PAYLOAD = "CASE WHEN event_id % 97 = 3 THEN '[1,2]' ELSE props END"

# concat gives NULL for a NULL value and concat_ws leaves NULL members out.
_CURRENT = """concat('{', concat_ws(',',
  concat('"event_id":', {event_id}),
  concat('"event_type":"', event_type, '"'),
  concat('"timestamp":"', date_format(ts + INTERVAL 2 HOURS, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), '+02:00"'),
  '"version":"1.0"',
  concat('"source":{', concat_ws(',',
    concat('"host":"host', user_id % 3, '"'),
    '"type":"service"',
    CASE
      WHEN event_id % 12 = 0 THEN '"app":""'
      WHEN event_id % 6 <> 0 THEN concat('"app":"app', user_id % 5, '"')
    END), '}'),
  CASE
    WHEN event_id % 28 = 0 THEN '"correlation_ids":[]'
    WHEN event_id % 14 <> 0 THEN concat('"correlation_ids":["c', event_id DIV 10, '","x"]')
  END,
  '"agent_context":{"depth":1}',
  concat('"payload":', {payload})), '}')"""

_LEGACY = """concat('{', concat_ws(',',
  concat('"id":', {event_id}),
  concat('"ts":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), '"'),
  concat('"event_type":"', event_type, '"'),
  concat('"source":"svc', user_id % 5, '"'),
  concat('"data":', {payload}),
  CASE
    WHEN event_id % 4 = 1 THEN concat('"target":"svc', user_id % 4, '"')
    WHEN event_id % 4 = 3 THEN '"target":null'
  END,
  concat('"correlation_id":"c', event_id DIV 10, '"'),
  concat('"session_id":"s', user_id, '"')), '}')"""


def _body(payload: str) -> str:
    current, legacy = (
        text.replace("{event_id}", _EVENT_ID).replace("{payload}", payload)
        for text in (_CURRENT, _LEGACY)
    )
    return f"CASE WHEN event_id % 2 = 0 THEN {current} ELSE {legacy} END"


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table. Decoding is the expensive step, so a table that comes as fewer
    splits than there are cores is spread; a large one is read as it lies."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = estimated_bytes(events)
    if size is not None and size < cores * SPLIT_BYTES:
        return events.repartition(cores)
    return events


def messages_from_events(events: DataFrame) -> DataFrame:
    """``RAW_SCHEMA`` plus ``processed_at``; one narrow pass, no shuffle."""
    first = f"""CASE
      WHEN event_id % 97 = 1 AND event_id % 2 = 0 THEN '{{oops'
      WHEN event_id % 97 = 1 THEN concat({_body(_PAYLOAD)}, ' zz')
      WHEN event_id % 97 = 3 AND event_id % 4 = 0 THEN '[1]'
      ELSE {_body(_PAYLOAD)}
    END"""
    again = _body("""'{"dup":true}'""")
    copies = f"""CASE WHEN event_id % 97 = 5
      THEN array(
        named_struct('body', {first}, 'arrival_seq', event_id),
        named_struct('body', {again}, 'arrival_seq', event_id + {DUPLICATE_SEQ_SHIFT}))
      ELSE array(named_struct('body', {first}, 'arrival_seq', event_id))
    END"""
    received_at = "CAST(ts AS TIMESTAMP)"
    return events.selectExpr(
        f"inline({copies})",
        "CASE WHEN event_id % 50 = 0 THEN '' ELSE event_type END AS routing_key",
        f"{received_at} AS received_at",
        f"timestampadd(MICROSECOND, CAST(round(value * 1000) AS INT), {received_at}) AS processed_at",
    ).select("body", "routing_key", "received_at", "arrival_seq", "processed_at")
