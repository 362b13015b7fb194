import json

import pytest
from event_rows import raw, utc
from pyspark.sql import functions as F

from eventledger.functions import instants
from eventledger.operators.envelopes import normalize_envelope, received

V2 = {
    "event_id": "a",
    "event_type": "t",
    "timestamp": "2024-05-01T12:00:00+02:00",
    "source": {"host": "h", "type": "x"},
    "payload": {"k": 1},
}
V1 = {"id": "b", "ts": "2024-05-01T10:00:00", "event_type": "t", "source": "s", "data": {"k": 1}}


def v2(**changes):
    return json.dumps(V2 | changes)


def v1(**changes):
    return json.dumps(V1 | changes)


def without(envelope, name):
    return json.dumps({k: v for k, v in envelope.items() if k != name})


JSON, VALID, VALUE = "JSONDecodeError", "validation_error", "ValueError"

CASES = {
    # syntax
    "empty": ("", JSON),
    "null body": (None, JSON),
    "two objects": ("{}{}", JSON),
    "trailing text": (v1() + " zz", JSON),
    "closes the wrapper": (v1() + '} {"q":1', JSON),
    "closes the list": (v1() + '] [{"q":1', JSON),
    "two values": (v1() + ",{}", JSON),
    "single quotes": (v1().replace('"', "'"), JSON),
    "NaN": ('{"id":NaN}', JSON),
    "control character": ('{"id":"a\nb"}', JSON),
    "leading zero": ('{"id":01}', JSON),
    "trailing comma": ('{"id":"a",}', JSON),
    "comment": ('{"id":"a" /* c */}', JSON),
    # well-formed, but no envelope
    "list": ("[1]", VALID),
    "list of an envelope": (f"[{v1()}]", VALID),
    "number": ("5", VALID),
    "string": ('"abc"', VALID),
    "null": ("null", VALID),
    "empty object": ("{}", VALID),
    # types
    "numeric id": (v2(event_id=5), VALID),
    "null id": (v1(id=None), VALID),
    "payload is a list": (v2(payload=[1]), VALID),
    "payload is text that looks like an object": (v2(payload="{}"), VALID),
    "payload is null": (v2(payload=None), VALID),
    "source without host": (v2(source={"type": "x"}), VALID),
    "source host is a number": (v2(source={"host": 1, "type": "x"}), VALID),
    "app is a number": (v2(source={"host": "h", "type": "x", "app": 1}), VALID),
    "meta is a list": (v2(source={"host": "h", "type": "x", "meta": []}), VALID),
    "version is a number": (v2(version=1), VALID),
    "agent context is a list": (v2(agent_context=[]), VALID),
    "correlation ids null": (v2(correlation_ids=None), VALID),
    "correlation id null inside": (v2(correlation_ids=["a", None]), VALID),
    "correlation id number inside": (v2(correlation_ids=["a", 1]), VALID),
    "correlation ids text": (v2(correlation_ids="a"), VALID),
    "target is a number": (v1(target=1), VALID),
    "no data": (without(V1, "data"), VALID),
    "no timestamp": (without(V2, "timestamp"), VALID),
    "a number as text is an epoch": (v1(ts="1714557600"), None),
    "bad month": (v1(ts="2024-13-01T00:00:00"), VALID),
    "boolean timestamp": (v1(ts=True), VALID),
    "endless timestamp": (v1(ts=10**40), VALID),
    # empty ids
    "empty id v2": (v2(event_id=""), VALUE),
    "empty id v1": (v1(id=""), VALUE),
    # good
    "v2": (v2(), None),
    "v1": (v1(), None),
    "surrounding space": (f" \n{v1()}\t", None),
    "null optionals": (v1(target=None, session_id=None, correlation_id=None), None),
    "null app and meta": (v2(source={"host": "h", "type": "x", "app": None, "meta": None}), None),
    "unknown fields": (v2(extra=[1], version="1", agent_context={"a": [1]}), None),
    "epoch seconds": (v1(ts=1714557600), None),
}


def outcome(spark, *bodies):
    rows = normalize_envelope(raw(spark, *bodies)).orderBy("arrival_seq").collect()
    return rows


def test_errors(spark):
    rows = outcome(spark, *(body for body, _ in CASES.values()))
    assert {name: row.error_type for name, row in zip(CASES, rows)} == {
        name: error for name, (_, error) in CASES.items()
    }
    for row in rows:
        if row.error_type in (JSON, VALID):
            assert row.event_type == "unknown"
        else:
            assert row.event_type == "t"
            assert row.timestamp == utc(2024, 5, 1, 10).replace(tzinfo=None)


def test_received_counts_later_failures(spark):
    rows = normalize_envelope(raw(spark, v2(), v2(event_id=""), "{oops", "[1]"))
    assert received(rows).count() == 2


def test_v2_fields(spark):
    plain, full = outcome(
        spark,
        v2(session_id="s", target="x"),
        v2(source={"host": "h", "type": "x", "app": "svc"}, correlation_ids=["c1", "c2"]),
    )
    assert (plain.source, plain.target, plain.session_id, plain.correlation_id) == (
        "unknown@h",
        None,
        None,
        None,
    )
    assert (full.source, full.correlation_id, full.payload) == ("svc@h", "c1", '{"k":1}')
    (empty,) = outcome(spark, v2(source={"host": "h", "type": "x", "app": ""}, correlation_ids=[]))
    assert (empty.source, empty.correlation_id) == ("unknown@h", None)


def test_v1_fields(spark):
    (row,) = outcome(spark, v1(target="t", session_id="s", correlation_id="c"))
    assert (row.source, row.target, row.session_id, row.correlation_id) == ("s", "t", "s", "c")


def test_both_shapes_means_v2(spark):
    (row,) = outcome(spark, json.dumps(V1 | V2))
    assert (row.event_id, row.source) == ("a", "unknown@h")


def test_repeated_key_keeps_the_last(spark):
    (row,) = outcome(spark, v1()[:-1] + ',"id":"z","data":{"last":true}}')
    assert (row.id, row.payload) == ("z", '{"last":true}')


def test_payload_keeps_its_numbers(spark):
    payload = {"x": 1.0, "y": 12345678901234567890, "z": [None, "é\n"], "n": {"a": {"b": []}}}
    (row,) = outcome(spark, v2(payload=payload))
    assert json.loads(row.payload) == payload
    assert '"x":1.0' in row.payload


def test_large_payload_is_read_whole(spark):
    (row,) = outcome(spark, v2(payload={"x": "y" * 3_000_000}))
    assert row.error_type is None and len(row.payload) == 3_000_000 + len('{"x":""}')


def test_routing_key_default(spark):
    for key in ("", None):
        (row,) = normalize_envelope(raw(spark, v1(), key=key)).collect()
        assert row.routing_key == "unknown"


def test_max_lengths(spark):
    bodies = [v1(id="x" * 37), v1(source="s" * 255)]
    rows = normalize_envelope(raw(spark, *bodies), max_lengths=True).orderBy("arrival_seq").collect()
    assert [row.error_type for row in rows] == ["DataError", None]


TIMES = {
    "2024-05-01T12:00:00Z": utc(2024, 5, 1, 12),
    "2024-05-01T12:00:00+02:00": utc(2024, 5, 1, 10),
    "2024-05-01T12:00:00-0500": utc(2024, 5, 1, 17),
    "2024-05-01T12:00:00.123456": utc(2024, 5, 1, 12, 0, 0, 123456),
    "2024-05-01 12:00": utc(2024, 5, 1, 12),
    "2024-05-01t12:00:00z": utc(2024, 5, 1, 12),
    "2024-05-01": utc(2024, 5, 1),
    "2026": utc(1970, 1, 1, 0, 33, 46),
    "1714557600": utc(2024, 5, 1, 10),
    "1714557600.5": utc(2024, 5, 1, 10, 0, 0, 500_000),
    "-5": utc(1969, 12, 31, 23, 59, 55),
    "\u22125": utc(1969, 12, 31, 23, 59, 55),
    "20240501": utc(1970, 8, 23, 6, 21, 41),
    "2024-05-01T12:00:00+20:00": utc(2024, 4, 30, 16),
    "2024-05-01T12:00:00-18:30": utc(2024, 5, 2, 6, 30),
    "2024-05-01T12:00:00\u221202:00": utc(2024, 5, 1, 14),
    "2024-05-01T12:00:00.1234567890123Z": utc(2024, 5, 1, 12, 0, 0, 123456),
    "2024-05-01T12:00:00+24:00": None,
    "12:00": None,
    "2024-05-01T25:00:00": None,
    "tomorrow": None,
    "": None,
    None: None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_text_to_utc_in_any_session_zone(spark, zone):
    df = spark.createDataFrame([(n, text) for n, text in enumerate(TIMES)], "n int, text string")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        micros = df.orderBy("n").select(F.expr(f"unix_micros({instants.text_to_utc('text')})"))
        got = [row[0] for row in micros.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    want = [t and round(t.timestamp() * 1_000_000) for t in TIMES.values()]
    assert got == want


def test_epoch_to_utc(spark):
    df = spark.sql(
        "SELECT inline(array(struct(1, 1714557600BD), struct(2, 1714557600123BD),"
        " struct(3, 0.5BD), struct(4, 999999999999999999BD)))"
    ).toDF("n", "x")
    got = df.orderBy("n").select(F.expr(f"unix_micros({instants.epoch_to_utc('x')})")).collect()
    assert [row[0] for row in got] == [1714557600000000, 1714557600123000, 500000, None]


def test_bodies_beyond_the_parser_have_their_own_error(spark):
    large = v1(data={"x": "y" * 21_000_000})
    rows = normalize_envelope(raw(spark, large, "{oops")).orderBy("arrival_seq").select("error_type", "event_type")
    assert [tuple(r) for r in rows.collect()] == [("BodySizeError", "unknown"), ("JSONDecodeError", "unknown")]
