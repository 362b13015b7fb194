"""Decode, validate and normalise message bodies with built-in expressions only.

A body is read three times: into a VARIANT, in which JSON types can be tested; to count
its values; and, if it is good, for the text of its payload, which must not pass through
VARIANT: that would turn ``1.0`` into ``1``. Both JSON readers stop after the first value, so a body is read
wrapped in ``{"b":…}`` and counted wrapped in ``[…]``: text that is not exactly one
value can satisfy one of the two, never both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from eventledger.functions import fields, instants, variants
from eventledger.schema import (
    COLUMN_LENGTHS,
    JSON_ERROR,
    LARGEST_JSON_TEXT,
    LENGTH_ERROR,
    NORMALIZED_COLUMNS,
    SIZE_ERROR,
    UNKNOWN,
    VALIDATION_ERROR,
    VALUE_ERROR,
)

_STRICT_JSON = "map('allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false')"

_CURRENT_FIELDS = ("event_id", "event_type", "timestamp", "version", "source", "correlation_ids")
_LEGACY_FIELDS = ("id", "ts", "target", "correlation_id", "session_id")
_SOURCE_FIELDS = ("host", "type", "app", "meta")


def _variant_struct(names: tuple[str, ...]) -> str:
    return f"struct<{', '.join(f'{name}: variant' for name in names)}>"


def decode_body(raw: DataFrame) -> DataFrame:
    """Add ``is_json``, and of a JSON object ``fields``: its known members as VARIANTs.

    Members that may be large are only tested for being objects, not copied.
    """
    parsed = raw.selectExpr(
        "*",
        """try_parse_json(concat('{"b":', body, '}')) AS _doc""",
        "json_array_length(concat('[', body, ']')) AS _values",
    )
    one_value = "_doc IS NOT NULL AND is_valid_utf8(body) AND _values <=> 1"
    members = _variant_struct(_CURRENT_FIELDS + _LEGACY_FIELDS)
    return parsed.selectExpr(
        "* EXCEPT (_doc, _values)",
        f"{one_value} AS is_json",
        f"CASE WHEN {one_value} THEN try_variant_get(_doc, '$.b', '{members}') END AS fields",
        f"{variants.is_object('_doc', '$.b.payload')} AS has_payload",
        f"{variants.is_object('_doc', '$.b.data')} AS has_data",
        f"{variants.is_optional_object('_doc', '$.b.agent_context')} AS context_ok",
    )


def read_fields(decoded: DataFrame) -> DataFrame:
    """Add what validation and normalising both need, so it is computed once per row."""
    return decoded.selectExpr(
        "*",
        f"try_variant_get(fields.source, '$', '{_variant_struct(_SOURCE_FIELDS)}') AS sender",
        f"{variants.text('fields.timestamp')} AS _current_text",
        f"{variants.text('fields.ts')} AS _legacy_text",
    ).selectExpr(
        "* EXCEPT (_current_text, _legacy_text)",
        f"{instants.instant('_current_text', 'fields.timestamp')} AS current_instant",
        f"{instants.instant('_legacy_text', 'fields.ts')} AS legacy_instant",
    )


def valid_v2() -> str:
    """Whether a row of ``read_fields`` is a well-typed current envelope."""
    return " AND ".join(
        [
            variants.is_string("fields.event_id"),
            variants.is_string("fields.event_type"),
            "current_instant IS NOT NULL",
            variants.is_optional_string("fields.version"),
            variants.is_string("sender.host"),
            variants.is_string("sender.type"),
            variants.is_optional_string("sender.app"),
            variants.is_optional_object("sender.meta"),
            variants.is_string_list("fields.correlation_ids"),
            "context_ok",
            "has_payload",
        ]
    )


def valid_v1() -> str:
    """Whether a row of ``read_fields`` is a well-typed legacy envelope."""
    return " AND ".join(
        [
            variants.is_string("fields.id"),
            variants.is_string("fields.event_type"),
            variants.is_string("fields.source"),
            "legacy_instant IS NOT NULL",
            "has_data",
            variants.is_optional_string("fields.target"),
            variants.is_optional_string("fields.correlation_id"),
            variants.is_optional_string("fields.session_id"),
        ]
    )


def _object_text(name: str) -> str:
    return f"from_json(body, '{name} STRING', {_STRICT_JSON}).{name}"


def _envelope(values: tuple[str, ...]) -> str:
    members = (f"'{name}', {value}" for name, value in zip(NORMALIZED_COLUMNS, values))
    return f"named_struct({', '.join(members)})"


def _from_v2() -> str:
    no_text = "CAST(NULL AS STRING)"
    return _envelope(
        (
            variants.text("fields.event_id"),
            variants.text("fields.event_type"),
            "current_instant",
            fields.format_source(variants.text("sender.app"), variants.text("sender.host")),
            no_text,
            fields.first_correlation_id("fields.correlation_ids"),
            no_text,
            _object_text("payload"),
        )
    )


def _from_v1() -> str:
    return _envelope(
        (
            variants.text("fields.id"),
            variants.text("fields.event_type"),
            "legacy_instant",
            variants.text("fields.source"),
            variants.text("fields.target"),
            variants.text("fields.correlation_id"),
            variants.text("fields.session_id"),
            _object_text("data"),
        )
    )


def normalize_envelope(raw: DataFrame, max_lengths: bool = False) -> DataFrame:
    """One row per message: the normalised envelope, or why there is none.

    Adds the eight envelope columns, ``id`` and ``error_type`` / ``error`` (NULL for
    good rows) and defaults ``routing_key``. The current shape is tried first, the legacy
    one only when that fails. ``event_type`` of rows that fail before or in validation
    is ``unknown``.
    """
    kept = [name for name in raw.columns if name != "routing_key"]
    envelope = f"CASE WHEN {valid_v2()} THEN {_from_v2()} WHEN {valid_v1()} THEN {_from_v1()} END"
    # A filter on the outcome would be pushed down as one expression that parses the body
    # again for every field it mentions. Filters stop at a generator, so this one keeps
    # the work at three passes per row.
    envelopes = (
        read_fields(decode_body(raw))
        .selectExpr(
            *kept,
            f"{fields.default_routing_key()} AS routing_key",
            f"named_struct('is_json', is_json, '_e', {envelope}) AS _outcome",
        )
        .selectExpr(*kept, "routing_key", "inline(array(_outcome))")
    )
    rows = envelopes.selectExpr(
        "*", "_e.*", f"{fields.resolve_event_id('_e.event_id')} AS id"
    )
    failures = [
        # The parser refuses single strings beyond a size: such a body may well be JSON.
        (f"NOT is_json AND octet_length(body) > {LARGEST_JSON_TEXT}", SIZE_ERROR, "body is too large to parse"),
        ("NOT is_json", JSON_ERROR, "body is not JSON"),
        ("_e IS NULL", VALIDATION_ERROR, "body matches no envelope version"),
        ("id IS NULL", VALUE_ERROR, "event id is empty"),
    ]
    if max_lengths:
        too_long = " OR ".join(f"length({n}) > {size}" for n, size in COLUMN_LENGTHS.items())
        failures.append((too_long, LENGTH_ERROR, "a field is too long"))
    types = " ".join(f"WHEN {test} THEN '{kind}'" for test, kind, _ in failures)
    texts = " ".join(f"WHEN {test} THEN '{message}'" for test, _, message in failures)
    return rows.selectExpr(
        "* EXCEPT (is_json, _e, event_type)",
        f"coalesce(event_type, '{UNKNOWN}') AS event_type",
        f"CASE {types} END AS error_type",
        f"CASE {texts} END AS error",
    )


def received(rows: DataFrame) -> DataFrame:
    """Rows that passed validation, whatever happened to them afterwards."""
    return rows.where(
        f"error_type IS NULL OR error_type NOT IN ('{JSON_ERROR}', '{SIZE_ERROR}', '{VALIDATION_ERROR}')"
    )
