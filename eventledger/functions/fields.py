"""Scalar rules for single fields of an event."""

from eventledger.functions import variants
from eventledger.schema import UNKNOWN


def _or_unknown(value: str) -> str:
    return f"coalesce(nullif({value}, ''), '{UNKNOWN}')"


def format_source(app: str, host: str) -> str:
    """``app@host``; a null or empty app reads ``unknown``."""
    return f"concat({_or_unknown(app)}, '@', {host})"


def first_correlation_id(correlation_ids: str) -> str:
    """First element of the VARIANT list, NULL when it is empty or absent."""
    return variants.text(f"get({variants.elements(correlation_ids)}, 0)")


def default_routing_key(routing_key: str = "routing_key") -> str:
    return _or_unknown(routing_key)


def resolve_event_id(event_id: str, legacy_id: str | None = None) -> str:
    """The event's id, else its older alias; empty text counts as missing."""
    if legacy_id is None:
        return f"nullif({event_id}, '')"
    return f"coalesce(nullif({event_id}, ''), nullif({legacy_id}, ''))"


def storage_latency(received_at: str = "received_at", stored_at: str = "stored_at") -> str:
    """Milliseconds between receipt and storing."""
    return f"(unix_micros({stored_at}) - unix_micros({received_at})) / 1000.0D"


_DAY = 86_400_000_000


def event_day(timestamp: str = "timestamp") -> str:
    """The UTC day of an instant, whatever the session's time zone."""
    micros = f"unix_micros({timestamp})"
    return f"date_from_unix_date(CAST(({micros} - pmod({micros}, {_DAY})) DIV {_DAY} AS INT))"
