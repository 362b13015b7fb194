"""Turning wire timestamps into UTC instants."""

from eventledger.functions import variants

# --- fixed values: accepted text forms and the bounds of numeric timestamps ---
DATE_TEXT = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
TIME_TEXT = "[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,9})?"
ZONE_TEXT = "(Z|[+-][0-9]{2}:?[0-9]{2})"
NUMBER_TEXT = "^[+\u2212-]?[0-9]+([.][0-9]+)?$"
LARGEST_EPOCH_SECONDS = 20_000_000_000
LARGEST_EPOCH_MILLIS = 253_402_300_799_999  # the end of year 9999
# ------------------------------------------------------------------------------


def _written_out(text: str) -> str:
    """ISO-8601 text with its zone; no zone means UTC, other text gives NULL."""
    return f"""CASE
      WHEN {text} RLIKE '^{DATE_TEXT}[T ]{TIME_TEXT}{ZONE_TEXT}$' THEN {text}
      WHEN {text} RLIKE '^{DATE_TEXT}[T ]{TIME_TEXT}$' THEN concat({text}, 'Z')
      WHEN {text} RLIKE '^{DATE_TEXT}$' THEN concat({text}, 'T00:00:00Z')
    END"""


def text_to_utc(text: str) -> str:
    """Text to an instant, whatever the session time zone; bad text gives NULL.

    ISO-8601 is the usual form. Only texts that fail it pay for the others, which stand in a
    lambda: that keeps them out of the compiled code, whose size slows down every row. They are lower-case ``t``
    and ``z``, ``_`` as separator, a decimal comma, a minus sign proper, times without
    seconds, fractions beyond the microsecond, which are cut, offsets up to 23:59 and
    numbers, which are epochs.
    """
    tidied = (
        f"regexp_replace(regexp_replace(translate({text}, 'tz_,\u2212', 'TZ .-'), '([.][0-9]{{6}})[0-9]+', '$1'), "
        f"'^({DATE_TEXT}.[0-9]{{2}}:[0-9]{{2}}){ZONE_TEXT}?$', '$1:00$2')"
    )
    unusual = f"coalesce(try_cast({_written_out('t')} AS TIMESTAMP), {_far_from_utc('t')})"
    return (
        f"CASE WHEN {text} IS NOT NULL THEN coalesce(try_cast({_written_out(text)} AS TIMESTAMP), "
        f"element_at(transform(array({tidied}), t -> {unusual}), 1), "
        f"element_at(transform(array({text}), t -> {_number_text('t')}), 1)) END"
    )


def _far_from_utc(text: str) -> str:
    """Offsets that the cast refuses, 18:00 to 23:59: taken off by hand."""
    form = f"^({DATE_TEXT}[T ]{TIME_TEXT})([+-])(1[89]|2[0-3]):?([0-5][0-9])$"
    part = lambda n: f"regexp_extract({text}, '{form}', {n})"
    minutes = f"(CAST({part(4)} AS INT) * 60 + CAST({part(5)} AS INT))"
    at = f"try_cast(concat({part(1)}, 'Z') AS TIMESTAMP)"
    return f"""CASE WHEN {text} RLIKE '{form}'
      THEN timestampadd(MINUTE, IF({part(3)} = '-', 1, -1) * {minutes}, {at}) END"""


def _number_text(text: str) -> str:
    number = f"try_cast(translate({text}, '\u2212', '-') AS DECIMAL(30, 6))"
    return f"CASE WHEN {text} RLIKE '{NUMBER_TEXT}' THEN {epoch_to_utc(number)} END"


def epoch_to_utc(number: str) -> str:
    """Epoch seconds, or milliseconds beyond 2e10, to an instant; out of range gives NULL."""
    return f"""timestamp_micros(try_cast(CASE
      WHEN abs({number}) <= {LARGEST_EPOCH_SECONDS} THEN {number} * 1000000
      WHEN abs({number}) <= {LARGEST_EPOCH_MILLIS} THEN {number} * 1000
    END AS BIGINT))"""


def instant(text: str, value: str) -> str:
    """The instant in a JSON string or number; any other type gives NULL.

    ``text`` is the VARIANT ``value`` read as a string, computed once by the caller.
    """
    number = f"try_variant_get({value}, '$', 'decimal(30,6)')"
    return f"""CASE
      WHEN {variants.kind(value)} = 'STRING' THEN {text_to_utc(text)}
      WHEN {variants.kind(value)} RLIKE '^(BIGINT|DOUBLE|FLOAT|DECIMAL)' THEN {epoch_to_utc(number)}
    END"""
