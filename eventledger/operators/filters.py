"""Optional, exact, AND-combined filters over stored events."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Moment = datetime | str


def as_utc(moment: Moment) -> datetime:
    """A bound as an aware UTC datetime; text is ISO-8601, no zone means UTC."""
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    if moment.tzinfo is None:
        return moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc)


_EQUALITY = ("session_id", "event_type", "source", "target", "correlation_id")


def _time_bound(events: DataFrame, bound: Moment, comparison: str) -> Column:
    at = as_utc(bound)
    predicate = f"timestamp {comparison} TIMESTAMP '{at.isoformat()}'"
    if "event_date" in events.columns:  # a bound on time alone prunes no partition
        predicate += f" AND event_date {comparison} DATE '{at.date().isoformat()}'"
    return F.expr(predicate)


def filter_events(
    events: DataFrame,
    session_id: str | None = None,
    event_type: str | None = None,
    source: str | None = None,
    target: str | None = None,
    start_time: Moment | None = None,
    end_time: Moment | None = None,
    correlation_id: str | None = None,
) -> DataFrame:
    """Events that match every given value; both time bounds are inclusive.

    None and empty text mean no filter. All predicates go into one ``where`` and from
    there into the scan.
    """
    wanted = dict(zip(_EQUALITY, (session_id, event_type, source, target, correlation_id)))
    predicates = [F.col(name) == value for name, value in wanted.items() if value]
    if start_time:
        predicates.append(_time_bound(events, start_time, ">="))
    if end_time:
        predicates.append(_time_bound(events, end_time, "<="))
    return events.where(reduce(and_, predicates)) if predicates else events


def filter_session(events: DataFrame, session_id: str) -> DataFrame:
    return filter_events(events, session_id=session_id)


def filter_event_type(events: DataFrame, event_type: str) -> DataFrame:
    return filter_events(events, event_type=event_type)


def filter_source(events: DataFrame, source: str) -> DataFrame:
    return filter_events(events, source=source)


def filter_target(events: DataFrame, target: str) -> DataFrame:
    return filter_events(events, target=target)


def filter_correlation(events: DataFrame, correlation_id: str) -> DataFrame:
    return filter_events(events, correlation_id=correlation_id)


def filter_start_time(events: DataFrame, start_time: Moment) -> DataFrame:
    """Events at or after ``start_time``."""
    return filter_events(events, start_time=start_time)


def filter_end_time(events: DataFrame, end_time: Moment) -> DataFrame:
    """Events at or before ``end_time``."""
    return filter_events(events, end_time=end_time)


def get_event_by_id(events: DataFrame, event_id: str) -> DataFrame:
    """The event with this id: one row, or none when there is no such event."""
    return events.where(F.col("id") == event_id)


def payload_field(name: str) -> Column:
    """A top-level payload field as text."""
    return F.get_json_object("payload", f"$.{name}")
