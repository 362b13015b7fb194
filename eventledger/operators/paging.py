"""Newest-first order, limits, offsets and pages.

``timestamp DESC, id`` is the order everywhere: ids are unique, so pages never overlap
even when many events share one timestamp.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventledger.functions.fields import event_day
from eventledger.operators.filters import Moment, as_utc, filter_end_time, filter_events
from eventledger.schema import DEFAULT_LIMIT, EVENT_COLUMNS, MAX_LIMIT
from eventledger.session import estimated_bytes

# A top-k keeps offset + limit rows per task. Pages that end further down skip ahead.
TOP_K_ROWS = 20_000
# Above this size a page first finds the days it can lie in, from a narrow count.
PRUNE_BYTES = 1 << 30

_ID_STEP = 2  # characters of id by which a run of equal timestamps is split
_ID_LENGTH = 512


def validate_page_args(limit: int = DEFAULT_LIMIT, offset: int = 0) -> None:
    """Reject a limit outside 1…1000 or a negative offset before anything is planned."""
    for name, value in (("limit", limit), ("offset", offset)):
        if isinstance(value, bool) or not isinstance(value, int):
            raise ValueError(f"{name} must be an integer")
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must lie between 1 and {MAX_LIMIT}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def newest_first(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("timestamp"), "id")


def oldest_first(events: DataFrame) -> DataFrame:
    return events.orderBy("timestamp", "id")


def limit_events(events: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` newest events: a distributed top-k, not a sort."""
    return newest_first(events).limit(limit)


def offset_events(events: DataFrame, offset: int, limit: int) -> DataFrame:
    """``limit`` events after the ``offset`` newest; the offset must come first."""
    return newest_first(events).offset(offset).limit(limit)


def _day(events: DataFrame) -> Column:
    return F.col("event_date") if "event_date" in events.columns else F.expr(event_day())


def _stored_days(events: DataFrame) -> list[date]:
    """The days that the table's partitions name, newest first, from the driver's listing."""
    if "event_date" not in events.columns:
        return []
    found = {re.search(r"/event_date=(\d{4}-\d{2}-\d{2})/", name) for name in events.inputFiles()}
    if None in found:
        return []
    return sorted({date.fromisoformat(m[1]) for m in found}, reverse=True)


def _buckets_of_page(
    events: DataFrame, keys: list[tuple[str, Column, bool]], offset: int, limit: int
) -> DataFrame:
    """The buckets that rows [offset, offset + limit) fall in, with ``before``: the number
    of rows ahead of the bucket. Each holds a row of the page, so there are at most
    ``limit``. Only counts per bucket are shuffled."""
    order = [F.col(name).desc() if desc else F.col(name).asc() for name, _, desc in keys]
    upto = F.sum("n").over(Window.orderBy(*order))
    counts = events.groupBy(*[key.alias(name) for name, key, _ in keys]).agg(
        F.count("*").alias("n")
    )
    return (
        counts.withColumn("before", upto - F.col("n"))
        .where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
        .drop("n")
    )


def _span(
    events: DataFrame, bucket: Column, offset: int, limit: int
) -> tuple[object, object, int] | None:
    """Oldest and newest bucket of the page and the rows ahead of it."""
    row = (
        _buckets_of_page(events, [("bucket", bucket, True)], offset, limit)
        .agg(F.min("bucket"), F.max("bucket"), F.min("before"))
        .first()
    )
    return None if row[0] is None else (row[0], row[1], row[2])


def newest_days(
    events: DataFrame, rows: int, days: list[date], newest: date | None = None, oldest: date | None = None
) -> DataFrame:
    """``events`` of so many of the newest days that ``rows`` of them are there, or all.

    The days are counted in windows that double in size, from the newest on: a page near the
    top opens a few days, however many the store has.
    """
    days = [d for d in days if (newest is None or d <= newest) and (oldest is None or d >= oldest)]
    found, at, width = 0, 0, 1
    while at < len(days) and found < rows:
        window = days[at : at + width]
        found += events.where(F.col("event_date").between(F.lit(window[-1]), F.lit(window[0]))).count()
        at, width = at + width, width * 2
    if at >= len(days):
        return events
    return events.where(F.col("event_date") >= F.lit(days[at - 1]))


def narrow_to_days(events: DataFrame, offset: int, limit: int) -> tuple[DataFrame, int]:
    """Keep only the days the page lies in; returns the events and the offset within them.

    Without other filters the counts come from Parquet footers alone.
    """
    day = _day(events)
    span = _span(events, day, offset, limit)
    if span is None:
        return events.where(F.lit(False)), 0
    return events.where(day.between(F.lit(span[0]), F.lit(span[1]))), offset - span[2]


def _at(micros: int) -> Column:
    """An instant as a constant, without a detour over local times."""
    return F.expr(f"timestamp_micros({micros}L)")


def _narrow_to_times(
    events: DataFrame, width: int, offset: int, limit: int
) -> tuple[DataFrame, int]:
    """By stretches of ``width`` microseconds; instants stay numbers on the driver."""
    micros = "unix_micros(timestamp)"
    oldest, newest, before = _span(events, F.expr(f"{micros} - pmod({micros}, {width}L)"), offset, limit)
    timestamp = F.col("timestamp")
    kept = events.where((timestamp >= _at(oldest)) & (timestamp < _at(newest + width)))
    return kept, offset - before


def _narrow_to_ids(
    events: DataFrame, prefix: int, offset: int, limit: int
) -> tuple[DataFrame, int]:
    """Split runs of equal timestamps by the first characters of the id."""
    keys = [
        ("t", F.expr("unix_micros(timestamp)"), True),
        ("p", F.substring("id", 1, prefix), False),
    ]
    hits = sorted(
        _buckets_of_page(events, keys, offset, limit).collect(),  # at most `limit` rows
        key=lambda row: row["before"],
    )
    first, last = hits[0], hits[-1]
    t, p = F.col("timestamp"), F.substring("id", 1, prefix)
    top, end = _at(first["t"]), _at(last["t"])
    from_first = (t < top) | ((t == top) & (p >= F.lit(first["p"])))
    to_last = (t > end) | ((t == end) & (p <= F.lit(last["p"])))
    return events.where(from_first & to_last), offset - first["before"]


def skip_ahead(
    events: DataFrame, offset: int, limit: int, keep: int = TOP_K_ROWS
) -> tuple[DataFrame, int]:
    """Cut a deep page down to the stretch of time it lies in.

    Counts per day, hour, minute, second, millisecond, instant and id prefix, each within
    the stretch found before, until offset + limit rows fit a top-k. Exact; nothing is sorted
    whole. A step has at most a thousand buckets for each bucket of the step before, and
    that one holds a row of the page, so the ordered sum over buckets stays small.
    """
    keep = max(keep, limit)
    events, offset = narrow_to_days(events, offset, limit)
    for width in (3_600_000_000, 60_000_000, 1_000_000, 1_000, 1):
        if offset + limit <= keep:
            return events, offset
        events, offset = _narrow_to_times(events, width, offset, limit)
    prefix = _ID_STEP
    while offset + limit > keep and prefix <= _ID_LENGTH:
        events, offset = _narrow_to_ids(events, prefix, offset, limit)
        prefix += _ID_STEP
    return events, offset


def is_large(events: DataFrame) -> bool:
    size = estimated_bytes(events)
    return size is None or size > PRUNE_BYTES


def page(
    events: DataFrame,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
    prune: bool | None = None,
    keep: int = TOP_K_ROWS,
    newest: date | None = None,
    oldest: date | None = None,
) -> DataFrame:
    """One page of ``events``, newest first. No event lies outside of the days
    ``oldest`` … ``newest``, where these are given.

    ``prune`` looks up the page's days first, so that a page over a large store reads
    those days only; by default it is used when the store is large. Pages that end below
    ``keep`` rows are always looked up.
    """
    validate_page_args(limit, offset)
    if offset + limit > keep:
        events, offset = skip_ahead(events, offset, limit, keep)
    else:
        if is_large(events) if prune is None else prune:
            days = _stored_days(events)
            if days:
                events = newest_days(events, offset + limit, days, newest, oldest)
            else:
                events, offset = narrow_to_days(events, offset, limit)
    return event_projection(offset_events(events, offset, limit))


def query_page(
    events: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0, **wanted: Moment | None
) -> DataFrame:
    """Filter, order newest first and cut out one page."""
    validate_page_args(limit, offset)
    # The size is that of the files, with or without filters; asking the unfiltered table
    # needs no further planning.
    bounds = {"newest": _bound(wanted.get("end_time")), "oldest": _bound(wanted.get("start_time"))}
    return page(filter_events(events, **wanted), limit, offset, prune=is_large(events), **bounds)


def _bound(moment: Moment | None) -> date | None:
    return as_utc(moment).date() if moment else None


@dataclass(frozen=True)
class Page:
    rows: list
    total: int
    limit: int
    offset: int

    @property
    def has_more(self) -> bool:
        return self.offset + self.limit < self.total


def fetch_page(
    events: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0, **wanted: Moment | None
) -> Page:
    """A page's rows and the total of all matches, as one call; the two jobs run side by side."""
    validate_page_args(limit, offset)
    with ThreadPoolExecutor(2) as pool:
        total = pool.submit(lambda: total_count(events, **wanted).first()["total"])
        rows = pool.submit(lambda: query_page(events, limit, offset, **wanted).collect())
        return Page(rows.result(), total.result(), limit, offset)


def page_after(
    events: DataFrame,
    timestamp: Moment,
    event_id: str,
    limit: int = DEFAULT_LIMIT,
    **wanted: Moment | None,
) -> DataFrame:
    """The page that follows the event ``(timestamp, event_id)``.

    On a large store it opens that event's day and as many before it as fill the page.
    """
    validate_page_args(limit)
    at = F.lit(as_utc(timestamp))
    older = filter_end_time(filter_events(events, **wanted), timestamp).where(
        (F.col("timestamp") < at) | (F.col("id") > F.lit(event_id))
    )
    days = {"newest": _bound(timestamp), "oldest": _bound(wanted.get("start_time"))}
    return page(older, limit, prune=is_large(events), **days)


def total_count(events: DataFrame, **wanted: Moment | None) -> DataFrame:
    return filter_events(events, **wanted).agg(F.count("*").alias("total"))


def page_info(
    events: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0, **wanted: Moment | None
) -> DataFrame:
    """``total, limit, offset, has_more`` of the page, as one row."""
    return info_of_total(total_count(events, **wanted), limit, offset)


def info_of_total(total: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    validate_page_args(limit, offset)
    return total.select(
        "total",
        F.lit(limit).cast("bigint").alias("limit"),
        F.lit(offset).cast("bigint").alias("offset"),
        (F.lit(offset + limit) < F.col("total")).alias("has_more"),
    )


def event_projection(events: DataFrame) -> DataFrame:
    """The fixed eleven columns of an event, without the store's own."""
    return events.selectExpr(*EVENT_COLUMNS)
