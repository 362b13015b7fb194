"""One batch of raw messages into the store: good rows, rejects, nothing lost."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventledger.functions.fields import default_routing_key, storage_latency
from eventledger.operators.envelopes import normalize_envelope
from eventledger.operators.uniqueness import first_writes
from eventledger.plans.commits import APPEND, Change
from eventledger.plans.store import EventStore
from eventledger.schema import FEED_ROUTING_KEY, INTEGRITY_ERROR

# Ids of a batch are broadcast to the key check up to this size, and so are the row numbers
# that split it; beyond it these are shuffled joins.
BROADCAST_BYTES = 64 << 20
_ROW_OVERHEAD = 32

_DUPLICATE = "event id is already stored"


def stamp(rows: DataFrame, stored_at: str | None = None) -> DataFrame:
    """Add ``stored_at``, one value per batch, and the latency since receipt.

    ``stored_at``, an SQL expression, is a literal taken now unless a backfill knows
    better: it must not change when a lost partition is computed again.
    """
    if stored_at is None:
        stored_at = f"TIMESTAMP '{datetime.now(timezone.utc).isoformat()}'"
    return rows.selectExpr("*", f"{stored_at} AS stored_at").selectExpr(
        "*", f"{storage_latency()} AS storage_latency_ms"
    )


def without_feed(raw: DataFrame, routing_keys: Sequence[str] = (FEED_ROUTING_KEY,)) -> DataFrame:
    """Drop the store's own announcements, which would otherwise announce themselves."""
    return raw.where(~F.expr(default_routing_key()).isin(*routing_keys))


def _held_ids(store: EventStore, firsts: DataFrame) -> DataFrame:
    """``id, bucket, event_date, file, writer, batch_id`` of those first writes that the key holds.

    Opens the key's buckets that these ids lie in. The batch is the build side as long as
    it is small, so the key is read but not shuffled.
    """
    buckets = store.keys.buckets
    ids = firsts.selectExpr("id", f"{store.keys.bucket_of(buckets)} AS bucket")
    size, wanted = ids.selectExpr(f"sum(octet_length(id) + {_ROW_OVERHEAD})", "collect_set(bucket)").first()
    if (size or 0) <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    return store.keys.held(ids, sorted(wanted), buckets)


def ingest_batch(
    raw: DataFrame,
    store: EventStore,
    batch_id: int = 0,
    writer: str | None = None,
    stored_at: str | None = None,
    max_lengths: bool = False,
    skip_routing_keys: Sequence[str] = (FEED_ROUTING_KEY,),
) -> None:
    """Store the good messages of ``raw`` and quarantine the others.

    ``(writer, batch_id)`` names the batch; without a writer the call is a batch of its own.
    Running a named batch again, as a restarted stream does, changes nothing: events the
    batch has stored are left alone, not taken for duplicates, and rejects that are
    written stay. A name that comes back with other messages is an error.

    One ingest at a time runs on a store: from the key check to the append a batch holds the
    store's next change, and another one waits, or gives up (see ``commits``).

    The key check opens the key's buckets of the batch's ids; the events are not read.

    First write wins per id, by ``arrival_seq`` within the batch and by batch otherwise.
    Joins run on the row number or on ids that are unique by then, never on the raw ids,
    so an id that fills a third of the batch does not end up in one task.

    The decoded batch is written to the store's staging folder first. That decodes every
    body once and fixes the row numbers: a partition that is lost later on is read
    again, not numbered anew. Each step after it reads only the columns it needs. What the
    checks find is staged beside it as row numbers, and the fewer of stored and rejected
    ones split the batch, so whole rows mostly meet no shuffle before the write by day.
    """
    normalized = normalize_envelope(without_feed(raw, skip_routing_keys), max_lengths)
    given = [f"{stored_at} AS _stored_at"] if stored_at else []
    numbered = normalized.selectExpr(
        "*",
        "monotonically_increasing_id() AS _row",
        "xxhash64(body, routing_key, received_at, arrival_seq) AS _code",
        *given,
    )
    writer = writer or f"batch-{uuid.uuid4().hex}"
    stage = hashlib.md5(f"{writer}/{batch_id}/{uuid.uuid4().hex}".encode()).hexdigest()
    rows = store.refresh().stage(numbered, f"{stage}/rows")
    try:
        count, code, good = rows.selectExpr(
            "count(*)", "sum(CAST(_code AS DECIMAL(20, 0)))", "count_if(error_type IS NULL)"
        ).first()
        change = store.begin(APPEND, writer, batch_id)
        change.named = True
        try:
            _ingest_staged(rows, store, change, f"{count}_{code or 0}", stage, good, stored_at)
        finally:
            store.commits.cancel(change)  # nothing, once it is ready
    finally:
        store.drop_stage(stage)


def _ingest_staged(
    rows: DataFrame, store: EventStore, change: Change, digest: str, stage: str, good_count: int, stored_at: str | None
) -> None:
    writer, batch_id = change.writer, change.batch_id
    known = store.batch_state(writer, batch_id)
    if known.get("digest", digest) != digest:
        raise ValueError(f"batch {batch_id} of {writer} came with other messages before")
    if "events" in known:
        return
    store.record_batch(writer, batch_id, digest=digest)
    # Records of several partitions of a topic are ordered by time, not by offset alone.
    position = [n for n in ("received_at", "topic", "partition") if "partition" in rows.columns and n in rows.columns]
    order = (*position, "arrival_seq", "_row")
    good = rows.where("error_type IS NULL")
    firsts = first_writes(good.select("id", *order), order=order).select("id", "_row")
    flags = _flagged(store, store.stage(firsts, f"{stage}/firsts"), change, stage)
    accepted, late = _split(store, good, flags, good_count, stage)
    rejects = _rejects(rows, late)
    if "rejects" not in known:
        store.write_quarantine(rejects, writer, batch_id)
        store.record_batch(writer, batch_id, rejects="written")
    # The stamp comes last, so that the latency covers the work up to the append.
    stamped = stamp(accepted, "_stored_at" if stored_at else None)
    store.append_events(stamped, writer, batch_id, change, rejects)


def _flagged(store: EventStore, firsts: DataFrame, change: Change, stage: str) -> DataFrame:
    """``_row`` of the first writes, with ``_by_us``: NULL for a new id, TRUE for one that this
    batch has stored already, FALSE for one that is taken."""
    held = store.stage(_held_ids(store, firsts), f"{stage}/held")
    if held.isEmpty():
        return firsts.selectExpr("_row", "CAST(NULL AS BOOLEAN) AS _by_us")
    by_us = ((F.col("writer") == change.writer) & (F.col("batch_id") == change.batch_id)).alias("_by_us")
    # The key may hold a row twice; hits are few.
    found = store.keys.live(held).select("id", by_us).distinct()
    return store.stage(firsts.join(found, "id", "left").select("_row", "_by_us"), f"{stage}/flags")


def _split(
    store: EventStore, good: DataFrame, flags: DataFrame, good_count: int, stage: str
) -> tuple[DataFrame, DataFrame]:
    """The good rows to store, and those that come second to their id.

    Mostly one of the two is a small part. Only its row numbers then go to the tasks, which
    read the batch as it lies; when both are large the joins shuffle it.
    """
    fresh, ours = flags.where("_by_us IS NULL").select("_row"), flags.where("_by_us").select("_row")
    fresh_count, ours_count = flags.selectExpr("count_if(_by_us IS NULL)", "count_if(_by_us)").first()
    stored, stored_count = fresh.union(ours) if ours_count else fresh, fresh_count + ours_count
    late_count = good_count - stored_count
    if late_count > stored_count:
        late = good.join(_small(stored, stored_count), "_row", "left_anti")
        return good.join(_small(fresh, fresh_count), "_row", "left_semi"), late
    accepted, late = good, good.limit(0)
    if late_count:
        numbers = store.stage(good.select("_row").join(stored, "_row", "left_anti"), f"{stage}/late")
        numbers = _small(numbers, late_count)
        accepted, late = good.join(numbers, "_row", "left_anti"), good.join(numbers, "_row", "left_semi")
    if ours_count:
        accepted = accepted.join(_small(ours, ours_count), "_row", "left_anti")
    return accepted, late


def _small(numbers: DataFrame, count: int) -> DataFrame:
    """Row numbers, broadcast up to ``BROADCAST_BYTES``."""
    return F.broadcast(numbers) if count * _ROW_OVERHEAD <= BROADCAST_BYTES else numbers


def _rejects(rows: DataFrame, late: DataFrame) -> DataFrame:
    """Rows that failed before storing, and good rows that came second to their id."""
    return rows.where("error_type IS NOT NULL").unionByName(late.select(rows.columns)).selectExpr(
        "* EXCEPT (error_type, error)",
        f"coalesce(error_type, '{INTEGRITY_ERROR}') AS error_type",
        f"coalesce(error, '{_DUPLICATE}') AS error",
    )
