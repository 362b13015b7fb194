"""Continuous ingest: a checkpointed stream into the store."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventledger.operators.envelopes import normalize_envelope
from eventledger.plans.ingest import ingest_batch
from eventledger.plans.store import EventStore


def _trigger(interval: str | None) -> dict[str, object]:
    return {"processingTime": interval} if interval else {"availableNow": True}


def ingest_stream(
    raw: DataFrame,
    store: EventStore,
    checkpoint: str,
    interval: str | None = None,
    stored_at: str | None = None,
    max_lengths: bool = False,
) -> StreamingQuery:
    """Start storing ``raw``, a streaming DataFrame.

    Without ``interval`` the stream takes what is there and stops. The checkpoint keeps
    the offsets and the query's id; a batch that is delivered twice is recognised by that id
    and its number, so a restart neither loses nor repeats an event, and a checkpoint that
    is made anew is a new writer. There is no watermark: an event of any age is stored.
    """
    started, writer = threading.Event(), []

    def sink(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        batch_store = EventStore(batch.sparkSession, store.root)
        ingest_batch(batch, batch_store, batch_id, writer[0], stored_at, max_lengths)
        store.refresh()

    query = (
        raw.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(interval))
        .start()
    )
    writer.append(query.id)
    started.set()
    return query


def dedup_stream_bounded(raw: DataFrame, delay: str, salts: int = 16) -> DataFrame:
    """Good rows, one per id, with bounded state.

    Cheaper than the store's key check for fast streams, but not the same: an id that
    arrives again later than ``delay`` passes again, and which copy wins is not fixed. The
    watermark runs on the clock of arrival, not on event times: no row can be late, however
    old its event is.

    The copies of an id are first reduced in ``salts`` groups, by position: an id that
    makes up much of the stream is spread over that many tasks, and at most ``salts`` of
    its rows reach the task that decides.
    """
    good = (
        normalize_envelope(raw)
        .where("error_type IS NULL")
        .selectExpr("*", f"pmod(xxhash64(arrival_seq, received_at, body), {salts}) AS _salt")
        .withColumn("_arrived", F.current_timestamp())
        .withWatermark("_arrived", delay)
    )
    spread = good.dropDuplicatesWithinWatermark(["id", "_salt"]).drop("_salt")
    return spread.dropDuplicatesWithinWatermark(["id"]).drop("_arrived")


def dedup_stream_settled(raw: DataFrame, delay: str) -> DataFrame:
    """Good rows, one per id and session: copies of an id that follow one another within
    ``delay`` on the clock of receipt are one session, and its first copy by
    (received_at, arrival_seq) comes out.

    The result does not depend on how the stream is cut into micro-batches, as a session
    comes out only when the watermark has passed its end: ``delay`` after its last copy, and
    a copy may be late by ``delay``. State is one row for each open session; copies are
    joined before the shuffle as well, so an id that fills much of the stream sends a row
    for each task.
    """
    spark = raw.sparkSession
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    good = normalize_envelope(raw).where("error_type IS NULL").drop("error_type", "error").withWatermark("received_at", delay)
    first = F.min_by(F.struct(*good.columns), F.struct("received_at", "arrival_seq", F.xxhash64("body")))
    return good.groupBy("id", F.session_window("received_at", delay)).agg(first.alias("_first")).select("_first.*")


def append_stream(
    rows: DataFrame, path: str, checkpoint: str, interval: str | None = None, fmt: str = "parquet"
) -> StreamingQuery:
    """Start writing a streaming DataFrame to files."""
    return (
        rows.writeStream.format(fmt)
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(interval))
        .start()
    )
